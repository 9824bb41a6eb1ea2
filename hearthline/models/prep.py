"""Feature preparation fitted on training rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from hearthline import config as C
from hearthline.functions.hashing import hash32
from hearthline.operators.orderstats import PER_RANGE, bucket_count, exact_percentiles, place_among, running_totals
from hearthline.operators.repair import fill_missing_level, numeric_columns
from hearthline.operators.skew import attach_by_key
from hearthline.session import staged
from hearthline.operators.summary import cardinalities

LOW_CARD = 25
RARE_BELOW = 20
MAX_DRIVER_LEVELS = 200_000


def column_groups(df: DataFrame, cols: Iterable[str] | None = None, low_card: int = LOW_CARD) -> DataFrame:
    """(column, group, levels): numeric by type, text split by its number of levels."""
    cols = list(cols or df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in cols if isinstance(kinds[c], NumericType)]
    text = [c for c in cols if c not in numeric]
    spark = df.sparkSession
    out = spark.createDataFrame([(c, "numeric", None) for c in numeric], "column string, group string, levels bigint")
    if text:
        counted = cardinalities(df, text).select(
            "column",
            F.when(F.col("n_distinct") <= low_card, "low_card").otherwise("high_card").alias("group"),
            F.col("n_distinct").alias("levels"),
        )
        # a column that is null everywhere has no levels to count
        named = spark.createDataFrame([(c,) for c in text], "column string").join(counted, "column", "left")
        out = out.unionByName(
            named.select("column", F.coalesce("group", F.lit("low_card")).alias("group"), F.coalesce("levels", F.lit(0)).alias("levels"))
        )
    return out


# --- exact preparation steps ----------------------------------------------------------------------


def fit_numeric(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """(median, interquartile range after imputation) per column, exact; 0 and 1 where there is nothing to measure."""
    learn = train.select(*[F.col(c).cast("double").alias(c) for c in cols])
    medians = exact_percentiles(learn.unpivot([], cols, "column", "value"), "value", {"m": 0.5}, ["column"])
    fill = {c: 0.0 for c in cols} | {r["column"]: r["m"] for r in medians.collect()}  # one row per column
    filled = learn.fillna(fill)
    quart = exact_percentiles(filled.unpivot([], cols, "column", "value"), "value", {"q1": 0.25, "q3": 0.75}, ["column"])
    span = {r["column"]: (r["q3"] - r["q1"]) or 1.0 for r in quart.collect()}
    return {c: (fill[c], span.get(c, 1.0)) for c in cols}


def impute_and_scale(df: DataFrame, train: Column, cols: list[str]) -> DataFrame:
    """Median imputation, then (x - median) / interquartile range, both from the training rows."""
    fitted = fit_numeric(df.where(train), cols)
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(q) for c, (m, q) in fitted.items()})


@dataclass(frozen=True)
class Levels:
    """Levels of low-cardinality columns: what fills a null, what gets a column, what is folded."""

    mode: dict[str, str]
    kept: dict[str, tuple[str, ...]]
    rare: dict[str, tuple[str, ...]]

    def one_hot(self, df: DataFrame) -> DataFrame:
        """``col=level`` columns; rare levels share ``col=(rare)``; an unknown level is all zeros."""
        new: dict[str, Column] = {}
        for c, kept in self.kept.items():
            value = F.coalesce(F.col(c), F.lit(self.mode[c]))
            new |= {f"{c}={v}": (value == v).cast("int") for v in kept}
            if self.rare[c]:
                new[f"{c}=(rare)"] = value.isin(*self.rare[c]).cast("int")
        return df.withColumns(new)


def fit_levels(df: DataFrame, train: Column, cols: list[str], min_count: int = RARE_BELOW) -> Levels:
    """Count the levels of low-cardinality columns on the training rows."""
    long = df.where(train).select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    nulls = df.where(train).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    wide = counts.groupBy("column").agg(F.count(F.lit(1)).alias("levels")).where(F.col("levels") > LOW_CARD).collect()  # one row per column
    if wide:
        raise ValueError(f"more than {LOW_CARD} levels; encode by rank instead: {sorted(r['column'] for r in wide)}")
    rows = counts.collect()  # at most LOW_CARD rows per column
    mode, kept, rare = {}, {}, {}
    for c in cols:
        mine = sorted(((r["value"], r["n"]) for r in rows if r["column"] == c), key=lambda x: (-x[1], x[0]))
        mode[c] = mine[0][0] if mine else C.MISSING_LEVEL
        imputed = {v: n + (nulls[c] if v == mode[c] else 0) for v, n in mine}
        kept[c] = tuple(sorted(v for v, n in imputed.items() if n >= min_count))
        rare[c] = tuple(sorted(v for v, n in imputed.items() if n < min_count))
    return Levels(mode, kept, rare)


def level_codes(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """(level, code): alphabetical rank of every distinct level.

    Levels picked by hash cut the alphabet into ranges that are ranked apart, about ``PER_RANGE`` levels in each, or ``buckets`` ranges,
    so even very many levels never meet in one task. The cuts stay in the plan; the driver sees their number only.
    """
    levels = staged(df.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct().withColumn("one", F.lit(1).cast("bigint")), "levels")
    total = levels.count()
    wanted = min(buckets or -(-total // PER_RANGE), bucket_count(levels, buckets), total)
    if wanted <= 1:
        return running_totals(levels, ["level"], [], ["one"]).select("level", F.col("one_before").cast("int").alias("code"))
    # a share of the levels by hash: about ``wanted`` of them, by chance a few more
    cuts = levels.where(hash32("edges", F.col("level")) < int((1 << 32) * wanted / total)).agg(F.sort_array(F.collect_list("level"))).scalar()
    bucketed = levels.withColumn("_cuts", cuts).withColumn("_bucket", place_among(F.col("_cuts"), F.col("level"), 4 * wanted + 64)).drop("_cuts")
    return running_totals(bucketed, ["level"], [], ["one"], "_bucket").select("level", F.col("one_before").cast("int").alias("code"))


def ordinal_encode(df: DataFrame, train: Column, col: str, name: str | None = None) -> DataFrame:
    """Alphabetical code of a level seen in training, -1 for an unknown one; null takes the training mode."""
    learn = df.where(train)
    counts = learn.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.agg(F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col)))).scalar()
    filled = df.withColumn("_level", F.coalesce(F.col(col), mode))
    seen = filled.groupBy("_level").agg(F.count(F.lit(1)).alias("_rows"))
    codes = level_codes(learn, col).withColumnRenamed("level", "_level")
    table = seen.join(codes, "_level", "left").select("_level", "_rows", F.coalesce("code", F.lit(-1)).alias("_code"))
    out = attach_by_key(filled, table, ["_level"], "_rows")
    return out.withColumn(name or f"{col}_code", F.coalesce("_code", F.lit(-1))).drop("_level", "_code")


# --- Spark ML preparation -------------------------------------------------------------------------


def split_groups(df: DataFrame, cols: Iterable[str]) -> dict[str, list[str]]:
    """Column names per group, from ``column_groups``."""
    rows = column_groups(df, cols).collect()  # one row per column
    too_many = [r["column"] for r in rows if (r["levels"] or 0) > MAX_DRIVER_LEVELS]
    if too_many:
        raise ValueError(f"columns with more than {MAX_DRIVER_LEVELS} levels need ordinal_encode: {too_many}")
    order = {c: i for i, c in enumerate(cols)}
    picked = sorted(rows, key=lambda r: order[r["column"]])
    return {g: [r["column"] for r in picked if r["group"] == g] for g in ("numeric", "low_card", "high_card")}


def _text(value: str) -> str:
    """A value as an SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Preparation:
    """The exact steps above as stages that can be saved: ``fit`` learns from the rows it is given only.

    Numbers take their median and, if ``scale``, are centred and divided by the interquartile range. A level of a low-cardinality
    column has its own 0/1 column, levels of fewer than ``min_count`` rows share one, and an unknown level is all zeros. Other text
    becomes the alphabetical code of its level, -1 if unknown. Trees take ``scale=False``. Null text must be filled beforehand
    (``ready``).
    """

    cols: tuple[str, ...]
    scale: bool = True
    features: str = "features"
    min_count: int = RARE_BELOW

    def fit(self, train: DataFrame) -> PipelineModel:
        groups = split_groups(train, self.cols)
        numeric, low, high = groups["numeric"], groups["low_card"], groups["high_card"]
        new: dict[str, str] = {}
        for c, (m, q) in (fit_numeric(train, numeric) if numeric else {}).items():
            filled = f"coalesce(double(`{c}`), {m!r}D)"
            new[f"{c}__num"] = f"({filled} - ({m!r}D)) / {q!r}D" if self.scale else filled
        if low:
            levels = fit_levels(train, F.lit(True), low, self.min_count)
            for c in low:
                value = f"coalesce(`{c}`, {_text(levels.mode[c])})"
                new |= {f"{c}__hot{i}": f"double({value} = {_text(v)})" for i, v in enumerate(levels.kept[c])}
                if levels.rare[c]:
                    new[f"{c}__rare"] = f"double({value} IN ({', '.join(map(_text, levels.rare[c]))}))"
        parts = list(new)
        stages: list = [SQLTransformer(statement=f"SELECT *{''.join(f', {e} AS `{c}`' for c, e in new.items())} FROM __THIS__")]
        if high:
            codes = StringIndexer(inputCols=high, outputCols=[f"{c}__ord" for c in high], handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
            # the indexer puts unknown levels behind the last code
            known = {f"{c}__code": f"CASE WHEN `{c}__ord` < {len(v)} THEN `{c}__ord` + 0.0D ELSE -1.0D END" for c, v in zip(high, codes.labelsArray, strict=True)}
            stages += [codes, SQLTransformer(statement=f"SELECT *{''.join(f', {e} AS `{c}`' for c, e in known.items())} FROM __THIS__")]
            parts += list(known)
        stages.append(VectorAssembler(inputCols=parts, outputCol=self.features, handleInvalid="keep"))
        return PipelineModel(stages=stages)


def preparation(cols: Iterable[str], *, scale: bool = True, features: str = "features") -> Preparation:
    return Preparation(tuple(cols), scale, features)


def ready(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers as double and null text as its own level, as the stages expect."""
    numeric = set(numeric_columns(df))
    typed = df.withColumns({c: F.col(c).cast("double") for c in cols if c in numeric})
    return fill_missing_level(typed, [c for c in cols if c not in numeric])
