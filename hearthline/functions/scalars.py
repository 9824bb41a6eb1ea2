"""Column -> Column functions. Built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

from hearthline import config as C


# Every Unicode white-space character.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.trim(c, F.lit(WHITE_SPACE))


def _first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first, *rest = rules
    return reduce(lambda acc, r: acc.when(*r), rest, F.when(*first)).otherwise(otherwise)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps null (``greatest``/``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Text to double; what is no number, or reads as NaN, becomes null."""
    return nan_to_null(strip(c.cast("string")).try_cast("double"))


# --- dates, age, floors, places -------------------------------------------------------------------


def construction_age_num(c: Column) -> Column:
    """Age band or bare year to a representative year."""
    text = strip(c)
    pairs = [(p + k, v) for p in (C.AGE_BAND_PREFIX, "") for k, v in C.AGE_BAND_YEAR.items()]
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    year = F.when(text.rlike(r"^\d{4}$"), text.try_cast("int"))
    return F.coalesce(
        F.try_element_at(known, text).cast("double"),
        F.when(year.between(*C.AGE_YEAR_RANGE), year.cast("double")),
    )


def floor_level_num(c: Column) -> Column:
    """Storey of a flat: basement -1, ground 0, n-th floor n."""
    t = F.lower(strip(c))
    ordinal = r"^(\d{1,2})\s*(?:st|nd|rd|th)?(?:\s*floor)?$"
    return _first_match(
        [
            (t.contains("basement"), F.lit(-1.0)),
            (t.startswith("ground") | t.isin("g", "gf"), F.lit(0.0)),
            (t.rlike(ordinal), F.regexp_extract(t, ordinal, 1).try_cast("double")),
            (t.rlike(r"^[+-]?\d+$"), t.try_cast("double")),
        ],
        F.lit(None).cast("double"),
    )


def postcode_district(c: Column) -> Column:
    return F.coalesce(F.split_part(F.upper(c), F.lit(" "), F.lit(1)), F.lit("UNK"))


def era(c: Column, scheme=C.ERA_LEFT_CLOSED, right_closed: bool = False, null_label: str | None = None) -> Column:
    """Era label of a year; years outside every bin get ``null_label``."""
    inside = (lambda lo, hi: (c > lo) & (c <= hi)) if right_closed else (lambda lo, hi: (c >= lo) & (c < hi))
    return _first_match([(inside(lo, hi), F.lit(lab)) for lo, hi, lab in scheme], F.lit(null_label).cast("string"))


# --- free-text fabric descriptions ----------------------------------------------------------------


def text_flag(c: Column, pattern: str) -> Column:
    """1 when the text contains the pattern (any case); null text counts as empty."""
    return F.coalesce(c, F.lit("")).rlike(f"(?id){pattern}").cast("int")


def loft_depth_mm(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    depth = F.coalesce(F.regexp_extract(text, f"(?i){C.LOFT_DEPTH_PATTERN}", 1).try_cast("int"), F.lit(0))
    return F.when(text.rlike(f"(?id){C.NO_LOFT_PATTERN}"), F.lit(0)).otherwise(depth)


def wall_type(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return _first_match([(text.rlike(p), F.lit(kind)) for kind, p in C.WALL_KINDS], F.lit("other"))


def measure_name(c: Column) -> Column:
    """Name of a measure without its capacity suffix."""
    return strip(F.substring_index(c, ",", 1))


def parse_cost(c: Column) -> Column:
    """Cost text to a struct (low, high, mid): a range anywhere in the text, else its first number."""
    # groups: 1-2 the ends of a range, 3 a lone number; a hyphen makes a range, a dash does not
    pattern = r"(?s)^(?:.*?([\d,]+)[\s\p{Z}]*-[\s\p{Z}]*£?([\d,]+)|.*?([\d,]+)).*$"
    # one match per text; a text without a digit stays as it is and no part of it is a number
    parts = F.split(F.regexp_replace(c, pattern, "$1;$2;$3"), ";")

    def number(i: int) -> Column:
        return F.replace(F.get(parts, F.lit(i)), F.lit(","), F.lit("")).try_cast("double")

    is_range = F.get(parts, F.lit(0)) != ""
    low = F.when(is_range, number(0)).otherwise(number(2))
    high = F.when(is_range, number(1)).otherwise(number(2))
    return F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2.0).alias("mid"))


# --- ratios ---------------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clipped_ratio(a: Column, b: Column) -> Column:
    return clip(ratio(a, b), 0.0, 1.0)


# --- scores and bands -----------------------------------------------------------------------------


def clip_score(c: Column) -> Column:
    return clip(c.cast("double"), C.SCORE_MIN, C.SCORE_MAX)


def _by_cut_off(c: Column, labels: list, fallback) -> Column:
    """Label of the highest cut-off reached. Clipping to the scale would not move a
    score across a cut-off, so the raw score is compared; this keeps the generated code short.
    """
    rules = [(c.isNull() | F.isnan(c), F.lit(fallback))]
    rules += [(c >= F.lit(float(C.BAND_LOWER[b])), F.lit(v)) for b, v in zip(C.BANDS[:-1], labels)]
    return _first_match(rules, F.lit(labels[-1]))


def score_to_band(c: Column) -> Column:
    """Band of a score; a null or NaN score falls back to the middle band."""
    return _by_cut_off(c.cast("double"), list(C.BANDS), C.FALLBACK_BAND)


def score_to_code(c: Column) -> Column:
    """Index 0..6 of the score's band."""
    return _by_cut_off(c.cast("double"), list(range(len(C.BANDS))), C.BANDS.index(C.FALLBACK_BAND))


def encode_band(c: Column) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(x) for i, b in enumerate(C.BANDS) for x in (b, i)]), c
    )


def decode_band(c: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(b) for b in C.BANDS]), c.cast("int") + 1)


def confidence_proxy(c: Column) -> Column:
    """1 at the middle of a band, 0 at its edge; 0 in the gaps between bands."""
    rules = []
    for band in C.BANDS:
        lo, up = C.BAND_LOWER[band], C.BAND_UPPER[band]
        mid, half = (lo + up) / 2.0, max(1.0, (up - lo) / 2.0)
        rules.append((c.between(lo, up + 0.999), F.lit(1.0) - F.abs(c - mid) / half))
    return clip(_first_match(rules, F.lit(0.0)), 0.0, 1.0)


# --- decoding class probabilities -----------------------------------------------------------------


def cumulative(probs: Column) -> Column:
    """Running sum of an array of probabilities."""
    return F.transform(
        F.sequence(F.lit(1), F.size(probs)),
        lambda i: F.aggregate(F.slice(probs, 1, i), F.lit(0.0), lambda a, p: a + p),
    )


def expected_class(probs: Column) -> Column:
    """Rounded (half to even) expectation of the class index, kept inside the domain."""
    weighted = F.zip_with(
        probs, F.sequence(F.lit(0), F.size(probs) - 1), lambda p, k: p * k
    )
    mean = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)
    return F.least(F.greatest(F.bround(mean, 0).cast("int"), F.lit(0)), F.size(probs) - 1)


def argmax_class(probs: Column) -> Column:
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def threshold_class(cum: Column, thresholds: Column) -> Column:
    """First class whose cumulative probability reaches its threshold, else the last class."""
    hits = F.filter(
        F.sequence(F.lit(0), F.size(cum) - 1),
        lambda k: F.element_at(cum, k + 1) >= F.element_at(thresholds, k + 1),
    )
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.size(cum) - 1)


def rank_class(exceed: Column, cut: float = 0.5) -> Column:
    """Number of exceedance probabilities P(Y > k) at or above ``cut``."""
    return F.size(F.filter(exceed, lambda p: p >= cut))


def exceed_targets(c: Column, classes: int = len(C.BANDS)) -> Column:
    """Binary targets Y > k for k = 0 .. classes-2."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 2)), lambda k: (c > k).cast("int"))


def mean_probability(*probs: Column) -> Column:
    """Element-wise mean of several probability arrays (soft vote)."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), probs)
    return F.transform(total, lambda v: v / F.lit(float(len(probs))))
