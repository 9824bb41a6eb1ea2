"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (letters and digits, A-Z as a-z); a text of one to four words is one shingle. Its weight is its
count in the text times 1 + ln(1 / max(df, ``floor``)), df being the share of documents that hold it, counted over all documents in
hashed buckets. Chance adds to each bucket the mean number of shingles per document over ``2**DF_BITS``, whatever the corpus size; the floor is twice
that, as measured on the corpus, unless one is given. So a passage that many documents share weighs less than their own words, and documents that
differ in all but a common template stay apart.

Equal texts are one node. Each text gives ``bands * rows`` weighted samples; two texts agree in one with a probability of their
weighted Jaccard similarity. Texts that agree in all rows of a band are candidates, and every candidate pair is verified once, in the
first band in which it agrees, with the exact weighted Jaccard of its whole texts. The pairs of a bucket of at most ``small`` nodes are
rows. A larger bucket is dealt into parts of about ``part_texts`` nodes or ``part_bytes`` of text at most; a task holds two parts, compares
all their pairs by products of matrices, and returns the number of links of each node and the classes within the two parts, never pairs.
Its work is that of all pairs, and a text travels once per part of its bucket. Links of at least ``similarity`` are joined to classes by
repeated minimum labels with shortcuts; every round is written to the shared folder.

At a similarity of 0.8 a pair shares some band with probability 1 - (1 - 0.8**3)**10 = 0.999, and a class needs only some chain of links.
``n_links`` counts the links among those pairs.

Null texts are empty. Texts without words are alike only if equal. Rows that repeat a doc_id are rows like any other: exactly one row of
each class has ``kept``, the one with the smallest doc_id (nulls last), then the first in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.common import map_arrow, staged, texts_of, thinned
from hearthline.llm.ngrams import LETTER, lowered
from hearthline.llm.textblocks import Block, U, blocks, mix, window_hash
from hearthline.operators.skew import attach_by_key

WORDS, DF_BITS = 5, 18


def gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of equal shares."""
    x = np.concatenate([np.linspace(0, 2, 200_000), np.linspace(2, 40, 200_000)[1:]])
    return np.interp((np.arange(size) + 0.5) / size, 1 - (1 + x) * np.exp(-x), x)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner text, hash and count of each distinct shingle, ordered by text."""
    word = lowered(block)
    at = block.windows(WORDS)
    owner, value = block.owner()[at], window_hash(word, at, WORDS)
    n = block.counts()
    for k in range(1, WORDS):
        few = np.flatnonzero(n == k)
        owner, value = np.concatenate([owner, few]), np.concatenate([value, window_hash(word, block.first[few], k)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(value)))


def bucket_of(value: np.ndarray) -> np.ndarray:
    return (value >> U(64 - DF_BITS)).astype(np.int64)


def inverse_shares(texts: DataFrame, floor: float | None) -> np.ndarray:
    """1 + ln(1 / max(df, floor)) per bucket. Only buckets above the floor reach the driver, fewer than there are buckets. Runs a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << DF_BITS, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in blocks(batch["text"], LETTER):
                owner, value, _ = shingles(block)
                pair = np.unique((owner << DF_BITS) | bucket_of(value))
                total += np.bincount(pair & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    counted = staged(texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "shares")
    n, held = counted.agg(F.sum(F.when(F.col("bucket") < 0, F.col("n"))), F.sum(F.when(F.col("bucket") >= 0, F.col("n")))).first()
    if floor is None:
        floor = min(1.0, max(2 * (held or 0) / ((n or 1) << DF_BITS), 1 / max(n or 1, 1)))
    weight = np.full(1 << DF_BITS, 1 - np.log(floor))
    found = counted.where(F.col("bucket") >= 0).where(F.col("n") > floor * (n or 0)).toArrow()
    weight[found["bucket"].to_numpy()] = 1 - np.log(found["n"].to_numpy() / max(n or 1, 1))
    return weight


def weighted_samples(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, samples: int) -> np.ndarray:
    """Consistent weighted samples of each text: an array (samples, texts); texts without shingles have 0."""
    out = np.zeros((samples, n), dtype=U)
    if not len(value):
        return out
    table = gamma_table()
    log_table = np.log(table)
    log_weight = np.log(weight)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.append(first, len(owner)))
    for k in range(samples):
        m = mix(value + U((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = table[(m >> U(48)).astype(np.int64)]
        log_c = log_table[((m >> U(32)) & U(0xFFFF)).astype(np.int64)]
        beta = (m & U(0xFFFFFFFF)).astype(np.float64) / 2.0**32
        t = np.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta + 1.0)
        least = np.repeat(np.minimum.reduceat(log_a, first), sizes)
        name = np.where(log_a == least, mix(m + t.astype(np.int64).view(U)), U(0))
        out[k, owner[first]] = np.maximum.reduceat(name, first)
    return out


def signatures(rows: DataFrame, weight: np.ndarray, bands: int, per_band: int) -> DataFrame:
    """rid, doc_id, copy_of (digest of the text), its bytes, and one hash per band; no bands for a text without words."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch["text"], LETTER):
            owner, value, times = shingles(block)
            got = weighted_samples(owner, value, times * weight[bucket_of(value)], block.n, bands * per_band)
            keys = np.zeros((bands, block.n), dtype=U)
            for i in range(bands * per_band):
                keys[i // per_band] = mix(keys[i // per_band] * U(31) + got[i] + U(1))
            has = np.bincount(owner, minlength=block.n) > 0
            flat = keys.T.reshape(-1).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c][block.rows] for c in ("rid", "doc_id", "copy_of")), pa.array(np.diff(block.off)), pa.compute.if_else(pa.array(has), lists, pa.scalar(None, lists.type))],
                names=["rid", "doc_id", "copy_of", "n_bytes", "bands"],
            )

    own = rows.select("rid", "doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("copy_of"))
    return map_arrow(own, step, "rid long, doc_id long, copy_of binary, n_bytes long, bands array<long>")


def candidates(nodes: DataFrame, small: int, part_texts: int, part_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes (rid, n_bytes, bands) to verify: those of small buckets (a < b), and the parts (band, key, i, j) of larger ones.

    A pair of nodes is in small buckets at most once, in the first band in which it agrees.
    """
    rows = nodes.where("bands IS NOT NULL").select(F.col("rid").alias("node"), "n_bytes", "bands", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total")).where("n > 1")
    sized = staged(rows.drop("n_bytes").join(sizes, ["band", "key"]), "buckets")
    pairs = (
        sized.where(F.col("n") <= small)
        .groupBy("band", "key")
        .agg(F.array_sort(F.collect_list(F.struct("node", "bands"))).alias("nodes"))
        .select("band", F.posexplode("nodes").alias("i", "a"), "nodes")
        .select("band", "a", F.explode(F.slice("nodes", F.col("i") + 2, small)).alias("b"))
        .where("NOT exists(zip_with(slice(a.bands, 1, band), slice(b.bands, 1, band), (x, y) -> x = y), same -> same)")
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    )
    parts = F.ceil(F.greatest(F.col("n") / part_texts, F.col("total") / part_bytes)).cast("int")
    dealt = sized.where(F.col("n") > small).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return pairs, met.select("node", "bands", "band", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def shared_weight(left: list[np.ndarray], right: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """The sum of smaller amounts of each left and each right text, both given as (owner, value, count) of their shingles."""

    def levels(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A shingle that occurs c times stands for c features: its first to its c-th occurrence."""
        owner, value, times = side
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(owner, times), np.repeat(value, times), nth

    n, m = (int(side[0].max()) + 1 if len(side[0]) else 0 for side in (left, right))
    out = np.zeros(n * m)
    if not out.size:
        return out.reshape(n, m)
    (lo, lv, ln), (ro, rv, rn) = levels(left), levels(right)
    value, nth = np.concatenate([lv, rv]), np.concatenate([ln, rn])
    order = np.lexsort((nth, value))
    new = np.r_[True, (value[order][1:] != value[order][:-1]) | (nth[order][1:] != nth[order][:-1])]
    feature = np.empty(len(order), dtype=np.int64)
    feature[order] = np.cumsum(new) - 1
    unit = weight[bucket_of(value[order][new])]
    lf, rf = feature[: len(lo)], feature[len(lo) :]
    nl, nr = np.bincount(lf, minlength=len(unit)), np.bincount(rf, minlength=len(unit))
    rare = (nl * nr > 0) & (nl * nr * 100 < n * m)
    # few texts on both sides: name the pairs, two million at a time
    at = np.flatnonzero(rare[lf])
    by = np.argsort(rf, kind="stable")
    begin = np.cumsum(nr) - nr
    upto = np.cumsum(nr[lf[at]])
    while len(at):
        to = max(1, int(np.searchsorted(upto, 2_000_000)))
        own, upto = at[:to], upto[to:] - upto[to - 1]
        at = at[to:]
        times = nr[lf[own]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        mate = ro[by[np.repeat(begin[lf[own]], times) + nth]]
        out += np.bincount(np.repeat(lo[own], times) * m + mate, np.repeat(unit[lf[own]], times), minlength=n * m)
    out = out.reshape(n, m)
    common = np.flatnonzero((nl * nr > 0) & ~rare)
    place = np.full(len(unit), -1)
    place[common] = np.arange(len(common))
    lp, rp = place[lf], place[rf]
    width = 1024
    lorder, rorder = np.argsort(lp, kind="stable"), np.argsort(rp, kind="stable")
    for start in range(0, len(common), width):
        both = []
        for owner, p, by_place, rows in ((lo, lp, lorder, n), (ro, rp, rorder, m)):
            own = by_place[slice(*np.searchsorted(p, [start, start + width], sorter=by_place))]
            dense = np.zeros((rows, min(width, len(common) - start)))
            dense[owner[own], p[own] - start] = 1
            both.append(dense)
        out += (both[0] * unit[common[start : start + width]]) @ both[1].T
    return out


def compare_parts(met: DataFrame, weight: np.ndarray, similarity: float) -> DataFrame:
    """Of parts (node, bands, band, key, part, i, j, text): n links of a node without other, and other (with n 0) of the node's class."""

    def side(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        got, before = [], 0
        for block in blocks(texts, LETTER):
            owner, value, times = shingles(block)
            got.append((owner + before, value, times))
            before += block.n
        owner, value, times = (np.concatenate(c) for c in zip(*got, strict=True))
        return [owner, value, times], np.bincount(owner, times * weight[bucket_of(value)], minlength=before)

    def step(group: pa.Table) -> pa.Table:
        def chosen(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bands = group["bands"].take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return group["node"].to_numpy()[rows], bands.reshape(len(rows), -1)

        empty = pa.table({c: pa.array([], pa.int64()) for c in ("node", "other", "n")})
        band, i, j = (group[c][0].as_py() for c in ("band", "i", "j"))
        part = group["part"].to_numpy()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(left) or not len(right):
            return empty
        (a, p), (b, q) = chosen(left), chosen(right)
        todo = a[:, None] < b if i == j else np.ones((len(a), len(b)), dtype=bool)
        for k in range(band):
            todo &= p[:, k][:, None] != q[:, k]
        rows, cols = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
        if not len(rows):
            return empty
        a, b, todo = a[rows], b[cols], todo[np.ix_(rows, cols)]
        (x, total_x), (y, total_y) = (side(group["text"].take(pa.array(at)).combine_chunks()) for at in (left[rows], right[cols]))
        shared = shared_weight(x, y, weight)
        links = todo & (shared >= (similarity - 1e-9) * np.maximum(total_x[:, None] + total_y - shared, 1e-12))
        of_a, of_b = links.sum(axis=1), links.sum(axis=0)
        nodes, n = np.concatenate([a[of_a > 0], b[of_b > 0]]), np.concatenate([of_a[of_a > 0], of_b[of_b > 0]])
        member, root = [], []
        left_over = of_a > 0
        while left_over.any():
            first = int(np.argmax(left_over))
            seen_a, seen_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
            fresh = np.array([first])
            while len(fresh):
                seen_a[fresh] = True
                seen_b |= links[fresh].any(axis=0)
                fresh = np.flatnonzero(links[:, seen_b].any(axis=1) & ~seen_a)
            left_over &= ~seen_a
            found = np.setdiff1d(np.concatenate([a[seen_a], b[seen_b]]), a[first])
            member.append(found)
            root.append(np.full(len(found), a[first]))
        edges = np.concatenate([np.zeros(0, np.int64), *member]), np.concatenate([np.zeros(0, np.int64), *root])
        none = pa.nulls(len(nodes), pa.int64())
        return pa.table(
            {
                "node": pa.chunked_array([pa.array(nodes), pa.array(edges[0])], pa.int64()),
                "other": pa.chunked_array([none, pa.array(edges[1])], pa.int64()),
                "n": pa.chunked_array([pa.array(n.astype(np.int64)), pa.array(np.zeros(len(edges[0]), np.int64))], pa.int64()),
            }
        )

    return met.groupBy("band", "key", "i", "j").applyInArrow(step, "node long, other long, n long")


def similar(pairs: DataFrame, weight: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose weighted Jaccard similarity is at least ``similarity``."""

    def side(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for block in blocks(texts, LETTER):
            owner, value, times = shingles(block)
            cut = np.searchsorted(owner, np.arange(block.n + 1))
            amount = times * weight[bucket_of(value)]
            out += [(value[i:j], amount[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for (x, p), (y, q) in zip(side(batch["text_a"]), side(batch["text_b"]), strict=True):
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            shared = np.minimum(p[i], q[j]).sum()
            found.append(shared / max(p.sum() + q.sum() - shared, 1e-12))
        found = np.array(found)
        return pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found)], names=["a", "b", "similarity"]).filter(pa.array(found >= similarity - 1e-9))

    return map_arrow(pairs, step, "a long, b long, similarity double")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and label (the smallest node it is linked to, directly or not) of every node of the edges (a, b)."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        jumped = staged(lower.join(up, lower["label"] == up["up"]).select("node", "was", F.least("label", "higher").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def near_duplicates(
    docs: DataFrame,
    similarity: float = 0.8,
    bands: int = 10,
    per_band: int = 3,
    small: int = 16,
    floor: float | None = None,
    part_texts: int = 1024,
    part_bytes: int = 1 << 21,
) -> DataFrame:
    """One row per input row: rid, doc_id, class_id (smallest doc_id of the class), n_links of its text to other texts, kept.

    Stages signatures, candidates, links and labels in jobs of its own.
    """
    rows = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", F.monotonically_increasing_id())
    weight = inverse_shares(rows, floor)
    signed = staged(signatures(rows, weight, bands, per_band), "signatures")
    copies = staged(signed.groupBy("copy_of").agg(F.min("rid").alias("node")), "copies")
    nodes = signed.join(copies.select(F.col("node").alias("rid")), "rid", "left_semi").select("rid", "n_bytes", "bands")
    pairs, met = candidates(nodes, small, part_texts, part_bytes)
    pairs = staged(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    texts = thinned(rows.select("rid", "text"), wanted, "rid")
    left, right = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    links = staged(similar(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), weight, similarity), "links")
    crowd = thinned(rows.select("rid", "text"), met.select(F.col("node").alias("rid")).distinct(), "rid").withColumnRenamed("rid", "node")
    many = staged(compare_parts(met.join(crowd, "node"), weight, similarity), "many")
    counted = links.select(F.col("a").alias("node"), F.lit(1).alias("n")).union(links.select("b", F.lit(1))).union(many.where("other IS NULL").select("node", "n"))
    degree = counted.groupBy("node").agg(F.sum("n").alias("n_links"))
    links = links.select("a", "b").union(many.where("other IS NOT NULL").select("node", "other"))
    known = copies.join(components(links), "node", "left").join(degree, "node", "left")
    placed = staged(
        signed.select("rid", "doc_id", "copy_of")
        .join(known, "copy_of")
        .select("rid", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")),
        "classes",
    )
    per_label = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m"))
    classed = staged(attach_by_key(placed, per_label, ["label"], "m"), "classes")
    first = classed.where("doc_id <=> class_id").groupBy("label").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("kept"))
    return classed.join(first, "rid", "left").select("rid", "doc_id", "class_id", "n_links", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """The input rows, all columns, that stand for their class."""
    kept = near_duplicates(docs, **settings).where("kept").select(F.col("rid").alias("__rid"))
    return docs.withColumn("__rid", F.monotonically_increasing_id()).join(kept, "__rid", "left_semi").drop("__rid")
