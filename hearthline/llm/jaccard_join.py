"""Jaccard self-join of texts on word n-grams, by a blocked sparse product of the document by n-gram incidence matrix.

A text's set are its distinct ``width``-word shingles (words between ASCII white space, A-Z as a-z; a shorter text is one shingle). Two
texts link when 100 * intersection >= ``percent`` * union; the result names the component of every text.

The columns of the matrix (n-grams) are dealt into blocks by hash. The sizes of two linked sets bound how many columns they can differ in:
at most (100 - percent) * (m + n) / (100 + percent). A row gives one hashed key per block; with more blocks than that bound, linked rows
agree in a whole block, so no linked pair is missed by multiplying only rows that share a key. Sizes are cut into classes so wide that
linked sets lie in one class or in neighbouring ones, and a row gives keys for both pairs of classes. Some blocks are ``spare``: linked
rows agree in more blocks than that, and a row shows its empty blocks only when more of them than are spare are empty.

Pairs of rows pass three bounds, the cheap ones first: their sizes; the distance of their folded rows (columns added up modulo 2 into
two to four bits per column, which can only make rows more alike); the overlap of their n-grams. Rows of one key are multiplied with
the smallest of them first. Later pairs are taken only where the two rows are not yet in one component, so a family of near copies
costs its size, not its square. Where a key still holds rows of several components, its pairs are named (up to ``small`` rows), or its
rows are dealt into parts. A task multiplies the folded rows of two parts by blocks of columns, adds up the distances and drops
each pair whose distance has passed the bound of its sizes; a pair counts only at the first such key that its rows share. Only rows
left in some pair come back, with their texts, and a second product, by blocks of n-grams, adds up overlaps and drops each
pair that the n-grams left cannot lift to its bound. A task returns no more links than join the components it holds.

Equal texts are one row of the matrix. Texts are told apart by 64-bit hashes, n-grams as well. Null texts are empty; empty texts and texts
without words have an empty set and link with nothing. Rows that repeat a doc_id, or have none, are rows like any other; a component is
named by its smallest doc_id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.common import staged, texts_of, thinned
from hearthline.llm.near_dedup import components
from hearthline.llm.ngrams import LOWER
from hearthline.llm.textblocks import Block, U, blocks, mix, window_hash
from hearthline.operators.skew import attach_by_key

WIDTH = 3


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and hash of each distinct shingle, ordered by text and hash."""
    word = block.word_hash(0, LOWER)
    at = block.windows(width)
    owner, value = [block.owner()[at]], [window_hash(word, at, width)]
    counts = block.counts()
    for k in range(1, width):
        few = np.flatnonzero(counts == k)
        owner.append(few)
        value.append(window_hash(word, block.first[few], k))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def size_classes(percent: int, largest: int) -> np.ndarray:
    """Lower bounds of size classes, two beyond the largest size: sets that link lie in one class or in neighbouring ones."""
    bounds = [1]
    while len(bounds) < 3 or bounds[-3] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


def block_counts(bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of neighbouring classes: blocks of columns, and how many of them are spare."""
    differ = 2 * (100 - percent) * (bounds[2:] - 1) // (100 + percent)
    spare = np.where(differ > 0, 1 + differ // 16, 0)
    return differ + 1 + spare, spare


def block_keys(owner: np.ndarray, value: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and key of each block of columns that a text shows."""
    size = np.bincount(owner, minlength=n)
    bounds = size_classes(percent, int(size.max(initial=1)))
    count, spare = block_counts(bounds, percent)
    mixed = mix(value ^ U(0x5851F42D4C957F2D))
    owners, keys = [], []
    for step in (0, 1):
        pair = np.searchsorted(bounds, size, side="right") - 1 - step
        has = (size > 0) & (pair >= 0)
        blocks_of = np.where(has, count[np.maximum(pair, 0)], 0)
        first = np.cumsum(blocks_of) - blocks_of
        rows = has[owner]
        of = owner[rows]
        place = first[of] + (value[rows] % blocks_of[of].astype(U)).astype(np.int64)
        sums = np.zeros(int(blocks_of.sum()), dtype=U)
        order = np.argsort(place, kind="stable")
        at = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]]) if len(order) else order
        if len(order):
            sums[place[order][at]] = np.add.reduceat(mixed[rows][order], at)
        filled = np.zeros(len(sums), dtype=bool)
        filled[place] = True
        who = np.repeat(np.arange(n), blocks_of)
        empty = blocks_of - np.bincount(who[filled], minlength=n)
        shown = filled | (empty > np.where(has, spare[np.maximum(pair, 0)], 0))[who]
        nth = np.arange(len(who)) - first[who]
        label = mix((pair[who].astype(U) << U(32)) + nth.astype(U))
        owners.append(who[shown])
        keys.append(mix(sums + label)[shown])
    return np.concatenate(owners), np.concatenate(keys)


def folded_rows(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's columns added up modulo 2 into a power of two of bits (at least two per column): 64-bit words, and the first of each text."""
    size = np.bincount(owner, minlength=n)
    words = np.array([1 << max(0, (2 * int(s) - 1).bit_length() - 6) for s in size], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(words)])
    place = first[owner] * 64 + (mix(value + U(1)) % (words[owner] * 64).astype(U)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(first[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), first


def signatures(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, node (hash of the text), n_shingles, the folded row, and the keys of the blocks of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                owner, value = shingle_sets(block, width)
                who, key = block_keys(owner, value, block.n, percent)
                order = np.argsort(who, kind="stable")
                cut = np.searchsorted(who[order], np.arange(block.n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(key[order].view(np.int64)))
                words, first = folded_rows(owner, value, block.n)
                folded = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words))
                size = pa.array(np.bincount(owner, minlength=block.n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][block.rows], batch["node"][block.rows], size, folded, lists],
                    names=["doc_id", "node", "n_shingles", "folded", "keys"],
                )
        pa.default_memory_pool().release_unused()

    return rows.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, n_shingles long, folded array<long>, keys array<long>")


def one_row(rows: DataFrame, copies: DataFrame, wanted: DataFrame) -> DataFrame:
    """One of the equal rows of each wanted node, read at the smallest doc_id of its text only, so that no copy is shuffled."""
    chosen = wanted.select("node").distinct().join(copies, "node").select(F.col("node").alias("__node"), F.xxhash64("node", "first_id").alias("__at"))
    found = thinned(rows.withColumn("__place", F.xxhash64("node", "doc_id")), chosen.withColumnRenamed("__at", "__place"), "__place")
    found = found.join(chosen, F.col("node") == F.col("__node")).where("__place = __at")
    return found.dropDuplicates(["node"]).drop("doc_id", "__node", "__at", "__place")


def sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    out = []
    for block in blocks(texts):
        owner, value = shingle_sets(block, width)
        cut = np.searchsorted(owner, np.arange(block.n + 1))
        out += [value[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


def reaches(overlap: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of sets of these sizes is enough: 100 * i >= percent * (left + right - i)."""
    return overlap * (100 + percent) >= percent * (left + right)


def multiply_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int, part: int = 256) -> DataFrame:
    """The linked ones of the pairs (a, b). A row a meets at most about ``part`` rows b in a stretch of a task; only its set is held."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part))
    dealt = attach_by_key(pairs, degree, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    dealt = staged(dealt, "dealt-pairs")
    right = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    left = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    lined = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(0, dtype=U)
        for batch in batches:
            found = []
            for a, b, values in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), sets_of(batch["text"], width), strict=True):
                if b is None:
                    row = values
                elif len(row) and reaches(min(len(row), len(values)), len(row), len(values), percent):
                    at = np.minimum(np.searchsorted(row, values), len(row) - 1)
                    if reaches(np.count_nonzero(row[at] == values), len(row), len(values), percent):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        pa.default_memory_pool().release_unused()

    return lined.mapInArrow(run, "a long, b long")


def near_rows(left: np.ndarray, right: np.ndarray, most: np.ndarray, todo: np.ndarray, columns: int = 256) -> np.ndarray:
    """The pairs marked in ``todo`` that differ in at most ``most`` columns of their bits: products by blocks of columns."""
    distance = np.zeros(todo.shape, dtype=np.int64)
    todo = todo.copy()
    for at in range(0, left.shape[1], columns):
        rows, cols = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
        if not len(rows):
            break
        a, b = left[rows, at : at + columns].astype(np.float32), right[cols, at : at + columns].astype(np.float32)
        distance[np.ix_(rows, cols)] += (a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
        todo &= distance <= most
    return todo


def product(left: list[np.ndarray], right: list[np.ndarray], todo: np.ndarray, percent: int, columns: int = 2048) -> np.ndarray:
    """The linked ones of the pairs marked in ``todo``, from the product of two row blocks over blocks of columns."""
    sizes = [np.array([len(v) for v in side], dtype=np.int64) for side in (left, right)]
    total = sizes[0][:, None] + sizes[1][None, :]
    flat = [np.concatenate([np.zeros(0, U), *side]) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), s) for side, s in zip((left, right), sizes, strict=True)]
    order = [np.argsort(v, kind="stable") for v in flat]
    flat, owner = [v[o] for v, o in zip(flat, order, strict=True)], [w[o] for w, o in zip(owner, order, strict=True)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    # columns that only one side has never overlap
    rest = [s - np.bincount(w[~np.isin(v, both)], minlength=len(s)) for v, w, s in zip(flat, owner, sizes, strict=True)]
    overlap, todo = np.zeros(todo.shape, dtype=np.int64), todo.copy()
    for at in range(0, len(both), columns):
        todo &= reaches(overlap + np.minimum(rest[0][:, None], rest[1][None, :]), sizes[0][:, None], sizes[1][None, :], percent)
        if not todo.any():
            return todo
        names, dense = both[at : at + columns], []
        for v, w, r in zip(flat, owner, rest, strict=True):
            span = slice(np.searchsorted(v, names[0], side="left"), np.searchsorted(v, names[-1], side="right"))
            place = np.minimum(np.searchsorted(names, v[span]), len(names) - 1)
            hit = names[place] == v[span]
            matrix = np.zeros((len(r), len(names)), dtype=np.float32)
            matrix[w[span][hit], place[hit]] = 1
            r -= np.bincount(w[span][hit], minlength=len(r))
            dense.append(matrix)
        rows, cols = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
        overlap[np.ix_(rows, cols)] += (dense[0][rows] @ dense[1][cols].T).astype(np.int64)
    return todo & (overlap * (100 + percent) >= percent * total)


def open_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two parts of a tile, and the pairs of them that sizes and folded rows allow and whose first key this is."""
    part, label, n = (group[c].to_numpy() for c in ("part", "label", "n"))
    words = group["folded"].combine_chunks()
    cut, flat = words.offsets.to_numpy(), words.values.to_numpy()
    least = int(np.diff(cut).min())
    bits = np.zeros((len(n), least * 64), dtype=np.uint8)
    for r in range(len(n)):
        row = np.bitwise_xor.reduce(flat[cut[r] : cut[r + 1]].reshape(-1, least), axis=0)
        bits[r] = np.unpackbits(row.view(np.uint8), bitorder="little")
    left, right = np.flatnonzero(part == group["i"][0].as_py()), np.flatnonzero(part == group["j"][0].as_py())
    x, y = n[left][:, None], n[right][None, :]
    todo = (label[left][:, None] != label[right][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    lower = group["lower"].to_pylist()
    where: dict[int, tuple[list[int], list[int]]] = {}
    for side, rows in enumerate((left, right)):
        for k, row in enumerate(rows):
            for key in lower[row] or ():
                where.setdefault(key, ([], []))[side].append(k)
    for of_left, of_right in where.values():
        if of_left and of_right:
            todo[np.ix_(of_left, of_right)] = False
    return left, right, near_rows(bits[left], bits[right], (100 - percent) * (x + y) // (100 + percent), todo)


def multiply_folded(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows (key, i, j, node) of each tile that are left in some pair; dealt: key, i, j, part, node, label, n, folded, lower."""

    def step(tile: pa.Table) -> pa.Table:
        left, right, todo = open_pairs(tile, percent)
        kept = np.unique(np.concatenate([left[todo.any(axis=1)], right[todo.any(axis=0)]]))
        return tile.select(["key", "i", "j", "node"]).take(pa.array(kept))

    return dealt.groupBy("key", "i", "j").applyInArrow(step, "key long, i int, j int, node long")


def multiply_parts(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components met in a tile, fewer than its rows; dealt as before, and text."""

    def step(tile: pa.Table) -> pa.Table:
        left, right, todo = open_pairs(tile, percent)
        rows, cols = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
        found: list[tuple[int, int]] = []
        if len(rows):
            node, label = tile["node"].to_numpy(), tile["label"].to_numpy()
            sets = [sets_of(tile["text"].take(pa.array(at)).combine_chunks(), width) for at in (left[rows], right[cols])]
            x, y = np.nonzero(product(*sets, todo[np.ix_(rows, cols)], percent))
            a, b = left[rows[x]], right[cols[y]]
            root: dict[int, int] = {}

            def top(name: int) -> int:
                while root.setdefault(name, name) != name:
                    root[name] = name = root[root[name]]
                return name

            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                one, other = top(int(label[p])), top(int(label[q]))
                if one != other:
                    root[one] = other
                    found.append((int(node[p]), int(node[q])))
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate("ab")})

    return dealt.groupBy("key", "i", "j").applyInArrow(step, "a long, b long")


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, percent: int = 90, small: int = 16, part_rows: int = 1024, part_shingles: int = 1 << 20
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id. Stages signatures, keys, links and labels in jobs of its own."""
    rows = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("node", F.xxhash64("text"))
    signed = staged(signatures(rows, width, percent), "signatures")
    copies = staged(signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "copies")
    keys = signed.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("top")).where("center <> top").select("key", "center")
    shared = staged(shared, "shared")
    met = staged(thinned(keys, shared, "key").distinct(), "met")
    weight = met.groupBy("key").agg(F.count("*").alias("n")).join(shared, "key")
    members = staged(attach_by_key(met, weight, ["key"], "n", how="inner"), "members")
    rowed = one_row(signed.select("doc_id", "node", F.col("n_shingles").alias("n"), "folded"), copies, members)
    rowed = staged(rowed, "rows")

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs that the sizes and folded rows allow to link; of two lengths of folded rows the longer is folded once more."""
        a, b = (rowed.select(F.col("node").alias(c), F.struct("n", "folded").alias(f"of_{c}")) for c in "ab")
        fit = "100 * least(of_a.n, of_b.n) >= {0} * greatest(of_a.n, of_b.n)".format(percent)
        both = pairs.join(a, "a").join(b, "b").where(fit).withColumn("m", F.expr("least(size(of_a.folded), size(of_b.folded))"))
        fold = "if(size({0}.folded) = m, {0}.folded, zip_with(slice({0}.folded, 1, m), slice({0}.folded, m + 1, m), (x, y) -> x ^ y))"
        apart = f"aggregate(zip_with({fold.format('of_a')}, {fold.format('of_b')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        return both.where(f"{apart} * {100 + percent} <= {100 - percent} * (of_a.n + of_b.n)").select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        texts = staged(one_row(rows, copies, pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), "row-texts")
        return staged(multiply_pairs(pairs, texts, width, percent), "links")

    links = linked(plausible(members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()))
    # keys whose rows are not yet of one component
    labels = components(links)
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = (
        named.join(rowed.select("node", F.col("n").alias("weight")), "node")
        .groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("weight").alias("total"))
        .where("low <> high")
        .select("key", "n", F.col("n").alias("size"), F.ceil(F.greatest(F.col("n") / part_rows, F.col("total") / part_shingles)).cast("int").alias("parts"))
    )
    open_keys = staged(open_keys, "open-keys")
    opened = staged(attach_by_key(thinned(named.select("key", "node", "center", "label"), open_keys, "key"), open_keys, ["key"], "n", how="inner"), "opened")
    few = (
        opened.where(F.col("size") <= small)
        .groupBy("key", "center")
        .agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("nodes"))
        .select("center", F.posexplode("nodes").alias("i", "a"), "nodes")
        .select("center", "a", F.explode(F.slice("nodes", F.col("i") + 2, small)).alias("b"))
        .where("a.label <> b.label AND a.node <> center AND b.node <> center")
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        .distinct()
    )
    many = staged(opened.where(F.col("size") > small), "many")
    of_node = many.groupBy("node").agg(F.collect_set("key").alias("keys")).join(rowed, "node")
    dealt = (
        many.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(of_node, "node")
        .withColumn("lower", F.expr("filter(keys, k -> k < key)"))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label", "n", "folded", "lower")
    )
    left_over = staged(multiply_folded(dealt, percent), "left-over")
    texts = staged(one_row(rows, copies, left_over), "row-texts")
    again = dealt.join(left_over, ["key", "i", "j", "node"], "left_semi").join(texts, "node")
    crowd = staged(multiply_parts(again, width, percent), "links")
    late = linked(plausible(few))
    labels = components(links.union(late).union(crowd))

    named = copies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m"))
    per_text = attach_by_key(named.select("node", "label", "n"), first, ["label"], "m").select("node", "component_id", "n")
    out = attach_by_key(signed.select("doc_id", "node", "n_shingles"), per_text, ["node"], "n")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(list_slice(w, i, i + 2), ' ') FOR i IN range(1, len(w) - 1)] END)) AS g
      FROM w WHERE len(w) > 0),
t AS (SELECT g, min(doc_id) AS a, len(g) AS n FROM s GROUP BY g),
u AS (SELECT a, n, unnest(g) AS x FROM t),
p AS (SELECT l.a, r.a AS b FROM u l JOIN u r ON l.x = r.x AND l.a < r.a AND 100 * least(l.n, r.n) >= 90 * greatest(l.n, r.n)
      GROUP BY l.a, r.a HAVING 100 * count(*) >= 90 * (min(l.n) + min(r.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c(a, b) AS (SELECT a, a FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a, min(b) AS k FROM c GROUP BY a)
SELECT w.doc_id, CAST(coalesce(len(s.g), 0) AS BIGINT) AS n_shingles, coalesce(m.k, w.doc_id) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN t ON t.g = s.g LEFT JOIN m ON m.a = t.a
"""
