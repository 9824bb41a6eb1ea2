"""Token counts from flat token files by a separator scan.

Token files are plain arrays of unsigned integers with an end-of-document id behind every document and no index. A scan cuts each file
into blocks of ``block_tokens``, finds the separators of a block with one vectorised comparison, and stitches documents across blocks
with a prefix scan over block summaries: the separators before a block number its documents, and the last separator before it says
where its first document began. Only summaries (one short row per block) meet per file.

``write_token_files`` makes such files from texts. A null or empty text is a document of no tokens. Files of a repeated or lost task
attempt are never read: each attempt writes its own file and only the files of the committed manifest count. Special strings in a text
are encoded as ordinary text, so no text can hold a separator. Null or repeated doc_ids are counted row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.llm.common import map_arrow, staged, texts_of
from hearthline.llm.tokens import encoder, vocabulary_path
from hearthline.session import scratch_path

SEPARATOR = 50256
MOST_TASKS = 20_000
MANIFEST = "file long, ordinal long, doc_id long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """One flat file per task in a folder that driver and executors share; the manifest (file, ordinal, doc_id). Runs a job."""
    path = vocabulary or vocabulary_path()
    if separator > np.iinfo(np.dtype(dtype)).max:
        raise ValueError(f"separator {separator} does not fit {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special_as_text=True).ids
        end = np.array([separator], dtype=dtype).tobytes()
        top = np.iinfo(np.dtype(dtype)).max
        files, at = pafs.FileSystem.from_uri(folder)
        file = TaskContext.get().taskAttemptId()
        out, ordinal = None, 0
        for batch in batches:
            if out is None:
                files.create_dir(at, recursive=True)
                out = files.open_output_stream(f"{at}/part-{file}.bin")
            for text in batch["text"]:
                ids = encode(text.as_py())
                if len(ids) and int(ids.max()) > top:
                    raise ValueError(f"a token id does not fit {dtype}")
                out.write(ids.astype(dtype).tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, file)), pa.array(np.arange(ordinal, ordinal + n)), batch["doc_id"].cast(pa.int64())],
                names=["file", "ordinal", "doc_id"],
            )
            ordinal += n
        if out is not None:
            out.close()

    return staged(texts_of(docs).mapInArrow(run, MANIFEST), "manifest")


def scan_blocks(paths: DataFrame, separator: int, dtype: str, block_tokens: int) -> DataFrame:
    """For each block of each (path, length): how many separators it has, where (positions in the block), and the last one's place."""
    width = np.dtype(dtype).itemsize
    cut = paths.select(
        "path",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / (width * block_tokens)) - 1, F.lit(0)))).alias("block"),
    )
    # a list this short would be coalesced to one task; a number given here is kept
    total = paths.agg(F.sum(F.floor(F.col("length") / (width * block_tokens)) + 1)).first()[0] or 1
    cut = cut.repartition(int(min(total, MOST_TASKS)))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, length, block in zip(*(batch[c].to_pylist() for c in ("path", "length", "block")), strict=True):
            files, at = pafs.FileSystem.from_uri(path)
            with files.open_input_file(at) as f:
                f.seek(block * block_tokens * width)
                raw = f.read(min(block_tokens * width, length - block * block_tokens * width))
            tokens = np.frombuffer(raw, dtype=dtype)
            found = np.flatnonzero(tokens == separator)
            begin = block * block_tokens
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [path],
                    "block": [block],
                    "tokens": [len(tokens)],
                    "n": [len(found)],
                    "last": [begin + int(found[-1]) if len(found) else None],
                    "at": [found.astype("<i4").tobytes()],
                },
                schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("at", pa.binary())]),
            )

    return map_arrow(cut, step, "path string, block long, tokens long, n long, last long, at binary")


def scan_token_files(spark: SparkSession, folder: str, separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = 1 << 22) -> DataFrame:
    """One row per document of all files in a folder: path, ordinal, start, length, closed (false: the file ends without a separator)."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    scanned = staged(scan_blocks(paths, separator, dtype, block_tokens), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    stitched = scanned.select("path", "block", "n", "last", "tokens").select(
        F.col("path"),
        F.col("block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
        F.when(F.col("block") == F.max("block").over(whole), F.sum("tokens").over(whole)).alias("file_tokens"),
    )

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            ends = np.frombuffer(row["at"], dtype="<i4").astype(np.int64) + row["block"] * block_tokens
            closed = np.ones(len(ends), dtype=bool)
            last = int(ends[-1]) if len(ends) else row["carry"]
            if row["file_tokens"] is not None and row["file_tokens"] > last + 1:
                ends, closed = np.append(ends, row["file_tokens"]), np.append(closed, False)
            if not len(ends):
                continue
            starts = np.concatenate([[row["carry"]], ends[:-1]]) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["path"]] * len(ends)),
                    *map(pa.array, (row["base"] + np.arange(len(ends)), starts, ends - starts, closed)),
                ],
                names=["path", "ordinal", "start", "length", "closed"],
            )

    return map_arrow(
        scanned.select("path", "block", "at").join(stitched, ["path", "block"]), step, "path string, ordinal long, start long, length long, closed boolean"
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None, block_tokens: int = 1 << 22) -> DataFrame:
    """doc_id and n_tokens of every row, counted on flat token files written for it."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    manifest = write_token_files(docs, folder, vocabulary)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    found = scan_token_files(spark, folder, block_tokens=block_tokens).select(
        F.regexp_extract("path", r"part-(\d+)\.bin$", 1).cast("long").alias("file"), "ordinal", "length"
    )
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", F.col("length").alias("n_tokens"))
