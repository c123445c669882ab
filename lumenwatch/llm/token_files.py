"""Token-id files: flat unsigned integers plus 64-bit document offsets, read by memory mapping.

Documents are ranged by ``doc_id``; each task streams its range into three flat files: ``.bin`` holds ids (16-bit when
the vocabulary allows, else 32-bit, little-endian), ``.idx`` holds for each document the 64-bit number of ids before it
in the part, and a closing total, ``.doc`` holds the 64-bit document ids. A prefix sum over the parts' totals, one row
for each part, gives each part's place in the whole, so no part waits for another.

Files are written under a name of the task's attempt and renamed when complete: a task that is run again after a lost
executor replaces its part by equal content. Folders are reached through ``pyarrow.fs``.

Defined cases: null text is empty and has only the end id; a null ``doc_id`` sorts first and is read back as null;
documents that repeat an id stand in the order of their texts; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.llm.tokens import encoder
from lumenwatch.session import scratch_path, settle

END_ID = 0
NO_ID = -(2**63)
VOCABULARY_SIZE = 50_257
#: Ids that a reading task takes into memory at once when files cannot be mapped.
PART_ROWS = 2_000


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, inner


def _flat(path: str, dtype: str, low: int, high: int) -> np.ndarray:
    """The numbers from ``low`` to ``high`` of a flat file: of a memory map where the folder is local, else a range read."""
    where, inner = _open(path)
    at, size = low * np.dtype(dtype).itemsize, (high - low) * np.dtype(dtype).itemsize
    with pa.memory_map(inner) if where.type_name == "local" else where.open_input_file(inner) as f:
        return np.frombuffer(f.read_at(size, at), dtype)


def write_token_files(
    docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID,
    vocabulary: str | None = None, vocabulary_size: int = VOCABULARY_SIZE,
) -> DataFrame:
    """Write the documents' ids in ascending order of doc_id; one row for each part: part, path, first, n_docs, n_tokens, before."""
    dtype = "<u2" if vocabulary_size <= 2**16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary).encode, np.asarray([end_id], dtype).tobytes()
        where, inner = _open(folder)
        where.create_dir(inner, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = {kind: f"{inner}/part-{part:06d}.{kind}" for kind in ("bin", "idx", "doc")}
        first, n_docs, n_tokens = None, 0, 0
        files = {kind: where.open_output_stream(f"{name}.{attempt}") for kind, name in names.items()}
        try:
            for batch in batches:
                ids, texts = (batch.column(c) for c in (0, 1))
                lengths = []
                for raw in encode(texts.to_pylist()):
                    files["bin"].write(np.frombuffer(raw, "<u4").astype(dtype).tobytes() + end)
                    lengths.append(len(raw) // 4 + 1)
                ends = n_tokens + np.cumsum(lengths, dtype="<u8")
                files["idx"].write(np.concatenate([np.asarray([n_tokens], "<u8"), ends[:-1]]).tobytes() if len(lengths) else b"")
                named = np.asarray(ids.fill_null(NO_ID), "<i8")
                files["doc"].write(named.tobytes())
                n_docs, n_tokens = n_docs + len(lengths), int(ends[-1]) if len(lengths) else n_tokens
                first = int(named[0]) if first is None and len(named) else first
            files["idx"].write(np.asarray([n_tokens], "<u8").tobytes())
        finally:
            for f in files.values():
                f.close()
        for kind, name in names.items():
            where.move(f"{name}.{attempt}", name)
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [f"{folder}/part-{part:06d}"], "first": [first], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )

    ranged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Texts break ties, so that a range of equal ids can be cut and is always dealt alike.
    ranged = ranged.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    parts = settle(ranged.mapInArrow(write, "part long, path string, first long, n_docs long, n_tokens long"), "token-parts")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("before", F.coalesce(before, F.lit(0)))


def read_token_files(parts: DataFrame, vocabulary_size: int = VOCABULARY_SIZE, rows: int = PART_ROWS) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32."""
    dtype = "<u2" if vocabulary_size <= 2**16 else "<u4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = _flat(f"{path}.idx", "<u8", low, high + 1).astype(np.int64)
                ids, named = _flat(f"{path}.bin", dtype, int(at[0]), int(at[-1])), _flat(f"{path}.doc", "<i8", low, high)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                doc = pa.array(named, mask=named == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    steps = F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(rows).cast("long")))
    pieces = parts.select("path", "before", "n_docs", steps.alias("low")).select(
        "path", "before", "low", F.least(F.col("low") + rows, F.col("n_docs")).alias("high")
    )
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "path", "low").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files")))


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}
