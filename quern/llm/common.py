"""What the training-data operators share: reading tables, cutting lineage, words and shingle hashes."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are cut into words at a time, so that a very long text needs no more memory than a short one.
STEP = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    context = spark.sparkContext
    if context.master.startswith("local"):  # workers on this machine can import the package from where it is
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session of one machine can do without
    the setting (tests); it gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its files outlive any executor, and lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes that one task of a shuffle should get.
TASK = 64 << 20


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Tasks of a shuffle of ``size`` bytes: no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))


def size_of(df: DataFrame) -> int:
    """Bytes of the files that a table is read from, as the optimizer knows them; 0 where it knows nothing."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


#: Keys of more rows than this are joined apart, and rows that may be sent to every executor: of whole lookups, and else.
HOT, SMALL, FEW = 1000, 200_000, 1_000_000


def lookup(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` (``total`` rows) with what ``right`` has for its key; ``right`` is one row a key, with ``n``, its rows in left.

    No task gets all rows of a key: the keys of many rows, of which there are at most 10,000, or all keys where left has
    few rows, are sent to where left's rows are.
    """
    if total <= SMALL:
        return left.join(F.broadcast(right), key)
    floor = max(HOT, total // 10_000)
    hot = F.broadcast(right.filter(F.col("n") > floor))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.filter(F.col("n") <= floor), key))


def among(docs: DataFrame, which: DataFrame, kind: str) -> DataFrame:
    """A join of whole documents with written rows (doc_id, mark, …), mark being the hash of a document's text.

    kind: left_anti, left_semi or inner, which adds the other columns. Few rows are sent to the documents; beyond FEW,
    both are shuffled.
    """
    few = which.count() <= FEW
    names = {"doc_id": "__doc_id", "mark": "__mark"}  # of their own, also where both sides come from one table
    which = which.select(*[F.col(c).alias(names.get(c, c)) for c in which.columns])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__mark"))
    return docs.join(F.broadcast(which) if few else which, on, kind)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of one takes little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(data: bytes, step: int = STEP) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, some at a time, A-Z in lower case."""
    at, end = 0, len(data)
    while at < end:
        cut = min(end, at + step)
        if cut < end:
            space = _SPACE.search(data, cut)
            cut = space.start() if space else end
        yield data[at:cut].lower().split()
        at = cut


def shingle_hashes(data: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``k``-word shingle, repeats included, in text order.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    hashed, parts, rest = xxhash.xxh64_intdigest, [], []
    for words in words_of(data):
        words = rest + words
        if len(words) >= k:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends]
            parts.append(np.array([hashed(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])], dtype=np.uint64))
            rest = words[len(words) - k + 1 :]
        else:
            rest = words
    if parts:
        return parts[0] if len(parts) == 1 else np.concatenate(parts)
    return np.array([hashed(b" ".join(rest), seed)] if rest else [], dtype=np.uint64)
