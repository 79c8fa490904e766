"""One-permutation MinHash: each shingle is hashed once and falls into one bin; a bin keeps its least hash.

A bin without a shingle takes over the value of the first filled bin in a random order of its own (optimal
densification): its order does not depend on the document, so two documents' bins agree with the probability of
their Jaccard similarity, empty or not. Of each bin only ``bits`` low-order bits are stored; two different values
agree in them by chance with probability 2^-bits, which ``likeness`` takes out again.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import partitions, shingle_hashes, table

SHINGLE, BINS = 5, 512
#: A stored bin: four bits, two bins a byte.
BITS = 4


@functools.cache
def _orders(bins: int) -> np.ndarray:
    """For each bin a random rank of all bins: where an empty bin looks first, second and so on."""
    return np.random.default_rng(20170101).permuted(np.tile(np.arange(bins, dtype=np.uint16), (bins, 1)), axis=1)


def fingerprint(data: bytes, shingle: int = SHINGLE, bins: int = BINS) -> bytes:
    """``bins * 4`` bits. A text without words counts as having one empty shingle, so empty texts are alike."""
    hashes = shingle_hashes(data, shingle)
    if not len(hashes):
        hashes = np.zeros(1, dtype=np.uint64)
    hashes = np.sort(hashes)
    at = (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # sorted, so a bin's first hash is its least
    filled = at[first]
    values = np.zeros(bins, dtype=np.uint8)
    values[filled] = (hashes[first] & np.uint64(15)).astype(np.uint8)
    if len(filled) < bins:
        empty = np.ones(bins, dtype=bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        if len(filled) == 1:
            values[empty] = values[filled[0]]
        else:
            values[empty] = values[filled[_orders(bins)[np.ix_(empty, filled)].argmin(axis=1)]]
    return (values[::2] << 4 | values[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1, free of chance agreements."""
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    agree = (np.count_nonzero(x & 0xF0 == 0) + np.count_nonzero(x & 0x0F == 0)) / (2 * len(x))
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def minhash(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the binary fingerprint of a text column. Null counts as empty. A column named ``out`` is replaced."""
    made = F.pandas_udf(lambda s: s.map(lambda x: fingerprint((x or "").encode())), "binary")
    return df.withColumn(out, made(F.col(text)))


#: Most cells by quantile; beyond, each is cut into equal ranges of ids.
_CELLS = 255


def _ranges(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``docs`` with ``_part``, falling with doc_id (null: in the last part), in about ``n`` parts of like size.

    Bounds are quantiles: at most _CELLS numbers come to the driver.
    """
    cells = min(n, _CELLS)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    sub = -(-n // (len(bounds) + 1))
    cell = F.size(F.filter(F.lit(bounds), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    if sub > 1:
        edges = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        all_edges = [(edges[1] or 0) + 1, *[b for b in bounds], edges[0] or 0]
        top, low = F.element_at(F.lit(all_edges), cell + 1), F.element_at(F.lit(all_edges), cell + 2)
        inside = F.least(F.lit(sub - 1), F.greatest(F.lit(0), F.floor((top - F.col("doc_id")) * sub / (top - low + 1))))
        cell = cell * sub + inside.cast("int")
    last = (len(bounds) + 1) * sub
    return docs.withColumn("_part", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(cell).cast("int")), last + 1


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (_part, doc_id, text, _guest): each part's rows plus, as a guest, the first row of the part that follows it.

    The last part's guest is the first row of all. Ties of doc_id are in order of their texts.
    """
    ranged, n = _ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), partitions(docs.sparkSession))
    heads = ranged.groupBy("_part").agg(F.max("doc_id").alias("_head")).orderBy("_part").collect()  # at most n rows
    if not heads:
        return ranged.withColumn("_guest", F.lit(False)), n
    sent = [(part, head, heads[i - 1][0]) for i, (part, head) in enumerate(heads)]
    to = F.broadcast(docs.sparkSession.createDataFrame(sent, "_from int, _head long, _to int"))
    guests = (
        ranged.join(to, (ranged["_part"] == to["_from"]) & ranged["doc_id"].eqNullSafe(to["_head"]))
        .groupBy("_to", "doc_id")
        .agg(F.min("text").alias("text"))
        .select(F.col("_to").alias("_part"), "doc_id", "text", F.lit(True).alias("_guest"))
    )
    return ranged.select("_part", "doc_id", "text", F.lit(False).alias("_guest")).unionByName(guests), n


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the start of the next document.

    The next document is the one with the next smaller doc_id; the first one's follows the last. Needs ``doc_id``
    and ``text``; other columns are left out. Null text is empty; null ids come after all others; among rows of one
    id the order is that of their texts; a lone document is its own next. An empty table gives an empty table.
    One shuffle: of the texts, by ranges of doc_id, each partition of which is read as a stream.
    """
    rows, n = with_next(docs)
    dealt = rows.repartitionById(n, F.col("_part")).sortWithinPartitions("_part", "_guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for part, doc, text, guest in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "text", "_guest"))):
                now = (part, doc, text, fingerprint(text.encode()), guest)
                if held is not None and held[0] == part:
                    half = len(held[2]) // 2
                    edited = (held[2][: len(held[2]) - half] + text[:half]).encode()
                    other = fingerprint(edited)
                    out.append((held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), held[3].hex(), other.hex(), likeness(held[3], other), likeness(held[3], now[3])))
                held = None if guest else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[c.split()[0] for c in OUT.split(", ")])

    return dealt.mapInArrow(run, OUT)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
