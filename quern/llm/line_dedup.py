"""Substring dedup by hashing lines.

A unit is a line, or a sentence or clause of a longer line, or what follows a word chosen by its own hash (so that a
passage pasted into the middle of a line is still cut at its own seams), together with the units after it until it has
enough words. A whole line is a unit of its own as well, from three words on. Units are normalised, digests of 72
bits grouped over all documents, and every occurrence but the earliest ranked one is removed, its place in the
original text retained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quern.llm.common import partitions, size_of, sliced, table

#: A run of words that doesn't go on past a line's end, a sentence's end, or a capital letter. After 。！？ it ends
#: without white space too.
_PART = r"(?:[^\s。！？]++[。！？]*+|[。！？]++)"
_UNIT = re.compile(rf"{_PART}(?:(?<![.!?…。！？])[^\S\n\r]++(?![A-ZÀ-ÖØ-ÞΑ-ΩА-Я]){_PART})*+")
#: Letters of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han), and what parts words without white space.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_STOP = re.compile(r"[。！？]")


#: The code points that part words, as ``str.split`` has it, and which of the first 256 are among them.
_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], dtype=np.uint32)
_LOW = np.array([chr(i).isspace() for i in range(256)] + [False])
_WORD = re.compile(r"\S++")
_LINE = re.compile(r"\S(?:[^\n\r]*\S)?")


@dataclass(frozen=True)
class Units:
    """A unit has at least ``words`` words, or ``chars`` characters of normalised text (for scripts without spaces).

    The words whose own hash is a multiple of ``every`` are seams too, so that seams depend on nothing around them;
    inside a word of a script without spaces, runs of ``gram`` characters whose hash is a multiple of twice that.
    A whole line needs only ``line_words`` words or ``line_chars`` characters: a brace, a lone word or a number on a line
    of its own says nothing of where it comes from.
    """

    words: int = 8
    chars: int = 80
    every: int = 4
    gram: int = 4
    line_words: int = 3
    line_chars: int = 16


Piece = tuple[int, int, int, int]


def _inner(word: str, how: Units) -> list[int]:
    """Where seams are in a word of a script without spaces. A run that only repeats one character has none."""
    grams = [word[i : i + how.gram].lower() for i in range(len(word) - how.gram + 1)]
    return [i for i, g in enumerate(grams) if i and g != grams[i - 1] and xxhash.xxh3_64_intdigest(g) % (2 * how.every) == 0]


def _dense_pieces(text: str, how: Units) -> tuple[list[Piece], list[Piece]]:
    """As ``_pieces``, of a text whose pieces can meet without white space. What goes on a word is none of its own."""

    def piece(a: int, b: int) -> Piece:
        words = text[a:b].lower().split()
        return a, a + len(text[a:b].rstrip()), len(words) - (a > 0 and not text[a - 1].isspace()), sum(map(len, words)) + len(words) - 1

    whole, parts = [], []
    for m in _UNIT.finditer(text):
        cuts = {m.start()}
        for w in _WORD.finditer(text, m.start(), m.end()):
            if _DENSE.search(w[0]):
                cuts.update(w.start() + i for i in _inner(w[0], how))
            elif xxhash.xxh3_64_intdigest(w[0].lower()) % how.every == 0:
                cuts.add(w.start())
        edges = [*sorted(cuts), m.end()]
        parts += [piece(a, b) for a, b in zip(edges, edges[1:])]
        whole.append(piece(*m.span()))
    return whole, parts


def _windows(found: list[Piece], how: Units) -> Iterator[tuple[int, int]]:
    """From each piece on, until there is enough."""
    n, last, words, chars = len(found), -1, 0, 0  # found[i..last] is the window
    for i, piece in enumerate(found):
        if last < i:
            last, words, chars = i, piece[2], piece[3]
        while words < how.words and chars < how.chars and last + 1 < n:
            last += 1
            words, chars = words + found[last][2], chars + found[last][3]
        if words < how.words and chars < how.chars:
            return
        yield piece[0], found[last][1]
        words, chars = words - piece[2], chars - piece[3]


def _runs(seams: np.ndarray, ends: np.ndarray, how: Units) -> tuple[np.ndarray, np.ndarray]:
    """From each seam on, as word numbers [i, j), until there is enough.

    seams: numbers of words, and the number of all; ends: where words end in the normalised text.
    """
    k = np.arange(len(seams) - 1)
    begin = np.where(seams[:-1] > 0, ends[seams[:-1] - 1] + 1, 0)
    by_words = np.searchsorted(seams, seams[:-1] + how.words)
    # of pieces with a single space between them, each counts as if it stood alone
    by_chars = np.searchsorted(ends[seams[1:] - 1] - np.arange(1, len(seams)), begin - k - 1 + how.chars) + 1
    to = np.maximum(np.minimum(by_words, by_chars), k + 1)
    enough = to < len(seams)
    return seams[:-1][enough], seams[to[enough]]


def units(text: str, how: Units = Units()) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of each unit, a span once: one begins at every line, sentence, clause and hash seam.

    Those of lines, sentences and clauses end at such a seam too, whatever hash seams are between; those of hash seams
    end at the next seam of any kind. A whole line is a unit by itself besides, if it has what ``Units`` asks of lines.
    Normalised: lower case, white space as single spaces. What is left at a text's end that is too short, and no whole
    line, is no unit; nor is a text's only line if it is too short.
    """
    lines = [m.span() for m in _LINE.finditer(text)]
    seen: set[tuple[int, int]] = set()
    if _DENSE.search(text) or _STOP.search(text):
        whole, parts = _dense_pieces(text, how)
        for spans in (_windows(whole, how), _windows(parts, how), lines):
            for a, b in spans:
                unit = " ".join(text[a:b].lower().split())
                if (a, b) not in seen and (spans is not lines or (len(lines) > 1 or seen) and _is_line(unit, how)):
                    seen.add((a, b))
                    yield a, b, unit
        return
    if not lines:
        return
    first, last = _words(text)
    low = text.lower().split() if text.isascii() else [x.lower() for x in text.split()]
    normal = " ".join(low)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1) - 1
    n, digest, every = len(low), xxhash.xxh3_64_intdigest, how.every
    whole = np.searchsorted(first, [m.start() for m in _UNIT.finditer(text)])
    seam = np.fromiter(map(digest, low), np.uint64, n) % np.uint64(every) == 0
    seam[whole] = True
    of_whole, of_parts = (i * (n + 1) + j for i, j in (_runs(np.append(x, n), ends, how) for x in (whole, np.flatnonzero(seam))))
    found = np.concatenate([of_whole, of_parts[~_held(of_parts, of_whole)]])
    if len(lines) > 1 or len(found):
        i, j = np.searchsorted(first, [a for a, _ in lines]), np.searchsorted(last, [b for _, b in lines]) + 1
        size = ends[j - 1] - np.where(i > 0, ends[i - 1] + 1, 0)
        of_lines = (i * (n + 1) + j)[(j - i >= how.line_words) | (size >= how.line_chars)]
        found = np.concatenate([found, of_lines[~_held(of_lines, of_whole) & ~_held(of_lines, of_parts)]])
    i, j = np.divmod(found, n + 1)
    begin = np.where(i > 0, ends[i - 1] + 1, 0)
    for a, b, x, y in zip(first[i].tolist(), last[j - 1].tolist(), begin.tolist(), ends[j - 1].tolist()):
        yield a, b, normal[x:y]


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b, which rises."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), dtype=bool)


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _LOW[np.minimum(code, 256)]
    if not text.isascii():
        far = code >= 256
        space[far] = np.isin(code[far], _SPACES)
    inside = np.r_[False, ~space, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _is_line(unit: str, how: Units) -> bool:
    return len(unit) >= how.line_chars or unit.count(" ") + 1 >= how.line_words


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans. White space on both sides of a cut becomes one: a line break if either has one."""
    if not spans:
        return text
    out: list[str] = []  # what stays, and between two of it what parts them
    at = 0
    gap = ""
    for a, b in [*spans, (len(text), len(text))]:
        part = text[at:a]
        bare = part.strip()
        if not bare:
            gap += part
        else:
            lead, trail = part[: len(part) - len(part.lstrip())], part[len(part.rstrip()) :]
            if at == 0:
                out.append(lead + bare)
            else:
                if out:
                    out.append("\n" if "\n" in gap + lead else " ")
                out.append(bare)
            gap = trail
        at = b
    return "".join(out) + (gap if bare else "")


#: Units that are held at a time, and of how many digests and places are objects of their own.
ROWS, LOOSE = 1 << 18, 1 << 12
UNIT = "high long, low int, doc_id long, text_hash long, span long"


def _late(high: np.ndarray, low: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of some units have an earlier one of their digest among them. Rows alike in all have one fate."""
    order = np.lexsort((start, rank, low, high))
    h, l, r, s = (x[order] for x in (high, low, rank, start))
    new = np.r_[True, (h[1:] != h[:-1]) | (l[1:] != l[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), dtype=bool)
    out[order] = (r != r[head]) | (s != s[head])
    return out


def _occurrences(docs: DataFrame, how: Units) -> DataFrame:
    """(high, low, doc_id, text_hash, span): units of each text, the repeats among ROWS at a time already told.

    A span is one long, to be shuffled small: start * 2^32 + length; of a late unit its complement, below 0.

    A repeat inside such a run is late whatever others hold, so only its earliest occurrence of a digest need meet the
    others: a line that a third of all documents share comes once a run.
    """

    def told(packed: list[tuple], ranks: list[tuple]) -> pa.RecordBatch:
        digests, owners, spans = zip(*packed)
        digest = np.frombuffer(b"".join(digests), dtype=[("high", "<i8"), ("low", "u1"), ("rest", "V7")])  # 72 bits are shuffled
        high, low = digest["high"].copy(), digest["low"].astype(np.int32)
        owner, span = np.concatenate(owners), np.concatenate(spans)
        place = {r: i for i, r in enumerate(sorted(set(ranks)))}
        late = _late(high, low, np.array([place[r] for r in ranks])[owner], span >> 32)
        ids, marks = pa.array([None if r[0] else r[1] for r in ranks], pa.int64()), pa.array([r[2] for r in ranks], pa.int64())
        owner = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), ids.take(owner), marks.take(owner), pa.array(np.where(late, ~span, span))], names=["high", "low", "doc_id", "text_hash", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, ranks, n = [], [], 0
        digests, owners, spans = [], [], []

        def pack() -> None:
            nonlocal digests, owners, spans
            packed.append((b"".join(digests), np.array(owners), np.array(spans, dtype=np.int64)))
            digests, owners, spans = [], [], []

        for batch in sliced(batches):
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                ranks.append((doc is None, doc or 0, mark))
                for start, end, unit in units(text, how):
                    digests.append(xxhash.xxh3_128_digest(unit))
                    owners.append(len(ranks) - 1)
                    spans.append(start << 32 | end - start)
                    n += 1
                    if len(spans) >= LOOSE or n >= ROWS:
                        pack()
                    if n >= ROWS:
                        yield told(packed, ranks)
                        packed, ranks, n = [], [ranks[-1]], 0
                        # the text goes on as the first of the next run
        if spans:
            pack()
        if packed:
            yield told(packed, ranks)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, UNIT)


def repeats(docs: DataFrame, how: Units = Units(), size: int = 0) -> DataFrame:
    """(doc_id, text_hash, span): every unit but the first of its digest, by doc_id (null last), then place.

    Of (doc_id, text_hash, text). What a run has found late goes wherever there is room: no task gets all of a digest.
    """
    spark = docs.sparkSession
    late = F.col("span") < 0
    key = F.when(late, F.xxhash64("doc_id", "span")).otherwise(F.col("high"))
    dealt = _occurrences(docs, how).repartition(partitions(spark, 3 * size), key).sortWithinPartitions("high", "low", late, F.asc_nulls_last("doc_id"), "text_hash", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            digest = np.stack([batch.column("high").to_numpy(), batch.column("low").to_numpy().astype(np.int64)], axis=1)
            span = batch.column("span").to_numpy()
            late = span < 0
            rank = np.stack([batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("doc_id").fill_null(0).to_numpy(), batch.column("text_hash").to_numpy(), span], axis=1)
            new = np.r_[before is None or (digest[0] != before).any(), (digest[1:] != digest[:-1]).any(axis=1)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(digest)), -1))
            heads = np.where((first >= 0)[:, None], rank[np.maximum(first, 0)], head if head is not None else rank[:1])
            keep = late | (rank != heads).any(axis=1)  # rows alike in all keep one fate
            before, head = digest[-1], heads[-1]
            if keep.any():
                yield batch.select(["doc_id", "text_hash"]).append_column("span", pa.array(np.where(late, ~span, span))).filter(pa.array(keep))

    return dealt.mapInArrow(run, "doc_id long, text_hash long, span long")


def dedup(docs: DataFrame, how: Units = Units()) -> DataFrame:
    """``docs`` with its texts cut, and ``removed``, the original (start, end) of what went, in code points.

    Null and empty texts stay as they are. Rows that share doc_id and text are one document: they have the same
    result. Columns named ``removed`` are replaced; others stay. An empty table gives an empty table. A very long text
    is held whole, its units a bounded number at a time. Texts are shuffled once, by document; digests once.
    """
    docs = docs.drop("removed")
    columns, at = docs.columns, docs.columns.index("text")
    size = size_of(docs)
    # where ids tell documents apart, no hash of the text need be shuffled with each unit
    known = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1 or doc_id is null").isEmpty()
    mark = lambda text: F.lit(0).cast("long") if known else F.xxhash64(F.coalesce(text, F.lit("")))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text")).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    # grouped by what the join compares, so that the groups aren't shuffled again
    ids = lambda c: (F.coalesce(c, F.lit(0).cast("long")), c.isNull())
    spans = repeats(plain, how, size).select(*[c.alias(n) for c, n in zip(ids(F.col("doc_id")), ("_id", "_none"))], "text_hash", "span").groupBy("_id", "_none", "text_hash").agg(F.collect_set("span").alias("_spans"))
    own = docs.toDF(*[f"_{i}" for i in range(len(columns))]).withColumn("_mark", mark(F.col(f"_{at}")))
    doc, none = ids(own[f"_{columns.index('doc_id')}"].cast("long"))
    joined = own.join(spans, (doc == spans["_id"]) & (none == spans["_none"]) & (own["_mark"] == spans["text_hash"]), "left").select(*[f"_{i}" for i in range(len(columns))], "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans_ = [merged([(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in s]) if s else [] for s in batch.column(len(columns)).to_pylist()]
            texts = batch.column(at).to_pylist()
            new = [t if t is None or not s else cut(t, s) for t, s in zip(texts, spans_)]
            arrays = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            removed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans_], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*arrays, removed], names=[*columns, "removed"])

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    return joined.mapInArrow(run, StructType([*docs.schema, StructField("removed", ArrayType(span))]))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
