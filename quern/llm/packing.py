"""Vector bin packing: examples are placed into sequences under limits on tokens, segments and loss-bearing tokens.

A sequence is filled from a pool of waiting examples: of those that fit, the one whose demand has the largest dot
product with what is left of the sequence (both as shares of the limits) goes in next. Where nothing fits whole,
an example may be cut to close the gap. Every task packs its own rows as a stream; nothing is shuffled.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.token_count import byte_vocabulary, vocabulary_path

TOKENS, SEGMENTS, POOL = 2048, 256, 256
#: The id that ends a document.
END = 1


@dataclass(frozen=True)
class Limits:
    """Most of each in one sequence. loss: tokens that bear loss (those after an example's prompt)."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS


class Packer:
    """Packs a stream of (key, tokens, prompt): the first ``prompt`` tokens bear no loss.

    ``add`` and ``finish`` give pieces (key, start, length, sequence, offset). With ``cut`` off, an example stays
    whole unless it breaks a limit alone. With ``powers``, the stream's last, partly filled sequence is cut into
    sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, limits: Limits = Limits(), cut: bool = True, powers: bool = True, pool: int = POOL) -> None:
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.cut, self.powers, self.pool, self.made = limits, cut, powers, pool, 0
        self.waiting: list[list] = []  # [key, start, end, prompt]

    def add(self, key, tokens: int, prompt: int = 0) -> list[tuple]:
        if tokens > 0:
            self.waiting.append([key, 0, tokens, prompt])
        return self._fill() if len(self.waiting) >= 2 * self.pool else []

    def finish(self) -> list[tuple]:
        return self._fill(0)

    def _loss(self, x: list) -> int:
        return max(0, x[2] - max(x[1], x[3]))

    def _prefix(self, x: list, tokens: int, loss: int) -> int:
        """The longest piece from the start of what is left of x that keeps to both."""
        return min(x[2] - x[1], tokens, max(0, x[3] - x[1]) + loss)

    def _fill(self, leave: int | None = None) -> list[tuple]:
        lim, out, waiting = self.limits, [], self.waiting
        leave = self.pool if leave is None else leave
        cap = np.array([lim.tokens, lim.segments, lim.loss], dtype=np.float64)
        need = np.array([[x[2] - x[1], 1, self._loss(x)] for x in waiting], dtype=np.float64).reshape(-1, 3)
        alive = np.ones(len(waiting), dtype=bool)
        n = len(waiting)
        while n > leave:
            left, bin_ = cap.copy(), []
            while n and left[1] >= 1:
                fits = alive & (need <= left).all(axis=1)
                if fits.any():
                    score = np.where(fits, need @ (left / cap / cap), -1.0)
                    i = int(score.argmax())
                    x = waiting[i]
                    bin_.append((x[0], x[1], x[2] - x[1]))
                    left -= need[i]
                    alive[i] = False
                    n -= 1
                    continue
                if bin_ and not self.cut:
                    break
                i = int(np.where(alive, need[:, 0], -1.0).argmax())  # nothing fits whole: the largest gives a piece
                x = waiting[i]
                size = self._prefix(x, int(left[0]), int(left[2]))
                if size <= 0:
                    break
                bin_.append((x[0], x[1], size))
                left -= (size, 1, max(0, x[1] + size - max(x[1], x[3])))
                x[1] += size
                need[i] = (x[2] - x[1], 1, self._loss(x))
            out += self._close(bin_, lim.tokens - int(left[0]), last=n == 0)
        self.waiting = [x for x, a in zip(waiting, alive) if a]
        return out

    def _close(self, bin_: list[tuple], total: int, last: bool) -> list[tuple]:
        """Pieces of one sequence; the last of a stream may become several."""
        sizes = [total]
        if last and self.powers and self.cut and total < self.limits.tokens:
            sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        out, room, offset = [], sizes[0], 0
        at = 0
        for key, start, size in bin_:
            while size:
                part = min(size, room)
                out.append((key, start, part, self.made, offset))
                start, size, room, offset = start + part, size - part, room - part, offset + part
                if not room:
                    self.made, at, offset = self.made + 1, at + 1, 0
                    room = sizes[at] if at < len(sizes) else 0
        return out


@functools.lru_cache(2)
def encoder(path: str | None):
    """The byte-level BPE of a tokenizer's JSON file: ids are ranks, so merging by rank gives its ids.

    A special token's string in a text gets its id, as in the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken

    path = path or vocabulary_path()
    with open(path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_vocabulary(path), special_tokens=special)


def document_ids(text: str, path: str | None = None) -> np.ndarray:
    """A document's ids and the id that ends it, as little-endian unsigned 32-bit integers."""
    return np.append(encoder(path).encode_to_numpy(text, allowed_special="all"), END).astype("<u4")


PIECE = "example_id long, start long, length long, sequence_id long, offset long"


def pack_examples(df: DataFrame, limits: Limits, cut: bool = False, pool: int = POOL) -> DataFrame:
    """Pieces (PIECE) of examples (example_id, n_tokens, n_prompt): instruction data, whose prompts bear no loss.

    No sequence has more tokens, segments or loss-bearing tokens than ``limits`` says. Examples stay whole but for those
    that break a limit alone (or ``cut``). Null counts are 0; an example without tokens has no piece; repeated rows are
    packed each for itself; other columns are left out; no rows give none. Every task packs its rows as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first, ids, n = Packer(limits, cut=cut, powers=False, pool=pool), TaskContext.get().partitionId() << 33, {}, 0
        left: dict[int, int] = {}

        def rows(pieces):
            out = [(ids[key], start, size, first + sequence, offset) for key, start, size, sequence, offset in pieces]
            for key, _, size, *_ in pieces:
                left[key] -= size
                if not left[key]:
                    del ids[key], left[key]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PIECE.split(", ")])

        for batch in batches:
            for example, tokens, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                if tokens and tokens > 0:
                    ids[n], left[n] = example, tokens
                    if pieces := packer.add(n, tokens, min(prompt or 0, tokens)):
                        yield rows(pieces)
                    n += 1
        if pieces := packer.finish():
            yield rows(pieces)

    return df.select(*(F.col(c).cast("long") for c in ("example_id", "n_tokens", "n_prompt"))).mapInArrow(run, PIECE)


OUT = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def pack_documents(df: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """One row per piece of ``doc_id``, ``text``: where its ids start in the document, and its sequence and offset there.

    All ids of a document bear loss. Documents are cut freely, so that only a task's last sequence is short, and
    that one is cut at powers of two. Null and empty texts are one id long. Repeated rows are packed each for
    itself; null doc_ids stay null; other columns are left out; an empty table gives an empty table; of a very long text
    all ids are held until its last piece is out. sequence_id
    holds the task's partition in its upper bits, so a repeated task gives the same ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids, first = Packer(limits), {}, TaskContext.get().partitionId() << 33
        left: dict[int, int] = {}

        def rows(pieces):
            out = []
            for key, start, size, sequence, offset in pieces:
                doc, own = ids[key]
                out.append((doc, start, size, zlib.crc32(own[start : start + size].tobytes()), len(own), first + sequence, offset))
                left[key] -= size
                if not left[key]:
                    del ids[key], left[key]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), OUT.values())], names=list(OUT))

        n = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = document_ids(text or "", path)
                ids[n], left[n] = (doc, own), len(own)
                if pieces := packer.add(n, len(own)):
                    yield rows(pieces)
                n += 1
        if pieces := packer.finish():
            yield rows(pieces)

    return df.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in OUT))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
