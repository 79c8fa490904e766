"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node's failure link leads to where matching goes on once the longest piece
(or pieces) at the front of what the node stands for is taken off, and the node stores how many pieces that pops.
Each byte of a word is read once; the count of greedy longest-match pieces comes out without building any piece.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import binary, table, words_of

#: Words whose count a worker remembers; beyond, it starts anew.
REMEMBERED = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1 as it is, the other bytes from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces of a byte-level BPE file (JSON) by id, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special, alphabet = {x["content"] for x in data.get("added_tokens", [])}, byte_alphabet()
    return {bytes(alphabet[c] for c in piece): i for piece, i in data["model"]["vocab"].items() if piece not in special}


class Automaton:
    """Greedy longest-match piece counts over a vocabulary that holds every single byte (so no word is unknown)."""

    def __init__(self, pieces) -> None:
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                nxt = self.child[at].get(byte)
                if nxt is None:
                    nxt = self.child[at][byte] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                at = nxt
            ends[at] = True
        if any(b not in self.child[0] or not ends[self.child[0][b]] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        #: where to go on after popping, and how many pieces that pops
        self.fail, self.pops = [0] * len(self.child), [0] * len(self.child)
        level = list(self.child[0].values())
        for node in level:
            self.pops[node] = 1
        while level:
            below = []
            for node in level:
                for byte, nxt in self.child[node].items():
                    below.append(nxt)
                    if ends[nxt]:
                        self.fail[nxt], self.pops[nxt] = 0, 1
                    else:
                        at, popped = self.fail[node], self.pops[node]
                        while byte not in self.child[at]:
                            popped += self.pops[at]
                            at = self.fail[at]
                        self.fail[nxt], self.pops[nxt] = self.child[at][byte], popped
            level = below

    def count(self, word: bytes) -> int:
        at, total, child, fail, pops = 0, 0, self.child, self.fail, self.pops
        for byte in word:
            nxt = child[at].get(byte)
            while nxt is None:
                total += pops[at]
                at = fail[at]
                nxt = child[at].get(byte)
            at = nxt
        while at:
            total += pops[at]
            at = fail[at]
        return total


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def _automaton(path: str | None) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(byte_vocabulary(path or vocabulary_path())), {}


def count_text(data: bytes, automaton: Automaton, known: dict[bytes, int]) -> tuple[int, int]:
    """Words of a text and greedy pieces of all its words, each with the space before it that word-initial pieces have."""
    words = tokens = 0
    for some in words_of(data):
        words += len(some)
        for word in some:
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = automaton.count(b" " + word)
                if len(word) <= 64:
                    known[word] = n
            tokens += n
    return words, tokens


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_words, n_tokens) of each row: greedy longest-match lengths of its whitespace words, A-Z in lower case.

    ``path`` is a byte-level vocabulary file that every executor has (the public 50k one if not given). Null and
    empty texts count 0; rows are independent, so ties, repeated rows and other columns play no part; an empty
    table gives an empty table. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        for batch in batches:
            counts = [count_text(x, automaton, known) for x in binary(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([a for a, _ in counts], pa.int64()), pa.array([b for _, b in counts], pa.int64())], names=[key, "n_words", "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
