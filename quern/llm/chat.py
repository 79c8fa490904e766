"""Chat formatting by grammar round trip.

Rendered text is read back by a deterministic parser. Where the turn that comes back is not the turn that went in,
the conflicting content is escaped and the turn rendered again, until both are identical.

Grammar (one turn; control strings in quotes)::

    turn      := '[INST]' text '[/INST]' | '<<SYS>>' text '<</SYS>>' | '<<ROLE>>' text '<</ROLE>>' text '</s>' | text '</s>'
    text      := (character | '\\' character)*

The four forms are a user's, a system's, another role's and an assistant's turn. A backslash makes the next
character plain. A conversation is its turns one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import partitions, size_of, table

#: The template's control strings.
CONTROLS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "</s>")
_TOKEN = re.compile(r"\\(?s:.)|" + "|".join(map(re.escape, CONTROLS)))
_CONFLICT = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))


class GrammarError(ValueError):
    """Rendered text that the grammar does not accept."""


class _Unfinished(GrammarError):
    """Text that ends before a turn does."""


def escaped(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\((?s:.))", r"\1", text)


def _until(s: str, at: int, control: str) -> tuple[int, int]:
    """Where a text from ``at`` ends and what follows its closing control string starts."""
    for m in _TOKEN.finditer(s, at):
        if m[0][0] != "\\":
            if m[0] != control:
                raise GrammarError(f"{m[0]} at {m.start()} where {control} was due")
            return m.start(), m.end()
    raise _Unfinished(f"no {control} after {at}")


def _turn(s: str, at: int) -> tuple[str, str, tuple[int, int], bool, int]:
    """The turn that starts at ``at``: role, text, where the (escaped) text is, whether it bears loss, where it ends."""
    role, close, begin = "assistant", "</s>", at
    for opening, closing, name in (("[INST]", "[/INST]", "user"), ("<<SYS>>", "<</SYS>>", "system"), ("<<ROLE>>", "<</ROLE>>", "")):
        if s.startswith(opening, at):
            role, close, begin = name, closing, at + len(opening)
    end, at = _until(s, begin, close)
    loss = role == "assistant"
    if not role:
        role, begin = unescaped(s[begin:end]), at
        end, at = _until(s, begin, "</s>")
    return role, unescaped(s[begin:end]), (begin, end), loss, at


def parse(s: str) -> list[tuple[str, str, int, int, bool]]:
    """The turns of rendered text: role, text, where the (escaped) text starts and ends, and whether it bears loss."""
    turns, at = [], 0
    while at < len(s):
        role, text, span, loss, at = _turn(s, at)
        turns.append((role, text, *span, loss))
    return turns


class Reader:
    """Reads a conversation's rendered text as one stream, cut anywhere: what is not yet a whole turn waits."""

    _OPENINGS = ("[INST]", "<<SYS>>", "<<ROLE>>")

    def __init__(self) -> None:
        self.tail = ""

    def feed(self, s: str) -> list[tuple[str, str, bool]]:
        """The turns that are complete with it: role, text, whether the text bears loss."""
        s, turns, at = self.tail + s, [], 0
        while at < len(s) and not any(len(s) - at < len(o) and o.startswith(s[at:]) for o in self._OPENINGS):
            try:
                role, text, _, loss, at = _turn(s, at)
            except _Unfinished:
                break
            turns.append((role, text, loss))
        self.tail = s[at:]
        return turns

    def close(self) -> None:
        if self.tail:
            raise GrammarError(f"{self.tail[:40]!r} is no whole turn")


def _render(role: str, text: str) -> str:
    if role == "user":
        return f"[INST]{text}[/INST]"
    if role == "system":
        return f"<<SYS>>{text}<</SYS>>"
    return f"{text}</s>" if role == "assistant" else f"<<ROLE>>{role}<</ROLE>>{text}</s>"


def render_turn(role: str, text: str) -> str:
    """A turn's rendered text, escaped only where it would not be read back as it is."""
    for r, t in ((role, text), (role, escaped(text)), (escaped(role), escaped(text))):
        s = _render(r, t)
        try:
            if [x[:2] for x in parse(s)] == [(role, text)]:
                return s
        except GrammarError:
            pass
    raise GrammarError(f"no rendering of a turn of {role!r} is read back")


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with ``formatted``, its rendered segment; segments in order of turn are the whole.

    Rows are independent: no shuffle; repeated rows are turns of their own, no rows give none, and a very long turn is one
    row. Null role or text counts as empty. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(list(c), pa.string()) for c in ([r for r, _ in pairs], [t for _, t in pairs], [render_turn(r, t) for r, t in pairs]))], names=["conv_id", "turn", "role", "text", "formatted"])

    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string")


OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text alone.

    Partitions are sorted by conversation and turn, and a conversation's segments read as one text: the parser, not where
    a segment ends, finds the turns. Of a conversation, however long, a task holds its running digests, what is read of
    one turn, and one batch of segments; a turn is held whole. Turns of one number are in order of role and text; null
    conv_ids are one conversation; null turns come first. An empty table gives an empty table.
    """
    spark = formatted.sparkSession
    dealt = formatted.repartition(partitions(spark, size_of(formatted)), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, schema = None, None, pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUT.split(", ")])

        def done():
            state[5].close()
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for conv, segment in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                state[4] += len(segment)
                for role, text, loss in state[5].feed(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if loss:
                        state[2] += len(text)
                        state[3].update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(), schema)], schema=schema)

    return dealt.mapInArrow(run, OUT)


#: Fixed value: a conversation that is nothing but control strings.
HARD = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_turns(rows.unionByName(own)))
