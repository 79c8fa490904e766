"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers and capitalised names become typed placeholders. Windows of the resulting templates
are hash-joined with the benchmark's; a window with few literal words is compared word for word instead. What fills
the placeholders must be a one-to-one exchange of the benchmark's values over a whole match: re-parameterised
questions pass that check, texts that only share a frame don't.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import among, table, written

NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Units that become a placeholder after a number.
UNITS = "km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs oz pound pounds gram grams kilogram kilograms ton tons l ml litre litres liter liters gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur mph kmh kb mb gb tb degree degrees".split()
#: Java regex of what parts words: ASCII space and punctuation, but not a point or comma inside a number.
BETWEEN = r"(?:[\s!-+\-/:-@\[-`{-~]|[.,](?!\d))+"


@dataclass(frozen=True)
class Matching:
    """window: words; literals: fewest in a window for its template to be sought; share: of an item that leaks.

    broadcast, bytes: most benchmark windows, and bytes of them, that go to every executor at once; beyond, the join runs
    in blocks of that.
    """

    window: int = 8
    literals: int = 4
    share: float = 0.5
    broadcast: int = 500_000
    bytes: int = 128 << 20


def placeholder(w: Column) -> Column:
    """NUM, UNIT or NAME for a number, a unit or a capitalised word, else null. ASCII words are told by their order."""
    first = F.substring(w, 1, 1)
    return F.when((w >= "a") & (w < "{"), F.when(w.isin(UNITS), UNIT)).when((w >= "A") & (w < "a"), NAME).when((w >= "0") & (w < ":"), NUM).when(F.lower(first) != first, NAME)


def _template(words: str) -> Column:
    """The hash of each word's template: of its placeholder, or of the word."""
    return F.transform(words, lambda w: F.xxhash64(F.coalesce(placeholder(w), w)))


def _plain(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _windows(hashes: str, size: int, kind: str) -> Column:
    """The key of each window: a hash of its words' hashes and of its kind (windows of other sizes hash otherwise)."""
    n = F.size(hashes)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, size), F.lit(kind))))


def _sought(items: DataFrame, size: int, how: Matching) -> dict[str, tuple[DataFrame, int]]:
    """The windows of items to look for, and how many, by kind: templates, and plain words for items that are mostly placeholders."""
    ours = items.filter(F.least("item_words", F.lit(how.window)) == size)
    literal = lambda part: F.size(F.filter(part, lambda w: placeholder(w).isNull())) >= min(how.literals, size)
    starts = F.filter(F.sequence(F.lit(1), F.col("item_words") - size + 1), lambda i: literal(F.slice("_item", i, size)))
    held = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + size - 1)))))
    ours = ours.withColumn("_rich", held >= how.share * F.col("item_words"))
    out = {}
    for kind, hashes, rows in (("template", _template("_item"), ours.filter("_rich")), ("plain", _plain("_item"), ours.filter(~F.col("_rich")))):
        rows = rows.withColumn("_h", hashes).select("item_id", "item_hash", "item_words", "_item", F.posexplode(_windows("_h", size, kind)).alias("_at", "_key"))
        rows = rows.select("item_id", "item_hash", "item_words", (F.col("_at") + 1).alias("item_at"), "_key", F.slice("_item", F.col("_at") + 1, size).alias("item_slice"))
        rows = rows.filter(literal(F.col("item_slice"))) if kind == "template" else rows
        out[kind] = rows, rows.count()
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, how: Matching = Matching(), text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, covered, item_words, coverage, slots, exchanged) of each document and item it holds.

    ``covered`` words of the item lie in matched windows whose slots are consistent, at least ``how.share`` of its
    words; ``exchanged`` slots have another value than the item. text_hash tells apart rows that share a doc_id;
    rows alike in both give one result. Null or empty texts and items hold nothing; an item of fewer words than a
    window is one window; items that share an item_id are told apart by their texts; an empty table on either side
    gives no rows; other columns are left out; a very long text is one row, compared whole. Documents aren't shuffled: only
    matched windows are.
    """
    split = F.split(F.coalesce("_text", F.lit("")), BETWEEN)
    items = benchmark.select("item_id", F.col(text).alias("_text")).distinct().select("item_id", F.xxhash64("_text").alias("item_hash"), F.filter(split, lambda w: w != "").alias("_item")).withColumn("item_words", F.size("_item"))
    items = written(items.filter("item_words > 0"))
    sizes = [r[0] for r in items.select(F.least("item_words", F.lit(how.window)).alias("n")).distinct().collect()]  # at most window numbers
    docs = documents.select("doc_id", F.col(text).alias("_text")).withColumn("_words", split).withColumn("text_hash", F.xxhash64("_text"))
    # one pass over the documents for all sizes and kinds: their windows' keys stand one after another in one array, and a
    # match's place in it, less the windows of the kinds before, is its place in the document
    before, keys, sought = F.lit(0), [], []
    for size in sorted(sizes):
        for kind, (some, n) in _sought(items, size, how).items():
            if n:
                keys.append(F.coalesce(_windows(f"_{kind}", size, kind), F.array().cast("array<long>")))
                sought.append((some.withColumn("_kind", F.lit(len(sought))), before, size))
                before = before + F.greatest(F.lit(0), F.size("_words") - size + 1)
    empty = "doc_id long, text_hash long, item_id long, covered int, item_words int, coverage double, slots int, exchanged int"
    if not sought:
        return documents.sparkSession.createDataFrame([], empty)
    wanted = written(reduce(DataFrame.unionByName, [x for x, _, _ in sought]))
    n, size = wanted.agg(F.count("*"), F.sum(F.size("item_slice") * 24 + F.length(F.array_join("item_slice", "")) + 64)).first()
    blocks = max(-(-n // how.broadcast), -(-size // how.bytes))
    # keys in a projection of their own: exploding and probing then compile to one loop that copies a row's words only
    # where a window matches; outer, or a filter on the keys' number would compute them again for each window
    rows = docs.select("doc_id", "text_hash", "_words", _template("_words").alias("_template"), _plain("_words").alias("_plain"))
    rows = rows.select("doc_id", "text_hash", "_words", F.concat(*keys).alias("_keys")).select("doc_id", "text_hash", "_words", F.posexplode_outer("_keys").alias("_at", "_key"))
    place = reduce(lambda other, x: F.when(F.col("_kind") == x[0], F.col("_at") - x[1][1]).otherwise(other), enumerate(sought), F.lit(None).cast("int"))
    found = []
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.filter(F.pmod("_key", F.lit(blocks)) == block)
        hits = rows.join(F.broadcast(some), "_key").withColumn("_at", place)
        found.append(hits.select("doc_id", "text_hash", "item_id", "item_hash", "item_words", "item_at", (F.col("_at") + 1 - F.col("item_at")).alias("_shift"), "item_slice", F.slice("_words", F.col("_at") + 1, F.size("item_slice")).alias("doc_slice")))
    matched = reduce(DataFrame.unionByName, found)
    key = ["doc_id", "text_hash", "item_id", "item_hash", "item_words"]
    pairs = F.filter(F.zip_with("item_slice", "doc_slice", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: placeholder(p["a"]).isNotNull())
    runs = (
        matched.withColumn("_same", _frame(F.col("item_slice"), F.col("doc_slice")))  # not a filter, which would move into the join
        .select(*key, "_shift", F.when(F.col("_same"), F.struct("item_at", F.size("item_slice").alias("n"))).alias("_window"), F.when(F.col("_same"), pairs).alias("_pairs"))
        .groupBy(*key, "_shift")
        .agg(F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs"), F.collect_set("_window").alias("_windows"))
        .filter(F.size("_windows") > 0)
    )
    one_to_one = (F.size(F.array_distinct(F.col("_pairs.a"))) == F.size("_pairs")) & (F.size(F.array_distinct(F.col("_pairs.b"))) == F.size("_pairs"))
    covered = F.flatten(F.transform("_windows", lambda w: F.sequence(w["item_at"], w["item_at"] + w["n"] - 1)))
    return (
        runs.filter(one_to_one)
        .select(*key, F.array_distinct(covered).alias("_covered"), F.size("_pairs").alias("slots"), F.size(F.filter("_pairs", lambda p: p["a"] != p["b"])).alias("exchanged"))
        .groupBy(*key)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("_covered")))).alias("covered"), F.max("slots").alias("slots"), F.max("exchanged").alias("exchanged"))
        .withColumn("coverage", F.col("covered") / F.col("item_words"))
        .filter(F.col("coverage") >= how.share)
        .select("doc_id", "text_hash", "item_id", "covered", "item_words", "coverage", "slots", "exchanged")
    )


def _frame(a: Column, b: Column) -> Column:
    """Whether two windows agree outside their slots: a hash that matched by chance doesn't count."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(placeholder(x) == placeholder(y), placeholder(x).isNull() & placeholder(y).isNull() & (x == y)) | (F.lower(x) == F.lower(y))), lambda ok: ok)


def clean(documents: DataFrame, benchmark: DataFrame, how: Matching = Matching()) -> DataFrame:
    """``documents`` without those that hold a benchmark item; other rows and all columns stay as they are.

    Rows alike in doc_id and text share their fate. Null and empty texts hold nothing and stay; no items, all stay; very
    long texts are compared whole. Documents are shuffled only if more than a million of them leak.
    """
    return among(documents, written(leaks(documents, benchmark, how).select("doc_id", F.col("text_hash").alias("mark")).distinct()), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
