"""URL filtering by association rules, in DataFrame functions only.

Labelled URLs are sets of tokens plus one item for a bad label; FP-growth mines the sets that are frequent, and
those that imply a bad label with enough confidence become rules, as many as there are. Rules are kept as an inverted
index, a table from one token of each rule to the rule: a URL's tokens are joined with it, and a rule fires when the
URL has all its tokens. Fixed allow and block rules by host and path come before mined ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table, written

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class Mining:
    """rows: bad URLs that a rule must hold in, at least ``share`` of all labelled ones; confidence: least share of the
    labelled URLs with a rule's tokens that are bad, at least ``lift`` times the share of all; tokens: most in a rule
    (as in the query's SQL)."""

    rows: int = 5
    share: float = 1e-4
    confidence: float = 0.5
    lift: float = 1.5
    tokens: int = 3


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels and their parts, path words (numbers as #), and names of query parameters."""
    labels = F.split(F.regexp_replace(host_of(url), r"[:@].*", ""), r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.when(x.contains("-"), F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))))
    path = F.split(F.lower(F.regexp_replace(path_of(url), r"\d+", "#")), r"[^\p{L}#]+")
    query = F.regexp_extract_all(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    named = [F.transform(F.filter(c, lambda x: x != ""), lambda x, kind=kind: F.concat(F.lit(kind), x)) for kind, c in (("h:", parts), ("p:", path), ("q:", query))]
    return F.array_distinct(F.concat(*named))


def rules_of(labelled: DataFrame, how: Mining = Mining()) -> DataFrame | None:
    """Rules (items, confidence), all there are, from rows (url, bad); None where nothing can be a rule.

    A rule that another one with fewer of its tokens covers at the same or more confidence is left out. Null or
    empty URLs have no tokens; no rows, or no bad ones, give no rules.
    """
    baskets = written(labelled.select(F.when(F.coalesce(F.col("bad"), F.lit(False)), F.concat(tokens_of(F.col("url")), F.array(F.lit(BAD)))).otherwise(tokens_of(F.col("url"))).alias("items")).filter(F.size("items") > 0))
    n, bad = baskets.agg(F.count("*"), F.count(F.when(F.array_contains("items", BAD), 1))).first()
    if not bad:
        return None
    support = max(how.share, how.rows / n)
    if support > 1 or how.lift * bad > n:
        return None
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=max(how.confidence, min(1.0, how.lift * bad / n))).fit(baskets).associationRules
    found = written(found.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.sort_array("antecedent").alias("items"), "confidence").filter(F.size("items").between(1, how.tokens)))
    if found.isEmpty():
        return None
    parts = F.array(F.array().cast("array<string>"))  # all sets of a rule's tokens
    parts = F.aggregate("items", parts, lambda sets, x: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(x)))))
    smaller = found.select("items", "confidence", F.explode(parts).alias("part")).filter((F.size("part") > 0) & (F.size("part") < F.size("items")))
    other = found.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    covered = smaller.join(other, "part").filter("sure >= confidence").select("items").distinct()
    return written(found.join(covered, "items", "left_anti"))


def mine(labelled: DataFrame, how: Mining = Mining()) -> list[tuple[list[str], float]]:
    """``rules_of`` as a list, for a look at them: judging leaves them in their table."""
    rules = rules_of(labelled, how)
    return [] if rules is None else [(list(r["items"]), r["confidence"]) for r in rules.orderBy(F.desc("confidence"), F.size("items"), F.array_join("items", " ")).collect()]


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of each distinct URL that a mined rule holds for: the best confidence of those rules.

    A rule is looked up by its token that the fewest rules hold, so a token of most rules finds few of them.
    """
    tokens = rules.select("items", "confidence", F.explode("items").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held"))
    index = tokens.join(held, "token").groupBy("items", "confidence").agg(F.min(F.struct("held", "token"))["token"].alias("token"))
    ours = urls.select("url").distinct().withColumn("_tokens", tokens_of(F.col("url")))
    hits = ours.select("url", "_tokens", F.explode("_tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("items", "_tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path as one string) that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, how: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every URL.

    ``labels`` (doc_id, quality, toxic) label the page of that id: bad is toxic, or quality 0; a page labelled more
    than once is bad if any label is. Null labels say nothing. Null URLs have an empty host and path and are
    allowed. Repeated pages come out as often as they are; other columns are left out; no pages, no rows. Mining reads
    the labelled pages only; where no rule is mined, judging needs no shuffle, else URLs are joined with the rules.
    """
    bad = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).filter(F.col("bad").isNotNull())
    ours = pages.select("page_id", "url")
    mined = rules_of(ours.join(bad, ours["page_id"] == bad["doc_id"]).select("url", "bad"), how)
    ours = ours.withColumn("confidence", F.lit(None).cast("double")) if mined is None else ours.join(fired(ours, mined), "url", "left")
    out = ours.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence")
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
