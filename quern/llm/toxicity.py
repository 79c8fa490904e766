"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

All thresholds between grades share one weight per feature: P(grade >= k) = sigmoid(w.x - t_k), t_1 < t_2 < ...
Features are the words of a text and their stems of four and five letters, each present or not. Expected severity
is the sum of P(grade >= k) over k.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table, written

_WORD = re.compile(r"[^\W\d_]+")
#: Characters of a text that are cut into words at a time.
STEP = 1 << 20
#: Words whose features a worker remembers.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Fit:
    """rows: most labelled documents that the model is fitted on (those with the least hash of their id).

    support: documents that a feature must be in; evidence: least likelihood ratio (G2) for a feature against the
    grades; features: most that are kept, the strongest first; penalty: of squared weights.
    """

    rows: int = 20_000
    support: int = 3
    evidence: float = 15.0
    features: int = 4000
    penalty: float = 1e-6
    rounds: int = 800


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()


def features_of(word: str) -> tuple[str, ...]:
    out = [word]
    if len(word) >= 4:
        out.append(word[:4] + "*")
    if len(word) >= 5:
        out.append(word[:5] + "*")
    return tuple(out)


def vocabulary(text: str) -> set[str]:
    """The distinct words of a text in lower case. A word is a run of letters."""
    found: set[str] = set()
    at, n = 0, len(text)
    while at < n:
        cut = at + STEP
        while cut < n and text[cut].isalpha():
            cut += 1
        found.update(_WORD.findall(text[at:cut].lower()))
        at = cut
    return found


def present(text: str) -> set[str]:
    out: set[str] = set()
    for word in vocabulary(text):
        out.update(features_of(word))
    return out


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from a column ``grade`` (0 is not toxic), or from ``toxic``, which tells two grades apart, 0 and 1.

    Null ids or labels are left out; of several labels of a document the worst counts.
    """
    grade = F.col("grade" if "grade" in labels.columns else "toxic").cast("int")
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def _sample(docs: DataFrame, labels: DataFrame, how: Fit) -> DataFrame:
    """(grade, text) of at most about how.rows labelled documents; only these ids are sent to the documents."""
    ids = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.rows)
    ours = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return ours.join(F.broadcast(ids), "doc_id").select("grade", "text")


def _choose(sample: DataFrame, how: Fit) -> list[str]:
    """The features that tell toxic documents from others, at most how.features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, all_ = Counter(), Counter()
            for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text").to_pylist()):
                found = present(text)
                all_.update(found)
                if grade:
                    bad.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.string()), pa.array([bad[x] for x in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], names=["feature", "bad", "n"])

    total, bad = sample.agg(F.count("*"), F.count(F.when(F.col("grade") > 0, 1))).first()
    if not bad or bad == total:
        return []
    x = sample.mapInArrow(count, "feature string, bad long, n long").groupBy("feature").agg(F.sum("bad").cast("double").alias("a"), F.sum("n").cast("double").alias("n")).filter(F.col("n") >= how.support)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, n = F.col("a"), F.col("n")
    share = F.lit(bad / total)
    g2 = 2 * (part(a, n * share) + part(n - a, n * (1 - share)) + part(bad - a, (total - n) * share) + part((total - n) - (bad - a), (total - n) * (1 - share)))
    best = x.withColumn("g2", g2).filter(F.col("g2") >= how.evidence).orderBy(F.desc("g2"), "feature").limit(how.features).collect()
    return [r["feature"] for r in best]


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """The model of (doc_id, text) and (doc_id, quality, toxic). Without both toxic and other documents it says 0 of all,
    as it does of empty tables. Documents of a labelled id, repeated rows too, each count; nulls are as in ``graded`` and
    null texts empty; which documents are taken, and which of equally strong features, doesn't depend on the rows' order.

    To the driver come at most how.features features and how.rows rows of their numbers.
    """
    sample = written(_sample(docs, labels, how))
    names = _choose(sample, how)
    if not names:
        return Model()
    index = {x: i for i, x in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades, found = [], []
            for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text").to_pylist()):
                grades.append(grade)
                found.append(sorted({index[x] for x in present(text) if x in index}))
            yield pa.RecordBatch.from_arrays([pa.array(grades, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["grade", "at"])

    data = sample.mapInArrow(rows, "grade int, at array<int>").toArrow()
    grades = data.column("grade").to_numpy()
    at = data.column("at").combine_chunks()
    sizes = np.asarray(at.value_lengths())
    there, levels = np.unique(grades, return_inverse=True)  # grades that occur, gapless
    weights, cuts = train(levels, np.repeat(np.arange(len(grades)), sizes), np.asarray(at.flatten()), len(names), len(there), how)
    thresholds = [float(cuts[np.searchsorted(there, g) - 1]) for g in range(1, int(there[-1]) + 1)]  # a grade without rows shares the next one's
    return Model({x: float(w) for x, w in zip(names, weights)}, tuple(thresholds))


def train(levels: np.ndarray, row: np.ndarray, col: np.ndarray, n: int, k: int, how: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by Adam on the full likelihood of a cumulative-link (logit) model."""
    rows = len(levels)
    share = np.array([(levels >= j).mean() for j in range(1, k)])
    start = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for step in range(1, how.rounds + 1):
        w, cuts = theta[:n], theta[n] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n + 1 :]))])
        score = np.bincount(row, weights=w[col], minlength=rows)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        above, beyond = edges[levels], edges[levels + 1]
        a = np.where(np.isinf(above), 1.0, sigmoid(score - np.where(np.isinf(above), 0, above)))
        b = np.where(np.isinf(beyond), 0.0, sigmoid(score - np.where(np.isinf(beyond), 0, beyond)))
        p = np.maximum(a - b, 1e-12)
        slope = -(1 - a - b) / rows
        grad_w = np.bincount(col, weights=slope[row], minlength=n) + how.penalty * w
        d_cut = np.zeros(k - 1)
        low, high = levels > 0, levels < k - 1
        np.add.at(d_cut, levels[low] - 1, (a * (1 - a) / p)[low] / rows)
        np.add.at(d_cut, levels[high], -(b * (1 - b) / p)[high] / rows)
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * np.exp(theta[n + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n], theta[n] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n + 1 :]))])


def judge(texts: list[str | None], model: Model, known: dict[str, tuple[str, ...]]) -> list[tuple[float, int]]:
    """(expected severity, levels whose probability is at least a half) of each text. known: features by word, kept."""
    thresholds = np.array(model.thresholds)
    out = []
    for text in texts:
        found: set[str] = set()
        for word in vocabulary(text or ""):
            hits = known.get(word)
            if hits is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                hits = known[word] = tuple(x for x in features_of(word) if x in model.weights)
            if hits:
                found.update(hits)
        p = 1 / (1 + np.exp(-np.clip(sum(model.weights[x] for x in sorted(found)) - thresholds, -35, 35)))
        out.append((float(p.sum()), int((p >= 0.5).sum())))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade) of whole texts; null counts as empty, other columns are left out. No shuffle.

    Rows are independent: repeated rows and ties come out as often as they are, no rows give none; a very long text is
    read in parts. Expected severity is the sum over the thresholds of the probability to be above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            found = judge(batch.column("text").to_pylist(), model, known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array([g for _, g in found], pa.int32())], names=["doc_id", "severity", "grade"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade int")


def reject_toxic(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """``docs`` without rows of grade 1 or more; the others keep all their columns, and a column named like one of
    ``score`` is no matter. Null and empty texts stay; repeated rows share their fate; no documents or no labels, no change.
    """
    model = fit(docs, labels, how)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            yield batch.filter(pa.array([g < 1 for _, g in judge(batch.column(at).to_pylist(), model, known)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "grade")
