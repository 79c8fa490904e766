"""One-permutation MinHash against exact Jaccard, and the edited-text query against plain Python."""

import hashlib

import numpy as np
import pytest

from quern.llm.common import shingle_hashes, words_of
from quern.llm.fingerprint import BINS, edited_pairs, fingerprint, likeness, minhash


def jaccard(a: str, b: str, k: int = 5) -> float:
    sets = [{tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))} for x in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_likeness_is_near_the_jaccard_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (12, 60, 700, 4000):
        for share in (0.0, 0.2, 0.5, 0.8, 0.95):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            other = [f"v{x}" for x in rng.integers(0, 10**6, n)]
            cut = int(n * share)
            a, b = " ".join(words), " ".join(words[:cut] + other[cut:])
            errors.append(likeness(fingerprint(a.encode()), fingerprint(b.encode())) - jaccard(a, b))
    assert np.abs(errors).max() < 0.1 and abs(np.mean(errors)) < 0.02


def test_equal_texts_are_alike_and_empty_ones_too():
    for text in (b"", b" \n", b"one", b"a b c d e f g", "é ü ß 漢字 words".encode()):
        assert likeness(fingerprint(text), fingerprint(text)) == 1.0 and len(fingerprint(text)) == BINS // 2
    assert fingerprint(b"") == fingerprint(b" \t") and likeness(fingerprint(b""), fingerprint(b"a b c d e f")) < 0.2
    assert fingerprint(b"A  b\nC d E f") == fingerprint(b"a b c d e f")


def test_words_and_shingles_do_not_depend_on_the_part_size():
    text = b" ".join(b"w%d" % (i % 91) for i in range(5000)) + b"\x0b\x0c tail"
    assert [w for part in words_of(text, 64) for w in part] == text.split()
    import xxhash

    words = text.split()
    assert shingle_hashes(text, 5).tolist() == [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (fingerprint(x.encode()) for x in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(i * 7 % 101, f"text {i} é " * (i % 9)) for i in range(101)],
    [(5, "only one")],
    [(3, "a b c"), (3, "a b"), (3, "a b c"), (None, None), (None, "x y"), (-2, ""), (2**40, "漢字 " * 50)],
    [(None, "a"), (None, "b")],
])
def test_edited_pairs(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, _part int, fingerprint string")
    assert sorted((tuple(r) for r in edited_pairs(df).collect()), key=str) == expected(rows)


def test_many_ranges(spark):
    rows = [(i * i, f"text {i}") for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        got = edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty_table(spark):
    assert edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [bytes(r.fingerprint) for r in minhash(df).orderBy("doc_id").collect()] == [fingerprint(b"a b"), fingerprint(b"")]
