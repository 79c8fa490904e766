"""Toxicity, line dedup, URL rules and decontamination: held-out accuracy, brute force, and odd input."""

import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import decontaminate, line_dedup, toxicity, url_rules
from quern.llm.decontaminate import Matching, leaks
from quern.llm.line_dedup import Units, cut, dedup, merged, units
from quern.llm.toxicity import Fit, fit, graded, reject_toxic, score, train

DOCS = "doc_id long, text string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# --- toxicity ---

PLAIN = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ban", "del", "fir", "gon", "hul", "jim", "kol")]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(5, 60), PLAIN).split()
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range(grade * 3):
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "moron!", "scumling", "scummage", "SCUMS"]))
        docs.append((i, " ".join(words)))
        labels.append((i, grade, int(grade > 0)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_documents_are_told_apart(labelled):
    docs, labels, truth = labelled
    model = fit(docs, labels.withColumnRenamed("quality", "grade").filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in score(docs, model).collect()}
    held = [(got[i].grade > 0, bool(t)) for i, _, t in truth if i % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.99
    by_grade = [np.mean([got[i].severity for i, q, _ in truth if i % 2 and q == g]) for g in (0, 1, 2)]
    assert by_grade[0] < 0.1 and by_grade[0] < by_grade[1] < by_grade[2] < 2.0001
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    kept = reject_toxic(docs.withColumn("severity", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "severity"] and {r.doc_id for r in kept.collect()} == {i for i, _, t in truth if not t}


def test_three_grades_share_weights(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(1200):
        grade = i % 3
        words = prose(rng, 30, PLAIN).split() + ["scum"] * (grade > 0) + [rng.choice(["vermin", "scumlord"])] * (grade > 1)
        docs.append((i, " ".join(words)))
        labels.append((i, grade))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, grade int")
    model = fit(docs, labels.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert sum(got[i].grade == i % 3 for i in range(1, 1200, 2)) > 590
    means = [np.mean([got[i].severity for i in range(1, 1200, 2) if i % 3 == g]) for g in range(3)]
    assert means[0] < 0.1 and abs(means[1] - 1) < 0.1 and means[2] > 1.9
    two = fit(docs, labels.selectExpr("doc_id", "int(grade > 0) as toxic"))  # labels without grades: two of them
    assert len(two.thresholds) == 1 and score(docs, two).agg(F.max("grade")).first()[0] == 1


def test_weights_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3)) < 0.5
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=3000)
    levels = (latent > 0.5).astype(int) + (latent > 2)
    row, col = np.nonzero(x)
    weights, cuts = train(levels, row, col, 3, 3, Fit(penalty=0.0))
    assert np.allclose(weights, [2, -1, 0], atol=0.3) and np.allclose(cuts, [0.5, 2], atol=0.3)


def test_toxicity_edges(spark, labelled):
    docs, labels, _ = labelled
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "idiot " * 9, 5), (3, "x" * 3_000_000, 5), (3, "x" * 3_000_000, 5)], DOCS + ", grade int")
    model = fit(docs, labels)
    assert sorted(((r.doc_id, r.grade) for r in score(odd, model).collect()), key=str)[:2] == [(1, 0), (2, 0)]
    assert score(odd.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert {(r.severity, r.grade) for r in score(odd, fit(docs, none)).collect()} == {(0.0, 0)}
    assert len(fit(docs, labels.selectExpr("doc_id", "quality * 2 as grade")).thresholds) == 4  # grades 1 and 3 don't occur
    mixed = spark.createDataFrame([(1, None, 1), (1, 0, 1), (2, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in graded(mixed).collect()) == [(1, 1), (3, 1), (4, 0)]


# --- line dedup ---


def brute_dedup(rows, how=Units()):
    first, out = {}, {}
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    marks = {r: i for i, r in enumerate(order)}
    for r in order:
        gone = [False] * len(r[2])
        for (start, end), unit in sorted(plain_units(r[2], how).items()):
            if first.setdefault(unit, (marks[r], start)) != (marks[r], start):
                gone[start:end] = [True] * (end - start)
        out[r] = gone
    result = []
    for d, t in rows:
        gone = out[d is None, d or 0, t or ""]
        edges = [i for i in range(len(gone) + 1) if (i < len(gone) and gone[i]) != (i > 0 and gone[i - 1])]
        spans = list(zip(edges[::2], edges[1::2]))
        result.append((d, t if t is None else plain_cut(t, spans), spans))
    return result


def plain_cut(text, spans):
    for a, b in reversed(spans):
        left, right = text[:a].rstrip(), text[b:].lstrip()
        gap = text[len(left) : a] + text[b : len(text) - len(right)]
        text = left + ("" if not left or not right else "\n" if "\n" in gap else " ") + right
    return text


def plain_units(text, how=Units()):
    """The units of text in scripts with spaces, word by word: (start, end) -> normalised text."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\S+", text)]
    gaps = ["\n", *(text[a[1] : b[0]] for a, b in zip(words, words[1:]))]
    begins = [k for k, (a, _, _) in enumerate(words) if set("\n\r") & set(gaps[k]) or re.search(r"[.!?…]$", words[k - 1][2]) or re.match(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]", text[a])]
    out = {}
    for seams in (begins, [k for k, w in enumerate(words) if k in begins or xxhash.xxh3_64_intdigest(w[2]) % how.every == 0]):
        pieces = [words[a:b] for a, b in zip(seams, [*seams[1:], len(words)])]
        for i in range(len(pieces)):
            for j in range(i + 1, len(pieces) + 1):
                some = [w for piece in pieces[i:j] for w in piece]
                if len(some) >= how.words or sum(len(" ".join(w[2] for w in piece)) for piece in pieces[i:j]) >= how.chars:
                    out[some[0][0], some[-1][1]] = " ".join(w[2] for w in some)
                    break
    lines = [x for x in re.finditer(r"[^\n\r]+", text) if x[0].strip()]
    for m in lines if len(lines) > 1 or out else []:
        unit = " ".join(m[0].lower().split())
        if len(unit.split()) >= how.line_words or len(unit) >= how.line_chars:
            out[m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - len(m[0]) + len(m[0].rstrip())] = unit
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["one", "Two", "three.", "four!", "five", "Été", "ein", "ΣΑΣ", "x", "longerword" * 4, "…", "seven?"]), st.sampled_from([" ", " ", " ", "  ", "\n", "\r\n", "\t", " \u00a0"])), max_size=60))
def test_units_are_those_of_going_word_by_word(parts):
    text = "".join(a + b for a, b in parts)
    found = list(units(text))
    assert {(a, b): u for a, b, u in found} == plain_units(text) and len({x[:2] for x in found}) == len(found)


def test_units():
    found = list(units("One two three. Four five six seven eight nine.\nTen eleven and a Passage of four words more here."))
    assert found[0] == (0, 46, "one two three. four five six seven eight nine.") and found[1][0] == 15 and found[2][0] == 47
    assert [u for _, _, u in units("a b c d e f g h")] == ["a b c d e f g h"] and list(units("a b c")) == [] and list(units("")) == []
    assert len(list(units("漢" * 100))) == 1
    long = " ".join(f"w{i}" for i in range(200))
    assert len(list(units(long))) > 10 and all(long[a:b] == u for a, b, u in units(long))


def test_cuts():
    assert cut("ab cd ef", [(3, 5)]) == "ab ef" and cut("ab\ncd ef", [(3, 5)]) == "ab\nef"
    assert cut("ab", [(0, 2)]) == "" and cut(" ab cd", [(1, 3)]) == " cd"[1:] and cut("x", []) == "x"


def test_cutting_takes_linear_time():
    text = "ab cd " * 200_000
    began = time.perf_counter()
    assert cut(text, [(i, i + 2) for i in range(0, len(text), 6)]) == " ".join(["cd"] * 200_000) + " "
    assert time.perf_counter() - began < 5


def test_a_line_of_half_the_documents_lands_in_no_single_task(spark):
    rng = random.Random(4)
    rows = [(i, ("Read this first of all things here, then go on\n" if i % 2 else "") + prose(rng, 3, [a + b for a in PLAIN for b in PLAIN])) for i in range(8000)]
    df = spark.createDataFrame(rows, DOCS).repartition(32)
    plain = df.select("doc_id", F.lit(0).cast("long").alias("text_hash"), "text")
    sizes = [r[1] for r in line_dedup.repeats(plain).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) >= 3999 and max(sizes) < 2 * sum(sizes) / 4  # four partitions
    got = dedup(df)
    assert got.filter("size(removed) > 0").count() == 3999 and got.filter("doc_id = 1 and size(removed) = 0").count() == 1


def test_a_batch_of_many_texts_is_held_in_parts(spark, monkeypatch):
    """What a Python worker holds besides the batch that it gets, as Spark sends 10,000 documents at a time."""
    import tracemalloc

    import pyarrow as pa

    made, frame = [], type(spark.range(0))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: made.append(run) or plain(self, run, schema))
    rng = random.Random(5)
    words = [a + b for a in PLAIN for b in PLAIN]
    texts = [prose(rng, 60, words) for _ in range(3000)]
    dedup(spark.createDataFrame([(1, "a")], DOCS))
    found, _, cutter = made
    batches = [[[*range(3000)], [0] * 3000, texts], [[*range(3000)], texts, [[(1 << 32) + 40]] * 3000]]
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text", pa.string())], [("doc_id", pa.int64()), ("text", pa.string()), ("_spans", pa.list_(pa.int64()))]
    size = sum(map(len, texts))
    for run, columns, kind, most in ((found, batches[0], kinds[0], 10_000_000), (cutter, batches[1], kinds[1], size)):
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kind)], names=[n for n, _ in kind])
        tracemalloc.start()
        held = pa.total_allocated_bytes()
        rows = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= 3000 and pa.total_allocated_bytes() - held < size and peak < most, (rows, peak / size, peak)


def test_very_long_texts_and_nothing_at_all(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: r for r in dedup(spark.createDataFrame([(1, long), (2, long + " tail"), (3, None), (4, ""), (5, " \n ")], DOCS)).collect()}
    assert got[1].text == long and len(got[2].text.split()) < 30 and got[3].text is None and (got[4].text, got[5].text) == ("", " \n ")


def test_a_passage_pasted_into_a_line_is_removed(spark):
    rng = random.Random(5)
    sentence = lambda n: prose(rng, n, PLAIN).capitalize() + "."
    passage = " ".join(sentence(rng.randint(2, 14)) for _ in range(9))
    hosts = [prose(rng, 30, PLAIN).split() for _ in range(3)]
    rows = [(10 + i, " ".join(h[:15] + [passage] + h[15:])) for i, h in enumerate(hosts)]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[10].text == rows[0][1] and got[10].removed == []
    for i in (11, 12):
        host = hosts[i - 10]
        left = got[i].text
        assert left.startswith(" ".join(host[:15])) and left.endswith(" ".join(host[15:]))
        assert len(left.split()) - 30 <= 0.25 * len(passage.split())


def test_a_passage_in_text_without_any_seam_is_removed(spark):
    rng = random.Random(8)
    words = [a + b for a in PLAIN for b in PLAIN]
    passage = prose(rng, 70, words)
    rows = [(i, " ".join([prose(rng, 40, words), passage, prose(rng, 40, words)])) for i in range(2)]
    first, second = dedup(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()
    assert first.text == rows[0][1] and 80 <= len(second.text.split()) <= 100


@pytest.mark.parametrize("sizes", [(26, 26), (30, 30), (32, 20), (14, 44)])
def test_a_passage_with_one_inner_sentence_break_is_cut_alike_in_any_context(sizes):
    rng = random.Random(9)
    words = [a + b for a in PLAIN for b in PLAIN]
    for _ in range(50):
        a, b = (prose(rng, n, words) for n in sizes)
        passage = f"{a}. {b.capitalize()}"
        line = f"{prose(rng, 40, words)}\n{passage}\n{prose(rng, 40, words)}"
        middle = f"{prose(rng, 20, words)} {passage} {prose(rng, 20, words)}"
        digests = {u for _, _, u in units(line)}
        spans = merged([(x, y) for x, y, u in units(middle) if u in digests])
        assert sum(len(middle[x:y].split()) for x, y in spans) >= 0.4 * sum(sizes)


@pytest.mark.parametrize("stops", ["", "。"])
def test_a_passage_in_a_script_without_spaces_is_found_inside_lines(stops):
    rng = random.Random(12)
    run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    for _ in range(20):
        passage = stops.join(run(40) for _ in range(5))
        one, two = (run(60) + passage + run(60) for _ in range(2))
        digests = {u for _, _, u in units(one)}
        spans = merged([(x, y) for x, y, u in units(two) if u in digests])
        assert sum(y - x for x, y in spans) >= 0.5 * len(passage) and all(two[x:y] in passage for x, y in spans)


def test_short_lines_are_removed_but_where_they_stand_first(spark):
    rng = random.Random(10)
    texts = [prose(rng, 12, PLAIN) + "\n  Read more here\r\nOK\n" + prose(rng, 12, PLAIN) for _ in range(4)]
    got = [r.text for r in dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()]
    assert got[0] == texts[0] and got[1:] == [t.replace("  Read more here\r\n", "") for t in texts[1:]]  # "OK" says nothing


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [prose(rng, rng.randint(1, 12), PLAIN).capitalize() + rng.choice([".", "", "!"]) for _ in range(25)]
    rows = [(i or None, rng.choice([None, "", *["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))] * 4])) for i in rng.sample(range(120), 120)]
    rows += rows[:5]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS + ", removed string, digest int").repartition(6)
    got = dedup(df)
    assert got.columns == ["doc_id", "text", "digest", "removed"]
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(((r.doc_id, r.text, [tuple(x) for x in r.removed]) for r in got.collect()), key=key) == sorted(brute_dedup(rows), key=key)
    assert dedup(df.limit(0)).count() == 0


# --- URL rules ---


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://a.org/x?y#z", "a.org", "/x", "org/"),
    ("HTTP://M.Example.ORG/es/1", "m.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/"),
    ("x://q.com/fr/", "q.com", "/fr/", "com/fr/"),
    ("x://q.com/de/a", "q.com", "/de/a", "com/de/"),
    ("x://q.com?/de/", "q.com", "", None),
    ("x://a.org", "a.org", "", None),
    ("x://a://b.org/", "a:", "//b.org/", None),
    ("no host", "", "", None), ("", "", "", None), (None, "", "", None),
    ("http://ÄB.org/é", "Äb.org", "/é", "org/"),
])
def test_hosts_paths_and_fixed_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string").select(url_rules.host_of(F.col("url")).alias("h"), url_rules.path_of(F.col("url")).alias("p"))
    name, verdict = url_rules.fixed_rule(F.col("h"), F.col("p"))
    assert tuple(df.select("h", "p", name).first()) == (host, path, rule)


def brute_rules(baskets, bad, how):
    items = sorted({x for b in baskets for x in b})
    out = []
    for n in (1, 2, 3):
        for c in combinations(items, n):
            rows = [i for i, b in enumerate(baskets) if set(c) <= b]
            hits = sum(bad[i] for i in rows)
            if hits >= how.rows and hits / len(rows) >= how.confidence:
                out.append((c, hits / len(rows)))
    return [(c, p) for c, p in out if not any(set(d) < set(c) and q >= p for d, q in out)]


def test_mined_rules_are_those_of_brute_force(spark):
    rng = random.Random(7)
    urls, bad = [], []
    for i in range(400):
        host, word, query = rng.choice(["casino-win", "news", "blog"]), rng.choice(["bet", "sport", "x"]), rng.choice(["", "?ref=1", "?utm=2"])
        urls.append(f"http://{host}.example.net/{word}/{i}{query}")
        bad.append(rng.random() < (0.95 if "casino" in host and word == "bet" else 0.8 if query == "?ref=1" and word == "x" else 0.05))
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    how = url_rules.Mining(rows=8, confidence=0.6, lift=1.0)
    tokens = {r[0]: set(r[1]) for r in pages.select("page_id", url_rules.tokens_of(F.col("url"))).collect()}
    baskets = [tokens[i] for i in range(400)]
    rules = url_rules.mine(pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", (F.col("quality") == 0).alias("bad")), how)
    small = brute_rules([{x for x in b if not x.startswith(("h:example", "h:net"))} for b in baskets], bad, how)
    blocked = {i for i, b in enumerate(baskets) if any(set(c) <= b for c, _ in small)}
    got = {r.page_id: r for r in url_rules.judge(pages, labels, how=how).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == blocked and blocked
    for i, r in got.items():
        best = max((p for c, p in rules if set(c) <= baskets[i]), default=None)
        assert r.confidence == best


def test_every_rule_counts_however_many_there_are(spark):
    urls = [f"http://site{chr(97 + i // 26)}{chr(97 + i % 26)}.net/{w}" for i in range(260) for w in ("one", "two", "three")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = pages.selectExpr("page_id as doc_id", "int(url like '%/three') as quality", "0 as toxic")
    how = url_rules.Mining(rows=1, share=0.0, lift=1.0)
    assert len(url_rules.mine(pages.selectExpr("url", "url not like '%/three' as bad"), how)) > 200
    sites = labels.filter("doc_id % 3 < 2").withColumn("toxic", F.expr("int(doc_id >= 30)")).withColumn("quality", F.lit(1))
    got = {r.page_id: r for r in url_rules.judge(pages, sites, how=url_rules.Mining(rows=2, share=0.0, confidence=0.99, lift=1.0)).collect()}
    assert len(got) == len(urls) and {i for i, r in got.items() if r.verdict == "block"} == set(range(30, len(urls)))


def test_rules_must_be_above_the_share_of_all(spark):
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.net/x") for i in range(100)], "page_id long, url string")
    for bad, blocked in ((lambda i: i % 2 == 0 or i % 10 < 6, 0), (lambda i: i % 2 == 0, 50)):
        labels = spark.createDataFrame([(i, int(not bad(i)), 0) for i in range(100)], "doc_id long, quality int, toxic int")
        assert url_rules.judge(pages, labels).filter("verdict = 'block'").count() == blocked


def test_mined_rules_decide_verdicts_of_the_tables(spark):
    got = url_rules.op7_url_rules(spark, "/root/testdata/sf0.1")
    by = {(r[0], r[1]): r[2] for r in got.groupBy("verdict", F.col("rule").isNull()).count().collect()}
    assert by["block", True] > 0 and by["allow", True] > by["block", True]
    assert got.filter("rule is null and (confidence is not null) <> (verdict = 'block')").isEmpty()


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.org/x"), (3, "")], "page_id long, url string")
    labels = spark.createDataFrame([(1, None, None), (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()), key=str) == sorted([(1, None, "allow"), (1, None, "allow"), (None, "org/", "allow"), (3, None, "allow")], key=str)
    assert url_rules.judge(pages.limit(0), labels).count() == 0 and url_rules.judge(pages, labels.limit(0)).count() == 4


# --- decontamination ---

QUESTION = "Alice buys 12 kg of apples from Bob and sells 5 kg of them at the market for 30 dollars, how many kg of apples are left with Alice now"


def found(spark, texts, items, how=Matching()):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", _words string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in leaks(docs, bench, how).collect()}


def test_reparameterised_questions_are_found_and_inconsistent_ones_are_not(spark):
    swapped = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "900").replace(" kg", " lb").replace("30", "4.5")
    broken = QUESTION.replace("Alice buys", "Carol buys")  # Alice is Carol once and Alice once
    got = found(spark, ["before " + QUESTION + " after", "so " + swapped, broken, "nothing of the kind", None, ""], [QUESTION])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].exchanged == 0 and got[0, 0].coverage == 1.0 and got[1, 0].exchanged >= 5 and got[1, 0].coverage == 1.0


def test_decontamination_edges(spark):
    names = "Ann Bea Cal Dan Eve Fay Gus Hal Ida Jon Kim Lee"
    got = found(spark, ["x " + names + " y", names.replace("Ann", "Zoe"), "tiny item here is", "a b c"], [names, "tiny item", None, "", "tiny item"])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (2, 4)} and got[1, 0].covered == 11  # of plain words, as they stand
    assert found(spark, [], [QUESTION]) == {} and found(spark, [QUESTION], []) == {}
    assert set(found(spark, [QUESTION, QUESTION + " " + QUESTION], [QUESTION] * 3, Matching(broadcast=7))) == {(d, i) for d in (0, 1) for i in range(3)}


def test_planted_items_are_found_among_random_texts(spark):
    rng = random.Random(11)
    sentence = lambda: prose(rng, rng.randint(4, 12), PLAIN).capitalize() + "."
    items = [" ".join(sentence() for _ in range(4)) for _ in range(30)]
    texts, planted = [], set()
    for d in range(200):
        parts = [sentence() for _ in range(rng.randint(1, 20))]
        if d % 4 == 0:
            i = rng.randrange(30)
            parts.insert(rng.randrange(len(parts) + 1), items[i])
            planted.add((d, i))
        texts.append("\n".join(parts))
    assert set(found(spark, texts, items)) == planted
    docs = spark.createDataFrame([(d, t, 1) for d, t in enumerate(texts)] + [(0, texts[0], 1), (0, "clean", 1), (None, texts[0], 1)], DOCS + ", keep int")
    left = decontaminate.clean(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(d, t) for d, t in enumerate(texts) if d % 4] + [(0, "clean")])


def test_native_operators_have_no_python_in_their_plans(spark, sf_dir):
    for df in (url_rules.op7_url_rules(spark, sf_dir), decontaminate.op8_decontaminate(spark, sf_dir)):
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


def test_lines_of_all_queries_exist(spark, sf_dir):
    assert line_dedup.op6_line_dedup(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() == toxicity.op5_toxicity(spark, sf_dir).count()
