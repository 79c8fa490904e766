"""The pipeline's stages, each against what it should do to its own input."""

import random

import pytest

import corpus_pipeline
from quern.llm.line_dedup import units
from quern.llm.packing import document_ids
from quern.llm.simhash import keep_one

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ba", "de", "fi", "go", "hu") for c in ("n", "r", "st", "l")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    texts = {i: ". ".join(prose(rng, rng.randint(6, 14)).capitalize() for _ in range(12)) + "." for i in range(300)}
    bench = [". ".join(prose(rng, 8).capitalize() for _ in range(5)) for _ in range(10)]
    passage = ". ".join(prose(rng, 9).capitalize() for _ in range(8)) + "."
    toxic = list(range(0, 60))
    for i in toxic:
        for _ in range(4):
            texts[i] += " You " + rng.choice(["vilemoron", "vilescum"]) + "."
    copies, near, leaked, pasted = {100: 200, 101: 201}, {110: 210, 111: 211, 112: 212}, [120, 121], [130, 131, 132]
    for a, b in copies.items():
        texts[b] = texts[a]
    for a, b in near.items():
        words = texts[a].split()
        for k in rng.sample(range(len(words)), 2):
            words[k] = rng.choice(WORDS)
        texts[b] = " ".join(words)
    for i in leaked:
        texts[i] += "\n" + rng.choice(bench)
    for i in pasted:
        texts[i] = texts[i][:300] + "\n" + passage + "\n" + texts[i][300:]
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, dict(toxic=toxic, copies=copies, near=near, leaked=leaked, pasted=pasted, passage=passage)


def test_stages(spark, corpus, tmp_path):
    folder, texts, planted = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.dtypes == [tuple(x.split()[::1]) for x in ("doc_id bigint", "text string", "lang string", "source string", "n_chars bigint")]
    ids = {name: {r.doc_id for r in df.select("doc_id").distinct().collect()} for name, df in seen.items()}
    everything = set(texts) | {900, 901}
    assert everything - ids["toxicity"] == set(planted["toxic"])
    gone = set(planted["copies"].values()) | set(planted["near"].values()) | {901}  # the empty text is a copy of the null one
    assert ids["toxicity"] - ids["near_dedup"] == gone
    assert ids["substring_dedup"] == ids["near_dedup"]
    cut = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    first, *others = planted["pasted"]
    assert cut[first].text == texts[first] and all(planted["passage"][60:400] not in cut[i].text and len(cut[i].text) == cut[i].n_chars for i in others)
    for i in ids["substring_dedup"] - set(planted["pasted"]) - {900}:
        assert cut[i].text == texts[i]
    digests = [u for r in cut.values() for _, _, u in units(r.text or "")]
    assert len(digests) == len(set(digests))
    assert ids["substring_dedup"] - ids["decontamination"] == set(planted["leaked"])
    packed = seen["packing"].groupBy("doc_id").sum("length").collect()
    kept = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    assert {r.doc_id: r[1] for r in packed} == {i: len(document_ids(t or "")) for i, t in kept.items()}


def test_run_gives_the_last_stage(spark, corpus):
    folder, _, planted = corpus
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert not got & {*planted["toxic"], *planted["copies"].values(), *planted["near"].values(), *planted["leaked"]}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_one_of_a_group_stays(spark):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (None, "a b c d e f", 4), (None, "other words of its own here", 5), (7, None, 6), (8, "", 7), (9, "x", 8)]
    out = keep_one(spark.createDataFrame(rows, "doc_id long, text string, node int"))
    assert out.columns == ["doc_id", "text", "node"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "other words of its own here"), (7, None), (9, "x")], key=str)


def test_stages_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def words_of(texts):
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}


def test_near_dedup_finds_lone_pairs_and_drops_nothing_unlike(spark):
    rng = random.Random(6)
    texts, share, n = {}, {}, 0
    for kind in ("block", "end", "scattered"):
        for _ in range(120):
            a = prose(rng, 300).split()
            b, k = list(a), rng.randint(5, 45)
            if kind == "block":
                at = rng.randrange(len(b) - k)
                b[at : at + k] = prose(rng, k).split()
            elif kind == "end":
                b += prose(rng, 2 * k).split()
            else:
                for i in rng.sample(range(len(b)), max(1, k // 5)):
                    b[i] = rng.choice(WORDS)
            texts[n], texts[n + 1], share[n + 1] = " ".join(a), " ".join(b), kind
            n += 2
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = words_of(texts)
    alike = {i: len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in share}
    assert not [i for i, j in alike.items() if j < 0.8 and (i not in kept or i - 1 not in kept)]
    for kind in ("block", "end", "scattered"):
        pairs = [i for i, j in alike.items() if j >= 0.8 and share[i] == kind]
        assert len(pairs) > 40 and sum(i not in kept for i in pairs) >= 0.9 * len(pairs), kind


def test_a_large_group_of_near_copies_leaves_its_text(spark):
    rng = random.Random(7)
    base = prose(rng, 400).split()
    texts = {5000: " ".join(base)}
    for i in range(3000):
        b = list(base)
        for k in rng.sample(range(400), rng.randint(1, 7)):
            b[k] = rng.choice(WORDS) + str(i)
        texts[i] = " ".join(b)
    sets = words_of(texts)
    kept = [r.doc_id for r in keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    near = [i for i in texts if len(sets[i] & sets[5000]) / len(sets[i] | sets[5000]) >= 0.8]
    assert len(near) > 2900 and len(set(near) & set(kept)) <= 0.02 * len(near), len(set(near) & set(kept))
    stay = [sets[i] for i in kept]
    assert all(any(len(sets[i] & x) >= 0.8 * len(sets[i] | x) for x in stay) for i in texts if i not in kept)


def test_near_dedup_leaves_no_pair_alike(spark):
    rng = random.Random(11)
    texts = {}
    for n in range(0, 600, 2):  # lone pairs, half of them barely over 0.8
        a = prose(rng, 300).split()
        b, k = list(a), rng.randint(22, 40)
        at = rng.randrange(len(b) - k)
        b[at : at + k] = prose(rng, k).split()
        texts[n], texts[n + 1] = " ".join(a), " ".join(b)
    base = prose(rng, 300).split()
    for n in range(600, 900):  # a loose group, in which few are like many
        b = list(base)
        for k in rng.sample(range(300), rng.randint(2, 7)):
            b[k] = rng.choice(WORDS)
        texts[n] = " ".join(b)
    sets = words_of(texts)
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    like = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    near = [(i, j) for i in texts for j in texts if i < j and (j == i + 1 if i < 600 else True) and like(i, j)]
    assert sum(i < 600 for i, _ in near) > 100 and len(near) > 1000
    assert not [(i, j) for i, j in near if i in kept and j in kept]
    assert all(any(like(i, j) for j in kept) for i in texts if i not in kept)
