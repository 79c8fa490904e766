"""SimHash near-duplicates against comparing all pairs."""

import numpy as np
import pytest

from quern.llm import simhash
from quern.llm.simhash import Linking, fingerprint, near_duplicates, trie_join

np_zero = np.zeros(1, dtype=np.int64)


def clustered(n: int, flips: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, 60, dtype=np.uint64)[rng.integers(0, 60, n)]
    for _ in range(flips):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return values


def brute(fps, second, radius, confirm=None) -> list[int]:
    """Smallest index that each can reach."""
    least = list(range(len(fps)))
    a = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    if confirm is not None:
        b = np.array(second, dtype=np.uint64)
        near &= (np.bitwise_count(b[:, None] ^ b[None, :]) <= confirm) | (a[:, None] == a[None, :]) & (b[:, None] == b[None, :])
    while True:
        new = [min(least[j] for j in np.flatnonzero(near[i])) for i in range(len(a))]
        if new == least:
            return least
        least = new


@pytest.mark.parametrize("same", [True, False])
def test_trie_join_finds_all_pairs(same):
    a = np.sort(clustered(900, 3))
    b = a if same else np.sort(clustered(500, 3, 1))
    got = set()
    for i, j in trie_join(a, b, [np_zero, np_zero + len(a), np_zero, np_zero + len(b)], np_zero, np_zero, 3, same):
        got |= set(zip(i.tolist(), j.tolist()))
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if not same or i < j}


@pytest.mark.parametrize("how", [Linking(), Linking(cell=4), Linking(radius=9, blocks=5), Linking(radius=9, blocks=5, cell=3), Linking(radius=7, blocks=4, confirm=12, cell=8)])
def test_links_reach_what_all_pairs_reach(spark, how):
    fps, second = clustered(400, 3), clustered(400, 6, 5)
    second = second & np.uint64(0x3FF)
    rows = [(int(i), int(x), int(y)) for i, (x, y) in enumerate(zip(fps.view(np.int64), second.view(np.int64)))]
    df = spark.createDataFrame(rows, "doc_id long, fp long, fp2 long").selectExpr("fp", "fp2", "xxhash64(fp, fp2) as node", "doc_id")
    nodes = df.groupBy("fp", "fp2", "node").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "least")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, how)).collect()}
    ids = [r.node for r in df.orderBy("doc_id").collect()]
    expected = brute(fps, second, how.radius, how.confirm)
    groups = {}
    for i, e in enumerate(expected):
        groups.setdefault(found.get(ids[i], ids[i]), set()).add(e)
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(expected))


def test_fingerprint_is_a_majority_of_shingle_bits():
    import xxhash

    assert fingerprint(b"") == 0 and fingerprint(b" \n\t") == 0
    assert fingerprint(b"One  TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c a", b"c a b", b"a b c")]
    assert fingerprint(b"a b\tc A b\x0bC") == sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > 4)


def test_whole_query_and_its_edges(spark):
    rows = [(5, "x y z"), (3, "x y z"), (None, "x y z"), (9, None), (8, ""), (7, "p q r s t"), (7, "p q r s t"), (None, "lone words only here")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, node int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (7, 7), (None, None)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_long_texts_are_read_in_parts():
    text = b"word%d " * 400_000 % tuple(i % 9973 for i in range(400_000))
    assert fingerprint(text) == fingerprint(b"  " + text.upper())


@pytest.mark.parametrize("held", [5, 1 << 18])
def test_components_whatever_a_run_holds(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "EDGES", held)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, 300 + i) for i in range(40)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}  # a node without another is left out
    assert sorted((r.node, r.root) for r in found) == sorted((x, y) for x, y in least.items() if x not in alone)
    assert spark.range(0).selectExpr("id a", "id b").transform(simhash.components).count() == 0


def test_prefixes_are_a_fifth_of_a_set_and_sets_alike_share_one():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 37, 400):
        pool = rng.permutation(np.arange(1, 4 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        often = np.sort(pool[: 2 * n])
        known = often, rng.integers(2, 9, 2 * n)
        for _ in range(50):
            a = pool[:n]
            gone = rng.integers(0, n // 9 + 1)  # as many go as come
            b = np.r_[a[gone:], pool[n : n + gone]]
            a, b = np.sort(a), np.sort(b)
            x, y = (simhash.prefix(z, known, 0.8) for z in (a, b))
            assert len(x) <= 0.2 * n + 1
            if (n - gone) * 10 >= 8 * (n + gone):
                assert np.intersect1d(x, y).size
            pool = rng.permutation(pool)
    assert not simhash.prefix(pool[:0], known, 0.8).size


@pytest.mark.parametrize("n", [400])
def test_near_dedup_proposes_no_more_than_leaders_of_each_node(spark, monkeypatch, n):
    """A large group of copies that are alike: what is made of it grows with its rows, not their square."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = [[f"own{i}-{k}" if k in put else w for k, w in enumerate(base)] for i, put in enumerate(set(rng.choice(150, 1, replace=False).tolist()) for _ in range(n))]
    seen, proposed = [], simhash._proposed

    def counted(rows, share):
        made = simhash.written(proposed(rows, share))
        seen.append((rows.count(), made.count()))
        return made

    monkeypatch.setattr(simhash, "_proposed", counted)
    kept = simhash.keep_one(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).count()
    assert kept < n and sum(pairs for _, pairs in seen) <= 8 * n, seen


def test_bits_tell_unlike_sets_and_no_sets_alike():
    rng = np.random.default_rng(6)
    told = 0
    for _ in range(300):
        n = int(rng.integers(1, 900))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        gone, come = rng.integers(0, n // 8 + 1, 2)
        a, b, far = np.unique(pool[:n]), np.unique(pool[gone : n + come]), np.unique(pool[n:])
        for x, y in ((a, b), (a, far)):
            can = simhash._can_be_alike(simhash._bits(simhash._odd(x)), simhash._bits(simhash._odd(y)), 0.8)
            both = len(np.intersect1d(x, y))
            alike = both / (len(x) + len(y) - both) >= 0.8
            assert simhash._are_alike(x, y, 0.8) == alike and can >= alike
            told += not can
    assert told > 250


def test_dealt_shingles_come_back_and_only_rows_in_company_stay():
    rng = np.random.default_rng(7)
    n = 3000
    token, node = rng.integers(0, 900, n), np.sort(rng.integers(0, 1 << 40, n))
    token[:100] = 7
    size = rng.integers(1, 60, n)
    pos = rng.integers(0, size)
    back = simhash._read_small(simhash._written_small(token.astype(np.uint64), node, pos, size))
    assert all((x == y).all() for x, y in zip(back, (token, node, pos, size)))
    want = set(np.flatnonzero(token == 7).tolist())  # more than BUCKET
    for i in range(n):
        for j in np.flatnonzero(token == token[i]).tolist():
            need = 0.8 / 1.8 * (size[i] + size[j]) - 1e-9
            if i != j and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-9 and min(size[i] - pos[i], size[j] - pos[j]) >= need:
                want.add(i)
    assert set(simhash._in_company(*back, 0.8).tolist()) == want


def test_near_dedup_shuffles_less_than_four_times_its_texts(spark):
    """Of unlike texts with a passage in common, that meet in prefixes as no order by rarity is known."""
    rng = np.random.default_rng(9)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ba", "de", "fi", "go", "hu", "ra", "se", "ti", "vo", "zu")]
    prose = lambda n: " ".join(rng.choice(words, n).tolist())
    passages = [prose(200) for _ in range(12)]
    texts = [f"{prose(300)} {passages[i % 12]}" for i in range(480)]
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = shuffled()
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), simhash.Similar(sample=1)).count()
    assert kept == len(texts)
    assert shuffled() - before < 4 * sum(map(len, texts)), (shuffled() - before) / sum(map(len, texts))
