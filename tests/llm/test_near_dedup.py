import random

import numpy as np
import pytest

from corpusloom.llm.near_dedup import DEPTH, HASHES, TREES, exact_links, families, forest, forest_labels, near_dedup
from corpusloom.llm.shingles import jaccard_at_least, shingle_sets
from corpusloom.sources.storage import Scratch


def words(text):
    return (text or "").encode().lower().split()


def brute_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: brute_set(t, k) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n_groups=12, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for g in range(n_groups):
        base = rng.choices(vocabulary, k=rng.choice([4, 12, 60, 150]))
        for _ in range(copies if g else 5 * copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            i += 1
            rows.append((i * 7 % 1009, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \t"), (2003, "One two"), (2004, "one  TWO"), (2005, "one"), (2006, "ÉA b c"), (2007, "éa b c")]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, k, num, den):
    rows = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def components_by_products(rows, k, num, den):
    """Brute force for many texts: all intersections at once."""
    sets = [brute_set(t, k) for _, t in rows]
    number = {x: i for i, x in enumerate(set().union(*sets))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    label = np.array([i for i, _ in rows])
    while True:
        least = np.where(linked, label[None, :], label.max() + 1).min(axis=1)
        if (least == label).all():
            return {i: int(x) for (i, _), x in zip(rows, label)}
        label = least


def test_large_families(spark, monkeypatch):
    """Families many blocks large: copies of one text that only it links, texts that drift, and pairs on both sides of the threshold."""
    monkeypatch.setattr("corpusloom.llm.near_dedup.BLOCK", 32)
    monkeypatch.setattr("corpusloom.llm.near_dedup.PIVOTS", 4)
    monkeypatch.setattr("corpusloom.llm.near_dedup.WINDOW", 4)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(9000)]
    rows = []
    for number, shape in enumerate(["star", "chain", "near the threshold"]):
        base = rng.choices(vocabulary, k=200)
        w = list(base)
        for i in range(500):
            if shape != "chain":
                w = list(base)
            for at in rng.sample(range(0, 200, 3), {"star": 5, "chain": 1, "near the threshold": 3 + i % 5}[shape] if i else 0):
                w[at] = rng.choice(vocabulary)
            rows.append((number * 1000 + i * 7 % 503, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_products(rows, 3, 85, 100)


def test_mates_apart_in_all_orders(spark, monkeypatch):
    """Against brute force: mates that agree in most values, but in no order beyond a prefix that all texts share."""
    monkeypatch.setattr("corpusloom.llm.near_dedup.BLOCK", 16)
    monkeypatch.setattr("corpusloom.llm.near_dedup.WINDOW", 4)
    rng = np.random.default_rng(4)
    signatures = rng.integers(0, 256, (80, HASHES)).astype(np.uint64)
    signatures[1::2] = signatures[::2]
    for t in range(TREES):
        at = DEPTH * t
        if t % 2:
            signatures[1::2, at] = (signatures[1::2, at] + 1) % 256
        else:
            signatures[:, at : at + DEPTH] = t
    low = signatures.astype(np.uint8)
    rows = [(i, 100, bytearray(low[i].tobytes()), forest_labels(signatures[i : i + 1])[0].tolist()) for i in range(80)]
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, bytes binary, labels array<long>")
    tables = Scratch(spark, "test")
    found = {r.node: r.family for r in families(forest(nodes, tables), 85, 100, tables).collect()}
    assert found == {i: i - i % 2 for i in range(80)}


def test_edges(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(3, text, 1), (3, text, 1), (None, text, 1), (1, text, 1)], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup(df).collect())
    assert got == [(-1, None, True), (1, 1, True), (3, 1, False), (3, 1, False)]
    assert near_dedup(df.where("false")).count() == 0


def test_shingles_and_links():
    texts = ["A b\tc d", "x", "", None, "a " * 5000, "q w e r t y u i o p"]
    for k in (1, 3, 5):
        assert [len(s) for s in shingle_sets(texts, k)] == [len(brute_set(t, k)) for t in texts]
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    linked, _ = exact_links(sets, 1, 2)
    up = list(range(40))
    for a, b in linked:
        assert jaccard_at_least(sets[a], sets[b], 1, 2)
        up = [up[a] if x == up[b] else x for x in up]
    assert all(up[a] == up[b] for a in range(40) for b in range(a) if jaccard_at_least(sets[a], sets[b], 1, 2))
