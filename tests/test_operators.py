"""Small fixtures with known answers for the library's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import matching as T
from corpusloom.functions import measures as M
from corpusloom.operators import classify, divergence, edges, extraction, graphs, lexical, sampling, tables
from corpusloom.operators.components import connected_components


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fractional_weights(spark):
    data = [("a", 1, "astrophysics"), ("a", 2, "astrophysics"), ("a", 3, "high-energy"), ("b", 1, "high-energy")]
    got = {(r.key, r.cls): r.weight for r in classify.fractional_weights(spark.createDataFrame(data, "key string, pos int, cls string")).collect()}
    assert got["a", "astrophysics"] == pytest.approx(2 / 3)
    assert sum(w for (k, _), w in got.items() if k == "a") == pytest.approx(1)


def test_distances_of_equal_and_different_counts(spark):
    data = [(y, f, x) for y, f, x in [(1, "p", "u"), (1, "q", "u"), (2, "p", "u"), (2, "q", "v"), (3, "p", "u")]]
    m = spark.createDataFrame(data, "year int, field string, family string").withColumn("key", F.monotonically_increasing_id())
    got = {r.year: r for r in divergence.distances(divergence.field_shares(m, ("p", "q"), ["year"]), ["year"]).collect()}
    assert got[1].jsd == pytest.approx(0) and got[1].tv == pytest.approx(0) and got[1].cosine == pytest.approx(0)
    assert got[2].jsd == pytest.approx(1) and got[2].tv == pytest.approx(1) and got[2].cosine == pytest.approx(1)
    assert got[3].jsd is None and got[3].cosine is None


def test_top_families_breaks_ties_by_name(spark):
    data = [(i, y, f, x) for i, (y, f, x) in enumerate([(1995, "p", "A"), (1995, "p", "B"), (1995, "q", "B"), (1995, "q", "C"), (2016, "p", "A"), (2016, "p", "B"), (2016, "q", "B"), (2016, "q", "C")])]
    m = spark.createDataFrame(data, "key int, year int, field string, family string")
    assert rows(divergence.top_families(m, 1, ("p", "q")), "family") == [("A",), ("B",)]
    assert divergence.top_families(m, 99, ("p", "q")).count() == 3


def test_wilson_brackets_the_share(spark):
    low, high = M.wilson(F.lit(90), F.lit(100))
    r = spark.range(1).select(low.alias("low"), high.alias("high"), M.wilson(F.lit(0), F.lit(0))[0].alias("none")).first()
    assert r.low < 0.9 < r.high and r.none is None


def test_prominence_by_hand(spark):
    papers = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "p"), ("d", "q")], "key string, field string")
    mentions = spark.createDataFrame([("a", "p", "w"), ("b", "q", "w"), ("d", "q", "w")], "key string, field string, family string")
    r = edges.prominence(mentions, papers, ("p", "q"), []).first()
    assert (r.n_a, r.n_b) == (1, 2)
    assert r.log2_ratio == pytest.approx(math.log2((2.5 / 3) / (1.5 / 3)))


def test_average_rank_share(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int").withColumn("g", F.lit(0))
    got = [r.s for r in df.select("x", tables.average_rank_share(F.col("x"), ["g"]).alias("s")).orderBy("x").collect()]
    assert got == [0.25, 0.625, 0.625, 1.0]


def test_not_among_keeps_nulls(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "t string")
    assert df.where(M.not_among(F.col("t"), ["x"])).count() == 2


def test_bootstrap_and_rarefaction_are_reproducible_and_bounded(spark):
    rng = np.random.default_rng(1)
    data = [(i, 2000 + i % 2, "pq"[i % 3 == 0], f"f{rng.integers(4)}") for i in range(120)]
    m = spark.createDataFrame(data, "key int, year int, field string, family string")
    first = divergence.bootstrap(m, ("p", "q"), 50).toPandas().sort_values(["year", "b"]).reset_index(drop=True)
    again = divergence.bootstrap(m.repartition(7), ("p", "q"), 50).toPandas().sort_values(["year", "b"]).reset_index(drop=True)
    assert first.equals(again) and first["jsd"].between(0, 1).all()
    assert divergence.rarefied(m, ("p", "q"), 20, permute=True).toPandas()["jsd"].between(0, 1).all()


def test_allocation_keeps_the_total_and_the_caps():
    got = sampling.allocate({"a": 100, "b": 10, "c": 1}, 20, 2)
    assert sum(got.values()) == 20 and got["c"] == 1 and got["b"] >= 2


def test_set_scores(spark):
    df = spark.createDataFrame([(["x", "y"], ["x", "z"]), (["x"], []), ([], [])], "gold array<string>, pred array<string>")
    r = sampling.set_scores(df, "gold", "pred", []).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 2) and r.recall == pytest.approx(1 / 3)


def test_sentences_keep_decimals_and_abbreviations():
    text = "We find 0.5 here, e.g. Fig. 2 of it. Another one, e.g. this!  "
    got = T.sentences(text)
    assert len(got) == 2 and all(text[a:b] == s for a, b, s in got)
    assert T.sentences(None) == T.sentences("  ") == []
    parts = lambda t: [s for *_, s in T.sentences(t)]
    assert parts("Dr. Smith saw it.  Prof. Lee\ndid not!? See ref. 3") == ["Dr. Smith saw it.", "Prof. Lee\ndid not!?", "See ref.", "3"]
    assert parts("Cf. this, et al. and that vs. ours. ") == ["Cf.", "this, et al. and that vs. ours."]
    text = " A b.  C d. "
    assert [(text[a:b], s) for a, b, s in T.sentences(text)] == [("A b.", "A b."), ("C d.", "C d.")]


def test_tagger_first_match_decides():
    tagger = T.Tagger({"ball": [r"\bglueballs?\b"], "x": [r"\bx\b"]}, r"dark matter", {"ball"}, 20)
    assert tagger.find("x and a glueball of dark matter") == [("x", (0, 1)), ("ball", (8, 16))]
    assert tagger.find("a glueball far away from everything else; a glueball of dark matter") == []


def test_entities_longest_first_without_overlap():
    make = lambda i, n, c=False: T.Entity(i, i, "t", (T.Alias.of({"text": n, "case_sensitive": c}),))
    matcher = T.EntityMatcher([make("t:short", "rotation"), make("t:long", "rotation curves"), make("t:lux", "LUX", True)])
    found = [(e.id, s) for e, _, s in matcher.find("flat rotation  curves, flux and LUX")]
    assert found == [("t:long", (5, 21)), ("t:lux", (32, 35))]


def test_case_rule():
    rule = T.CaseRule("idm", {"iDM": "inelastic", "IDM": "doublet"}, {"inert doublet": "doublet", "inelastic dark matter": "inelastic"})
    assert rule.keeps("inelastic", "iDM here", (0, 3)) and not rule.keeps("doublet", "iDM here", (0, 3))
    assert rule.keeps("doublet", "idm of an inert doublet", (0, 3)) and not rule.keeps("doublet", "idm alone", (0, 3))


def test_normaliser():
    n = T.Normaliser({"–": "-"}, [(r"<[^>]+>", " ")], {"DM": "dark matter"}, ["dark matter"])
    assert n("dark matter (DM) – <b>x</b> &amp; DM") == "dark matter - x & dark matter"
    assert T.fold_phrases("Dark matter (x) dark matter halo", [(r"dark matter", "dark-matter")]) == "dark-matter halo"


def test_entity_files(tmp_path):
    (tmp_path / "a.json").write_text('{"include": ["b.json"], "entities": [{"id": "t:a", "label": "a", "type": "t", "aliases": [{"text": "abcd"}]}]}')
    (tmp_path / "b.json").write_text('{"entities": [{"id": "u:b", "label": "b", "type": "u", "aliases": [{"text": "abcd"}, {"text": "xy"}]}]}')
    found = T.load_entities(tmp_path / "a.json")
    assert [e.id for e in found] == ["u:b", "t:a"] and len(T.entity_problems(found)) == 2
    assert [e.id for e in T.load_entities(tmp_path / "a.json", frozenset({"u"}))] == ["t:a"]
    (tmp_path / "b.json").write_text('{"include": ["a.json"]}')
    with pytest.raises(ValueError):
        T.load_entities(tmp_path / "a.json")


def _lexicon():
    return T.Lexicon(
        tags={"wimp": [r"\bwimps?\b"], "pbh": [r"\bprimordial black holes?\b"]},
        labels={"wimp": "Generic WIMP", "pbh": "PBH"},
        entities=[
            T.Entity("o:curves", "rotation curves", "observable", (T.Alias.of({"text": "rotation curves"}),)),
            T.Entity("o:hole", "black hole", "object", (T.Alias.of({"text": "black holes"}),)),
        ],
        relations=[T.Relation("explains", (r"\bexplain\w*\b",), frozenset({"observable"}))],
    )


def test_extraction(spark):
    texts = [(1, "WIMPs explain flat galaxy rotation curves."), (2, "WIMPs are here. Rotation curves are flat."), (3, "WIMPs do not explain rotation curves."), (4, "Primordial black holes are candidates."), (5, None)]
    found = extraction.matches(spark.createDataFrame(texts, "doc long, text string"), _lexicon()).cache()
    got = extraction.events(found)
    assert rows(got["cooccurrence_events"], "doc") == [(1,), (3,)]
    assert rows(got["abstract_cooccurrence_events"], "doc", "distance", "same_sentence") == [(1, 0, True), (2, 1, False), (3, 0, True)]
    assert rows(got["relation_events"], "doc", "negated", "confidence") == [(1, False, "high"), (3, True, "high")]
    assert got["occurrences"].where("doc = 4").count() == 1


def test_pairs_and_association(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "a")], "doc int, item string")
    got = {(r.source, r.target): r for r in edges.association_edges(items, [], 1).collect()}
    assert got["a", "b"].n_xy == 2 and got["a", "b"].weight == pytest.approx(1 / 3 + 1)
    assert got["a", "b"].jaccard == pytest.approx(2 / 3) and got["a", "c"].npmi == pytest.approx(math.log(1.0) / -math.log(1 / 3))


def _brute_betweenness(graph, sources, targets):
    def paths(a, b):
        best, found, todo = math.inf, [], [(0.0, [a])]
        while todo:
            d, p = todo.pop()
            if d > best + 1e-12:
                continue
            if p[-1] == b:
                if d < best - 1e-12:
                    best, found = d, []
                found.append(p)
                continue
            todo += [(d + w, [*p, y]) for y, w in graph[p[-1]].items() if y not in p]
        return [p for p in found if abs(sum(graph[x][y] for x, y in zip(p, p[1:])) - best) < 1e-12]

    score = dict.fromkeys(graph, 0.0)
    for s in sources:
        for t in targets:
            if s != t:
                all_paths = paths(s, t)
                for p in all_paths:
                    for x in p[1:-1]:
                        score[x] += 1 / len(all_paths)
    n = len(graph)
    return {x: v / ((n - 1) * (n - 2)) for x, v in score.items()}


def test_betweenness_against_all_paths():
    rng = np.random.default_rng(3)
    names = list("abcdefg")
    for _ in range(10):
        es = [(x, y, float(rng.integers(1, 4))) for i, x in enumerate(names) for y in names[i + 1 :] if rng.random() < 0.6]
        g = graphs.adjacency(es)
        s, t = sorted(g)[:2], sorted(g)[-2:]
        got, want = graphs.betweenness_between(g, s, t)[0], _brute_betweenness(g, s, t)
        assert all(got[x] == pytest.approx(want[x]) for x in g)


def test_efficiency_and_removal():
    g = graphs.adjacency([("a1", "m", 0.1), ("a2", "m", 0.2), ("m", "h1", 0.3), ("m", "h2", 0.4)])
    want = (1 / 0.4 + 1 / 0.5 + 1 / 0.5 + 1 / 0.6) / 4
    assert graphs.efficiency(g, ["a1", "a2"], ["h1", "h2"])[0] == pytest.approx(want)
    assert graphs.efficiency(g, ["a2", "a1"], ["h2", "h1"])[0] == pytest.approx(want)
    assert graphs.removal_loss(g, ["a1", "a2"], ["h1", "h2"], "m") == pytest.approx(1)
    # Ends that aren't in the graph don't count, a node with itself does, and no pair at all is no number.
    assert graphs.efficiency(g, ["a1", "absent"], ["h1"]) == (pytest.approx(1 / 0.4), 1.0)
    assert graphs.efficiency(g, ["a1", "m"], ["m"]) == (pytest.approx(1 / 0.1 / 2), 0.5)
    assert np.isnan(graphs.efficiency(g, ["absent"], ["h1"])[0]) and np.isnan(graphs.removal_loss(g, ["absent"], ["h1"], "m"))


def test_cores_and_spectra():
    g = graphs.adjacency([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)])
    assert graphs.core_numbers(g) == {"a": 2, "b": 2, "c": 2, "d": 1}
    left, right = graphs.spectral_scores(["x", "y"], ["u"], np.array([[3.0], [4.0]]))
    assert left == pytest.approx({"x": 0.75, "y": 1.0}) and right == {"u": 1.0}
    assert max(graphs.eigenvector_centrality(g), key=graphs.eigenvector_centrality(g).get) == "c"


def test_removal_effects_match_the_single_graph(spark):
    es = [("w", "a", "m", 1.0), ("w", "m", "h", 1.0), ("w", "a", "n", 2.0), ("w", "n", "h", 2.0)]
    df = spark.createDataFrame(es, "win string, source string, target string, distance double")
    g = graphs.adjacency([e[1:] for e in es])
    got = {r.node: r.loss for r in graphs.removal_effects(df, ["win"], "distance", ["a"], ["h"]).collect()}
    assert got == {n: pytest.approx(graphs.removal_loss(g, ["a"], ["h"], n)) for n in ("m", "n")}
    only = spark.createDataFrame([("w", "n"), ("w", "a")], "win string, node string")
    assert [r.node for r in graphs.removal_effects(df, ["win"], "distance", ["a"], ["h"], only).collect()] == ["n"]


def test_loess_recovers_a_line():
    x = np.arange(10.0)
    assert lexical.loess_ends(x, 2 * x + 1) == pytest.approx((1.0, 19.0))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 40)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[500 + i] == 500 for i in range(40)) and got[7] == 7 and 3 not in got
    assert connected_components(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """A path with its least node at the far end is done in tens of rounds."""
    rounds = []
    from corpusloom.operators import components

    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, *rest: rounds.append(1) or real(df, *rest))
    nodes = [*range(2, 4097), 1]
    got = connected_components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "src long, dst long")).collect()
    assert {r.component for r in got} == {1} and len(got) == 4096
    assert len(rounds) < 2 + 2 * 30


def test_blank_values_in_lists(spark):
    from corpusloom.functions.measures import first_nonblank
    from corpusloom.operators.sampling import split_labels

    df = spark.createDataFrame([([" ", None, " x ", "y"], " a ;; b;  ")], "values array<string>, labels string")
    row = df.select(first_nonblank(F.col("values")).alias("first"), split_labels(F.col("labels")).alias("labels")).first()
    assert row["first"] == "x" and row["labels"] == ["a", "b"]
