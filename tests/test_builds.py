import pytest
from pyspark.sql import functions as F

from corpusloom.functions.matching import Alias, Entity, Lexicon, Relation
from corpusloom.operators import roles, tables
from corpusloom.plans import builds


def test_network(spark):
    lexicon = Lexicon(
        tags={"wimp": [r"\bwimps?\b"]}, entities=[Entity("o:c", "curves", "observable", (Alias.of({"text": "rotation curves"}),)), Entity("o:h", "halo", "object", (Alias.of({"text": "halo"}),))],
        relations=[Relation("explains", (r"\bexplain\w*\b",), frozenset({"observable"}))],
    )
    rows = [(1, 1999, "WIMPs explain flat rotation curves."), (2, 2001, "WIMPs explain rotation curves of a halo."), (3, 2001, "A halo. WIMPs."), (4, 2001, None)]
    papers = spark.createDataFrame(rows, "doc long, year int, text string")
    got = builds.build_network(papers, lexicon, builds.NetworkParameters(((1990, 2000, "old"), (2001, 2010, "new")), 1, 1))
    edges = {(r.period, r.source, r.target): r for r in got["abstract_edges"].collect()}
    assert edges["all", "candidate:wimp", "o:c"].n_xy == 2 and edges["new", "candidate:wimp", "o:h"].n_xy == 2 and ("old", "candidate:wimp", "o:h") not in edges
    assert edges["all", "candidate:wimp", "o:h"].same_sentence_share == pytest.approx(0.5) and edges["all", "candidate:wimp", "o:h"].weight == pytest.approx(1.5)
    assert {(r.period, r.n_docs) for r in got["relation_edges"].collect()} == {("all", 2), ("old", 1), ("new", 1)}
    assert got["bridges"].where("period = 'all'").first().n_domains == 2
    assert got["nodes"].where("period = 'all' and item = 'candidate:wimp'").first().n == 3
    assert got["sentence_edges"].count() and got["pattern_frequency"].count()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, 2000 + i // 2 % 4, "pq"[i % 2], f"f{j}") for i in range(80) for j in range(6) if (i * (j + 2) + j) % (3 + (i % 2) * (j % 3)) == 0]
    return spark.createDataFrame(rows, "key int, year int, field string, family string").cache()


def test_all(spark, corpus):
    papers = corpus.select("key", "year", "field").distinct().withColumn("doctype", F.lit(None).cast("string"))
    classes = corpus.select("key", F.lit(1).alias("pos"), F.col("field").alias("cls")).distinct()
    p = builds.AnalysisParameters(("p", "q"), (2000, 2001), (2002, 2003), 3, 30, 10, ks=(1, 3, 9), generic="f0")
    got = builds.build_all(papers, classes, corpus, p)
    assert len(got) == 17
    for name, table in got.items():
        assert table.count() > 0, name
    one = got["divergence_contrast_interval"].first()
    assert one.low <= one.high and one.claim in ("supported", "not supported")
    assert {r.doctype for r in got["document_flow"].collect()} == {"missing"}


def test_role_graphs(spark, corpus):
    papers = corpus.select("key", "year", "field").distinct()
    items = corpus.select(F.col("key").alias("doc"), "year", "field", F.col("family").alias("item"))
    windows = tables.year_windows(2000, 2003, [(2000, 2001)], 3)
    got = builds.build_role_graphs(papers, corpus, items, ("p", "q"), windows, {"plain": {}, "joined": {"g": ["f0", "f1"]}}, 1, 50)
    prominence = got["prominence"].toPandas()
    assert set(prominence["definition"]) == {"plain", "joined"} and (prominence["log2_low"] <= prominence["log2_high"]).all()
    assert "g" in set(prominence[prominence["definition"] == "joined"]["family"]) and "f0" not in set(prominence[prominence["definition"] == "joined"]["family"])
    for name in ("brokerage", "brokerage_common_ends"):
        table = got[name].toPandas()
        # Without a pair of ends in the graph there is no efficiency to lose.
        assert (table["loss"].isna() == ~(table["efficiency"] > 0)).all() and (table["loss"].dropna() >= 0).all() and (table["betweenness"] >= 0).all()
    assert got["brokerage"].count() and got["anchors"].groupBy("definition", "window", "side").count().count() == 2 * len(windows) * 2
    assert got["prominence_nodes"].where("kind = 'field'").count() == 2 * len(windows) * 2
    assert got["importance_edges"].count() and got["participation"].count()


def test_membership_and_scale(spark):
    classes = spark.createDataFrame([("a", 1, "astro-ph.CO"), ("a", 2, "hep-ph"), ("b", 1, "x.y")], "key string, pos int, cls string")
    papers = spark.createDataFrame([("a", 2000), ("b", 2001)], "key string, year int")
    got = {r.key: (r.primary_field, r.crosslisted) for r in roles.field_membership(classes, papers, {"astro-ph": "A", "hep-ph": "H"}, "A", "H").collect()}
    assert got == {"a": ("A", True), "b": ("other", False)}
    df = spark.createDataFrame([(1.0, True), (4.0, True), (8.0, False)], "v double, r boolean")
    assert sorted(r.scaled for r in roles.on_common_scale(df, "v", F.col("r")).collect()) == [0.25, 1.0, 1.0]
