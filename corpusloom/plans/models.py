"""Queries of dictionary matching, resampling, graph measures and local regression, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.matching import Alias, Entity, Lexicon, Normaliser, Relation
from corpusloom.operators import divergence, edges, extraction, graphs, lexical, tables
from corpusloom.plans.catalog import _WINDOW_ROWS, BASKET, FIELDS, MENTIONS, TWO, WINDOWS, baskets, mentions, query, rounded, table
from corpusloom.sources.storage import materialize

EARLY, LATE = (1995, 1997), (1999, 2001)


def sample_lexicon() -> Lexicon:
    """Vocabulary for the invented prose of the documents; real vocabularies are loaded from files."""
    words = {"the": "Article", "and": "And", "und": "And", "les": "Article", "worthless": "Insult", "loser": "Insult"}
    aliases = lambda *names: tuple(Alias.of({"text": n}) for n in names)
    return Lexicon(
        tags={w: [rf"\b{w}\b"] for w in words},
        labels=words,
        context=r"\b(?:of|in|der|de)\b",
        needs_context=frozenset({"and", "und"}),
        entities=[
            Entity("word:with", "with", "word", aliases("with", "avec", "con")),
            Entity("word:from", "from", "word", aliases("from", "von"), frozenset({"worthless"})),
            Entity("shape:number", "number", "shape", (Alias.of({"regex": r"\b\d{3,}\b"}),)),
        ],
        relations=[Relation("place", (r"\b(?:in|at|to)\b",), frozenset({"word"})), Relation("measure", (r"\bof\b",), frozenset({"shape", "word"}))],
        normaliser=Normaliser(rules=[(r"[*#%$&|]+", " ")]),
    )


def _matches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return materialize(extraction.matches(docs, sample_lexicon()), "matches")


@query("dictionary_tags")
def dictionary_tags(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.events(_matches(spark, d))["occurrences"]
    return found.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("doc").alias("n_docs"))


@query(
    "dictionary_flags",
    r"""SELECT doc_id, coalesce(regexp_matches(lower(text), '(^|[^a-z0-9])worthless([^a-z0-9]|$)'), false) AS worthless,
  coalesce(regexp_matches(lower(text), '(^|[^a-z0-9])loser([^a-z0-9]|$)'), false) AS loser FROM documents""",
)
def dictionary_flags(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda w: F.coalesce(F.lower("text").rlike(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)"), F.lit(False)).alias(w)
    return table(spark, d, "documents").select("doc_id", flag("worthless"), flag("loser"))


@query("sentence_counts", r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[.!?]+[ \t\n]+')) AS n_stops FROM conversations""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit("[.!?]+[ \\t\\n]+")).cast("long").alias("n_stops"))


@query("tag_cooccurrence")
def tag_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.events(_matches(spark, d))
    near = found["cooccurrence_events"].groupBy("source", "target").agg(F.count_distinct("doc").alias("n_docs"), F.sum("weight").alias("weight"))
    far = found["abstract_cooccurrence_events"].groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n_abstracts"), F.avg("distance").alias("mean_distance"), F.avg(F.col("same_sentence").cast("int")).alias("same_share")
    )
    return far.join(near, ["source", "target"], "left")


@query("relation_cues")
def relation_cues(spark: SparkSession, d: str) -> DataFrame:
    return edges.relation_edges(extraction.events(_matches(spark, d))["relation_events"], [])


@query("bootstrap_jsd")
def bootstrap_jsd(spark: SparkSession, d: str) -> DataFrame:
    return divergence.intervals(divergence.bootstrap(mentions(spark, d), FIELDS), ["year"])


@query("bootstrap_contrast")
def bootstrap_contrast(spark: SparkSession, d: str) -> DataFrame:
    found = divergence.contrast_intervals(divergence.bootstrap(mentions(spark, d), FIELDS), EARLY, LATE)
    return found.withColumn("claim", divergence.claim_gate(F.col("excludes_zero")))


@query("rarefaction")
def rarefaction(spark: SparkSession, d: str) -> DataFrame:
    return divergence.intervals(divergence.rarefied(mentions(spark, d), FIELDS), ["year"])


@query("permutation_null")
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    seen = divergence.intervals(divergence.rarefied(m, FIELDS), ["year"]).select("year", F.col("mean").alias("rarefied"))
    null = divergence.intervals(divergence.rarefied(m, FIELDS, permute=True), ["year"])
    return seen.join(null, "year").withColumn("excess", F.col("rarefied") - F.col("mean"))


def _role_graph(spark: SparkSession, d: str) -> DataFrame:
    items = tables.in_windows(baskets(spark, d).where(F.col("field").isin(*FIELDS)), WINDOWS)
    return edges.brokerage_edges(items.select("window", "doc", "field", "item"), FIELDS, ["window"]).select("window", "source", "target", "distance", "shared")


SOURCES, TARGETS = ["Brand#1", "Brand#2", "Brand#3"], ["Brand#23", "Brand#24", "Brand#25"]
_ENDS = [", ".join(f"'{x}'" for x in ends) for ends in (SOURCES, TARGETS)]
_GRAPH = f"""{BASKET}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), i AS (SELECT win, doc, field, item FROM basket JOIN w ON year BETWEEN a AND b WHERE {TWO}),
t AS (SELECT win, count(DISTINCT doc) FILTER (field = 'AUTOMOBILE') AS da, count(DISTINCT doc) FILTER (field = 'BUILDING') AS db FROM i GROUP BY win),
p AS (SELECT x.win, x.item AS source, y.item AS target, count(*) FILTER (x.field = 'AUTOMOBILE') AS n_a, count(*) FILTER (x.field = 'BUILDING') AS n_b
  FROM i x JOIN i y ON x.win = y.win AND x.doc = y.doc AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT p.win, source, target, 2 / (n_a / da + n_b / db) AS distance, CASE WHEN n_a > 0 AND n_b > 0 THEN 2 * (n_a / da) * (n_b / db) / (n_a / da + n_b / db) ELSE 0 END AS shared FROM p JOIN t ON t.win = p.win),
sym AS MATERIALIZED (SELECT win, source AS x, target AS y, distance, shared FROM g UNION ALL SELECT win, target, source, distance, shared FROM g)"""


def _shorter(name: str, of: str) -> str:
    """SQL for distances over twice as many edges."""
    return f"""{name} AS MATERIALIZED (SELECT win, r, x, y, min(d) AS d FROM (SELECT * FROM {of} UNION ALL SELECT m.win, m.r, m.x, o.y, m.d + o.d FROM {of} m JOIN {of} o ON o.win = m.win AND o.r = m.r AND o.x = m.y AND o.y <> m.x) GROUP BY ALL)"""


@query("betweenness_subset")
def betweenness_subset(spark: SparkSession, d: str) -> DataFrame:
    return graphs.per_graph(_role_graph(spark, d), ["window"], "distance", lambda g: graphs.betweenness_between(g, SOURCES, TARGETS)[0], "betweenness")


@query("efficiency_removal", f"""WITH {_GRAPH}, nodes AS (SELECT DISTINCT win, x FROM sym), s AS (SELECT * FROM nodes WHERE x IN ({_ENDS[0]})), e AS (SELECT * FROM nodes WHERE x IN ({_ENDS[1]})),
r AS (SELECT win, x AS r FROM nodes WHERE x NOT IN ({_ENDS[0]}, {_ENDS[1]}) UNION ALL SELECT DISTINCT win, '' FROM nodes),
d1 AS MATERIALIZED (SELECT sym.win, r, x, y, distance AS d FROM sym JOIN r ON r.win = sym.win AND x <> r AND y <> r), {_shorter("d2", "d1")}, {_shorter("d4", "d2")}, {_shorter("d8", "d4")},
f AS (SELECT r.win, r.r, sum(coalesce(1 / d, 0)) / count(*) AS eff FROM r JOIN s ON s.win = r.win JOIN e ON e.win = r.win LEFT JOIN d8 ON d8.win = r.win AND d8.r = r.r AND d8.x = s.x AND d8.y = e.x GROUP BY ALL)
SELECT f.win AS "window", f.r AS node, round(greatest((b.eff - f.eff) / b.eff, 0), 9) AS loss FROM f JOIN f b ON b.win = f.win AND b.r = '' WHERE f.r <> ''""")
def efficiency_removal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graphs.removal_effects(_role_graph(spark, d), ["window"], "distance", SOURCES, TARGETS), "loss")


@query("kcore", f"""WITH RECURSIVE {_GRAPH}, alive(win, k, x, step) AS (SELECT DISTINCT win, k, x, 0 FROM sym, range(1, 40) c(k)
  UNION ALL SELECT a.win, a.k, a.x, a.step + 1 FROM alive a JOIN sym ON sym.win = a.win AND sym.x = a.x JOIN alive b ON b.win = a.win AND b.k = a.k AND b.x = sym.y WHERE a.step < 40 GROUP BY a.win, a.k, a.x, a.step HAVING count(*) >= a.k)
SELECT win AS "window", x AS node, max(k)::DOUBLE AS core FROM alive WHERE step = 40 GROUP BY ALL""")
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return graphs.per_graph(_role_graph(spark, d), ["window"], "distance", graphs.core_numbers, "core")


@query("eigenvector_scores", f"""WITH RECURSIVE {_GRAPH}, v(win, x, v, step) AS (SELECT DISTINCT win, x, 1.0::DOUBLE, 0 FROM sym
  UNION ALL SELECT sym.win, sym.x, sum(shared * v), v.step + 1 FROM sym JOIN v ON v.win = sym.win AND v.x = sym.y WHERE v.step < 60 GROUP BY sym.win, sym.x, v.step)
SELECT win AS "window", x AS node, round(v / max(v) OVER (PARTITION BY win), 9) AS centrality FROM v WHERE step = 60""")
def eigenvector_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graphs.per_graph(_role_graph(spark, d), ["window"], "shared", graphs.eigenvector_centrality, "centrality"), "centrality")


@query("trend_loess", f"""WITH {MENTIONS}, c AS (SELECT field, year, family AS term, count(*) AS n FROM mentions GROUP BY ALL), y AS (SELECT *, n / sum(n) OVER (PARTITION BY field, year) AS share FROM c),
e AS (SELECT field, term, 'start' AS side, min(year) AS x0 FROM y GROUP BY ALL UNION ALL SELECT field, term, 'end', max(year) FROM y GROUP BY ALL),
d AS (SELECT y.*, side, x0, abs(year - x0) AS d, row_number() OVER (PARTITION BY y.field, y.term, side ORDER BY abs(year - x0)) AS nth, count(*) OVER (PARTITION BY y.field, y.term, side) AS m FROM y JOIN e ON e.field = y.field AND e.term = y.term),
r AS (SELECT *, max(d) FILTER (nth = greatest(2, floor(0.75 * m + 1e-9))) OVER (PARTITION BY field, term, side) AS reach FROM d WHERE m >= 4),
w AS (SELECT *, CASE WHEN d < reach THEN pow(1 - pow(d / reach, 3), 3) ELSE 0 END AS w FROM r),
s AS (SELECT *, sum(w * year) OVER p / sum(w) OVER p AS mx, sum(w * share) OVER p / sum(w) OVER p AS my FROM w WINDOW p AS (PARTITION BY field, term, side)),
f AS (SELECT field, term, side, any_value(my) + CASE WHEN sum(w * pow(year - mx, 2)) > 1e-12 THEN sum(w * (year - mx) * (share - my)) / sum(w * pow(year - mx, 2)) * (any_value(x0) - any_value(mx)) ELSE 0 END AS fit FROM s GROUP BY ALL),
b AS (SELECT field, term, max(fit) FILTER (side = 'start') AS "start", max(fit) FILTER (side = 'end') AS "end" FROM f GROUP BY ALL), n AS (SELECT field, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
z AS (SELECT b.*, n, ln("end" / "start") AS growth FROM b JOIN n ON n.field = b.field AND n.term = b.term WHERE n >= 40 AND "start" > 0 AND "end" > 0 AND greatest("start", "end") >= 0.005),
o AS (SELECT *, CASE WHEN growth > 0 THEN 'rising' ELSE 'declining' END AS direction FROM z WHERE abs(growth) >= 0.01)
SELECT field, term, round("start", 9) AS "start", round("end", 9) AS "end", round(growth, 9) AS growth, n, direction, rank FROM (SELECT *, row_number() OVER (PARTITION BY field, direction ORDER BY abs(growth) DESC, term) AS rank FROM o) WHERE rank <= 5""")
def trend_loess(spark: SparkSession, d: str) -> DataFrame:
    shares = divergence.share_of(mentions(spark, d).groupBy("field", "year", "family").agg(F.count(F.lit(1)).alias("n")), ["field", "year"], "n")
    trend = lexical.trends(shares, ["field", "family"], "share").withColumnRenamed("family", "term")
    totals = shares.groupBy("field", F.col("family").alias("term")).agg(F.sum("n").alias("n"))
    return rounded(lexical.chosen_trends(trend, totals, "field", growth=0.01), "start", "end", "growth")


@query("spectral_scores", f"""WITH RECURSIVE {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), c AS (SELECT win, family, field, count(*)::DOUBLE AS n FROM mentions JOIN w ON year BETWEEN a AND b GROUP BY ALL),
f AS (SELECT win, sum(n * n) AS f FROM c GROUP BY win), m AS MATERIALIZED (SELECT x.win, x.family AS x, y.family AS y, sum(x.n * y.n / f) AS m FROM c x JOIN c y ON y.win = x.win AND y.field = x.field JOIN f ON f.win = x.win GROUP BY ALL),
v(win, x, v, step) AS (SELECT DISTINCT win, x, 1.0::DOUBLE, 0 FROM m UNION ALL SELECT m.win, m.x, sum(m * v), v.step + 1 FROM m JOIN v ON v.win = m.win AND v.x = m.y WHERE v.step < 60 GROUP BY m.win, m.x, v.step)
SELECT win AS "window", x AS family, round(v / max(v) OVER (PARTITION BY win), 9) AS score FROM v WHERE step = 60""")
def spectral_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spectral scores of families in the family-field graph of each window."""
    import numpy as np
    import pandas as pd

    counts = tables.in_windows(mentions(spark, d), WINDOWS).groupBy("window", "family", "field").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="family", columns="field", values="n", fill_value=0.0, aggfunc="sum").sort_index()
        left, _ = graphs.spectral_scores(list(wide.index), list(wide.columns), np.asarray(wide))
        return pd.DataFrame([[key[0], f, s] for f, s in left.items()], columns=["window", "family", "score"])

    return rounded(counts.groupBy("window").applyInPandas(run, "window string, family string, score double"), "score")
