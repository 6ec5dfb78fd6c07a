"""Queries of role graphs, periods, sources, sampling and manifests, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import edges, roles, sampling, tables
from corpusloom.plans.catalog import _PAIRS, _WINDOW_ROWS, BASKET, CLASSES, FIELDS, MENTIONS, PAPERS, PERIODS, TWO, WINDOWS, baskets, classes, mentions, papers, query, rounded, table
from corpusloom.sources import readers, writers
from corpusloom.sources.storage import Scratch, materialize

DEFINITIONS = {"own": {}, "umbrella": {"Brand#1x": ["Brand#1", "Brand#11", "Brand#12"], "Brand#2x": ["Brand#2", "Brand#21"]}}
_UMBRELLA = "CASE WHEN family IN ('Brand#1', 'Brand#11', 'Brand#12') THEN 'Brand#1x' WHEN family IN ('Brand#2', 'Brand#21') THEN 'Brand#2x' ELSE family END"
FOLD = 1.02  # how far a family must lean to be an anchor; the made-up fields hardly differ
SPANS = [("all", 1900, 2100), *((label, a, b) for a, b, label in PERIODS)]
_SPAN_ROWS = ", ".join(f"('{w}', {a}, {b})" for w, a, b in SPANS)

_RATIOS = f"""n AS (SELECT win, family, count(*) FILTER (field = 'AUTOMOBILE') AS n_a, count(*) FILTER (field = 'BUILDING') AS n_b FROM mentions JOIN w ON year BETWEEN a AND b WHERE {TWO} GROUP BY ALL),
t AS (SELECT win, count(*) FILTER (field = 'AUTOMOBILE') AS p_a, count(*) FILTER (field = 'BUILDING') AS p_b FROM papers JOIN w ON year BETWEEN a AND b GROUP BY win),
q AS (SELECT n.win, n.family AS node, n_a, n_b, p_a, p_b, log2(((n_b + 0.5) / (p_b + 1)) / ((n_a + 0.5) / (p_a + 1))) AS r FROM n JOIN t ON t.win = n.win)"""
_ANCHORS = f"""k AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY r, node) AS up, row_number() OVER (PARTITION BY win ORDER BY r DESC, node DESC) AS down,
  min(r) OVER (PARTITION BY win) AS lowest, max(r) OVER (PARTITION BY win) AS highest FROM q),
anchors AS (SELECT win, 'low' AS side, node FROM k WHERE r <= -log2({FOLD}) OR (up = 1 AND lowest > -log2({FOLD}))
  UNION ALL SELECT win, 'high', node FROM k WHERE r >= log2({FOLD}) OR (down = 1 AND highest < log2({FOLD})))"""


def _prominence(spark: SparkSession, d: str) -> DataFrame:
    m = tables.in_windows(mentions(spark, d).where(F.col("field").isin(*FIELDS)), WINDOWS)
    return edges.prominence(m, tables.in_windows(papers(spark, d), WINDOWS), FIELDS, ["window"])


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return roles.anchor_table(_prominence(spark, d).select("window", F.col("family").alias("node"), "log2_ratio"), ["window"], FOLD)


@query("definitions", f"""WITH {MENTIONS}, u AS (SELECT 'own' AS definition, key, year, field, family FROM mentions UNION SELECT 'umbrella', key, year, field, {_UMBRELLA} FROM mentions)
SELECT definition, family, count(*) AS n_papers, count(DISTINCT year) AS n_years FROM u GROUP BY ALL""")
def definitions(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.defined(mentions(spark, d), DEFINITIONS)
    return rows.groupBy("definition", "family").agg(F.count(F.lit(1)).alias("n_papers"), F.count_distinct("year").alias("n_years"))


@query("field_membership", f"""WITH {PAPERS}, {CLASSES}, f AS (SELECT key, min_by(CASE cls WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'other' END, pos) AS primary_field,
  bool_or(cls = 'A') AND bool_or(cls = 'R') AS crosslisted FROM classes GROUP BY key)
SELECT p.key, p.year, primary_field, crosslisted FROM papers p JOIN f ON f.key = p.key""")
def field_membership(spark: SparkSession, d: str) -> DataFrame:
    return roles.field_membership(classes(spark, d), papers(spark, d), {"A": "accepted", "R": "returned"}, "accepted", "returned")


@query("anchors", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), {_RATIOS}, {_ANCHORS} SELECT win AS "window", side, node FROM anchors""")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d)


@query("common_anchors", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), {_RATIOS}, {_ANCHORS},
s AS (SELECT side, node FROM anchors GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT win) FROM anchors))
SELECT g.win AS "window", side, node FROM (SELECT DISTINCT win FROM anchors) g, s""")
def common_anchors(spark: SparkSession, d: str) -> DataFrame:
    return roles.common_anchors(materialize(_anchors(spark, d), "anchors"), ["window"])


@query("prominence_edges", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), {_RATIOS}
SELECT win AS "window", 'AUTOMOBILE' AS source, node AS target, round(n_a / p_a, 9) AS weight FROM q WHERE n_a > 0
UNION ALL SELECT win, 'BUILDING', node, round(n_b / p_b, 9) FROM q WHERE n_b > 0""")
def prominence_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roles.prominence_graph(_prominence(spark, d), ["window"], FIELDS)[1], "weight")


@query("prominence_nodes", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), {_RATIOS}
SELECT win AS "window", node, 'family' AS kind FROM q WHERE n_a > 0 OR n_b > 0
UNION SELECT win, 'AUTOMOBILE', 'field' FROM q WHERE n_a > 0 UNION SELECT win, 'BUILDING', 'field' FROM q WHERE n_b > 0""")
def prominence_nodes(spark: SparkSession, d: str) -> DataFrame:
    return roles.prominence_graph(_prominence(spark, d), ["window"], FIELDS)[0]


@query("prominence_bootstrap")
def prominence_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    found = _prominence(spark, d)
    return found.select("window", "family", "log2_ratio").join(roles.prominence_intervals(found, ["window"]), ["window", "family"])


@query("log_ratio_intervals")
def log_ratio_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Log ratios of families between fields, by year, with intervals over binomial redraws of the counts."""
    years = [(str(y), y, y) for y in range(1992, 2002)]
    m = tables.in_windows(mentions(spark, d).where(F.col("field").isin(*FIELDS)), years)
    found = edges.prominence(m, tables.in_windows(papers(spark, d), years), FIELDS, ["window"])
    return found.select("window", "family", "log2_ratio").join(roles.prominence_intervals(found, ["window"]), ["window", "family"])


@query("common_scale", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), n AS (SELECT win, family, count(*) AS n FROM mentions JOIN w ON year BETWEEN a AND b GROUP BY ALL)
SELECT win AS "window", family, n, round(least(n / (SELECT max(n) FROM n WHERE win = '{WINDOWS[0][0]}'), 1), 9) AS scaled FROM n""")
def common_scale(spark: SparkSession, d: str) -> DataFrame:
    n = tables.in_windows(mentions(spark, d), WINDOWS).groupBy("window", "family").agg(F.count(F.lit(1)).alias("n"))
    return rounded(roles.on_common_scale(materialize(n, "counts"), "n", F.col("window") == WINDOWS[0][0]), "scaled")


@query("pattern_frequency", f"""WITH {MENTIONS} SELECT field, year, count(DISTINCT key) AS n_docs, count(*) AS n_events FROM mentions GROUP BY ALL""")
def pattern_frequency(spark: SparkSession, d: str) -> DataFrame:
    return roles.pattern_frequency(mentions(spark, d).withColumnRenamed("key", "doc"), ["field", "year"])


@query("period_edges", f"""WITH {BASKET}, {_PAIRS}, w(win, a, b) AS (VALUES {_SPAN_ROWS}), t AS (SELECT win, count(DISTINCT doc) AS n_docs FROM basket JOIN w ON year BETWEEN a AND b GROUP BY win),
n AS (SELECT win, item, count(*) AS n FROM basket JOIN w ON year BETWEEN a AND b GROUP BY ALL), e AS (SELECT win, source, target, count(*) AS n_xy FROM pairs JOIN w ON year BETWEEN a AND b GROUP BY ALL HAVING count(*) >= 5)
SELECT e.win AS "window", source, target, n_xy, n_docs, x.n AS n_x, y.n AS n_y, round(n_xy / (x.n + y.n - n_xy), 9) AS jaccard, round(n_xy / sqrt(x.n::DOUBLE * y.n), 9) AS cosine
FROM e JOIN t ON t.win = e.win JOIN n x ON x.win = e.win AND x.item = source JOIN n y ON y.win = e.win AND y.item = target""")
def period_edges(spark: SparkSession, d: str) -> DataFrame:
    """Co-occurrence of the whole range and of each period, as one plan."""
    items = tables.in_windows(baskets(spark, d), SPANS).select("window", "doc", "item")
    found = edges.association_edges(items, ["window"])
    return rounded(found.select("window", "source", "target", "n_xy", "n_docs", "n_x", "n_y", "jaccard", "cosine"), "jaccard", "cosine")


# --- sampling and validation ---

_DRAW = " + ".join(f"(u >= {p})::INT" for p in sampling.POISSON)


@query("score_bootstrap", f"""WITH t AS (SELECT l.doc_id, quality = 1 AS g, n_chars >= 500 AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
r AS (SELECT *, ('0x' || substr(md5(concat_ws(chr(31), doc_id::VARCHAR, b::VARCHAR, '20250801')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t, range(1, 1001) x(b)),
v AS (SELECT *, {_DRAW} AS w FROM r), c AS (SELECT b, sum(w) FILTER (g AND p) AS tp, sum(w) FILTER (NOT g AND p) AS fp, sum(w) FILTER (g AND NOT p) AS fn FROM v GROUP BY b),
z AS (SELECT b, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM c),
s AS (SELECT tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM z)
SELECT metric, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(*) AS n_defined FROM (UNPIVOT s ON precision, recall, f1 INTO NAME metric VALUE value) GROUP BY metric""")
def score_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of validation scores over redraws of the labelled documents."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(sampling.bootstrap_scores(rows, "doc_id", F.col("quality") == 1, F.col("n_chars") >= 500, []), "low", "high")


@query("stratum_sizes", f"""WITH {PAPERS}, n AS (SELECT field, year, count(*) AS n FROM papers GROUP BY ALL), e AS (SELECT *, 200.0::DOUBLE * n / sum(n) OVER () AS x FROM n),
f AS (SELECT *, floor(x)::BIGINT AS base, row_number() OVER (ORDER BY x - floor(x) DESC, field, year) AS k FROM e)
SELECT field, year, n, base + (k <= 200 - (SELECT sum(base) FROM f))::INT AS drawn FROM f""")
def stratum_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many papers of each field and year a sample of 200 takes, by largest remainders."""
    counts = papers(spark, d).groupBy("field", "year").agg(F.count(F.lit(1)).alias("n"))
    sizes = {(r["field"], r["year"]): r["n"] for r in counts.collect()}  # one row a field and year
    drawn = sampling.allocate(sizes, 200)
    return spark.createDataFrame([(f, y, n, drawn[f, y]) for (f, y), n in sizes.items()], "field string, year int, n long, drawn long")


@query("label_lists", """WITH t AS (SELECT p_brand, string_agg(' ' || p_type, ';' ORDER BY p_partkey) || '; ;' AS labels FROM part GROUP BY p_brand),
x AS (SELECT p_brand, trim(unnest(string_split(labels, ';'))) AS label FROM t) SELECT p_brand, label, count(*) AS n FROM x WHERE label <> '' GROUP BY ALL""")
def label_lists(spark: SparkSession, d: str) -> DataFrame:
    """Label lists joined by semicolons, with spaces and empty entries, and what they split into."""
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit(" "), "p_type").alias("label"))))
    joined = F.concat(F.array_join(F.transform(ordered, lambda x: x["label"]), ";"), F.lit("; ;"))
    lists = table(spark, d, "part").groupBy("p_brand").agg(joined.alias("labels"))
    rows = lists.select("p_brand", F.explode(sampling.split_labels(F.col("labels"))).alias("label"))
    return rows.groupBy("p_brand", "label").agg(F.count(F.lit(1)).alias("n"))


# --- sources and sinks: what is written in a format comes back from it ---


@query("csv_round_trip", """SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, commas and line ends through a CSV file with a header."""
    path = f"{Scratch(spark, 'csv').root}/documents.csv"
    writers.write_table(table(spark, d, "documents").select("doc_id", "lang", "text").where("text is not null and trim(text) <> ''"), path)
    return readers.csv_records(spark, path, "doc_id long, lang string, text string")


@query("json_round_trip", """SELECT p_partkey, p_name, p_size, round(p_retailprice, 6) AS p_retailprice FROM part""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark, 'json').root}/part.json"
    columns = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    writers.write_table(table(spark, d, "part").select(*columns), path)
    return rounded(readers.json_records(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double", by_line=True), "p_retailprice", digits=6)


@query("line_list", """SELECT line, count(*) AS n FROM (SELECT trim(p_type) AS line FROM part) WHERE line <> '' GROUP BY line""")
def line_list(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark, 'lines').root}/types.txt"
    writers.write_table(table(spark, d, "part").select(F.concat(F.lit(" "), "p_type", F.lit("  \n")).alias("value")), path)
    return readers.lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("metrics_map", """SELECT c_custkey, 'orders' AS metric, year(o_orderdate)::INT AS metric_year, count(*) AS value FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def metrics_map(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map metric -> year -> count for each customer, read back as rows; a reserved metric is left out."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("string").alias("year"))
    counts = orders.groupBy("c_custkey", "year").agg(F.count(F.lit(1)).alias("n"))
    by_year = counts.groupBy("c_custkey").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"))
    texts = by_year.select("c_custkey", F.to_json(F.create_map(F.lit("orders"), "m", F.lit("skipped"), "m")).alias("metrics"))
    return readers.metrics_long(texts, "c_custkey", "metrics", ("skipped",))


@query("fill_missing", """SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, f.found, '') AS event_type
FROM events e LEFT JOIN (SELECT event_id AS id, 'type of ' || user_id AS found FROM events WHERE event_id % 2 = 0) f ON f.id = e.event_id""")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Blanked types are filled from another table where it has them; those that are there stay."""
    events = table(spark, d, "events")
    holes = events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("event_type"))
    found = events.where("event_id % 2 = 0").select("event_id", F.concat(F.lit("type of "), F.col("user_id").cast("string")).alias("event_type"))
    return readers.fill_missing(holes, found, "event_id", "event_type")


@query("feed_entries", """SELECT 'doc-' || p_partkey AS id, p_brand AS "primary", p_brand || '|' || p_type AS categories FROM part""")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """An Atom feed of the parts, read back by entry; the version at the end of an address goes."""
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(
        F.lit("<entry><id>http://x.org/abs/doc-"), F.col("p_partkey").cast("string"), F.lit('v2</id><primary_category term="'), cell("p_brand"),
        F.lit('"/><category term="'), cell("p_brand"), F.lit('"/><category term="'), cell("p_type"), F.lit('"/></entry>'),
    )

    def whole(batches):  # each file is a feed
        yield pa.RecordBatch.from_pydict({"value": ["<feed>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</feed>"]})

    path = f"{Scratch(spark, 'feed').root}/feed.txt"
    writers.write_table(table(spark, d, "part").select(entry.alias("value")).mapInArrow(whole, "value string"), path)
    found = readers.feed_categories(spark, path)
    return found.select("id", "primary", F.array_join("categories", "|").alias("categories"))


@query("range_checks", """SELECT bool_and(l_discount BETWEEN 0 AND 1) AS l_discount, bool_and(l_quantity BETWEEN 0 AND 40) AS l_quantity FROM lineitem""")
def range_checks(spark: SparkSession, d: str) -> DataFrame:
    return writers.range_checks(table(spark, d, "lineitem"), {"l_discount": (0, 1), "l_quantity": (0, 40)})


@query("table_manifest", """SELECT 'region' AS name, count(*) AS n_rows, 2 AS n_columns FROM region UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'part', count(*), 6 FROM part""")
def table_manifest(spark: SparkSession, d: str) -> DataFrame:
    found = writers.manifest({}, {n: table(spark, d, n) for n in ("region", "nation", "part")})["outputs"]
    return spark.createDataFrame([(n, t["rows"], len(t["columns"])) for n, t in found.items()], "name string, n_rows long, n_columns int")
