"""Queries over the star-schema and document tables, each with the SQL that gives the same rows.

Orders stand for papers (year, market segment as field, priority as document type), their lineitems for class rows and, through parts,
for mentions of families (brands); documents, pages, events, labels, conversations and embeddings stand for themselves.
Doubles are rounded so that a different order of addition can't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.operators import classify, divergence, edges, lexical, sampling, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FIELDS = ("AUTOMOBILE", "BUILDING")
PERIODS = [(1995, 1996, "early"), (1997, 1999, "middle"), (2000, 2001, "late")]
WINDOWS = tables.year_windows(1995, 2001, [(1995, 1998), (1998, 2001)], 3)

PAPERS = """papers AS (
  SELECT o_orderkey AS key, year(o_orderdate)::INT AS year, c_mktsegment AS field, o_orderpriority AS doctype,
         o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
MENTIONS = f"""{PAPERS},
mentions AS (
  SELECT DISTINCT p.key, p.year, p.field, b.p_brand AS family
  FROM papers p JOIN lineitem l ON l.l_orderkey = p.key JOIN part b ON b.p_partkey = l.l_partkey)"""
CLASSES = """classes AS (
  SELECT l_orderkey AS key, l_returnflag AS cls,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos
  FROM lineitem)"""
TWO = "field IN ('AUTOMOBILE', 'BUILDING')"
SHARES = f"""{MENTIONS},
counts AS (
  SELECT year, family, count(*) FILTER (field = 'AUTOMOBILE')::DOUBLE AS a, count(*) FILTER (field = 'BUILDING')::DOUBLE AS b
  FROM mentions WHERE {TWO} GROUP BY year, family),
shares AS (
  SELECT *, coalesce(a / nullif(sum(a) OVER (PARTITION BY year), 0), 0) AS p,
         coalesce(b / nullif(sum(b) OVER (PARTITION BY year), 0), 0) AS q FROM counts)"""
JSD = "sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END)"
COSINE = "1 - coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0)"
BASKET = """basket AS (
  SELECT DISTINCT o_orderkey AS doc, year(o_orderdate)::INT AS year, c_mktsegment AS field, b.p_brand AS item
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part b ON p_partkey = l_partkey)"""
WORDS = """words AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[a-z]{2,}')) AS term
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM words GROUP BY ALL)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("doctype"), F.col("o_orderstatus").alias("status"),
    )
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("field"))
    return orders.join(customer, "c_custkey").drop("c_custkey")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("family"))
    return papers(spark, d).select("key", "year", "field").join(lines.join(parts, "p_partkey").select("key", "family"), "key").distinct()


def classes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("cls"), F.row_number().over(order).alias("pos")
    )


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select(F.col("key").alias("doc"), "year", "field", F.col("family").alias("item"))


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})  # no negative zero


# --- divergence of fields ---


@query(
    "field_composition_jsd",
    f"""WITH {SHARES},
n AS (SELECT field, family, count(*) AS n FROM mentions WHERE {TWO} GROUP BY ALL),
top AS (SELECT DISTINCT family FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, family) AS r FROM n) WHERE r <= 9),
c2 AS (SELECT year, family, a, b FROM counts WHERE family IN (SELECT family FROM top)),
s2 AS (SELECT *, a / sum(a) OVER (PARTITION BY year) AS p, b / sum(b) OVER (PARTITION BY year) AS q FROM c2)
SELECT year, sum(a) AS total_a, sum(b) AS total_b, round({JSD}, 9) AS jsd, round(sum(abs(p - q)) / 2, 9) AS tv, round({COSINE}, 9) AS cosine
FROM s2 GROUP BY year""",
)
def field_composition_jsd(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    tracked = divergence.top_families(m, 9, FIELDS)
    shares = divergence.field_shares(m.join(tracked, "family", "left_semi"), FIELDS, ["year"])
    return rounded(divergence.distances(shares, ["year"]), "jsd", "tv", "cosine")


@query(
    "divergence_contrast",
    f"""WITH {SHARES}, y AS (SELECT year, {JSD} AS jsd FROM shares GROUP BY year)
SELECT round(avg(jsd) FILTER (year BETWEEN 1995 AND 1997), 9) AS early, round(avg(jsd) FILTER (year BETWEEN 1999 AND 2001), 9) AS late,
       round(avg(jsd) FILTER (year BETWEEN 1999 AND 2001) - avg(jsd) FILTER (year BETWEEN 1995 AND 1997), 9) AS difference FROM y""",
)
def divergence_contrast(spark: SparkSession, d: str) -> DataFrame:
    yearly = divergence.distances(divergence.field_shares(mentions(spark, d), FIELDS, ["year"]), ["year"])
    return rounded(divergence.contrast(yearly, "jsd", (1995, 1997), (1999, 2001)), "early", "late", "difference")


@query(
    "equal_paper_jsd",
    f"""WITH {MENTIONS}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY key) AS weight FROM mentions),
counts AS (SELECT year, family, coalesce(sum(weight) FILTER (field = 'AUTOMOBILE'), 0) AS a, coalesce(sum(weight) FILTER (field = 'BUILDING'), 0) AS b
  FROM w WHERE {TWO} GROUP BY year, family),
shares AS (SELECT *, a / sum(a) OVER (PARTITION BY year) AS p, b / sum(b) OVER (PARTITION BY year) AS q FROM counts)
SELECT year, round({JSD}, 9) AS jsd, round(sum(abs(p - q)) / 2, 9) AS tv FROM shares GROUP BY year""",
)
def equal_paper_jsd(spark: SparkSession, d: str) -> DataFrame:
    weighted = divergence.paper_weights(mentions(spark, d))
    shares = divergence.field_shares(weighted, FIELDS, ["year"], F.col("weight"))
    return rounded(divergence.distances(shares, ["year"]).select("year", "jsd", "tv"), "jsd", "tv")


@query(
    "topk_union_sensitivity",
    f"""WITH {MENTIONS}, n AS (SELECT field, family, count(*) AS n FROM mentions WHERE {TWO} GROUP BY ALL),
best AS (SELECT family, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, family) AS r FROM n) GROUP BY family),
chosen AS (SELECT family, k FROM best, (SELECT unnest([3, 5, 9, 20, 1000]) AS k) WHERE r <= k),
counts AS (SELECT k, year, m.family, count(*) FILTER (field = 'AUTOMOBILE')::DOUBLE AS a, count(*) FILTER (field = 'BUILDING')::DOUBLE AS b
  FROM mentions m JOIN chosen c ON m.family = c.family WHERE {TWO} GROUP BY ALL),
shares AS (SELECT *, a / sum(a) OVER (PARTITION BY k, year) AS p, b / sum(b) OVER (PARTITION BY k, year) AS q FROM counts)
SELECT k, year, round({JSD}, 9) AS jsd FROM shares GROUP BY k, year""",
)
def topk_union_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    found = divergence.selection_sensitivity(mentions(spark, d), FIELDS, [3, 5, 9, 20, 1000])
    return rounded(found.select("k", "year", "jsd"), "jsd")


@query(
    "family_suppression",
    f"""WITH {MENTIONS}, kept AS (SELECT * FROM mentions m WHERE family <> 'Brand#1' OR NOT EXISTS (SELECT 1 FROM mentions o WHERE o.key = m.key AND o.family <> 'Brand#1'))
SELECT year, field, count(*) AS n_mentions, count(*) FILTER (family = 'Brand#1') AS n_generic FROM kept GROUP BY ALL""",
)
def family_suppression(spark: SparkSession, d: str) -> DataFrame:
    kept = divergence.suppress_generic(mentions(spark, d), "Brand#1")
    return kept.groupBy("year", "field").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if(F.col("family") == "Brand#1").alias("n_generic"))


@query(
    "relabel_collapse",
    f"""WITH {MENTIONS}, m2 AS (SELECT DISTINCT key, year, field, CASE WHEN family IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'Group#1' ELSE family END AS family FROM mentions)
SELECT field, family, count(*) AS n FROM m2 GROUP BY ALL""",
)
def relabel_collapse(spark: SparkSession, d: str) -> DataFrame:
    groups = dict.fromkeys(("Brand#1", "Brand#2", "Brand#3"), "Group#1")
    return divergence.relabel(mentions(spark, d), groups).groupBy("field", "family").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log_ratio_smoothed",
    f"""WITH {SHARES}, g AS (SELECT y.year, f.family, coalesce(a, 0) AS a, coalesce(b, 0) AS b
  FROM (SELECT DISTINCT year FROM mentions) y CROSS JOIN (SELECT DISTINCT family FROM mentions) f LEFT JOIN counts c ON c.year = y.year AND c.family = f.family)
SELECT year, family, a, b, round(log2((b + 0.5) / sum(b + 0.5) OVER (PARTITION BY year)) - log2((a + 0.5) / sum(a + 0.5) OVER (PARTITION BY year)), 9) AS log_ratio,
       a + b >= 20 AS supported FROM g""",
)
def log_ratio_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(divergence.log_ratios(mentions(spark, d), FIELDS), "log_ratio")


@query(
    "crossover_year",
    f"""WITH {SHARES} SELECT family, min(year) FILTER (q > p) AS first_year, count(*) FILTER (q > p) AS n_years FROM shares GROUP BY family HAVING count(*) FILTER (q > p) > 0""",
)
def crossover_year(spark: SparkSession, d: str) -> DataFrame:
    ahead = F.col("q") > F.col("p")
    shares = divergence.field_shares(mentions(spark, d), FIELDS, ["year"])
    return shares.groupBy("family").agg(F.min(F.when(ahead, F.col("year"))).alias("first_year"), F.count_if(ahead).alias("n_years")).where("n_years > 0")


@query(
    "doctype_sensitivity",
    f"""WITH {MENTIONS}, t AS (SELECT m.key, m.year, m.field, m.family, p.doctype FROM mentions m JOIN papers p ON m.key = p.key),
sc AS (SELECT 'all' AS scope, key, year, field, family FROM t UNION ALL SELECT 'urgent', key, year, field, family FROM t WHERE doctype IN ('1-URGENT', '2-HIGH')
       UNION ALL SELECT 'other', key, year, field, family FROM t WHERE NOT coalesce(doctype IN ('1-URGENT', '2-HIGH'), false)),
counts AS (SELECT scope, year, family, count(*) FILTER (field = 'AUTOMOBILE')::DOUBLE AS a, count(*) FILTER (field = 'BUILDING')::DOUBLE AS b FROM sc WHERE {TWO} GROUP BY ALL),
shares AS (SELECT *, a / sum(a) OVER (PARTITION BY scope, year) AS p, b / sum(b) OVER (PARTITION BY scope, year) AS q FROM counts)
SELECT scope, year, round({JSD}, 9) AS jsd FROM shares GROUP BY scope, year""",
)
def doctype_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    urgent = ["1-URGENT", "2-HIGH"]
    typed = mentions(spark, d).join(papers(spark, d).select("key", "doctype"), "key")
    scope = F.explode(F.array(F.lit("all"), F.when(M.not_among(F.col("doctype"), urgent), "other").otherwise("urgent")))
    shares = divergence.field_shares(typed.withColumn("scope", scope), FIELDS, ["scope", "year"])
    return rounded(divergence.distances(shares, ["scope", "year"]).select("scope", "year", "jsd"), "jsd")


@query(
    "composition_share",
    f"""WITH {MENTIONS}, n AS (SELECT year, field, family, count(*) AS n FROM mentions GROUP BY ALL)
SELECT year, field, family, n, round(n / sum(n) OVER (PARTITION BY year, field), 9) AS share FROM n""",
)
def composition_share(spark: SparkSession, d: str) -> DataFrame:
    counts = mentions(spark, d).groupBy("year", "field", "family").agg(F.count(F.lit(1)).alias("n"))
    return rounded(divergence.share_of(counts, ["year", "field"], "n"), "share")


# --- classification tables ---


@query("primary_class_yearly", f"""WITH {PAPERS}, {CLASSES}, f AS (SELECT key, min_by(cls, pos) AS cls FROM classes GROUP BY key),
n AS (SELECT year, cls, count(*) AS n FROM f JOIN papers p ON p.key = f.key GROUP BY ALL)
SELECT year, cls, n, round(n / sum(n) OVER (PARTITION BY year), 9) AS share FROM n""")
def primary_class_yearly(spark: SparkSession, d: str) -> DataFrame:
    primary = classify.per_paper(classes(spark, d)).select("key", F.col("primary").alias("cls"))
    n = primary.join(papers(spark, d).select("key", "year"), "key").groupBy("year", "cls").agg(F.count(F.lit(1)).alias("n"))
    return rounded(divergence.share_of(n, ["year"], "n"), "share")


@query("assignment_shares", f"""WITH {PAPERS}, {CLASSES},
w AS (SELECT 'primary' AS scheme, key, min_by(cls, pos) AS cls, 1.0::DOUBLE AS weight FROM classes GROUP BY key
  UNION ALL SELECT DISTINCT 'any', key, cls, 1.0::DOUBLE FROM classes
  UNION ALL SELECT 'fractional', key, cls, sum(s) FROM (SELECT key, cls, 1.0::DOUBLE / count(*) OVER (PARTITION BY key) AS s FROM classes) GROUP BY key, cls),
y AS (SELECT scheme, year, cls, weight, w.key FROM w JOIN papers p ON p.key = w.key),
t AS (SELECT scheme, year, count(DISTINCT key) AS n_papers FROM y GROUP BY ALL),
g AS (SELECT scheme, year, cls, sum(weight) AS w FROM y GROUP BY ALL)
SELECT g.scheme, g.year, cls, round(w, 6) AS weight, n_papers, round(w / n_papers, 9) AS share
FROM g JOIN t ON t.scheme = g.scheme AND t.year = g.year""")
def assignment_shares(spark: SparkSession, d: str) -> DataFrame:
    found = classify.assignment_shares(classes(spark, d), papers(spark, d))
    return rounded(found.withColumn("weight", F.round("weight", 6)), "share")


@query("fractional_weights", f"""WITH {CLASSES}, s AS (SELECT key, cls, 1.0::DOUBLE / count(*) OVER (PARTITION BY key) AS s FROM classes)
SELECT key, cls, round(sum(s), 9) AS weight FROM s GROUP BY key, cls""")
def fractional_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(classify.fractional_weights(classes(spark, d)), "weight")


_Z = "1.959963984540054"


@query("crosslisting_wilson", f"""WITH {PAPERS}, {CLASSES}, f AS (SELECT key, bool_or(cls = 'A') AS a, bool_or(cls = 'R') AS r FROM classes GROUP BY key),
y AS (SELECT year, count(*) FILTER (a AND r) AS n_cross, count(*) FILTER (a OR r) AS n_either FROM f JOIN papers p ON p.key = f.key GROUP BY year),
p AS (SELECT *, n_cross::DOUBLE / n_either AS rate, {_Z}::DOUBLE AS z FROM y)
SELECT year, n_cross, n_either, round(rate, 9) AS rate,
  round((rate + z * z / 2 / n_either) / (1 + z * z / n_either) - z * sqrt((rate * (1 - rate) + z * z / 4 / n_either) / n_either) / (1 + z * z / n_either), 9) AS low,
  round((rate + z * z / 2 / n_either) / (1 + z * z / n_either) + z * sqrt((rate * (1 - rate) + z * z / 4 / n_either) / n_either) / (1 + z * z / n_either), 9) AS high
FROM p""")
def crosslisting_wilson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(classify.cross_listing(classes(spark, d), papers(spark, d), "A", "R"), "rate", "low", "high")


@query("coverage_by_type", f"""WITH {PAPERS}, c AS (SELECT DISTINCT l_orderkey AS key FROM lineitem)
SELECT year, doctype, count(*) AS n_rows, count(c.key) AS n_present, round(count(c.key) / count(*), 9) AS share
FROM papers p LEFT JOIN c ON c.key = p.key GROUP BY ALL""")
def coverage_by_type(spark: SparkSession, d: str) -> DataFrame:
    flagged = tables.member_flag(papers(spark, d), classes(spark, d), ["key"], "classified")
    return rounded(tables.coverage(flagged, ["year", "doctype"], F.col("classified")), "share")


@query("class_mapping", """SELECT l_returnflag || '/' || l_linestatus AS cls, CASE WHEN l_returnflag LIKE 'A%' THEN 'accepted' WHEN l_returnflag LIKE 'R%' THEN 'returned' ELSE 'Other' END AS category, count(*) AS n
FROM lineitem GROUP BY ALL""")
def class_mapping(spark: SparkSession, d: str) -> DataFrame:
    cls = F.concat_ws("/", "l_returnflag", "l_linestatus")
    rows = table(spark, d, "lineitem").select(cls.alias("cls"), M.first_match(F.col("l_returnflag"), [("A", "accepted"), ("R", "returned")], "Other").alias("category"))
    return rows.groupBy("cls", "category").agg(F.count(F.lit(1)).alias("n"))


@query("doctype_flow", f"""WITH {PAPERS}, c AS (SELECT DISTINCT l_orderkey AS key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#7')
SELECT coalesce(doctype, 'missing') AS doctype, NOT coalesce(doctype IN ('5-LOW'), false) AS included, count(*) AS n_corpus, count(c.key) AS n_candidate
FROM papers p LEFT JOIN c ON c.key = p.key GROUP BY ALL""")
def doctype_flow(spark: SparkSession, d: str) -> DataFrame:
    named = mentions(spark, d).where("family = 'Brand#7'")
    return classify.document_flow(papers(spark, d), named, M.not_among(F.col("doctype"), ["5-LOW"]))


@query("ordered_classes", f"""WITH {CLASSES} SELECT key, string_agg(cls, '|' ORDER BY pos) AS classes, string_agg(DISTINCT cls, '|' ORDER BY cls) AS class_set, count(*) AS n FROM classes GROUP BY key""")
def ordered_classes(spark: SparkSession, d: str) -> DataFrame:
    lists = classify.per_paper(classes(spark, d))
    return lists.select("key", F.array_join("classes", "|").alias("classes"), F.array_join(F.array_sort(F.array_distinct("classes")), "|").alias("class_set"), F.size("classes").cast("long").alias("n"))


@query("eligibility", f"""WITH {PAPERS} SELECT year, count(*) AS n, count(*) FILTER (year BETWEEN 1996 AND 2000 AND NOT coalesce(doctype IN ('5-LOW'), false) AND NOT coalesce(regexp_matches(field, '^M'), false)) AS n_eligible FROM papers GROUP BY year""")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("year").between(1996, 2000) & M.not_among(F.col("doctype"), ["5-LOW"]) & ~F.coalesce(F.col("field").rlike("^M"), F.lit(False))
    return papers(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_eligible"))


@query("quantiles", """SELECT lang, median(n_chars::DOUBLE) AS med, quantile_cont(n_chars::DOUBLE, 0.025) AS low, quantile_cont(n_chars::DOUBLE, 0.975) AS high, count(*) AS n FROM documents GROUP BY lang""")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("n_chars").cast("double")
    return table(spark, d, "documents").groupBy("lang").agg(
        F.median(x).alias("med"), F.percentile(x, F.lit(0.025)).alias("low"), F.percentile(x, F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("n")
    )


# --- windows, ranks and reshaping ---

_WINDOW_ROWS = ", ".join(f"('{w}', {a}, {b})" for w, a, b in WINDOWS)


@query("rolling_windows", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS})
SELECT win AS "window", field, count(*) AS n_mentions, count(DISTINCT key) AS n_papers FROM mentions JOIN w ON year BETWEEN a AND b GROUP BY ALL""")
def rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.in_windows(mentions(spark, d), WINDOWS)
    return rows.groupBy("window", "field").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("key").alias("n_papers"))


@query("period_metrics", f"""WITH {PAPERS}, t AS (SELECT *, CASE WHEN year BETWEEN 1995 AND 1996 THEN 'early' WHEN year BETWEEN 1997 AND 1999 THEN 'middle' WHEN year BETWEEN 2000 AND 2001 THEN 'late' END AS period FROM papers)
SELECT period, field, count(*) AS n, count(DISTINCT doctype) AS n_types, round(avg((status = 'F')::INT), 9) AS done_share, bool_or(status = 'P') AS any_open FROM t GROUP BY ALL""")
def period_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = papers(spark, d).withColumn("period", M.period_of(F.col("year"), PERIODS))
    return rounded(
        rows.groupBy("period", "field").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("doctype").alias("n_types"),
            F.avg((F.col("status") == "F").cast("int")).alias("done_share"), F.bool_or(F.col("status") == "P").alias("any_open"),
        ), "done_share",
    )


@query("pct_rank_avg", """SELECT p_partkey, p_brand, p_size, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) / count(*) OVER (PARTITION BY p_brand), 9) AS pct FROM part""")
def pct_rank_avg(spark: SparkSession, d: str) -> DataFrame:
    share = tables.average_rank_share(F.col("p_size"), ["p_brand"])
    return rounded(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", share.alias("pct")), "pct")


@query("winner_share", f"""WITH {MENTIONS}, n AS (SELECT year, family, count(*) AS n FROM mentions GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, family) AS r, round(n / sum(n) OVER (PARTITION BY year), 9) AS share FROM n)
SELECT year, family, n, share FROM r WHERE r = 1""")
def winner_share(spark: SparkSession, d: str) -> DataFrame:
    n = mentions(spark, d).groupBy("year", "family").agg(F.count(F.lit(1)).alias("n"))
    first = tables.top_k(divergence.share_of(n, ["year"], "n"), ["year"], [F.desc("n"), "family"], 1)
    return rounded(first.drop("rank"), "share")


@query("top_classes", f"""WITH {MENTIONS}, n AS (SELECT family, count(*) AS total FROM mentions GROUP BY family ORDER BY total DESC, family LIMIT 7)
SELECT m.year, m.family, count(*) AS n FROM mentions m WHERE family IN (SELECT family FROM n) GROUP BY ALL""")
def top_classes(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    top = m.groupBy("family").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "family").limit(7)
    return m.join(top, "family", "left_semi").groupBy("year", "family").agg(F.count(F.lit(1)).alias("n"))


@query("table_ranked_wide", f"""WITH {MENTIONS}, n AS (SELECT field, family, count(*) AS n FROM mentions GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, family) AS rank FROM n)
SELECT rank, max(family) FILTER (field = 'AUTOMOBILE') AS automobile, max(family) FILTER (field = 'BUILDING') AS building FROM r WHERE rank <= 12 GROUP BY rank""")
def table_ranked_wide(spark: SparkSession, d: str) -> DataFrame:
    n = mentions(spark, d).groupBy("field", "family").agg(F.count(F.lit(1)).alias("n"))
    ranked = tables.top_k(n, ["field"], [F.desc("n"), "family"], 12)
    wide = ranked.groupBy("rank").pivot("field", list(FIELDS)).agg(F.max("family"))
    return wide.withColumnsRenamed({f: f.lower() for f in FIELDS})


@query("heatmap_cells", f"""WITH {SHARES}, g AS (SELECT year, family, a, b, log2((b + 0.5) / sum(b + 0.5) OVER (PARTITION BY year)) - log2((a + 0.5) / sum(a + 0.5) OVER (PARTITION BY year)) AS v FROM counts),
o AS (SELECT family, sum(v * (a + b)) / sum(a + b) AS mean_ratio, median(v) AS median_ratio FROM g GROUP BY family)
SELECT g.family, year, CASE WHEN a + b >= 20 THEN round(v, 9) END AS cell, round(mean_ratio, 9) AS mean_ratio, round(median_ratio, 9) AS median_ratio FROM g JOIN o ON o.family = g.family""")
def heatmap_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = divergence.log_ratios(mentions(spark, d), FIELDS).where("a + b > 0")
    w = F.col("a") + F.col("b")
    order = cells.groupBy("family").agg((F.sum(F.col("log_ratio") * w) / F.sum(w)).alias("mean_ratio"), F.median("log_ratio").alias("median_ratio"))
    cell = F.when(F.col("supported"), F.col("log_ratio"))
    return rounded(cells.join(order, "family").select("family", "year", cell.alias("cell"), "mean_ratio", "median_ratio"), "cell", "mean_ratio", "median_ratio")


@query("unpivot_metrics", """SELECT l_orderkey, l_linenumber, l_partkey, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value)""")
def unpivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    ids, values = ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(rows.unpivot(ids, values, "metric", "value"), "value", digits=6)


@query("json_props_flatten", """SELECT event_id, 'k' AS name, json_extract(props, '$.k')::BIGINT AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_props_flatten(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", F.explode(props).alias("name", "value")).where("value is not null")


@query("merge_latest_nonempty", """SELECT user_id, arg_max(event_type, event_id) FILTER (event_type IS NOT NULL AND event_type <> '') AS event_type, round(arg_max(value, event_id) FILTER (value IS NOT NULL), 6) AS value FROM events GROUP BY user_id""")
def merge_latest_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tables.latest_nonempty(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"]), "value", digits=6)


@query("keep_first", """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) WHERE r = 1""")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    first = tables.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return rounded(first.select("user_id", "event_type", "event_id", "value"), "value", digits=6)


@query("year_summary", """SELECT max(y) AS latest, min(y) AS earliest, count(DISTINCT y) AS n_years, count(*) AS n FROM (SELECT try_cast(strftime(o_orderdate, '%Y') AS INT) AS y FROM orders)""")
def year_summary(spark: SparkSession, d: str) -> DataFrame:
    y = F.date_format("o_orderdate", "yyyy").try_cast("int")
    return table(spark, d, "orders").select(y.alias("y")).agg(F.max("y").alias("latest"), F.min("y").alias("earliest"), F.count_distinct("y").alias("n_years"), F.count(F.lit(1)).alias("n"))


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- membership ---


@query("semi_flag", """SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def semi_flag(spark: SparkSession, d: str) -> DataFrame:
    return tables.member_flag(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], "labelled")


@query("anti_exclude", """SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti_exclude(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_operations", """SELECT 'both' AS part, l_partkey AS id FROM ((SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') INTERSECT (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))
UNION ALL SELECT 'only_a', l_partkey FROM ((SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    a, r = (rows.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("id")) for x in "AR")
    return a.intersect(r).select(F.lit("both").alias("part"), "id").unionByName(a.subtract(r).select(F.lit("only_a").alias("part"), "id"))


@query("zero_match_inventory", """WITH a AS (SELECT DISTINCT p_brand AS alias FROM part UNION SELECT 'Brand#' || i FROM range(90, 99) r(i)), o AS (SELECT l_orderkey AS doc, p_brand AS alias FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.alias, count(o.doc) AS n_matches, count(DISTINCT o.doc) AS n_docs FROM a LEFT JOIN o ON o.alias = a.alias GROUP BY a.alias""")
def zero_match_inventory(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("alias"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("p_partkey"))
    known = part.select("alias").union(spark.range(90, 99).select(F.concat(F.lit("Brand#"), F.col("id")))).distinct()
    return edges.inventory(known, rows.join(part, "p_partkey"))


@query("quality_flags", f"""WITH {MENTIONS}, n AS (SELECT count(DISTINCT key) AS n FROM mentions), o AS (SELECT key AS doc, family AS item, lower(right(family, 1)) AS matched FROM mentions)
SELECT 'short_match' AS flag, item, count(*) AS n FROM o WHERE length(matched) <= 3 AND matched = lower(matched) GROUP BY item
UNION ALL SELECT 'high_prevalence', item, count(DISTINCT doc) FROM o GROUP BY item HAVING count(DISTINCT doc) >= 0.1 * (SELECT n FROM n)""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    found = m.select(F.col("key").alias("doc"), F.col("family").alias("item"), F.lower(F.right("family", F.lit(1))).alias("matched"))
    return edges.quality_flags(found, m.agg(F.count_distinct("key")).first()[0], common=0.1)


# --- co-occurrence ---

_PAIRS = "pairs AS (SELECT x.doc, x.year, x.field, x.item AS source, y.item AS target FROM basket x JOIN basket y ON x.doc = y.doc AND x.item < y.item)"


@query("pair_npmi", f"""WITH {BASKET}, {_PAIRS}, t AS (SELECT count(DISTINCT doc) AS n_docs FROM basket), n AS (SELECT item, count(*) AS n FROM basket GROUP BY item),
w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc) AS w FROM pairs),
e AS (SELECT source, target, count(*) AS n_xy, sum(w) AS weight FROM w GROUP BY ALL HAVING count(*) >= 5)
SELECT source, target, n_xy, n_docs, a.n AS n_x, b.n AS n_y, round(weight, 6) AS weight, round(n_xy / (a.n + b.n - n_xy), 9) AS jaccard, round(n_xy / sqrt(a.n::DOUBLE * b.n), 9) AS cosine,
  round(ln((n_xy / n_docs) / ((a.n / n_docs) * (b.n / n_docs))) / -ln(n_xy / n_docs), 9) AS npmi
FROM e, t, n a, n b WHERE a.item = source AND b.item = target""")
def pair_npmi(spark: SparkSession, d: str) -> DataFrame:
    found = edges.association_edges(baskets(spark, d).select("doc", "item"), [])
    return rounded(found.withColumn("weight", F.round("weight", 6)), "jaccard", "cosine", "npmi")


@query("importance_edges", f"""WITH {BASKET}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}), i AS (SELECT win, doc, item FROM basket JOIN w ON year BETWEEN a AND b),
t AS (SELECT win, count(DISTINCT doc) AS n_docs FROM i GROUP BY win), n AS (SELECT win, item, count(*) AS n FROM i GROUP BY ALL),
e AS (SELECT x.win, x.item AS source, y.item AS target, count(*) AS n_xy FROM i x JOIN i y ON x.win = y.win AND x.doc = y.doc AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5)
SELECT e.win AS "window", source, target, n_xy, round(n_xy / n_docs, 9) AS prevalence, round(greatest(ln((n_xy / n_docs) / ((a.n / n_docs) * (b.n / n_docs))) / -ln(n_xy / n_docs), 0), 9) AS positive_npmi, round(n_docs / n_xy, 6) AS distance
FROM e JOIN t ON t.win = e.win JOIN n a ON a.win = e.win AND a.item = source JOIN n b ON b.win = e.win AND b.item = target""")
def importance_edges(spark: SparkSession, d: str) -> DataFrame:
    items = tables.in_windows(baskets(spark, d), WINDOWS).select("window", "doc", "item")
    found = edges.association_edges(items, ["window"])
    share = M.ratio(F.col("n_xy"), F.col("n_docs"))
    return found.select(
        "window", "source", "target", "n_xy", F.round(share, 9).alias("prevalence"),
        F.round(F.greatest("npmi", F.lit(0.0)), 9).alias("positive_npmi"), F.round(1 / share, 6).alias("distance"),
    )


@query("node_strength", f"""WITH {BASKET}, {_PAIRS}, e AS (SELECT source, target, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 5)
SELECT node, count(*) AS degree, sum(n)::BIGINT AS strength, round(ln(1 + sum(n)), 9) AS log_strength FROM (SELECT source AS node, n FROM e UNION ALL SELECT target, n FROM e) GROUP BY node""")
def node_strength(spark: SparkSession, d: str) -> DataFrame:
    found = edges.association_edges(baskets(spark, d).select("doc", "item"), [])
    return rounded(edges.strengths(found, [], "n_xy"), "log_strength")


@query("pair_brokerage", f"""WITH {BASKET}, {_PAIRS}, t AS (SELECT count(DISTINCT doc) FILTER (field = 'AUTOMOBILE') AS da, count(DISTINCT doc) FILTER (field = 'BUILDING') AS db FROM basket WHERE {TWO}),
e AS (SELECT source, target, count(*) AS n, count(*) FILTER (field = 'AUTOMOBILE') AS n_a, count(*) FILTER (field = 'BUILDING') AS n_b FROM pairs WHERE {TWO} GROUP BY ALL HAVING count(*) >= 5)
SELECT source, target, n, n_a, n_b, round(CASE WHEN n_a > 0 AND n_b > 0 THEN 2 * (n_a / da) * (n_b / db) / (n_a / da + n_b / db) ELSE 0 END, 9) AS shared,
  round((greatest(least(log10(((n_b + 0.5) / (db + 1)) / ((n_a + 0.5) / (da + 1))), 1), -1) + 1) / 2, 9) AS orientation, round(2 / (n_a / da + n_b / db), 6) AS distance FROM e, t""")
def pair_brokerage(spark: SparkSession, d: str) -> DataFrame:
    items = baskets(spark, d).where(F.col("field").isin(*FIELDS))
    found = edges.brokerage_edges(items, FIELDS, []).withColumn("distance", F.round("distance", 6))
    return rounded(found.drop("docs_a", "docs_b"), "shared", "orientation")


@query("participation_entropy", f"""WITH {MENTIONS}, w AS (SELECT family, field, count(*) AS w FROM mentions GROUP BY ALL), s AS (SELECT *, w / sum(w) OVER (PARTITION BY family) AS s FROM w)
SELECT family, count(*) AS n_domains, round(1 - sum(s * s), 9) AS participation, round(CASE WHEN count(*) > 1 THEN (1 - sum(s * s)) * count(*) / (count(*) - 1) ELSE 0 END, 9) AS scaled_participation,
  round(CASE WHEN count(*) > 1 THEN sum(-s * ln(s)) / ln(count(*)) ELSE 0 END, 9) AS entropy FROM s GROUP BY family""")
def participation_entropy(spark: SparkSession, d: str) -> DataFrame:
    links = mentions(spark, d).select("family", "field", F.lit(1.0).alias("w1"))
    return rounded(edges.participation(links, [], "family", "field", "w1"), "participation", "scaled_participation", "entropy")


@query("prominence_paired", f"""WITH {MENTIONS}, w(win, a, b) AS (VALUES {_WINDOW_ROWS}),
n AS (SELECT win, family, count(*) FILTER (field = 'AUTOMOBILE') AS n_a, count(*) FILTER (field = 'BUILDING') AS n_b FROM mentions JOIN w ON year BETWEEN a AND b WHERE {TWO} GROUP BY ALL),
t AS (SELECT win, count(*) FILTER (field = 'AUTOMOBILE') AS p_a, count(*) FILTER (field = 'BUILDING') AS p_b FROM papers JOIN w ON year BETWEEN a AND b GROUP BY win),
q AS (SELECT n.*, p_a, p_b, ((n_b + 0.5) / (p_b + 1)) / ((n_a + 0.5) / (p_a + 1)) AS q FROM n JOIN t ON t.win = n.win)
SELECT win AS "window", family, n_a, n_b, round(log2(q), 9) AS log2_ratio, round((greatest(least(log10(q), 1), -1) + 1) / 2, 9) AS orientation,
  round(CASE WHEN n_a > 0 AND n_b > 0 THEN 2 * (n_a / p_a) * (n_b / p_b) / (n_a / p_a + n_b / p_b) ELSE 0 END, 9) AS shared,
  round((n_b + 0.5) * (p_a - n_a + 0.5) / ((p_b - n_b + 0.5) * (n_a + 0.5)), 9) AS odds_ratio FROM q""")
def prominence_paired(spark: SparkSession, d: str) -> DataFrame:
    m = tables.in_windows(mentions(spark, d).where(F.col("field").isin(*FIELDS)), WINDOWS)
    p = tables.in_windows(papers(spark, d), WINDOWS)
    found = edges.prominence(m, p, FIELDS, ["window"])
    return rounded(found.select("window", "family", "n_a", "n_b", "log2_ratio", "orientation", "shared", "odds_ratio"), "log2_ratio", "orientation", "shared", "odds_ratio")


@query("visual_scaling", f"""WITH {BASKET}, {_PAIRS}, e AS (SELECT source, target, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 5)
SELECT source, target, n, round((ln(1 + n) - min(ln(1 + n)) OVER ()) / (max(ln(1 + n)) OVER () - min(ln(1 + n)) OVER ()), 9) AS scaled FROM e""")
def visual_scaling(spark: SparkSession, d: str) -> DataFrame:
    found = edges.association_edges(baskets(spark, d).select("doc", "item"), []).select("source", "target", F.col("n_xy").alias("n"), F.lit(1).alias("g"))
    return rounded(edges.scaled(found, "n", ["g"], "log1p").drop("g"), "scaled")


# --- terms ---


def _term_docs(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("text", "[^\\x00-\\x7F]", " ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", "lang", lexical.tokens(plain).alias("words"))


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_counts(_term_docs(spark, d), F.col("words"), ["lang"])


@query("term_yearly_dense", f"""WITH {WORDS}, y AS (SELECT term, lang, (doc_id % 5)::INT AS bucket FROM tf), n AS (SELECT lang, (doc_id % 5)::INT AS bucket, count(*) AS n_papers FROM documents GROUP BY ALL),
keep AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 50), c AS (SELECT term, lang, bucket, count(*) AS n_kw FROM y WHERE term IN (SELECT term FROM keep) GROUP BY ALL),
g AS (SELECT * FROM keep CROSS JOIN (SELECT DISTINCT lang, bucket FROM c))
SELECT g.term, g.lang, g.bucket, coalesce(n_kw, 0) AS n_kw, n_papers, round(coalesce(n_kw, 0) / n_papers, 9) AS rate FROM g LEFT JOIN c ON c.term = g.term AND c.lang = g.lang AND c.bucket = g.bucket JOIN n ON n.lang = g.lang AND n.bucket = g.bucket""")
def term_yearly_dense(spark: SparkSession, d: str) -> DataFrame:
    counts = lexical.gated(_term_counts(spark, d), 1, 50, float("inf"))
    bucket = F.pmod("doc_id", F.lit(5)).cast("int").alias("bucket")
    n_kw = counts.groupBy("term", "lang", bucket).agg(F.count(F.lit(1)).alias("n_kw"))
    sizes = table(spark, d, "documents").groupBy("lang", bucket).agg(F.count(F.lit(1)).alias("n_papers"))
    grid = tables.dense_grid(n_kw, ["term"], ["lang", "bucket"], ["n_kw"])
    return grid.join(F.broadcast(sizes), ["lang", "bucket"]).withColumn("rate", F.round(M.ratio(F.col("n_kw"), F.col("n_papers")), 9))  # a row a cell


@query("keyness", f"""WITH {WORDS}, s AS (SELECT count(*) FILTER (lang = 'en') AS n_a, count(*) FILTER (lang = 'de') AS n_b FROM documents WHERE text IS NOT NULL),
k AS (SELECT term, count(*) FILTER (lang = 'en') AS df_a, count(*) FILTER (lang = 'de') AS df_b FROM tf WHERE lang IN ('en', 'de') GROUP BY term),
p AS (SELECT *, (df_a + 0.5) / (n_a + 1.0::DOUBLE) AS p_a, (df_b + 0.5) / (n_b + 1.0::DOUBLE) AS p_b FROM k, s)
SELECT term, df_a, df_b, df_a + df_b AS total_df, round(p_a, 9) AS p_a, round(p_b, 9) AS p_b, round(log2((p_a / (1 - p_a)) / (p_b / (1 - p_b))), 9) AS log_odds_a,
  round(-log2((p_a / (1 - p_a)) / (p_b / (1 - p_b))), 9) AS log_odds_b, round(abs(log2((p_a / (1 - p_a)) / (p_b / (1 - p_b)))) * ln(1 + df_a + df_b), 9) AS salience FROM p""")
def keyness(spark: SparkSession, d: str) -> DataFrame:
    sizes = {r["lang"]: r["n"] for r in table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = lexical.keyness(_term_counts(spark, d), sizes, "lang", ("en", "de"))
    return rounded(found, "p_a", "p_b", "log_odds_a", "log_odds_b", "salience")


@query("tfidf_salience", f"""WITH {WORDS}, n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT lang, count(*) AS ng FROM documents WHERE text IS NOT NULL GROUP BY lang),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.35 * (SELECT n FROM n)),
r AS (SELECT doc_id, lang, tf.term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS raw FROM tf JOIN df ON df.term = tf.term, n),
w AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM r),
g AS (SELECT lang, term, sum(w) AS si FROM w GROUP BY ALL), a AS (SELECT term, sum(w) AS sa FROM w GROUP BY term),
m AS (SELECT g.lang, g.term, si / ng AS mean_in, (sa - si) / greatest(n - ng, 1) AS mean_out FROM g JOIN a ON a.term = g.term JOIN s ON s.lang = g.lang, n),
o AS (SELECT *, mean_in - mean_out AS sal, row_number() OVER (PARTITION BY lang ORDER BY round(mean_in - mean_out, 12) DESC, term) AS rank FROM m WHERE mean_in - mean_out > 0)
SELECT lang, rank, term, round(mean_in, 9) AS mean_in, round(mean_out, 9) + 0.0::DOUBLE AS mean_out, round(sal, 9) AS salience FROM o WHERE rank <= 25""")
def tfidf_salience(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = docs.count()
    weighted = lexical.tfidf(lexical.gated(_term_counts(spark, d), n, 5, 0.35), n)
    return rounded(lexical.salience(weighted, sizes, "lang"), "mean_in", "mean_out", "salience")


@query("lexical_jsd", f"""WITH {WORDS}, sc AS (SELECT 'all' AS scope, lang, term FROM tf UNION ALL SELECT 'short_left_out', lang, term FROM tf WHERE length(term) > 3),
counts AS (SELECT scope, term, count(*) FILTER (lang = 'en')::DOUBLE AS a, count(*) FILTER (lang = 'fr')::DOUBLE AS b FROM sc WHERE lang IN ('en', 'fr') GROUP BY ALL),
shares AS (SELECT *, a / sum(a) OVER (PARTITION BY scope) AS p, b / sum(b) OVER (PARTITION BY scope) AS q FROM counts)
SELECT scope, count(*) AS n_terms, round({JSD}, 9) AS jsd FROM shares GROUP BY scope""")
def lexical_jsd(spark: SparkSession, d: str) -> DataFrame:
    scope = F.explode(F.when(F.length("term") > 3, F.array(F.lit("all"), F.lit("short_left_out"))).otherwise(F.array(F.lit("all"))))
    rows = _term_counts(spark, d).select(F.col("lang").alias("field"), F.col("term").alias("family"), scope.alias("scope"))
    shares = divergence.field_shares(rows, ("en", "fr"), ["scope"])
    return rounded(divergence.distances(shares, ["scope"]).select("scope", "jsd"), "jsd").join(shares.groupBy("scope").agg(F.count(F.lit(1)).alias("n_terms")), "scope")


@query("bigrams", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[a-z]{2,}') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM b GROUP BY term HAVING count(DISTINCT doc_id) >= 5""")
def bigrams(spark: SparkSession, d: str) -> DataFrame:
    counts = lexical.term_counts(_term_docs(spark, d), lexical.bigrams(F.col("words")), [])
    return counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).where("df >= 5")


# --- scoring, text and vectors ---


@query("cube_breakdown", """WITH t AS (SELECT lang, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE coalesce(lang, 'missing') END AS lang, CASE WHEN grouping(quality) = 1 THEN 'all' ELSE coalesce(quality::VARCHAR, 'missing') END AS quality, count(*) AS n, sum(toxic)::BIGINT AS n_toxic FROM t GROUP BY CUBE (lang, quality)""")
def cube_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return tables.cube_counts(rows, ["lang", "quality"], [F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic")])


@query("label_scores", """WITH t AS (SELECT lang, quality = 1 AS gold, n_chars >= 500 AS pred FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT lang, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp, count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn FROM t GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(fn / nullif(tp + fn, 0), 9) AS false_negative_rate FROM c""")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(sampling.document_scores(rows, F.col("quality") == 1, F.col("n_chars") >= 500, ["lang"]), "precision", "recall", "f1", "false_negative_rate")


@query("family_scores", f"""WITH {MENTIONS}, g AS (SELECT key, year, list(DISTINCT family) AS gold FROM mentions GROUP BY ALL),
p AS (SELECT DISTINCT l_orderkey AS key, p_brand AS family FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 10), q AS (SELECT key, list(family) AS pred FROM p GROUP BY key),
c AS (SELECT year, sum(len(list_intersect(gold, coalesce(pred, [])))) ::BIGINT AS tp, sum(len(coalesce(pred, [])) - len(list_intersect(gold, coalesce(pred, []))))::BIGINT AS fp, sum(len(gold) - len(list_intersect(gold, coalesce(pred, []))))::BIGINT AS fn
  FROM g LEFT JOIN q ON q.key = g.key GROUP BY year)
SELECT year, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(fn / nullif(tp + fn, 0), 9) AS false_negative_rate FROM c""")
def family_scores(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    predicted = table(spark, d, "lineitem").where("l_quantity > 10").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set("p_brand").alias("pred"))
    gold = mentions(spark, d).groupBy("key", "year").agg(F.collect_set("family").alias("gold"))
    both = gold.join(predicted, "key", "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<string>")))
    return rounded(sampling.set_scores(both, "gold", "pred", ["year"]), "precision", "recall", "f1", "false_negative_rate")


@query("stratified_sample", f"""WITH {PAPERS} SELECT field, year, key, place FROM (SELECT *, row_number() OVER (PARTITION BY field, year ORDER BY md5(concat_ws(chr(31), coalesce(key::VARCHAR, ''), '7'))) AS place FROM papers) WHERE place <= 10""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = papers(spark, d).withColumn("seed", F.lit("7"))
    return sampling.stratified(rows, ["field", "year"], sampling.hash_order("key", "seed"), 10).select("field", "year", "key", "place")


@query("design_hash", f"""WITH {PAPERS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, year ORDER BY md5(concat_ws(chr(31), coalesce(key::VARCHAR, ''), '7'))) AS place FROM papers) WHERE place <= 10),
r AS (SELECT year, key, sha256(concat_ws('|', key::VARCHAR, field, doctype)) AS h FROM s)
SELECT year, sha256(string_agg(h, '' ORDER BY key)) AS design FROM r GROUP BY year""")
def design_hash(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a sampling design: the rows of the sample, at most ten a field and year."""
    rows = papers(spark, d).withColumn("seed", F.lit("7"))
    drawn = sampling.stratified(rows, ["field", "year"], sampling.hash_order("key", "seed"), 10)
    row = F.sha2(F.concat_ws("|", F.col("key").cast("string"), "field", "doctype"), 256)
    ordered = F.array_sort(F.collect_list(F.struct("key", row.alias("h"))))
    return drawn.groupBy("year").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("design"))


@query("html_strip", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", M.strip_tags(F.col("html")).alias("text"))


@query("slugs", r"""SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ν', 'nu'), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM documents WHERE text IS NOT NULL)""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", M.slug(F.col("text")).alias("slug"))


@query("url_parts", r"""SELECT page_id, nullif(regexp_extract(url, '://([^/?#]+)', 1), '') AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", part("://([^/?#]+)").alias("host"), part("/([0-9]+)").alias("number"))


@query("embedding_cosine", """SELECT a.vec_id AS source, b.vec_id AS target, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"), F.col("vec_id").alias("target"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    distance = 1 - dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))
    return rows.join(after, "vec_id").select(F.col("vec_id").alias("source"), "target", F.round(distance, 6).alias("distance"))


# --- inputs and data behind figures ---


@query("abstract_gates", r"""SELECT doc_id, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, len(regexp_extract_all(text, '\d+')) AS n_numbers FROM documents
WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) BETWEEN 12 AND 1200""")
def abstract_gates(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    rows = table(spark, d, "documents").select("doc_id", "lang", n("[^\\x20\\x09-\\x0D]+").alias("n_words"), n("[0-9]+").alias("n_numbers"))
    return rows.where(F.col("n_words").between(12, 1200))


@query("keyness_input", f"""WITH {PAPERS}, {CLASSES}, f AS (SELECT key, lower(trim(min_by(cls, pos))) AS field FROM classes GROUP BY key)
SELECT p.year, f.field, count(*) AS n FROM papers p LEFT JOIN f ON f.key = p.key WHERE p.year BETWEEN 1996 AND 2001 AND f.field IN ('a', 'r') GROUP BY ALL""")
def keyness_input(spark: SparkSession, d: str) -> DataFrame:
    primary = classify.per_paper(classes(spark, d)).select("key", F.lower(F.trim("primary")).alias("primary"))
    rows = papers(spark, d).select("key", "year").where(F.col("year").between(1996, 2001)).join(primary, "key", "left")
    return rows.where(F.col("primary").isin("a", "r")).groupBy("year", F.col("primary").alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query("yearly_volume", f"""WITH {PAPERS} SELECT year, count(*) AS n_papers, count(doctype) AS n_typed, count(DISTINCT field) AS n_fields FROM papers WHERE year >= 1996 GROUP BY year""")
def yearly_volume(spark: SparkSession, d: str) -> DataFrame:
    rows = papers(spark, d).where("year >= 1996")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"), F.count("doctype").alias("n_typed"), F.count_distinct("field").alias("n_fields"))


@query("recent_field_share", f"""WITH {PAPERS}, n AS (SELECT year, CASE field WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Houses' ELSE 'Other' END AS label, count(*) AS n FROM papers WHERE year BETWEEN 1998 AND 2001 GROUP BY ALL)
SELECT year, label, n, round(n / sum(n) OVER (PARTITION BY year), 9) AS share, round(100 * n / sum(n) OVER (PARTITION BY year), 1) AS percent FROM n""")
def recent_field_share(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("field") == "AUTOMOBILE", "Cars").when(F.col("field") == "BUILDING", "Houses").otherwise("Other")
    n = papers(spark, d).where(F.col("year").between(1998, 2001)).groupBy("year", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    shares = divergence.share_of(n, ["year"], "n")
    return rounded(shares.withColumn("percent", F.round(100 * F.col("share"), 1)), "share")


@query("distances_long", f"""WITH {SHARES}, y AS (SELECT year, round({JSD}, 9) AS jsd, round(sum(abs(p - q)) / 2, 9) AS tv, sum(a) AS total_a, sum(b) AS total_b FROM shares GROUP BY year)
SELECT year, measure, value FROM (UNPIVOT y ON jsd, tv, total_a, total_b INTO NAME measure VALUE value)""")
def distances_long(spark: SparkSession, d: str) -> DataFrame:
    yearly = divergence.distances(divergence.field_shares(mentions(spark, d), FIELDS, ["year"]), ["year"])
    return rounded(yearly.unpivot("year", ["jsd", "tv", "total_a", "total_b"], "measure", "value"), "value")


@query("family_counts", f"""WITH {MENTIONS} SELECT family, count(*) AS n_mentions, count(DISTINCT key) AS n_papers, min(year) AS first_year, max(year) AS last_year FROM mentions WHERE family <> 'Brand#2' GROUP BY family""")
def family_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d).where("family <> 'Brand#2'")
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("key").alias("n_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("snippets", """SELECT doc_id, instr(text, 'worthless') - 1 AS start, substr(text, greatest(instr(text, 'worthless') - 30, 1), least(instr(text, 'worthless') + 38, length(text)) - greatest(instr(text, 'worthless') - 31, 0)) AS snippet
FROM documents WHERE instr(text, 'worthless') > 0""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("start", (F.instr("text", "worthless") - 1).cast("long")).where("start >= 0")
    at = F.col("start").cast("int")
    return rows.select("doc_id", "start", M.snippet(F.col("text"), at, at + len("worthless")).alias("snippet"))


@query("completeness", """SELECT 'lang' AS "column", count(*) AS n_rows, count(*) FILTER (trim(lang) <> '') AS n_filled FROM documents
UNION ALL SELECT 'text', count(*), count(*) FILTER (trim(text) <> '') FROM documents""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return sampling.completeness(table(spark, d, "documents"), ["lang", "text"])
