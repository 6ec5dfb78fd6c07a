import pytest

from corpusloom.llm.line_dedup import line_dedup, lines_of, spread_lines

LONG = "accept all our cookies and terms please"


def test_boilerplate_goes(spark):
    rows = [(10 + i, f"own line number {i} of this text\n{LONG} \nshort\n\n  {LONG}", f"s{i % 6}") for i in range(12)]
    rows += [(1, None, "s1"), (2, "", "s2"), (3, f"seen\n{LONG}", None), (None, LONG, "s3"), (10, rows[0][1], "s0")]
    df = spark.createDataFrame([(*r, "en", 7) for r in rows], "doc_id long, text string, source string, lang string, n_lines int")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "source", "lang", "n_lines", "n_removed"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert by[3].text == f"seen\n{LONG}" and by[3].n_removed == 0
    assert by[10].text == "own line number 0 of this text\nshort\n" and by[10].n_removed == 2 and by[10].n_lines == 5
    assert by[None].text == "" and by[1].text is None and by[2].text == "" and by[1].n_lines == 0
    assert line_dedup(df.where("false")).count() == 0


def test_first_document_keeps_its_first(spark):
    rows = [(i, f"{LONG}\n{LONG}\nx", f"s{i}") for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {0: f"{LONG}\nx"} | dict.fromkeys(range(1, 5), "x")
    four = spark.createDataFrame(rows[:4], "doc_id long, text string, source string")
    assert line_dedup(four).where("n_removed > 0").count() == 0


@pytest.mark.parametrize("limit", [3, 40])
def test_spread_is_exact(spark, limit):
    rows = [(d, f"this is the line number {n}", f"s{d % n}") for n in (2, 3, 4, 30, 39, 40, 41, 80) for d in range(2 * n)]
    lines = lines_of(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "source", "text", 5)
    assert spread_lines(lines, limit, 1000).count() == sum(n >= limit for n in (2, 3, 4, 30, 39, 40, 41, 80))
    short = lines_of(spark.createDataFrame([(d, f"line {n}", s) for d, n, s in [(r[0], r[1].split()[-1], r[2]) for r in rows]], "doc_id long, text string, source string"), "doc_id", "source", "text", 5)
    assert spread_lines(short, 2, limit).count() == sum(n >= limit for n in (2, 3, 4, 30, 39, 40, 41, 80))


def test_short_lines_need_more_sites(spark):
    rows = [(i, f"All rights reserved.\n \nOn nine sites.\nown text of number {i}", f"s{i}") for i in range(9)] + [(9, "All rights reserved.", "s9")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == rows[0][1] and got[9] == "" and got[4] == " \nOn nine sites.\nown text of number 4"


def test_a_very_long_text_of_boilerplate(spark):
    """200,000 lines, most of them removed, in time that grows with the lines."""
    lines = [f"line number {i} of a long imprint" for i in range(100)]
    rows = [(i, "\n".join(lines), f"s{i}") for i in range(6)] + [(10, "\n".join(lines * 2000 + ["the end"]), "s1")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[10].text == "the end" and got[10].n_removed == 200_000 and got[0].n_removed == 0
