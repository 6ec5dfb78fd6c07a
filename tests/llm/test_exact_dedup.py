import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import chunks, exact_dedup, normalised


def brute(rows):
    out, groups = [], {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\f\r"), []).append((-len(t or ""), i is None, i or 0, i))
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
        best = min(groups[norm])
        out.append((i, best[3], len(groups[norm]), i == best[3] and -len(t or "") == best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **k):
    return sorted((tuple(r) for r in exact_dedup(df, **k).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    long = "".join(rng.choice("ab c.\n") for _ in range(30000))
    texts = ["x y", "xy", " x\ty ", None, "", "   ", "é a", "éa", long, long.replace(" ", "  "), long[:-1] + "z", "Z" * 9000, "Z" * 9001, "\U0001f600."]
    return [(i * 3 % 17, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark, rows):
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeats_nulls_and_clashing_names(spark):
    rows = [(1, "a"), (1, "a"), (None, "a "), (2, "a"), (None, None)]
    df = spark.createDataFrame([(*r, 0, True, "s") for r in rows], "doc_id long, text string, keep_id int, kept boolean, recipe string")
    assert got(df) == brute(rows)
    assert exact_dedup(df.where("false")).count() == 0


def test_colliding_identifiers_are_found(spark, rows):
    weak = lambda c: F.length(c).cast("long")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, identifiers=(weak, lambda c: F.sha2(c, 256))) == brute(rows)
    with pytest.raises(ValueError):
        exact_dedup(df, identifiers=(weak,))


def test_chunks_are_content_defined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").select(normalised(F.col("text")).alias("n"))
    for r in df.select("n", chunks(F.col("n")).alias("c")).collect():
        assert "".join(r.c) == r.n and all(len(x) <= 4096 for x in r.c)
    body = "".join(f"Sentence{i}withsomelength{'y' * 30}." for i in range(200))
    two = spark.createDataFrame([(body,), ("Newstart." + body,)], "n string").select(chunks(F.col("n")).alias("c")).collect()
    assert len(set(two[0].c) & set(two[1].c)) > len(two[0].c) / 2
