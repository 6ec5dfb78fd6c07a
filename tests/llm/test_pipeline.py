"""The pipeline on a small corpus whose right answers are planted."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.near_dedup import near_dedup

WORDS = {"en": "the and with from that house street water there come some time year".split(), "de": "der die und mit haus straße wasser für über nicht auch jahr".split()}
BANNER = "please accept all cookies before you read on"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "de"])
        text = "\n".join(" ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(20)) for _ in range(3))
        rows.append([i, text, lang, f"src{i % 7}"])
    for i in range(40):
        rows[i][1] += "\n" + BANNER
    for k in range(6):
        rows.append([300 + k, rows[100][1] + f" end{k}", rows[100][2], "src1"])
    rows += [[400, "12 34 !!", "en", "src1"], [401, None, "en", "src2"], [402, rows[7][1].replace("\n" + BANNER, ""), "de" if rows[7][2] == "en" else "en", "src3"]]
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{folder}/documents.parquet")
    return str(folder), {r[0]: r for r in rows}


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder).cache()
        assert set(after.columns) == set(corpus_pipeline.COLUMNS)
        seen[name] = after
        docs = after
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert set(rows) - ids["language ID"] == {400, 401, 402}
    lines = {r.doc_id: r for r in seen["line dedup"].collect()}
    assert ids["line dedup"] == ids["language ID"] and sum(BANNER in r.text for r in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert ids["line dedup"] - ids["MinHash near-dedup"] == {300, 301, 302, 303, 304, 305}
    assert near_dedup(seen["MinHash near-dedup"], 5, 80, 100).where("not kept").count() == 0
    mixed = seen["mixing sources to target weights"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 3 and {r.doc_id for r in mixed} <= ids["MinHash near-dedup"]


def test_run(spark, corpus):
    folder, rows = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.round_trip and r.n_differing == 0 for r in out)
    reference = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    untouched = [r for r in out if 40 <= r.doc_id < 300 and r.doc_id != 100]
    assert untouched and all(r.pieces == reference.encode(rows[r.doc_id][1]) for r in untouched)


def test_odd_rows_and_empty_tables(spark):
    """Nulls in every column, repeated ids and rows, clashing extra columns, and no rows at all, stage by stage."""
    good = "the and with from that house street water there come some time year"
    rows = [(1, good, "en", "a", 60), (1, good, "en", "a", 60), (1, f"{good} {good} other words here", "en", None, None), (None, f"some {good}", None, "b", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "1 2", "en", "a", 3)]
    rows += [(10 + i, f"{good} number {i} " * 9, "en", f"s{i % 3}", 5) for i in range(9)]
    extra = "n_lines int, kept int, score int, pieces int, text_hash int, copies int, source_size int, row int"
    df = spark.createDataFrame([(*r, *[0] * 8) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for table in (df, df.where("false")):
        sizes = []
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, "").cache()
            sizes.append(table.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert table.columns == list(corpus_pipeline.COLUMNS)
                table = table.select("*", *[F.lit(0).alias(x.split()[0]) for x in extra.split(", ")])
        assert sizes[0] == sizes[1] == (13 if sizes[0] else 0) and (sizes[4] > 0) == (sizes[0] > 0)
