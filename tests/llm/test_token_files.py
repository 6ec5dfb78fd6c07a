import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusloom.llm import token_files
from corpusloom.llm.token_files import EliasFano, Shard, WordEncoder, token_table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b\tc", "x \n y", "<|endoftext|> z", "naïve Straße ½", "中文 字 \U0001f600", "can't we'll 123 4567", "  a  b", "a" * 3000, "\n\n", "w\n w2\n\nw3 w4"]


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9], list(np.cumsum(np.random.default_rng(0).integers(0, 5000, 3000))), [2**40, 2**40 + 1]])
def test_elias_fano(values):
    ef = EliasFano.build(np.array(values, np.uint64))
    assert ef.values().tolist() == list(values)
    assert [ef.select(i) for i in range(len(values))] == list(values)
    with pytest.raises(IndexError):
        ef.select(len(values))
    if len(values) > 1000:
        assert ef.low.nbytes + ef.high.nbytes + ef.samples.nbytes < 2.5 * len(values)


def test_encoder_is_the_library(tmp_path):
    encoder = WordEncoder(PATH)
    rng = random.Random(1)
    words = ["the", "and", "thereof", "don't", "x\ny", "über", "1,234.5", "—", "\tt", "", "a.\nB", "end.", "(x)", "straße!?", "Привет,", "l'été", "x's", "a-b", "ǅ", "日本語", "e\u0301", "٣", "\u00a0b", "x\x1c", "_a_", "end.\nNext", "x\nY.", "x.\n\nY", "q'\ns", "a\n1"]
    texts = ODD + [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for limit in (1000, 1000, 3, 3):
        encoder.words.limit = limit
        ids, counts = encoder.encode(pa.array(texts), 7)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [x + [7] for x in want]
    ids, counts = encoder.encode(pa.array([], pa.string()), 7)
    assert len(ids) == len(counts) == 0


def test_table(spark):
    texts = {5: "second text", 2: ODD[8], 9: None, 1: "", 3: "long " * 20000}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, start string, n_tokens int")
    rows = token_table(df, PATH).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    start, encoder = 0, WordEncoder(PATH)
    for r in rows:
        ids = encoder.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        shard = Shard(r.shard_path)
        assert shard.ids(shard.end(r.position - 1), shard.end(r.position)).tolist() == ids and shard.doc_id(r.position) == r.doc_id
        start += len(ids)


def test_table_edges(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string")
    rows = token_table(df, PATH).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 1, None, None] and rows[0].ids_crc32 == rows[1].ids_crc32
    assert token_table(df.where("false"), PATH).count() == 0


def test_shards_roll_and_hot_ids(spark, monkeypatch):
    """One id for most rows, negative and huge ids, and shards of a few documents each."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    ids = [-(2**62), -5, *[7] * 300, 2**62, *[None] * 100]
    df = spark.createDataFrame([(k, f"text number {i % 150} " * 20) for i, k in enumerate(ids)], "doc_id long, text string")
    rows = token_table(df, PATH, batch_bytes=3000).orderBy("start").collect()
    assert [r.doc_id for r in rows] == ids and len({r.shard_path for r in rows}) > 10
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_query_reads_by_select(spark, monkeypatch):
    """Files written well and a broken select give no result that looks right."""
    rows = [(i, "some words " * i) for i in range(20)]
    folder = token_files.fresh_path(spark, "test-shards")
    manifest = token_files.encode_to_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, folder).collect()
    shard = Shard(manifest[0].path)
    good = [shard.end(i) for i in range(shard.n)]
    monkeypatch.setattr(EliasFano, "select", lambda self, i: i)
    assert [shard.end(i) for i in range(shard.n)] != good and shard.ends.values().tolist() == good
