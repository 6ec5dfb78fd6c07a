import random

import pytest

from corpusloom.llm.mixing import mix_documents, mix_sources


def waterfill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "d", None, "é"]) if i % 3 else "hot", " ".join(["w"] * rng.randint(0, 60)), "s") for i in range(900)]
    rows += [(1000, "tiny", "one", "s"), (1001, "none", None, "s"), (None, "b", "x y z", "s"), (5, "b", "again", "s")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, target string").cache()


def test_targets_and_taken(spark, docs):
    got = mix_sources(docs).toPandas()
    text = docs.toPandas()
    assert len(got) == len(text) and sorted(got["size"]) == sorted(len((t or "").split()) for t in text["text"])
    sizes = {None if s is None else s: 0 for s in text["source"]}
    for s, t in zip(text["source"], text["text"]):
        sizes[s] += len((t or "").split())
    want = waterfill(sizes)
    assert sorted({(int(a), round(b, 6)) for a, b in zip(got["source_size"], got["target"])}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for (size, target), part in got.groupby(["source_size", "target"]):
        n = sum(sizes[s] == size and round(want[s], 6) == round(target, 6) for s in sizes)
        assert abs(part["taken"].sum() - n * target) <= n * part["size"].max()
    assert got.sort_values(["doc_id", "size"]).reset_index(drop=True).equals(mix_sources(docs.repartition(5)).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True))


def test_documents_are_repeated(spark, docs):
    times = mix_sources(docs).where("size > 0").groupBy("doc_id", "size").sum("copies").toPandas()
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("size(split(trim(text), ' ')) > 0 and text <> ''").count() == times["sum(copies)"].sum()


def test_empty_and_wordless(spark, docs):
    assert mix_sources(docs.where("false")).count() == 0 and mix_documents(docs.where("false")).count() == 0
    got = mix_sources(docs.where("source = 'none'")).first()
    assert (got.size, got.source_size, got.target, got.taken) == (0, 0, 0.0, 0) if not callable(got.size) else (got["size"], got["source_size"], got["target"], got["taken"]) == (0, 0, 0.0, 0)


def test_repeated_and_null_ids_meet_the_target(spark):
    """A source of rows that share an id, one of rows without any, and one of rows that are all the same."""
    rows = [(7, "a", f"word {i} " * 5, "s") for i in range(400)] + [(None, "b", f"text {i} " * 5, "s") for i in range(400)] + [(8, "c", "the same four words", "s")] * 400
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    got = mix_sources(df).toPandas()
    for _, part in got.groupby("target"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 60  # 256 hash places for about 400 rows
    assert got.groupby("target")["taken"].sum().tolist() == mix_sources(df).toPandas().groupby("target")["taken"].sum().tolist()
