import random

import numpy as np
import pytest

from corpusloom.llm.langid import Model, held_out, identify, normalised, presence, train

WORDS = {"aa": "the and with from that house street water".split(), "bb": "der die und mit haus straße wasser für".split(), "cc": "les une avec maison rue été où".split()}


def sample(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang := rng.choice(list(WORDS))], k=rng.randint(5, 60))), lang) for i in range(n)]


def test_kernel_is_the_blended_spectrum():
    texts = ["abcab, x", "bcab", "", "ÄB!"]
    phi = normalised(presence(texts)[0])

    def grams(t, n):
        padded = "".join(c if c.isalpha() else " " for c in t.lower())
        import re

        s = re.sub(" +", " ", padded + " ")
        return {s[i : i + n] for i in range(len(s) - n + 1)}

    got = phi @ phi.T
    for i in (0, 1):
        for j in (0, 1):
            want = np.mean([len(grams(texts[i], n) & grams(texts[j], n)) / np.sqrt(len(grams(texts[i], n)) * len(grams(texts[j], n))) for n in (1, 2, 3)])
            assert got[i, j] == pytest.approx(want, abs=1e-6)
    assert list(presence(texts)[1]) == [True, True, False, True]


def test_held_out_accuracy_and_edges(spark):
    rows = [*sample(900), (5000, None, "aa"), (5001, "123 !?", "bb"), (5002, "the and " * 40000, None), (None, "und die straße", "bb"), (5003, "\U00010400\U00010401", "cc")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = identify(df, keep=("score",)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "held_out", "lang_pred", "score", "score"]
    true = {r[0]: r[2] for r in rows[:900]}
    test = got[got["held_out"] & got["doc_id"].isin(true)]
    assert 0.15 < len(test) / 900 < 0.35
    assert np.mean([true[d] == p for d, p in zip(test["doc_id"], test["lang_pred"])]) > 0.98
    by = dict(zip(got["doc_id"], got["lang_pred"]))
    assert by[5000] == by[5001] == "und" and by[5002] == "aa" and by[5003] != "und"
    assert got["score"].iloc[:, 0].between(0, 1).all()


def test_labels_of_held_out_rows_dont_matter(spark):
    df = spark.createDataFrame(sample(300), "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    changed = df.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = (identify(x).toPandas().sort_values("doc_id").reset_index(drop=True) for x in (df, changed))
    assert a.equals(b)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(df).first().lang_pred == "und" and identify(df.where("false")).count() == 0
    assert Model([], np.zeros((5, 0), np.float32)).languages == []


def test_hashed_kernel_of_long_texts():
    """20,000 words: the bucketed kernel with other texts is off by its collisions, but the own language still leads."""
    rng = random.Random(4)
    long = {lang: " ".join(rng.choices([a + b for a in words for b in words], k=20_000)) for lang, words in WORDS.items()}
    short = {lang: " ".join(rng.choices(words, k=30)) for lang, words in WORDS.items()}
    phi = normalised(presence([*long.values(), *short.values()])[0])
    kernel = phi[:3] @ phi[3:].T

    def grams(t, n):
        s = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        return {s[i : i + n] for i in range(len(s) - n + 1)}

    for i, a in enumerate(long.values()):
        for j, b in enumerate(short.values()):
            exact = np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2, 3)])
            assert abs(kernel[i, j] - exact) < 0.05
    assert (kernel.argmax(axis=0) == np.arange(3)).all()


def test_regression_against_a_dense_solve():
    """With all texts as landmarks, Nystroem is the whole kernel: alpha from the kernel matrix gives the same scores."""
    rows = sample(120, 3)
    bits, _ = presence([t for _, t, _ in rows])
    labels = [lang for *_, lang in rows]
    model = Model.fit(np.packbits(bits, axis=1), labels, landmarks=1000, ridge=1e-2)
    phi = normalised(bits).astype(float)
    kernel, names = phi @ phi.T, sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    goal, balance = np.where(y[:, None] == np.arange(3), 1.0, -1.0), 1.0 / np.bincount(y)[y]
    order = np.concatenate([np.flatnonzero(y == k) for k in range(3)])
    alpha = np.linalg.lstsq(balance[:, None] * kernel + 3e-2 * np.eye(len(y)), balance[:, None] * goal, rcond=None)[0]
    assert len(order) == len(y) and np.abs(phi @ model.weights - kernel @ alpha).max() < 1e-2


def test_one_id_or_text_for_most_rows(spark):
    rows = [(None, t, lang) for _, t, lang in sample(400)] + [(7, "the the the", "aa")] * 3000 + [(8 + i, t, lang) for i, t, lang in sample(200, 1)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert model.languages == ["aa", "bb", "cc"]
    assert [model.predict([" ".join(WORDS[x])])[0][0] for x in WORDS] == ["aa", "bb", "cc"]
