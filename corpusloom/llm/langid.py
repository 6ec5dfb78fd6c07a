"""Language identification by string kernels with Nyström landmarks and kernel ridge regression.

The kernel is a blended spectrum of character n-gram *presence*: for n = 1, 2, 3 the number of n-grams that two
texts share, divided by the root of the product of their own numbers, averaged over n.  N-grams are counted by their hashes'
``SIZES`` buckets: short texts have nearly the exact kernel, while in a very long one different n-grams meet in a bucket, which
raises its kernel with all texts alike.  Ridge
regression, one-versus-rest, is solved in the span of landmark texts.  Since the kernel is an inner product of
normalised presence vectors, the landmarks' weights fold into one matrix, and a batch of texts is
scored by one product of its presence matrix with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.groups import in_slices

SIZES = (512, 4096, 16384)  # presence bits for n = 1, 2, 3
WIDTH = sum(SIZES)
PER_LANGUAGE = 1000  # expected training texts a language at most; a sample is drawn by id hash
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-3
SHARPNESS = 8.0
UNDETERMINED = "und"

_ALPHABET = None


def _alphabet() -> np.ndarray:
    """For each code point of the basic plane: 0 for what isn't a letter, else the code point of its lower case."""
    global _ALPHABET
    if _ALPHABET is None:
        table = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        _ALPHABET = table
    return _ALPHABET


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, runs of other characters as one 0, and each one's text number."""
    table = _alphabet()
    joined = "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t or "") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    codes = np.where(points < 1 << 16, table[np.minimum(points, 0xFFFF)], 0)
    for i in np.flatnonzero(points >= 1 << 16):  # letters beyond the basic plane are rare
        codes[i] = points[i] if chr(points[i]).isalpha() else 0
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return codes[keep], owner[keep]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(presence bits as a len(texts) x WIDTH byte matrix, whether a text has a letter)."""
    codes, owner = letters(texts)
    bits = np.zeros((len(texts), WIDTH), np.uint8)
    bits[owner, codes % SIZES[0]] = 1
    same = owner[1:] == owner[:-1]
    pair = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    bits[owner[1:][same], SIZES[0] + (pair >> np.uint32(20))[same]] = 1
    same3 = same[1:] & same[:-1]
    triple = (pair[:-1] ^ (pair[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    bits[owner[2:][same3], SIZES[0] + SIZES[1] + (triple >> np.uint32(18))[same3]] = 1
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[codes != 0]] = True
    return bits, has_letter


def normalised(bits: np.ndarray) -> np.ndarray:
    """Presence vectors scaled so that an inner product is the blended kernel."""
    out = bits.astype(np.float32)
    at = 0
    for size in SIZES:
        part = out[:, at : at + size]
        norm = np.sqrt(part.sum(axis=1, keepdims=True) * len(SIZES))
        np.divide(part, norm, out=part, where=norm > 0)
        at += size
    return out


class Model:
    """Folded weights, WIDTH x languages, and the languages in order."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
        """``packed`` has a row of presence bits a text, eight to a byte; they become numbers a block at a time."""
        languages = sorted(set(labels))
        y = np.array([languages.index(x) for x in labels], int)
        rows = lambda r: normalised(np.unpackbits(r, axis=1, count=WIDTH))
        marks = rows(packed[np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])])
        k_nm = np.concatenate([rows(packed[a : a + 128]) @ marks.T for a in range(0, len(packed), 128)]).astype(np.float64)
        k_mm = (marks @ marks.T).astype(np.float64)
        goal = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        balance = 1.0 / np.bincount(y)[y]  # rare languages weigh as much
        left = k_nm.T @ (balance[:, None] * k_nm) + ridge * len(languages) * k_mm + 1e-9 * np.eye(len(marks))
        alpha = np.linalg.solve(left, k_nm.T @ (balance[:, None] * goal))
        return cls(languages, (marks.T.astype(np.float64) @ alpha).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its score for each text."""
        bits, has_letter = presence(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        raw = (normalised(bits) @ self.weights).astype(np.float64)
        odds = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
        share = odds / odds.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        score = np.where(has_letter, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has_letter)], score


def _blocks(texts: list[str | None], rows: int = 128, chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fit in memory as dense matrices."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < rows and (to == at or size + len(texts[to] or "") <= chars):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of labelled texts that aren't held out.

    Each language gives the documents with the lowest hashes of id and text, ``per_language`` in expectation, and of texts with the
    same n-grams one: rows that repeat an id or a text, or have no id, neither fill nor empty the sample.  What comes to
    the driver is their presence bits, 2.6 KB a text.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                bits, has_letter = presence(texts[a:b])
                rows = np.flatnonzero(has_letter)
                packed = [np.packbits(bits[i]).tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array([langs[a + i] for i in rows], pa.string())], ["bits", "lang"])

    sample = labelled.where(place < rate).select("text", "lang").mapInArrow(run, "bits binary, lang string").distinct().toPandas()
    sample = sample.sort_values(["lang", "bits"])  # partition order doesn't matter
    if sample.empty:
        return Model([], np.zeros((WIDTH, 0), np.float32))
    packed = np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1)
    return Model.fit(packed, sample["lang"].tolist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score, then the columns named in ``keep``.

    A text that is null or has no letter is ``und`` with score 0; so is every text where no labelled row is there to
    learn from.  Only the text enters a prediction, so repeated texts get equal results.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), *kept)
    schema = rows.drop("text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in in_slices(batches):
            texts = batch.column(0).to_pylist()
            langs: list[str] = []
            scores: list[float] = []
            for a, b in _blocks(texts):
                got, score = scorer.predict(texts[a:b])
                langs += got
                scores += score.tolist()
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            names = batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
