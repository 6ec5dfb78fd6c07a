"""Token-id output with Elias-Fano coded document boundaries.

A shard file holds the ids of consecutive documents as one array of 2- or 4-byte unsigned integers,
and where each document ends as an Elias-Fano sequence: of each end the low ``l`` bits stand packed in one
bit array, the rest is unary in a second, and the positions of every 256th one bit serve select queries.
That takes about 2 + log2(ids per document) bits a document instead of a 64-bit table.

The documents' own ids, which ascend within a shard, are a second such sequence, counted from the first of them.

Shard layout, little-endian: magic ``EFTOKS02``, length of the JSON header (uint32), header, then the
sections that the header lists as [offset, bytes], offsets counted from the end of the header: ``low``, ``high`` and ``samples`` of
both sequences (``ends`` and ``doc_ids``, of the documents that have an id; the others stand last), and ``ids``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import WordRows, by_bytes, flattened
from corpusloom.sources.files import open_file, write_file
from corpusloom.sources.storage import fresh_path, materialize

MAGIC = b"EFTOKS02"
SAMPLE = 256
MAX_READERS = 10_000
SHARD_BYTES = 64 << 20  # of ids; a task begins a new shard beyond them
MEMORY_WORDS = 600_000  # and as many of the turn before

# Letters that Unicode has had for long, then ASCII punctuation, perhaps the same on a second line: the pre-tokenizer cuts
# between these parts and nowhere else.
PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ]+)([!-/:-@\[-`{-~]*)(?:\n([A-Za-zªµºÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ]+)([!-/:-@\[-`{-~]*))?")
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class EliasFano:
    """A non-decreasing sequence of integers with random access in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32 if not n or ones[-1] < 2**32 else np.uint64))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one bit, scan bytes of the unary array."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, mask = at >> 3, 0xFF << (at & 7) & 0xFF
        word = int(self.high[byte]) & mask
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + ((word & -word).bit_length() - 1)
        p = i * self.low_bits
        low = int.from_bytes(self.low[p >> 3 : (p + self.low_bits + 7) >> 3].tobytes(), "little") >> (p & 7)
        return (one - i) << self.low_bits | low & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        high = ones - np.arange(self.n, dtype=np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high << np.uint64(self.low_bits) | low


    def sections(self, name: str) -> tuple[dict, dict[str, bytes]]:
        """What a header must say of the sequence, and its sections."""
        about = {"n": self.n, "low_bits": self.low_bits, "sample_bytes": self.samples.itemsize}
        return about, {f"{name}.{part}": getattr(self, part).tobytes() for part in ("low", "high", "samples")}


def write_shard(uri: str, doc_ids: list[int | None], lengths: np.ndarray, ids: list[np.ndarray], width: int) -> int:
    """Write one shard; ``ids`` are the documents' ids one after another, in pieces, as ``width``-byte integers.

    ``doc_ids`` ascend, with those that are None at the end.
    """
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    header: dict = {"n": len(doc_ids), "first": first, "width": width}
    sections: dict[str, bytes] = {}
    for name, values in (("ends", np.cumsum(lengths, dtype=np.uint64)), ("doc_ids", (known.astype(np.uint64) - np.uint64(first % (1 << 64))))):
        header[name], parts = EliasFano.build(values).sections(name)
        sections |= parts
    at = 0
    for name, data in sections.items():
        header[name] = [at, len(data)]
        at += len(data)
    header["ids"] = [at, sum(x.nbytes for x in ids)]
    head = json.dumps(header).encode()
    return write_file(uri, [MAGIC, len(head).to_bytes(4, "little"), head, *sections.values(), *(x.tobytes() for x in ids)])


class Shard:
    """Random access to a shard: a document's ids cost two selects and one read, its own id one select."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        first = self.file.read(12)
        if first[:8] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        size = int.from_bytes(first[8:], "little")
        self.header = json.loads(self.file.read(size))
        self.base = 12 + size
        self.n, self.width = self.header["n"], self.header["width"]
        self.ends, self.names = self._sequence("ends"), self._sequence("doc_ids")

    def _section(self, name: str, kind: str) -> np.ndarray:
        at, size = self.header[name]
        self.file.seek(self.base + at)
        return np.frombuffer(self.file.read(size), kind)

    def _sequence(self, name: str) -> EliasFano:
        about = self.header[name]
        samples = self._section(f"{name}.samples", f"<u{about['sample_bytes']}")
        return EliasFano(about["n"], about["low_bits"], self._section(f"{name}.low", "u1"), self._section(f"{name}.high", "u1"), samples)

    def doc_id(self, i: int) -> int | None:
        return self.header["first"] + self.names.select(i) if i < self.names.n else None

    def end(self, i: int) -> int:
        """Where document i ends; -1 names the start."""
        return self.ends.select(i) if i >= 0 else 0

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.base + self.header["ids"][0] + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """Whole-text encoding by byte-level BPE with a memory of words.

    The vocabulary's pre-tokenizer always cuts before a single space between two characters that aren't
    white space, and merges never cross its cuts.  A text therefore encodes as its first word followed by its other words
    with their leading space, each on its own, and a word seen before needs no second encoding.  A text in which some
    space has another neighbour or stands at an end, or that holds a special token's string, is encoded as it is; so is every
    text if the file has another pre-tokenizer.

    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        cuts = about.get("pre_tokenizer") or {}
        self.by_words = not about.get("normalizer") and (cuts.get("type"), cuts.get("add_prefix_space"), cuts.get("use_regex", True)) == ("ByteLevel", False, True)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.line = self.letters[10]
        self.marks: dict[str, list[int]] = {}
        self.words = WordRows(f"<u{self.width}", MEMORY_WORDS, self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Words with a leading space that isn't written."""
        tokenize, letters, plain = self.model.tokenize, self.letters, PLAIN.fullmatch
        lists: list[list[int]] = [[]] * len(words)
        hard = []
        for i, w in enumerate(words):
            if (m := plain(w)) is None:
                hard.append(i)
                continue
            core, tail, core2, tail2 = m.groups()
            if not w.isascii():
                core = core.encode().decode("latin-1").translate(letters)
                core2 = core2 and core2.encode().decode("latin-1").translate(letters)
            ids = [t.id for t in tokenize("Ġ" + core)]
            if tail:
                ids += self._mark(tail)
            if core2:
                ids += self._mark(self.line)
                ids += [t.id for t in tokenize(core2)]
                if tail2:
                    ids += self._mark(tail2)
            lists[i] = ids
        for i, ids in zip(hard, self._encode([" " + words[i] for i in hard])):
            lists[i] = ids
        return *flattened(lists, f"<u{self.width}"), 0

    def _mark(self, text: str) -> list[int]:
        """The ids of a run of punctuation, or of the line end; there are few."""
        if text not in self.marks:
            if len(self.marks) > 50_000:
                self.marks.clear()
            self.marks[text] = [t.id for t in self.model.tokenize(text)]
        return self.marks[text]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), 256) for e in self.tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts can't be taken word by word."""
        if not self.by_words:
            return np.ones(len(texts), bool)
        whole = pc.match_substring_regex(texts, f"^ | $| {WHITE}|{WHITE} ")
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        return whole.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, each text's with ``end_id`` appended; their numbers)."""
        if not len(texts):
            return np.zeros(0, f"<u{self.width}"), np.zeros(0, np.int64)
        whole = self._whole(texts)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        rows, begin = self.words.numbered(lists, skip_first=True)
        heads = lists.flatten().take(pa.array(begin)).to_pylist()  # first words have no space before them
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()
        kept = (self.words.rows, self.words.used)
        rows[begin] = self.words.add_lists(self._encode(heads))
        stops = np.append(begin[1:], len(rows))
        ids, sizes = self.words.gather(np.insert(rows, stops, self.words.add_lists([[end_id]])[0]))
        self.words.forget(*kept)
        return ids, np.diff(np.cumsum(sizes)[stops + np.arange(len(stops))], prepend=0)


def byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself where it is printable, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, so that later tasks find its memory filled."""
    return WordEncoder(path)


def encode_to_shards(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2_000_000
) -> DataFrame:
    """Encode every whole text and write shards in ascending id order; returns the manifest.

    Manifest rows: shard, path, n_docs, n_tokens; shard numbers follow document order.  A task writes a shard as
    soon as it holds ``SHARD_BYTES`` of ids, so its memory doesn't grow with its rows.  Rows that share an id, or have
    none, are dealt and ordered by their texts' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        encoder = None
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            path = f"{folder}/shard-{shard >> 24:06d}-{shard & (1 << 24) - 1:06d}.eft"
            counts = np.concatenate(lengths)
            write_shard(path, doc_ids, counts, parts, encoder.width)
            row = {"shard": [shard], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [int(counts.sum())]}
            for held in (doc_ids, lengths, parts):
                held.clear()
            shard += 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            encoder = encoder or word_encoder(tokenizer_path)
            texts = pc.fill_null(batch.column(1), "")
            for at, to in by_bytes(texts, batch_bytes):
                ids, counts = encoder.encode(texts.slice(at, to - at), end_id)
                doc_ids += batch.column(0).slice(at, to - at).to_pylist()
                lengths.append(counts)
                parts.append(ids)
                if sum(x.nbytes for x in parts) > SHARD_BYTES:
                    yield flush()
        if doc_ids:
            yield flush()

    place = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(*place).sortWithinPartitions(*place)
    )
    return ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, path, and its number in the shard.

    Ends and document ids are read by select.  The manifest has a row a shard; its running sum places each shard in the whole array.
    """
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "first", "shard")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard_path", "position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                for at in range(0, shard.n, 2000):
                    rows = range(at, min(at + 2000, shard.n))
                    ends = [shard.end(at - 1), *map(shard.end, rows)]
                    data = memoryview(shard.ids(ends[0], ends[-1]).astype("<u4")).cast("B")
                    bounds = 4 * (np.array(ends) - ends[0])
                    crcs = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    columns = [
                        pa.array(map(shard.doc_id, rows), pa.int64()),
                        pa.array(np.array(ends[:-1]) + first, pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(crcs, pa.int64()),
                        pa.array([path] * len(rows), pa.string()),
                        pa.array(rows, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
                shard.close()

    # A number is given since manifest rows are tiny: by their bytes all would be put into one task.
    return placed.repartition(max(1, min(manifest.count(), MAX_READERS)), "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_path string, position long"
    )


def token_table(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write all documents' ids to Elias-Fano shards and return what the files hold.

    One row per input row: doc_id, start (ids before it in the whole), n_tokens (with the end id),
    ids_crc32 (of the ids as little-endian uint32), shard_path, position.  Documents stand in ascending
    doc_id order, null ids last; rows with equal ids stand together, in the order of their texts' hashes.  A null or empty
    text is the end id alone.  Strings of special tokens in a text become those tokens, as the library does by
    itself.  Other columns are not read; an empty table writes no shard.
    """
    folder = folder or fresh_path(docs.sparkSession, "op1-shards")
    manifest = materialize(encode_to_shards(docs, tokenizer_path, folder, **options), "op1-manifest")
    return read_shards(manifest)
