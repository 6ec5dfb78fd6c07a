"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed field by field and rebuilt: its normaliser, the metaspace marker, unigram scores or the merges that
its BPE scores imply, and byte fallback.  The rebuilt tokenizer encodes, in multithreaded batches; its ids are the result.  Words (what
stands between single spaces) are remembered.  The sentencepiece library only verifies: whatever the tokenizer encodes, a new word or
a text that can't be taken by words, the library encodes too, and a document counts what the two encode differently.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.groups import in_slices
from corpusloom.llm.words import WordRows, by_bytes, flattened, gathered

SPACE = "▁"
THREADS = 2
MEMORY_WORDS = 100_000  # and as many of the turn before; 200 bytes a word

# Fixed values of the format: field numbers, piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: integers, 4- or 8-byte strings, or byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """A parsed model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.verbatim = not self.charsmap and not self.squeeze and self.dummy_prefix and not any(p[2] == USER_DEFINED for p in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Each way to make a piece of two pieces, best score first: the order in which BPE would join them."""
        known = {p: (score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, (score, i) in known.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in known and piece[cut:] in known:
                    found.append((-score, i, known[piece[:cut]][1], piece[:cut], piece[cut:]))
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        """The model rebuilt for the tokenizers library."""
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        steps += [normalizers.Prepend(SPACE)] if self.dummy_prefix else []
        tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
        own = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER_DEFINED]
        if own:
            tokenizer.add_tokens(own)
        return tokenizer

    def surfaces(self) -> list[bytes]:
        """What each piece decodes to, with the marker as a space."""
        out = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        return out


class PieceCodec:
    """Encoder and decoder of one model with a memory of words; each word is marked by what was found when it was new.

    ``verify`` gives the ids that the verifier has for texts; by default that is the sentencepiece library.
    """

    DIFFERS, LOST = 1, 2  # marks: the verifier has other ids; decoding doesn't give the word back

    def __init__(self, path: str, threads: int = THREADS, verify: Callable[[list[str]], list[list[int]]] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            data = f.read()
        self.model = PieceModel(data)
        self.tokenizer = self.model.tokenizer()
        if verify is None:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=data)
            verify = lambda texts: library.encode(texts, num_threads=1)
        self.verify = verify
        self.surface = self.model.surfaces()
        lengths = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self.surface_ends = np.concatenate([[0], np.cumsum(lengths)])
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        line = self.tokenizer.encode("a\n").ids
        self.line_end = line[-1] if self.model.verbatim and self.model.pieces[line[-1]][2] == BYTE else None
        self.words = WordRows("<i4", MEMORY_WORDS, self._encode_words)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """The tokenizer's ids of whole texts, and whether the verifier has the same."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        other = self.verify(texts)
        return own, np.fromiter((a == b for a, b in zip(own, other)), bool, len(texts))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as lines of texts: a line end is one byte piece, which no merge joins to its neighbours.

        Where the two libraries differ on a text of many lines, its words are encoded one by one.
        """
        sizes = np.zeros(len(words), np.int64)
        parts: list[np.ndarray] = []
        order: list[int] = []
        alone = [i for i, w in enumerate(words) if self.line_end is None or "\n" in w]
        lines = [i for i, w in enumerate(words) if "\n" not in w] if self.line_end is not None else []
        groups = [lines[k : k + 64] for k in range(0, len(lines), 64)]
        ids, same = self._ids(["\n ".join([words[i] for i in g]) + "\n" for g in groups]) if groups else ([], np.zeros(0, bool))
        for group, found, ok in zip(groups, ids, same):
            found = np.array(found, "<i4")
            ends = np.flatnonzero(found == self.line_end)
            if not ok or len(ends) != len(group):
                alone += group
                continue
            sizes[group] = np.diff(ends, prepend=-1) - 1
            parts.append(np.delete(found, ends))
            order += group
        marks = np.zeros(len(words), np.uint8)
        if alone:
            ids, same = self._ids([words[i] for i in alone])
            parts.append(flattened(ids, "<i4")[0])
            sizes[alone] = [len(x) for x in ids]
            marks[np.array(alone)[~same]] |= self.DIFFERS
            order += alone
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        flat = np.concatenate(parts) if parts else np.zeros(0, "<i4")
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        flat, sizes = gathered(flat, ends, place)
        data, per_id = gathered(self.surface_bytes, self.surface_ends, flat)
        cuts = np.concatenate([[0], np.cumsum(per_id)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = data.tobytes()
        lost = [data[a:b] != b" " + w.encode() for a, b, w in zip(cuts, cuts[1:], words)]
        marks[np.array(lost, bool)] |= self.LOST
        return flat, sizes, marks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, each text's number of ids, of its words or itself that the verifier encodes
        differently, and whether decoding gives it back)."""
        if not len(texts):
            return np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        by_words = pc.invert(pc.match_substring_regex(texts, "^ | $|  |^$")) if self.model.verbatim else pa.array(np.zeros(len(texts), bool))
        whole = ~by_words.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(by_words, texts, ""), " ")
        rows, begin = self.words.numbered(lists, skip_first=False)
        kept = (self.words.rows, self.words.used)
        at = np.flatnonzero(whole)
        for k in range(0, len(at), 8):
            part = [texts[i].as_py() for i in at[k : k + 8].tolist()]
            ids, same = self._ids(part)
            back = np.array([self.decode(x) == t for x, t in zip(ids, part)], bool)
            rows[begin[at[k : k + 8]]] = self.words.add_lists(ids, self.DIFFERS * ~same + self.LOST * ~back)
        ids, sizes = self.words.gather(rows)
        marks = self.words.marks[rows]
        self.words.forget(*kept)
        n_ids = np.add.reduceat(sizes, begin)
        n_differing = np.add.reduceat((marks & self.DIFFERS > 0).astype(np.int32), begin)
        return ids, n_ids, n_differing, np.add.reduceat((marks & self.LOST > 0).astype(np.int32), begin) == 0

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that aren't UTF-8 become replacement characters."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return (data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, threads: int) -> PieceCodec:
    """One codec a Python worker, so that later tasks find its memory filled."""
    return PieceCodec(path, threads)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", threads: int = THREADS, batch_bytes: int = 500_000) -> DataFrame:
    """All columns but the text, then pieces (ids), n_pieces, ids_crc32 (of little-endian int32), round_trip and n_differing.

    ``round_trip`` says that decoding the ids gives the text back (a text taken by words decodes to its words' decodings one after
    another, each of which is compared); ``n_differing`` counts the words (or whole texts, where spaces aren't single)
    for which the sentencepiece library has other ids than the rebuilt tokenizer, whose ids stand.
    Null and empty texts have no pieces and make the round trip.  Input columns with the names of the new ones are replaced.
    An empty table gives an empty result.
    """
    added = ("pieces", "n_pieces", "ids_crc32", "round_trip", "n_differing")
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"keep_{c}") for c in docs.columns if c not in (text_col, *added)])
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.LongType(), T.BooleanType(), T.IntegerType())
    schema = T.StructType([*rows.schema.fields[1:], *(T.StructField(*x) for x in zip(added, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path, threads)
        for batch in in_slices(batches):
            texts = pc.fill_null(batch.column(0), "")
            for at, to in by_bytes(texts, batch_bytes):
                ids, sizes, odd, same = coder.encode(texts.slice(at, to - at))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                data = memoryview(ids).cast("B")
                columns = [
                    *[batch.column(i).slice(at, to - at) for i in range(1, batch.num_columns)],
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in pairwise(ends.tolist())], pa.int64()),
                    pa.array(same, pa.bool_()),
                    pa.array(odd, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], *added])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(c).alias(c.removeprefix("keep_")) if c.startswith("keep_") else F.col(c) for c in out.columns])


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """All columns, with the text of each list of ids in ``text_col``, which is replaced where it is there.

    Null ids give a null text, no ids an empty one; bytes that aren't UTF-8 become replacement characters.
    """
    kept = [c for c in encoded.columns if c != text_col]
    rows = encoded.select(*kept)
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path, THREADS)
        for batch in in_slices(batches):
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))
