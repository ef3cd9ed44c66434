"""SentencePiece models on the Tokenizers library: parse the model's protobuf, rebuild it, encode and decode.

Words (a run of markers with what follows up to the next marker) are encoded on their own and kept in a table of
bounded bytes; this is exact as long as no piece holds a marker after another character, which is checked. Distinct new
words are encoded in multithreaded batches. Every row is verified against the sentencepiece library as a whole raw text,
which the normaliser of this module hasn't touched; a codec used on its own can verify every word instead.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import slices

MARK = "▁"
#: Piece types and model types of the SentencePiece format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: In front of a word of the table that has no marker; no word holds one otherwise.
NO_MARK = " "
#: Bytes of the words that a task keeps in each of two generations, counted with what an entry of the table costs besides its characters.
KEPT_BYTES, WORD_BYTES = 40_000_000, 180
#: Words that are handed to the encoders at once.
LEARNT_WORDS = 8192
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> dict:
    """pieces [(piece, score, type)], model_type, byte_fallback, unk_id and the normaliser's settings."""
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model["pieces"].append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                name = {3: "model_type", 35: "byte_fallback", 40: "unk_id", 24: "suffix"}.get(n)
                if name:
                    model[name] = bool(v) if name in ("byte_fallback", "suffix") else v
        elif number == 3:
            for n, v in fields(value):
                name = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}.get(n)
                if name:
                    model[name] = v if name == "charsmap" else bool(v)
    return model


class Codec:
    """Encoder and decoder of one model file. by_word: new words are held against the library; who holds whole texts against it needs no such check."""

    def __init__(self, data: bytes, threads: bool = True, by_word: bool = True):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Regex, Tokenizer, models, normalizers

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"
        # As many threads as a task may use; Spark states them for its Python workers.
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "2"))
        self.model = m = parse(data)
        pieces = m["pieces"]
        if m["suffix"] or not m["escape_whitespaces"] or any(k == USER_DEFINED for _, _, k in pieces):
            raise ValueError("models with suffix markers, unescaped white space or user-defined pieces are not supported")
        self.whole = any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == NORMAL)
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        if m["model_type"] == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in pieces], m["unk_id"], m["byte_fallback"])
        elif m["model_type"] == BPE:
            # A merge for each way to build a piece of two others, the best scores first.
            parts = [(-s, i, p[:k], p[k:]) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
            parts.sort(key=lambda x: (x[0], x[1], ids[x[2]], ids[x[3]]))
            core = models.BPE(ids, [x[2:] for x in parts], unk_token=pieces[m["unk_id"]][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
        else:
            raise ValueError(f"model type {m['model_type']} is not supported")
        self.tokenizer = Tokenizer(core)
        # The library drops leading blanks, and trailing blanks and markers; other white space it keeps.
        steps = ([normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []) + ([normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(f"^ +|[ {MARK}]+$"), "")] if m["remove_extra_whitespaces"] else [])
        self.normaliser = normalizers.Sequence(steps) if steps else None
        self.library = SentencePieceProcessor(model_proto=data)
        self.by_word = by_word
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])
        #: Ids of words as bytes, in two generations; a word without a marker in front stands for the marker and itself.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        #: Words for which the library has other ids, and words whose ids don't decode to them.
        self.differ: set[str] = set()
        self.strange: set[str] = set()

    def expected(self, text: str) -> str:
        """The normalised text, before white space is escaped."""
        return self.normaliser.normalize_str(text) if self.normaliser else text

    def cut(self, text: str) -> list[str]:
        """The words of a normalised text. One marker in front of a word is left out; words that have none or several in front begin with NO_MARK or the markers."""
        if not text:
            return []
        if not (self.whole or MARK in text or "  " in text or text[0] == " " or text[-1] == " " or not self.model["add_dummy_prefix"]):
            return text.split(" ")
        text = text.replace(" ", MARK)
        if self.model["add_dummy_prefix"]:
            text = MARK + text
        return [w if w[:2] == MARK * 2 or w == MARK else w[1:] if w[0] == MARK else NO_MARK + w for w in ([text] if self.whole else WORDS.findall(text))]

    def spelt(self, word: str) -> str:
        """The characters that a word of the table stands for."""
        return word[1:] if word[0] == NO_MARK else word if word[0] == MARK else MARK + word

    def same(self, word: str, got: list[int]) -> bool:
        """Whether the library gives these ids for one word. The word is put behind a letter where the library's own prefix would change it; its markers, unlike blanks, are never collapsed."""
        s = self.spelt(word)
        if self.whole:
            return self.library.encode(s[1:] if self.model["add_dummy_prefix"] else s) == got
        if s[0] != MARK:
            return not self.model["add_dummy_prefix"] and self.library.encode(s) == got
        return self.library.encode(f"a{s}")[len(self.library.encode("a")) :] == got

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, encoded in multithreaded batches. With by_word all are held against the library, a batch in one text; a batch that differs, word by word."""
        out = {}
        for at in range(0, len(words), LEARNT_WORDS):
            part = words[at : at + LEARNT_WORDS]
            spelt = [self.spelt(w) for w in part]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(spelt, add_special_tokens=False)]
            flat = [i for ids in found for i in ids]
            table, ends = np.array(flat, "<i4").tobytes(), np.cumsum([0] + [4 * len(ids) for ids in found]).tolist()
            out.update(zip(part, (table[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
            decoded = b"".join([self.bytes_of[i] for i in flat])
            joined = "".join(spelt)
            if decoded != joined.replace(MARK, " ").encode():
                self.strange.update(w for w, s, ids in zip(part, spelt, found, strict=True) if b"".join([self.bytes_of[i] for i in ids]) != s.replace(MARK, " ").encode())
            if not self.by_word:
                continue
            simple = not self.whole and self.model["add_dummy_prefix"] and all(w[0] not in NO_MARK + MARK for w in part)
            if not simple or decoded != joined.replace(MARK, " ").encode() or self.library.encode(" ".join(part)) != flat:
                self.differ.update(w for w, ids in zip(part, found, strict=True) if not self.same(w, ids))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Ids as little-endian bytes, whether they decode to the normalised text, and whether every word agrees with the library (true without by_word)."""
        expected = [self.expected(t) for t in texts]
        cut = [self.cut(t) for t in expected]
        need = set().union(*cut)
        if self.young_bytes > KEPT_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
            self.differ.intersection_update(self.old)
            self.strange.intersection_update(self.old)
        need.difference_update(self.young)
        again = {w: self.old[w] for w in need & self.old.keys()}
        new = self.learn(sorted(need.difference(again)))
        for found in (again, new):
            self.young.update(found)
            self.young_bytes += sum(map(len, found)) + sum(map(len, found.values())) + WORD_BYTES * len(found)
        ids_of, out = self.young.__getitem__, []
        for text, ws in zip(expected, cut, strict=True):
            ids = b"".join(map(ids_of, ws))
            back = not self.strange or self.strange.isdisjoint(ws) or self.decode(np.frombuffer(ids, "<i4").tolist()) == text.replace(MARK, " ")
            out.append((ids, back, not self.differ or self.differ.isdisjoint(ws)))
        return out

    def agrees(self, raw: str, ids: bytes) -> bool:
        """Whether the library gives these ids for a whole raw text."""
        return self.library.encode_as_numpy(raw).astype("<i4").tobytes() == ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model["add_dummy_prefix"] and text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read(), by_word=False)


def encode(docs: DataFrame, model_path: str, text: str = "text", whole_share: int = 1) -> DataFrame:
    """docs with ids, n_tokens, n_byte_tokens, ids_crc32, round_trip and parity.

    ids are those of the model without special tokens; round_trip says that decoding them gives the normalised text back; parity that the sentencepiece library gives the same ids for the whole raw text, which is compared for every row. whole_share can only be 1 (every row). An empty text, or one that the normaliser empties, has no ids and is true in both; a null text has null results. Texts of any length are encoded whole; a task holds the words of about common.BATCH_BYTES of text, or of one longer text, besides its table. Equal rows get equal results; an empty table gives an empty one. model_path must lie at the same place on all machines (it comes with an installed package). Columns of docs of the same names as the added ones are replaced.
    """
    if whole_share != 1:
        raise ValueError("parity is compared for every row: whole_share must be 1")
    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])
    docs = docs.drop(*[f.name for f in added if f.name in docs.columns])
    schema = T.StructType(docs.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for at, n in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                yield results(c, batch.slice(at, n), texts.slice(at, n).to_pylist())

    def results(c: Codec, batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        there = [t for t in texts if t is not None]
        got = iter([(ids, back, c.agrees(t, ids)) for t, (ids, back, _) in zip(there, c.encode(there), strict=True)])
        rows = [None if t is None else next(got) for t in texts]
        flat = np.frombuffer(b"".join([r[0] for r in rows if r]), "<i4")
        ends = np.cumsum([0] + [len(r[0]) // 4 if r else 0 for r in rows])
        n_bytes = np.concatenate([[0], np.cumsum(c.is_byte[flat])])[ends]
        null = pa.array([r is None for r in rows])
        none = null.to_numpy(zero_copy_only=False)
        columns = [
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=null),
            pa.array(np.diff(ends), pa.int64(), mask=none),
            pa.array(np.diff(n_bytes), pa.int64(), mask=none),
            pa.array([zlib.crc32(r[0]) if r else None for r in rows], pa.int64()),
            pa.array([r and r[1] for r in rows], pa.bool_()),
            pa.array([r and r[2] for r in rows], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf(T.StringType())
    def texts(s):
        c = codec(model_path)
        return s.map(lambda x: None if x is None else c.decode(list(x)))

    return rows.withColumn(out, texts(F.col(ids)))
