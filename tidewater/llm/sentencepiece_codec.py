"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field and rebuilt as a tokenizers pipeline: normaliser,
metaspace marker, unigram scores or the merges that BPE scores imply, and byte fallback.
Batches are encoded with several threads. Where no piece reaches across a marker, texts are
cut before their markers, and each distinct segment of a batch is encoded once. Before a worker uses a rebuilt tokenizer it must
agree with the sentencepiece library on a fixed set of probes; ``parity`` compares whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tidewater.llm.flat import FlatText, chunks
from tidewater.llm.shared import map_batches, own

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Threads that encode a batch in one worker process, and bytes of text in it.
THREADS, BATCH_BYTES = 2, 1 << 20
#: Segments that one call of the library encodes, and whose results a worker keeps before it starts
#: afresh: bounds on memory, not on results.
SEGMENT_BATCH, MAX_SEGMENTS = 5_000, 200_000

#: Texts on which a rebuilt tokenizer must agree with the library before it is used.
PROBES = ("", " ", "  ", "Hello world", " lead", "trail ", "a  b   c", "tab\tnew\nline\r\n", "Éçole naïve ñandú Ü", "你好 мир", "🙂 ​﻿", "<s> </s> <unk> <0x41>", f"x{MARK}y {MARK}", "don't stop!! 123456 a1b2", "\x00\x01 \x7f")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers as integers, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class SentenceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    byte_fallback: bool = False

    @staticmethod
    def read(path: str) -> SentenceModel:
        model = SentenceModel()
        with open(path, "rb") as file:
            data = file.read()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                model.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, the best scored piece first: the order in which BPE joins them."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
                found += [(-score, rank[piece], rank[a], rank[b], (a, b)) for a, b in splits]
        return [pair for *_, pair in sorted(found)]

    @property
    def words_apart(self) -> bool:
        """Whether no piece holds a marker behind another character, so that text may be cut before each run of markers."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def tokenizer(self) -> Tokenizer:
        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocabulary, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models can be rebuilt")
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" " if not self.escape else MARK))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if self.words_apart:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER])
        ends = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        return out


class _Ragged:
    """Rows of different lengths end to end, in an array that grows by doubling."""

    def __init__(self, kind: type):
        self.values, self.at, self.used = np.empty(1024, kind), [0], 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.empty(2 * need - self.used, self.values.dtype)])
        self.values[self.used : need] = values
        self.at.extend((self.used + np.cumsum(lengths)).tolist())
        self.used = need

    def take(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        done = np.cumsum(lengths)
        return self.values[np.repeat(starts[rows] - (done - lengths), lengths) + np.arange(int(done[-1]) if len(done) else 0)]


class Codec:
    """A rebuilt tokenizer, and where the model allows it a second one for single segments, whose results a worker keeps."""

    def __init__(self, path: str):
        model = SentenceModel.read(path)
        self.whole = model.tokenizer()
        # The library never matches control and byte pieces in a text; a unigram tokenizer would, so it leaves such texts to the library.
        names = [re.escape(p) for p, _, kind in model.pieces if kind not in (NORMAL, USER)]
        self.literal = re.compile("|".join(names)) if model.kind == UNIGRAM and names else None
        self.path, self.library = path, None
        plain = model.kind == BPE and not model.charsmap and not model.squeeze and model.dummy_prefix and model.escape
        self.segment: Tokenizer | None = None
        if plain and model.words_apart and not any(kind == USER for _, _, kind in model.pieces):
            self.segment = Tokenizer(self.whole.model)
            self.segment.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.said = _Ragged(np.int32), _Ragged(np.uint8)

    def _rows(self, keys: np.ndarray, segment_of) -> np.ndarray:
        """Each distinct segment's row in the kept results; those not kept yet are encoded and decoded together."""
        if len(self.index) > MAX_SEGMENTS:
            self._forget()
        listed = keys.tolist()
        rows = np.array([self.index.get(k, -1) for k in listed], np.int64)
        new = np.flatnonzero(rows < 0)
        for k in range(0, len(new), SEGMENT_BATCH):
            part = new[k : k + SEGMENT_BATCH].tolist()
            ids = [e.ids for e in self.segment.encode_batch_fast([segment_of(i) for i in part], add_special_tokens=False)]
            said = [x.encode() for x in self.segment.decode_batch(ids, skip_special_tokens=False)]
            for i in part:
                rows[i] = self.index[listed[i]] = len(self.index)
            size = np.array([len(x) for x in ids])
            self.ids.extend(np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), size)
            self.said.extend(np.frombuffer(b"".join(said), np.uint8), np.array([len(x) for x in said]))
        return rows

    def encode(self, texts: list[str], decode: bool = False) -> tuple[pa.ListArray, list[bytes] | None]:
        """The ids of each text; with ``decode`` also what they decode to, in UTF-8."""
        if self.segment is None:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            for i in [i for i, x in enumerate(texts) if self.literal and self.literal.search(x)]:
                ids[i] = self._by_library(texts[i])
            return _lists(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids])), [x.encode() for x in self.decode(ids)] if decode else None
        joined = "".join([MARK + x.replace(" ", MARK) if x else "" for x in texts])
        is_mark = np.frombuffer(joined.encode("utf-32-le"), np.uint32) == ord(MARK)
        ends = np.cumsum([len(x) + 1 if x else 0 for x in texts])
        start = is_mark.copy()
        start[1:] &= ~is_mark[:-1]
        start[ends[:-1][ends[:-1] < len(joined)]] = True
        starts = np.flatnonzero(start)
        flat = FlatText(pa.array([joined], pa.large_string()))
        begins = np.flatnonzero((flat.bytes & 0xC0) != 0x80)[starts]
        closes = np.append(begins[1:], len(flat.bytes)) if len(begins) else begins
        keys, first, which = np.unique(flat.hashes(begins, closes), return_index=True, return_inverse=True)
        raw = flat.bytes.tobytes()
        rows = self._rows(keys, lambda i: raw[begins[first[i]] : closes[first[i]]].decode())[which]
        of_text = np.searchsorted(starts, np.concatenate([[0], ends]))

        def gathered(kept: _Ragged) -> tuple[np.ndarray, np.ndarray]:
            at = np.array(kept.at)
            lengths = np.diff(at)[rows]
            return kept.take(rows, at, lengths), np.concatenate([[0], np.cumsum(lengths)])[of_text]

        ids, at = gathered(self.ids)
        lists = _lists(ids, np.diff(at))
        if not decode:
            return lists, None
        said, at = gathered(self.said)
        spoken = said.tobytes()
        # The first marker, which the model puts before a text, is not part of it.
        return lists, [spoken[a + 1 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _by_library(self, text: str) -> list[int]:
        import sentencepiece

        self.library = self.library or sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self.library.encode(text)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


@cache
def codec(path: str) -> Codec:
    """The rebuilt tokenizer of a model file, one for each worker process, once it has passed the probes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    import sentencepiece

    rebuilt, library = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    probes = list(PROBES)
    expected = library.encode(probes, num_threads=1)
    lists, said = rebuilt.encode(probes, decode=True)
    spoken = [library.decode(x) for x in expected]
    if lists.to_pylist() != expected or said != [x.encode() for x in spoken] or rebuilt.decode(expected) != spoken:
        raise ValueError(f"{path} can't be rebuilt exactly: a probe differs from the library")
    return rebuilt


def parity(path: str, texts: list[str]) -> list[bool]:
    """For each text, whether ids and decoded text are the library's."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    lists, said = codec(path).encode(texts, decode=True)
    theirs = library.encode(texts, num_threads=1)
    return [a == b and d == library.decode(b).encode() for a, b, d in zip(lists.to_pylist(), theirs, said, strict=True)]


def _batches(docs: DataFrame, model: str, schema: str, columns) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in chunks(batch.column(1), BATCH_BYTES):
            made = columns(codec(model), pc.fill_null(part, "").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *made], [x.split()[0] for x in schema.split(", ")])

    return map_batches(own(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, schema)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more): doc_id, ids, n_pieces, without begin or end.

    ``model`` is the path of a SentencePiece model, the same on every executor. Whole texts are
    encoded, special strings inside them as ordinary text. A null or empty text has no pieces.
    Repeated rows get the same result each; extra columns are ignored.
    """

    def columns(machine: Codec, texts: list[str]) -> list[pa.Array]:
        lists, _ = machine.encode(texts)
        return [lists, pc.list_value_length(lists).cast(pa.int64())]

    return _batches(docs, model, "doc_id long, ids array<int>, n_pieces long", columns)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, any more) to (doc_id, text); null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            texts = codec(model).decode([x or [] for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(own(encoded, "doc_id", "ids").withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes: doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, lossless.

    lossless tells whether the decoded text equals the original (null: empty). Cases as in ``encode_pieces``.
    """

    def columns(machine: Codec, texts: list[str]) -> list[pa.Array]:
        lists, back = machine.encode(texts, decode=True)
        raw, at = lists.values.to_numpy().astype("<i4").tobytes(), lists.offsets.to_pylist()
        return [
            pc.list_value_length(lists).cast(pa.int64()),
            pa.array([hashlib.sha256(raw[a * 4 : b * 4]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            pa.array([a.encode() == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
        ]

    return _batches(docs, model, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean", columns)
