"""Quality rules by line sequence labelling: a linear-chain CRF marks each line as content or boilerplate.

Viterbi decoding runs in step over all documents of a batch. A document stays if it passes the
base rules and enough of its text stands on content lines. The model is fitted by gradient
ascent on the conditional likelihood, with the lines of labelled documents as weak labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.flat import IS_SPACE, U64, FlatText, chunks, mix
from tidewater.llm.shared import map_batches, own

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays if content lines hold at least this share of its characters.
MIN_CONTENT_SHARE = 0.5
#: Most labelled documents that a fit reads.
MAX_FIT_DOCUMENTS = 4000

FEATURES = ("bias", "short", "long", "symbols", "upper", "digits", "exclamations", "symbol_words", "repeated_line", "repeated_words", "word_length", "stops")
_MODEL = Path(__file__).with_name("quality_model.json")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class LineModel:
    """Scores for the labels boilerplate (0) and content (1): emissions (features x 2), transitions (2 x 2), starts (2)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    @staticmethod
    def load(path: Path = _MODEL) -> LineModel:
        kept = json.loads(path.read_text())
        return LineModel(*(np.array(kept[k]) for k in ("emit", "move", "start")))

    def save(self, path: Path = _MODEL) -> None:
        path.write_text(json.dumps({"features": FEATURES} | {k: np.round(getattr(self, k), 5).tolist() for k in ("emit", "move", "start")}, indent=1) + "\n")


@dataclass
class Lines:
    """What the kernel finds in a batch: counts for each text, and the lines that have a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first: np.ndarray  # of each text's lines, one more at the end
    chars: np.ndarray  # of each line
    features: np.ndarray


def read_lines(texts: pa.Array) -> Lines:
    flat = FlatText(texts)
    starts, ends, first_word = flat.words()
    n_words = np.diff(first_word)
    word = flat.hashes(starts, ends)
    text_of_word = np.repeat(np.arange(flat.n), n_words)
    begins = (flat.bytes & 0xC0) != 0x80
    solid = ~IS_SPACE[flat.bytes]
    in_words = np.zeros(len(flat.bytes) + 1, np.int64)
    np.cumsum(begins & solid, out=in_words[1:])
    symbol = _IS_SYMBOL[flat.bytes]

    windows = max(0, len(word) - 2)
    trio = mix(word[:windows] * U64(3) + word[1 : windows + 1] * U64(5) + word[2 : windows + 2] * U64(7))
    inside = text_of_word[:windows] == text_of_word[2 : windows + 2]
    _, which, times = np.unique(mix(trio ^ mix(text_of_word[:windows].astype(U64)))[inside], return_inverse=True, return_counts=True)
    again = np.zeros(windows, bool)
    again[inside] = times[which] > 1
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[k : k + windows] |= again
    repeats = np.zeros(len(word) + 1, np.int64)
    np.cumsum(covered, out=repeats[1:])

    line_start, line_end, first_line = flat.lines()
    lo, hi = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    solid_lines = hi > lo
    text_of_line = np.repeat(np.arange(flat.n), np.diff(first_line))[solid_lines]
    line_start, line_end, lo, hi = line_start[solid_lines], line_end[solid_lines], lo[solid_lines], hi[solid_lines]
    key = mix(flat.hashes(line_start, line_end) ^ mix(text_of_line.astype(U64)))
    _, earliest, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    repeated = times[which] > 1
    dup = np.ones(len(key), bool)
    dup[earliest] = False

    def share(mark: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mark) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        return (total[line_end] - total[line_start]) / np.maximum(of, 1)

    chars = in_words[line_end] - in_words[line_start]
    n = hi - lo
    b = flat.bytes
    upper = ((b >= 65) & (b <= 90)) | ((np.concatenate([[0], b[:-1]]) == 0xC3) & (b >= 0x80) & (b <= 0x9E))
    has_symbol = np.zeros(len(b) + 1, np.int64)
    np.cumsum(symbol, out=has_symbol[1:])
    symbol_word = np.zeros(len(word) + 1, np.int64)
    np.cumsum(has_symbol[ends] > has_symbol[starts], out=symbol_word[1:])
    last = b[ends[hi - 1] - 1] if len(hi) else b[:0]
    features = np.stack(
        [
            np.ones(len(n)),
            n < 4,
            np.minimum(np.log1p(n) / 6, 1),
            np.minimum(share(symbol, chars) * 4, 1),
            share(upper, chars),
            share((b >= 48) & (b <= 57), chars),
            np.minimum(share(b == 33, chars) * 6, 1),
            (symbol_word[hi] - symbol_word[lo]) / np.maximum(n, 1),
            repeated,
            (repeats[hi] - repeats[lo]) / np.maximum(n, 1),
            np.minimum(chars / np.maximum(n, 1) / 12, 1),
            last == 46,
        ],
        axis=1,
    ).astype(np.float64)
    return Lines(
        n_words,
        in_words[flat.offsets[1:]] - in_words[flat.offsets[:-1]],
        flat.counts(symbol),
        np.bincount(text_of_line, weights=dup, minlength=flat.n).astype(np.int64),
        repeats[first_word[1:]] - repeats[first_word[:-1]],
        np.searchsorted(text_of_line, np.arange(flat.n + 1)),
        chars,
        features,
    )


def _in_step(first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each position, the texts that have so many lines; texts with most lines come first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    ranked = length[order]
    for t in range(int(ranked[0]) if len(ranked) else 0):
        yield t, order[: np.searchsorted(-ranked, -t, side="left")]


def viterbi(model: LineModel, lines: Lines) -> np.ndarray:
    """The best label of each line given its whole document."""
    score = lines.features @ model.emit
    back = np.zeros((len(score), 2), np.int8)
    best = np.zeros((len(lines.first) - 1, 2))
    for t, live in _in_step(lines.first):
        at = lines.first[live] + t
        if t == 0:
            best[live] = model.start + score[at]
        else:
            ways = best[live][:, :, None] + model.move
            back[at] = ways.argmax(axis=1)
            best[live] = ways.max(axis=1) + score[at]
    label = np.zeros(len(score), np.int8)
    some = np.flatnonzero(np.diff(lines.first))
    label[lines.first[some + 1] - 1] = best[some].argmax(axis=1)
    for t, live in reversed(list(_in_step(lines.first))):
        if t:
            at = lines.first[live] + t
            label[at - 1] = back[at, label[at]]
    return label


def fit(lines: Lines, quality: np.ndarray, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> LineModel:
    """Gradient ascent (Adam) on the CRF's conditional log-likelihood; each line takes its document's label."""
    texts = len(quality)
    label = np.repeat(quality, np.diff(lines.first))
    steps = list(_in_step(lines.first))
    flat = np.zeros(len(FEATURES) * 2 + 6)
    want = np.zeros((len(label), 2))
    want[np.arange(len(label)), label] = 1
    inner = np.ones(len(label), bool)
    inner[lines.first[:-1][np.diff(lines.first) > 0]] = False
    moved = np.zeros((2, 2))
    np.add.at(moved, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    began = want[~inner].sum(axis=0)
    m, v = np.zeros_like(flat), np.zeros_like(flat)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(FEATURES) * 2
        return x[:k].reshape(-1, 2), x[k : k + 4].reshape(2, 2), x[k + 4 :]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        emit, move, start = split(flat)
        score = lines.features @ emit
        ahead, behind = np.zeros((len(label), 2)), np.zeros((len(label), 2))
        for t, live in steps:
            at = lines.first[live] + t
            ahead[at] = score[at] + (total(ahead[at - 1][:, :, None] + move, 1) if t else start)
        for t, live in reversed(steps):
            if t:
                at = lines.first[live] + t
                behind[at - 1] = total(move + (score[at] + behind[at])[:, None, :], 2)
        some = np.flatnonzero(np.diff(lines.first))
        log_z = np.zeros(texts)
        log_z[some] = total(ahead[lines.first[some + 1] - 1], 1)
        z = np.repeat(log_z, np.diff(lines.first))[:, None]
        node = np.exp(ahead + behind - z)
        at = np.flatnonzero(inner)
        edge = np.exp(ahead[at - 1][:, :, None] + move + (score[at] + behind[at])[:, None, :] - z[at][:, :, None]).sum(axis=0)
        slope = np.concatenate([(lines.features.T @ (want - node)).ravel(), (moved - edge).ravel(), began - node[~inner].sum(axis=0)]) / texts - decay * flat
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        flat = flat + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return LineModel(*split(flat))


def fit_quality(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_FIT_DOCUMENTS) -> LineModel:
    """A model from the labelled documents; of more than ``max_documents`` those whose ids hash lowest."""
    chosen = labels.select("doc_id", "quality").where("quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    rows = own(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("text", "quality").toArrow()
    return fit(read_lines(rows.column("text").combine_chunks()), rows.column("quality").to_numpy().astype(int))


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, n_content_lines long, content_share double, kept boolean"
)


def judge(texts: pa.Array, model: LineModel) -> list[pa.Array]:
    lines = read_lines(texts)
    content = viterbi(model, lines)
    text = np.repeat(np.arange(len(texts)), np.diff(lines.first))
    n_content = np.bincount(text, weights=content, minlength=len(texts))
    share = np.bincount(text, weights=content * lines.chars, minlength=len(texts)) / np.maximum(lines.word_chars, 1)
    failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT_PERCENT * lines.n_words)
    kept = ~failed & (share >= MIN_CONTENT_SHARE)
    counts = (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)
    return [*(pa.array(x.astype(np.int64)) for x in counts), pa.array(failed), pa.array(np.diff(lines.first)), pa.array(n_content.astype(np.int64)), pa.array(share), pa.array(kept)]


def quality_rules(docs: DataFrame, model: LineModel | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more): doc_id and the columns of ``SCHEMA``.

    Words are runs of characters other than 09-0D and 20. word_chars counts code points in
    words; n_symbols the characters ``#*$%&|<>``; n_dup_lines the lines with a word that equal
    an earlier line of the text; n_repeat_words the words in 3-word windows that the text has
    twice or more. base_failed: under 50 words, or more than half of the words repeated. kept:
    not base_failed, and content lines hold half of the characters or more. A null or empty
    text, or one of white space, has zeros everywhere and fails. Repeated rows get the same
    result each; extra columns are ignored.
    """
    model = model or LineModel.load()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *judge(part, model)], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return map_batches(own(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, f"doc_id long, {SCHEMA}")


def keep_good(docs: DataFrame, model: LineModel | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever their names.

    Null and empty texts fail and go; repeated rows stay or go together; an empty table gives an empty result.
    """
    model = model or LineModel.load()
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in chunks(batch.column(at)):
            yield batch.slice(start, len(part)).filter(judge(part, model)[-1])

    return map_batches(docs, run, docs.schema)
