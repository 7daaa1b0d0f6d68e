"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers run one after the other, and neither builds a token:

* The splitter reads characters and marks where pretokens begin. Texts are cut into chunks of
  equal length; each chunk yields a state map (the end state for every start state), maps
  compose by a parallel prefix scan, and so every chunk learns its true start state without
  any chunk waiting for another. Marks behind the point where all start states have merged are
  final at once, so that nearly all of the work is done in a single sweep.
* The counter reads the bytes of a pretoken along a tree of states. Each transition is
  annotated with the tokens it emits, compiled when it is first walked: of the vocabulary's
  tokens that end here exactly one may follow the last token of the state where it begins.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.flat import FlatText, chunks
from tidewater.llm.shared import map_batches, own

#: Fixed value: the split pattern of byte-level BPE that the splitter below stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 256
SETTLE = 8
#: States that a worker's counter keeps before it starts afresh: a bound on memory, not on results.
MAX_STATES = 1_000_000

LETTER, ENDING, R, V, EL, E, NUMBER, OTHER, QUOTE, BLANK, SPACE, PAD = range(12)
START, LETTERS, NUMBERS, OTHERS, ONE_BLANK, ONE_SPACE, BLANKS, SPACES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_EL = range(12)
_HERE, _BEFORE = 1, 2
_RUN = {LETTER: LETTERS, ENDING: LETTERS, R: LETTERS, V: LETTERS, EL: LETTERS, E: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}


def _step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and whether a pretoken begins at this character or at the one before."""
    if kind == PAD:
        return state, 0
    afresh = _RUN.get(kind, {QUOTE: QUOTED, BLANK: ONE_BLANK, SPACE: ONE_SPACE}.get(kind, START))
    run = _RUN.get(kind, OTHERS)
    white = {BLANK: BLANKS, SPACE: SPACES}.get(kind)
    if state in (ONE_BLANK, ONE_SPACE, BLANKS, SPACES):
        if white is not None:
            return white, 0
        several = _BEFORE if state in (BLANKS, SPACES) else 0
        return (run, several) if state in (ONE_BLANK, BLANKS) else (afresh, several | _HERE)
    if state in (LETTERS, NUMBERS, OTHERS) and white is None and (run == state and (kind != QUOTE or state == OTHERS)):
        return state, 0
    if state == QUOTED:
        if kind in (OTHER, QUOTE):
            return OTHERS, 0
        if kind in (ENDING, R, V, EL):
            return {ENDING: START, R: QUOTED_R, V: QUOTED_V, EL: QUOTED_EL}[kind], 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_EL):
        if kind == (EL if state == QUOTED_EL else E):
            return START, 0
        return (LETTERS, _BEFORE) if run == LETTERS else (afresh, _BEFORE | _HERE)
    return afresh, _HERE


_STEPS = [[_step(s, k) for k in range(12)] for s in range(12)]
_NEXT = np.array([[x[0] for x in row] for row in _STEPS], np.uint8).ravel()
_MARK = np.array([[x[1] for x in row] for row in _STEPS], np.uint8).ravel()


@cache
def _kinds() -> np.ndarray:
    """The splitter's class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            out[c] = LETTER if major == "L" else NUMBER
    for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    for text, kind in (("stmd", ENDING), ("r", R), ("v", V), ("l", EL), ("e", E), ("'", QUOTE), (" ", BLANK)):
        out[[ord(x) for x in text]] = kind
    return out


def _sweep(kinds: np.ndarray, state: np.ndarray, columns: range, marks: np.ndarray | None) -> np.ndarray:
    """Walks the chunks (rows of ``kinds``, transposed) in step over ``columns``."""
    for j in columns:
        at = state * 12 + (kinds[j] if state.ndim == 1 else kinds[j][:, None])
        if marks is not None:
            marks[j] = _MARK[at]
        state = _NEXT[at]
    return state


def pretoken_starts(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pretokens begin, given the class of each character and the texts' offsets; each text begins one."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // CHUNK)
    n = int(pieces.sum())
    if not n:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(lengths)), pieces)
    head = np.concatenate([[0], np.cumsum(pieces)[:-1]])[pieces > 0]
    nth = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    begin = offsets[:-1][text] + nth * CHUNK
    end = np.minimum(begin + CHUNK, offsets[1:][text])
    at = begin[None, :] + np.arange(CHUNK)[:, None]
    grid = np.where(at < end[None, :], kinds[np.minimum(at, len(kinds) - 1)], PAD).astype(np.uint8)
    marks = np.zeros((CHUNK, n), np.uint8)

    maps = _sweep(grid, np.tile(np.arange(12, dtype=np.uint8), (n, 1)), range(SETTLE), None)
    settled = (maps == maps[:, :1]).all(axis=1)
    rest = range(SETTLE, CHUNK)
    done = np.flatnonzero(settled)
    part = np.zeros((CHUNK, len(done)), np.uint8)
    maps[done] = _sweep(grid[:, done], maps[done, 0], rest, part)[:, None]
    marks[SETTLE:, done] = part[SETTLE:]
    open_ = np.flatnonzero(~settled)
    if len(open_):
        maps[open_] = _sweep(grid[:, open_], maps[open_], rest, None)

    maps[head] = maps[head, START][:, None]  # a text's first chunk starts afresh, whatever came before
    scan, step = maps.copy(), 1
    while step < n:
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step].astype(np.intp), axis=1)
        step *= 2
    start = np.zeros(n, np.uint8)
    start[1:] = scan[:-1, 0]
    start[head] = START

    marks[:SETTLE] = 0
    first = np.zeros((CHUNK, n), np.uint8)
    state = _sweep(grid, start, range(SETTLE), first)
    marks[:SETTLE] = first[:SETTLE]
    if len(open_):
        part = np.zeros((CHUNK, len(open_)), np.uint8)
        _sweep(grid[:, open_], state[open_], rest, part)
        marks[SETTLE:, open_] = part[SETTLE:]

    out = np.zeros(len(kinds), bool)
    here, before = (marks & _HERE) > 0, (marks & _BEFORE) > 0
    out[at[here]] = True
    out[at[before] - 1] = True
    tails = np.concatenate([head[1:], [n]]) - 1
    cut = np.isin(scan[tails, 0], (QUOTED_R, QUOTED_V, QUOTED_EL))  # the text ends behind a quote and one letter
    out[offsets[1:][lengths > 0][cut] - 1] = True
    return np.flatnonzero(out)


class Counter:
    """The byte transducer: states form a tree; ``emitted`` of a state is the sum over the transitions that lead there."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        token = {bytes([b]): b for b in range(256)}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for left, right in merges:
            pair = token[left], token[right]
            self.made[pair] = token[left + right] = len(self.parts)
            self.parts.append(pair)
        self.token, self.longest = token, max(map(len, token))
        self.apart: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.emitted = [-1], [0]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both tokens would end with these two.

        Undoes the merges inside both, the latest first. At each step the tokens that face
        each other must not have had a merge that comes before the one just undone.
        """
        bound = len(self.parts)
        while True:
            if self.made.get((left, right), bound) < bound:
                return False
            if max(left, right) < 256:
                return True
            if left > right:
                bound, left = left, self.parts[left][1]
            else:  # a merge of equal rank further left is done first
                bound, right = right + 1, self.parts[right][0]

    def may_follow(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > MAX_STATES:
                self.apart.clear()
            found = self.apart[left, right] = self._stay_apart(left, right)
        return found

    def count(self, word: bytes) -> int:
        state, path = 0, [0]
        for i, byte in enumerate(word):
            there = self.next.get(state << 8 | byte)
            if there is None:
                there = self._compile(word, i + 1, path)
                self.next[state << 8 | byte] = there
            path.append(there)
            state = there
        return self.emitted[state]

    def _compile(self, word: bytes, end: int, path: list[int]) -> int:
        for begin in range(max(0, end - self.longest), end):
            token = self.token.get(word[begin:end])
            if token is not None and self.may_follow(self.last[path[begin]], token):
                self.last.append(token)
                self.emitted.append(self.emitted[path[begin]] + 1)
                return len(self.last) - 1
        raise AssertionError("a single byte is always a token")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class CompiledTokenizer:
    """A byte-level BPE tokenizer file of the tokenizers library, compiled for counting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        byte = _byte_of()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.counter = Counter([tuple(bytes(byte[c] for c in side) for side in pair) for pair in pairs])
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"{path}: added token {token['content']} takes in its surroundings")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[int, int] = {}

    def _segments(self, texts: list[str]) -> tuple[list[str], list[int], np.ndarray]:
        """Texts cut at special strings, the text of each piece, and how many special strings each text has."""
        pieces, owner, special = list(texts), list(range(len(texts))), np.zeros(len(texts), np.int64)
        for mark in self.special:
            if any(mark in x for x in pieces):
                cut = [x.split(mark) for x in pieces]
                special += np.bincount(owner, weights=[len(x) - 1 for x in cut], minlength=len(texts)).astype(np.int64)
                owner = [o for o, x in zip(owner, cut, strict=True) for _ in x]
                pieces = [y for x in cut for y in x]
        return pieces, owner, special

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as the library counts them."""
        pieces, owner, total = self._segments(texts)
        joined = "".join(pieces)
        if not joined:
            return total
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in pieces])
        starts = pretoken_starts(_kinds()[points], np.concatenate([[0], ends]).astype(np.int64))
        flat = FlatText(pa.array([joined], pa.large_string()))
        begins = np.flatnonzero((flat.bytes & 0xC0) != 0x80)[starts]
        closes = np.append(begins[1:], len(flat.bytes))
        distinct, first, which = np.unique(flat.hashes(begins, closes), return_index=True, return_inverse=True)
        if len(self.known) > MAX_STATES or len(self.counter.last) > MAX_STATES:
            self.known.clear()
            self.counter.reset()
        raw, tokens = flat.bytes.tobytes(), np.empty(len(distinct), np.int64)
        for k, key in enumerate(distinct.tolist()):
            n = self.known.get(key)
            if n is None:
                n = self.known[key] = self.counter.count(raw[begins[first[k]] : closes[first[k]]])
            tokens[k] = n
        piece = np.searchsorted(ends, starts, side="right")
        return total + np.bincount(np.array(owner)[piece], weights=tokens[which], minlength=len(texts)).astype(np.int64)


@cache
def compiled(path: str) -> CompiledTokenizer:
    """One compiled tokenizer for each worker process and file."""
    return CompiledTokenizer(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more): doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every executor. n_tokens is
    what the tokenizers library gives for the whole text without added begin or end tokens; a
    special string inside a text is one token. A null or empty text has no bytes and no tokens.
    Repeated rows get the same result each; extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for start, part in chunks(batch.column(1)):
            part = pc.fill_null(part, "")
            n = machine.counts(part.to_pylist())
            size = pc.binary_length(part).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = own(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
