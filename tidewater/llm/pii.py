"""Personal data by patterns, and by a skip-chain CRF that carries labels over to repeated and similar tokens.

Base patterns find spans and stay. The CRF labels every token with a digit or an at sign:
tokens that stand next to each other are linked in a chain, and distant tokens of a document
that share a key (the same text, last seven digits, or part before an at sign) are linked through one hub
for each key, which holds their shared potential without a link for every pair. Tokens under
a base span are evidence. Loopy message passing over all documents of a batch gives each
token's marginal; a token that the base rules missed becomes a span if its label is sure.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.flat import FlatText, chunks
from tidewater.llm.shared import map_batches, own

#: The kinds in order, and their base patterns, in forms that take time linear in the text: a number
#: is tried from its first digit only, and what a run has taken is not given back.
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

ROUNDS = 8
#: A token becomes a span if its marginal is at least this.
SURE = 0.7
#: Words before a token that tell its kind, for the features.
CUES = (("mail",), ("ip", "host", "addr"), ("card", "visa", "pan"), ("phone", "tel", "call", "mobile", "fax"))
_TRIM = ".,;:!?\"'()[]{}<>#$%&*|`~="
_MODEL = Path(__file__).with_name("pii_model.json")

Span = tuple[int, int, int]  # begin, end, kind


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain, found from the at signs so that long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        match = EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            yield begin, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by begin, then kind; matches that fail their check are dropped."""
    spans = [(a, b, 0) for a, b in _emails(text)]
    spans += [(*m.span(), 1) for m in IP.finditer(text) if all(len(x) < 4 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((*m.span(), 2))
    spans += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


@dataclass(frozen=True)
class SkipChain:
    """Weights of features (n x 5), of neighbouring labels (5 x 5) and of a shared key (one number); label 0 is none."""

    node: np.ndarray
    chain: np.ndarray
    skip: float

    @staticmethod
    def load(path: Path = _MODEL) -> SkipChain:
        kept = json.loads(path.read_text())
        return SkipChain(np.array(kept["node"]), np.array(kept["chain"]), kept["skip"])

    def save(self, path: Path = _MODEL) -> None:
        path.write_text(json.dumps({"features": FEATURES, "node": np.round(self.node, 4).tolist(), "chain": np.round(self.chain, 4).tolist(), "skip": round(self.skip, 4)}, indent=1) + "\n")


FEATURES = (
    *("bias", "at", "digits_1_3", "digits_4_6", "digits_7_9", "digits_10_13", "digits_14_19", "digits_20", "dots_3", "dots_1_2", "letters"),
    *("plus", "hyphen", "bracket", "luhn", "cue_email", "cue_ip", "cue_card", "cue_phone"),
)


def features(token: str, before: str) -> list[float]:
    core = token.strip(_TRIM)
    digits = "".join(c for c in core if "0" <= c <= "9")
    n, dots, cue = len(digits), core.count("."), before.lower()
    letters = any(c.isalpha() for c in core)
    return [
        1,
        "@" in core,
        1 <= n <= 3,
        4 <= n <= 6,
        7 <= n <= 9,
        10 <= n <= 13,
        14 <= n <= 19,
        n >= 20,
        dots == 3 and not letters,
        dots in (1, 2) and not letters,
        letters,
        token.startswith("+"),
        "-" in core,
        "(" in token,
        14 <= n <= 19 and luhn(digits),
        *(any(x in cue for x in words) for words in CUES),
    ]


_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
_LAST_NUMBER = re.compile(r"[0-9][0-9 ().\-_/]*$")


def keys(token: str) -> str | None:
    """What a token shares with its repeats and with tokens like it; short numbers share nothing.

    The last seven digits of the number that ends it, whatever stands before; an address's part
    before its at sign; else the text, if it has letters and three digits.
    """
    core = token.strip(_TRIM).lower()
    at = _AT.search(core)
    if at:
        return core[: at.start()] or core
    last = _LAST_NUMBER.search(core[-40:])
    digits = "".join(c for c in last.group() if "0" <= c <= "9") if last else ""
    if len(digits) >= 7:
        return digits[-7:]
    return core if any(c.isalpha() for c in core) and sum("0" <= c <= "9" for c in core) >= 3 else None


@dataclass
class Graph:
    """Tokens of a batch: features, evidence (kind + 1, or 0), chain links i to i + 1, and each token's hub or -1."""

    features: np.ndarray
    evidence: np.ndarray
    linked: np.ndarray
    hub: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(model: SkipChain, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
    """Each token's label probabilities by loopy sum-product message passing."""
    n = len(graph.features)
    own_ = graph.features @ model.node
    own_[graph.evidence > 0] = -30.0
    own_[np.flatnonzero(graph.evidence), graph.evidence[graph.evidence > 0]] = 0.0
    left = np.flatnonzero(graph.linked)  # links left to left + 1
    shared = np.flatnonzero(graph.hub >= 0)
    hub = graph.hub[shared]
    agree = model.skip * np.eye(5)
    ahead, back, to_hub, from_hub = (np.zeros((n, 5)) for _ in range(4))
    belief = own_
    for _ in range(rounds):
        belief = own_ + ahead + back + from_hub
        new_ahead, new_back = np.zeros((n, 5)), np.zeros((n, 5))
        new_ahead[left + 1] = _lse((belief - back)[left][:, :, None] + model.chain, 1)
        new_back[left] = _lse((belief - ahead)[left + 1][:, None, :] + model.chain, 2)
        to_hub[shared] = _lse((belief - from_hub)[shared][:, :, None] + agree, 1)
        to_hub[shared] -= to_hub[shared].max(axis=1, keepdims=True)
        total = np.zeros((int(hub.max()) + 1 if len(hub) else 0, 5))
        np.add.at(total, hub, to_hub[shared])
        from_hub[shared] = _lse((total[hub] - to_hub[shared])[:, :, None] + agree, 1)
        ahead, back = new_ahead, new_back
        for m in (ahead, back, from_hub):
            m -= m.max(axis=1, keepdims=True)
    belief = own_ + ahead + back + from_hub
    return np.exp(belief - _lse(belief, 1)[:, None])


def find_spans(texts: pa.Array, model: SkipChain) -> tuple[list[list[Span]], list[list[Span]]]:
    """For each text: the base spans, and the spans that the model adds (which overlap no base span)."""
    flat = FlatText(texts)
    b = flat.bytes
    mark = ((b >= 48) & (b <= 57)) | (b == 64)
    base: list[list[Span]] = [[] for _ in range(flat.n)]
    added: list[list[Span]] = [[] for _ in range(flat.n)]
    rich = np.flatnonzero(flat.counts(mark))
    if not len(rich):
        return base, added
    whole = {i: texts[i].as_py() for i in rich.tolist()}
    for i, text in whole.items():
        base[i] = base_spans(text)
    starts, ends, first = flat.words()
    marks = np.zeros(len(b) + 1, np.int64)
    np.cumsum(mark, out=marks[1:])
    chosen = np.flatnonzero(marks[ends] > marks[starts])
    owner = np.searchsorted(first, chosen, side="right") - 1
    points = flat.code_points()
    begin, end = points[starts] - points[flat.offsets[:-1]][np.searchsorted(first, np.arange(len(starts)), side="right") - 1], points[ends]
    end = begin + end - points[starts]
    rows, evidence, hubs, hub_of, near = [], np.zeros(len(chosen), np.int64), {}, [], 0
    last_owner = -1
    for k, (w, i) in enumerate(zip(chosen.tolist(), owner.tolist(), strict=True)):
        if i != last_owner:
            last_owner, near = i, 0
        a, z = int(begin[w]), int(end[w])
        token = whole[i][a:z]
        before = whole[i][begin[w - 1] : end[w - 1]] if w > first[i] else ""
        rows.append(features(token, before))
        key = keys(token)
        hub_of.append(-1 if key is None else hubs.setdefault((i, key), len(hubs)))
        found = base[i]
        while near < len(found) and max(found[near][1], *(s[1] for s in found[near : near + 4])) <= a:
            near += 1
        for s in found[near : near + 8]:
            if s[0] < z and s[1] > a:
                evidence[k] = s[2] + 1
                break
    linked = np.append((np.diff(chosen) == 1) & (np.diff(owner) == 0), False)
    sure = marginals(model, Graph(np.array(rows, float), evidence, linked, np.array(hub_of)))
    label = sure.argmax(axis=1)
    new = np.flatnonzero((label > 0) & (evidence == 0) & (sure.max(axis=1) >= SURE))
    previous = -2
    for k in new.tolist():
        i, w, kind = int(owner[k]), int(chosen[k]), int(label[k]) - 1
        token = whole[i][begin[w] : end[w]]
        a = int(begin[w]) + len(token) - len(token.lstrip(_TRIM.replace("(", "")))
        z = int(end[w]) - len(token) + len(token.rstrip(_TRIM.replace(")", "")))
        if z <= a:
            continue
        spans = added[i]
        if previous == k - 1 and linked[previous] and spans and spans[-1][2] == kind:
            spans[-1] = (spans[-1][0], z, kind)
        else:
            spans.append((a, z, kind))
        previous = k
    return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more) with the columns of ``SCHEMA``.

    n_email to n_phone count base spans; base_sha256 is of kind:begin:end of the base spans in
    code points, by begin, then kind, comma-joined; spans has the base spans and the n_added
    that the model adds, joined likewise. Base spans of different kinds may overlap; added ones
    overlap no base span. A null or empty text has none. Repeated rows get the same result
    each; extra columns are ignored.
    """
    model = model or SkipChain.load()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in chunks(batch.column(1)):
            base, added = find_spans(pc.fill_null(part, ""), model)
            counts = [[sum(s[2] == k for s in spans) for spans in base] for k in range(4)]
            digests = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            every = [_joined(sorted(x + y, key=lambda s: (s[0], s[2]))) for x, y in zip(base, added, strict=True)]
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array([len(x) for x in added], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(own(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, SCHEMA)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in angle brackets."""
    out, done = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact_pii(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """``docs`` with ``text`` redacted and ``n_chars``, where there is one, counted anew; null texts stay null."""
    model = model or SkipChain.load()
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in chunks(batch.column(at)):
            base, added = find_spans(pc.fill_null(part, ""), model)
            texts = [t if t is None or not (x or y) else redact(t, x + y) for t, x, y in zip(part.to_pylist(), base, added, strict=True)]
            columns = [c.slice(start, len(part)) for c in batch.columns]
            columns[at] = pa.array(texts, part.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


# Training: texts with planted personal data whose labels are known. No text of any table is read.

#: Number of generated texts that a fit reads.
FIT_TEXTS = 3000


def generated(n: int, seed: int = 1) -> Iterator[tuple[list[str], list[int]]]:
    """Texts as tokens with labels: entities first in full, later without what the base patterns need; and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "tion", "le", "ou", "st", "re")) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    other = (lambda: str(r.randint(1, 2100)), lambda: f"{r.randint(1, 99)}.{digits(2)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", lambda: hashlib.md5(digits(9).encode()).hexdigest()[: r.randint(8, 32)], lambda: digits(r.randint(5, 16)), lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"@{word()}", lambda: f"{digits(3)}-{digits(4)}")
    for _ in range(n):
        tokens, labels = [], []

        def say(*pairs: tuple[str, int], tokens: list[str] = tokens, labels: list[int] = labels) -> None:
            for t, y in pairs:
                tokens.append(t)
                labels.append(y)

        entities = []
        for _ in range(r.randint(0, 4)):
            kind = r.randrange(4)
            if kind == 0:
                name, host = f"{word()}.{digits(2)}", word()
                entities.append((kind, [(f"{name}@{host}.example.com", 1)], [(f"{name}@{host}", 1)]))
            elif kind == 1:
                ip = ".".join(str(r.randint(1, 255)) for _ in range(4))
                entities.append((kind, [(ip, 2)], [(ip.replace(".", "-"), 2)]))
            elif kind == 2:
                body = digits(15)
                card = next(body + c for c in "0123456789" if luhn(body + c))
                entities.append((kind, [(card, 3)], [(f"x{'x' * r.randint(0, 4)}{card[-7:]}".strip("x"), 3)]))
            else:
                area, a, b = digits(3), digits(3), digits(4)
                entities.append((kind, [("+1", 4), (f"({area})", 4), (f"{a}-{b}", 4)], r.choice(([(f"({area})", 4), (f"{a}-{b}", 4)], [(f"{area}-{a}-{b}", 4)], [(f"{a}-{b}", 4)]))))
        said = [e[1] for e in entities] + [e[2] for e in entities if r.random() < 0.6]
        said += [[(r.choice(other)(), 0)] for _ in range(r.randint(0, 5))]
        if r.random() < 0.3:
            twice = [(digits(r.randint(7, 12)), 0)]
            said += [twice, twice]
        r.shuffle(said)
        for mention in said:
            for _ in range(r.randint(1, 5)):
                say((word(), 0))
            if mention[0][1] and r.random() < 0.2:
                say((r.choice(CUES[mention[0][1] - 1]), 0))
            say(*mention)
        yield tokens, labels


def fit_pii(n: int = FIT_TEXTS, rounds: int = 600, rate: float = 0.05, decay: float = 1e-3) -> SkipChain:
    """Pseudo-likelihood: each token's label given its features, its neighbours' labels and its key's other labels."""
    rows, labels, before, after, same = [], [], [], [], []
    for tokens, ys in generated(n):
        use = [i for i, t in enumerate(tokens) if "@" in t or any(c.isdigit() for c in t)]
        marked, by_key = set(use), {}
        for i in use:
            by_key.setdefault(keys(tokens[i]), []).append(i)
        for i in use:
            rows.append(features(tokens[i], tokens[i - 1] if i else ""))
            labels.append(ys[i])
            before.append(ys[i - 1] if i - 1 in marked else -1)
            after.append(ys[i + 1] if i + 1 in marked else -1)
            others = {ys[j] for j in by_key[keys(tokens[i])] if j != i} if keys(tokens[i]) else set()
            same.append([float(y in others) for y in range(5)])
    x, y, same_ = np.array(rows, float), np.array(labels), np.array(same)
    left, right = np.eye(6)[before][:, :5], np.eye(6)[after][:, :5]
    k = x.shape[1] * 5
    flat, m, v, want = np.zeros(k + 26), np.zeros(k + 26), np.zeros(k + 26), np.eye(5)[y]
    for t in range(1, rounds + 1):
        node, chain, skip = flat[:k].reshape(-1, 5), flat[k : k + 25].reshape(5, 5), flat[-1]
        score = x @ node + left @ chain + right @ chain.T + skip * same_
        miss = want - np.exp(score - _lse(score, 1)[:, None])
        slope = np.concatenate([(x.T @ miss).ravel(), (left.T @ miss + miss.T @ right).ravel(), [(miss * same_).sum()]]) / len(y) - decay * flat
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        flat = flat + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return SkipChain(flat[:k].reshape(-1, 5), flat[k : k + 25].reshape(5, 5), float(flat[-1]))
