"""MinHash near-duplicate detection by a chosen-path similarity join.

1. One pass over the texts makes each document's shingle set, and from it a digest, 64
   minwise tokens and the number of shingles. Full sets don't leave the task.
2. Documents with equal digests have equal sets; one representative of each goes on.
3. Independent trees branch the representatives: a root by one minwise token, and while a
   node is larger than ``node_limit``, each of its documents goes on along two further
   tokens that the node's own path chooses. Documents that agree on all chosen tokens meet.
   A node that holds most of its parent may be of documents alike throughout, which
   branching would only repeat: it is dealt into blocks with some members in common, and
   members that hang together with one of these, the hub, are a cluster. Those that don't
   meet all members of the node, block against block, or where they are many the node is
   branched on. A node that is still large at ``MAX_DEPTH`` is compared block against block.
   A pair at the threshold survives a tree with probability above 0.8 however deep it goes,
   so that eight trees miss about one pair in a million.
4. Small nodes are compared exhaustively on their tokens. A node's likely links leave it as
   a spanning forest, never as all pairs.
5. Components of these forests are candidate clusters. Each member's full set goes to its
   cluster once, and there every link is confirmed on full sets. Two linked sets share one of
   their rarest shingles: of a set of n, one of the first (1 - threshold) * n + 1 in order of
   frequency. Only sets that do are compared, so that texts of one template cost no more than
   their own near copies.
6. A cluster whose sets exceed ``block_bytes`` is first cut by the same rule into parts that
   share no such shingle. In a part that is still too large, sets become differences from a core
   that most of some members have, which are small among texts of one template, and overlaps
   are counted on these. What doesn't fit a block then either is dealt into blocks that all have some
   members, the pivots, in common. Members that hang together with the hub, the pivot that
   most pivots are linked with, are done; the rest meets all members, block against block.
   All links are found, and no task grows with the cluster.

No step draws a sample or drops a partner. Results for the same rows are the same in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.flat import U64, chunks, mix, shingle_sets
from tidewater.llm.shared import map_batches, own, staged, unstaged

TOKENS = 64
TREES = 8
#: Clusters of so few sets are compared without an index of rare shingles.
FEW_SETS = 24
#: The frequency of shingles in large clusters is counted in so many slots, in which rare ones may meet; any order is right.
SLOTS = 1 << 20
#: Members that the blocks of a large part have in common.
COMMON = 8
MAX_DEPTH = 6
PIVOTS = 32
#: Up to so many node limits of members apart from a hub meet all others directly.
FEW = 4
_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def minwise(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise tokens of each set, as 64-bit values; an empty set has zeros."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, TOKENS), U64)
    if len(some):
        starts = offsets[:-1][some]
        for k, seed in enumerate(_SEEDS):
            out[some, k] = np.minimum.reduceat((hashes ^ (hashes >> U64(29))) * seed, starts)
    return out


def _packed(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of each set."""
    raw = hashes.tobytes()
    return [raw[a * 8 : b * 8] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _signatures(words: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), batch.column(1)
        for start, part in chunks(texts):
            hashes, offsets = shingle_sets(part, words)
            tokens = minwise(hashes, offsets)
            digests = [_digest(x) for x in _packed(hashes, offsets)]
            short = mix(tokens).astype(np.uint16)
            roots = (tokens[:, :TREES] >> U64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, len(part)),
                    batch.column(2).slice(start, len(part)),
                    pa.array(np.diff(offsets)),
                    pa.array(digests, pa.binary()),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, roots.size + 1, TREES, dtype=np.int32), pa.array(roots.ravel())),
                ],
                ["doc_id", "key", "n_shingles", "digest", "tokens", "roots"],
            )

    return run


def forest(alike, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` items; ``alike(i, others)`` tells which others item i links to."""
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        front = [seed]
        while front:
            left = np.flatnonzero(label < 0)
            if not len(left):
                break
            found = left[alike(front.pop(), left)]
            label[found] = seed
            front.extend(found.tolist())
    return label


def _least(threshold: float) -> int:
    """So many tokens of a pair at the threshold agree at least, but for 4.5 standard deviations."""
    return int(np.floor(TOKENS * (threshold - 4.5 * (threshold * (1 - threshold) / TOKENS) ** 0.5)))


def _likely(threshold: float):
    """For a node: a spanning forest of the pairs whose tokens agree nearly as often as the threshold asks."""
    least = _least(threshold)

    def run(node: pa.Table) -> pa.Table:
        ids = node.column("rid").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        tokens = np.frombuffer(b"".join(node.column("tokens").to_pylist()), np.uint16).reshape(-1, TOKENS)[order]
        label = forest(lambda i, others: (tokens[others] == tokens[i]).sum(axis=1) >= least, len(ids))
        linked = label != np.arange(len(ids))
        return pa.table({"a": ids[linked], "b": ids[label[linked]]})

    return run


def _around_hub(threshold: float):
    """For a block of a dense node: its forest, and for each member whether it is apart from the hub."""
    least = _least(threshold)

    def run(block: pa.Table) -> pa.Table:
        ids = block.column("rid").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        tokens = np.frombuffer(b"".join(block.column("tokens").to_pylist()), np.uint16).reshape(-1, TOKENS)[order]
        pivots = np.flatnonzero(block.column("pivot").to_numpy(zero_copy_only=False)[order])
        label = forest(lambda i, others: (tokens[others] == tokens[i]).sum(axis=1) >= least, len(ids))
        apart = np.ones(len(ids), bool)
        if len(pivots):
            # Every block has the same pivots, so that all choose the same hub.
            near = [int(((tokens[pivots] == tokens[i]).sum(axis=1) >= least).sum()) for i in pivots]
            apart = label != label[pivots[int(np.argmax(near))]]
        return pa.table({"node": pa.array(np.full(len(ids), block.column("node")[0].as_py())), "a": ids, "b": ids[label], "rest": apart})

    return run


def _prefix(percent: int, size: np.ndarray) -> np.ndarray:
    """So many of a set's shingles, in any order common to all sets, hold one of each set it is linked with."""
    return (100 - percent) * size // 100 + 1


class _Overlaps:
    """How many terms each of ``n`` sets shares with all others, read off what sets them apart.

    Terms of more than half of the sets are a core. Two sets share the core but for what either lacks,
    plus what both lack, plus what both have besides it: so only differences from the core are indexed,
    and texts of one template cost as little as they differ.
    """

    def __init__(self, n: int, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        column = np.cumsum(2 * count > n) - 1
        major = 2 * count[term] > n
        self.n, self.core = n, int((2 * count > n).sum())
        there = np.zeros((n, self.core), bool)
        there[owner[major], column[term[major]]] = True
        lacking, lacked = np.nonzero(~there)
        self.lacks = np.bincount(lacking, minlength=n)
        own = ~major & (count[term] > 1)
        holder, what = np.concatenate([owner[own], lacking]), np.concatenate([term[own], len(count) + lacked])
        order = np.argsort(holder, kind="stable")
        self.what = what[order]
        self.begin = np.searchsorted(holder[order], np.arange(n + 1))
        by_what = np.argsort(what, kind="stable")
        self.post = holder[by_what].astype(np.int32)
        self.at = np.searchsorted(what[by_what], np.arange(len(count) + self.core + 1))
        steps = np.concatenate([[0], np.cumsum(self.at[self.what + 1] - self.at[self.what])])
        self.cost = np.diff(steps[self.begin])

    def of(self, i: int) -> np.ndarray:
        mine = self.what[self.begin[i] : self.begin[i + 1]]
        lengths = self.at[mine + 1] - self.at[mine]
        done = np.cumsum(lengths)
        met = self.post[np.repeat(self.at[mine] - (done - lengths), lengths) + np.arange(int(done[-1]) if len(done) else 0)]
        return self.core - self.lacks[i] - self.lacks + np.bincount(met, minlength=self.n)


def exact_forest(ids: np.ndarray, packed: list[bytes], percent: int, coded: Coded | None = None) -> np.ndarray:
    """The smallest index reachable from each set over links confirmed on full sets; equal ids are one.

    With ``coded``, ``packed`` holds each set's differences from a core that all of them have in common.
    """
    length = np.array([len(x) // 8 for x in packed], np.int64)
    size, core, lacks = (length, 0, np.zeros(len(ids), np.int64)) if coded is None else (coded.size, coded.core, coded.lacks)
    flat = np.frombuffer(b"".join(packed), U64)
    _, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(len(ids)), length)
    marked = np.zeros(len(count), bool)
    twice = len(np.unique(ids)) < len(ids)
    index: list[_Overlaps] = []
    read = 0

    def shared(i: int, near: np.ndarray) -> np.ndarray:
        """Reads the sets of the others, or where that would be more, the index of differences."""
        nonlocal read
        left = int(length[near].sum())
        read += left
        if not index and read > 4 * len(flat):
            index.append(_Overlaps(len(ids), owner, term, count))
        if index and index[0].cost[i] < left:
            return index[0].of(i)[near]
        mine = term[first[i] : first[i + 1]]
        marked[mine] = True
        done = np.cumsum(length[near])
        places = np.repeat(first[near] - (done - length[near]), length[near]) + np.arange(left)
        found = np.bincount(np.repeat(np.arange(len(near)), length[near]), marked[term[places]], len(near)).astype(np.int64)
        marked[mine] = False
        return found

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        """Of the others, which dwindle as links are found, only those of a fitting size are compared."""
        linked = np.zeros(len(others), bool)
        fits = np.flatnonzero(100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others]))
        near = others[fits]
        if len(near):
            both = core - lacks[i] - lacks[near] + shared(i, near)
            linked[fits] = 100 * both >= percent * (size[i] + size[near] - both)
        return linked | (ids[others] == ids[i]) if twice else linked

    if len(ids) <= FEW_SETS or coded is not None:
        return forest(alike, len(ids))
    order = np.lexsort((term, count[term], owner))
    place = np.arange(len(term)) - first[owner]
    kept = order[(place < _prefix(percent, size)[owner]) & (count[term[order]] > 1)]
    rare, holder = term[kept], owner[kept]
    begin = np.searchsorted(holder, np.arange(len(ids) + 1))
    by_term = np.argsort(rare, kind="stable")
    post = holder[by_term]
    at = np.searchsorted(rare[by_term], np.arange(len(count) + 1))

    def partners(i: int, others: np.ndarray) -> np.ndarray:
        """Of the others, those that share a rare shingle."""
        mine = rare[begin[i] : begin[i + 1]]
        lengths = at[mine + 1] - at[mine]
        done = np.cumsum(lengths)
        met = np.zeros(len(ids), bool)
        if len(done):
            met[post[np.repeat(at[mine] - (done - lengths), lengths) + np.arange(int(done[-1]))]] = True
        found = met[others]
        if twice:
            found |= ids[others] == ids[i]
        found[found] = alike(i, others[found])
        return found

    return forest(partners, len(ids))


@dataclass(frozen=True)
class Coded:
    """Of sets that are stored as differences from a core: their sizes, the core's, and how much of it each lacks."""

    size: np.ndarray
    core: int
    lacks: np.ndarray


def core_of(packed: list[bytes]) -> np.ndarray:
    """Terms of more than half of the sets. Any core is right; one that most sets have makes differences small."""
    term, count = np.unique(np.frombuffer(b"".join(packed), U64), return_counts=True)
    return term[2 * count > len(packed)]


def differences(packed: bytes, core: np.ndarray) -> tuple[bytes, int]:
    """A set's terms beyond the core and, turned over, those of the core that it lacks; and the number of the latter."""
    terms = np.frombuffer(packed, U64)
    lacking = np.setdiff1d(core, terms, assume_unique=True)
    return np.concatenate([np.setdiff1d(terms, core, assume_unique=True), ~lacking]).tobytes(), len(lacking)


def _sorted_sets(members: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray, Coded | None]:
    ids = members.column("rid").to_numpy()
    order = np.argsort(ids, kind="stable")
    coded = Coded(members.column("n").to_numpy()[order], members.column("core")[0].as_py(), members.column("lacks").to_numpy()[order]) if "core" in members.column_names else None
    return ids[order], members.column("shingles").combine_chunks().take(pa.array(order)).to_pylist(), order, coded


def _exact(percent: int):
    """For the sets of a cluster, or of two of its blocks: the confirmed links, as stars on the smallest id."""

    def run(members: pa.Table) -> pa.Table:
        ids, packed, _, coded = _sorted_sets(members)
        return pa.table({"a": ids, "b": ids[exact_forest(ids, packed, percent, coded)]})

    return run


def _exact_around_hub(percent: int):
    """For a block of a large part: its confirmed links as stars, and for each member whether it is apart from the hub."""

    def run(block: pa.Table) -> pa.Table:
        ids, packed, order, coded = _sorted_sets(block)
        common = np.flatnonzero(block.column("pivot").to_numpy(zero_copy_only=False)[order])
        label = exact_forest(ids, packed, percent, coded)
        # Every block has the same pivots; how these are linked among themselves is the same in all.
        own_label = exact_forest(ids[common], [packed[i] for i in common], percent, Coded(coded.size[common], coded.core, coded.lacks[common]))
        hub = common[int(own_label[np.bincount(own_label).argmax() if len(common) else 0])] if len(common) else 0
        part = np.full(len(ids), block.column("part")[0].as_py())
        return pa.table({"part": part, "a": ids, "b": ids[label], "rest": label != label[hub]})

    return run


def _verdicts(docs: DataFrame, words: int, percent: int, node_limit: int, block_bytes: int) -> DataFrame:
    """A row for each row of ``docs``: doc_id, key (hash of the text), n_shingles, component_id, first.

    A vertex is 64 bits of a set's digest, so that rows are linked by their own sets whatever
    their ids. first: the least (doc_id, digest, key) of the row's group, null where it has none.
    """
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    schema = "doc_id long, key long, n_shingles long, digest binary, tokens binary, roots array<long>"
    signed = staged(map_batches(rows, _signatures(words), schema), "signatures")
    alike = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    least, one = F.min(F.struct("doc_id", "digest", "key")).alias("least"), lambda c: F.first(c).alias(c)
    classes = staged(alike.agg(least, F.first("n_shingles").alias("n"), one("tokens"), one("roots")).withColumn("rid", F.xxhash64("digest")), "classes")
    likely = components(_candidates(classes, percent / 100, node_limit))
    likely = staged(likely.withColumnsRenamed({"id": "rid", "component": "cluster"}), "clusters")
    links = _confirmed(rows, classes, likely, words, percent, block_bytes)
    grouped = staged(classes.select("digest", "rid", "least").join(links, "rid"), "linked")
    firsts = staged(grouped.groupBy("component").agg(F.min("least").alias("first")), "firsts")
    named = grouped.join(firsts, "component").select("digest", "first")
    alone = classes.join(links, "rid", "left_anti").select("digest", F.col("least").alias("first"))
    members = named.unionByName(alone)
    whose = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest")
    return (
        signed.select("doc_id", "key", "n_shingles", whose)
        .join(members, "digest", "left")
        .select("doc_id", "key", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "digest", "first")
    )


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, node_limit: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``words``-word shingles. component_id is the smallest doc_id reachable over links, kept is
    true for that document. Null or empty texts, and texts without words, have no shingles and
    no links. A repeated row gets the same result again; rows that share a doc_id but not a
    text are each linked by their own set. A row without doc_id is linked with nothing, has no
    component_id, and is kept. Extra columns are ignored.
    """
    judged = _verdicts(docs, words, percent, node_limit, block_bytes)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _candidates(classes: DataFrame, threshold: float, node_limit: int) -> DataFrame:
    """Edges (a, b) between representatives that a tree brings together and whose tokens say they may be linked."""
    level = classes.select("rid", F.posexplode("roots").alias("tree", "token")).select(
        F.xxhash64("tree", "token").alias("node"), "rid", F.lit(None).cast("long").alias("parent_members")
    )
    leaves: DataFrame | None = None
    hubs: DataFrame | None = None
    sets = classes.select("rid", "tokens")
    for depth in range(MAX_DEPTH + 1):
        # Staged, so that the join meets a table of known size: broadcast if small, else split where a node is hot.
        sizes = staged(level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes")
        level = staged(level.join(sizes, "node"), "nodes")
        small = level.where(F.col("members") <= node_limit).select("node", "rid")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = level.where(F.col("members") > node_limit)
        if large.isEmpty():
            break
        dense = F.coalesce(2 * F.col("members") > F.col("parent_members"), F.lit(False)) | F.lit(depth == MAX_DEPTH)
        if not large.where(dense).isEmpty():
            stars, across, large = _hubs(large, dense, sets, threshold, node_limit, depth == MAX_DEPTH)
            hubs = stars if hubs is None else hubs.unionByName(stars)
            leaves = leaves.unionByName(across)
        if depth == MAX_DEPTH:
            break
        # Two tokens, one even and one odd, that the path so far chooses; 2 bytes each, from 1 on.
        chosen = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(TOKENS // 2)) * 2 + F.col("side")
        level = (
            large.select("node", "rid", "members", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
            .join(sets, "rid")
            .select(F.xxhash64("node", "side", F.substring(F.col("tokens"), (chosen * 2 + 1).cast("int"), F.lit(2))).alias("node"), "rid", F.col("members").alias("parent_members"))
        )
    edges = leaves.distinct().join(sets, "rid").groupBy("node").applyInArrow(_likely(threshold), "a long, b long")
    return (edges if hubs is None else edges.unionByName(hubs)).distinct()


def _hubs(large: DataFrame, dense: Column, sets: DataFrame, threshold: float, node_limit: int, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of the dense nodes to their hubs, small nodes in which the rest meets all members, and the nodes still to branch.

    Blocks of a dense node share some members, the pivots. What hangs together with the hub,
    the pivot that most pivots resemble, is one cluster; the rest, which doesn't, must still
    meet every member of the node. A small rest does so block against block, and so does any
    rest of the last level. With a larger rest, the whole node is branched.
    """
    blocks = _blocks(large.where(dense), node_limit)
    found = staged(blocks.join(sets, "rid").groupBy("node", "block").applyInArrow(_around_hub(threshold), "node long, a long, b long, rest boolean"), "hubs")
    rest = found.groupBy("node", F.col("a").alias("rid")).agg(F.min("rest").alias("rest")).where("rest").drop("rest")
    counts = staged(rest.groupBy("node").agg(F.count(F.lit(1)).alias("n_rest")), "rests")
    few = F.lit(last) | (F.col("n_rest") <= FEW * node_limit)
    half = node_limit // 2
    deal = lambda n: F.pmod(F.xxhash64("rid", "node"), F.ceil(F.col(n) / half).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / half).cast("long") - 1))
    crossed = large.where(dense).join(counts.where(few), "node")
    named = lambda i, j: F.xxhash64("node", F.lit("across"), i, j).alias("node")
    all_members = crossed.select("node", "rid", deal("members").alias("i"), every("n_rest").alias("j")).select(named("i", "j"), "rid")
    sizes = crossed.select("node", "members", "n_rest").distinct()
    the_rest = rest.join(sizes, "node").select("node", "rid", deal("n_rest").alias("j"), every("members").alias("i")).select(named("i", "j"), "rid")
    on = large.where(~dense).unionByName(large.where(dense).join(counts.where(~few), "node", "left_semi"))
    return found.where("a <> b").select("a", "b"), all_members.unionByName(the_rest), on


def _blocks(large: DataFrame, node_limit: int) -> DataFrame:
    """(node, block, rid, pivot): members dealt by hash, and some of them, the pivots, in every block of their node."""
    order = F.xxhash64("node", "rid")
    step = F.greatest(F.lit(1), F.ceil(F.col("members") / (node_limit - 4 * PIVOTS))).cast("long")
    dealt = large.withColumn("blocks", step).withColumn("order", order)
    pivot = F.pmod(F.col("order"), F.greatest(F.lit(1), (F.col("members") / PIVOTS).cast("long"))) == 0
    blocks = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.shiftrightunsigned("order", 20), F.col("blocks"))))
    return dealt.select("node", "rid", pivot.alias("pivot"), F.explode(blocks).alias("block"))


def _confirmed(rows: DataFrame, classes: DataFrame, likely: DataFrame, words: int, percent: int, block_bytes: int) -> DataFrame:
    """(rid, component) of every representative with a link, from links confirmed on full sets."""
    spark = rows.sparkSession
    sized = likely.join(classes.select("rid", "n", "least.doc_id", "least.key"), "rid")
    bytes_ = sized.groupBy("cluster").agg(F.ceil(F.sum("n") * 8 / block_bytes).cast("long").alias("blocks"))
    members = staged(sized.join(staged(bytes_, "bytes"), "cluster"), "members")
    n, most = members.agg(F.count(F.lit(1)), F.max("blocks")).first()
    if not n:
        return members.select("rid", F.col("cluster").alias("component"))
    sets = _member_sets(rows, members, n, words).join(members.select("rid", "cluster", "n", "blocks"), "rid")
    if most == 1:
        stars = staged(sets.groupBy("cluster").applyInArrow(_exact(percent), "a long, b long"), "links")
        return stars.groupBy(F.col("a").alias("rid")).agg(F.min("b").alias("component"))
    sets = staged(sets, "sets")
    small = sets.where("blocks = 1").select(F.col("cluster").alias("part"), "rid", "shingles")
    parts = staged(_parts(spark, sets.where("blocks > 1"), percent), "parts")
    larger = sets.where("blocks > 1").select("rid", "n", "shingles").join(parts, "rid")
    weights = staged(larger.groupBy("part").agg(F.ceil(F.sum("n") * 8 / block_bytes).cast("long").alias("blocks")), "weights")
    larger = staged(larger.join(weights, "part"), "larger")
    small = small.unionByName(larger.where("blocks = 1").select("part", "rid", "shingles"))
    edges = small.groupBy("part").applyInArrow(_exact(percent), "a long, b long")
    large = larger.where("blocks > 1")
    if not large.isEmpty():
        edges = edges.unionByName(_large_parts(large, percent, block_bytes))
    return components(edges).withColumnsRenamed({"id": "rid"})


def _bits(n: int) -> int:
    """Size of a bit table for ``n`` keys: 16 bits a key, of 16 MB at most."""
    return min(1 << 27, max(1 << 16, 1 << int(16 * n).bit_length()))


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "key"), F.lit(bits))


def _bit_table(keys: DataFrame, bits: int) -> DataFrame:
    """(_at, _bits): the bits of (doc_id, key) rows, 32,768 in a row."""
    slots = keys.select(_slot(bits).alias("slot"))
    return slots.groupBy(F.shiftright("slot", 15).alias("_at")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("_bits"))


def _member_sets(rows: DataFrame, members: DataFrame, n: int, words: int) -> DataFrame:
    """(rid, shingles) of the ``n`` members, each once, made from the texts anew.

    A bit table of at most 16 MB, whatever the input, tells which texts to read; a bit too many
    only moves a set in vain. Of other texts' sets 0.7 % move with a million members, 9 % with 13
    million, 63 % with 134 million, nearly all beyond that.
    """
    bits = _bits(n)
    table = np.zeros(bits // 8, np.uint8)
    for at, piece in _bit_table(members, bits).collect():
        table[at * 4096 : at * 4096 + len(piece)] = np.frombuffer(bytes(piece), np.uint8)[: max(0, len(table) - at * 4096)]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slots = batch.column(1).to_numpy()
        batch = batch.filter(pa.array((shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1))
        for _, part in chunks(batch.column(0)):
            packed = _packed(*shingle_sets(part, words))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in packed], pa.binary()), pa.array(packed, pa.binary())], ["digest", "shingles"])

    marked = rows.where("doc_id is not null").select("text", _slot(bits).alias("slot"))
    whole = map_batches(marked, sets, "digest binary, shingles binary").where(F.length("shingles") > 0)
    return whole.select(F.xxhash64("digest").alias("rid"), "shingles").dropDuplicates(["rid"])


def _parts(spark, large: DataFrame, percent: int) -> DataFrame:
    """(rid, part): members of large clusters that hang together by shared rare shingles; those that share none are left out.

    Every link is inside a part: linked sets share a shingle of their prefixes, in the order
    of how often a shingle's slot occurs.
    """

    def slots(cluster: int, terms: np.ndarray) -> np.ndarray:
        return (mix(terms ^ np.array(cluster, np.int64).view(U64)) & U64(SLOTS - 1)).astype(np.int64)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = [slots(c, np.frombuffer(x, U64)) for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        slot, n = np.unique(np.concatenate(every), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])

    counted = map_batches(large.select("cluster", "shingles"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SLOTS, np.int64)  # one row for each slot at most
    frequency[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(frequency)

    def prefixes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for cluster, rid, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = np.frombuffer(packed, U64)
            rare = terms[np.lexsort((terms, shared.value[slots(cluster, terms)]))[: int(_prefix(percent, np.array(len(terms))))]]
            size = len(rare)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, cluster)), pa.array(rare.view(np.int64)), pa.array(np.full(size, rid))], ["cluster", "term", "rid"])

    posts = staged(map_batches(large.select("cluster", "rid", "shingles"), prefixes, "cluster long, term long, rid long"), "prefixes")
    least = posts.groupBy("cluster", "term").agg(F.min("rid").alias("least"), F.max("rid").alias("last")).where("least < last").drop("last")
    edges = posts.join(staged(least, "least"), ["cluster", "term"]).select(F.col("rid").alias("a"), F.col("least").alias("b"))
    return components(edges).withColumnsRenamed({"id": "rid", "component": "part"})


def _coded(large: DataFrame, common: DataFrame) -> DataFrame:
    """(part, rid, n, core, lacks, shingles): each set as its differences from a core of its part, which some members tell.

    One core for each large part; a core is as large as a set.
    """

    def core(members: pa.Table) -> pa.Table:
        return pa.table({"part": members.column("part")[:1], "core": pa.array([core_of(members.column("shingles").to_pylist()).tobytes()], pa.binary())})

    cores = staged(large.select("part", "rid", "shingles").join(common, ["part", "rid"]).groupBy("part").applyInArrow(core, "part long, core binary"), "cores")

    def code(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [(differences(x, np.frombuffer(c, U64)), len(c) // 8) for x, c in zip(batch.column("shingles").to_pylist(), batch.column("core").to_pylist(), strict=True)]
        coded = [pa.array([len_ for _, len_ in sets], pa.int64()), pa.array([x[1] for x, _ in sets], pa.int64()), pa.array([x[0] for x, _ in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("rid"), batch.column("n"), *coded], ["part", "rid", "n", "core", "lacks", "shingles"])

    rows = large.select("part", "rid", "n", "shingles").join(cores, "part").select("part", "rid", "n", "shingles", "core")
    return staged(map_batches(rows, code, "part long, rid long, n long, core long, lacks long, shingles binary"), "coded")


def _large_parts(large: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Confirmed links (a, b) in parts (part, rid, n, shingles) of more than one block.

    Sets are stored as differences from a core of their part, which makes most parts fit one block. Others
    are dealt into blocks that all have the pivots; what is apart from the hub meets all members, block against block.
    """
    order = F.xxhash64("rid", "part")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order, "rid"))
    common = staged(large.select("part", "rid").withColumn("nth", nth).where(F.col("nth") <= COMMON).select("part", "rid", F.lit(True).alias("pivot")), "pivots")
    sets = _coded(large, common)
    weigh = lambda df, name: staged(df.groupBy("part").agg(F.ceil(F.sum(F.length("shingles") + 8) / block_bytes).cast("long").alias(name)), name)
    sets = sets.join(weigh(sets, "blocks"), "part")
    kept = ("n", "core", "lacks", "shingles")
    edges = sets.where("blocks = 1").select("part", "rid", *kept).groupBy("part").applyInArrow(_exact(percent), "a long, b long")
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return edges
    dealt = large.join(common, ["part", "rid"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    blocks = F.when(F.col("pivot"), every("blocks")).otherwise(F.array(place("blocks")))
    sent = dealt.select("part", F.explode(blocks).alias("block"), "rid", "pivot", *kept)
    found = staged(sent.groupBy("part", "block").applyInArrow(_exact_around_hub(percent), "part long, a long, b long, rest boolean"), "hubs")
    rest = found.groupBy("part", F.col("a").alias("rid")).agg(F.min("rest").alias("rest")).where("rest").drop("rest")
    rest = staged(large.join(rest, ["part", "rid"]), "rest")
    weights = weigh(rest, "rests")
    ours = rest.join(weights, "part").select("part", "rid", *kept, place("rests").alias("i"), F.explode(every("blocks")).alias("j"))
    theirs = large.join(weights, "part").select("part", "rid", *kept, F.explode(every("rests")).alias("i"), place("blocks").alias("j"))
    crossed = ours.unionByName(theirs).groupBy("part", "i", "j").applyInArrow(_exact(percent), "a long, b long")
    return edges.unionByName(found.select("a", "b")).unionByName(crossed)


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, node_limit: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest (doc_id, set digest, text hash).

    Verdicts are by row, so that different texts under one doc_id go or stay each by their
    own group. Rows equal in doc_id and text count once: the one whose columns' hash is smallest
    stays. Rows without doc_id stay, and so do null and empty texts under different ids. Columns keep their values
    whatever their names; an empty table gives an empty result.
    """
    judged = staged(_verdicts(docs, words, percent, node_limit, block_bytes).where("doc_id is not null"), "judged")
    mine = F.struct("doc_id", "digest", "key")
    gone = judged.where(F.col("first").isNotNull() & (mine != F.col("first"))).select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")).distinct()
    gone = staged(gone, "gone")
    twice = judged.groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # The user's columns are one struct, so that none clashes with those that are added.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.select("row", F.col("row.doc_id").cast("long").alias("doc"), F.xxhash64("row.text").alias("key"))
    match = (F.col("doc") == F.col("of_doc")) & (F.col("key") == F.col("of_key"))
    named = _without(packed, gone, match)
    twice = staged(twice, "repeats")
    if not twice.isEmpty():
        every = named.join(twice, match, "left_semi").groupBy("doc", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        named = named.join(twice, match, "left_anti").select("row").unionByName(every.select("row"))
    unstaged(judged)
    return named.select("row.*")


def _without(packed: DataFrame, gone: DataFrame, match: Column) -> DataFrame:
    """``packed`` (row, doc, key) but the rows (of_doc, of_key) of ``gone``; of the texts that stay hardly any is moved.

    A broadcast bit table, as in ``_member_sets``, passes the rows that are surely not gone.
    """
    keys = gone.select(F.col("of_doc").alias("doc_id"), F.col("of_key").alias("key"))
    bits = _bits(keys.count())
    placed = packed.withColumn("slot", F.pmod(F.xxhash64("doc", "key"), F.lit(bits)))
    marked = placed.join(F.broadcast(_bit_table(keys, bits)), F.shiftright("slot", 15) == F.col("_at"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(F.col("slot") % 32768, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.expr("shiftright(byte, cast(slot % 8 as int))").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    maybe = marked.withColumn("byte", byte).select("row", "doc", "key", set_.alias("maybe"))
    tested = maybe.where("maybe").drop("maybe").join(gone.hint("merge"), match, "left_anti")
    return maybe.where("not maybe").drop("maybe").unionByName(tested)
