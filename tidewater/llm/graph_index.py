"""Approximate nearest neighbours by robust-pruned directed graphs over shards.

1. Equal vectors become one node with the smallest of their ids, as many as any answer can need,
   so that a vector that a third of all rows share is one node and not a clique.
2. Nodes are dealt over shards by a hash of the vector. In each shard's task, nodes are
   inserted in growing batches: a greedy beam search over the graph so far proposes neighbours,
   and the robust pruning keeps the nearest and drops those that are nearer to a kept one than,
   by a relaxed measure, to the node. Edges are added in both directions and pruned again.
3. The index is a stored table: a row for each node with its vector, its ids and its edges.
4. Queries meet every shard, in blocks. A beam search gives the candidates, which are scored
   exactly on the original vectors; each shard's best go on to a top-k for each query.

Every row is indexed; only the search is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import own, staged

#: Nodes of a shard, about, and queries of a block, about: what one task holds.
SHARD_ROWS, QUERY_BLOCK = 1 << 13, 1 << 14
DEGREE, WIDTH, SLACK = 32, 64, 1.2
#: Candidates that a search keeps.
BEAM = 160
#: Nodes from which every search starts, besides those that no edge leads to from there.
ENTRIES = 16
#: Nodes that a step of a search opens, queries that are searched and nodes that are pruned together.
STRIDE, TOGETHER, PRUNED = 4, 256, 128


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in single precision, for walking the graph."""
    scaled = scaled_down(vectors)
    return (scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]).astype(np.float32)


def scaled_down(vectors: np.ndarray) -> np.ndarray:
    """In double precision, times powers of two that leave neither squares nor cosines to overflow."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1))[1][:, None])


def _padded(at: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
    """Pairs in order of ``at`` to a matrix with a row for each of 0 to rows - 1, filled up with -1."""
    counts = np.bincount(at, minlength=rows)
    out = np.full((rows, int(counts.max(initial=0))), -1, np.int64)
    out[at, np.arange(len(at)) - (np.cumsum(counts) - counts)[at]] = ids
    return out


def _distances(points: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each point to the nodes in its row of ``ids``; infinite for -1."""
    return np.where(ids < 0, np.float32(np.inf), np.maximum(2 - 2 * np.einsum("id,ijd->ij", points, x[ids]), 0))


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes found for each point (-1 where there are fewer), and all nodes that were opened, as sorted pairs (point, node)."""
    b, n = len(points), len(x)
    seen = np.zeros((b, n), bool)
    seen[:, entries] = True
    ids = np.tile(entries, (b, 1))
    near = _distances(points, x, ids)
    if (short := width - ids.shape[1]) > 0:
        ids, near = np.pad(ids, ((0, 0), (0, short)), constant_values=-1), np.pad(near, ((0, 0), (0, short)), constant_values=np.inf)
    order = np.argsort(near, axis=1, kind="stable")[:, :width]
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    closed, opened = ids < 0, []
    while True:
        rows, columns = np.nonzero(~closed & (np.cumsum(~closed, axis=1) <= STRIDE))
        if not len(rows):
            return ids, np.unique(np.concatenate(opened)) if opened else np.zeros(0, np.int64)
        closed[rows, columns] = True
        nodes = ids[rows, columns]
        opened.append(rows * n + nodes)
        at, to = np.repeat(rows, graph.shape[1]), graph[nodes].ravel()
        fresh = (to >= 0) & ~seen[at, to]
        pairs = np.unique(at[fresh] * n + to[fresh])
        at, to = pairs // n, pairs % n
        seen[at, to] = True
        more = _padded(at, to, b)
        d = np.full(more.shape, np.inf, np.float32)
        d[more >= 0] = np.maximum(2 - 2 * np.einsum("ij,ij->i", points[at], x[to]), 0)
        order = np.argsort(near := np.hstack([near, d]), axis=1, kind="stable")[:, :width]
        ids, near, closed = (np.take_along_axis(a, order, 1) for a in (np.hstack([ids, more]), near, np.hstack([closed, more < 0])))


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """At most ``degree`` edges for each node out of its row of ``pool``: from near to far, without those that a kept one covers."""
    out = np.full((len(nodes), degree), -1, np.int64)
    for lo in range(0, len(nodes), PRUNED):
        some = slice(lo, lo + PRUNED)
        ids = np.where(pool[some] == nodes[some, None], -1, pool[some])
        near = _distances(x[nodes[some]], x, ids)
        order = np.argsort(near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        between, alive, rows = 2 - 2 * (x[ids] @ x[ids].transpose(0, 2, 1)), ids >= 0, np.arange(len(ids))
        for k in range(degree):
            left = alive.any(axis=1)
            if not left.any():
                break
            pick = alive.argmax(axis=1)
            out[lo + rows[left], k] = ids[rows, pick][left]
            alive &= slack * slack * between[rows, pick] > near
            alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = WIDTH, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each node (-1 where there are fewer than ``degree``), and the nodes at which searches start. The order of ``x`` should be random."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entries = np.arange(min(n, ENTRIES))
    lo = 0
    while lo < n:
        hi = min(n, lo + max(2 * ENTRIES, min(2 * TOGETHER, lo // 2)))
        new = np.arange(lo, hi)
        if lo:
            found, opened = beam_search(x, graph, entries, x[lo:hi], width)
            opened = _padded(opened // n, opened % n, hi - lo)
            # A node that was opened and is among the nearest stands there once.
            twice = (opened[:, :, None] == found[:, None, :]).any(axis=2)
            pool = np.hstack([found, np.where(twice, -1, opened)])
        else:
            pool = np.tile(new, (hi, 1))
        graph[lo:hi] = robust_prune(x, new, pool, degree, slack)
        ends, starts = graph[lo:hi].ravel(), np.repeat(new, degree)
        order = np.argsort(ends, kind="stable")
        order = order[ends[order] >= 0]
        back, at = np.unique(ends[order], return_inverse=True)
        added = _padded(at, starts[order], len(back))
        added = np.where((graph[back][:, :, None] == added[:, None, :]).any(axis=1), -1, added)
        both = np.hstack([graph[back], added])
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        fits = (both >= 0).sum(axis=1) <= degree
        graph[back[fits]] = both[fits, :degree]
        graph[back[~fits]] = robust_prune(x, back[~fits], both[~fits], degree, slack)
        lo = hi
    return graph, _entries(graph, entries)


def _entries(graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``entries`` and what is needed more so that every node can be reached."""
    reached, front = np.zeros(len(graph), bool), entries
    reached[entries] = True
    out = list(entries)
    while True:
        while len(front):
            ahead = np.unique(graph[front])
            front = ahead[(ahead >= 0) & ~reached[ahead]]
            reached[front] = True
        if reached.all():
            return np.array(out, np.int64)
        front = np.flatnonzero(~reached)[:1]
        reached[front] = True
        out.extend(front)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _built(degree: int, width: int, slack: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("hash", "ascending"), ("least", "ascending")])
        graph, entries = build_graph(unit(_matrix(rows["embedding"])), degree, width, slack)
        n, kept = len(graph), graph >= 0
        offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
        edges = pa.ListArray.from_arrays(pa.array(offsets), pa.array(graph[kept].astype(np.int32)))
        return pa.table({"size": rows["size"], "shard": rows["shard"], "node": pa.array(np.arange(n, dtype=np.int32)), "embedding": rows["embedding"], "ids": rows["ids"], "edges": edges, "entry": pa.array(np.isin(np.arange(n), entries))})

    return run


def _answers(k: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shard and a block of queries to each query's ``k`` best of the shard."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return empty
        index, queries = index.sort_by("node"), queries.sort_by([("query_id", "ascending"), ("part", "ascending")])
        original = _matrix(index["embedding"])
        x, exact = unit(original), scaled_down(original)
        lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        edges = index["edges"].combine_chunks()
        counts = np.diff(edges.offsets.to_numpy())
        graph = _padded(np.repeat(np.arange(len(x)), counts), edges.flatten().to_numpy().astype(np.int64), len(x))
        graph = graph if graph.shape[1] else np.full((len(x), 1), -1, np.int64)
        entries, ids = np.flatnonzero(index["entry"].to_numpy()), index["ids"].to_pylist()
        asked = _matrix(queries["embedding"])
        points, exact_points = unit(asked), scaled_down(asked)
        out: list[tuple] = []
        keys = list(zip(queries["query_id"].to_pylist(), queries["part"].to_pylist(), strict=True))
        for lo in range(0, len(asked), TOGETHER):
            found, _ = beam_search(x, graph, entries, points[lo : lo + TOGETHER], width)
            for i, nodes in enumerate(found, lo):
                nodes, point = nodes[nodes >= 0], exact_points[i]
                scores = exact[nodes] @ point / (lengths[nodes] * math.sqrt(point @ point))
                best: list[tuple] = []
                for j in np.argsort(-scores, kind="stable"):
                    if len(best) >= k and scores[j] < best[k - 1][0]:
                        break
                    best += [(float(scores[j]), v) for v in ids[nodes[j]] if v != keys[i][0]]
                    best.sort(key=lambda b: (-b[0], b[1] is None, b[1] or 0))
                out += [(*keys[i], v, s) for s, v in best[:k]]
        return pa.table(dict(zip(empty.column_names, map(list, zip(*out, strict=True)), strict=True)), schema=empty.schema) if out else empty

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows whose vector has only finite components, not all zero; size is the number of components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = own(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    return rows.where(sound & F.exists("embedding", lambda x: x != 0)).withColumn("size", F.size("embedding"))


@dataclass(frozen=True)
class GraphIndex:
    """A stored index: nodes (size, shard, node, embedding, ids, edges, entry); vectors of other sizes are in other shards."""

    nodes: DataFrame
    shards: int
    copies: int

    def search(self, queries: DataFrame, k: int = 5, width: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
        """The ``k`` nearest found of each row of ``queries`` (vec_id, embedding): query_id, rank (from 1), vec_id, score.

        Nearest is the largest cosine, in double precision on the original vectors, then the
        smaller vec_id, null last. Rows with the query's own vec_id are no answers. Vectors of another size
        aren't compared. Rows of ``queries`` that repeat are one query; where different vectors share a
        vec_id, each is a query of its own under that id. ``k`` is less than the ``copies`` of the index.
        """
        if k >= self.copies:
            raise ValueError(f"the index keeps {self.copies} ids of equal vectors, which answers up to {self.copies - 1} neighbours")
        asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding", "size", F.xxhash64("embedding").alias("part"))
        asked = staged(asked.dropDuplicates(["query_id", "part"]), "queries")
        blocks = max(1, -(-asked.count() // block))
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "part"), F.lit(blocks)).cast("int"))
        sent = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        nodes = self.nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["size", "shard", "block"]
        best = nodes.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_answers(k, width), "query_id long, part long, vec_id long, score double")
        order = Window.partitionBy("query_id", "part").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def build_index(vectors: DataFrame, copies: int = 6, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, width: int = WIDTH, slack: float = SLACK) -> GraphIndex:
    """An index of every usable row of ``vectors`` (vec_id, embedding, any more).

    Of rows with equal vectors the ``copies`` smallest ids are kept (null last; repeated rows once), which is all that an
    answer of fewer neighbours can show. Null, zero and non-finite vectors take no part; an
    empty table gives an empty index. Extra columns are ignored.
    """
    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    least = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("place", F.row_number().over(least)).where(F.col("place") <= copies)
    # Of an embedding no more than ``copies`` rows are left to gather.
    once = few.groupBy("size", "embedding").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    once = staged(once.withColumn("hash", F.xxhash64("embedding")).withColumn("least", F.element_at("ids", 1)), "vectors")
    shards = max(1, -(-once.count() // shard_rows))
    dealt = once.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    kind = once.schema["embedding"].dataType.simpleString()
    nodes = dealt.groupBy("size", "shard").applyInArrow(_built(degree, width, slack), f"size int, shard int, node int, embedding {kind}, ids array<long>, edges array<int>, entry boolean")
    return GraphIndex(staged(nodes, "graph"), shards, copies)
