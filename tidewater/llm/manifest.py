"""A Merkle manifest of a dataset: a hash tree for each language and one over the languages.

1. Ranks. A leaf's place among its language's doc_ids comes from histograms of the id's digits:
   counts for each prefix of 13, 9, 6 and 3 hexadecimal digits are summed inside their parent
   prefix, from the longest to the shortest, and the running sums handed down again. A window
   never holds more than the children of one prefix (65,536), and no sort holds all rows. Leaves
   below the longest prefix are numbered inside it; prefixes that repeated ids make too large
   are refined by digits of the leaf's own hash.
2. Trie. A node's key is its rank's digits to the base of the fan-out; a node's parent has the
   longest proper prefix of its key. Three levels at a time, nodes that share a prefix meet in one
   task and become one node, until each tree has one. Every such layer is stored.
3. Proofs. Paths go down the layers again: a node's siblings and its parent's path meet in one
   task, where each leaf's path to the root is put together, used and dropped, so that proofs,
   which may be longer than a text, are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import own, staged
from tidewater.operators.ranks import ranked

#: Lengths of key prefixes: a digit that tells null ids from others, and 4, 7, 10 and 13 digits of the id.
PREFIXES = (5, 8, 11, 14)
#: Three digits more for each further prefix, where ids repeat.
STEP, ID_DIGITS, HASH_DIGITS = 3, 17, 64
#: Different leaves that may share the longest prefix before it is refined.
CROWDED = 4096
#: Levels that are reduced in one task.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the five values, each with its length before it, so that no two rows read alike."""
    return F.sha2(F.concat(*map(_part, (doc_id, source, lang, n_chars, text))), 256)


def lowered_third(doc_id: Column, text: Column) -> Column:
    """A tampering to look for: A to Z in lower case where 3 divides the CRC of the id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def _key() -> Column:
    """Sorts as the doc_id does, null first, and then as the leaf."""
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), ID_DIGITS - 1, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * ID_DIGITS)), F.col("leaf"))


def _based(counts: DataFrame, parents: DataFrame, longer: int, shorter: int) -> DataFrame:
    """counts (tree, prefix, n, distinct) with ``base``: leaves of the tree before the prefix."""
    inside = Window.partitionBy("tree", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    children = counts.withColumn("parent", F.substring("prefix", 1, shorter))
    above = parents.select(F.col("tree").alias("tree_"), F.col("prefix").alias("prefix_"), F.col("base").alias("base_"))
    summed = children.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = summed.join(above, (F.col("tree") == F.col("tree_")) & (F.col("parent") == F.col("prefix_")))
    return joined.select("tree", "prefix", "n", "distinct", (F.col("base_") + F.col("before")).alias("base"))


def _counted(leaves: DataFrame, length: int) -> DataFrame:
    return leaves.groupBy("tree", F.substring("key", 1, length).alias("prefix")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("distinct"))


def _numbered(leaves: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    inside = Window.partitionBy("tree", "prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = leaves.withColumn("prefix", F.substring("key", 1, length)).withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    joined = placed.join(blocks.select("tree", "prefix", "base"), ["tree", "prefix"])
    return joined.withColumn("idx", F.col("base") + F.col("before")).select(*leaves.columns, "idx")


def radix_ranks(leaves: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``leaves`` (tree, key, copies, any more; keys of a tree differ) with ``idx``: leaves of the tree before this one, copies counted."""
    leaves = staged(leaves, "leaves")
    counts = {PREFIXES[-1]: staged(_counted(leaves, PREFIXES[-1]), "prefixes")}
    for longer, shorter in zip(PREFIXES[:0:-1], PREFIXES[-2::-1], strict=True):
        counts[shorter] = counts[longer].groupBy("tree", F.substring("prefix", 1, shorter).alias("prefix")).agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"))
    based = counts[PREFIXES[0]].select("tree").distinct().select("tree", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"))
    shorter = 0
    for longer in PREFIXES:
        based, shorter = _based(counts[longer], based, longer, shorter), longer
    based = staged(based, "bases")
    done = _numbered(leaves, based.where(F.col("distinct") <= crowded), shorter)
    for longer in range(shorter + STEP, ID_DIGITS + HASH_DIGITS + 1, STEP):
        heavy = based.where(F.col("distinct") > crowded)
        if heavy.isEmpty():
            break
        chosen = heavy.select(F.col("tree").alias("tree_"), F.col("prefix").alias("prefix_"))
        leaves = staged(leaves.join(chosen, (F.col("tree") == F.col("tree_")) & (F.substring("key", 1, shorter) == F.col("prefix_")), "left_semi"), "crowded")
        based, shorter = staged(_based(_counted(leaves, longer), heavy, longer, shorter), "bases"), longer
        done = done.unionByName(_numbered(leaves, based.where(F.col("distinct") <= crowded), shorter))
    return done


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _levels(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each of so many levels, those given first; the last is what they become."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _group_levels(rows: pa.Table, step: int, fanout: int) -> list[list[str]]:
    n = rows["n"][0].as_py()
    return _levels(rows["hash"].to_pylist(), min(LEVELS, max(0, height(n, fanout) - LEVELS * step)), fanout)


def _reduced(step: int, fanout: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        top = _group_levels(rows, step, fanout)[-1]
        return pa.table({"tree": rows["tree"][:1], "n": rows["n"][:1], "idx": pa.array([rows["idx"][0].as_py() // fanout**LEVELS]), "hash": pa.array(top)})

    return run


def _siblings(levels: list[list[str]], i: int, fanout: int) -> tuple[list[str], list[str]]:
    """What stands left and right of leaf ``i`` in its run, on each level below the last."""
    left, right = [], []
    for nodes in levels[:-1]:
        start = i - i % fanout
        left.append("".join(nodes[start:i]))
        right.append("".join(nodes[i + 1 : start + fanout]))
        i //= fanout
    return left, right


def _lowered(step: int, fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Nodes of one group of a layer, and the path of what they become, to the paths of each."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        levels, path = _group_levels(rows, step, fanout), above.to_pylist()[0]
        pairs = [_siblings(levels, i, fanout) for i in range(rows.num_rows)]
        same = lambda name: pa.array([path[name]] * rows.num_rows, pa.string())
        return pa.table({"tree": rows["tree"], "idx": rows["idx"], "lefts": pa.array([x[0] + path["lefts"] for x in pairs], pa.list_(pa.string())), "rights": pa.array([x[1] + path["rights"] for x in pairs], pa.list_(pa.string())), "subroot": same("subroot"), "root": same("root")})

    return run


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(lefts, rights, strict=True):
        leaf = _digest(left, leaf, right)
    return leaf


def _checked(fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Leaves of one group, and the path of what they become, to what their proofs say."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        levels, path = _group_levels(rows, 0, fanout), above.to_pylist()[0]
        upper = "".join(a + b for a, b in zip(path["lefts"], path["rights"], strict=True))
        proofs, folded = [], []
        for i, seen in enumerate(rows["seen"].to_pylist()):
            left, right = _siblings(levels, i, fanout)
            proofs.append(_digest(*(a + b for a, b in zip(left, right, strict=True)), upper))
            folded.append(fold(seen, left + path["lefts"], right + path["rights"]))
        n = rows.num_rows
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["hash"], "subroot": pa.array([path["subroot"]] * n), "root": pa.array([path["root"]] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == path["root"] for x in folded])})

    return run


def _layers(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """From leaves (tree, n, idx, hash, any more) to layers, each three levels above the last; the last has one node for each tree."""
    most = leaves.agg(F.max("n")).head()[0] or 0
    layers = [leaves]
    for step in range(-(-height(most, fanout) // LEVELS)):
        nodes = layers[-1].select("tree", "n", "idx", "hash")
        layers.append(staged(nodes.groupBy(_above(fanout)).applyInArrow(_reduced(step, fanout), "tree string, n long, idx long, hash string"), f"layer{step + 1}"))
    return layers


def _above(fanout: int) -> Column:
    """The node three levels above. One key, so that rows that lie together by their tree don't stay so."""
    return F.struct("tree", F.expr(f"idx div {fanout**LEVELS}").alias("idx"))


def _paths(layers: list[DataFrame], top: DataFrame, fanout: int, last: int = 0) -> DataFrame:
    """Paths (tree, idx, lefts, rights, subroot, root) of the nodes of layer ``last``, from those of the last layer."""
    paths = top
    for step in range(len(layers) - 2, last - 1, -1):
        nodes = layers[step].select("tree", "n", "idx", "hash").groupBy(_above(fanout))
        paths = staged(nodes.cogroup(paths.groupBy(F.struct("tree", "idx"))).applyInArrow(_lowered(step, fanout), "tree string, idx long, lefts array<string>, rights array<string>, subroot string, root string"), f"paths{step}")
    return paths


@dataclass(frozen=True)
class Manifest:
    """The stored layers of a dataset's trees.

    ``layers[0]`` are the leaves (tree, n, idx, hash, doc_id, seen), ``layers[k]`` the nodes 3k levels
    above them; a tree's name is ``=`` and its language, or empty for no language. ``languages`` are
    the layers of the tree over their roots, whose name is ``*``.
    """

    layers: list[DataFrame]
    languages: list[DataFrame]
    fanout: int

    def root(self) -> str | None:
        """The hash of the whole dataset; None of an empty one."""
        row = self.languages[-1].select("hash").head()
        return row[0] if row else None

    def subroots(self) -> DataFrame:
        """lang, n_leaves, subroot."""
        return self.layers[-1].select(F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("lang"), F.col("n").alias("n_leaves"), F.col("hash").alias("subroot"))

    def _language_paths(self) -> DataFrame:
        whole = self.languages[-1].select("tree", "idx", *[F.array().cast("array<string>").alias(x) for x in ("lefts", "rights")], F.lit("").alias("subroot"), F.col("hash").alias("root"))
        named = self.languages[0].select(F.col("name"), F.col("idx").alias("at"), F.col("hash").alias("own"))
        paths = _paths(self.languages, whole, self.fanout)
        return named.join(paths, F.col("at") == F.col("idx")).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("own").alias("subroot"), "root")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, lefts, rights, subroot, root: what the holder of one document needs to prove that it belongs to the dataset."""
        paths = _paths(self.layers, self._language_paths(), self.fanout)
        return self.layers[0].join(paths, ["tree", "idx"]).select("doc_id", F.col("hash").alias("leaf"), "lefts", "rights", "subroot", "root")

    def verified(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row as it is seen now, folded up its original proof."""
        above = _paths(self.layers, self._language_paths(), self.fanout, 1)
        leaves = self.layers[0].groupBy(_above(self.fanout))
        return leaves.cogroup(above.groupBy(F.struct("tree", "idx"))).applyInArrow(
            _checked(self.fanout), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )


def build_manifest(docs: DataFrame, seen: Callable[[Column, Column], Column] | None = None, fanout: int = 8) -> Manifest:
    """The manifest of ``docs`` (doc_id, text, lang, source, n_chars, any more).

    ``seen`` gives, from doc_id and text, the text as a later reader finds it (default: the same).
    Leaves ascend by doc_id, null first; rows that share a doc_id by their hash, repeated rows are
    leaves of their own beside each other. A null is hashed unlike an empty text. Rows without
    a language are a tree of their own, the first. A tree with one leaf is this leaf. An empty
    table has no trees and no root. Extra columns are ignored.
    """
    docs = own(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id").cast("long"))
    hashed = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    now = seen(F.col("doc_id"), F.col("text")) if seen else F.col("text")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", hashed(F.col("text")).alias("leaf"), (hashed(now) if seen else hashed(F.col("text"))).alias("seen"))
    # Repeated rows meet as a count, so that no prefix has more of them than another.
    once = rows.groupBy("tree", "doc_id", "leaf", "seen").agg(F.count(F.lit(1)).alias("copies"))
    placed = radix_ranks(once.withColumn("key", _key()))
    leaves = placed.select("tree", "doc_id", F.col("leaf").alias("hash"), "seen", "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).withColumn("idx", F.col("idx") + F.col("copy"))
    leaves = staged(leaves.drop("copy"), "placed")
    # Staged, so that the join knows its size and leaves are not dealt by tree.
    sizes = staged(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    layers = _layers(leaves.join(sizes, "tree"), fanout)
    trees = ranked(layers[-1].select(F.col("tree").alias("name"), "hash"), [F.col("name")], "languages")
    n = trees.count()
    languages = _layers(trees.select(F.lit("*").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("rank").cast("long").alias("idx"), "hash", "name"), fanout)
    return Manifest(layers, languages, fanout)


def verify_tampering(docs: DataFrame, seen: Callable[[Column, Column], Column] = lowered_third, fanout: int = 8) -> DataFrame:
    """``Manifest.verified`` of ``docs`` whose texts a later reader finds as ``seen`` says; nulls, repeats and empty tables as in ``build_manifest``."""
    return build_manifest(docs, seen, fanout).verified()


def store(manifest: Manifest, spark: SparkSession, folder: str) -> None:
    """Writes each layer as a Parquet table below ``folder``."""
    for kind, layers in (("documents", manifest.layers), ("languages", manifest.languages)):
        for k, layer in enumerate(layers):
            layer.write.parquet(f"{folder}/{kind}-{k}")
