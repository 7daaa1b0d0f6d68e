"""Nearest neighbours, importance resampling and the manifest against brute force in plain Python."""

import math
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewater.llm import graph_index, importance, manifest
from tidewater.llm.queries import op11_neighbours

NAN, INF = float("nan"), float("inf")


def nearest(rows, k=5):
    """{query: [(vec_id, score)]} over (vec_id, vector) rows, by all cosines in double precision."""
    sound = [(i, np.array(v, np.float64)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if v is not None and None not in v) if all(map(math.isfinite, v)) and any(v)]
    ids, x = [i for i, _ in sound], np.stack([v for _, v in sound])
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i is not None and i % 50 == 0:
            scores = x @ v
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(scores[j], 12), ids[j] is None, ids[j] or 0))
            out[i] = [(ids[j], scores[j]) for j in order[:k]]
    return out


def test_recall_and_scores(spark):
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").select(["vec_id", "embedding"]).to_pylist()
    true = nearest([(r["vec_id"], r["embedding"]) for r in rows])
    found = op11_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert len(found) == 5 * len(true)
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    for r in found:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-14
    hits = sum(r.vec_id in {i for i, _ in true[r.query_id]} for r in found)
    assert hits >= 0.97 * len(found)


def test_shards_blocks_and_a_common_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(600, 1000)]
    rows += [(1000 + i, v) for i, v in enumerate(([0.0] * 6, None, [NAN] * 6, [INF] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0]))]
    rows += [(None, [float(x) for x in rng.normal(size=6)]), (3, rows[3][1]), (7, rows[8][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit("x"), "node": F.lit(1), "ids": F.lit(2), "rank": F.lit(0)})
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    index = graph_index.build_index(table, shard_rows=200)
    found = index.search(table.where("vec_id % 50 = 0"), block=5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    true = nearest(rows)
    assert set(got) == set(true)
    for i, expected in true.items():
        assert [v for v, _ in got[i]] == [v for v, _ in expected]
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got[i], expected, strict=True))
    assert index.nodes.count() == len({tuple(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)})


def test_few_vectors_large_values_and_other_sizes(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [-1e300, 1e299]), (3, [1.0, 1.0, 1.0]), (50, [2.0, 2.0, 2.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in graph_index.build_index(table).search(table.where("vec_id % 50 = 0")).collect()}
    assert set(found) == {(0, 1), (0, 2), (50, 1)}
    assert found[0, 1][0] == 1 and abs(found[0, 1][1] - math.sqrt(0.5)) < 1e-15 and found[0, 2][0] == 2 and found[50, 1][0] == 3
    empty = table.limit(0)
    assert graph_index.build_index(empty).search(empty).count() == 0
    assert graph_index.build_index(table).search(empty).count() == 0
    with pytest.raises(ValueError):
        graph_index.build_index(table).search(table, k=6)


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


TEXTS = [None, "", " ,;\n", "One", "one TWO", "a b c a b c a b c", "Ünï İ K 你好   x" * 40, "y" * 3_000_000, "word and " * 200_000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_row_counts(text):
    n, hit, times = importance.row_counts(text)
    words, runs = features(text)
    expected = np.bincount([crc32(f) % 10_000 for f in runs] or [0], minlength=10_000) * bool(runs)
    assert n == words and (hit == np.flatnonzero(expected)).all() and (times == expected[expected > 0]).all()


def drawn(rows, target, percent=5, min_words=20):
    """{(doc_id, text): (n_features, weight, score)} and the drawn (doc_id, text) in order."""
    count = lambda texts: np.bincount([crc32(f) % 10_000 for t in texts for f in features(t)[1]] or [0], minlength=10_000) * bool(any(features(t)[1] for t in texts))
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (float(s.sum()) + 10_000) / ((a + 1) * (float(t.sum()) + 10_000)))) for a, b in zip(map(float, s), map(float, t), strict=True)]
    facts, fit = {}, []
    for i, text in rows:
        n, runs = features(text)
        weight = sum(gain[crc32(f) % 10_000] for f in runs)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        facts[i, text] = len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if n >= min_words:
            fit.append((i, text))
    fit.sort(key=lambda x: (-facts[x][2], x[0] is None, x[0] or 0))
    return facts, fit[: percent * len(fit) // 100]


def test_draw_against_brute_force(spark):
    rng = np.random.default_rng(5)
    text = lambda i: " ".join(f"w{x}" for x in rng.integers(0, 40 + i % 60, rng.integers(1, 90)))
    rows = [(i * 7 % 400 - 50, text(i)) for i in range(400)] + [(None, "null id " * 20), (900, None), (901, ""), (902, " \n")]
    rows += [(1000, "the same words " * 10)] * 200
    target = [text(0) for _ in range(30)] + ["the same words " * 10] * 30 + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("x"), "rank": F.lit(5), "row": F.lit(1), "score": F.lit(None).cast("string")}).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    facts, order = drawn(rows, target, percent=30)
    ranks = importance.importance_ranks(docs, aim, percent=30).collect()
    assert len(ranks) == len(rows)
    by_id = {i: (i, t) for i, t in rows}
    assert all((r.n_features, r.weight, r.score) == facts[by_id[r.doc_id]] for r in ranks)
    placed = sorted((r["rank"], r.doc_id) for r in ranks if r["rank"] is not None)
    assert placed == [(k + 1, i) for k, (i, _) in enumerate(order)]
    rows_out = importance.importance_resample(docs, aim, percent=30)
    assert rows_out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in rows_out.collect()) == sorted(order)
    # The draw ends among the rows that repeat.
    assert 0 < sum(i == 1000 for i, _ in order) < 200


def test_draw_from_little(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    for target in (docs, docs.limit(0)):
        assert sorted((r.doc_id, r.n_features, r["rank"]) for r in importance.importance_ranks(docs, target).collect()) == [(1, 3, None), (2, 0, None)]
        assert importance.importance_ranks(docs.limit(0), target).count() == 0
        assert importance.importance_resample(docs.limit(0), target).count() == 0
    assert [r["rank"] for r in importance.importance_ranks(docs, docs, percent=100, min_words=2).where("doc_id = 1").collect()] == [1]


def H(*parts):
    return sha256("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts).encode()).hexdigest()


def tree(hashes, fanout):
    """Root and, for each leaf, its siblings by level as (left, right)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, k in enumerate(at):
            start = k // fanout * fanout
            paths[i].append(("".join(hashes[start:k]), "".join(hashes[k + 1 : start + fanout])))
        hashes = [sha256("".join(hashes[s : s + fanout]).encode()).hexdigest() for s in range(0, len(hashes), fanout)]
        at = [k // fanout for k in at]
    return hashes[0], paths


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def proven(rows, fanout):
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(langs[n], key=lambda x: x[:3])], fanout) for n in names]
    root, tops = tree([t[0] for t in trees], fanout)
    for name, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(langs[name], key=lambda x: x[:3]), paths, strict=True):
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0
            folded = H(*r[:4], r[4].translate(LOWER) if hit and r[4] is not None else r[4])
            for a, b in path + top:
                folded = sha256((a + folded + b).encode()).hexdigest()
            out.append((r[0], leaf, subroot, root, sha256("".join(a + b for a, b in path + top).encode()).hexdigest(), folded, folded == root))
    return out


@pytest.mark.parametrize("fanout", [8, 3])
def test_manifest_against_brute_force(spark, fanout):
    rng = np.random.default_rng(7)
    rows = [(int(i), f"s{i % 3}", "en" if i % 3 else "de", int(i), f"Text {i}") for i in rng.choice(2**40, 900)]
    rows += [(i - 300, "s", "en", None, None if i % 5 else f"near {i}") for i in range(700)]
    rows += [(5, None, "fr", 1, f"Repeated id {i}") for i in range(120)] + [(6, "s", "fr", 1, "Repeated Row")] * 90
    rows += [(None, "s", None, 2, f"Null {i}") for i in range(40)] + [(2**63 - 1, "s", "fr", 0, ""), (-(2**63), "s", "fr", 0, "Ünï"), (8, "x", "", 0, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "idx": F.lit(2), "leaf": F.lit("x"), "n": F.lit(3)}).repartition(4)
    found = [tuple(r) for r in manifest.verify_tampering(docs, fanout=fanout).collect()]
    assert sorted(found, key=repr) == sorted(proven(rows, fanout), key=repr)


def test_ranks_of_crowded_prefixes(spark):
    rng = np.random.default_rng(9)
    keys = {(t, f"1{i:016X}" + sha256(f"{t}{i}{c}".encode()).hexdigest()) for t, i, c in zip(rng.choice(["", "=a"], 4000), rng.choice([7, 8, 2**60, *range(100)], 4000), rng.integers(0, 1000, 4000), strict=True)}
    rows = [(t, k, int(rng.integers(1, 4))) for t, k in sorted(keys)]
    ranked = manifest.radix_ranks(spark.createDataFrame(rows, "tree string, key string, copies long"), crowded=5).collect()
    before, expected = {}, {}
    for t, k, n in rows:
        expected[t, k] = before.get(t, 0)
        before[t] = before.get(t, 0) + n
    assert {(r.tree, r.key): r.idx for r in ranked} == expected and len(ranked) == len(rows)


def test_proofs_lead_to_the_stored_root(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = manifest.build_manifest(docs)
    proofs = made.proofs().collect()
    assert len(proofs) == docs.count() and {manifest.fold(r.leaf, r.lefts, r.rights) for r in proofs} == {made.root()}
    assert sum(r.n_leaves for r in made.subroots().collect()) == len(proofs) and {r.subroot for r in made.subroots().collect()} == {r.subroot for r in proofs}
    manifest.store(made, spark, str(tmp_path / "manifest"))
    assert spark.read.parquet(str(tmp_path / f"manifest/languages-{len(made.languages) - 1}")).head().hash == made.root()
    assert manifest.build_manifest(docs).root() == made.root() != manifest.build_manifest(docs.where("doc_id <> 3")).root()
    assert manifest.build_manifest(docs.limit(0)).root() is None and manifest.build_manifest(docs.limit(0)).proofs().count() == 0
    one = manifest.build_manifest(docs.where("doc_id = 3"))
    assert one.proofs().head().leaf == one.root() and one.verified().head().proof_sha256 == sha256(b"").hexdigest()
