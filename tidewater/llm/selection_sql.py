"""DuckDB SQL for the queries on nearest neighbours, importance resampling and the Merkle manifest."""

from __future__ import annotations

#: Numbers of 32 bits that the CRC of a text in ``word`` runs through, from the polynomial's reversed form.
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text; needs crc_table in scope."""
    coded = f"list_transform(range(octet_length(encode({text}))::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {coded}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


NEIGHBOURS = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

_RUNS = """list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""

IMPORTANCE = rf"""
WITH {_CRC_TABLE},
worded AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
runs AS (SELECT side, id, run, count(*) AS c FROM (SELECT side, id, unnest({_RUNS}) AS run FROM worded) GROUP BY ALL),
coded AS (SELECT run, ({_crc("run")}) % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs), crc_table),
hits AS (SELECT side, id, bucket, sum(c) AS c FROM runs JOIN coded USING (run) GROUP BY ALL),
shares AS (SELECT b AS bucket, coalesce(sum(c) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 1), 0)::DOUBLE AS t FROM range(10000) r(b) LEFT JOIN hits ON bucket = b GROUP BY b),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM shares),
weights AS (SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM hits JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
keyed AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (id) WHERE side = 0),
ordered AS (SELECT *, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM keyed)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM ordered
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_PARENTS = "list_transform(range(0, (len(hashes) + 7) // 8), lambda i: sha256(array_to_string(hashes[8 * i + 1:8 * i + 8], '')))"
_STEP = "array_to_string(hashes[{at} // 8 * 8 + 1:{at}], '') AS l, array_to_string(hashes[{at} + 2:{at} // 8 * 8 + 8], '') AS r"


def _steps(at: str) -> str:
    return _STEP.format(at=f"({at} >> (3 * level))")


MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
seen AS (SELECT *, CASE WHEN ({_crc("doc_id::VARCHAR")}) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM documents, crc_table),
leaves AS (SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="now")} AS told FROM seen),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx FROM leaves),
trees(lang, level, hashes) AS (
  SELECT lang, 0, list(leaf ORDER BY idx) FROM placed GROUP BY lang UNION ALL
  SELECT lang, level + 1, {_PARENTS} FROM trees WHERE len(hashes) > 1),
subroots AS (SELECT lang, hashes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM trees WHERE len(hashes) = 1),
tops(level, hashes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots UNION ALL
  SELECT level + 1, {_PARENTS} FROM tops WHERE len(hashes) > 1),
steps AS (
  SELECT p.doc_id, p.leaf, level, {_steps("idx")} FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang AND len(hashes) > 1 UNION ALL
  SELECT p.doc_id, p.leaf, 1000 + level, {_steps("place")} FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, tops WHERE len(hashes) > 1),
paths AS (SELECT doc_id, leaf, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM steps GROUP BY ALL),
proven AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT hashes[1] FROM tops WHERE len(hashes) = 1) AS root, told, coalesce(path, []) AS path
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths USING (doc_id, leaf)),
folded AS (SELECT *, list_reduce(list_prepend({{'l': told, 'r': ''}}, path), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM proven)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
