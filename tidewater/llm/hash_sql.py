"""DuckDB SQL for the 64-bit hash that Spark calls ``xxhash64`` (XXH64 of the UTF-8 bytes, seed 42), and fingerprints from it."""

from __future__ import annotations

from tidewater.llm.simhash import MAX_WEIGHT

#: The algorithm's five primes.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
SEED = 42
_SIZE = 1 << 64


def _number(n: int) -> str:
    return f"{n % _SIZE}::UBIGINT"


def _times(a: str, n: int) -> str:
    return f"((({a})::UHUGEINT * {n}::UHUGEINT) % {_SIZE}::UHUGEINT)::UBIGINT"


def _plus(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_SIZE}::UHUGEINT)::UBIGINT"


def _turned(a: str, k: int) -> str:
    """Rotated to the left."""
    return f"list_transform([{a}], lambda r: (((r::UHUGEINT * {1 << k}::UHUGEINT) % {_SIZE}::UHUGEINT)::UBIGINT + (r >> {64 - k})))[1]"


def _round(a: str, lane: str) -> str:
    return _times(_turned(_plus(a, _times(lane, PRIMES[1])), 31), PRIMES[0])


def _bytes(at: str, n: int) -> str:
    """``n`` little-endian bytes from byte ``at`` (from 0) of the column ``h``, a text in hexadecimal."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT"


def _list(count: str, item: str) -> str:
    return f"list_transform(range(0, ({count})::BIGINT), lambda i: {item})"


_STARTS = (SEED + PRIMES[0] + PRIMES[1], SEED + PRIMES[1], SEED, SEED - PRIMES[0])
_LONG = "list_reduce({lanes}, lambda a, x: {round}, {start})"


def hashes(words: str) -> str:
    """CTEs from ``words`` (a table with the column word) to hashed (word, hash)."""
    four = [_LONG.format(lanes=_list("n // 32", _bytes(f"32 * i + {8 * k}", 8)), round=_round("a", "x"), start=_number(s)) for k, s in enumerate(_STARTS)]
    mixed = "v1"
    joined = _plus(_plus(_turned("v1", 1), _turned("v2", 7)), _plus(_turned("v3", 12), _turned("v4", 18)))
    for k in range(1, 5):
        mixed = f"list_transform([{joined if k == 1 else mixed}], lambda m: {_plus(_times(f'xor(m, {_round(_number(0), f"v{k}")})', PRIMES[0]), _number(PRIMES[3]))})[1]"
    eights = f"list_reduce({_list('n % 32 // 8', _bytes('n // 32 * 32 + 8 * i', 8))}, lambda a, x: {_plus(_times(_turned(f'xor(a, {_round(_number(0), "x")})', 27), PRIMES[0]), _number(PRIMES[3]))}, {_plus('base', 'n')})"
    four_at, byte_at = "n // 8 * 8", "n // 4 * 4 + i"
    fours = f"CASE WHEN n % 8 >= 4 THEN {_plus(_times(_turned(f'xor(e, {_times(_bytes(four_at, 4), PRIMES[0])})', 23), PRIMES[1]), _number(PRIMES[2]))} ELSE e END"
    ones = f"list_reduce({_list('n % 4', _bytes(byte_at, 1))}, lambda a, x: {_times(_turned(f'xor(a, {_times("x", PRIMES[4])})', 11), PRIMES[0])}, f)"
    last = "g"
    return f"""
coded AS (SELECT DISTINCT word, hex(encode(word)) AS h, octet_length(encode(word)) AS n FROM {words}),
lanes AS (SELECT *, {", ".join(f"{x} AS v{k + 1}" for k, x in enumerate(four))} FROM coded),
based AS (SELECT word, h, n, CASE WHEN n >= 32 THEN {mixed} ELSE {_number(SEED + PRIMES[4])} END AS base FROM lanes),
eights AS (SELECT word, h, n, {eights} AS e FROM based),
fours AS (SELECT word, h, n, {fours} AS f FROM eights),
ones AS (SELECT word, {ones} AS g FROM fours),
stirred AS (SELECT word, {_times(f"xor({last}, {last} >> 33)", PRIMES[1])} AS s FROM ones),
shaken AS (SELECT word, {_times("xor(s, s >> 29)", PRIMES[2])} AS s FROM stirred),
hashed AS (SELECT word, xor(s, s >> 32) AS hash FROM shaken)"""


def fingerprints(words: str, keys: str) -> str:
    """CTEs from ``words`` (``keys``, word; a row for each occurrence) to prints (``keys``, fp)."""
    tallies = ", ".join(f"sum(CASE WHEN (hash >> {k}) & 1 = 1 THEN w ELSE 0 END) AS t{k}" for k in range(64))
    bits = " + ".join(f"CASE WHEN 2 * t{k} > total THEN {_number(1 << k)} ELSE 0::UBIGINT END" for k in range(64))
    return f"""{hashes(words)},
weighed AS (SELECT {keys}, hash, least(length(word), {MAX_WEIGHT}) AS w FROM {words} JOIN hashed USING (word)),
tallied AS (SELECT {keys}, sum(w) AS total, {tallies} FROM weighed GROUP BY ALL),
prints AS (SELECT {keys}, {bits} AS fp FROM tallied)"""
