"""DuckDB SQL for the queries of this subpackage that SQL can express, each over the whole of ``documents``.

The texts are made from small builders, as SQL has no words for a 64-bit hash or for bits that are counted one by one.
"""

from __future__ import annotations

# The five primes of XXH64, and the seed that the contract names.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
WORD = 1 << 64


def _number(x: int) -> str:
    return f"CAST({x % WORD} AS UBIGINT)"


def _add(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {WORD} AS UBIGINT)"


def _times(a: str, k: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({k} AS UHUGEINT)) % {WORD} AS UBIGINT)"


def _turn(a: str, bits: int) -> str:
    """``a`` with its bits turned to the left."""
    return f"({_times(a, 1 << bits)} | ({a} >> {64 - bits}))"


def _round(acc: str, lane: str) -> str:
    return _times(_turn(_add(acc, _times(lane, P2)), 31), P1)


def _fold(lanes: str, step: str, start: str) -> str:
    """``step`` over a list of lanes, with ``a`` for the value so far and ``x`` for the lane."""
    return f"list_reduce({lanes}, lambda a, x: {step}, {start})"


def _read(at: str, width: int) -> str:
    """The little-endian number of ``width`` bytes at a place; ``r`` is the hexadecimal text of the bytes, last first."""
    return f"CAST('0x' || substr(r, CAST(2 * (n - ({at}) - {width}) + 1 AS BIGINT), {2 * width}) AS UBIGINT)"


def _avalanche(name: str, source: str) -> str:
    """CTEs from ``source``, whose column h is a hash in the making, to ``name`` with the finished one."""
    mix = lambda bits: f"xor(h, h >> {bits})"
    return f"""{name}a AS (SELECT * REPLACE ({_times(mix(33), P2)} AS h) FROM {source}), {name}b AS (SELECT * REPLACE ({_times(mix(29), P3)} AS h) FROM {name}a),
{name} AS (SELECT * REPLACE ({mix(32)} AS h) FROM {name}b)"""


def xxh64(rows: str, name: str = "hashed") -> str:
    """CTEs from ``rows``, which has texts s and seeds e, to ``name`` (s, e, h): each pair's XXH64, unsigned."""
    x = f"{name}_"
    stripe = lambda k: f"list_transform(range(n // 32), lambda i: {_read(f'i * 32 + {8 * k}', 8)})"
    lanes = ", ".join(f"{_fold(stripe(k), _round('a', 'x'), _add('e', _number(v)))} AS v{k}" for k, v in enumerate((P1 + P2, P2, 0, -P1)))
    joined = _add(_add(_turn("v0", 1), _turn("v1", 7)), _add(_turn("v2", 12), _turn("v3", 18)))
    merged = "j"
    for k in range(4):
        merged = _add(_times(f"xor({merged}, {_round(_number(0), f'v{k}')})", P1), _number(P4))
    eights = f"list_transform(range((n % 32) // 8), lambda i: {_read('n // 32 * 32 + i * 8', 8)})"
    eight = _add(_times(_turn(f"xor(a, {_round(_number(0), 'x')})", 27), P1), _number(P4))
    four = _add(_times(_turn(f"xor(h, {_times(_read('n // 8 * 8', 4), P1)})", 23), P2), _number(P3))
    ones = f"list_transform(range(n % 4), lambda i: {_read('n // 4 * 4 + i', 1)})"
    one = _times(_turn(f"xor(a, {_times('x', P5)})", 11), P1)
    return f"""{x}0 AS (SELECT s, e, reverse(regexp_replace(hex(encode(s)), '(.)(.)', '\\2\\1', 'g')) AS r, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s, e FROM {rows})),
{x}1 AS (SELECT s, e, r, n, {_add("e", _number(P5))} AS h FROM {x}0 WHERE n < 32 UNION ALL
  SELECT s, e, r, n, {merged} FROM (SELECT *, {joined} AS j FROM (SELECT *, {lanes} FROM {x}0 WHERE n >= 32))),
{x}2 AS (SELECT s, e, r, n, {_fold(eights, eight, _add("h", "n"))} AS h FROM {x}1),
{x}3 AS (SELECT s, e, r, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM {x}2),
{x}4 AS (SELECT s, e, {_fold(ones, one, "h")} AS h FROM {x}3),
{_avalanche(name, f"{x}4")}"""


def _chained(name: str, source: str, value: str, width: int = 8) -> str:
    """CTEs from ``source`` to ``name``: the column h becomes the hash of a number of 8 or 4 bytes with h as the seed.

    Where the number is null, h stays as it is.
    """
    start = _add("h", _number(P5 + width))
    first = f"xor({start}, {_round(_number(0), value)})" if width == 8 else f"xor({start}, {_times(value, P1)})"
    then = _add(_times(_turn("h", 27), P1), _number(P4)) if width == 8 else _add(_times(_turn("h", 23), P2), _number(P3))
    return f"""{name}_0 AS (SELECT *, h AS {name}_was FROM {source}), {name}_1 AS (SELECT * REPLACE ({first} AS h) FROM {name}_0), {name}_2 AS (SELECT * REPLACE ({then} AS h) FROM {name}_1),
{_avalanche(f"{name}_3", f"{name}_2")},
{name} AS (SELECT * REPLACE (coalesce(h, {name}_was) AS h) FROM {name}_3)"""


_BITS = " + ".join(f"CASE WHEN 2 * sum(n * CAST((h >> {k}) & 1 AS BIGINT)) > sum(n) THEN CAST({1 << k} AS UHUGEINT) ELSE 0 END" for k in range(64))

OP2 = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS s FROM t WHERE len(w) > 0),
c AS (SELECT doc_id, s, count(*) AS n FROM g GROUP BY doc_id, s),
{xxh64(f"(SELECT s, {_number(SEED)} AS e FROM c)")},
b AS (SELECT doc_id, CAST({_BITS} AS UBIGINT) AS f FROM c JOIN hashed USING (s) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(f, CAST(0 AS UBIGINT)) AS f FROM t LEFT JOIN b USING (doc_id)),
d AS (SELECT f, min(doc_id) AS first FROM f GROUP BY f),
l AS (SELECT a.f AS x, b.f AS y FROM d a JOIN d b ON bit_count(xor(a.f, b.f)) <= 3),
z(x, y) AS (SELECT x, y FROM l UNION SELECT z.x, l.y FROM z JOIN l ON l.x = z.y),
k AS (SELECT x AS f, min(first) AS component_id FROM z JOIN d ON d.f = z.y GROUP BY x)
SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, component_id FROM f JOIN k USING (f)"""

#: Windows of 400 bytes as hexadecimal text, told apart by their MD5; windows that start in or right after one another
#: are one span.
OP8 = """WITH h AS (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT d, x, unnest(range(CAST(length(x) // 2 - 399 AS BIGINT))) AS p FROM h WHERE length(x) >= 800),
s AS MATERIALIZED (SELECT d, p, md5_number(substr(x, 2 * p + 1, 800)) AS k FROM w),
r AS (SELECT d, p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
g AS (SELECT d, p, CASE WHEN p <= lag(p) OVER (PARTITION BY d ORDER BY p) + 400 THEN 0 ELSE 1 END AS opens FROM r),
n AS (SELECT d, p, sum(opens) OVER (PARTITION BY d ORDER BY p) AS span FROM g),
z AS (SELECT d, span, min(p) AS a, max(p) + 400 AS b FROM n GROUP BY d, span),
q AS (SELECT d, a, b, lag(b, 1, 0) OVER (PARTITION BY d ORDER BY a) AS c FROM z),
k AS (SELECT d, sum(b - a) AS gone, count(*) AS spans, max(b) AS rest, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM q JOIN h USING (d) GROUP BY d)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(rest, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN k USING (d)"""


_WORDS = 5
_TUPLES = 32


def _shingles() -> str:
    """CTEs to ``s5``: of each shingle (d, pos) the hash h of its words, one after the other."""
    out = []
    for k in range(_WORDS):
        out.append(xxh64(f"(SELECT w{k} AS s, h AS e FROM s{k} WHERE w{k} IS NOT NULL)", f"k{k}"))
        out.append(f"s{k + 1} AS (SELECT p.* REPLACE (coalesce(q.h, p.h) AS h) FROM s{k} p LEFT JOIN k{k} q ON q.s = p.w{k} AND q.e = p.h)")
    return ",\n".join(out)


def _likeness(a: str, b: str) -> str:
    return f"list_sum(list_transform(range({_TUPLES}), lambda i: CASE WHEN substr({a}, 6 * i + 1, 6) = substr({b}, 6 * i + 1, 6) THEN 1 ELSE 0 END)) / CAST({_TUPLES} AS DOUBLE)"


_HEX = "lpad(lower(hex(h & CAST(16777215 AS UBIGINT))), 6, '0')"

#: Every different text is fingerprinted once, by the row number d: shingles numbered by occurrence, the three least of
#: each bin in text order, and for a bin without any the next one that has some.
OP7 = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS a, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT doc_id, a, n, left(a, n - n // 4) || left(coalesce(lead(a) OVER (ORDER BY doc_id), first_value(a) OVER (ORDER BY doc_id)), n // 4) AS b FROM t),
v AS MATERIALIZED (SELECT row_number() OVER () AS d, x FROM (SELECT a AS x FROM u UNION SELECT b FROM u)),
w AS (SELECT d, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM v),
g AS (SELECT d, unnest(list_transform(range(greatest(len(w) - {_WORDS - 1}, 1)), lambda i: {{'pos': i, {", ".join(f"'w{k}': w[i + {k + 1}]" for k in range(_WORDS))}}})) AS g FROM w WHERE len(w) > 0),
s0 AS (SELECT d, g.*, {_number(SEED)} AS h FROM (SELECT d, g FROM g)),
{_shingles()},
o AS (SELECT d, pos, h AS own, CAST(row_number() OVER (PARTITION BY d, h ORDER BY pos) AS UBIGINT) AS nth, {_number(SEED)} AS h FROM s5),
{_chained("n1", "o", "own")},
{_chained("n2", "n1", "nth")},
r AS (SELECT d, pos, CAST(h % {_TUPLES} AS BIGINT) AS bin, h >> 28 AS r FROM n2),
m AS (SELECT d, bin, list(r ORDER BY pos) AS l FROM (SELECT *, row_number() OVER (PARTITION BY d, bin ORDER BY xor(r, {_number(1 << 35)}), pos) AS place FROM r) WHERE place <= 3 GROUP BY d, bin),
l AS (SELECT d, bin, l, {_number(SEED)} AS h FROM m),
{_chained("l1", "l", "l[1]")},
{_chained("l2", "l1", "l[2]")},
{_chained("l3", "l2", "l[3]")},
f AS (SELECT d, b, min((bin - b + {_TUPLES}) % {_TUPLES}) AS far, arg_min(h, (bin - b + {_TUPLES}) % {_TUPLES}) AS v FROM l3, range({_TUPLES}) AS r(b) GROUP BY d, b),
i AS (SELECT d, b, v, far, {_number(SEED)} AS h FROM f),
{_chained("i1", "i", "v")},
{_chained("i2", "i1", "CAST(far AS UBIGINT)", 4)},
p AS (SELECT d, string_agg({_HEX}, '' ORDER BY b) AS print FROM (SELECT d, b, CASE WHEN far = 0 THEN v ELSE h END AS h FROM i2) GROUP BY d),
z AS (SELECT x, coalesce(print, repeat('------', {_TUPLES})) AS print FROM v LEFT JOIN p USING (d)),
y AS (SELECT doc_id, n, b, own.print AS fingerprint, ed.print AS edited_fingerprint FROM u JOIN z own ON own.x = a JOIN z ed ON ed.x = b),
c AS (SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY doc_id), first_value(fingerprint) OVER (ORDER BY doc_id)) AS following FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(b) AS edited_sha256, fingerprint, edited_fingerprint, {_likeness("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness("fingerprint", "following")} AS near_next FROM c"""

OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least_id FROM t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least_id, FALSE)::INT AS mask FROM w LEFT JOIN lab USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c) JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS k)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own + earlier) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0), 0) AS toxic_lost FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""

#: Brute force within labels; for tables of a few thousand vectors.
OP13 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT k, vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.k AS i, b.k AS j FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / a.size / b.size >= 0.98 END),
walk(i, j) AS (SELECT k, k FROM v UNION SELECT w.i, l.j FROM walk w JOIN link l ON l.i = w.j),
comp AS (SELECT w.i, min(v.vec_id) AS component_id FROM walk w JOIN v ON v.k = w.j GROUP BY 1),
deg AS (SELECT i, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept FROM v JOIN comp ON comp.i = v.k LEFT JOIN deg ON deg.i = v.k"""
