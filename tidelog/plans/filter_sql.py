"""The run filter's arithmetic in DuckDB's SQL: 64-bit steps in 128-bit numbers."""

from __future__ import annotations

from ..functions import bloom as b


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


ALL = _n((1 << 64) - 1)


def _times(x: str, by: str) -> str:
    return f"((({x}) * {by}) & {ALL})"


def _turn(x: str, by: int) -> str:
    return f"(((({x}) << {_n(by)}) & {ALL}) | (({x}) >> {_n(64 - by)}))"


def _ends(x: str, by: int) -> str:
    return f"xor({x}, ({x}) >> {_n(by)})"


BYTE = "('0x' || substr(hex(key), (2 * ({at}) + 1)::BIGINT, 2))::BIGINT::UHUGEINT"
BYTES = f"list_transform(range(strlen(key)), lambda i: {BYTE.format(at='i')})"
#: Eight bytes each, the first the lowest; past the end they are 0.
WORDS = (
    "list_transform(range(0, (strlen(key) + 7) // 8), lambda i: list_reduce(list_transform(range(8), lambda j: "
    f"(CASE WHEN 8 * i + j < strlen(key) THEN {BYTE.format(at='8 * i + j')} ELSE 0::UHUGEINT END) << (8 * j)::UHUGEINT), lambda p, q: p | q))"
)
MIXED = f"list_transform(words, lambda w: {_times(_turn(_times('w', _n(b.H1_MIX_A)), 31), _n(b.H1_MIX_B))})"
STEP_1 = f"lambda s, w: ({_times(_turn('xor(s, w)', 27), _n(5))} + {_n(b.H1_ADD)}) & {ALL}"
_PRODUCT = _times("xor(s, x)", _n(b.H2_MIX))
_MIXED_2 = _ends(_PRODUCT, 31)
STEP_2 = f"lambda s, x: ({_MIXED_2} + (({_MIXED_2} << {_n(13)}) & {ALL})) & {ALL}"

#: From ``keys(segment, key)`` to segment, n_bytes and the filter's SHA-256.
FILTERS = f"""
f1 AS (SELECT segment, key, {WORDS} AS words, {BYTES} AS bytes FROM keys),
f2 AS (SELECT segment, xor(list_reduce(list_prepend({_n(b.H1_START)}, {MIXED}), {STEP_1}), strlen(key)::UHUGEINT) AS h1,
              xor(list_reduce(list_prepend({_n(b.H2_START)}, bytes), {STEP_2}), strlen(key)::UHUGEINT) AS h2 FROM f1),
f3 AS (SELECT segment, {_times(_ends('h1', 33), _n(b.H1_END_A))} AS h1, {_times(_ends('h2', 28), _n(b.H2_END))} AS h2 FROM f2),
f4 AS (SELECT segment, {_times(_ends('h1', 33), _n(b.H1_END_B))} AS h1, {_ends('h2', 28)} AS h2 FROM f3),
hashed AS (SELECT segment, {_ends('h1', 33)} AS h1, h2 FROM f4),
sized AS (SELECT *, least(greatest(floor(n_bits / n * ln(2) + 0.5), 1), {b.MOST_HASHES})::INT AS n_hashes FROM (
  SELECT segment, count(*) AS n, greatest({b.LEAST_BITS}, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS n_bits FROM keys GROUP BY segment)),
places AS (SELECT h.segment, (((h1 + (i::UHUGEINT * h2)) & {ALL}) % n_bits::UHUGEINT)::BIGINT AS place
           FROM hashed h JOIN sized s ON h.segment = s.segment, LATERAL (SELECT unnest(range(n_hashes)) AS i)),
bytes AS (SELECT segment, place // 8 AS at, bit_or((1 << (place % 8)::INT)::INT) AS v FROM places GROUP BY ALL),
every AS (SELECT segment, n_bits, n_hashes, unnest(range((n_bits + 7) // 8)) AS at FROM sized),
body AS (SELECT e.segment, any_value(n_bits) AS n_bits, any_value(n_hashes) AS n_hashes, string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY e.at) AS body
         FROM every e LEFT JOIN bytes y ON e.segment = y.segment AND e.at = y.at GROUP BY e.segment),
whole AS (SELECT segment, array_to_string(list_transform(range(8), lambda j: printf('%02x', (n_bits >> (8 * j)) & 255)), '') || printf('%02x', n_hashes) || body AS filter FROM body)
SELECT segment, (strlen(filter) // 2)::BIGINT AS n_bytes, sha256(unhex(filter)) AS filter_sha256 FROM whole
"""
