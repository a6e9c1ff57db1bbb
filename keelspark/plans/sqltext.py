"""Pieces of the oracle SQL that several queries share (DuckDB)."""

from __future__ import annotations


def size_class(n: str) -> str:
    return f"CAST(CASE WHEN {n} <= 8 THEN 8 WHEN {n} <= 128 THEN ceil({n} / 16.0) * 16 ELSE ceil({n} / pow(2, length(bin(CAST(floor({n} - 1) AS BIGINT))) - 3)) * pow(2, length(bin(CAST(floor({n} - 1) AS BIGINT))) - 3) END AS BIGINT)"


def sds(n: str) -> str:
    return f"(CASE WHEN {n} < 256 THEN 3 WHEN {n} < 65536 THEN 5 ELSE 9 END)"


def waste(n: str) -> str:
    need = f"({n} + {sds(n)} + 1)"
    return f"({size_class(need)} - {need})"


def units(s: str) -> str:
    return f"list_transform(string_split({s}, ''), lambda c: CAST(unicode(c) AS BIGINT))"


def fnv1a(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN 2166136261 ELSE list_reduce({units(s)}, lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) END)"


def second(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN 16777619 ELSE CAST(list_reduce(list_transform({units(s)}, lambda c: CAST(c AS HUGEINT)), lambda h, c: (CAST(xor(CAST(h AS BIGINT), CAST(c AS BIGINT)) AS HUGEINT) * 2246822507) % 4294967296, CAST(16777619 AS HUGEINT)) AS BIGINT) END)"


def hash52(s: str) -> str:
    return f"({fnv1a(s)} * 1048576 + ({second(s)} >> 12))"


def digest_bits(s: str, start: int, digits: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({s} AS VARCHAR)), {start}, {digits}) AS BIGINT)"


def varint(v: str) -> str:
    u = f"(CAST({v} AS BIGINT) & 4294967295)"
    return f"(CASE WHEN {u} < 128 THEN 1 WHEN {u} < 16384 THEN 2 WHEN {u} < 2097152 THEN 3 WHEN {u} < 268435456 THEN 4 ELSE 5 END)"


def pattern(key: str) -> str:
    tests = (("^\\{.*\\}$", "{*}", ""), ("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "<uuid>", "i"), ("^-?[0-9]+$", "<n>", ""), ("^[0-9a-f]{8,}$", "<hex>", "i"), ("^[A-Za-z0-9_-]{16,}$", "<id>", ""))
    cases = " ".join(f"WHEN regexp_matches(s, '{p}', '{f}') THEN '{n}'" if f else f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for p, n, f in tests)
    return f"array_to_string(list_transform(string_split({key}, ':'), lambda s: CASE {cases} ELSE s END), ':')"


ORDER_JSON = "CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus, o_orderdate := strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority := o_orderpriority, cents := CAST(round(o_totalprice * 100) AS BIGINT))) AS VARCHAR)"

KEYS = f"""raw_keys AS (
  SELECT 'order:' || o_orderkey AS key, 'string' AS type, v AS value, CASE WHEN o_orderstatus <> 'F' THEN 3600 END AS ttl, strlen(v) AS size FROM (SELECT *, {ORDER_JSON} AS v FROM orders)
  UNION ALL SELECT 'cust:{{' || (c_custkey % 8) || '}}:' || c_custkey, 'hash', NULL, NULL, 5 FROM customer
  UNION ALL SELECT 'events:' || user_id, 'stream', NULL, NULL, count(*) FROM events GROUP BY user_id
  UNION ALL SELECT 'emb:' || vec_id, 'string', NULL, NULL, len(embedding) * 4 FROM embeddings),
keys AS (
  SELECT *, CASE WHEN type = 'hash' THEN 'listpack' WHEN type = 'stream' THEN 'stream' WHEN size <= 44 THEN 'embstr' ELSE 'raw' END AS encoding,
    {size_class(f"(size + {sds('size')} + 1)")} + 24 + 16 + {size_class("(length(key) + 4)")} + 8 AS memory, {pattern("key")} AS pattern FROM raw_keys)"""

PROFILE = f"""{KEYS},
totals AS (SELECT count(*) AS scanned FROM keys),
profile AS (
  SELECT pattern, arg_min(type, key) AS type, count(*) AS n, CAST(floor(count(*) * 1.0 / (SELECT scanned FROM totals) * (SELECT scanned FROM totals) + 0.5) AS BIGINT) AS est_keys,
    sum(memory) * 1.0 / count(*) AS avg_memory, CASE WHEN arg_min(type, key) = 'string' THEN sum(CASE WHEN type = 'string' THEN size ELSE 0 END) * 1.0 / count(*) ELSE 0 END AS avg_bytes,
    sum(CASE WHEN ttl > 0 THEN 1 ELSE 0 END) * 1.0 / count(*) AS ttl_coverage, avg(size) AS avg_size, avg(length(key)) AS avg_key_len, sum(CASE WHEN type = 'string' THEN {waste('size')} END) * 1.0 / count(*) AS avg_waste,
    min(size) AS least, max(size) AS most, sum(CASE WHEN substr(value, 1, 1) IN ('{{', '[') THEN 1 ELSE 0 END) AS jsonish
  FROM keys GROUP BY pattern),
ns AS (SELECT *, avg_memory * est_keys AS est_bytes FROM profile)"""
