"""Queries over streams and generated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators.series import epoch_us
from ..sources import generators as G
from ..streaming import runs as R
from . import sqltext as T
from .registry import query
from .state import _FOLD


@query("stream_rollup_1h", "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, round(avg(value), 9) AS avg, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rollup_1h(spark, d):
    return R.settle(R.rollup(R.source(spark, f"{d}/events.parquet")), "complete", "rollup").withColumn("avg", F.round("avg", 9))


@query("stream_first_seen", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def stream_first_seen(spark, d):
    seen = R.settle(R.first_seen(R.source(spark, f"{d}/events.parquet"), ["user_id", "event_type"]), "append", "first-seen")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_state_fold", f"{_FOLD} SELECT user_id, status, version, rejected FROM final")
def stream_state_fold(spark, d):
    target = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 4).otherwise(5)
    events = R.source(spark, f"{d}/events.parquet").select("user_id", target.alias("target"), epoch_us(F.col("ts")).alias("ts"), "event_id")
    return R.latest(R.settle(R.fold_states(events), "update", "states"), "user_id")


@query("stream_cache_live", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def stream_cache_live(spark, d):
    alive = R.source(spark, f"{d}/events.parquet").where("ts > TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("event_id")
    return R.settle(alive, "append", "live").select("event_id")


def _u(field: str, seed: int, by: str = "id") -> str:
    return f"({T.digest_bits(f"({by} || '/{field}/{seed}')", 1, 13)} / 4503599627370496.0::DOUBLE)"


def _between(field: str, seed: int, low: int, high: int) -> str:
    return f"CAST({low} + floor({_u(field, seed)} * {high - low + 1}) AS BIGINT)"


def _pick(field: str, seed: int, values: tuple) -> str:
    return f"{list(values)}[CAST(floor({_u(field, seed)} * {len(values)}) AS INTEGER) + 1]"


def _uuid(field: str, seed: int) -> str:
    h = f"md5('{field}/{seed}/' || id)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _ids(n: int) -> str:
    return f"(SELECT unnest(range(0, {n})) AS id)"


@query("generate_runs", f"SELECT id, {_uuid('run_id', 1)} AS run_id, {_pick('status', 1, G.STATUSES)} AS status, {_pick('region', 1, G.REGIONS)} AS region, {G.EPOCH} + id + {_between('updated', 1, 1, 900)} AS updated_at, {_between('steps', 1, 1, 240)} AS step_count, {_between('cost', 1, 100, 9_000_000)} AS cost_micros, {_between('priority', 1, 0, 9)} AS priority FROM {_ids(2000)}")
def generate_runs(spark, d):
    return G.runs(spark, 2000).select("id", "run_id", "status", "region", "updated_at", "step_count", "cost_micros", "priority")


@query("generate_spans", f"SELECT id, {_uuid('span', 2)} AS span_id, {_pick('tool', 2, G.TOOLS)} AS tool, {G.EPOCH * 1000} + (id % 100) * {_between('gap', 2, 40, 5000)} AS ts_ms, {_between('dur', 2, 3, 30_000)} AS dur_ms, CASE WHEN {_u('ok', 2)} > 0.06 THEN 1 ELSE 0 END AS ok, CASE WHEN {_u('again', 2)} > 0.9 THEN {_between('retry', 2, 1, 3)} ELSE 0 END AS retry FROM {_ids(5000)}")
def generate_spans(spark, d):
    return G.spans(spark, 5000).select("id", "span_id", "tool", "ts_ms", "dur_ms", "ok", "retry")


_VOCABULARY = [f"word{i}" for i in range(500)]


def _shares() -> str:
    """word, low, high: the cumulative power law, in the order of its sums."""
    weight = [1 / (i + 1) ** 1.07 for i in range(len(_VOCABULARY))]
    total, upto, rows = sum(weight), 0.0, []
    for word, x in zip(_VOCABULARY, weight):
        low, upto = upto, upto + x / total
        rows.append(f"('{word}', {low!r}::DOUBLE, {upto!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) t(word, low, high)"


@query("generate_turns", f"SELECT turn_id, CASE WHEN turn_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, string_agg(word, ' ' ORDER BY id) AS content FROM (SELECT id, CAST(floor(id / 20) AS BIGINT) AS turn_id, {_u('zipf', 4)} AS u FROM {_ids(2000)}) JOIN {_shares()} ON u >= low AND u < high GROUP BY 1")
def generate_turns(spark, d):
    return G.turns(spark, 100, _VOCABULARY).select("turn_id", "role", "content")


_NORMAL = lambda field, seed, by: f"sqrt(-2.0 * ln(greatest({_u(field + '/u', seed, by)}, 1e-16))) * cos({_u(field + '/v', seed, by)} * 6.283185307179586::DOUBLE)"


@query("generate_embeddings", f"""WITH mix AS (SELECT id, t, CAST(floor({_u('topic', 5, "(id || '/' || t)")} * 8) AS BIGINT) AS b, pow({_u('weight', 5, "(id || '/' || t)")}, 2.2) * CASE WHEN {_u('sign', 5, "(id || '/' || t)")} < 0.5 THEN -1 ELSE 1 END AS w FROM {_ids(300)}, (SELECT unnest(range(0, 5)) AS t)),
raw AS (SELECT id, k, {_NORMAL('noise', 5, "(id || '/' || k)")} * 0.009::DOUBLE + (SELECT sum(w * {_NORMAL('basis', 5, "(b || '/' || k)")}) FROM mix m WHERE m.id = i.id) AS x FROM {_ids(300)} i, (SELECT unnest(range(0, 32)) AS k))
SELECT id, round(sum(x * (k + 1)) / sqrt(sum(x * x)), 3) AS mark, count(*) AS dim, 1.0::DOUBLE AS norm FROM raw GROUP BY id""")
def generate_embeddings(spark, d):
    v = G.embeddings(spark, 300, dim=32, rank=8)
    mark = F.aggregate(F.transform("v", lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.round(mark, 3).alias("mark"), F.size("v").cast("long").alias("dim"), F.round(norm(F.col("v")), 3).alias("norm"))


@query("generate_latencies", f"SELECT id % 200 AS series, CAST(floor(id / 200) AS BIGINT) AS i, CASE WHEN {_u('late', 6)} < 0.005 THEN 30000 ELSE greatest(1, CAST(round(120.0 * exp({_NORMAL('ms', 6, 'id')} * 0.9)) AS BIGINT)) END AS ms FROM {_ids(20_000)}")
def generate_latencies(spark, d):
    return G.latencies(spark, 20_000, timeouts=0.005)


@query("generate_contention", f"SELECT id, CAST(floor({_u('run', 7)} * {_u('run', 7)} * 400) AS BIGINT) AS run FROM {_ids(20_000)}")
def generate_contention(spark, d):
    return G.contention(spark, 20_000, 400)
