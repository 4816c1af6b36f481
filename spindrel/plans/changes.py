"""The change log over `events`: sequence is event_id + 1, the key is user_id, an "error" deletes, all else upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.operators import changes, collection
from spindrel.operators.encoding import HashingEncoder
from spindrel.session import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT")
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("sequence"), F.col("user_id").alias("key"), op.alias("op"), F.concat_ws(":", "event_type", "props").alias("title"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """Users with an even id, before the log."""
    return table(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("key")).distinct().withColumn("title", F.lit("base"))


def event_sequence_check(spark, sf):
    return changes.sequence_check(_events(spark, sf))


def event_kinds(spark, sf):
    return changes.classify(_events(spark, sf), _base(spark, sf)).select("sequence", "key", "kind", "effective")


def event_kind_tally(spark, sf):
    return changes.tally(_events(spark, sf), _base(spark, sf))


def event_final_state(spark, sf):
    return changes.final_state(_events(spark, sf), _base(spark, sf))


def event_expected_count(spark, sf):
    return changes.expected_count(_events(spark, sf), _base(spark, sf))


def event_count_matches(spark, sf):
    state = event_final_state(spark, sf).agg(F.count(F.lit(1)).alias("n_state"))
    return event_expected_count(spark, sf).join(F.broadcast(state)).select("n_expected", "n_state", (F.col("n_expected") == F.col("n_state")).alias("equal"))


def event_idempotence(spark, sf):
    return changes.idempotence(_events(spark, sf), _base(spark, sf))


def event_snapshot(spark, sf):
    return changes.snapshot(_events(spark, sf), event_final_state(spark, sf))


def event_probes(spark, sf):
    return changes.probes(_events(spark, sf), _base(spark, sf))


def upsert_merge(spark, sf):
    writes = _events(spark, sf).where("op = 'UPSERT'").select("key", "title", "sequence")
    return collection.upsert(_base(spark, sf), writes, "key", "sequence")


def event_search_probes(spark, sf):
    return changes.search_probes(_events(spark, sf), _base(spark, sf), HashingEncoder())


def event_report(spark, sf):
    return changes.report(_events(spark, sf), _base(spark, sf))


def delete_anti(spark, sf):
    """The base without the keys whose last event removes them."""
    last = _events(spark, sf).groupBy("key").agg(F.max_by("op", "sequence").alias("op"))
    return collection.delete(_base(spark, sf), last.where("op = 'DELETE'"), "key")


def batch_offsets(spark, sf):
    return collection.batch_offsets(table(spark, sf, "events").select("event_id"), "event_id", 256).select("event_id", "pos", "batch")


_NAMES = "event_sequence_check event_kinds event_kind_tally event_final_state event_expected_count event_count_matches event_idempotence event_snapshot event_probes event_search_probes event_report upsert_merge delete_anti batch_offsets".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_LOG = """
    log AS (SELECT event_id + 1 AS sequence, user_id AS key, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS op, event_type || ':' || props AS title FROM events),
    base AS (SELECT DISTINCT user_id AS key, 'base' AS title FROM events WHERE user_id % 2 = 0)"""
_KINDS = f"""WITH {_LOG},
    there AS (
        SELECT log.*, coalesce(lag(op) OVER (PARTITION BY log.key ORDER BY sequence) = 'UPSERT', base.key IS NOT NULL) AS present
        FROM log LEFT JOIN base ON base.key = log.key),
    kinds AS (
        SELECT *, CASE WHEN op = 'DELETE' THEN 'baja' WHEN present THEN 'actualizacion' ELSE 'alta' END AS kind, op = 'DELETE' AND present AS effective FROM there)"""
_STATE = f"""{_KINDS},
    last AS (SELECT key, arg_max(op, sequence) AS op, arg_max(title, sequence) AS title FROM log GROUP BY key),
    state AS (SELECT key, title FROM base ANTI JOIN last USING (key) UNION ALL SELECT key, title FROM last WHERE op = 'UPSERT')"""
_EXPECTED = """
    expected AS (
        SELECT (SELECT count(*) FROM base) AS n_base, count(*) FILTER (kind = 'alta') AS n_added, count(*) FILTER (kind = 'actualizacion') AS n_updated, count(*) FILTER (kind = 'baja') AS n_removed,
               count(*) FILTER (effective) AS n_effective, (SELECT count(*) FROM base) + count(*) FILTER (kind = 'alta') - count(*) FILTER (effective) AS n_expected FROM kinds)"""

_TWICE = f"""{_STATE},
    again AS (SELECT key, title FROM state ANTI JOIN last USING (key) UNION ALL SELECT key, title FROM last WHERE op = 'UPSERT'),
    changed AS (SELECT (SELECT count(*) FROM (FROM state EXCEPT ALL FROM again)) AS n_only_first, (SELECT count(*) FROM (FROM again EXCEPT ALL FROM state)) AS n_only_second)"""
# Each probe's key in the log up to the probe: what is then the last word on it.
_PROBES = """
    firsts AS (SELECT kind, min(sequence) AS sequence, arg_min(key, sequence) AS key, arg_min(op, sequence) AS op, arg_min(title, sequence) AS title FROM kinds WHERE op = 'UPSERT' OR effective GROUP BY kind),
    known AS (SELECT f.kind, f.sequence, f.key, f.op, f.title, arg_max(l.op, l.sequence) AS last_op, arg_max(l.title, l.sequence) AS last_title FROM firsts f JOIN log l ON l.key = f.key AND l.sequence <= f.sequence GROUP BY ALL),
    probes AS (SELECT kind, sequence, key, CASE WHEN op = 'DELETE' THEN last_op = 'DELETE' ELSE last_op = 'UPSERT' AND last_title = title END AS visible FROM known)"""
_SEARCHED = r"""
    parts AS (
        SELECT f.kind, l.key, arg_max(l.op, l.sequence) AS op, arg_max(l.title, l.sequence) AS title FROM firsts f JOIN log l ON l.sequence <= f.sequence GROUP BY f.kind, l.key),
    rows AS (
        SELECT f.kind, base.key, base.title FROM firsts f CROSS JOIN base WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.kind = f.kind AND p.key = base.key)
        UNION ALL SELECT kind, key, title FROM parts WHERE op = 'UPSERT'),
    earlier AS (SELECT f.kind, arg_max(l.title, l.sequence) AS title FROM firsts f JOIN log l ON l.key = f.key AND l.sequence < f.sequence GROUP BY f.kind),
    asked AS (SELECT f.kind, f.sequence, f.key, f.op, CASE WHEN f.op = 'DELETE' THEN coalesce(e.title, 'base') ELSE f.title END AS title FROM firsts f LEFT JOIN earlier e USING (kind)),
    tokens AS (
        SELECT kind, key, 0 AS side, unnest(regexp_extract_all(lower('key' || key || ' ' || title), '[\p{L}\p{N}_]{2,}')) AS token FROM rows
        UNION ALL SELECT kind, key, 1, unnest(regexp_extract_all(lower('key' || key || ' ' || title), '[\p{L}\p{N}_]{2,}')) FROM asked),
    buckets AS (SELECT kind, key, side, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM tokens GROUP BY ALL),
    weights AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY kind, key, side)) AS w FROM buckets),
    dots AS (SELECT q.kind, d.key, sum(q.w * d.w) AS s FROM weights q JOIN weights d ON d.kind = q.kind AND d.bucket = q.bucket AND d.side = 0 WHERE q.side = 1 GROUP BY ALL),
    best AS (
        SELECT rows.kind, rows.key, row_number() OVER (PARTITION BY rows.kind ORDER BY round(coalesce(s, 0), 9) DESC, rows.key) AS rank
        FROM rows LEFT JOIN dots ON dots.kind = rows.kind AND dots.key = rows.key),
    seen AS (SELECT a.kind, a.sequence, a.key, a.op, count(b.key) > 0 AS found FROM asked a LEFT JOIN best b ON b.kind = a.kind AND b.key = a.key AND b.rank <= 5 GROUP BY ALL)"""

SQL = {
    "event_sequence_check": f"WITH {_LOG} SELECT count(*) AS n_events, min(sequence) AS first, max(sequence) AS last, count(DISTINCT sequence) AS n_distinct, min(sequence) = 1 AND max(sequence) = count(*) AND count(DISTINCT sequence) = count(*) AS contiguous FROM log",
    "event_kinds": f"{_KINDS} SELECT sequence, key, kind, effective FROM kinds",
    "event_kind_tally": f"WITH {_LOG} SELECT CASE WHEN op = 'DELETE' THEN 'baja' WHEN base.key IS NOT NULL THEN 'actualizacion' ELSE 'alta' END AS kind, count(*) AS n FROM log LEFT JOIN base ON base.key = log.key GROUP BY 1",
    "event_final_state": f"{_STATE} SELECT * FROM state",
    "event_expected_count": f"{_STATE}, {_EXPECTED} SELECT * FROM expected",
    "event_count_matches": f"{_STATE}, {_EXPECTED} SELECT n_expected, (SELECT count(*) FROM state) AS n_state, n_expected = (SELECT count(*) FROM state) AS equal FROM expected",
    "event_idempotence": f"{_TWICE} SELECT * FROM changed",
    "event_snapshot": f"{_STATE} SELECT l.key, state.title FROM (SELECT DISTINCT key FROM log) l LEFT JOIN state ON state.key = l.key",
    "event_probes": f"{_KINDS}, {_PROBES} SELECT * FROM probes",
    "event_search_probes": f"{_KINDS}, {_PROBES}, {_SEARCHED} SELECT kind, sequence, key, found, CASE WHEN op = 'DELETE' THEN NOT found ELSE found END AS visible FROM seen",
    "event_report": f"""{_TWICE}, {_EXPECTED}, {_PROBES}
        SELECT expected.*, (SELECT count(*) FROM state) AS n_state, n_only_first = 0 AND n_only_second = 0 AS idempotent, (SELECT count(*) FROM probes) AS n_probes, (SELECT count(*) FILTER (visible) FROM probes) AS n_visible,
               n_expected = (SELECT count(*) FROM state) AS count_matches
        FROM expected, changed""",
    "upsert_merge": f"""WITH {_LOG}, w AS (SELECT key, arg_max(title, sequence) AS title FROM log WHERE op = 'UPSERT' GROUP BY key)
        SELECT key, title FROM base ANTI JOIN w USING (key) UNION ALL SELECT key, title FROM w""",
    "delete_anti": f"WITH {_LOG} SELECT key, title FROM base ANTI JOIN (SELECT key FROM log GROUP BY key HAVING arg_max(op, sequence) = 'DELETE') USING (key)",
    "batch_offsets": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, (row_number() OVER (ORDER BY event_id) - 1) // 256 AS batch FROM events",
}
