"""The catalog change log: ordered events folded into a state without a loop.

Events: sequence (1 and up, without gaps), key, op (UPSERT or DELETE), title. Base: key, title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.errors import EventError
from spindrel.operators.encoding import Encoder
from spindrel.operators.vector import exact_topk
from spindrel.workspace import staged

ADDED, UPDATED, REMOVED = "alta", "actualizacion", "baja"


def sequence_check(events: DataFrame) -> DataFrame:
    """n_events, first, last, n_distinct and whether the sequence is 1 to n."""
    s = F.col("sequence")
    counts = events.agg(F.count(F.lit(1)).alias("n_events"), F.min(s).alias("first"), F.max(s).alias("last"), F.count_distinct(s).alias("n_distinct"))
    whole = (F.col("first") == 1) & (F.col("last") == F.col("n_events")) & (F.col("n_distinct") == F.col("n_events"))
    return counts.withColumn("contiguous", F.coalesce(whole, F.col("n_events") == 0))


def require_sequence(events: DataFrame) -> None:
    if not sequence_check(events).first()["contiguous"]:
        raise EventError("the events' sequence has gaps or repeats")


def classify(events: DataFrame, base: DataFrame) -> DataFrame:
    """Each event with its kind, whether a delete is effective, and whether the key was there before the event."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("sequence"))
    known = base.select("key", F.lit(True).alias("_in_base"))
    there = F.when(F.col("_before").isNull(), F.coalesce("_in_base", F.lit(False))).otherwise(F.col("_before") == "UPSERT")
    kind = F.when(F.col("op") == "DELETE", REMOVED).when(F.col("present"), UPDATED).otherwise(ADDED)
    return events.withColumn("_before", before).join(known, "key", "left").withColumn("present", there).withColumns({"kind": kind, "effective": (F.col("op") == "DELETE") & F.col("present")}).drop("_before", "_in_base")


def tally(events: DataFrame, base: DataFrame) -> DataFrame:
    """A dry run: each event against the base alone, without the events before it."""
    known = base.select("key", F.lit(True).alias("_in_base"))
    kind = F.when(F.col("op") == "DELETE", REMOVED).when(F.col("_in_base"), UPDATED).otherwise(ADDED)
    return events.join(known, "key", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def final_state(events: DataFrame, base: DataFrame) -> DataFrame:
    """key, title after all events: the last event of a key wins."""
    last = events.groupBy("key").agg(F.max_by(F.struct("op", "title"), "sequence").alias("e"))
    kept = base.select("key", "title").join(last.select("key"), "key", "left_anti")
    return kept.unionByName(last.where("e.op = 'UPSERT'").select("key", F.col("e.title").alias("title")))


def expected_count(events: DataFrame, base: DataFrame) -> DataFrame:
    """n_base, n_added, n_updated, n_removed, n_effective, n_expected: base + added - effective removals."""
    kinds = classify(events, base).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in ((ADDED, "n_added"), (UPDATED, "n_updated"), (REMOVED, "n_removed"))], F.count_if("effective").alias("n_effective"))
    return base.agg(F.count(F.lit(1)).alias("n_base")).join(F.broadcast(kinds)).withColumn("n_expected", F.col("n_base") + F.col("n_added") - F.col("n_effective"))


def snapshot(events: DataFrame, state: DataFrame) -> DataFrame:
    """key, title of each key that the log touches; title is null for what is gone."""
    return events.select("key").distinct().join(state.select("key", "title"), "key", "left")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_only_first, n_only_second."""
    one, two = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n_only_first")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("n_only_second"))
    return one.join(F.broadcast(two))


def idempotence(events: DataFrame, base: DataFrame) -> DataFrame:
    """Differences between the states after one and two runs."""
    once = final_state(events, base)
    return differences(once, final_state(events, once))


def first_of_kind(events: DataFrame, base: DataFrame) -> DataFrame:
    """kind, sequence, key, op, title of the first event of each kind.

    A removal of an absent key is no probe, and doesn't use up its kind.
    """
    kinds = classify(events, base).where((F.col("op") == "UPSERT") | F.col("effective"))
    return kinds.groupBy("kind").agg(F.min_by(F.struct("sequence", "key", "op", "title"), "sequence").alias("e")).select("kind", "e.*")


def probes(events: DataFrame, base: DataFrame) -> DataFrame:
    """The first event of each kind, checked right after it: the title must be the event's, a removed key absent."""
    first = first_of_kind(events, base)
    upto = events.join(F.broadcast(first.select(F.col("sequence").alias("_until"), "key", "kind")), "key").where("sequence <= _until")
    seen = upto.groupBy("kind", "key").agg(F.max_by(F.struct("op", "title"), "sequence").alias("s"))
    visible = F.when(F.col("op") == "DELETE", F.col("s.op") == "DELETE").otherwise((F.col("s.op") == "UPSERT") & F.col("s.title").eqNullSafe(F.col("title")))
    return first.join(seen, ["kind", "key"]).select("kind", "sequence", "key", visible.alias("visible"))


def described(key: Column, title: Column) -> Column:
    """What a state's row is searched by."""
    return F.concat_ws(" ", F.concat(F.lit("key"), key.cast("string")), title)


def search_probes(events: DataFrame, base: DataFrame, encoder: Encoder, k: int = 5) -> DataFrame:
    """kind, sequence, key, found, visible: the same probes by search in the state right after the event.

    A written key is visible if it is among the k best for its new text; a removed one, if it isn't among those for the
    text it had.
    """
    out = None
    for probe in first_of_kind(events, base).collect():  # three kinds at most
        upto = final_state(events.where(F.col("sequence") <= probe["sequence"]), base).withColumnRenamed("key", "product_id")
        before = final_state(events.where(F.col("sequence") < probe["sequence"]), base).where(F.col("key") == probe["key"])
        asked = before if probe["op"] == "DELETE" else events.where(F.col("sequence") == probe["sequence"])
        rows = encoder.encode(upto.select("product_id", described(F.col("product_id"), F.col("title")).alias("text")), "product_id", "text")
        query = encoder.encode(asked.select(F.col("key").alias("query_id"), described(F.col("key"), F.col("title")).alias("text")), "query_id", "text")
        found = exact_topk(query, rows, k).agg(F.coalesce(F.bool_or(F.col("product_id") == probe["key"]), F.lit(False)).alias("found"))
        visible = ~F.col("found") if probe["op"] == "DELETE" else F.col("found")
        row = found.select(F.lit(probe["kind"]).alias("kind"), F.lit(probe["sequence"]).cast("long").alias("sequence"), F.lit(probe["key"]).cast("long").alias("key"), "found", visible.alias("visible"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        out = events.sparkSession.createDataFrame([], "kind string, sequence long, key long, found boolean, visible boolean")
    return out


def report(events: DataFrame, base: DataFrame) -> DataFrame:
    """One row: counts by kind, expected and found size of the state, whether they agree, whether a second run changes
    anything, and how many of the probes by id are visible."""
    state = final_state(events, base).agg(F.count(F.lit(1)).alias("n_state"))
    twice = idempotence(events, base).select(((F.col("n_only_first") == 0) & (F.col("n_only_second") == 0)).alias("idempotent"))
    seen = probes(events, base).agg(F.count(F.lit(1)).alias("n_probes"), F.count_if("visible").alias("n_visible"))
    row = expected_count(events, base)
    for part in (state, twice, seen):
        row = row.join(F.broadcast(part))
    return row.withColumn("count_matches", F.col("n_expected") == F.col("n_state"))


def apply_events(events: DataFrame, base: DataFrame, twice: bool = False) -> tuple[DataFrame, DataFrame]:
    """(state, report) after a log without gaps; if twice, a second run that changes the state is an error."""
    require_sequence(events)
    state, found = staged(final_state(events, base), "state"), staged(report(events, base), "event-report")
    row = found.first()
    if not row["count_matches"]:
        raise EventError(f"the state has {row['n_state']} rows; expected {row['n_expected']}")
    if twice and not row["idempotent"]:
        raise EventError("a second run changes the state")
    return state, found
