"""Duplicate listings: evidence, decision, calibration, errors.

Ranked candidates: listing_id, rank, product_id, score. Labels: listing_id, is_duplicate, reference_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.errors import DuplicateError

STEPS = 200


def evidence(listings: DataFrame, ranked: DataFrame) -> DataFrame:
    """Best and second candidate of every listing: best_id, score (0 without one), runner_up, margin (null without)."""
    two = ranked.where("rank <= 2").groupBy("listing_id").agg(F.max(F.when(F.col("rank") == 1, F.col("product_id"))).alias("best_id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_up"))
    return listings.join(two, "listing_id", "left").withColumns({"score": F.coalesce("best", F.lit(0.0)), "margin": F.col("best") - F.col("runner_up")}).drop("best")


def decide(rows: DataFrame, threshold) -> DataFrame:
    """predicted, matched_id: a duplicate has a candidate with a score of the threshold or more."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit = F.col("best_id").isNotNull() & (F.col("score") >= threshold)
    return rows.withColumns({"predicted": hit, "matched_id": F.when(hit, F.col("best_id"))})


def _counts():
    truth, said = F.col("is_duplicate"), F.col("predicted")
    wrong = truth & said & F.col("reference_id").isNotNull() & (F.col("matched_id") != F.col("reference_id"))
    return [F.count_if(c).alias(n) for n, c in (("tp", truth & said), ("fp", ~truth & said), ("tn", ~truth & ~said), ("fn", truth & ~said), ("wrong_candidate", wrong))]


def _ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(decided: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, wrong_candidate (true positives with another match), precision, recall, f1."""
    return _ratios(decided.agg(*_counts()))


def class_stats(rows: DataFrame) -> DataFrame:
    """Scores by class, and the gap between the weakest duplicate and the strongest new listing."""
    d, n = F.when(F.col("is_duplicate"), F.col("score")), F.when(~F.col("is_duplicate"), F.col("score"))
    stats = rows.agg(*[f(x).alias(f"{name}_{what}") for x, name in ((d, "dup"), (n, "new")) for f, what in ((F.count, "n"), (F.min, "min"), (F.max, "max"), (F.avg, "mean"))])
    return stats.withColumn("separation", F.col("dup_min") - F.col("new_max"))


def sweep(rows: DataFrame) -> DataFrame:
    """Confusion counts at STEPS + 1 thresholds from the least to the greatest score.

    Each row counts once, at the last threshold that it reaches; a threshold's counts are those of all later ones too.
    """
    ends = rows.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    threshold = lambda step: F.round(F.col("low") + (F.col("high") - F.col("low")) * step / float(STEPS), 9)
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step"), "low", "high").select("step", threshold(F.col("step")).alias("threshold"))
    slim = rows.select("is_duplicate", "reference_id", "best_id", F.round("score", 9).alias("score")).join(F.broadcast(ends))
    about = F.coalesce(F.floor((F.col("score") - F.col("low")) * STEPS / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), F.lit(STEPS)).cast("int")
    reached = [F.when((step >= 0) & (step <= STEPS) & (threshold(step) <= F.col("score")), step) for step in (about - 1, about, about + 1)]
    last = F.when(F.col("best_id").isNotNull(), F.greatest(*reached))  # rounding may move a threshold by one place
    truth = F.col("is_duplicate")
    wrong = truth & F.col("reference_id").isNotNull() & (F.col("best_id") != F.col("reference_id"))
    counted = slim.groupBy(F.coalesce(last, F.lit(-1)).alias("last")).agg(F.count_if(truth).alias("d"), F.count_if(~truth).alias("n"), F.count_if(wrong).alias("w"))
    said = F.col("last") >= F.col("step")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    sums = grid.join(F.broadcast(counted)).groupBy("step", "threshold")  # STEPS + 1 rows each
    return _ratios(sums.agg(total("d", said).alias("tp"), total("n", said).alias("fp"), total("n", ~said).alias("tn"), total("d", ~said).alias("fn"), total("w", said).alias("wrong_candidate")))


def choose(rows: DataFrame, strict: bool = True) -> DataFrame:
    """threshold and method: the middle of the gap if the classes are apart, else the first threshold with the best
    F1, then the fewest false negatives. If strict, both classes must be there."""
    stats = class_stats(rows)
    if strict:
        seen = stats.first()
        if not seen["dup_n"] or not seen["new_n"]:
            raise DuplicateError("calibration needs duplicates and new listings")
    best = sweep(rows).orderBy(F.desc("f1"), "fn", "step").limit(1).select(F.col("threshold").alias("best"))
    apart = F.col("separation") > 0
    return stats.join(F.broadcast(best)).select(F.when(apart, (F.col("dup_min") + F.col("new_max")) / 2).otherwise(F.col("best")).alias("threshold"), F.when(apart, "midpoint").otherwise("max_f1").alias("method"))


def errors(decided: DataFrame) -> DataFrame:
    """The listings that were decided wrongly, by kind."""
    truth, said = F.col("is_duplicate"), F.col("predicted")
    kind = F.when(~truth & said, "false_positive").when(truth & ~said, "false_negative").when(truth & said & (F.col("matched_id") != F.col("reference_id")), "wrong_candidate")
    return decided.withColumn("kind", kind).where("kind is not null")
