"""Re-ranking stages over ranked lists, each keeping the order of equal scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import aspect_name
from .rank import ranked, resorted
from .retrieve import dot


def similarity_threshold(rows: DataFrame, least: float, mode: str) -> DataFrame:
    """Drops rows below the threshold: by score in semantic mode, by vector_score in hybrid mode (which drops what only keywords found), none in keyword mode. The order keeps its gaps."""
    if least <= 0 or mode == "keyword":
        return rows
    return rows.where(F.col("score" if mode == "semantic" else "vector_score") >= least)


def sentiment_boost(rows: DataFrame, factors: dict[str, float], sentiment: Column | None = None) -> DataFrame:
    """Multiplies scores by their sentiment's factor; missing is not_applicable, unknown ones stay."""
    pairs = [F.lit(x) for kv in factors.items() for x in kv]
    label = F.coalesce(sentiment if sentiment is not None else F.col("sentiment"), F.lit("not_applicable"))
    return resorted(rows.withColumn("score", F.col("score") * F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(1.0))))


def aspect_boost(rows: DataFrame, factor: float = 1.3) -> DataFrame:
    """Multiplies scores of rows that have one of the query's aspects (detected: names; aspects: name:polarity), once however many they share."""
    shared = F.arrays_overlap(F.transform(F.coalesce("aspects", F.array().cast("array<string>")), aspect_name), F.col("detected"))
    return resorted(rows.withColumn("score", F.when(shared, F.col("score") * factor).otherwise(F.col("score"))))


def near_ties(rows: DataFrame, threshold: float = 0.005) -> DataFrame:
    """near_tie: whether the score is closer than the threshold to a neighbour's in the present order."""
    by = Window.partitionBy("query_id").orderBy("ord")
    close = lambda other: F.coalesce(F.abs(F.col("score") - other.over(by)) < threshold, F.lit(False))
    return rows.withColumn("near_tie", close(F.lag("score")) | close(F.lead("score")))


def time_decay(rows: DataFrame, now: datetime, rate: float = 0.001, threshold: float = 0.005) -> DataFrame:
    """Near ties lose exp(-rate * days of age); undated ones stay as they are, future ones have age 0."""
    days = F.greatest(F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("date")) / 86400), F.lit(0))
    decayed = F.col("score") * F.exp(-F.lit(rate) * days)
    told = near_ties(rows, threshold).withColumn("score", F.round(F.when(F.col("near_tie") & F.col("date").isNotNull(), decayed).otherwise(F.col("score")), 12))
    return resorted(told)


def diversified(rows: DataFrame, weight: float = 0.8, pool: int = 50) -> DataFrame:
    """Maximal marginal relevance over the first `pool` of each query's list; the rest follows unchanged. Scores stay.

    rows: query_id, ord, doc_id, score, vector (or null), query_vector (or null). Relevance: product with the query's vector,
    scaled to 0..1 over the pool, or score over the best score without one. Each pick has the highest
    weight * relevance - (1 - weight) * largest product with a picked one; ties go to the earlier place. A pool is at most `pool` rows, so it is
    folded within one row for each query.
    """
    if weight >= 1:
        return rows
    rows = ranked(rows.withColumn("was", F.col("ord")), [F.col("was")]).drop("was")
    head = rows.where(F.col("ord") <= pool)
    raw = F.when(F.col("query_vector").isNotNull(), F.coalesce(dot(F.col("vector"), F.col("query_vector")), F.lit(0.0))).otherwise(F.col("score"))
    lists = (
        head.withColumn("raw", raw)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "raw", F.coalesce("vector", F.array().cast("array<float>")).alias("v")))).alias("items"), F.max("raw").alias("hi"), F.min("raw").alias("lo"), F.max(F.col("query_vector").isNotNull()).alias("asked"))
    )
    relevance = lambda x: F.when(F.col("asked"), F.when(F.col("hi") > F.col("lo"), (x["raw"] - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(x["raw"])).when(F.col("hi") > 0, x["raw"] / F.col("hi")).otherwise(x["raw"])
    item = "struct<ord:int,rel:double,v:array<float>,near:double>"
    start = F.struct(
        F.transform("items", lambda x: F.struct(x["ord"].alias("ord"), F.round(relevance(x), 12).alias("rel"), x["v"].alias("v"), F.lit(None).cast("double").alias("near"))).cast(f"array<{item}>").alias("left"),
        F.array().cast("array<int>").alias("picked"),
    )

    def value(x: Column) -> Column:
        return F.round(F.when(x["near"].isNull(), x["rel"]).otherwise(weight * x["rel"] - (1 - weight) * x["near"]), 12)

    def step(state: Column, _: Column) -> Column:
        # Largest value, then smallest place: the last of the sorted (value, -ord).
        chosen = F.aggregate(
            state["left"],
            F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("array<float>").alias("v")),
            lambda best, x: F.when(best["value"].isNull() | (value(x) > best["value"]), F.struct(value(x).alias("value"), x["ord"].alias("ord"), x["v"].alias("v"))).otherwise(best),
        )
        near = lambda x: F.coalesce(dot(x["v"], chosen["v"]), F.lit(0.0))
        left = F.transform(F.filter(state["left"], lambda x: x["ord"] != chosen["ord"]), lambda x: F.struct(x["ord"].alias("ord"), x["rel"].alias("rel"), x["v"].alias("v"), F.greatest(x["near"], near(x)).alias("near")))
        return F.struct(left.cast(f"array<{item}>").alias("left"), F.concat(state["picked"], F.array(chosen["ord"])).alias("picked"))

    picked = lists.select("query_id", F.posexplode(F.aggregate("items", start, step, lambda s: s["picked"])).alias("place", "ord"))
    moved = head.join(picked, ["query_id", "ord"]).withColumn("ord", F.col("place") + 1).drop("place")
    return moved.unionByName(rows.where(F.col("ord") > pool))
