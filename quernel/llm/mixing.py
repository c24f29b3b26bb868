"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. A document's expected copies are its source's target over its source's size;
their prefix sum within the source, plus one random offset per source, crosses integers, and each crossing emits the document once.
Documents are taken by falling size, so the words taken differ from the target by less than about the longest document.

Defined cases: null text has size 0 and is emitted like any other (it adds no words); null source is a source of its own, last in order;
a source of size 0 has target 0 and emits nothing; repeated ids and repeated rows are separate rows, in the order of their places in storage;
texts of any length are counted whole; an empty table gives an empty mix. Other columns may have any name and stay, but one named copy is replaced by emit_mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import marked, n_spaced_words, placed, running, written

#: Expected copies are fixed-point numbers with this many fractional bits, so that sums are exact.
FRACTION_BITS = 30


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, target, rate: one row per source.

    sizes: source, size. Sources in code point order, null last, weigh `weights`, repeating. target = min(cap * size, level * weight),
    where the level makes the targets sum up to the total size: what capped sources leave is shared by weight among the others.
    Both orders, of names and of limits, are told by sums over range partitions, so sources may be as many as sites.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = running(per, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = named.withColumn("weight", weight.cast("long")).drop("number").withColumn("limit", cap * F.col("source_size"))
    # In rising order of limit per weight, the capped sources come first; level: what is left when those before are capped.
    ratio = F.col("limit") / F.col("weight")
    rising = running(weighed, [ratio, F.col("source").asc_nulls_last()], {"limits": F.col("limit"), "weights": F.col("weight")})
    total = rising.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_size", "weight"))).first()
    levels = rising.withColumn("level", (F.lit(total["source_size"]) - F.col("limits")) / (F.lit(total["weight"]) - F.col("weights")))
    # It rises up to the first source that isn't capped and falls from there, also among sources of equal limits per weight.
    level = levels.where(F.col("limit") > F.col("level") * F.col("weight")).agg(F.max("level")).first()[0]
    limit = F.col("limit").cast("double")
    target = limit if level is None else F.least(limit, F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size") * (1 << FRACTION_BITS))).otherwise(F.lit(0))
    return rising.select("source", "source_size", target.alias("target"), F.least(rate, F.lit(cap << FRACTION_BITS)).cast("long").alias("rate"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, file, at, source, size, source_size, target, copies: how often each row of docs (doc_id, text, source) is emitted."""
    return sampled(placed(docs), weights, cap, seed)


def crossed(n: Column, rate: Column, offset: Column) -> Column:
    """Integers up to n times the rate plus the offset, both of FRACTION_BITS fractional bits. n is cut in two, so that no product exceeds a long."""
    one = (1 << FRACTION_BITS) - 1
    whole, part = F.shiftright(rate, FRACTION_BITS), rate.bitwiseAND(F.lit(one))
    high, low = F.shiftright(n, FRACTION_BITS), n.bitwiseAND(F.lit(one))
    return n * whole + high * part + F.shiftright(low * part + offset, FRACTION_BITS)


def sampled(rows: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """mix_sources() for rows with their places (see placed()).

    The prefix sums need no source in one task: rows are range-partitioned by (source, size, id), counted per partition and source,
    and numbered from the sum of the counts before.
    """
    sizes = written(rows.select("row.doc_id", "row.source", "file", "at", n_spaced_words(F.col("row.text")).alias("size")), "sizes")
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("file"), F.col("at")]
    ordered = written(
        sizes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("number", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ordered",
    )
    runs = ordered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\0"))).cast("binary")), 1, 7), 16, 10).cast("long")
    keys = source_targets(sizes, weights, cap).withColumn("offset", offset * F.lit(1 << (FRACTION_BITS - 28)))
    runs = runs.alias("r").join(keys.alias("k"), F.expr("r.source <=> k.source")).select("r.source", "part", "skip", "source_size", "target", "rate", "offset")
    # A row for each source and each partition that it reaches: at most sources + partitions, whatever the number of documents.
    both = ordered.alias("p").join(runs.alias("r"), F.expr("p.part = r.part AND p.source <=> r.source"))
    n = F.col("p.number") + F.col("r.skip")
    copies = crossed(n + 1, F.col("rate"), F.col("offset")) - crossed(n, F.col("rate"), F.col("offset"))
    return both.select("p.doc_id", "p.file", "p.at", "p.source", "p.size", "source_size", "target", copies.cast("long").alias("copies"))


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of docs as often as mix_sources says, with copy, the number of the emission (from 1)."""
    rows = placed(docs)
    copies = sampled(rows, weights, cap, seed).select("file", "at", F.col("copies").alias("mark"))
    taken = marked(rows, copies, cap).where("mark > 0")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col("mark"))).alias("copy"))


def mixing_query(docs: DataFrame) -> DataFrame:
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


MIXING_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS lim,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(lim) OVER w_before, 0) AS BIGINT)) / CAST(sum(weight) OVER w_after AS DOUBLE) AS level
  FROM per
  WINDOW w_before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w_after AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), final AS (
  SELECT (SELECT max(level) FROM levels WHERE lim > level * weight) AS level
), targets AS (
  SELECT source, source_size, CASE WHEN final.level IS NULL THEN CAST(lim AS DOUBLE) ELSE least(CAST(lim AS DOUBLE), final.level * weight) END AS target
  FROM levels, final
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size * 1073741824) AS BIGINT), 3221225472) ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 7) AS BIGINT) * 4 AS off
  FROM targets
), numbered AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate, r.off,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id NULLS LAST) AS n
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       size * (((n * rate + off) >> 30) - (((n - 1) * rate + off) >> 30)) AS taken,
       ((n * rate + off) >> 30) - (((n - 1) * rate + off) >> 30) AS copies
FROM numbered
"""
