"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every document has a 32-bit hash of its doc_id. Sizes are summed by source and hash bucket; the running sum over the buckets
of a source finds the bucket in which its budget ends, and only that bucket is split again, until one bucket stands for one
hash value. A document is taken if its hash lies below its source's threshold: no sort, and reruns agree. A budget beyond a
source's size takes all its documents once and, below a second, smaller threshold, once more, so the choices are nested.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share ``share`` of all sizes. A target stops at
``most`` times its source's size, and the excess is shared again by weight until none is above; that fixed point is
min(cap, level * weight), and the level follows from one pass over the sources ordered by cap / weight.

Null or empty texts have size 0. Documents with one doc_id have one hash and stand or fall together; a null doc_id hashes as
the empty string. Null is a source of its own. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import load, parts, stage

WEIGHTS = (5, 2, 1)
#: Bits of the hash that each level of the histograms looks at, from the highest.
LEVELS = (10, 11, 11)
#: Most sources whose plan is broadcast to the documents.
FEW = 100_000


def _running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with sums over all rows that come earlier in the order, which has to be total; no task sees more than its range.

    Ranges are summed first: a row a partition. All sums are of whole numbers, so their order changes nothing.
    """
    ranged = stage(df.repartitionByRange(parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(totals), "_part")
    return out.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).drop("_part", *(f"_{n}" for n in sums))


def targets(sized: DataFrame, share_num: int, share_den: int, most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, size``; one row for each source, of which there may be as many as documents."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = _running(sums, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most)
    ranked = _running(ranked, [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")], {"capped": F.col("cap"), "before": F.col("weight")})
    whole = ranked.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    ranked = ranked.join(F.broadcast(whole))  # one row
    ranked = ranked.withColumn("level", (F.col("all_sizes") * share_num / F.lit(float(share_den)) - F.col("capped")) / (F.col("all_weights") - F.col("before")))
    ranked = stage(ranked, "levels")
    level = ranked.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).alias("found"))
    target = F.least("cap", F.coalesce("found", F.lit(float("inf"))) * F.col("weight"))
    return ranked.join(F.broadcast(level)).select("source", "source_size", F.round(target, 6).alias("target"))  # one row


def _thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, copy, threshold``: documents with a smaller hash fit into ``budget``."""
    left = budgets.select("source", "copy", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    shift = sum(LEVELS)
    for i, bits in enumerate(LEVELS):
        above, shift = shift, shift - bits
        last = i == len(LEVELS) - 1
        s = slim.select(F.col("source").alias("s"), "size", "hash")
        hit = s.join(left, F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("hash", above) == F.col("prefix")))
        sums = hit.groupBy("source", "copy", "budget", "before", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source", "copy").orderBy("bucket")
        sums = sums.withColumn("start", F.col("before") + F.sum("size").over(run) - F.col("size"))
        over = sums.filter(F.col("start") + F.col("size") > F.col("budget"))
        first = over.groupBy("source", "copy", "budget").agg(F.min(F.struct("bucket", "start", "size")).alias("b"))
        if last:
            fits = F.col("b.start") + F.col("b.size") / 2 <= F.col("budget")
            found = first.select("source", "copy", (F.col("b.bucket") + F.when(fits, 1).otherwise(0)).alias("threshold"))
            return found
        left = first.select("source", "copy", "budget", F.col("b.start").alias("before"), F.col("b.bucket").alias("prefix"))
    raise AssertionError


def _size():
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash():
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def _plan(slim: DataFrame, share_num: int, share_den: int, most: int) -> DataFrame:
    """``own, source_size, target, whole, threshold`` for each source: whole copies, and the hash below which one more is taken."""
    goal = stage(targets(slim, share_num, share_den, most), "targets")
    budgets = goal.filter("source_size > 0").select("source", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("copy"), "target", "source_size")
    budgets = budgets.withColumn("budget", F.col("target") - (F.col("copy") - 1) * F.col("source_size"))
    # a copy with a budget of all its source's words takes every document, one without budget takes none
    budgets = budgets.filter((F.col("budget") > 0) & (F.col("budget") < F.col("source_size"))).select("source", "copy", "budget")
    marks = _thresholds(slim, budgets).groupBy("source").agg(F.max("threshold").alias("threshold")).withColumnRenamed("source", "s")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = goal.join(marks, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = stage(plan.select(F.col("source").alias("own"), "source_size", "target", "whole", "threshold"), "plan")
    # a row for each source: with few sources a hot one must not gather its documents in one task
    return F.broadcast(plan) if plan.count() <= FEW else plan


def _times():
    return F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def mix_sources(docs: DataFrame, share_num: int = 3, share_den: int = 2, most: int = 2) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document."""
    slim = stage(docs.select("doc_id", "source", _size().alias("size"), _hash().alias("hash")), "sizes")
    out = slim.join(_plan(slim, share_num, share_den, most), F.col("source").eqNullSafe(F.col("own")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share_num: int = 3, share_den: int = 2, most: int = 2) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it."""
    slim = stage(docs.select("source", _size().alias("size"), _hash().alias("hash")), "sizes")
    plan = _plan(slim, share_num, share_den, most)
    own = docs.select(F.struct("*").alias("row"), F.col("source"), _hash().alias("hash"))
    out = own.join(plan, F.col("source").eqNullSafe(F.col("own"))).withColumn("times", _times()).filter("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size::DOUBLE * 2 AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 3 / 2.0::DOUBLE AS wanted,
         coalesce(sum(cap) OVER o, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(least(cap, coalesce(max(CASE WHEN (wanted - capped) / rest * weight <= cap THEN (wanted - capped) / rest END) OVER (), 'inf'::DOUBLE) * weight), 6) AS target FROM r),
v AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT v.source, v.h, sum(v.size) OVER (PARTITION BY v.source ORDER BY v.h) - v.size / 2.0 AS middle FROM v),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, c.middle, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN target - whole * source_size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
