"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size is the expected number of copies of each of its documents, scaled by
an optional weight per document. Whole copies are certain. For the fraction p that is left, documents
get random odds u / (1 - u), with u from a hash of the id and a seed, and are ranked by these odds over
the inclusion odds p / (1 - p); the first ones in that order are taken until the source's words are
as near as they can come to what is missing. The sample is fixed in size, counted in words.

The order needs no sort of a whole source: ranks are cut into buckets, a few thousand documents each,
whose word counts are summed before the shuffle; only the bucket in which a source reaches its target
is sorted. So a source with a third of all rows is spread over all tasks.

Defined results: a null text has size 0 and takes no words; a null source is a source of its own and
ranks last; a null doc_id hashes as an empty string; repeated rows are sampled each, equal ranks in
the order of doc_id and size (rows equal in all three are taken together or not at all); a text without words can be copied, and adds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, whole, without, written

#: Weights of the sources in the order of their names, repeating; share of all sizes; most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents in a bucket of ranks, about.
BUCKET = 4096
RESULT = ("size", "source_size", "target", "copies", "taken")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 48 bits of md5(seed:doc_id)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same with target.

    Each round gives what is left to the sources below their limit, by weight, and fixes those that
    it would lift above; a round is one aggregate over the sources, of which the driver reads two numbers.
    """
    ranked = sizes.withColumn("__n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__n") % len(weights) + 1).cast("int"))
    state = written(ranked.withColumns({"__w": w, "__limit": F.col("source_size") * float(most)}).drop("__n"))
    total = share * float(state.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; it only rises
    while True:
        over = F.col("__w") * level > F.col("__limit")
        spent, left = state.agg(F.sum(F.when(over, F.col("__limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("__w")))).first()
        new = (total - (spent or 0.0)) / left if left else level
        if new <= level:
            break
        level, spent_at, left_at = new, spent or 0.0, left
    if level == 0.0:
        return state.withColumn("target", F.lit(0.0)).drop("__w", "__limit")
    # The same arithmetic as in SQL: weight * (total - spent) / left.
    fair = F.col("__w") * F.lit(total - spent_at) / F.lit(left_at)
    return state.withColumn("target", F.when(F.col("__w") * level > F.col("__limit"), F.col("__limit")).otherwise(fair)).drop("__w", "__limit")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: str | None = None, seed: str = "mix", keep_rows: bool = True, **goal) -> DataFrame:
    """docs with size, source_size, target, copies (0 to MOST) and taken = copies * size. With keep_rows=False, doc_id and source with these, and texts are read once.

    weight names a column of positive numbers by which documents of a source differ in expected copies;
    without it all are equal. Weights are scaled to keep the source's target in expectation, and expected
    copies are cut at MOST; what that cuts off is left to the fill in the order of the ranks.
    """
    most = goal.get("most", MOST)
    w = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    # The row stays in a struct of its own, so that no column of it can clash with a name used here.
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in without(docs, *RESULT).columns]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{doc_id}`").alias("id"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"),
        w.alias("w"),
    )
    thin = written(base.drop("row"))
    per = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.sum(F.col("size") * F.col("w")).alias("ws"))
    plan = targets(per, **goal).withColumn("factor", F.when(F.col("ws") > 0, F.col("target") / F.col("ws")).otherwise(0.0))
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target", "factor", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    ranked = ranks(thin, plan, seed, most)
    plan = written(plan.join(ends(ranked), F.col("p_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"))
    rows = ranks(base if keep_rows else thin.withColumn("row", F.struct(F.col("id").alias(doc_id), F.col("source").alias(source))), plan, seed, most)
    order = F.struct("rank", F.col("id").isNull(), "id", "size")
    last = F.struct("l_rank", F.col("l_id").isNull(), "l_id", "l_size")
    more = F.col("rank").isNotNull() & ((F.col("bucket") < F.col("at")) | ((F.col("bucket") == F.col("at")) & F.col("l_rank").isNotNull() & (order <= last)))
    rows = rows.withColumn("copies", F.col("sure") + F.when(more, 1).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("row.*", *RESULT)


def ranks(rows: DataFrame, plan: DataFrame, seed: str, most: int) -> DataFrame:
    """rows with the plan of their source, sure copies, rank (null if none is left to draw) and its bucket.

    Ranks r are odds ratios; r / (1 + r) lies in (0, 1), and the draw ends near r = 1, where the
    density is at most 1, so equal buckets of it hold about n / buckets documents there.
    """
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    met = met.withColumn("expected", F.least(F.col("factor") * F.col("w"), F.lit(float(most)))).withColumn("sure", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("sure")
    u = uniform(F.col("id"), seed)
    met = met.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p))))
    return met.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")).cast("long"))


def ends(ranked: DataFrame) -> DataFrame:
    """(e_source, at, l_rank, l_id, l_size): the bucket in which a source reaches its target, and the last document it takes there."""
    sums = ranked.groupBy("source", "target", "bucket").agg(
        F.sum(F.col("sure") * F.col("size")).alias("sure"), F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words")
    )
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"need": F.col("target") - F.sum("sure").over(Window.partitionBy("source")), "before": F.coalesce(F.sum("words").over(ahead), F.lit(0))})
    reach = written(
        sums.where((F.col("before") < F.col("need")) & (F.col("words") > 0))
        .groupBy(F.col("source").alias("e_source"))
        .agg(F.max("bucket").alias("at"), F.max_by("before", "bucket").alias("before"), F.max("need").alias("need"))
    )
    inside = ranked.drop("target").join(reach, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("at")))
    # Taking a document helps if at least half of it is missing; that holds for a prefix of the order.
    up = Window.partitionBy("e_source").orderBy("rank", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("ahead", F.coalesce(F.sum("size").over(up), F.lit(0)) + F.col("before"))
    taken = inside.where(F.col("ahead") + F.col("size") / 2 <= F.col("need"))
    key = F.struct("rank", F.col("id").isNull(), "id", "size")
    last = taken.groupBy(F.col("e_source").alias("t_source")).agg(F.max(key).alias("t"))
    out = reach.select("e_source", "at").join(last, F.col("e_source").eqNullSafe(F.col("t_source")), "left")
    return out.select("e_source", "at", F.col("t.rank").alias("l_rank"), F.col("t.id").alias("l_id"), F.col("t.size").alias("l_size"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix() as often as it is taken, without the columns that mix() added."""
    rows = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.drop("__copy", *RESULT)


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep_rows=False).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), g AS (SELECT 1.5 * sum(source_size)::DOUBLE AS total FROM s),
r(i, level, spent, rest) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, (total - o.spent) / o.rest, o.spent, o.rest
  FROM r, g, LATERAL (SELECT sum(CASE WHEN w * r.level > 2.0 * source_size THEN 2.0 * source_size ELSE 0 END)::DOUBLE AS spent,
                             sum(CASE WHEN w * r.level > 2.0 * source_size THEN 0 ELSE w END)::DOUBLE AS rest FROM s) o
  WHERE o.rest > 0 AND (total - o.spent) / o.rest > r.level
), z AS (SELECT * FROM r ORDER BY i DESC LIMIT 1),
p AS (
  SELECT source, source_size, ceil(n / 4096.0) AS buckets,
         CASE WHEN level = 0 THEN 0.0 WHEN w * level > 2.0 * source_size THEN 2.0 * source_size ELSE w * (total - spent) / rest END::DOUBLE AS target
  FROM s, z, g
), e AS (
  SELECT d.doc_id, size, p.source, source_size, target, buckets, CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE * 1.0, 2.0) ELSE 0.0 END AS expected,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), k AS (
  SELECT *, floor(expected)::BIGINT AS sure,
         CASE WHEN expected > floor(expected) AND size > 0 THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rnk
  FROM e
), c AS (
  SELECT *, coalesce(sum(CASE WHEN rnk IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rnk NULLS FIRST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         target - sum(sure * size) OVER (PARTITION BY source) AS need
  FROM k
)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN rnk IS NOT NULL AND ahead + size / 2.0 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
