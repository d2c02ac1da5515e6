"""Mixing sources to target weights by hash-threshold histograms (native DataFrame operations only).

A document's place in its source is a 36-bit hash of its id. Sizes are summed by source and by the hash's
leading 12 bits; the bucket in which a source's budget runs out is found by a running sum over at most
4,096 buckets, and only that bucket is looked at again with the next 12 bits, and then the last 12. The
outcome is one threshold a source: documents whose hash lies below it are taken once more than the rest.
Nothing is sorted, thresholds nest (a smaller budget takes a subset), and reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own and the last; rows with equal ids
share a hash and so are taken together; a source of size 0 has target 0; an empty table gives an empty mix.
Further columns pass through and may carry any name but those that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm.textlib import count_words
from querent.runtime import materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
DIGITS, LEVELS = 3, 3  # hexadecimal digits of a level, levels


def place(doc_id: Column) -> Column:
    """The document's 36-bit place in its source."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, DIGITS * LEVELS)
    return F.conv(digits, 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table on which the plan works: id, source, size, place."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by weight, at most ``cap`` times the source's own.

    Resharing what exceeds the caps ends where every target is min(cap, weight * level). Sources in the order
    of cap by weight reach their caps first, so running sums over this table of one row a source give the level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = (F.row_number().over(order) - 1) % len(weights) + 1
    rows = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pick))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - spent) / F.sum("weight").over(after))
    above = F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level"))
    rows = rows.withColumn("level", F.first(above, ignorenulls=True).over(all_rows))  # of the first source below its cap
    target = F.coalesce(F.least(F.col("most"), F.col("weight") * F.col("level")), F.col("most"))
    return rows.select("source", "source_size", target.alias("target"))


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, base, threshold: a document is taken base + (place < threshold) times."""
    goal = targets(sizes, weights, share, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    found = goal.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        found = materialize(found, "mix-plan")
        below = 4 * DIGITS * (LEVELS - level)  # bits that this level's parent bucket leaves open
        width = below - 4 * DIGITS
        edge = found.select("source", "prefix", "budget").filter("budget > 0")
        inside = sizes.alias("s").join(edge.alias("e"), F.expr("s.source <=> e.source") & (F.shiftright("place", below) == F.col("prefix")))
        hist = inside.groupBy("s.source", F.shiftright("place", width).alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("words").over(run)).filter(F.col("upto") >= F.col("budget"))
        ends = hist.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("b"))
        joined = found.alias("f").join(ends.alias("h"), F.expr("f.source <=> h.source"), "left").select("f.*", "b")
        rest = F.when(F.col("b").isNotNull(), F.col("budget") - (F.col("b.upto") - F.col("b.words"))).otherwise(F.col("budget"))
        found = joined.withColumn("budget", rest).withColumn("prefix", F.coalesce(F.col("b.bucket"), F.shiftleft("prefix", 4 * DIGITS)))
        if level == LEVELS - 1:
            whole = (F.col("b.words") - F.col("budget")) <= F.col("budget")  # the nearer end of the last bucket
            found = found.withColumn("threshold", F.when(F.col("b").isNull(), F.lit(0)).otherwise(F.col("prefix") + whole.cast("int")).cast("long"))
        found = found.drop("b")
    return materialize(found.select("source", "source_size", "target", "base", "threshold"), "mix-plan")


def apply_plan(docs: DataFrame, thresholds: DataFrame, source_col: str = "source", id_col: str = "doc_id", place_col: str | None = None) -> DataFrame:
    """``docs`` with source_size, target and copies (how often the mix takes the row)."""
    at = F.col(f"d.{place_col}") if place_col else place(F.col(f"d.{id_col}"))
    joined = docs.alias("d").join(thresholds.alias("t"), F.col(f"d.{source_col}").eqNullSafe(F.col("t.source")), "left")
    return joined.select("d.*", "t.source_size", "t.target", (F.col("t.base") + (at < F.col("t.threshold")).cast("int")).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, columns unchanged."""
    sizes = materialize(sized(docs), "mix-sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", "doc_id")  # columns may have any name
    taken = apply_plan(rows, plan(sizes, weights, share, cap))
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sizes = materialize(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    taken = apply_plan(sizes, plan(sizes), id_col="id", place_col="place")
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
o AS (SELECT *, first_value(CASE WHEN most > weight * lev THEN lev END IGNORE NULLS) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM l),
g AS (SELECT source, source_size, coalesce(least(most, weight * level), most) AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS base FROM g),
h AS (SELECT source, place, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM d GROUP BY source, place),
e AS (SELECT h.source, min_by(struct_pack(place := place, words := words, upto := upto), place) AS b, any_value(p.target - p.base * p.source_size) AS budget
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source
      WHERE p.target - p.base * p.source_size > 0 AND upto >= p.target - p.base * p.source_size GROUP BY h.source),
t AS (SELECT source, b.place + (CASE WHEN b.upto - budget <= budget - (b.upto - b.words) THEN 1 ELSE 0 END) AS threshold FROM e)
SELECT d.doc_id, d.size, p.source_size, p.target,
       ((p.base + CASE WHEN d.place < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
