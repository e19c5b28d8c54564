"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blackbar.llm.common import store

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
BLOCK_ROWS = 8_192
# Sizes keep their six highest bits where only classes of alike sizes matter.
CLASS_BITS = 6
OFFSET_STEPS = 1 << 20


def _numbered(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources in code-point order, null last, with their weights; ordered by ranges, not in one task."""
    ranged = store(
        sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources"
    )
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    number = (F.col("before") + F.col("at")) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("bigint")
    return ranged.withColumn("at", inside).join(parts, "part").select("source", "source_size", weight.alias("weight"))


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE_PERCENT, most: int = MOST_COPIES
) -> DataFrame:
    """Add ``target``, the words to take of each (source, source_size), source names being distinct.

    ``share`` per cent of all words are dealt by weight. A source that would get more than
    ``most`` times its size stops there, and what it can't take is dealt again by weight among
    the others, until none is above. Each round is one aggregate over the sources.
    """
    if share > 100 * most:
        raise ValueError("the share can't exceed what all sources together may give")
    rows = store(_numbered(sources, weights), "sources")
    limit = F.col("source_size") * most
    full = F.lit(False)
    whole = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    seen = -1
    while True:
        stopped = F.when(full, limit).otherwise(0)
        n, given, left = rows.agg(
            F.coalesce(F.sum(full.cast("bigint")), F.lit(0)),
            F.coalesce(F.sum(stopped), F.lit(0)),
            F.coalesce(F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.lit(0)),
        ).first()
        # a weight's part of what the sources at their limit leave, in whole numbers until the end
        above, below = float(whole - 100 * given), float(100 * left)
        if n == seen or not left:
            break
        seen = n
        part = F.col("weight").cast("double") * above / below
        full = part >= limit.cast("double")
    exact = limit.cast("double")
    target = exact if not left else F.when(full, exact).otherwise(F.col("weight").cast("double") * above / below)
    return rows.withColumn("target", target)


def _order_key(*columns: Column) -> Column:
    """Text that orders rows alike in any engine: an MD5 digest."""
    return F.md5(F.concat_ws(":", *columns).cast("binary"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: int = SHARE_PERCENT,
    most: int = MOST_COPIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    A document of a source is expected target / source_size times. Within a source these
    expected copies are summed along an order of the documents; with one random offset drawn
    from the source's name, a document is emitted once per integer that its part of the sum
    crosses. The order goes by falling size class, then by a digest of the id, so every stretch
    of alike sizes gets its share of copies and the words taken stay near the target however
    uneven the sizes are. Sums run over blocks: a source of any size is spread over many tasks.

    Sizes are counts of ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and take
    nothing. A null source is a source of its own, the last one. Rows of one id are documents
    of their own; equal ones are interchangeable. Null ids are kept. An empty table gives no
    rows; only the three named columns are read.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        F.col(source_col).cast("string").alias("source"),
    )
    shift = F.greatest(F.length(F.bin("size")) - CLASS_BITS, F.lit(0))
    size_class = F.expr("size - size % shiftleft(1L, _shift)")
    digest = _order_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = store(
        rows.withColumn("_shift", shift).withColumn("class", size_class).withColumn("digest", digest).drop("_shift"),
        "sizes",
    )
    # Classes of all sources and sizes; one with many rows is cut by leading digits of the digest.
    classes = store(
        rows.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "classes"
    )
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = store(targets(sources, weights, share, most), "targets")
    digits = F.greatest(F.ceil(F.log(16.0, F.col("n") / block_rows)), F.lit(0)).cast("int")
    same = lambda a, b, *names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    blocked = (
        rows.alias("r").join(classes.withColumn("digits", digits).alias("c"), same("r", "c", "source", "class"))
        .select("r.*", F.expr("substring(digest, 1, digits)").alias("block"))
    )
    blocks = blocked.groupBy("source", "class", "block").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("class"), F.asc("block")]
    before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("b")
    blocks = blocks.join(goal.alias("g"), same("b", "g", "source")).select("b.*", "source_size", "target").alias("b")
    inside = F.row_number().over(
        Window.partitionBy("source", "class", "block").orderBy("digest", F.asc_nulls_last("doc_id"), "size")
    )
    placed = blocked.withColumn("at", inside - 1).alias("p").join(blocks, same("p", "b", "source", "class", "block"))
    start = (F.col("b.before") + F.col("p.at")).cast("double")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.coalesce(F.concat(F.lit("s"), F.col("p.source")), F.lit("null"))
    offset = F.conv(F.substring(_order_key(name), 1, 5), 16, 10).cast("double") / OFFSET_STEPS
    copies = F.least(
        F.floor((start + 1) * step + offset) - F.floor(start * step + offset), F.lit(most)
    ).cast("bigint")
    return placed.select(
        F.col("p.doc_id").alias("doc_id"), F.col("p.size").alias("size"), "source_size", "target",
        copies.alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
classed AS (
  SELECT *, size - size % (1::BIGINT << greatest(length(bin(size)) - 6, 0)) AS class FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM sized GROUP BY source),
-- sources by how soon they are full; the first that is not yet fixes what a weight gets
filled AS (
  SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER earlier, 0) AS above,
         100 * (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS below
  FROM sources
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT above::DOUBLE AS above, below::DOUBLE AS below FROM filled
  WHERE weight * above::DOUBLE / below::DOUBLE < 2 * source_size
  ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size,
         CASE WHEN l.above IS NULL OR weight::DOUBLE * l.above / l.below >= 2 * source_size THEN (2 * source_size)::DOUBLE
              ELSE weight::DOUBLE * l.above / l.below END AS target
  FROM sources LEFT JOIN level l ON true),
placed AS (
  SELECT doc_id, size, g.source_size, target,
         CASE WHEN g.source_size > 0 THEN target / g.source_size ELSE 0 END AS step,
         ('0x' || md5(coalesce('s' || c.source, 'null'))[1:5])::INT::DOUBLE / 1048576 AS offs,
         (row_number() OVER (PARTITION BY c.source
            ORDER BY class DESC, md5(coalesce(doc_id::VARCHAR, 'null')), doc_id NULLS LAST, size) - 1)::DOUBLE AS start
  FROM classed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
copied AS (
  SELECT *, least(floor((start + 1) * step + offs) - floor(start * step + offs), 2)::BIGINT AS copies FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies, size * copies AS taken FROM copied
"""
