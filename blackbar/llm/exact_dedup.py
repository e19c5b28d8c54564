"""Exact deduplication that stays balanced when one text holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import own_name, store

ROWS_PER_SALT = 256


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; the largest id of equal texts stays. Digests only bring
    candidates together: every merge groups by the digest *and the text*.

    1. digests are counted (combined within each task before the shuffle); a text whose digest
       is unique is its own group. The join that picks the others moves every text once, by
       digest alone: adaptive execution splits what a frequent text makes large there;
    2. rows of repeated digests get ``n / rows_per_salt`` salts, are combined within each task
       and merged per (digest, salt, text);
    3. the salt winners are merged per (digest, text), and every row looks up its winner by
       (digest, salt, text).

    Null texts count as empty, so all of them and all empty texts are one group. Null ids are
    ids smaller than any other: such a row stays only in a group without ids, with keep_id
    null. A repeated (id, text) counts once per row in group_size, and its rows are all
    reported as kept when that id wins. An empty table gives no rows. Only the two named
    columns are read, so other columns may have any name.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).withColumn("text_sha256", F.sha2(F.encode("body", "UTF-8"), 256))
    counts = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = store(counts, "digests")
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / rows_per_salt)).cast("int")
    again = store(rows.join(counts.hint("merge"), "text_sha256").withColumn("salt", salt), "repeated")
    local = again.groupBy("text_sha256", "salt", "body", "n").agg(
        F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("rows")
    )
    winners = store(
        local.groupBy("text_sha256", "body", "n").agg(
            F.max("winner").alias("keep_id"), F.sum("rows").alias("group_size")
        ).withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / rows_per_salt) - 1).cast("int")))),
        "winners",
    )
    groups = again.join(
        winners.drop("n").hint("merge"), ["text_sha256", "salt", "body"]
    ).select("doc_id", "text_sha256", "keep_id", "group_size").distinct()
    left, right = rows.drop("body").alias("l"), groups.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_sha256") == F.col("r.text_sha256"))
    return (
        left.join(right.hint("merge"), same, "left")
        .select(
            F.col("l.doc_id").alias("doc_id"),
            F.when(F.col("r.group_size").isNull(), F.col("l.doc_id")).otherwise(F.col("r.keep_id")).alias("keep_id"),
            F.coalesce("r.group_size", F.lit(1)).cast("bigint").alias("group_size"),
            F.col("l.text_sha256").alias("text_sha256"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, one row per id and text.

    Null texts count as empty. Of equal texts the row with the largest id stays, one without an
    id only if none has one; extra columns may have any name and are kept as they are.
    """
    sha = own_name(docs, "sha")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct()
    keyed = docs.withColumn(sha, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).alias("d")
    same = (F.col(f"d.{sha}") == F.col("k.digest")) & F.col("d.doc_id").eqNullSafe(F.col("k.id"))
    return keyed.join(kept.alias("k"), same, "left_semi").dropDuplicates(["doc_id", sha]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
