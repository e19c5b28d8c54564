"""Digests of redacted streams that do not depend on how the stream was cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blackbar.plans.ordered import recut

FANOUT_BITS = 10


def _plain_receipts(redacted: DataFrame, key: str, seq: str, data: str, status: str | None) -> DataFrame:
    done = F.coalesce(F.col(status) == "completed", F.lit(False)) if status else F.lit(True)
    content = F.coalesce(F.col(data).cast("binary"), F.expr("X''"))
    rows = redacted.select(key, F.col(seq).alias("_seq"), content.alias("_data"), done.alias("_done"))
    schema = T.StructType([
        rows.schema[key],
        T.StructField("receipt", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("_done", T.BooleanType()),
    ])

    def run(batches):
        # by value to the workers, which need not have this package
        import hashlib

        import pyarrow as pa

        held = None

        def out(batch_type, ended):
            names = [batch_type.name, "receipt", "bytes", "_done"]
            types = [batch_type.type, pa.string(), pa.int64(), pa.bool_()]
            columns = zip(*[(k, h.hexdigest(), n, d) for k, h, n, d in ended])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            field, ended = batch.schema.field(0), []
            for k, content, d in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if held is None or held[0] != k:
                    if held is not None:
                        ended.append(held)
                    held = [k, hashlib.sha256(), 0, False]
                content = content.as_buffer()
                held[1].update(content)
                held[2] += content.size
                held[3] = held[3] or d
            if ended:
                yield out(field, ended)
        if held is not None:
            yield out(field, [held])

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, "_seq")
    return sorted_rows.mapInArrow(run, schema).where("_done").select(key, "receipt", "bytes", F.lit("sha256").alias("scheme"))


def stream_receipts(
    redacted: DataFrame,
    key: str = "stream_id",
    seq: str = "seq",
    data: str = "redacted",
    status: str | None = "status",
    leaf_bytes: int | None = None,
    fanout_bits: int = FANOUT_BITS,
    levels: int = 3,
) -> DataFrame:
    """Per completed stream: ``key, receipt, bytes, scheme``.

    Without ``leaf_bytes`` the receipt of a stream of any length is the SHA-256 of its bytes:
    a stream's chunks are sorted into one task, which hashes them one after another and holds
    one Arrow batch at a time. With ``leaf_bytes`` long streams are hashed in parallel: the
    stream is cut into leaves of that size, and every 2**fanout_bits digests are hashed again
    until one is left; a stream of one leaf keeps its SHA-256. Receipts are comparable within
    one ``scheme`` (sha256, or sha256-tree with the leaf size and fan-out); leaves and nodes
    are not marked, so a tree's receipt could be the plain SHA-256 of other bytes.
    """
    if leaf_bytes is None:
        return _plain_receipts(redacted, key, seq, data, status)
    rows = redacted.withColumn(data, F.coalesce(F.col(data), F.expr("X''")))
    totals = rows.groupBy(key).agg(
        F.sum(F.octet_length(data)).alias("bytes"),
        (F.bool_or(F.col(status) == "completed") if status else F.lit(True)).alias("_done"),
    )
    leaves = recut(rows, [key], seq, data, leaf_bytes).select(
        key, F.col("piece_no").alias("_no"), F.sha2(data, 256).alias("_digest")
    )
    for level in range(levels):
        digests = F.expr("listagg(_digest, '') WITHIN GROUP (ORDER BY _no)")
        group = F.shiftright("_no", fanout_bits) if level < levels - 1 else F.lit(0).cast("bigint")
        leaves = (
            leaves.groupBy(key, group.alias("_up"))
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.max("_no").alias("_last"),
                F.min("_digest").alias("_only"),
                digests.alias("_all"),
            )
            .select(
                key,
                F.col("_up").alias("_no"),
                # A lone digest is its own parent, so short streams keep the plain SHA-256.
                F.when((F.col("_n") == 1) & (F.col("_last") == 0), F.col("_only"))
                .otherwise(F.sha2(F.unhex("_all"), 256))
                .alias("_digest"),
            )
        )
    empty = F.sha2(F.expr("X''"), 256)
    return (
        totals.where("_done")
        .join(leaves, key, "left")
        .select(
            key,
            F.coalesce("_digest", empty).alias("receipt"),
            "bytes",
            F.when(F.col("bytes") <= leaf_bytes, "sha256")
            .otherwise(f"sha256-tree-{leaf_bytes}-{1 << fanout_bits}")
            .alias("scheme"),
        )
    )
