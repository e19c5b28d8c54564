"""URL filter: rules on host and path, and logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import mix64, spread
from blackbar.llm.words import ragged

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
# The training table: so many distinct labelled URLs of each verdict.
TRAIN_URLS = 2000
EPOCHS = 60

# Fixed values of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_first(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2], r[0] != "block"))


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one.

    Equally long rules go by name, and of equal rules a blocking one is first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(longest_first(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def gram_rows(hosts: list[str], paths: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram; those of host and path have hashes of their own."""
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind, texts in ((1, hosts), (2, paths)):
        texts = ["\x02" + t + "\x03" for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        begin = np.cumsum(size) - size
        for n in GRAMS:
            count = np.maximum(0, size - n + 1)
            at = ragged(begin, count)
            code = np.full(len(at), kind * 16 + n, np.uint64)
            for d in range(n):
                code = mix64(code * np.uint64(0x100000001B3) + data[at + d])
            rows.append(np.repeat(np.arange(len(texts)), count))
            cells.append((code % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cells)


class UrlModel:
    """Logistic regression: the probability that a URL is to be blocked."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        row, cell = gram_rows(hosts, paths, len(self.weights))
        n = np.maximum(1, np.bincount(row, minlength=len(hosts)))
        return np.bincount(row, self.weights[cell], minlength=len(hosts)) / np.sqrt(n) + self.bias


def train(hosts: list[str], paths: list[str], blocked: np.ndarray, epochs: int = EPOCHS, l2: float = 1e-4) -> UrlModel:
    """Full-batch AdaGrad. Without URLs everything is allowed; with one label all get that one."""
    w, b = np.zeros(BUCKETS), 0.0
    if not len(blocked) or blocked.min() == blocked.max():
        return UrlModel(w, 1.0 if len(blocked) and blocked.max() else -1.0)
    row, cell = gram_rows(hosts, paths)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
    share = blocked.mean()
    weight = np.where(blocked == 1, 0.5 / share, 0.5 / (1 - share)) / len(blocked)
    seen, seen_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, w[cell], minlength=len(hosts)) * norm + b
        d = (1 / (1 + np.exp(-z)) - blocked) * weight
        g = np.bincount(cell, (d * norm)[row], minlength=BUCKETS) + l2 * w
        seen += g * g
        seen_b += d.sum() ** 2
        w -= 0.3 * g / np.sqrt(seen)
        b -= 0.3 * d.sum() / np.sqrt(seen_b)
    return UrlModel(w, b)


def _scorer(model: UrlModel):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                z = model.logits(some.column(1).to_pylist(), some.column(2).to_pylist())
                names = [*some.schema.names, "block_score"]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(1 / (1 + np.exp(-z)))], names=names)

    return run


def url_filter(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    train_urls: int = TRAIN_URLS,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    The longest fitting rule decides; a page without one is blocked if the model, trained on
    ``labelled`` (url, verdict), gives it ``threshold`` or more. Of the labelled URLs at most
    ``train_urls`` distinct ones of each verdict are used, in the order of a hash; a URL with
    both verdicts counts as blocked. Null URLs and URLs without ``://`` have an empty host and
    path and are judged like any other. Repeated rows are repeated in the result, null ids
    kept; an empty table gives no rows. Only the two named columns are read.
    """
    known = (
        labelled.where("url is not null and verdict in ('allow', 'block')")
        .groupBy("url").agg(F.max("verdict").alias("verdict")).withColumn("h", F.xxhash64("url"))
    )
    parts = [known.where(F.col("verdict") == v).orderBy("h", "url").limit(train_urls) for v in ("block", "allow")]
    url = F.col("url")
    found = parts[0].unionByName(parts[1]).select(
        url_host(url).alias("host"), url_path(url).alias("path"), (F.col("verdict") == "block").cast("int").alias("y")
    ).toPandas()
    model = train(found["host"].tolist(), found["path"].tolist(), found["y"].to_numpy(float))
    url = F.col(url_col)
    rows = spread(pages.select(F.col(id_col).cast("bigint").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")))
    scored = rows.mapInArrow(_scorer(model), "page_id bigint, host string, path string, block_score double")
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "block_score")


def rule_labels(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """(url, verdict) of the pages that a rule decides: a labelled table to learn from."""
    url = F.col(url_col)
    _, verdict = apply_rules(url_host(url), url_path(url), rules)
    return pages.select(url.alias("url"), verdict.alias("verdict")).where("verdict is not null")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, rule_labels(pages))
