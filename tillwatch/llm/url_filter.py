"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

A rule names a host and the beginning of a path; it fits the host and all its subdomains, and the
longest fitting rule decides. URLs that no rule fits go to a classifier trained on a small table of
labelled URLs. Each distinct (host, path) is judged once.

Defined results
    null url, or one without ``://``   empty host and path; the classifier decides
    rules of equal length              the one with the longer host, then the first one in the alphabet
    labels of one kind or none         every URL without a rule gets that kind, or ``allow``
    repeated rows                      each row is judged
    very long urls                     time and memory grow with their length, labels of the host included
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.common import stored, text_slices

GRAMS = (3, 4)
FEATURE_BITS = 15
TRAIN_ROWS = 4096  # most labelled URLs the classifier is fitted on
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"

_SLICE = 1 << 19
_CHARS = 1 << 20  # code points that are looked at together
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) rows."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def fitting_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) rows with ``rule`` and ``rule_verdict`` of the longest fitting rule, else null.

    A URL meets the rules of its host and of its parent domains in an equi-join, never all rules. Domains of more
    labels than any rule has are left out, so a host of any length is spread over few rows.
    """
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1  # labels of the longest rule
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, most + 1)]))
    spread = urls.select("host", "path", F.explode(suffixes).alias("rule_host"))
    met = spread.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    order = F.struct((-F.length(text)).alias("a"), (-F.length("rule_host")).alias("b"), text.alias("rule"),
                     F.col("rule_verdict").alias("rule_verdict"))
    best = met.groupBy("host", "path").agg(F.min(order).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), "best.rule_verdict")
    return urls.join(best, ["host", "path"], "left")


def _hashed(codes: np.ndarray, row: np.ndarray, seed: int) -> np.ndarray:
    """Distinct (row, bucket) numbers of the n-grams that lie within one row."""
    found = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        whole = len(codes) - n + 1
        h = np.full(whole, seed * 8 + n, np.uint64) * _FACTORS[3]
        for i in range(n):
            h = (h ^ codes[i : i + whole]) * _FACTORS[i % 3]
            h ^= h >> np.uint64(29)
        inside = row[:whole] == row[n - 1 :]
        bucket = (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        found.append(np.unique((row[:whole][inside] << FEATURE_BITS) | bucket[inside]))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def gram_buckets(texts: pa.Array, seed: int) -> np.ndarray:
    """Sorted (row << FEATURE_BITS | bucket) of the character n-grams of each text, whose edges are marked. Linear in
    the text, and long ones are looked at in overlapping parts, so memory is bounded by the buckets."""
    marked = [f"^{t}$" for t in texts.to_pylist()]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    found = []
    for start in range(0, max(1, len(codes)), _CHARS):
        part = slice(start, start + _CHARS + max(GRAMS) - 1)
        place = np.arange(start, min(len(codes), part.stop))
        row = np.searchsorted(ends, place, side="right")
        found.append(_hashed(codes[part].astype(np.uint64), row, seed))
    return np.unique(np.concatenate(found))


def url_buckets(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct feature of each URL; host and path have features of their own."""
    both = np.unique(np.concatenate([gram_buckets(hosts, 1), gram_buckets(paths, 2)]))
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def _parts(hosts: pa.Array, paths: pa.Array):
    """Runs of rows with little text each: (first row, hosts, paths)."""
    for at, some in text_slices(paths, _SLICE):
        for more, own in text_slices(hosts.slice(at, len(some)), _SLICE):
            yield at + more, own, some.slice(more, len(own))


class UrlClassifier:
    """Logistic regression over hashed n-grams; ``weights`` end with the constant."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, row: np.ndarray, bucket: np.ndarray, allow: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> "UrlClassifier":
        """Accelerated gradient steps on the mean log loss; the step size bounds the curvature, so they converge."""
        n, width = len(allow), 1 << FEATURE_BITS
        rate = 4 * n / (np.bincount(row, minlength=n).max(initial=0) + 1) / n
        w, ahead = np.zeros(width + 1), np.zeros(width + 1)
        for step in range(steps):
            left = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[bucket], n) + ahead[-1], -30, 30))) - allow
            gradient = np.append(np.bincount(bucket, left[row], width), left.sum()) / n + ridge * ahead
            new = ahead - rate * gradient
            ahead = new + step / (step + 3) * (new - w)
            w = new
        return cls(w)

    def p_allow(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, bucket = url_buckets(hosts, paths)
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[bucket], len(hosts)) + self.weights[-1], -500, 500)))


def fit_classifier(labelled: DataFrame, most_rows: int = TRAIN_ROWS) -> UrlClassifier | str:
    """Fit on (host, path, verdict) rows; at most ``most_rows`` of them, drawn by the URL's hash.

    The driver gets the buckets of the drawn URLs, at most ``most_rows`` times 2^FEATURE_BITS numbers.
    """
    drawn = labelled.select("host", "path", (F.col("verdict") == "allow").cast("double").alias("allow"))
    drawn = drawn.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most_rows)

    def buckets(batches):
        for batch in batches:
            for at, hosts, paths in _parts(batch.column(0), batch.column(1)):
                row, bucket = url_buckets(hosts, paths)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(len(hosts) + 1)), pa.int32()), pa.array(bucket, pa.int32())
                )
                yield pa.RecordBatch.from_arrays([lists, batch.column(2).slice(at, len(hosts))], names=["buckets", "allow"])

    rows = drawn.mapInArrow(buckets, "buckets array<int>, allow double").collect()
    allow = np.array([r["allow"] for r in rows])
    if len(set(allow.tolist())) < 2:
        return "block" if len(rows) and not allow[0] else "allow"
    row = np.repeat(np.arange(len(rows)), [len(r["buckets"]) for r in rows])
    return UrlClassifier.fit(row, np.array([b for r in rows for b in r["buckets"]], np.int64), allow)


def classify(urls: DataFrame, model: UrlClassifier | str) -> DataFrame:
    """Add ``p_allow`` to (host, path) rows."""
    if isinstance(model, str):
        return urls.withColumn("p_allow", F.lit(1.0 if model == "allow" else 0.0))
    shared = urls.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def chance(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [shared.value.p_allow(own, some) for _, own, some in _parts(hosts, paths)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return urls.withColumn("p_allow", chance("host", "path"))


def filter_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_allow for every row.

    ``labelled`` has (url, verdict) rows; without it the URLs that a rule fits serve as labelled ones.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = stored(fitting_rule(parts.select("host", "path").distinct(), rules), "ruled-urls")
    if labelled is None:
        examples = ruled.filter(F.col("rule").isNotNull()).withColumnRenamed("rule_verdict", "verdict")
    else:
        host, path = host_and_path(F.col("url").cast("string"))
        examples = labelled.select(host.alias("host"), path.alias("path"), "verdict")
    judged = classify(ruled, fit_classifier(examples))
    own = F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")
    judged = judged.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")
    return parts.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "p_allow")
