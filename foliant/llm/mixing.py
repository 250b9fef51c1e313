"""Problem 7: mixing sources to target weights.

Poisson replication.  Each record draws its number of copies by inverting a
Poisson distribution at a uniform number hashed from a seed and its id.  The
distribution is cut at the source's most repeats, and its rate is solved so that
the mean under the cut is the repetition the target needs.  Records are exploded
by their copies and shuffled globally by a second hash.

Defined results: records of a null or unlisted source, and null or empty texts,
are not selected; equal ids draw alike; a source without records reaches the
share 0 and is left out of the total; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import VOCABULARY, with_sizes

SEED = 20_240_601
#: Uniform numbers have this many bits.
BITS = 40


def capped_mean(rate: float, most: int) -> float:
    """Mean of min(Poisson(rate), most)."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(most):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + most * max(0.0, 1.0 - below)


def solve_rate(mean: float, most: int) -> float:
    """The rate whose mean under the cut is the given one; infinite where every record has all its repeats."""
    if mean >= most * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, most) < mean and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, most) < mean else (low, mid)
    return high


def thresholds(rate: float, most: int) -> list[float]:
    """Values of the cut distribution function: a draw u has as many copies as there are values it is not below."""
    if math.isinf(rate):
        return [0.0] * most
    p, below, out = math.exp(-rate), 0.0, []
    for k in range(most):
        below += p
        out.append(min(1.0, below))
        p *= rate / (k + 1)
    return out


def uniform(name: str, key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"{name}:{seed}"), key), F.lit(1 << BITS)) / F.lit(float(1 << BITS))


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[tuple[str, float, int, list[float]]]:
    """(source, target share, most repeats, thresholds); sizes in tokens.

    Without a total, the largest is taken that every source can still give its share of.
    """
    able = [(s, w, m) for s, w, m in targets if sizes.get(s) and w > 0 and m > 0]
    whole = sum(w for _, w, _ in able) or 1.0
    most = min((m * sizes[s] / (w / whole) for s, w, m in able), default=0.0)
    total = most if total is None else min(total, most)
    return [(s, w, m, thresholds(solve_rate(total * w / whole / sizes[s], m), m)) for s, w, m in able]


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """The selection in its shuffled order: shuffle_key, doc_id, copy, source, n_tokens, target_share, reached_share.

    Sizes by source, one row each, are all that reaches the driver.  Rows are ordered by shuffle_key, by range
    partitions, so a source that holds a third of all rows is spread like any other.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    wanted = [(r[0], float(r[1]), int(r[2])) for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null").collect()]
    listed = rows.where(F.col("source").isin([s for s, _, _ in wanted]) & F.col("text").isNotNull() & (F.col("text") != ""))
    sized = cut(with_sizes(listed, path=path)).where("n_tokens > 0")
    sizes = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint"))).collect()}
    chosen = plan(sizes, wanted, total)
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, thresholds array<double>"
    table = spark.createDataFrame(chosen, schema)
    u = uniform("copies", F.col("doc_id"), seed)
    drawn = sized.join(F.broadcast(table), "source").withColumn("copies", F.size(F.filter("thresholds", lambda t: u >= t)))
    drawn = drawn.where("copies > 0")
    sums = drawn.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("tokens"))
    reached = {r[0]: r[1] for r in sums.collect()}
    grand = sum(reached.values()) or 1
    shares = spark.createDataFrame([(s, reached.get(s, 0) / grand) for s, *_ in chosen], "source string, reached_share double")
    copies = drawn.select("doc_id", "source", "n_tokens", "target_share", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(f"order:{seed}"), "doc_id", "copy")).join(F.broadcast(shares), "source")
    return keyed.orderBy("shuffle_key", "doc_id", "copy").select("shuffle_key", "doc_id", "copy", "source", "n_tokens", "target_share", "reached_share")


def report(mixed: DataFrame) -> DataFrame:
    """source, records, copies, tokens, target_share, reached_share."""
    return mixed.groupBy("source", "target_share", "reached_share").agg(F.countDistinct("doc_id").alias("records"), F.count("*").alias("copies"), F.sum(F.col("n_tokens").cast("bigint")).alias("tokens")).select("source", "records", "copies", "tokens", "target_share", "reached_share")
