"""Folds, bootstrap samples and parameter grids over groups.

Random orders and draws are keyed by md5, so they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelseq import GROUP, SEED
from panelseq.functions import expr as X
from panelseq.operators import blocks as B
from panelseq.operators.select import with_totals
from panelseq.operators.updaters import valid_config
from panelseq.session import ship


def shuffled_rank(groups: DataFrame, seeds: Sequence[int], group: str = GROUP) -> DataFrame:
    """(seed, group, rank): position of each group in the seed's md5 order."""
    rows = groups.select(group).distinct().withColumn(SEED, F.explode(F.array(*[F.lit(s) for s in seeds])))
    rows = rows.withColumn("_h", X.digest(F.col(SEED), F.col(group)))
    return B.dense_index(rows, [SEED], F.substring("_h", 1, 3), ["_h", group], "rank").select(SEED, group, "rank")


def grouped_kfold(groups: DataFrame, seeds: Sequence[int], k: int = 5, group: str = GROUP) -> DataFrame:
    """(seed, group, rank, fold): k nearly equal parts of the shuffled groups, larger parts first."""
    ranked = with_totals(shuffled_rank(groups, seeds, group), [SEED], {"_n": F.count(F.lit(1))})
    q, r = F.expr(f"_n div {k}"), F.expr(f"_n % {k}")
    big = r * (q + 1)
    fold = F.when(F.col("rank") < big, F.floor(F.col("rank") / (q + 1))).otherwise(
        r + F.floor((F.col("rank") - big) / F.greatest(q, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).select(SEED, group, "rank", "fold")


def fold_roles(folds: DataFrame, k: int = 5, group: str = GROUP) -> DataFrame:
    """(seed, fold, group, role): each group in every fold, validated once."""
    return folds.select(SEED, group, F.col("fold").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).select(
        SEED, "fold", group, F.when(F.col("fold") == F.col("_own"), "validation").otherwise("train").alias("role"))


def _pour(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal items each fold gets when each goes to the lightest."""
    base = np.array(loads, dtype=object)

    def taken(level: int) -> list[int]:
        return [max(0, -(-(level - b) // size)) for b in base]

    lo, hi = int(min(base)), int(min(base)) + size * (count + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if sum(taken(mid)) <= count:
            lo = mid
        else:
            hi = mid - 1
    got = taken(lo)
    for i in np.argsort([b + g * size for b, g in zip(base, got)], kind="stable")[: count - sum(got)]:
        got[int(i)] += 1
    return got


def balanced_group_folds(df: DataFrame, k: int, group: str = GROUP, weight: str | None = None) -> DataFrame:
    """(group, rows, fold): largest groups first, each to the lightest fold.

    Only the histogram of group sizes is walked in order; it has at most as many
    rows as there are distinct sizes. Groups then find their fold by size and
    position among the groups of that size.
    """
    ship(df.sparkSession)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(group).agg(n.cast("long").alias("rows"))
    hist = sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("m")).repartition(1).sortWithinPartitions(F.col("rows").desc())

    def walk(batches):
        loads = [0] * k
        for b in batches:
            out = {"rows": [], "fold": [], "first": [], "last": []}
            for size, m in zip(b.column("rows").to_pylist(), b.column("m").to_pylist()):
                got = _pour(loads, size, m)
                at = 0
                for f, g in enumerate(got):
                    if g:
                        out["rows"].append(size)
                        out["fold"].append(f)
                        out["first"].append(at)
                        out["last"].append(at + g - 1)
                        at += g
                        loads[f] += g * size
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("rows", pa.int64()), ("fold", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))

    cuts = hist.mapInArrow(walk, "rows long, fold int, first long, last long")
    placed = B.dense_index(sizes, ["rows"], F.substring(F.md5(F.col(group).cast("string")), 1, 2), [F.md5(F.col(group).cast("string")), group], "_at")
    return placed.join(cuts, "rows").where("_at between first and last").select(group, "rows", "fold")


def loso_splits(groups: DataFrame, seeds: Sequence[int], fraction: float, group: str = GROUP) -> DataFrame:
    """(seed, group, rank, cutoff): leave-one-group-out without the n x n table.

    With test group g, the validation part is the first ``cutoff`` others in the
    seed's order: see ``loso_role``. The part is rounded half up, at least 1.
    """
    ranked = with_totals(shuffled_rank(groups, seeds, group), [SEED], {"_n": F.count(F.lit(1))})
    part = F.greatest(F.lit(1), F.floor((F.col("_n") - 1) * fraction + 0.5)).cast("long")
    return ranked.withColumn("cutoff", part).withColumn("others", F.col("_n") - 1).select(SEED, group, "rank", "cutoff", "others")


def loso_role(rank: str, test_rank: str, cutoff: str) -> "F.Column":
    """Role of a group given the test group's rank, as a column expression."""
    place = F.col(rank) - F.when(F.col(test_rank) < F.col(rank), 1).otherwise(0)
    return F.when(F.col(rank) == F.col(test_rank), "test").when(place < F.col(cutoff), "validation").otherwise("train")


def loso_roles(splits: DataFrame, tests: Sequence, group: str = GROUP) -> DataFrame:
    """Roles of all groups for a short literal list of test groups."""
    chosen = splits.where(F.col(group).isin(*tests)).select(SEED, F.col(group).alias("test_group"), F.col("rank").alias("_test"))
    return splits.join(F.broadcast(chosen), SEED).select(
        SEED, "test_group", group, loso_role("rank", "_test", "cutoff").alias("role"))


def group_bootstrap(groups: DataFrame, seed: int, group: str = GROUP) -> DataFrame:
    """n draws with replacement: (bootstrap_id = -(draw+1), original group)."""
    from panelseq.operators.infer import group_index

    idx = group_index(groups.select(group).distinct(), group)
    slots = with_totals(idx, (), {"_n": F.count(F.lit(1))}).select(
        F.col("idx").alias("draw"), X.draw_index("_n", seed, F.col("idx")).alias("idx"))
    return slots.join(idx, "idx").select("draw", (-(F.col("draw") + 1)).alias("bootstrap_id"), group)


def bootstrap_rows(rows: DataFrame, draws: DataFrame, group: str = GROUP) -> DataFrame:
    """Rows of the drawn groups; copies keep the original group id."""
    return rows.join(draws, group)


# ------------------------------------------------------------------ grids
def gain_grid(spark: SparkSession, points: int = 1001) -> DataFrame:
    return spark.range(points).select(
        F.format_string("c0_alpha_k%04d", F.col("id")).alias("candidate_id"), F.col("id").cast("int").alias("k"),
        (F.col("id") / (points - 1)).alias("alpha"))


def noise_grid(spark: SparkSession, q: Sequence[float], r: Sequence[float]) -> DataFrame:
    one = spark.range(1)
    return one.select(F.explode(F.array(*[F.lit(float(x)) for x in q])).alias("q")).select(
        "q", F.explode(F.array(*[F.lit(float(x)) for x in r])).alias("r")).select(
        F.concat(F.lit("kalman_q_"), F.col("q").cast("string"), F.lit("_r_"), F.col("r").cast("string")).alias("candidate_id"), "q", "r")


def tracker_grid(spark: SparkSession, values: dict[str, Sequence[float]], sample: int | None = None, seed: int = 0) -> DataFrame:
    """Valid tracker configs of a small value grid; a sample follows the md5 order."""
    names = list(values)
    df = spark.range(1).drop("id")
    for n in names:
        df = df.withColumn(n, F.explode(F.array(*[F.lit(v) for v in values[n]])))
    df = df.where(valid_config()).withColumn("_h", X.digest(seed, *[F.col(n) for n in names]))
    if sample is not None:
        df = df.orderBy("_h").limit(sample)
    return df.withColumn("config_id", F.concat(F.lit("tracker_"), F.substring("_h", 1, 12))).drop("_h")


def grid_points(values: dict[str, Sequence]) -> list[dict]:
    """The same grid as plain dictionaries, for kernels that take config objects."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]
