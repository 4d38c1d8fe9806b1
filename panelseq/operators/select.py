"""Selection on development data: pools, roles, rankings, matching, gains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelseq import GROUP


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Top row per key as one aggregate of the ordering struct: combines map-side."""
    packed = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct("*").alias("_row"))).alias("_m")
    got = (df.groupBy(*by).agg(packed) if by else df.groupBy(F.lit(1).alias("_k")).agg(packed).drop("_k")).select("_m._row.*")
    return got.select(*df.columns)


def with_totals(df: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Attach per-key totals by a join: no window over an unbounded key.

    Without keys the totals are one row, which is always safe to broadcast.
    """
    aggs = [c.alias(n) for n, c in totals.items()]
    if by:
        return df.join(df.groupBy(*by).agg(*aggs), list(by))
    one = df.agg(*aggs).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")


def one_se_pool(summary: DataFrame, by: Sequence[str] = (), minimum: int = 2, candidate: str = "candidate_id") -> DataFrame:
    """Candidates with mean RMSE <= best + SE(best); ``pool_ok`` tells if enough."""
    best = F.min(F.struct("mean_rmse", candidate, "rmse_se"))
    out = with_totals(summary, by, {"_best": best}).withColumn("threshold", F.col("_best.mean_rmse") + F.col("_best.rmse_se"))
    pool = out.where("mean_rmse <= threshold").drop("_best")
    return with_totals(pool, by, {"pool_size": F.count(F.lit(1))}).withColumn("pool_ok", F.col("pool_size") >= minimum)


def pick_roles(pool: DataFrame, by: Sequence[str] = (), candidate: str = "candidate_id") -> DataFrame:
    """Fast: lowest lag, RMSE, id. Slow: lowest MAFD, RMSE, id among the others."""
    fast = _first(pool, by, [F.col("median_absolute_lag"), F.col("mean_rmse"), F.col(candidate)])
    keys = [*by, candidate]
    rest = pool.join(fast.select(*keys), keys, "left_anti")
    slow = _first(rest, by, [F.col("median_mafd"), F.col("mean_rmse"), F.col(candidate)])
    return fast.withColumn("role", F.lit("fast")).unionByName(slow.withColumn("role", F.lit("slow")))


def rank_candidates(df: DataFrame, by: Sequence[str] = (), eligible: Column | None = None, score: Column | None = None, candidate: str = "candidate_id") -> DataFrame:
    """Eligible first, then score, RMSE, CCC descending, id; marks the winner.

    ``eligible`` and ``score`` are the caller's rule; a key without an eligible
    candidate has no winner. Ranks are per search, whose grid bounds their number.
    """
    d = df.withColumn("eligible", eligible if eligible is not None else F.col("eligible")).withColumn(
        "selection_score", score if score is not None else F.col("selection_score"))
    w = Window.partitionBy(*by).orderBy(
        F.col("eligible").desc(), F.col("selection_score"), F.col("rmse"), F.col("ccc").desc(), F.col(candidate))
    return d.withColumn("rank", F.row_number().over(w)).withColumn("winner", (F.col("rank") == 1) & F.col("eligible"))


def best_operating_point(df: DataFrame, by: Sequence[str] = ("family",), candidate: str = "candidate_id") -> DataFrame:
    return _first(df, by, [F.col("mean_rmse"), F.col("median_absolute_lag"), F.col("median_mafd"), F.col(candidate)])


def match_operating_point(
    df: DataFrame, reference: DataFrame, metric: str, tolerance: float, relative: bool, by: Sequence[str] = ("family",),
    candidate: str = "candidate_id",
) -> DataFrame:
    """Nearest candidate to the one-row reference on ``metric``."""
    ref = reference.select(F.col(metric).alias("_ref")).withColumn("_k", F.lit(1))
    near = df.withColumn("_k", F.lit(1)).join(F.broadcast(ref), "_k").drop("_k").withColumn(
        "absolute_distance", F.abs(F.col(metric) - F.col("_ref")))
    top = _first(near, by, [F.col("absolute_distance"), F.col("mean_rmse"), F.col(candidate)])
    rel = F.col("absolute_distance") / F.greatest(F.abs(F.col("_ref")), F.lit(1e-12))
    judged = rel if relative else F.col("absolute_distance")
    return top.withColumn("relative_distance", rel).withColumn("within_tolerance", judged <= tolerance).drop("_ref")


def select_gain(objective: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gain with the lowest mean group RMSE; ties go to the smaller gain."""
    means = objective.groupBy(*by, "alpha").agg(F.avg("rmse").alias("mean_rmse"))
    best = F.min(F.struct(F.round("mean_rmse", 12).alias("r"), F.col("alpha"), F.col("mean_rmse"))).alias("_b")
    return (means.groupBy(*by).agg(best) if by else means.agg(best)).select(*by, "_b.alpha", "_b.mean_rmse")


def selected_methods(selection: DataFrame) -> DataFrame:
    """family x role -> operating point and its parameters, parsed from JSON."""
    p = F.from_json("parameters", "alpha double, q double, r double")
    return selection.select("family", "role", "candidate_id", p.alias("p")).select(
        "family", "role", "candidate_id", "p.alpha", "p.q", "p.r")


def order_canonical(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-key range sort, for sinks only."""
    return df.orderBy(*keys)


def leave_one_out(df: DataFrame, value: str, group: str = GROUP, by: Sequence[str] = ()) -> DataFrame:
    """Mean without each group and whether the direction changes."""
    from panelseq.functions.expr import sign_mark

    t = with_totals(df, by, {"_s": F.sum(value), "_n": F.count(value)})
    loo = F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1)
    return t.select(
        *by, group, loo.alias("mean_without"), sign_mark(loo).alias("direction"),
        (sign_mark(loo) != sign_mark(F.col("_s") / F.col("_n"))).alias("direction_changed"))
