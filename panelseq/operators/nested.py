"""Nested selection: what every outer group's selection sees, from one table of group metrics.

Leaving one group out changes a mean, a sample deviation and a median in closed form. So the summaries of all outer groups
follow from the totals and the middle values of each candidate, and no table of outer and other groups is made. The
candidates of one outer group are an array in its row; all choices are expressions over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import GROUP
from panelseq.operators import blocks as B
from panelseq.operators.select import with_totals
from panelseq.session import cut

#: Buckets of a candidate's values; each is sorted on its own.
SPLITS = 64
#: Digits to which summaries are compared, so that the order of additions decides nothing.
DIGITS = 9


def value_rank(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with the position (from 0) of each row among the rows of its key, by value and ties; nulls are left out.

    Values are dealt to buckets by approximate quantiles, which only decide how even the buckets are; many equal values are
    dealt on by their ties.
    """
    src = df.where(F.col(value).isNotNull())
    cuts = src.groupBy(*by).agg(F.percentile_approx(value, [i / SPLITS for i in range(1, SPLITS)], 10 * SPLITS).alias("_cuts"))
    at = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col(value)).cast("int"))
    return B.dense_index(src.join(cuts, list(by)), by, at, [value, *ties], name).drop("_cuts")


def middle_values(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """(by, n, below, middle, above): the values at positions n div 2 - 1, n div 2 and n div 2 + 1 of each key, nulls left out."""
    counts = df.groupBy(*by).agg(F.count(value).alias("n"))
    ranked = value_rank(df, by, value, ties, "_rank").join(counts, list(by))
    step = F.col("_rank") - F.expr("n div 2")
    return ranked.where(F.abs(step) <= 1).groupBy(*by, "n").agg(
        *[F.max(F.when(step == k, F.col(value))).alias(c) for k, c in ((-1, "below"), (0, "middle"), (1, "above"))])


def median_without(own: Column, n: Column, below: Column, middle: Column, above: Column) -> Column:
    """The median of n values after one of them is taken out; nothing is taken out for a null."""
    def left(low: Column, high: Column) -> Column:
        # The value at low's position among those left: high moves down if what is taken out was not above low.
        return F.when(own > low, low).otherwise(high)

    even = n % 2 == 0
    return (
        F.when(own.isNull() & even, (below + middle) / 2).when(own.isNull(), middle)
        .when(even, left(below, middle)).otherwise((left(below, middle) + left(middle, above)) / 2))


METRICS = ("rmse", "absolute_lag", "mafd")


def outer_summaries(metrics: DataFrame, candidate: str = "candidate_id", family: str = "family", group: str = GROUP) -> DataFrame:
    """(outer_group, candidates, development_rows, outer_rows_used), one row for each group of ``metrics``.

    ``metrics`` has one row for each candidate and group with rmse, absolute_lag and mafd. ``candidates`` is the array of struct(candidate_id,
    family, mean_rmse, rmse_se, median_absolute_lag, median_mafd, groups) over all other groups, in order of id. The audit counts the outer group's
    own rows in the sums: the rows of the table less the group's own, which another pass has counted, against the rows that the sums rest on.
    """
    rows = cut(metrics.select(group, F.col(candidate).alias("candidate_id"), F.col(family).alias("family"), *[F.col(m).cast("double").alias(m) for m in METRICS]))
    long = rows.select(group, "candidate_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS[1:]])))
    middle = middle_values(long, ["candidate_id", "metric"], "value", [group])
    stats = F.struct("n", "below", "middle", "above")
    middles = middle.groupBy("candidate_id").agg(*[F.max(F.when(F.col("metric") == m, stats)).alias(f"_{m}") for m in METRICS[1:]])
    totals = rows.groupBy("candidate_id").agg(
        F.first("family").alias("family"), F.count("rmse").alias("_n"), F.avg("rmse").alias("_mean"), F.var_pop("rmse").alias("_var"), F.count(F.lit(1)).alias("_rows"))
    one = totals.join(middles, "candidate_id", "left").groupBy(F.lit(1).alias("_k")).agg(
        F.sort_array(F.collect_list(F.struct("candidate_id", "family", "_n", "_mean", "_var", "_rows", *[f"_{m}" for m in METRICS[1:]]))).alias("_all"))
    own = rows.groupBy(F.col(group).alias("outer_group")).agg(
        F.map_from_entries(F.collect_list(F.struct("candidate_id", F.struct(*METRICS)))).alias("_own"), F.count(F.lit(1)).alias("_own_rows"))
    # One row for each candidate, in one row: their number is that of the search.
    wide = own.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")

    def without(c: Column) -> Column:
        mine = F.try_element_at("_own", c["candidate_id"])
        v, n = mine["rmse"], c["_n"]
        left = n - F.when(v.isNull(), 0).otherwise(1)
        mean = F.when(v.isNull(), c["_mean"]).otherwise(F.try_divide(c["_mean"] * n - v, left))
        # Squares about the mean: those of all, less what the value adds.
        squares = c["_var"] * n - F.when(v.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.pow(v - c["_mean"], 2) * n, left), F.lit(0.0)))
        se = F.when(left > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (left - 1)) / F.sqrt(left))
        medians = [
            F.round(median_without(mine[m], *[c[f"_{m}"][k] for k in ("n", "below", "middle", "above")]), DIGITS).alias(f"median_{m}") for m in METRICS[1:]]
        taken = F.when(mine.isNotNull(), 1).otherwise(0)
        return F.struct(
            c["candidate_id"].alias("candidate_id"), c["family"].alias("family"), F.round(mean, DIGITS).alias("mean_rmse"), F.round(se, DIGITS).alias("rmse_se"),
            *medians, left.alias("groups"), (c["_rows"] - taken).alias("rows"))

    out = wide.withColumn("candidates", F.transform("_all", without))
    used = F.aggregate("candidates", F.lit(0).cast("long"), lambda t, c: t + c["rows"])
    out = with_totals(out, (), {"_table": F.sum("_own_rows")})
    return out.select("outer_group", "candidates", used.alias("development_rows"), (used - (F.col("_table") - F.col("_own_rows"))).alias("outer_rows_used"))


def _least(items: Column, *order) -> Column:
    """The first item by ``order``; nulls come last, and there is none of an empty array."""
    keyed = F.transform(items, lambda c: F.struct(
        *[x for i, o in enumerate(order) for x in (o(c).isNull().alias(f"n{i}"), o(c).alias(f"o{i}"))], c["candidate_id"].alias("id"), c.alias("item")))
    return F.array_min(keyed)["item"]


def _of_family(name: str) -> Column:
    return F.filter("candidates", lambda c: c["family"] == name)


def outer_choices(
    summaries: DataFrame, minimum: int = 2, families: Sequence[str] = (), reference: str | None = None,
    matches: Sequence[tuple[str, float, bool]] = (("median_mafd", 0.1, True), ("median_absolute_lag", 0.5, False)), matched_family: str | None = None,
) -> DataFrame:
    """Pool, fast and slow role, each family's best point and the points matched to ``reference``, for every outer group.

    The pool holds the candidates within one standard error of the best; ``pool_ok`` says that it has ``minimum`` at least. Fast is the
    pool's least lag, slow the least MAFD among the others, ties by mean RMSE and id. A match is the candidate of ``matched_family`` whose metric is
    nearest to that of ``reference``, over the same development groups.
    """
    rmse, lag, mafd = (lambda c: c["mean_rmse"]), (lambda c: c["median_absolute_lag"]), (lambda c: c["median_mafd"])
    d = summaries.withColumn("_best", _least(F.col("candidates"), rmse)).withColumn("threshold", F.col("_best.mean_rmse") + F.col("_best.rmse_se"))
    d = d.withColumn("_pool", F.filter("candidates", lambda c: c["mean_rmse"] <= F.col("threshold")))
    d = d.withColumn("_fast", _least(F.col("_pool"), lag, rmse))
    d = d.withColumn("_slow", _least(F.filter("_pool", lambda c: c["candidate_id"] != F.col("_fast.candidate_id")), mafd, rmse))
    out = [
        "outer_group", F.col("_best.candidate_id").alias("best_candidate"), "threshold", F.size("_pool").alias("pool_size"), (F.size("_pool") >= minimum).alias("pool_ok"),
        F.col("_fast.candidate_id").alias("fast_candidate"), F.col("_slow.candidate_id").alias("slow_candidate")]
    for f in families:
        out.append(_least(_of_family(f), rmse, lag, mafd)["candidate_id"].alias(f"best_{f}"))
    if reference is not None:
        d = d.withColumn("_ref", F.filter("candidates", lambda c: c["candidate_id"] == reference)[0])
        for metric, tolerance, relative in matches:
            def far(c: Column, metric=metric) -> Column:
                return F.round(F.abs(c[metric] - F.col("_ref")[metric]), DIGITS)

            hit = _least(_of_family(matched_family), far, rmse)
            allowed = tolerance * (F.greatest(F.abs(F.col("_ref")[metric]), F.lit(1e-12)) if relative else F.lit(1.0))
            out += [hit["candidate_id"].alias(f"{metric}_match"), (far(hit) <= allowed).alias(f"{metric}_within")]
    return d.select(*out, "development_rows", "outer_rows_used")
