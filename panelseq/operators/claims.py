"""Contrasts, distributions, claim states and what changes between constructions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import EPS, GROUP
from panelseq.functions import expr as X
from panelseq.operators import blocks as B

MARKS = (X.PLUS, X.MINUS, X.ZERO)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "quantity", value: str = "value") -> DataFrame:
    return df.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])))


def _counts(value: str, eps: float = EPS) -> list[Column]:
    v = F.col(value)
    return [F.count_if(v > eps).alias("positive_groups"), F.count_if(v < -eps).alias("negative_groups"),
            F.count_if(F.abs(v) <= eps).alias("zero_groups")]


# ------------------------------------------------------------------ F15..F18
def sign_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_counts(col))


def distribution(long: DataFrame, by: Sequence[str] = ("quantity",), value: str = "value") -> DataFrame:
    """Mean, extremes, quartiles, sample sd and sign counts per quantity."""
    base = long.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"), *_counts(value))
    q = B.exact_quantiles(long, by, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return base.join(q, list(by))


def majority(df: DataFrame) -> DataFrame:
    """Category and polarity from the three sign counts."""
    c = X.majority("positive_groups", "negative_groups", "zero_groups")
    return df.withColumn("majority", c).withColumn("majority_polarity", X.polarity("majority"))


def heterogeneity(long: DataFrame, by: Sequence[str] = ("claim_id",), value: str = "value", intervals: DataFrame | None = None) -> DataFrame:
    """Spread, disagreement and fragility of each claim's group values."""
    by = list(by)
    v = F.col(value)
    d = distribution(long, by, value)
    away = long.join(d.select(*by, F.col("median").alias("_med")), by).withColumn("_away", F.abs(v - F.col("_med")))
    mad = B.exact_median(away, by, "_away", "mad")
    extra = long.groupBy(*by).agg(
        F.sum(F.when(v > EPS, v).otherwise(0.0)).alias("positive_sum"), F.sum(F.when(v < -EPS, v).otherwise(0.0)).alias("negative_sum"),
        F.min(F.struct((-F.abs(v)).alias("a"), F.col(GROUP).alias("id"))).alias("_top"))
    out = d.join(mad, by).join(extra, by)
    margin = F.abs(F.col("positive_groups") - F.col("negative_groups"))
    out = out.withColumns({
        "iqr": F.col("q3") - F.col("q1"), "mean_direction": X.direction("mean"), "median_direction": X.direction("median"),
        "majority_margin": margin, "largest_group": F.col("_top.id")}).withColumns({
        "mean_median_disagree": F.col("mean_direction") != F.col("median_direction"),
        "flips_to_reverse": F.when(F.col("majority_margin") > 0, F.expr("majority_margin div 2 + 1")).when(
            F.expr("positive_groups + negative_groups") > 0, F.lit(1).cast("long")),
        "abs_mean_over_iqr": F.when(F.col("iqr") > 0, F.abs("mean") / F.col("iqr"))})
    out = out.withColumn("one_flip_reverses", F.coalesce(F.col("flips_to_reverse") == 1, F.lit(False))).drop("_top")
    if intervals is not None:
        out = out.join(intervals.select(*by, "lower", "upper"), by, "left").withColumn(
            "directional_but_spans_zero", (F.col("mean_direction") != "ZERO") & (X.support_category("lower", "upper") == "SPANS_ZERO")
        ).drop("lower", "upper")
    return out


# ------------------------------------------------------------------ F19, I10
def unmatched_groups(first: DataFrame, second: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys that only one side has, and which side that is: the violations of a paired comparison."""
    keys = [*by, GROUP]
    side = lambda df, name: df.select(*keys).distinct().withColumn("present_in", F.lit(name))
    return side(first, "first").join(second, keys, "left_anti").unionByName(side(second, "second").join(first, keys, "left_anti"))


def _paired(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join that refuses keys without a partner, instead of losing them."""
    a, b = first.withColumn("_a", F.lit(True)), second.withColumn("_b", F.lit(True))
    j = a.join(b, list(keys), "full")
    lone = F.raise_error(F.concat(F.lit("a group has no partner: "), F.to_json(F.struct(*keys))))
    both = F.col("_a") & F.col("_b")
    return j.withColumn(GROUP, F.when(both, F.col(GROUP)).otherwise(lone.cast(first.schema[GROUP].dataType))).drop("_a", "_b")


def transition_rows(src: DataFrame, dst: DataFrame, by: Sequence[str] = ("comparison_id",), value: str = "value") -> DataFrame:
    """One row per group: signs on both sides and the accounting bucket.

    Both sides must have the same groups (see ``unmatched_groups``); a lone one raises in the task.
    """
    a = src.select(*by, GROUP, F.col(value).alias("source_value"))
    b = dst.select(*by, GROUP, F.col(value).alias("destination_value"))
    j = _paired(a, b, [*by, GROUP])
    j = j.withColumn("source_sign", X.sign_mark("source_value")).withColumn("destination_sign", X.sign_mark("destination_value"))
    bucket = F.when((F.col("source_sign") == X.ZERO) | (F.col("destination_sign") == X.ZERO), "any_zero").when(
        F.col("source_sign") == F.col("destination_sign"), "retained_nonzero").otherwise("flipped_nonzero")
    return j.withColumn("transition", F.concat(F.col("source_sign"), F.lit("→"), F.col("destination_sign"))).withColumn(
        "sign_retained", F.col("source_sign") == F.col("destination_sign")).withColumn("bucket", bucket)


def sign_transitions(rows: DataFrame, by: Sequence[str] = ("comparison_id",)) -> DataFrame:
    """3x3 counts per comparison, absent cells as 0, with both marginals."""
    cell = lambda a, b: F.count_if((F.col("source_sign") == a) & (F.col("destination_sign") == b))
    wide = rows.groupBy(*by).agg(*[cell(a, b).alias(f"_{i}{j}") for i, a in enumerate(MARKS) for j, b in enumerate(MARKS)])
    src = {i: sum((F.col(f"_{i}{j}") for j in range(3)), F.lit(0)) for i in range(3)}
    dst = {j: sum((F.col(f"_{i}{j}") for i in range(3)), F.lit(0)) for j in range(3)}
    grid = F.inline(F.array(*[
        F.struct(F.lit(a).alias("source_sign"), F.lit(b).alias("destination_sign"), F.col(f"_{i}{j}").alias("n"),
                 src[i].alias("source_total"), dst[j].alias("destination_total"))
        for i, a in enumerate(MARKS) for j, b in enumerate(MARKS)]))
    return wide.select(*by, grid)


def claim_states(long: DataFrame, intervals: DataFrame, by: Sequence[str] = ("claim_id",), value: str = "value") -> DataFrame:
    """Mean, interval support, sign counts and majority of each claim."""
    base = long.groupBy(*by).agg(F.avg(value).alias("population_mean"), F.count(value).alias("n_groups"), *_counts(value))
    out = majority(base).join(intervals.select(*by, "lower", "upper"), list(by), "left")
    return out.withColumn("mean_direction", X.direction("population_mean")).withColumn("ci_support", X.support_category("lower", "upper"))


def claim_retention(states: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """What survives between two constructions of a claim.

    ``pairs`` is (comparison_id, source_claim, destination_claim); ``rows`` comes
    from transition_rows.
    """
    fields = ("mean_direction", "ci_support", "majority", "majority_polarity")
    s = states.select(F.col("claim_id").alias("source_claim"), *[F.col(f).alias(f"s_{f}") for f in fields])
    d = states.select(F.col("claim_id").alias("destination_claim"), *[F.col(f).alias(f"d_{f}") for f in fields])
    counts = rows.groupBy("comparison_id").agg(
        F.count_if(F.col("bucket") == "retained_nonzero").alias("matched_sign_retained"),
        F.count_if(F.col("bucket") == "flipped_nonzero").alias("matched_sign_flipped"),
        F.count_if(F.col("bucket") == "any_zero").alias("transitions_via_zero"),
        F.count_if("sign_retained").alias("state_retained"), F.count(F.lit(1)).alias("n_groups"))
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    none = (F.col("s_ci_support") == "NO_INTERVAL_DEFINED") | (F.col("d_ci_support") == "NO_INTERVAL_DEFINED")
    out = pairs.join(s, "source_claim").join(d, "destination_claim").join(counts, "comparison_id")
    return out.select(
        "comparison_id", "source_claim", "destination_claim",
        yes(F.col("s_mean_direction") == F.col("d_mean_direction")).alias("mean_direction_retained"),
        F.when(none, "NOT APPLICABLE").otherwise(yes(F.col("s_ci_support") == F.col("d_ci_support"))).alias("ci_support_retained"),
        yes(F.col("s_majority_polarity") == F.col("d_majority_polarity")).alias("majority_direction_retained"),
        yes(F.col("s_majority") == F.col("d_majority")).alias("majority_category_retained"),
        "matched_sign_retained", "matched_sign_flipped", "transitions_via_zero", "state_retained", "n_groups",
        (F.col("matched_sign_retained") / F.col("n_groups")).alias("retained_sign_share"),
        F.array_contains(F.array(F.lit("POSITIVENEGATIVE"), F.lit("NEGATIVEPOSITIVE")), F.concat("s_mean_direction", "d_mean_direction")).alias("direction_reversed"))


def resisting_groups(retention: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups that keep a nonzero sign while the population direction reverses."""
    reversed_ = retention.where("direction_reversed").select("comparison_id")
    return rows.where("bucket = 'retained_nonzero'").join(reversed_, "comparison_id", "left_semi").select("comparison_id", GROUP, "source_sign")


# ------------------------------------------------------------------ I6..I9
def contrasts(metrics: DataFrame, value: str, full: str = "Full", base: str = "C0", mean: str = "Cmean", by: Sequence[str] = ()) -> DataFrame:
    """d0 = Full-C0, dm = Full-Cmean, K = C0-Cmean and the same K as dm-d0."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col(value)))
    out = metrics.groupBy(*by, GROUP).agg(pick(full).alias("Full"), pick(base).alias("C0"), pick(mean).alias("Cmean"))
    return out.withColumns({
        "d0": F.expr("Full - C0"), "dm": F.expr("Full - Cmean"), "K": F.expr("C0 - Cmean")}).withColumn("K_check", F.expr("dm - d0"))


def flip_orientation(df: DataFrame, cols: Sequence[str] = ("mean",), low: str = "lower", high: str = "upper") -> DataFrame:
    """Negate means and turn (l, u) into (-u, -l); sign counts change places."""
    made = {c: -F.col(c) for c in cols} | {low: -F.col(high), high: -F.col(low)}
    if {"positive_groups", "negative_groups"} <= set(df.columns):
        made |= {"positive_groups": F.col("negative_groups"), "negative_groups": F.col("positive_groups")}
    if "support" in df.columns:
        made["support"] = F.when(F.col("support") == "positive", "negative").when(F.col("support") == "negative", "positive").otherwise(F.col("support"))
    return df.withColumns(made)


def support(df: DataFrame, low: str = "lower", high: str = "upper") -> DataFrame:
    return df.withColumn("support", X.support(low, high)).withColumn("ci_support", X.support_category(low, high)).withColumn(
        "verdict", X.verdict(low, high))


def classify_construction(df: DataFrame) -> DataFrame:
    """Label from two contrasts' direction, support and majority and K's support.

    Columns: d0_mean, d0_support, d0_polarity, dm_mean, dm_support, dm_polarity,
    k_support.
    """
    kept = (
        (X.sign_code("d0_mean") == X.sign_code("dm_mean")) & (F.col("d0_support") == F.col("dm_support"))
        & (F.col("d0_polarity") == F.col("dm_polarity")))
    return df.withColumn("classification", F.when(~kept, "construction-sensitive").when(
        F.col("k_support") != "includes_zero", "magnitude-sensitive").otherwise("construction-robust"))


# ------------------------------------------------------------------ I11..I14
def construction_difference(thetas: DataFrame, fixed: str = "fixed_amplitude", equal: str = "equal_total_dose") -> DataFrame:
    """Theta_equal - Theta_fixed per group, and the terms of its five identities."""
    cols = ("A_Full_T", "A_Full_S", "A_C0_T", "A_C0_S", "D_S", "D_T", "Theta")
    f = thetas.where(F.col("view") == fixed).select(GROUP, *[F.col(c).alias(f"{c}_fixed") for c in cols])
    e = thetas.where(F.col("view") == equal).select(GROUP, *[F.col(c).alias(f"{c}_equal") for c in cols])
    return _paired(f, e, [GROUP]).withColumns({
        "delta": F.expr("Theta_equal - Theta_fixed"),
        "identity_2": F.expr("(D_S_equal - D_T_equal) - (D_S_fixed - D_T_fixed)"),
        "identity_3": F.expr("D_T_equal - D_T_fixed"),
        "identity_4": F.expr("D_S_equal - D_S_fixed"),
        "identity_5": F.expr("(A_Full_S_equal - A_C0_S_equal) - (A_Full_S_fixed - A_C0_S_fixed)")})


def identity_errors(diff: DataFrame) -> DataFrame:
    gaps = {"identity_2": F.expr("identity_2 - delta"), "identity_3": F.col("identity_3"),
            "identity_4": F.expr("identity_4 - delta"), "identity_5": F.expr("identity_5 - delta")}
    one = diff.agg(*[F.max(F.abs(g)).alias(n) for n, g in gaps.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("identity"), F.col(n).alias("max_abs_error")) for n in gaps])))


def updater_difference(first: DataFrame, second: DataFrame, by: Sequence[str] = ("component",), value: str = "value") -> DataFrame:
    """Second updater's contrast minus the first's, and whether the signs agree."""
    j = _paired(first.select(*by, GROUP, F.col(value).alias("first")), second.select(*by, GROUP, F.col(value).alias("second")), [*by, GROUP])
    return j.withColumn("difference", F.col("second") - F.col("first")).withColumn(
        "same_sign", X.sign_code("first") == X.sign_code("second"))


def estimate_table(long: DataFrame, by: Sequence[str] = ("endpoint_id",), value: str = "value") -> DataFrame:
    """n, mean and whether an interval can be given, with the reason if not."""
    d = long.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("estimate"), (F.max(value) - F.min(value)).alias("_span"))
    reason = F.when(F.col("n") < 2, "FEWER_THAN_TWO_GROUPS").when(F.col("_span") == 0, "NO_VARIATION")
    return d.withColumn("reason", reason).withColumn(
        "interval_status", F.when(reason.isNull(), "AVAILABLE").otherwise("NOT_AVAILABLE")).drop("_span")
