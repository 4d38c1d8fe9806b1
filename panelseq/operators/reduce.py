"""From branch ledgers to one value per group: equal-weight means, views, contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED
from panelseq.operators import blocks as B

CELLS = ("controller", "construction", "shape")
VIEWS = ("fixed_amplitude", "dose_normalized", "equal_total_dose")


def reduce_ledger(ledger: DataFrame, value: str = "A", cells: Sequence[str] = CELLS) -> DataFrame:
    """Mean over signs, seeds, roots, recordings, in that order, with equal weights.

    Rows are spread by root once; the sign and seed means then need no further
    shuffle, and the last two levels combine map-side.
    """
    spread = ledger.where(F.col(value).isNotNull()).repartition(GROUP, RECORDING, "t0")
    by_root = [GROUP, RECORDING, "t0", *cells]
    signs = spread.groupBy(*by_root, SEED).agg(F.avg(value).alias(value))
    seeds = signs.groupBy(*by_root).agg(F.avg(value).alias(value))
    recordings = seeds.groupBy(GROUP, RECORDING, *cells).agg(F.avg(value).alias(value))
    return recordings.groupBy(GROUP, *cells).agg(F.avg(value).alias(value))


def make_view(cells: DataFrame, view: str, duration: int, value: str = "A") -> DataFrame:
    """Dose view of a ledger or of its cells: the reducer is linear, so cells suffice."""
    sustained = "equal_sustained" if view == "equal_total_dose" else "fixed_sustained"
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}")
    out = cells.where(F.col("construction").isin("fixed_transient", sustained))
    if view == "dose_normalized":
        out = out.withColumn(value, F.when(F.col("shape") == "sustained", F.col(value) / duration).otherwise(F.col(value)))
    return out.withColumn("view", F.lit(view))


def all_views(cells: DataFrame, duration: int) -> DataFrame:
    out = make_view(cells, VIEWS[0], duration)
    for v in VIEWS[1:]:
        out = out.unionByName(make_view(cells, v, duration))
    return out


def theta(cells: DataFrame, by: Sequence[str] = ("view",), full: str = "Full", base: str = "C0") -> DataFrame:
    """Cells, differences and the interaction Theta per group, two ways."""
    def cell(c: str, s: str):
        return F.max(F.when((F.col("controller") == c) & (F.col("shape") == s), F.col("A")))

    out = cells.groupBy(*by, GROUP).agg(
        cell(full, "transient").alias("A_Full_T"), cell(full, "sustained").alias("A_Full_S"),
        cell(base, "transient").alias("A_C0_T"), cell(base, "sustained").alias("A_C0_S"))
    out = out.withColumns({
        "Delta_Full": F.expr("A_Full_S - A_Full_T"), "Delta_C0": F.expr("A_C0_S - A_C0_T"),
        "D_S": F.expr("A_Full_S - A_C0_S"), "D_T": F.expr("A_Full_T - A_C0_T")})
    return out.withColumns({"Theta": F.expr("Delta_Full - Delta_C0"), "Theta_from_method": F.expr("D_S - D_T")})


def sign_diagnostics(ledger: DataFrame, cells: Sequence[str] = ("controller", "construction")) -> tuple[DataFrame, DataFrame]:
    """Per group: sign branches and asymmetry. Per cell: root-level quantiles and minima."""
    branch = ledger.groupBy(GROUP, RECORDING, "t0", *cells, "sign").agg(F.avg("A").alias("A"))
    per_rec = branch.groupBy(GROUP, RECORDING, *cells, "sign").agg(F.avg("A").alias("A"))
    per_group = per_rec.groupBy(GROUP, *cells, "sign").agg(F.avg("A").alias("A"))

    def split(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.max(F.when(F.col("sign") == -1, F.col("A"))).alias("A_minus"), F.max(F.when(F.col("sign") == 1, F.col("A"))).alias("A_plus"))

    asym = F.coalesce(F.try_divide(F.abs(F.col("A_plus") - F.col("A_minus")), (F.col("A_plus") + F.col("A_minus")) / 2), F.lit(0.0))
    groups = split(per_group, [GROUP, *cells]).withColumns({
        "minus_contribution": F.col("A_minus") / 2, "plus_contribution": F.col("A_plus") / 2,
        "A_sign_average": F.col("A_minus") / 2 + F.col("A_plus") / 2, "relative_asymmetry": asym})
    roots = split(branch, [GROUP, RECORDING, "t0", *cells]).withColumn("asymmetry", asym)
    extremes = roots.groupBy(*cells).agg(
        F.max("asymmetry").alias("root_asymmetry_max"), F.min("A_minus").alias("minus_branch_min"), F.min("A_plus").alias("plus_branch_min"))
    q = B.exact_quantiles(roots, cells, "asymmetry", [0.95, 0.99], ["root_asymmetry_q95", "root_asymmetry_q99"])
    top = groups.groupBy(*cells).agg(F.max("relative_asymmetry").alias("group_asymmetry_max"))
    return groups, extremes.join(q, list(cells)).join(top, list(cells))


def component_areas(cells: DataFrame) -> DataFrame:
    """Mean area per updater, view and shape over groups."""
    return cells.groupBy(F.col("controller").alias("updater"), "view", "shape").agg(
        F.avg("A").alias("area"), F.count(F.lit(1)).alias("N"))


def component_contrasts(cells: DataFrame, updater: str, base: str, duration: int) -> DataFrame:
    """Updater minus base areas and their combinations, one row per group."""
    def cell(c: str, construction: str):
        return F.max(F.when((F.col("controller") == c) & (F.col("construction") == construction), F.col("A")))

    out = cells.groupBy(GROUP).agg(*[
        (cell(updater, k) - cell(base, k)).alias(n)
        for n, k in (("T", "fixed_transient"), ("S", "fixed_sustained"), ("E", "equal_sustained"))])
    return out.withColumns({
        "Theta_fixed": F.expr("S - T"), "Theta_dose": F.expr(f"S / {duration} - T"), "Theta_equal": F.expr("E - T"),
        "D": F.expr("E - S"), "R": F.expr(f"E - S / {duration}")})
