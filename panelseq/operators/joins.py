"""Equi joins with checked keys, difference sets, fan-out and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import SEQUENCE, TIME
from panelseq.operators import blocks as B


def _unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """One row per key; a repeated key raises in the task that meets it."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(c) for c in rest]) if rest else F.lit(1)).alias("_row")
    )
    ok = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"repeated key on the {side} side")))
    cols = [F.col(f"_row.{c}").alias(c) for c in rest]
    return packed.withColumn("_row", ok).select(*keys, *cols)


def merge_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on full keys; both sides must hold each key at most once.

    The uniqueness pass shuffles by the join keys, so the join adds no shuffle.
    """
    return _unique(a, keys, "left").join(_unique(b, keys, "right"), list(keys), how)


def paired_diff(metrics: DataFrame, group: str, method: str, value: str, first: str, second: str) -> DataFrame:
    """Metric of two methods per group and their difference, in one shuffle."""
    pick = {n: F.max(F.when(F.col(method) == n, F.col(value))) for n in (first, second)}
    return metrics.where(F.col(method).isin(first, second)).groupBy(group).agg(
        pick[first].alias("first"), pick[second].alias("second")
    ).withColumn("difference", F.col("first") - F.col("second"))


def shift_join(panel: DataFrame, lags: Sequence[int], pred: str, keys: Sequence[str] = SEQUENCE, t: str = TIME, chunk: int = B.CHUNK) -> DataFrame:
    """Prediction at t+lag next to the row at t: columns ``<pred>_lag<lag>``."""
    w = B.chunk_window(keys, t)
    base = B.with_halo(panel, t, before=max(0, -min(lags)), after=max(0, max(lags)), chunk=chunk)
    cols = {f"{pred}_lag{'m' if g < 0 else ''}{abs(g)}": F.lead(pred, g).over(w) if g >= 0 else F.lag(pred, -g).over(w) for g in lags}
    return B.drop_halo(base.withColumns(cols))


def slice_roots(roots: DataFrame, panel: DataFrame, horizon: int, keys: Sequence[str], t0: str = "t0", t: str = TIME) -> DataFrame:
    """Rows t0..t0+horizon-1 of each root's recording: one join on (keys, block of ``horizon`` steps).

    A slice lies in the block of its root and the next one, so a root travels twice, whatever the horizon. The side that
    is multiplied is never broadcast: its size before that says little.
    """
    here = F.expr(f"`{t0}` div {horizon}")
    spread = roots.withColumn("_block", F.explode(F.array(here, here + 1))).hint("merge")
    rows = panel.withColumn("_block", F.expr(f"`{t}` div {horizon}"))
    offset = F.col(t) - F.col(t0)
    rest = [c for c in panel.columns if c not in (*keys, t)]
    met = spread.join(rows, [*keys, "_block"]).where((offset >= 0) & (offset < horizon))
    kept = [c for c in roots.columns if c not in keys]
    return met.select(*keys, t, *kept, offset.cast("int").alias("offset"), *rest)


def missing_extra(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only expected (missing) or only observed (extra)."""
    o, e = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    both = (
        o.withColumn("_side", F.lit(1)).unionByName(e.withColumn("_side", F.lit(2)))
        .groupBy(*keys).agg(F.sum("_side").alias("_sides"))
    )
    return both.where("_sides <> 3").select(
        *keys, F.when(F.col("_sides") == 1, "extra").otherwise("missing").alias("kind")
    )


def fanout(df: DataFrame, **dims: Sequence) -> DataFrame:
    """Every row once per combination of small literal lists."""
    out = df
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])))
    return out
