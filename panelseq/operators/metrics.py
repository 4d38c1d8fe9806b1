"""Error, smoothness and lag metrics, candidate summaries, gain-grid objective."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq import GROUP, SEED, SEQUENCE, TIME
from panelseq.functions import expr as X
from panelseq.operators import blocks as B
from panelseq.operators.updaters import affine_scan, gains_at, unit_interval, within
from panelseq.session import cut


def rmse(traj: DataFrame, method: str, target: str = "target", extra: Sequence[str] = ()) -> DataFrame:
    """Pooled over a group's recordings within a seed, then the mean over seeds."""
    per_seed = traj.groupBy(*extra, GROUP, SEED).agg(
        F.sqrt(F.avg((F.col(target) - F.col(method)) * (F.col(target) - F.col(method)))).alias("_r")
    )
    return per_seed.groupBy(*extra, GROUP).agg(F.avg("_r").alias("rmse"))


def mafd(traj: DataFrame, method: str, extra: Sequence[str] = (), chunk: int = B.CHUNK) -> DataFrame:
    """Mean absolute first difference: median over recordings, then over seeds."""
    keys = [*extra, *SEQUENCE]

    def build(rows):
        return {"_step": F.abs(F.col(method) - F.lag(method).over(rows()))}

    moved = B.trailing(traj.select(*keys, TIME, method), keys, build, before=1, chunk=chunk)
    per_rec = moved.groupBy(*keys).agg(F.avg("_step").alias("_m"))
    return _median_chain(per_rec, extra, "_m", "mafd")


def _median_chain(per_rec: DataFrame, extra: Sequence[str], value: str, name: str) -> DataFrame:
    """Median over recordings (any number), then over the few seeds."""
    per_seed = B.exact_median(per_rec, [*extra, GROUP, SEED], value, "_v")
    return per_seed.groupBy(*extra, GROUP).agg(F.percentile("_v", F.lit(0.5)).alias(name))


def xcorr_lag(
    traj: DataFrame, method: str, max_lag: int, target: str = "target", tolerance: float = 1e-6,
    keys: Sequence[str] = SEQUENCE, t: str = TIME, chunk: int = B.CHUNK,
) -> DataFrame:
    """Lag of the highest correlation of target(t) with prediction(t+lag).

    Ties go to the smaller absolute, then the smaller lag. Lags within
    ``tolerance`` of the best form runs; several runs make the lag ambiguous.
    A constant sequence has a null lag.
    """
    lags = list(range(-max_lag, max_lag + 1))
    w = B.chunk_window(keys, t)
    base = B.with_halo(traj.select(*keys, t, target, method), t, before=max_lag, after=max_lag, chunk=chunk)
    shifted = {f"_s{i}": F.lag(method, -g).over(w) for i, g in enumerate(lags)}
    rows = B.drop_halo(base.withColumns(shifted))
    per = rows.groupBy(*keys).agg(*[X.corr(target, f"_s{i}").alias(f"_c{i}") for i in range(len(lags))])
    pairs = F.array(*[
        F.struct(F.when(F.isnan(f"_c{i}"), None).otherwise(F.col(f"_c{i}")).alias("c"), F.lit(-abs(g)).alias("near"),
                 F.lit(-g).alias("low"), F.lit(g).alias("lag"))
        for i, g in enumerate(lags)
    ])
    out = per.withColumn("_p", pairs).withColumn("_best", F.array_max(F.filter("_p", lambda p: p["c"].isNotNull())))
    marks = F.concat_ws("", F.transform("_p", lambda p: F.when(p["c"] >= F.col("_best.c") - tolerance, "1").otherwise("0")))
    runs = F.transform(F.filter(F.split(marks, "0+"), lambda x: x != ""), lambda x: F.length(x))
    return out.select(
        *keys, F.col("_best.lag").alias("signed_lag"), F.abs(F.col("_best.lag")).alias("absolute_lag"),
        F.col("_best.c").alias("max_correlation"),
        (F.abs(F.col("_best.lag")) == max_lag).alias("boundary_hit"),
        F.when(F.col("_best").isNotNull(), F.size(runs) > 1).alias("ambiguous"),
        F.when(F.col("_best").isNotNull(), runs).alias("peak_widths"),
    )


def lag_metric(lags: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Absolute lag: null lags dropped, median over recordings, then over seeds."""
    per = lags.select(*extra, *SEQUENCE, F.col("absolute_lag").cast("double").alias("_l"))
    return _median_chain(per, extra, "_l", "absolute_lag")


def error_metrics(traj: DataFrame, method: str, by: Sequence[str], target: str = "target", baseline: str | None = None) -> DataFrame:
    """RMSE, MAE, PCC and CCC per key; with a baseline also its deltas."""
    y, p = F.col(target), F.col(method)

    def ccc(c):
        gap = F.avg(y) - F.avg(c)
        return F.try_divide(2 * F.covar_pop(y, c), F.var_pop(y) + F.var_pop(c) + gap * gap)

    aggs = [
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        X.corr(y, p).alias("pcc"), ccc(p).alias("ccc"),
    ]
    if baseline:
        b = F.col(baseline)
        aggs += [F.sqrt(F.avg((y - b) * (y - b))).alias("_base_rmse"), ccc(b).alias("_base_ccc")]
    out = traj.groupBy(*by).agg(*aggs)
    if baseline:
        out = out.withColumn("rmse_delta", F.col("rmse") - F.col("_base_rmse")).withColumn(
            "ccc_gain", F.col("ccc") - F.col("_base_ccc")).drop("_base_rmse", "_base_ccc")
    return out


def max_seed_delta(per_seed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_seed.groupBy(*by).agg(F.max("rmse_delta").alias("max_seed_rmse_delta"))


def subject_metrics(traj: DataFrame, method: str, max_lag: int, extra: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAFD and absolute lag per group (and per extra key)."""
    keys = [*extra, GROUP]
    lags = xcorr_lag(traj, method, max_lag, keys=[*extra, *SEQUENCE])
    return rmse(traj, method, extra=extra).join(mafd(traj, method, extra), keys).join(lag_metric(lags, extra), keys, "left")


def _lag_of(y: np.ndarray, states: np.ndarray, unit: np.ndarray, units: int, max_lag: int) -> np.ndarray:
    """Absolute lag of the highest correlation of y(t) with each state(t+lag), a row a unit; NaN where no lag has a correlation."""
    best, lag = np.full((units, states.shape[1]), -np.inf), np.full((units, states.shape[1]), np.nan)
    known = ~np.isnan(y)
    for g in sorted(range(-max_lag, max_lag + 1), key=lambda g: (abs(g), g)):
        at = np.arange(max(0, -g), min(len(y), len(y) - g))
        at = at[(unit[at] == unit[at + g]) & known[at]]
        if not len(at):
            continue
        first = np.flatnonzero(np.append(True, unit[at[1:]] != unit[at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        part = np.repeat(np.arange(len(first)), count)

        def spread(x, first=first, count=count, part=part):
            # From the first value on, so that a side that does not vary is zero throughout.
            x = x - x[first][part]
            return x - (np.add.reduceat(x, first) / count[:, None])[part]

        a, b = spread(y[at][:, None]), spread(states[at + g])
        below = np.sqrt(np.add.reduceat(a * a, first)) * np.sqrt(np.add.reduceat(b * b, first))
        c = np.where(below > 0, np.add.reduceat(a * b, first) / np.where(below > 0, below, 1.0), -np.inf)
        u = unit[at[first]]
        more = c > best[u]
        best[u], lag[u] = np.where(more, c, best[u]), np.where(more, float(abs(g)), lag[u])
    return lag


def candidate_recordings(
    panel: DataFrame, emas: Sequence[float], kalmans: Sequence[tuple[float, float]], max_lag: int, target: str = "target",
    p0: float = 1.0, epsilon: float = 1e-12,
) -> DataFrame:
    """A row a sequence and candidate with its rows, squared error, mean absolute first difference and absolute lag.

    ``place`` counts the EMAs, then the (q, r) of the fixed Kalman filters. All candidates step through a sequence at once
    in the task that has it, and no state leaves it, so sequences have to fit a task.
    """
    width = len(emas) + len(kalmans)

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        x, y, at = B.floats(table, "fast"), B.floats(table, target), B.ints(table, TIME)
        steps = np.arange(int(at.max()) + 1) if n else np.zeros(0, np.int64)
        gains = np.empty((len(steps), width))
        gains[:, : len(emas)] = np.asarray(emas, dtype=np.float64)
        for k, (q, r) in enumerate(kalmans):
            gains[1:, len(emas) + k] = gains_at(q, r, p0, epsilon, steps[:-1])[0]
        gains[:1] = 1.0
        states = np.empty((n, width))
        for s, rows, live in B.steps(starts, n):
            gain = gains[at[rows]]
            before = states[rows - 1] if s else 0.0
            states[rows] = gain * x[rows][:, None] + (1.0 - gain) * before
        lengths = np.diff(np.append(starts, n))
        unit = np.repeat(np.arange(len(starts)), lengths)
        known = ~np.isnan(y)
        e = np.where(known, y, 0.0)[:, None] - states
        sse = np.add.reduceat(np.where(known[:, None], e * e, 0.0), starts)
        moved = np.zeros_like(states)
        moved[1:] = np.abs(states[1:] - states[:-1])
        moved[starts] = 0.0
        mafd = np.where(lengths[:, None] > 1, np.add.reduceat(moved, starts) / np.maximum(lengths - 1, 1)[:, None], np.nan)
        lag = _lag_of(y, states, unit, len(starts), max_lag)
        head = table.select(list(SEQUENCE)).take(pa.array(np.repeat(starts, width)))
        cols = {"place": np.tile(np.arange(width, dtype=np.int32), len(starts)), "rows": np.repeat(np.add.reduceat(known.astype(np.int64), starts), width)}
        out = B.extend(head, list(SEQUENCE), cols).append_column("sse", pa.array(sse.ravel()))
        return out.append_column("mafd", pa.array(mafd.ravel(), from_pandas=True)).append_column("absolute_lag", pa.array(lag.ravel(), from_pandas=True))

    src = panel.select(*SEQUENCE, TIME, unit_interval("fast").alias("fast"), target)
    fields = "place int, rows long, sse double, mafd double, absolute_lag double"
    return B.map_units(src, list(SEQUENCE), [TIME], kernel, B.schema_of(src, list(SEQUENCE), fields))


def recording_metrics(rows: DataFrame, extra: Sequence[str]) -> DataFrame:
    """``subject_metrics`` from the rows of ``candidate_recordings``."""
    keys = [*extra, GROUP]
    per_seed = rows.groupBy(*keys, SEED).agg(F.sqrt(F.sum("sse") / F.nullif(F.sum("rows"), F.lit(0))).alias("_r"))
    error = per_seed.groupBy(*keys).agg(F.avg("_r").alias("rmse"))
    return error.join(_median_chain(rows, extra, "mafd", "mafd"), keys).join(lag_metric(rows, extra), keys, "left")


def summarize_candidates(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Over groups: mean RMSE, its standard error, median lag and MAFD."""
    base = metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("group_count"), F.avg("rmse").alias("mean_rmse"),
        (F.stddev_samp("rmse") / F.sqrt(F.count(F.lit(1)))).alias("rmse_se"),
    )
    lag = B.exact_median(metrics, by, "absolute_lag", "median_absolute_lag")
    moved = B.exact_median(metrics, by, "mafd", "median_mafd")
    return base.join(lag, list(by), "left").join(moved, list(by), "left")


def ensemble_mean(preds: DataFrame, keys: Sequence[str], pred: str = "prediction") -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(pred).alias(pred), F.count(F.lit(1)).alias("members"))


def _fold_groups(width: int):
    """Rows come by (group, seed): squared errors are added up by seed, and a group leaves as one row of mean RMSEs."""

    def done(group, seed, n, e2):
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        means = np.add.reduceat(np.sqrt(e2 / n[:, None]), at) / np.diff(np.append(at, len(group)))[:, None]
        offsets = pa.array(np.arange(0, means.size + 1, width, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(group[at]), pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))], [GROUP, "rmse"])

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows == 0:
                continue
            e2 = b.column("e2")
            new = (b.column(GROUP).to_numpy(), b.column(SEED).to_numpy(), b.column("n").to_numpy().astype(np.float64), e2.flatten().to_numpy().reshape(-1, width))
            group, seed, n, e2 = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (seed[1:] != seed[:-1])))
            group, seed, n, e2 = group[at], seed[at], np.add.reduceat(n, at), np.add.reduceat(e2, at)
            last = int(np.argmax(group == group[-1]))
            if last:
                yield done(group[:last], seed[:last], n[:last], e2[:last])
            held = (group[last:], seed[last:], n[last:], e2[last:])
        if held is not None:
            yield done(*held)

    return run


def _gain_rows_short(src: DataFrame, grid: np.ndarray, target: str) -> DataFrame:
    """(group, rmse array) of groups whose sequences are one chunk each: a group's rows meet in one task, which holds sums only."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        fast, slow, y, at = B.floats(table, "fast"), B.floats(table, "slow"), B.floats(table, target), B.ints(table, TIME)
        first, lengths = B.unit_layout(starts, n)
        state = np.where(at[first] == 0, slow[first], 0.0)[:, None] * np.ones_like(grid)[None, :]
        e2 = np.zeros_like(state)
        for _, rows, live in B.steps(starts, n):
            state[:live] = np.clip(grid * fast[rows][:, None] + (1.0 - grid) * state[:live], 0.0, 1.0)
            e = y[rows][:, None] - state[:live]
            e2[:live] += e * e
        back = np.argsort(first, kind="stable")
        head = table.select([GROUP, SEED]).take(pa.array(first[back]))
        offsets = pa.array(np.arange(0, e2.size + 1, len(grid), dtype=np.int32))
        return head.append_column("n", pa.array(lengths[back])).append_column("e2", pa.ListArray.from_arrays(offsets, pa.array(e2[back].ravel())))

    rows_held = max(1000, min(B.FLUSH_ROWS, 4_000_000 // max(1, len(grid))))
    schema = B.schema_of(src, [GROUP], "rmse array<double>")
    return B.map_units(src, list(SEQUENCE), [TIME], kernel, schema, flush_rows=rows_held, together=[GROUP], then=_fold_groups(len(grid)))


def _gain_rows_long(src: DataFrame, grid: np.ndarray, length: int, target: str, chunk: int) -> DataFrame:
    """The same of groups with longer sequences, from partial sums of their chunks."""
    unit = [*SEQUENCE, "_chunk"]
    src = src.withColumn("_chunk", F.expr(f"`{TIME}` div {chunk}"))
    fields = "gain_index int, n long, e2 double, ep double, p2 double, end_state double, end_carry double"

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        fast, slow, y, at = B.floats(table, "fast"), B.floats(table, "slow"), B.floats(table, target), B.ints(table, TIME)
        first, lengths = B.unit_layout(starts, n)
        opening = (at[first] == 0)[:, None]
        state = np.where(opening, slow[first][:, None], 0.0) * np.ones_like(grid)[None, :]
        carry = np.where(opening, 0.0, 1.0) * np.ones_like(grid)[None, :]
        sums = {k: np.zeros_like(state) for k in ("e2", "ep", "p2")}
        for _, rows, live in B.steps(starts, n):
            state[:live] = np.clip(grid * fast[rows][:, None] + (1.0 - grid) * state[:live], 0.0, 1.0)
            carry[:live] *= 1.0 - grid
            e = y[rows][:, None] - state[:live]
            sums["e2"][:live] += e * e
            sums["ep"][:live] += e * carry[:live]
            sums["p2"][:live] += carry[:live] * carry[:live]
        g = len(grid)
        head = table.select(unit).take(pa.array(np.repeat(first, g)))
        cols = {
            "gain_index": np.tile(np.arange(g, dtype=np.int32), len(first)), "n": np.repeat(lengths, g),
            "e2": sums["e2"].ravel(), "ep": sums["ep"].ravel(), "p2": sums["p2"].ravel(),
            "end_state": state.ravel(), "end_carry": carry.ravel(),
        }
        return B.extend(head, unit, cols)

    rows_held = max(1000, min(B.FLUSH_ROWS, 4_000_000 // max(1, len(grid))))
    parts = B.map_units(src, unit, [TIME], kernel, B.schema_of(src, unit, fields), flush_rows=rows_held)
    parts = cut(parts)
    ends = parts.withColumnRenamed("_chunk", "block")
    start = affine_scan(
        ends, [*SEQUENCE, "gain_index"], "block", F.col("end_carry"), F.col("end_state"), F.lit(0.0),
        -(-length // chunk),
    ).select(*SEQUENCE, "gain_index", (F.col("block") + 1).alias("_chunk"), F.col("state").alias("_s"))
    joined = parts.join(start, [*unit, "gain_index"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    sse = joined.withColumn("_sse", F.expr("e2 - 2 * _s * ep + _s * _s * p2"))
    per_seed = sse.groupBy(GROUP, SEED, "gain_index").agg(F.sqrt(F.sum("_sse") / F.sum("n")).alias("_r"))
    per_group = per_seed.groupBy(GROUP, "gain_index").agg(F.avg("_r").alias("rmse"))
    return per_group.groupBy(GROUP).agg(F.array_sort(F.collect_list(F.struct("gain_index", "rmse"))).alias("_v")).select(GROUP, F.col("_v.rmse").alias("rmse"))


def gain_grid_rows(
    panel: DataFrame, gains: Sequence[float], length: int, target: str = "target", chunk: int = B.CHUNK,
) -> DataFrame:
    """(group, rmse): one row a group with an array of the RMSE for every gain, averaged over seeds.

    Groups without a sequence over one chunk are finished in the task that has their rows, so only panel rows travel.
    In others a chunk reports its squared error as a quadratic in the state it starts from, so long sequences need
    only the chunk ends to be solved.
    """
    grid = np.asarray(gains, dtype=np.float64)
    src = within(panel, length).select(*SEQUENCE, TIME, "fast", "slow", target)
    if length <= chunk:
        return _gain_rows_short(src, grid, target)
    long = cut(src.where(F.col(TIME) >= chunk).select(GROUP).distinct())
    short = _gain_rows_short(src.join(long, GROUP, "left_anti"), grid, target)
    return short.unionByName(_gain_rows_long(src.join(long, GROUP, "left_semi"), grid, length, target, chunk))


def gain_grid_objective(
    panel: DataFrame, gains: Sequence[float], length: int, target: str = "target", chunk: int = B.CHUNK,
) -> DataFrame:
    """RMSE per group for every gain, one row each; see ``gain_grid_rows``."""
    values = F.array(*[F.lit(float(v)) for v in gains])
    rows = gain_grid_rows(panel, gains, length, target, chunk).select(GROUP, F.posexplode("rmse").alias("gain_index", "rmse"))
    return rows.withColumn("alpha", F.element_at(values, F.col("gain_index") + 1))
