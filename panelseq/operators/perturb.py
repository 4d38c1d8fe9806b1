"""Start points (roots), perturbed replays and response ledgers.

A root needs only the rows around it: its history for the tracker context, the
clean state just before it, and the horizon after it. Replays are therefore cut
into time chunks with a halo on both sides and never read a whole sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, SEQUENCE, TIME
from panelseq.functions import expr as X
from panelseq.operators import blocks as B
from panelseq.operators import updaters as U
from panelseq.operators.joins import slice_roots

ROOT = (GROUP, RECORDING, "t0")
SIGNS = (-1, 1)
REASON = "BOTH_SIGN_NO_CLIPPING_HEADROOM_FAILED"
MISSING_SEED = "ROOT_MISSING_IN_A_SEED"


@dataclass(frozen=True)
class Branch:
    construction: str
    shape: str
    amplitude: float
    duration: int


def standard_branches(delta: float, sustained: int) -> tuple[Branch, ...]:
    """Fixed-amplitude transient and sustained, and the equal-dose sustained branch."""
    return (
        Branch("fixed_transient", "transient", delta, 1),
        Branch("fixed_sustained", "sustained", delta, sustained),
        Branch("equal_sustained", "sustained", delta / sustained, sustained),
    )


# ------------------------------------------------------------------ eligibility
def root_table(
    panel: DataFrame, sustained: int, horizon: int, t0_min: int, t0_max: int | None = None, delta: float = 0.05,
    seeds: int | None = None, fast: str = "fast", chunk: int = B.CHUNK,
) -> DataFrame:
    """All structural roots with ``eligible`` and the per-seed violations.

    Both bounds are inclusive, overlaps are allowed, and one failing seed excludes
    the root for all. A root that some seeds lack is excluded too, with that reason;
    without ``seeds`` the number expected is that of the recording. A null or
    non-finite input fails like one outside the bounds. Rows are spread once by
    (group, recording, chunk), which serves the windows and the aggregation.
    """
    src = panel.select(*SEQUENCE, TIME, fast)
    halo = B.with_halo(src, TIME, after=max(sustained, horizon), chunk=chunk).repartition(GROUP, RECORDING, "_chunk")
    w = B.chunk_window(SEQUENCE, TIME)
    ahead = w.rowsBetween(0, sustained - 1)
    bad = X.nonfinite(fast) | (F.col(fast) < delta) | (F.col(fast) > 1.0 - delta)
    t0 = F.col(TIME)
    span = F.lead(TIME, horizon - 1).over(w).isNotNull()
    tried = halo.withColumns({
        "_bad": F.collect_list(F.when(bad, t0)).over(ahead), "_lo": F.min(fast).over(ahead), "_hi": F.max(fast).over(ahead),
        "_span": span,
    }).where(F.col("_home") & F.col("_span") & (t0 >= t0_min))
    if t0_max is not None:
        tried = tried.where(t0 <= t0_max)
    failure = F.when(F.size("_bad") > 0, F.struct(
        F.col(SEED).alias("seed"), F.transform("_bad", lambda x: (x - t0).cast("int")).alias("offsets"),
        F.col("_lo").alias("minimum"), F.col("_hi").alias("maximum"), F.lit(REASON).alias("reason")))
    per = tried.groupBy(GROUP, RECORDING, "_chunk", t0.alias("t0")).agg(
        F.array_sort(F.collect_list(failure)).alias("_failed"), F.count(F.lit(1)).alias("_seeds"))
    if seeds is None:
        per = per.join(src.groupBy(GROUP, RECORDING).agg(F.count_distinct(SEED).alias("_all")), [GROUP, RECORDING])
    else:
        per = per.withColumn("_all", F.lit(seeds))
    gap = F.array(F.struct(
        F.lit(None).cast(src.schema[SEED].dataType).alias("seed"), F.array().cast("array<int>").alias("offsets"),
        F.lit(None).cast("double").alias("minimum"), F.lit(None).cast("double").alias("maximum"), F.lit(MISSING_SEED).alias("reason")))
    found = F.when(F.col("_seeds") < F.col("_all"), F.concat("_failed", gap)).otherwise(F.col("_failed"))
    return per.withColumn("violations", found).select(*ROOT, (F.size("violations") == 0).alias("eligible"), "violations")


def eligible_roots(roots: DataFrame) -> DataFrame:
    return roots.where("eligible").select(*ROOT)


def excluded_roots(roots: DataFrame) -> DataFrame:
    return roots.where("not eligible").select(*ROOT, "violations")


def root_audit(roots: DataFrame) -> DataFrame:
    """Structural, eligible and excluded counts per recording, group and in total."""
    return roots.rollup(GROUP, RECORDING).agg(
        F.count(F.lit(1)).alias("structural_roots"), F.count_if("eligible").alias("eligible_roots"),
        F.count_if(~F.col("eligible")).alias("excluded_roots"))


def root_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and shared roots per recording, old set against new."""
    sides = old.select(*ROOT, F.lit(1).alias("_s")).unionByName(new.select(*ROOT, F.lit(2).alias("_s")))
    both = sides.distinct().groupBy(*ROOT).agg(F.sum("_s").alias("_s"))
    return both.groupBy(GROUP, RECORDING).agg(
        F.count_if(F.col("_s") == 2).alias("added"), F.count_if(F.col("_s") == 1).alias("removed"),
        F.count_if(F.col("_s") == 3).alias("shared"))


# ------------------------------------------------------------------ perturbed signal
def perturb(panel: DataFrame, roots: DataFrame, branches: Sequence[Branch], horizon: int, fast: str = "fast") -> DataFrame:
    """Perturbed input rows of every root and branch; ``clipped`` marks a violation."""
    spec = F.inline(F.array(*[
        F.struct(F.lit(b.construction).alias("construction"), F.lit(b.shape).alias("shape"), F.lit(s).alias("sign"),
                 F.lit(b.amplitude).alias("amplitude"), F.lit(b.duration).alias("duration"))
        for b in branches for s in SIGNS]))
    rows = slice_roots(roots, panel.select(*SEQUENCE, TIME, fast), horizon, [GROUP, RECORDING])
    out = rows.select(*ROOT, SEED, "offset", fast, spec)
    moved = F.col(fast) + F.when(F.col("offset") < F.col("duration"), F.col("sign") * F.col("amplitude")).otherwise(0.0)
    return out.withColumn("perturbed", moved).withColumn("clipped", (moved < 0) | (moved > 1))


# ------------------------------------------------------------------ controllers
@dataclass(frozen=True)
class Tracker:
    name: str
    config: U.TrackerConfig = U.TrackerConfig()
    state = ("state",)

    @property
    def window(self) -> int:
        return self.config.past_window

    def clean(self, df: DataFrame, length: int, keep: Sequence[str], chunk: int) -> DataFrame:
        out = U.change_aware(df, self.config, length=length, keep=keep, full=False, chunk=chunk)
        return out.withColumnRenamed("state", f"{self.name}_state")

    def start(self, slow0: np.ndarray) -> list[np.ndarray]:
        return [slow0]

    def step(self, state, x, slow, context, step):
        got = U.tracker_step(self.config.__dict__, x, slow, state[0], *context)
        return [got["state"]]


@dataclass(frozen=True)
class ConstantGain:
    name: str
    alpha: float
    state = ("state",)
    window = 0

    def clean(self, df: DataFrame, length: int, keep: Sequence[str], chunk: int) -> DataFrame:
        out = U.constant_gain(df, self.alpha, length=length, keep=keep, chunk=chunk)
        return out.withColumnRenamed("state", f"{self.name}_state")

    def start(self, slow0: np.ndarray) -> list[np.ndarray]:
        return [slow0]

    def step(self, state, x, slow, context, step):
        return [np.clip(self.alpha * x + (1.0 - self.alpha) * state[0], 0.0, 1.0)]


@dataclass(frozen=True)
class AdaptiveKalman:
    name: str
    params: U.KalmanParams = U.KalmanParams()
    state = ("state", "covariance", "r_after")
    window = 0

    def clean(self, df: DataFrame, length: int, keep: Sequence[str], chunk: int) -> DataFrame:
        out = U.kalman_adaptive(df, self.params, length=length, keep=keep, chunk=chunk)
        out = out.drop("gain", "r_used", "step", "innovation")
        for c in self.state:
            out = out.withColumnRenamed(c, f"{self.name}_{c}")
        return out

    def start(self, slow0: np.ndarray) -> list[np.ndarray]:
        r0 = float(np.clip(self.params.r, self.params.r_min, self.params.r_max))
        return [slow0, np.full(len(slow0), self.params.p0), np.full(len(slow0), r0)]

    def step(self, state, x, slow, context, step):
        m, c, r, *_ = U.kalman_step(self.params, x, *state, step)
        return [m, c, r]


def clean_traces(panel: DataFrame, controllers: Sequence, length: int, keep: Sequence[str] = (), chunk: int = B.CHUNK) -> DataFrame:
    """Panel plus the clean state columns of every controller."""
    out, kept = panel, list(keep)
    for c in controllers:
        out = c.clean(out, length, kept, chunk)
        kept += [f"{c.name}_{s}" for s in c.state]
    return out


def replay(
    traces: DataFrame, roots: DataFrame, controllers: Sequence, branches: Sequence[Branch], horizon: int,
    delta0: float = 0.05, late: tuple[int, int] = (15, 20), emit: str = "ledger", chunk: int = B.CHUNK,
    block_cells: int = 4_000_000,
) -> DataFrame:
    """Replay every branch of every root; reduce to A and B_late inside the task.

    ``emit='states'`` returns the perturbed and clean state arrays instead, for
    audits. States before a root equal the clean ones, so a replay starts there.
    """
    k = max([c.window for c in controllers] + [1])
    carried = [f"{c.name}_{s}" for c in controllers for s in c.state]
    marked = traces.select(*SEQUENCE, TIME, "fast", "slow", *carried).join(
        roots.select(GROUP, RECORDING, F.col("t0").alias(TIME), F.lit(True).alias("_root")), [GROUP, RECORDING, TIME], "left")
    halo = B.with_halo(marked, TIME, before=k + 1, after=horizon, chunk=chunk)
    halo = halo.withColumn("_root", F.coalesce("_root", F.lit(False)) & F.col("_home"))
    unit = [*SEQUENCE, "_chunk"]
    plan = [(c, b, s) for c in controllers for b in branches for s in SIGNS]
    lo, hi = late
    if emit == "ledger":
        fields = ", ".join(f"a{i} double, b{i} double" for i in range(len(plan)))
    else:
        fields = ", ".join(f"p{i} array<double>, c{i} array<double>" for i in range(len(plan)))

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))

    def block(data: dict, at: np.ndarray, t0: np.ndarray) -> dict:
        n = len(at)
        ahead = at[:, None] + np.arange(horizon)[None, :]
        fast, slow = data["fast"][ahead], data["slow"][ahead]
        past = data["fast"][np.clip(at[:, None] + np.arange(-k, 0)[None, :], 0, None)]
        past = np.where(t0[:, None] + np.arange(-k, 0)[None, :] >= 0, past, 0.0)
        before = np.clip(at - 1, 0, None)
        out = {}
        for i, (c, b, sign) in enumerate(plan):
            x = fast.copy()
            x[:, : b.duration] += sign * b.amplitude
            if ((x < 0) | (x > 1)).any():
                raise ValueError("a perturbed input leaves [0,1]")
            signal = np.concatenate([past, x], axis=1)
            clean = data[f"{c.name}_{c.state[0]}"][ahead]
            opening = c.start(data["slow"][at])
            state = [np.where(t0 > 0, data[f"{c.name}_{s}"][before], o) for s, o in zip(c.state, opening)]
            area, tail, kept = np.zeros(n), np.zeros(n), np.empty((n, horizon)) if emit != "ledger" else None
            for u in range(horizon):
                context = None
                if c.window:
                    if u < b.duration + c.window:
                        context = U.past_stats(signal[:, k + u - c.window : k + u], np.minimum(t0 + u, c.window))
                    else:
                        context = [data[f"{c.name}_x{j}"][at + u] for j in range(3)]
                state = c.step(state, x[:, u], slow[:, u], context, t0 + u + 1)
                d = state[0] - clean[:, u]
                area += np.abs(d)
                if lo <= u < hi:
                    tail += sign * d
                if kept is not None:
                    kept[:, u] = state[0]
            if emit == "ledger":
                out[f"a{i}"], out[f"b{i}"] = area / delta0, tail / ((hi - lo) * delta0)
            else:
                out[f"p{i}"], out[f"c{i}"] = kept, clean
        return out

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        data = {c: B.floats(table, c) for c in ("fast", "slow", *carried)}
        root = np.asarray(table.column("_root").to_numpy(zero_copy_only=False), dtype=bool)
        pos = U.positions(starts, table.num_rows)
        for c in controllers:
            if c.window:
                stats = U.past_stats(U.windows_before(data["fast"], pos, c.window), np.minimum(pos, c.window))
                data |= {f"{c.name}_x{j}": stats[j] for j in range(3)}
        at = np.flatnonzero(root)
        t0 = B.ints(table, TIME)[at]
        size = max(1, block_cells // (horizon + k))
        parts = [block(data, at[i : i + size], t0[i : i + size]) for i in range(0, len(at), size)] or [
            block(data, at, t0)]
        head = table.select([*SEQUENCE, TIME]).take(pa.array(at))
        for name in parts[0]:
            v = np.concatenate([p[name] for p in parts])
            head = head.append_column(name, pa.array(v) if v.ndim == 1 else lists(v))
        return head

    keep = [*SEQUENCE, TIME]
    wide = B.map_units(halo, unit, [TIME], kernel, B.schema_of(halo, keep, fields))

    def tags(c, b, s) -> list[Column]:
        return [F.lit(s).alias("sign"), F.lit(c.name).alias("controller"), F.lit(b.shape).alias("shape"),
                F.lit(b.construction).alias("construction")]

    if emit == "ledger":
        rows = [
            F.struct(*tags(c, b, s), F.col(f"a{i}").alias("A"),
                     (F.col(f"b{i}") if b.shape == "sustained" else F.lit(None).cast("double")).alias("B_late"))
            for i, (c, b, s) in enumerate(plan)]
    else:
        rows = [
            F.struct(*tags(c, b, s), F.arrays_zip(F.col(f"p{i}").alias("state"), F.col(f"c{i}").alias("clean")).alias("path"))
            for i, (c, b, s) in enumerate(plan)]
    long = wide.select(GROUP, RECORDING, F.col(TIME).alias("t0"), SEED, F.inline(F.array(*rows)))
    if emit == "ledger":
        return long
    out = long.select(*[c for c in long.columns if c != "path"], F.posexplode("path").alias("offset", "_p"))
    return out.select(*[c for c in out.columns if c != "_p"], F.col("_p")["state"].alias("state"), F.col("_p")["clean"].alias("clean"))


# ------------------------------------------------------------------ areas from stored states
LEDGER_KEYS = (GROUP, RECORDING, "t0", SEED, "sign", "controller", "shape", "construction")


def response_area(states: DataFrame, delta0: float, keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    return states.groupBy(*keys).agg((F.sum(F.abs(F.col("state") - F.col("clean"))) / delta0).alias("A"))


def late_response(states: DataFrame, delta0: float, late: tuple[int, int] = (15, 20), keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    lo, hi = late
    inside = (F.col("offset") >= lo) & (F.col("offset") < hi)
    return states.where("shape = 'sustained'").where(inside).groupBy(*keys).agg(
        (F.sum(F.col("sign") * (F.col("state") - F.col("clean"))) / ((hi - lo) * delta0)).alias("B_late"))


def audit_areas(states: DataFrame, ledger: DataFrame, delta0: float, tolerance: float = 1e-10) -> DataFrame:
    """Stored areas against states: errors and boundary points per branch."""
    per = states.groupBy(*LEDGER_KEYS).agg(
        (F.sum(F.abs(F.col("state") - F.col("clean"))) / delta0).alias("_a"),
        F.count_if((F.col("state") == 0) | (F.col("state") == 1)).alias("_edge"))
    j = per.join(ledger.select(*LEDGER_KEYS, "A"), list(LEDGER_KEYS), "full")
    gap = F.abs(F.col("_a") - F.col("A"))
    return j.groupBy("controller", "construction", "sign").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_a").isNull() | F.col("A").isNull()).alias("unpaired"),
        F.count_if(gap > tolerance).alias("differing"), F.sum("_edge").alias("boundary_points"))
