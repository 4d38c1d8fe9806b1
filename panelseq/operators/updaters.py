"""Recursive state estimators (constant gain, EMA, Kalman, change-aware tracker).

Linear updaters with sequences longer than a chunk use an exact two-level affine
scan; nonlinear ones run all chunks at once from warmed-up guesses and rerun the
chunks whose start differs from their predecessor's end until none does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import EPS, SEQUENCE, TIME
from panelseq.functions import expr as X
from panelseq.operators import blocks as B
from panelseq.session import cut, ship

WARMUP = 1024


# ------------------------------------------------------------------ parameters
@dataclass(frozen=True)
class TrackerConfig:
    """Fixed default values of the change-aware tracker."""

    past_window: int = 10
    innovation_scale: float = 0.08
    disagreement_scale: float = 0.08
    slope_scale: float = 0.025
    variance_scale: float = 0.01
    temperature: float = 0.75
    outlier_bias: float = 0.0
    stable_bias: float = 0.0
    transition_bias: float = 0.0
    alpha_outlier: float = 0.04
    alpha_stable: float = 0.20
    alpha_transition: float = 0.75

    def __post_init__(self) -> None:
        problems = tracker_config_problems(asdict(self))
        if problems:
            raise ValueError("; ".join(problems))


# Score weights per state on (innovation, disagreement, slope,
# variance strengths, slope consistency, sign consistency), plus a constant.
SCORE_WEIGHTS = {
    "outlier": (1.6, 1.2, -0.4, 0.5, -1.1, -1.1, 1.1 + 1.1),
    "stable": (-1.5, -1.0, -0.8, -0.8, 0.3, 0.0, 1.5 + 1.0 + 0.8 + 0.8),
    "transition": (1.4, 1.1, 1.0, -0.5, 1.0, 1.2, 0.0),
}
STATES = ("outlier", "stable", "transition")


@dataclass(frozen=True)
class KalmanParams:
    """Fixed default values of the adaptive Kalman updater."""

    q: float = 1e-4
    r: float = 1e-2
    rate: float = 0.05
    r_min: float = 1e-6
    r_max: float = 1.0
    innovation_clip: float = 1.0
    warmup_steps: int = 10
    p0: float = 1.0
    epsilon: float = 1e-12

    def __post_init__(self) -> None:
        if self.q < 0 or self.r <= 0 or self.p0 < 0 or self.epsilon <= 0:
            raise ValueError("variances must not be negative; r and epsilon must be positive")
        if not 0 < self.rate <= 1 or not 0 < self.r_min <= self.r_max:
            raise ValueError("adaptation rate or variance bounds are invalid")
        if self.innovation_clip <= 0 or self.warmup_steps < 0:
            raise ValueError("innovation clip must be positive and warm-up not negative")


def tracker_config_problems(values: dict) -> list[str]:
    out = []
    if values["past_window"] < 3:
        out.append("past_window must be at least 3")
    scales = ("innovation_scale", "disagreement_scale", "slope_scale", "variance_scale", "temperature")
    if not all(np.isfinite(values[s]) and values[s] > 0 for s in scales):
        out.append("scales and temperature must be finite and positive")
    if not 0 <= values["alpha_outlier"] < values["alpha_stable"] < values["alpha_transition"] <= 1:
        out.append("gains must be ordered: outlier < stable < transition")
    return out


def valid_config() -> Column:
    """Predicate on a table with the tracker's parameter columns."""
    scales = ("innovation_scale", "disagreement_scale", "slope_scale", "variance_scale", "temperature")
    ok = F.col("past_window") >= 3
    for s in scales:
        ok = ok & ~X.nonfinite(s) & (F.col(s) > 0)
    return ok & (F.col("alpha_outlier") >= 0) & (F.col("alpha_outlier") < F.col("alpha_stable")) & (
        F.col("alpha_stable") < F.col("alpha_transition")) & (F.col("alpha_transition") <= 1)


# ------------------------------------------------------------------ affine scan
def _affine_kernel(keep, t):
    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        decay, add, first = (B.floats(table, c) for c in ("_decay", "_add", "_first"))
        at = B.ints(table, t)
        state, carry = np.empty(n), np.empty(n)
        prev = np.where(at[starts] == 0, first[starts], 0.0)
        product = np.where(at[starts] == 0, 0.0, 1.0)
        rank = np.argsort(-np.diff(np.append(starts, n)), kind="stable")
        prev, product = prev[rank], product[rank]
        for _, rows, live in B.steps(starts, n):
            d = decay[rows]
            prev[:live] = d * prev[:live] + add[rows]
            product[:live] *= d
            state[rows] = prev[:live]
            carry[rows] = product[:live]
        return B.extend(table, keep, {"state": state, "_carry": carry})

    return kernel


def affine_scan(
    df: DataFrame, keys: Sequence[str], t: str, decay: Column, add: Column, first: Column,
    length: int, chunk: int = B.CHUNK, keep: Sequence[str] = (),
) -> DataFrame:
    """state_t = decay_t * state_(t-1) + add_t, with ``first`` before row 0.

    Chunks are scanned on their own and keep the product of their decays. The
    chunk ends form a shorter recursion of the same shape, solved the same way.
    """
    keep = list(dict.fromkeys([*keys, t, *keep]))
    src = within(df, length, t).select(*keep, decay.alias("_decay"), add.alias("_add"), first.alias("_first")).withColumn(
        "_chunk", F.expr(f"`{t}` div {chunk}")
    )
    unit = [*keys, "_chunk"]
    schema = B.schema_of(src, [*keep, "_chunk"], "state double, _carry double")
    part = B.map_units(src, unit, [t], _affine_kernel([*keep, "_chunk"], t), schema)
    if length <= chunk:
        return part.drop("_chunk", "_carry")
    part = cut(part)
    upper = f"{t}_block"
    ends = part.where(F.expr(f"`{t}` % {chunk} = {chunk - 1}")).select(
        *keys, F.col("_chunk").alias(upper), F.col("_carry"), F.col("state").alias("_end")
    )
    # In chunk 0 the carry is 0, so its end is already the true state.
    joined = affine_scan(
        ends, keys, upper, F.col("_carry"), F.col("_end"), F.lit(0.0), -(-length // chunk), chunk
    ).select(*keys, (F.col(upper) + 1).alias("_chunk"), F.col("state").alias("_before"))
    fixed = part.join(joined, unit, "left").withColumn(
        "state", F.col("state") + F.col("_carry") * F.coalesce("_before", F.lit(0.0))
    )
    return fixed.drop("_chunk", "_carry", "_before")


def _start_value(keys: Sequence[str], df: DataFrame, t: str, value: str) -> DataFrame:
    """Attach the value of row 0; only row 0 needs it, so no join is used."""
    return df.withColumn("_start", F.when(F.col(t) == 0, F.col(value)).otherwise(F.lit(0.0)))


def constant_gain(
    panel: DataFrame, alpha: float | Column, keys: Sequence[str] = SEQUENCE, t: str = TIME,
    fast: str = "fast", slow: str = "slow", length: int | None = None, keep: Sequence[str] = (),
    chunk: int = B.CHUNK,
) -> DataFrame:
    """s_t = a*x_t + (1-a)*s_(t-1), started at slow[0]; adds ``state``.

    Inputs must be finite and in [0,1], where a clip of the state to [0,1] never acts; others raise in the task.
    """
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    length = B.longest(panel, t) if length is None else length
    src = _start_value(keys, panel.withColumns({c: unit_interval(c) for c in dict.fromkeys((fast, slow))}), t, slow)
    return affine_scan(
        src, keys, t, 1.0 - a, a * F.col(fast), F.col("_start"), length, chunk, keep=[fast, slow, *keep]
    )


def supplied_gain(panel: DataFrame, alpha_col: str = "alpha", **kw) -> DataFrame:
    """Constant-gain form with one gain per row; gains outside [0,1] raise."""
    ok = ~X.nonfinite(alpha_col) & F.col(alpha_col).between(0.0, 1.0)
    a = F.when(ok, F.col(alpha_col)).otherwise(F.raise_error(F.lit("gain outside [0,1]")).cast("double"))
    kw["keep"] = [alpha_col, *kw.get("keep", ())]
    return constant_gain(panel, a, **kw)


def ema(panel: DataFrame, alpha: float | Column, fast: str = "fast", **kw) -> DataFrame:
    """Exponential smoother started at the first observation."""
    return constant_gain(panel, alpha, fast=fast, slow=fast, **kw)


# ------------------------------------------------------------------ Kalman gains
def gains_at(q: float, r: float, p0: float, epsilon: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and posterior variance of the updates ``step`` (from 0), in closed form.

    One update maps the variance P to (P + q) r / (P + q + r). With the fixed points a > b of this map,
    (P - a) / (P - b) shrinks by a constant factor, so any step follows directly; without process noise
    the precision 1 / P grows by 1 / r instead. ``epsilon`` is the floor of the prior.
    """
    r = max(epsilon, r)
    k = step.astype(np.float64)
    if q == 0:
        before = 1.0 / (1.0 / p0 + k / r) if p0 > 0 else np.zeros(len(k))
    else:
        root = np.sqrt(q * (q + 4.0 * r))
        high, low = (root - q) / 2.0, (-root - q) / 2.0
        shrink, first = k * np.log1p(-root / (high + q + r)), root / (p0 - low)
        # In logarithms 1 - share keeps its digits where there is next to no noise and the share is close to 1.
        if first < 1.0:
            share, rest = np.exp(np.log1p(-first) + shrink), -np.expm1(np.log1p(-first) + shrink)
        else:
            share = (1.0 - first) * np.exp(shrink)
            rest = 1.0 - share
        before = high + root * share / rest
    prior = np.maximum(epsilon, before + q)
    return prior / (prior + r), prior * r / (prior + r)


# ------------------------------------------------------------------ input rules
def within(df: DataFrame, length: int, t: str = TIME) -> DataFrame:
    """Raise in the task where a row lies beyond the stated ``length``, which decides how chunks are joined."""
    late = F.raise_error(F.concat(F.lit(f"{t} is not below the stated length {length}: "), F.col(t).cast("string")))
    return df.withColumn(t, F.when(F.col(t) < length, F.col(t)).otherwise(late.cast("long")))


def unit_interval(c: str) -> Column:
    """The column, or an error in the task where it is not a finite number in [0, 1]."""
    bad = F.raise_error(F.concat(F.lit(f"{c} is outside [0,1]: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    return F.when(~X.nonfinite(c) & F.col(c).between(0.0, 1.0), F.col(c)).otherwise(bad.cast("double"))


# ------------------------------------------------------------------ fixed Kalman
def kalman_fixed(
    panel: DataFrame, q: float | Column, r: float | Column, init: str | None = None,
    keys: Sequence[str] = SEQUENCE, t: str = TIME, value: str = "fast", p0: float = 1.0,
    epsilon: float = 1e-12, length: int | None = None, keep: Sequence[str] = (), chunk: int = B.CHUNK,
) -> DataFrame:
    """Random-walk Kalman filter; adds state, variance, gain, innovation, r_used.

    The gain depends on the step only and has a closed form; the state follows
    the affine scan. Without ``init`` the first observation is the mean, with
    gain 0.
    """
    length = B.longest(panel, t) if length is None else length
    qc = q if isinstance(q, Column) else F.lit(float(q))
    rc = r if isinstance(r, Column) else F.lit(float(r))
    start = F.col(init) if init else F.col(value)
    shift = 0 if init else 1
    base = panel.select(*keys, t, value, *[c for c in keep if c not in (*keys, t, value)],
                        qc.alias("_q"), rc.alias("_r"), start.alias("_s0"))
    names = list(base.columns)
    schema = B.schema_of(base, names, "gain double, variance double")

    def lookup(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            at, qs, rs = B.ints(table, t) - shift, B.floats(table, "_q"), B.floats(table, "_r")
            gain, var = np.zeros(len(at)), np.full(len(at), p0)
            pairs, which = np.unique(np.stack([qs, rs]), axis=1, return_inverse=True)
            for i in range(pairs.shape[1]):
                m = (which.ravel() == i) & (at >= 0)
                gain[m], var[m] = gains_at(float(pairs[0, i]), float(pairs[1, i]), p0, epsilon, at[m])
            yield from B.extend(table, names, {"gain": gain, "variance": var}).to_batches()

    ship(panel.sparkSession)
    rows = base.mapInArrow(lookup, schema)
    first = F.when(F.col(t) == 0, F.col("_s0")).otherwise(F.lit(0.0))
    out = affine_scan(
        rows, keys, t, 1.0 - F.col("gain"), F.col("gain") * F.col(value), first, length, chunk,
        keep=[value, *keep, "gain", "variance", "_r"],
    )
    resid = (F.col(value) - F.col("state")) / (1.0 - F.col("gain"))
    opening = F.lit(0.0) if init is None else resid
    return out.withColumn("innovation", F.when(F.col(t) == 0, opening).otherwise(resid)).withColumnRenamed(
        "_r", "r_used"
    )


# ------------------------------------------------------------------ past context
def past_context(
    panel: DataFrame, k: int, keys: Sequence[str] = SEQUENCE, t: str = TIME, value: str = "fast",
    chunk: int = B.CHUNK,
) -> DataFrame:
    """Slope, sign consistency and variance of the previous ``k`` samples."""
    step = F.col(value) - F.col("_prev")
    mark = F.when(F.abs(step) > EPS, F.signum(step))

    def build(rows):
        enough = F.count(value).over(rows(-k, -1)) >= 2
        zero = F.lit(0.0)
        return {
            "past_slope": F.when(enough, F.regr_slope(F.col(value), F.col(t).cast("double")).over(rows(-k, -1))).otherwise(zero),
            "past_consistency": F.when(enough, F.coalesce(F.abs(F.avg(mark).over(rows(-(k - 1), -1))), zero)).otherwise(zero),
            "past_variance": F.when(enough, F.var_pop(value).over(rows(-k, -1))).otherwise(zero),
        }

    base = B.with_halo(panel, t, before=k + 1, chunk=chunk)
    w = B.chunk_window(keys, t)
    lagged = base.withColumn("_prev", F.lag(value).over(w))

    def rows(lo, hi):
        return w.rowsBetween(lo, hi)

    return B.drop_halo(lagged.withColumns(build(rows)).drop("_prev"))


def past_stats(window: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, consistency, variance of the last ``count`` entries of each row."""
    n, k = window.shape
    pos = np.arange(k)[None, :]
    lead = (k - count)[:, None]
    used = pos >= lead
    c = np.maximum(count, 1)[:, None]
    x = np.where(used, pos - lead - (count[:, None] - 1) / 2.0, 0.0)
    v = np.where(used, window, 0.0)
    mean = v.sum(axis=1, keepdims=True) / c
    dev = np.where(used, window - mean, 0.0)
    slope = (x * dev).sum(axis=1) / np.maximum((x * x).sum(axis=1), 1e-12)
    d = window[:, 1:] - window[:, :-1]
    moved = used[:, :-1] & (np.abs(d) > EPS)
    hits = moved.sum(axis=1)
    consistency = np.abs(np.where(moved, np.sign(d), 0.0).sum(axis=1)) / np.maximum(hits, 1)
    variance = (dev * dev).sum(axis=1) / c[:, 0]
    short = count < 2
    return (np.where(short, 0.0, slope), np.where(short, 0.0, consistency), np.where(short, 0.0, variance))


# ------------------------------------------------------------------ tracker step
def tracker_step(p: dict, fast, slow, prev, slope, consistency, variance) -> dict[str, np.ndarray]:
    """One step for a vector of sequences; ``p`` holds scalars or vectors."""
    innovation = fast - prev
    gap = fast - slow
    unclear = (np.abs(slope) <= EPS) | (np.abs(innovation) <= EPS)
    agree = np.where(unclear, 0.5, np.where(np.sign(slope) == np.sign(innovation), 1.0, 0.0))
    strengths = (
        1.0 - np.exp(-np.abs(innovation) / p["innovation_scale"]),
        1.0 - np.exp(-np.abs(gap) / p["disagreement_scale"]),
        1.0 - np.exp(-np.abs(slope) / p["slope_scale"]),
        1.0 - np.exp(-np.maximum(variance, 0.0) / p["variance_scale"]),
        consistency,
        agree,
    )
    scores = []
    for name in STATES:
        w = SCORE_WEIGHTS[name]
        total = p[f"{name}_bias"] + w[-1]
        for weight, s in zip(w, strengths):
            if weight:
                total = total + weight * s
        scores.append(total)
    scaled = np.stack(scores) / p["temperature"]
    e = np.exp(scaled - scaled.max(axis=0))
    prob = e / e.sum(axis=0)
    alpha = prob[0] * p["alpha_outlier"] + prob[1] * p["alpha_stable"] + prob[2] * p["alpha_transition"]
    state = np.clip(alpha * fast + (1.0 - alpha) * prev, 0.0, 1.0)
    return {"state": state, "alpha": alpha, "scores": np.stack(scores), "prob": prob,
            "innovation": innovation, "gap": gap, "agree": agree}


@dataclass
class _Grid:
    """Parameters per candidate as arrays, looked up by the candidate column."""

    configs: list[TrackerConfig]
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in TrackerConfig.__dataclass_fields__:
            self.arrays[name] = np.array([getattr(c, name) for c in self.configs])

    def at(self, index: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v[index] for k, v in self.arrays.items()}


TRACKER_FIELDS = (
    "alpha double, score_outlier double, score_stable double, score_transition double, "
    "p_outlier double, p_stable double, p_transition double, state_index int, "
    "disagreement double, innovation double, past_slope double, past_consistency double, "
    "sign_consistency double, past_variance double"
)


def windows_before(values: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """The k values before each row of its unit, zero-filled on the left."""
    at = np.arange(len(values))[:, None] + np.arange(-k, 0)[None, :]
    ok = pos[:, None] + np.arange(-k, 0)[None, :] >= 0
    return np.where(ok, values[np.clip(at, 0, None)], 0.0)


def positions(starts: np.ndarray, n: int) -> np.ndarray:
    lengths = np.diff(np.append(starts, n))
    return np.arange(n) - np.repeat(starts, lengths)


def _tracker_kernel(keep, grid: _Grid, candidate: str | None, t: str, chunk: int, full: bool):
    """Fold each unit; rows before the chunk give context and warm the state up."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        fast, slow = B.floats(table, "fast"), B.floats(table, "slow")
        home = np.asarray(table.column("_home").to_numpy(zero_copy_only=False), dtype=bool)
        given = B.floats(table, "_given")
        which = B.ints(table, candidate) if candidate else np.zeros(n, dtype=np.int64)
        pos = positions(starts, n)
        slope, consistency, variance = (np.empty(n) for _ in range(3))
        windows = grid.arrays["past_window"]
        for k in np.unique(windows[np.unique(which)]):
            m = windows[which] == k
            stats = past_stats(windows_before(fast, pos, int(k))[m], np.minimum(pos[m], k))
            slope[m], consistency[m], variance[m] = stats
        names = ["state", "_from"] + ([f.split()[0] for f in TRACKER_FIELDS.split(", ")] if full else [])
        out = {x: np.empty(n) for x in names}
        first, _ = B.unit_layout(starts, n)
        prev = slow[first].copy()
        use = grid.at(which[first])
        for s, rows, live in B.steps(starts, n):
            p = {k: v[:live] for k, v in use.items()}
            # A repaired chunk starts from its predecessor's end at its first own row.
            begin = home[rows] & ~np.isnan(given[rows])
            before = np.where(begin, given[rows], prev[:live])
            got = tracker_step(p, fast[rows], slow[rows], before, slope[rows], consistency[rows], variance[rows])
            prev[:live] = got["state"]
            out["state"][rows], out["_from"][rows] = got["state"], before
            if full:
                out["alpha"][rows] = got["alpha"]
                for i, name in enumerate(STATES):
                    out[f"score_{name}"][rows] = got["scores"][i]
                    out[f"p_{name}"][rows] = got["prob"][i]
                out["state_index"][rows] = got["prob"].argmax(axis=0)
                out["disagreement"][rows], out["innovation"][rows] = got["gap"], got["innovation"]
                out["sign_consistency"][rows] = got["agree"]
        if full:
            out["past_slope"], out["past_consistency"], out["past_variance"] = slope, consistency, variance
            out["state_index"] = out["state_index"].astype(np.int32)
        res = B.extend(table, keep, out)
        return res.filter(pa.array(home))

    return kernel


def _shoot(panel: DataFrame, keys, t, run, ends, length, chunk, warmup, tolerance=EPS, max_rounds=None):
    """Run nonlinear chunks in parallel and repair until the hand-overs agree.

    ``run(rows)`` folds units of rows that carry ``_chunk``, ``_home`` and the
    ``_given*`` start columns; ``ends`` maps each carried column to its start.
    """
    panel = within(panel, length, t)
    halo = B.with_halo(panel, t, before=0 if length <= chunk else warmup, chunk=chunk)
    blank = {f"_given{'' if c == 'state' else '_' + c}": F.lit(float("nan")) for c in ends}
    if length <= chunk:
        return run(halo.withColumns(blank))
    unit = [*keys, "_chunk"]
    halo = cut(halo)
    done = cut(run(halo.withColumns(blank)))

    def borders(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Start of each chunk but the first, and each full chunk's end as the next one's wanted start."""
        head = rows.where(F.expr(f"`{t}` % {chunk} = 0 and `{t}` > 0")).select(*unit, *[F.col(v) for v in ends.values()])
        tail = rows.where(F.expr(f"`{t}` % {chunk} = {chunk - 1}")).select(
            *keys, (F.col("_chunk") + 1).alias("_chunk"), *[F.col(c).alias(f"_end_{c}") for c in ends])
        return head, tail

    heads, tails = (cut(x) for x in borders(done))
    off = F.lit(False)
    for c, start in ends.items():
        off = off | (F.abs(F.col(f"_end_{c}") - F.col(start)) > tolerance)
    own = F.col("_home") & (F.expr(f"`{t}` % {chunk} = 0"))
    fills = {g: F.when(own, F.col(f"_end_{c}")).otherwise(F.lit(float("nan"))) for c, g in zip(ends, blank)}
    layers: list[DataFrame] = []
    while True:
        bad = cut(heads.join(tails, unit).where(off).select(*unit, *[f"_end_{c}" for c in ends]))
        if bad.isEmpty():
            break
        if max_rounds is not None and len(layers) >= max_rounds:
            raise RuntimeError("chunk hand-overs did not settle")
        # Only the repaired chunks are written; their borders replace the old ones.
        redone = cut(run(halo.join(bad, unit).withColumns(fills).drop(*[f"_end_{c}" for c in ends])))
        layers.append(redone)
        head, tail = borders(redone)
        after = bad.select(*keys, (F.col("_chunk") + 1).alias("_chunk"))
        heads = cut(heads.join(bad.select(*unit), unit, "left_anti").unionByName(head))
        tails = cut(tails.join(after, unit, "left_anti").unionByName(tail))
    if not layers:
        return done
    every = done.withColumn("_round", F.lit(0))
    for k, rows in enumerate(layers, 1):
        every = every.unionByName(rows.withColumn("_round", F.lit(k)))
    last = cut(every.where("_round > 0").groupBy(*unit).agg(F.max("_round").alias("_last")))
    return every.join(last, unit, "left").where(F.col("_round") == F.coalesce("_last", F.lit(0))).drop("_round", "_last")


def change_aware(
    panel: DataFrame, config: TrackerConfig | Sequence[TrackerConfig] = TrackerConfig(), candidate: str | None = None,
    keys: Sequence[str] = SEQUENCE, t: str = TIME, length: int | None = None, keep: Sequence[str] = (),
    full: bool = True, chunk: int = B.CHUNK, warmup: int = WARMUP,
) -> DataFrame:
    """Three-state change-aware tracker; adds state, gain, scores, probabilities.

    With several configs, ``candidate`` names the column that holds the position
    of each row's config, and is part of ``keys``.
    """
    configs = [config] if isinstance(config, TrackerConfig) else list(config)
    grid = _Grid(configs)
    if candidate and candidate not in keys:
        raise ValueError("the candidate column must be a key")
    warmup = min(chunk, max(warmup, 2 * max(c.past_window for c in configs)))
    length = B.longest(panel, t) if length is None else length
    extra = [c for c in keep if c not in (*keys, t, "fast", "slow")]
    src = panel.select(*keys, t, unit_interval("fast").alias("fast"), unit_interval("slow").alias("slow"), *extra)
    fields = "state double, _from double" + (", " + TRACKER_FIELDS if full else "")

    def run(rows: DataFrame) -> DataFrame:
        cols = [*src.columns, "_chunk"]
        return B.map_units(
            rows, [*keys, "_chunk"], [t], _tracker_kernel(cols, grid, candidate, t, chunk, full),
            B.schema_of(rows, cols, fields),
        )

    out = _shoot(src, keys, t, run, {"state": "_from"}, length, chunk, warmup)
    return out.drop("_chunk", "_from")


# ------------------------------------------------------------------ adaptive Kalman
def kalman_step(p: KalmanParams, x, mean, cov, r, step) -> tuple:
    """One adaptive-Kalman step; r moves only after the gain has used it."""
    prior = np.maximum(p.epsilon, cov + p.q)
    used = np.maximum(p.epsilon, r)
    gain = prior / (prior + used)
    innovation = x - mean
    mean = mean + gain * innovation
    cov = np.maximum(0.0, (1.0 - gain) * prior)
    e = np.clip(innovation, -p.innovation_clip, p.innovation_clip)
    moved = np.clip((1.0 - p.rate) * r + p.rate * (e * e), p.r_min, p.r_max)
    after = np.where(step > p.warmup_steps, moved, r)
    return mean, cov, after, gain, used, innovation


def kalman_adaptive(
    panel: DataFrame, params: KalmanParams = KalmanParams(), keys: Sequence[str] = SEQUENCE, t: str = TIME,
    value: str = "fast", start: str = "slow", length: int | None = None, keep: Sequence[str] = (),
    chunk: int = B.CHUNK, warmup: int = WARMUP,
) -> DataFrame:
    """Adaptive Kalman started at slow[0]; adds the seven trace columns."""
    length = B.longest(panel, t) if length is None else length
    warmup = min(chunk, warmup)
    src = panel.select(*keys, t, value, start, *[c for c in keep if c not in (*keys, t, value, start)])
    fields = (
        "state double, gain double, covariance double, r_used double, r_after double, step long, "
        "innovation double, _from double, _from_cov double, _from_r double"
    )
    r0 = float(np.clip(params.r, params.r_min, params.r_max))

    cols = [*src.columns, "_chunk"]

    def run(rows: DataFrame) -> DataFrame:
        def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
            n = table.num_rows
            x, s = B.floats(table, value), B.floats(table, start)
            at = B.ints(table, t)
            home = np.asarray(table.column("_home").to_numpy(zero_copy_only=False), dtype=bool)
            given = [B.floats(table, c) for c in ("_given", "_given_covariance", "_given_r_after")]
            first, _ = B.unit_layout(starts, n)
            cur = [s[first].copy(), np.full(len(first), params.p0), np.full(len(first), r0)]
            names = ["state", "gain", "covariance", "r_used", "r_after", "innovation", "_from", "_from_cov", "_from_r"]
            out = {c: np.empty(n) for c in names}
            for _, rws, live in B.steps(starts, n):
                begin = home[rws] & ~np.isnan(given[0][rws])
                m, c, r = (np.where(begin, g[rws], v[:live]) for g, v in zip(given, cur))
                out["_from"][rws], out["_from_cov"][rws], out["_from_r"][rws] = m, c, r
                m, c, r, gain, used, innovation = kalman_step(params, x[rws], m, c, r, at[rws] + 1)
                cur[0][:live], cur[1][:live], cur[2][:live] = m, c, r
                out["state"][rws], out["gain"][rws], out["covariance"][rws] = m, gain, c
                out["r_used"][rws], out["r_after"][rws], out["innovation"][rws] = used, r, innovation
            ordered = {k: out[k] for k in names[:5]} | {"step": at + 1} | {k: out[k] for k in names[5:]}
            return B.extend(table, cols, ordered).filter(pa.array(home))

        return B.map_units(rows, [*keys, "_chunk"], [t], kernel, B.schema_of(rows, cols, fields))

    ends = {"state": "_from", "covariance": "_from_cov", "r_after": "_from_r"}
    out = _shoot(src, keys, t, run, ends, length, chunk, warmup)
    return out.drop("_chunk", "_from", "_from_cov", "_from_r")


# ------------------------------------------------------------------ mean gain
def mean_gain(traj: DataFrame, balanced: bool = True, group: str = "group_id", gain: str = "alpha") -> DataFrame:
    """Mean tracker gain: of group means (balanced) or over all rows (pooled)."""
    if not balanced:
        return traj.agg(F.avg(gain).alias("mean_gain"))
    return traj.groupBy(group).agg(F.avg(gain).alias("_g")).agg(F.avg("_g").alias("mean_gain"))


def score_states(
    df: DataFrame, innovation: str, gap: str, slope: str = "past_slope", consistency: str = "past_consistency",
    variance: str = "past_variance", config: TrackerConfig = TrackerConfig(),
) -> DataFrame:
    """Scores, probabilities, blended gain and state index as column expressions."""
    i, s = F.abs(F.col(innovation)), F.col(slope)
    agree = F.when((F.abs(s) <= EPS) | (i <= EPS), 0.5).when(F.signum(s) == F.signum(F.col(innovation)), 1.0).otherwise(0.0)
    strengths = (
        X.squash(i, config.innovation_scale), X.squash(F.abs(F.col(gap)), config.disagreement_scale),
        X.squash(F.abs(s), config.slope_scale), X.squash(variance, config.variance_scale), F.col(consistency), agree)
    df = df.withColumns({f"_m{j}": c for j, c in enumerate(strengths)})
    made = {}
    for name in STATES:
        w = SCORE_WEIGHTS[name]
        total = F.lit(float(getattr(config, f"{name}_bias")) + w[-1])
        for j, weight in enumerate(w[:-1]):
            if weight:
                total = total + F.lit(weight) * F.col(f"_m{j}")
        made[f"score_{name}"] = total
    df = df.withColumns(made)
    probs = X.softmax([F.col(f"score_{n}") for n in STATES], config.temperature)
    df = df.withColumns({f"p_{n}": p for n, p in zip(STATES, probs)})
    p = F.array(*[F.col(f"p_{n}") for n in STATES])
    alpha = F.col("p_outlier") * config.alpha_outlier + F.col("p_stable") * config.alpha_stable + F.col("p_transition") * config.alpha_transition
    return df.withColumns({"alpha": alpha, "state_index": (F.array_position(p, F.array_max(p)) - 1).cast("int")}).drop(*[f"_m{j}" for j in range(6)])
