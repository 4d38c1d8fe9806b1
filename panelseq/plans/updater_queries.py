"""Recursive updaters over the events panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelseq import GROUP, SEQUENCE, TIME
from panelseq.operators import metrics as M
from panelseq.operators import updaters as U
from panelseq.operators.joins import fanout
from panelseq.plans import panels as P
from panelseq.plans import sql_parts as S
from panelseq.plans.registry import q, query, r

KT = [*SEQUENCE, TIME]


def _panel(spark, sf):
    return P.event_panel(spark, sf), P.event_length(spark, sf)


@query("constant_gain", f"WITH RECURSIVE {S.PANEL}, {S.linear('s', '0.2::DOUBLE')} SELECT {S.KT}, {q('state')} FROM s")
def constant_gain(spark, sf):
    p, n = _panel(spark, sf)
    return U.constant_gain(p, 0.2, length=n).select(*KT, r("state"))


@query("supplied_gain", f"WITH RECURSIVE {S.PANEL}, {S.linear('s', '0.1 + 0.5 * @slow')} SELECT {S.KT}, {q('state')} FROM s")
def supplied_gain(spark, sf):
    p, n = _panel(spark, sf)
    return U.supplied_gain(p.withColumn("alpha", 0.1 + 0.5 * F.col("slow")), length=n).select(*KT, r("state"))


@query("ema", f"WITH RECURSIVE {S.PANEL}, {S.linear('s', '0.3::DOUBLE', start='fast')} SELECT {S.KT}, {q('state')} FROM s")
def ema(spark, sf):
    p, n = _panel(spark, sf)
    return U.ema(p, 0.3, length=n).select(*KT, r("state"))


@query("kalman_fixed", f"""WITH RECURSIVE {S.PANEL}, k AS (
  SELECT {S.KT}, fast AS state, 1.0::DOUBLE AS variance, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS innovation FROM panel WHERE time_index = 0
  UNION ALL
  SELECT {S.KT}, m + g * (fast - m), (1 - g) * (v + 0.001), g, fast - m
  FROM (SELECT p.group_id, p.seed, p.recording_id, p.time_index, p.fast, k.state AS m, k.variance AS v,
      (k.variance + 0.001::DOUBLE) / (k.variance + 0.001::DOUBLE + 0.01) AS g
    FROM k JOIN panel p ON {S.same('p', 'k')} AND p.time_index = k.time_index + 1))
SELECT {S.KT}, {q('state')}, {q('variance')}, {q('gain')}, {q('innovation')} FROM k""")
def kalman_fixed(spark, sf):
    p, n = _panel(spark, sf)
    return U.kalman_fixed(p, 0.001, 0.01, length=n).select(*KT, *[r(c) for c in ("state", "variance", "gain", "innovation")])


@query("kalman_fixed_started", f"""WITH RECURSIVE {S.PANEL}, k AS (
  SELECT {S.KT}, slow + (1.001::DOUBLE / 1.011) * (fast - slow) AS state, (1 - 1.001::DOUBLE / 1.011) * 1.001 AS variance FROM panel WHERE time_index = 0
  UNION ALL
  SELECT {S.KT}, m + g * (fast - m), (1 - g) * (v + 0.001)
  FROM (SELECT p.group_id, p.seed, p.recording_id, p.time_index, p.fast, k.state AS m, k.variance AS v,
      (k.variance + 0.001::DOUBLE) / (k.variance + 0.001::DOUBLE + 0.01) AS g
    FROM k JOIN panel p ON {S.same('p', 'k')} AND p.time_index = k.time_index + 1))
SELECT {S.KT}, {q('state')}, {q('variance')} FROM k""")
def kalman_fixed_started(spark, sf):
    p, n = _panel(spark, sf)
    return U.kalman_fixed(p, 0.001, 0.01, init="slow", length=n).select(*KT, r("state"), r("variance"))


@query("kalman_adaptive", f"""WITH RECURSIVE {S.PANEL}, {S.ADAPTIVE}
SELECT {S.KT}, {q('state')}, {q('gain')}, {q('covariance')}, {q('r_used')}, {q('r_after')}, time_index + 1 AS step, {q('innovation')} FROM kal""")
def kalman_adaptive(spark, sf):
    p, n = _panel(spark, sf)
    d = U.kalman_adaptive(p, length=n)
    return d.select(*KT, *[r(c) for c in ("state", "gain", "covariance", "r_used", "r_after")], "step", r("innovation"))


@query("change_aware", f"""WITH RECURSIVE {S.PANEL}, {S.context()}, {S.tracker()}
SELECT {S.KT}, {q('state')}, {q('alpha')}, {q('so', 'score_outlier')}, {q('ss', 'score_stable')}, {q('st', 'score_transition')},
  {q('p1', 'p_outlier')}, {q('p2', 'p_stable')}, {q('p3', 'p_transition')},
  CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS state_index, {q('gap', 'disagreement')}, {q('innovation')},
  {q('past_slope')}, {q('past_consistency')}, {q('agree', 'sign_consistency')}, {q('past_variance')} FROM full_""")
def change_aware(spark, sf):
    p, n = _panel(spark, sf)
    d = U.change_aware(p, length=n)
    names = [f.split()[0] for f in U.TRACKER_FIELDS.split(", ")]
    return d.select(*KT, r("state"), *["state_index" if c == "state_index" else r(c) for c in names])


# A small grid of tracker settings, as (past_window, innovation_scale, alpha_stable).
GRID = ((5, 0.08, 0.20), (10, 0.08, 0.20), (10, 0.16, 0.30), (10, 0.04, 0.10))


def _grid_ctx() -> str:
    by = f"{S.K}, config"
    out = [f"g AS MATERIALIZED (SELECT p.*, config, w, sc, al FROM panel p, (VALUES {', '.join(f'({i}, {w}, {s}::DOUBLE, {a}::DOUBLE)' for i, (w, s, a) in enumerate(GRID))}) AS c(config, w, sc, al))"]
    for k in sorted({w for w, _, _ in GRID}):
        out.append(f"g{k} AS (SELECT * FROM g WHERE w = {k})")
        out.append(S.context(f"ctx{k}", f"g{k}", by, k=k, carry="slow, target, sc, al"))
    out.append("ctx AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM ctx{k}" for k in sorted({w for w, _, _ in GRID})) + ")")
    out.append(S.tracker(keys=by, carry="target, sc, al", innovation_scale="sc", alpha_stable="al"))
    return ", ".join(out)


GRID_SQL = f"WITH RECURSIVE {S.PANEL}, {_grid_ctx()}"
CCC = "2 * covar_pop(target, {c}) / (var_pop(target) + var_pop({c}) + pow(avg(target) - avg({c}), 2))"


def grid_configs() -> list[U.TrackerConfig]:
    return [U.TrackerConfig(past_window=w, innovation_scale=s, alpha_stable=a) for w, s, a in GRID]


def grid_states(spark, sf):
    p, n = _panel(spark, sf)
    rows = fanout(p, config=list(range(len(GRID))))
    return U.change_aware(
        rows, grid_configs(), candidate="config", keys=[*SEQUENCE, "config"], length=n, keep=["target"], full=False)


@query("replay_grid", GRID_SQL + f"""
SELECT config, {q('sqrt(avg(pow(target - state, 2)))', 'rmse')}, {q('avg(abs(target - state))', 'mae')}, {q('corr(target, state)', 'pcc')},
  {q(CCC.format(c='state'), 'ccc')} FROM full_ GROUP BY config""")
def replay_grid(spark, sf):
    d = M.error_metrics(grid_states(spark, sf), "state", ["config"])
    return d.select("config", *[r(c) for c in ("rmse", "mae", "pcc", "ccc")])


@query("mean_gain", f"""WITH RECURSIVE {S.PANEL}, {S.context()}, {S.tracker()}, g AS (SELECT group_id, avg(alpha) AS a FROM full_ GROUP BY group_id)
SELECT 'balanced' AS weighting, {q('avg(a)', 'mean_gain')} FROM g UNION ALL SELECT 'pooled', {q('avg(alpha)', 'mean_gain')} FROM full_""")
def mean_gain(spark, sf):
    p, n = _panel(spark, sf)
    d = U.change_aware(p, length=n).select(GROUP, "alpha")
    both = [U.mean_gain(d, b).select(F.lit(w).alias("weighting"), r("mean_gain")) for w, b in (("balanced", True), ("pooled", False))]
    return both[0].unionByName(both[1])
