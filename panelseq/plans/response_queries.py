"""Roots, perturbed replays, reduction and construction contrasts on the events panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEQUENCE, TIME
from panelseq.operators import claims as C
from panelseq.operators import infer as I
from panelseq.operators import metrics as M
from panelseq.operators import perturb as T
from panelseq.operators import reduce as R
from panelseq.operators import updaters as U
from panelseq.plans import panels as P
from panelseq.plans import sql_parts as S
from panelseq.plans.registry import q, query, r
from panelseq.session import cut

L, H, T0, D = P.SUSTAINED, P.HORIZON, P.T0_MIN, P.DELTA
LATE = (2, 5)
ALPHA = 0.2
BRANCHES = T.standard_branches(D, L)
CONTROLLERS = (T.Tracker("Full"), T.ConstantGain("C0", ALPHA), T.AdaptiveKalman("Kalman"))


def _roots(spark, sf):
    return T.root_table(P.event_panel(spark, sf), L, H, T0, delta=D)


_ROOTS = f"""hw AS (SELECT {S.K}, time_index, min(fast) OVER w AS lo, max(fast) OVER w AS hi,
    count(CASE WHEN fast < {D} OR fast > 1 - {D}::DOUBLE THEN 1 END) OVER w AS bad, lead(time_index, {H - 1}) OVER o AS far FROM panel
  WINDOW o AS (PARTITION BY {S.K} ORDER BY time_index), w AS (PARTITION BY {S.K} ORDER BY time_index ROWS BETWEEN CURRENT ROW AND {L - 1} FOLLOWING)),
tried AS (SELECT group_id, recording_id, time_index AS t0, bool_and(lo >= {D} AND hi <= 1 - {D}::DOUBLE) AS eligible,
    sum(bad)::BIGINT AS bad_offsets, sum(CASE WHEN lo < {D} OR hi > 1 - {D}::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS bad_seeds
  FROM hw WHERE far IS NOT NULL AND time_index >= {T0} GROUP BY ALL),
roots AS MATERIALIZED (SELECT group_id, recording_id, t0 FROM tried WHERE eligible)"""


@query("eligible_roots", f"WITH {S.PANEL}, {_ROOTS} SELECT group_id, recording_id, t0, eligible, bad_seeds, bad_offsets FROM tried")
def eligible_roots(spark, sf):
    n = F.aggregate("violations", F.lit(0), lambda a, v: a + F.size(v["offsets"]))
    return _roots(spark, sf).select(
        GROUP, RECORDING, "t0", "eligible", F.size("violations").cast("long").alias("bad_seeds"), n.cast("long").alias("bad_offsets"))


@query("root_audit", f"""WITH {S.PANEL}, {_ROOTS} SELECT coalesce(group_id, -1) AS group_id, coalesce(recording_id, -1) AS recording_id, count(*) AS structural_roots, count(*) FILTER (eligible) AS eligible_roots,
  count(*) FILTER (NOT eligible) AS excluded_roots FROM tried GROUP BY ROLLUP (group_id, recording_id)""")
def root_audit(spark, sf):
    d = T.root_audit(_roots(spark, sf))
    return d.withColumns({c: F.coalesce(c, F.lit(-1)) for c in (GROUP, RECORDING)})


@query("root_changes", f"""WITH {S.PANEL}, {_ROOTS} SELECT group_id, recording_id, 0::BIGINT AS added, count(*) FILTER (NOT eligible) AS removed,
  count(*) FILTER (eligible) AS shared FROM tried GROUP BY ALL""")
def root_changes(spark, sf):
    roots = _roots(spark, sf)
    return T.root_changes(roots, T.eligible_roots(roots))


@query("perturbed_signal", f"""WITH {S.PANEL}, {_ROOTS},
b(construction, amplitude, duration) AS (VALUES ('fixed_transient', {D}::DOUBLE, 1), ('fixed_sustained', {D}::DOUBLE, {L}), ('equal_sustained', {D}::DOUBLE / {L}, {L})),
x AS (SELECT construction, sign, o, fast + CASE WHEN o < duration THEN sign * amplitude ELSE 0 END AS y FROM roots
  JOIN panel ON panel.group_id = roots.group_id AND panel.recording_id = roots.recording_id AND time_index >= t0 AND time_index < t0 + {H},
  LATERAL (SELECT time_index - t0 AS o), b, (VALUES (-1), (1)) s(sign))
SELECT construction, sign, o::INTEGER AS "offset", count(*) AS n, count(*) FILTER (y < 0 OR y > 1) AS clipped, {q('avg(y)', 'mean_input')} FROM x GROUP BY ALL""")
def perturbed_signal(spark, sf):
    p = P.event_panel(spark, sf)
    d = T.perturb(p, T.eligible_roots(_roots(spark, sf)), BRANCHES, H)
    return d.groupBy("construction", "sign", "offset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("clipped").alias("clipped"), r(F.avg("perturbed"), 6, "mean_input"))


def ledger(spark, sf, controllers=CONTROLLERS, emit="ledger"):
    p, n = P.event_panel(spark, sf), P.event_length(spark, sf)
    traces = T.clean_traces(p, controllers, n)
    roots = T.eligible_roots(_roots(spark, sf))
    return T.replay(traces, roots, controllers, BRANCHES, H, D, LATE, emit)


# Replays as SQL: each branch row carries the clean state before the root; the
# perturbed window and its context are laid out first, then the recursion runs.
_BK = "group_id, seed, recording_id, t0, sign, construction"
_LEDGER = f"""{S.PANEL}, {_ROOTS}, {S.context()}, {S.tracker(carry='')}, {S.linear('c0_', f'{ALPHA}::DOUBLE')}, {S.ADAPTIVE},
clean AS MATERIALIZED (SELECT p.*, f.state AS full_state, c.state AS c0_state, k.state AS k_state, k.covariance AS k_cov, k.r_after AS k_r
  FROM panel p JOIN full_ f USING ({S.KT}) JOIN c0_ c USING ({S.KT}) JOIN kal k USING ({S.KT})),
br(construction, shape, amplitude, duration) AS (VALUES ('fixed_transient', 'transient', {D}::DOUBLE, 1), ('fixed_sustained', 'sustained', {D}::DOUBLE, {L}), ('equal_sustained', 'sustained', {D}::DOUBLE / {L}, {L})),
win AS MATERIALIZED (SELECT c.group_id, c.seed, c.recording_id, r.t0, s.sign, b.construction, c.time_index, c.slow,
    c.fast + CASE WHEN c.time_index >= r.t0 AND c.time_index < r.t0 + b.duration THEN s.sign * b.amplitude ELSE 0 END AS fast,
    c.full_state, c.c0_state, c.k_state, c.k_cov, c.k_r
  FROM roots r JOIN (SELECT unnest(range(-10, {H})) AS o) h ON true
  JOIN clean c ON c.group_id = r.group_id AND c.recording_id = r.recording_id AND c.time_index = r.t0 + h.o, br b, (VALUES (-1), (1)) s(sign)),
{S.context('wctx', 'win', _BK, carry='slow, full_state, c0_state, k_state, k_cov, k_r')},
w AS MATERIALIZED (SELECT *, time_index - t0 AS o FROM wctx),
fr AS (
  {S.tracker_body("SELECT w.*, (w.time_index - w.t0) AS oo, p.full_state AS prev FROM w JOIN w p ON " + S.same('w', 'p', _BK) + " AND p.o = -1 WHERE w.o = 0", _BK + ", time_index, full_state")}
  UNION ALL
  {S.tracker_body("SELECT w.*, (w.time_index - w.t0) AS oo, t.state AS prev FROM fr t JOIN w ON " + S.same('w', 't', _BK) + " AND w.time_index = t.time_index + 1", _BK + ", time_index, full_state")}),
cr AS (
  SELECT {', '.join('w.' + c.strip() for c in _BK.split(','))}, w.time_index, w.c0_state, {ALPHA}::DOUBLE * w.fast + {1 - ALPHA}::DOUBLE * p.c0_state AS state
    FROM w JOIN w p ON {S.same('w', 'p', _BK)} AND p.o = -1 WHERE w.o = 0
  UNION ALL SELECT {', '.join('w.' + c.strip() for c in _BK.split(','))}, w.time_index, w.c0_state, {ALPHA}::DOUBLE * w.fast + {1 - ALPHA}::DOUBLE * t.state
    FROM cr t JOIN w ON {S.same('w', 't', _BK)} AND w.time_index = t.time_index + 1),
kb AS (SELECT {', '.join('w.' + c.strip() for c in _BK.split(','))}, w.time_index, w.fast, w.k_state, p.k_state AS m, p.k_cov AS v, p.k_r AS rr FROM w JOIN w p ON {S.same('w', 'p', _BK)} AND p.o = -1 WHERE w.o = 0),
kr AS (
  SELECT {_BK}, time_index, k_state, m + g * (fast - m) AS state, (1 - g) * (v + 0.0001) AS v,
    CASE WHEN time_index + 1 > 10 THEN least(1, greatest(0.000001, 0.95 * rr + 0.05 * pow(fast - m, 2))) ELSE rr END AS rr
    FROM (SELECT *, (v + 0.0001::DOUBLE) / (v + 0.0001::DOUBLE + rr) AS g FROM kb)
  UNION ALL SELECT {_BK}, time_index, k_state, m + g * (fast - m), (1 - g) * (v + 0.0001),
    CASE WHEN time_index + 1 > 10 THEN least(1, greatest(0.000001, 0.95 * rr + 0.05 * pow(fast - m, 2))) ELSE rr END
    FROM (SELECT {', '.join('w.' + c.strip() for c in _BK.split(','))}, w.time_index, w.fast, w.k_state, t.state AS m, t.v, t.rr, (t.v + 0.0001::DOUBLE) / (t.v + 0.0001::DOUBLE + t.rr) AS g
      FROM kr t JOIN w ON {S.same('w', 't', _BK)} AND w.time_index = t.time_index + 1)),
states AS (SELECT 'Full' AS controller, {_BK}, time_index - t0 AS o, state, full_state AS clean FROM fr
  UNION ALL SELECT 'C0', {_BK}, time_index - t0, state, c0_state FROM cr UNION ALL SELECT 'Kalman', {_BK}, time_index - t0, state, k_state FROM kr),
ledger AS MATERIALIZED (SELECT {_BK}, controller, CASE WHEN construction = 'fixed_transient' THEN 'transient' ELSE 'sustained' END AS shape,
    sum(abs(state - clean)) / {D} AS A,
    CASE WHEN construction <> 'fixed_transient' THEN sum(sign * (state - clean)) FILTER (o >= {LATE[0]} AND o < {LATE[1]}) / ({LATE[1] - LATE[0]} * {D}) END AS B_late
  FROM states GROUP BY {_BK}, controller)"""


def _reduce_sql(value: str = "A") -> str:
    c = "controller, construction, shape"
    return f"""(SELECT group_id, {c}, avg({value}) AS {value} FROM (SELECT group_id, recording_id, {c}, avg({value}) AS {value} FROM (
  SELECT group_id, recording_id, t0, {c}, avg({value}) AS {value} FROM (SELECT group_id, recording_id, t0, seed, {c}, avg({value}) AS {value}
    FROM ledger WHERE {value} IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""


_CELLS = f"WITH RECURSIVE {_LEDGER}, cells AS MATERIALIZED {_reduce_sql()}"
_VIEWS = f"""views AS (SELECT 'fixed_amplitude' AS "view", group_id, controller, construction, shape, A FROM cells WHERE construction <> 'equal_sustained'
  UNION ALL SELECT 'dose_normalized', group_id, controller, construction, shape, CASE WHEN shape = 'sustained' THEN A / {L} ELSE A END FROM cells WHERE construction <> 'equal_sustained'
  UNION ALL SELECT 'equal_total_dose', group_id, controller, construction, shape, A FROM cells WHERE construction <> 'fixed_sustained')"""


def _theta_cells(full: str) -> str:
    def cell(c, s):
        return f"max(A) FILTER (controller = '{c}' AND shape = '{s}')"
    return (f"{cell(full, 'transient')} AS A_Full_T, {cell(full, 'sustained')} AS A_Full_S, "
            f"{cell('C0', 'transient')} AS A_C0_T, {cell('C0', 'sustained')} AS A_C0_S")


_THETA = f"""{_CELLS}, {_VIEWS}, tc AS (SELECT "view", group_id, {_theta_cells('Full')} FROM views GROUP BY ALL),
theta AS MATERIALIZED (SELECT *, A_Full_S - A_Full_T AS Delta_Full, A_C0_S - A_C0_T AS Delta_C0, A_Full_S - A_C0_S AS D_S, A_Full_T - A_C0_T AS D_T,
  (A_Full_S - A_Full_T) - (A_C0_S - A_C0_T) AS Theta FROM tc)"""


@query("response_ledger", f"WITH RECURSIVE {_LEDGER} SELECT {_BK}, controller, shape, {q('A')}, {q('B_late')} FROM ledger")
def response_ledger(spark, sf):
    d = ledger(spark, sf)
    return d.select(*SEQUENCE, "t0", "sign", "construction", "controller", "shape", r("A"), r("B_late"))


@query("group_cells", f"{_CELLS} SELECT group_id, controller, construction, shape, {q('A')} FROM cells")
def group_cells(spark, sf):
    return R.reduce_ledger(ledger(spark, sf)).select(GROUP, *R.CELLS, r("A"))


@query("late_response_cells", f"WITH RECURSIVE {_LEDGER} SELECT group_id, controller, construction, shape, {q('B_late')} FROM {_reduce_sql('B_late')}")
def late_response_cells(spark, sf):
    return R.reduce_ledger(ledger(spark, sf), "B_late").select(GROUP, *R.CELLS, r("B_late"))


def views(spark, sf):
    return R.all_views(cut(R.reduce_ledger(ledger(spark, sf))), L)


_T = ("A_Full_T", "A_Full_S", "A_C0_T", "A_C0_S", "Delta_Full", "Delta_C0", "D_S", "D_T", "Theta")


def thetas(spark, sf):
    return R.theta(views(spark, sf).where("controller <> 'Kalman'"))


@query("theta", f"""{_THETA} SELECT "view", group_id, {', '.join(q(c) for c in _T)} FROM theta""")
def theta(spark, sf):
    return thetas(spark, sf).select("view", GROUP, *[r(c) for c in _T])


@query("sign_branch_groups", f"""WITH RECURSIVE {_LEDGER}, b AS (SELECT group_id, recording_id, t0, controller, construction, sign, avg(A) AS A FROM ledger GROUP BY ALL),
g AS (SELECT group_id, controller, construction, sign, avg(A) AS A FROM (SELECT group_id, recording_id, controller, construction, sign, avg(A) AS A FROM b GROUP BY ALL) GROUP BY ALL),
p AS (SELECT group_id, controller, construction, max(A) FILTER (sign = -1) AS A_minus, max(A) FILTER (sign = 1) AS A_plus FROM g GROUP BY ALL)
SELECT group_id, controller, construction, {q('A_minus')}, {q('A_plus')}, {q('A_minus / 2 + A_plus / 2', 'A_sign_average')},
  {q('coalesce(abs(A_plus - A_minus) / nullif((A_plus + A_minus) / 2, 0), 0)', 'relative_asymmetry')} FROM p""")
def sign_branch_groups(spark, sf):
    d, _ = R.sign_diagnostics(cut(ledger(spark, sf)))
    return d.select(GROUP, "controller", "construction", *[r(c) for c in ("A_minus", "A_plus", "A_sign_average", "relative_asymmetry")])


@query("sign_branch_extremes", f"""WITH RECURSIVE {_LEDGER}, b AS (SELECT group_id, recording_id, t0, controller, construction, sign, avg(A) AS A FROM ledger GROUP BY ALL),
p AS (SELECT group_id, recording_id, t0, controller, construction, max(A) FILTER (sign = -1) AS m, max(A) FILTER (sign = 1) AS u FROM b GROUP BY ALL),
x AS (SELECT *, coalesce(abs(u - m) / nullif((u + m) / 2, 0), 0) AS a FROM p)
SELECT controller, construction, {q('max(a)', 'root_asymmetry_max', 5)}, {q('quantile_cont(a, 0.95)', 'root_asymmetry_q95', 5)}, {q('quantile_cont(a, 0.99)', 'root_asymmetry_q99', 5)},
  {q('min(m)', 'minus_branch_min', 5)}, {q('min(u)', 'plus_branch_min', 5)} FROM x GROUP BY ALL""")
def sign_branch_extremes(spark, sf):
    _, d = R.sign_diagnostics(cut(ledger(spark, sf)))
    cols = ("root_asymmetry_max", "root_asymmetry_q95", "root_asymmetry_q99", "minus_branch_min", "plus_branch_min")
    return d.select("controller", "construction", *[r(c, 5) for c in cols])


@query("component_areas", f"""{_CELLS}, {_VIEWS} SELECT controller AS updater, "view", shape, {q('avg(A)', 'area')}, count(*) AS N FROM views GROUP BY ALL""")
def component_areas(spark, sf):
    return R.component_areas(views(spark, sf)).select("updater", "view", "shape", r("area"), "N")


@query("state_area_audit", f"""WITH RECURSIVE {_LEDGER} SELECT s.controller, s.construction, s.sign, count(DISTINCT (group_id, seed, recording_id, t0)) AS rows, 0::BIGINT AS unpaired, 0::BIGINT AS differing,
  count(*) FILTER (state = 0 OR state = 1) AS boundary_points FROM states s GROUP BY ALL""")
def state_area_audit(spark, sf):
    p, n = P.event_panel(spark, sf), P.event_length(spark, sf)
    traces = cut(T.clean_traces(p, CONTROLLERS, n))
    roots = cut(T.eligible_roots(_roots(spark, sf)))
    led = T.replay(traces, roots, CONTROLLERS, BRANCHES, H, D, LATE)
    return T.audit_areas(T.replay(traces, roots, CONTROLLERS, BRANCHES, H, D, LATE, "states"), led, D)


@query("areas_from_states", f"WITH RECURSIVE {_LEDGER} SELECT {_BK}, controller, shape, {q('A')}, {q('B_late')} FROM ledger WHERE controller = 'C0'")
def areas_from_states(spark, sf):
    s = cut(ledger(spark, sf, (T.ConstantGain("C0", ALPHA),), "states"))
    d = T.response_area(s, D).join(T.late_response(s, D, LATE), list(T.LEDGER_KEYS), "left")
    return d.select(*SEQUENCE, "t0", "sign", "construction", "controller", "shape", r("A"), r("B_late"))


# ------------------------------------------------------------------ contrasts of constructions
_DIFF = f"""{_THETA}, d AS (SELECT f.group_id, e.Theta - f.Theta AS delta, (e.D_S - e.D_T) - (f.D_S - f.D_T) AS identity_2, e.D_T - f.D_T AS identity_3, e.D_S - f.D_S AS identity_4,
  (e.A_Full_S - e.A_C0_S) - (f.A_Full_S - f.A_C0_S) AS identity_5 FROM theta f JOIN theta e USING (group_id) WHERE f."view" = 'fixed_amplitude' AND e."view" = 'equal_total_dose')"""
_DCOLS = ("delta", "identity_2", "identity_3", "identity_4", "identity_5")


@query("construction_difference", f"{_DIFF} SELECT group_id, {', '.join(q(c) for c in _DCOLS)} FROM d")
def construction_difference(spark, sf):
    return C.construction_difference(thetas(spark, sf)).select(GROUP, *[r(c) for c in _DCOLS])


def _contrast_sql(name: str, updater: str) -> str:
    def gap(k):
        return f"max(A) FILTER (controller = '{updater}' AND construction = '{k}') - max(A) FILTER (controller = 'C0' AND construction = '{k}')"
    return f"""{name}_c AS (SELECT group_id, {gap('fixed_transient')} AS T, {gap('fixed_sustained')} AS S, {gap('equal_sustained')} AS E FROM cells GROUP BY ALL),
{name} AS (SELECT *, S - T AS Theta_fixed, S / {L} - T AS Theta_dose, E - T AS Theta_equal, E - S AS D, E - S / {L} AS R FROM {name}_c)"""


_COMP = ("T", "S", "E", "Theta_fixed", "Theta_dose", "Theta_equal", "D", "R")


@query("component_contrasts", f"{_CELLS}, {_contrast_sql('k', 'Kalman')} SELECT group_id, {', '.join(q(c) for c in _COMP)} FROM k")
def component_contrasts(spark, sf):
    return R.component_contrasts(R.reduce_ledger(ledger(spark, sf)), "Kalman", "C0", L).select(GROUP, *[r(c) for c in _COMP])


def _two_updaters(spark, sf):
    cells = cut(R.reduce_ledger(ledger(spark, sf)))
    return [C.unpivot(R.component_contrasts(cells, u, "C0", L), [GROUP], _COMP, "component") for u in ("Full", "Kalman")]


_UNP = " UNION ALL ".join(f"SELECT group_id, '{c}' AS component, f.{c} AS a, k.{c} AS b FROM f JOIN k USING (group_id)" for c in _COMP)


@query("updater_difference", f"{_CELLS}, {_contrast_sql('f', 'Full')}, {_contrast_sql('k', 'Kalman')}, u AS ({_UNP}) SELECT group_id, component, {q('b - a', 'difference')}, {q('a', 'first')}, {q('b', 'second')} FROM u")
def updater_difference(spark, sf):
    d = C.updater_difference(*_two_updaters(spark, sf))
    return d.select(GROUP, "component", r("difference"), r("first"), r("second"))


@query("estimate_table", f"{_CELLS}, {_contrast_sql('f', 'Full')}, {_contrast_sql('k', 'Kalman')}, u AS ({_UNP}) SELECT component AS endpoint_id, count(*) AS n, {q('avg(b)', 'estimate')}, 'AVAILABLE' AS interval_status FROM u GROUP BY component")
def estimate_table(spark, sf):
    long = _two_updaters(spark, sf)[1].withColumnRenamed("component", "endpoint_id")
    return C.estimate_table(long).select("endpoint_id", "n", r("estimate"), "interval_status")


@query("theta_distribution", f"""{_THETA} SELECT "view", count(*) AS n, {q('avg(Theta)', 'mean')}, {q('min(Theta)', 'min')}, {q('quantile_cont(Theta, 0.25)', 'q1')}, {q('median(Theta)', 'median')},
  {q('quantile_cont(Theta, 0.75)', 'q3')}, {q('max(Theta)', 'max')}, {q('stddev_samp(Theta)', 'sd')}, count(*) FILTER (Theta > 1e-12) AS positive_groups,
  count(*) FILTER (Theta < -1e-12) AS negative_groups, count(*) FILTER (abs(Theta) <= 1e-12) AS zero_groups FROM theta GROUP BY ALL""")
def theta_distribution(spark, sf):
    d = C.distribution(thetas(spark, sf), ["view"], "Theta")
    return d.select("view", "n", *[r(c) for c in ("mean", "min", "q1", "median", "q3", "max", "sd")], "positive_groups", "negative_groups", "zero_groups")


# What an interval report holds of each quantity, and its SQL over the CTE ``bc``.
_REPORT = ("estimate", "lower", "upper", "leave_out_low", "leave_out_high", "q1", "median", "q3")
_REPORT_SQL = f"""{q('estimate')}, {q('lower_', 'lower')}, {q('upper_', 'upper')}, {q('leave_out_low')}, {q('leave_out_high')}, {q('q1')}, {q('med', 'median')}, {q('q3')}, n,
  CASE WHEN lower_ IS NULL THEN 'DEGENERATE' ELSE 'AVAILABLE' END AS status"""


@query("theta_interval", f"""{_THETA}, tv AS MATERIALIZED (SELECT "view" AS quantity, group_id, Theta AS value FROM theta), {S.bca('tv', 'quantity')}
SELECT quantity, {_REPORT_SQL} FROM bc""")
def theta_interval(spark, sf):
    """BCa interval, leave-one-out range and quartiles of Theta per view."""
    t = thetas(spark, sf).select(F.col("view").alias("quantity"), GROUP, F.col("Theta").alias("value"))
    return I.bca_family(cut(t), ["quantity"]).select("quantity", *[r(c) for c in _REPORT], "n", "status")


@query("construction_report", f"""{_DIFF}, dv AS MATERIALIZED (SELECT 'delta' AS quantity, group_id, delta AS value FROM d), {S.bca('dv', 'quantity')},
sg AS (SELECT 'delta' AS quantity, count(*) FILTER (delta > 1e-12) AS positive_groups, count(*) FILTER (delta < -1e-12) AS negative_groups, count(*) FILTER (abs(delta) <= 1e-12) AS zero_groups FROM d)
SELECT quantity, {_REPORT_SQL}, positive_groups, negative_groups, zero_groups, CASE WHEN lower_ > 0 THEN 'positive' WHEN upper_ < 0 THEN 'negative' ELSE 'includes_zero' END AS support FROM bc JOIN sg USING (quantity)""")
def construction_report(spark, sf):
    """The construction difference with its BCa interval, leave-one-out range, quartiles and sign counts in one row."""
    long = cut(C.unpivot(C.construction_difference(thetas(spark, sf)), [GROUP], ["delta"]))
    d = I.bca_family(long, ["quantity"]).join(C.sign_counts(long, "value", ["quantity"]), "quantity")
    return C.support(d).select("quantity", *[r(c) for c in _REPORT], "n", "status", "positive_groups", "negative_groups", "zero_groups", "support")


# ------------------------------------------------------------------ comparator contrasts (flagship)
def comparator_metrics(spark, sf):
    """RMSE per group of the tracker, the constant gain and the matched mean gain."""
    p, n = P.event_panel(spark, sf), P.event_length(spark, sf)
    full = cut(U.change_aware(p, length=n, keep=["target"]).select(*SEQUENCE, TIME, "fast", "slow", "target", "alpha", F.col("state").alias("Full")))
    # The mean gain is one number, so it is attached by a one-row broadcast join.
    gain = U.mean_gain(full).withColumn("_k", F.lit(1))
    d = full.withColumn("_k", F.lit(1)).join(F.broadcast(gain), "_k").drop("_k")
    d = U.constant_gain(d, ALPHA, length=n, keep=["target", "Full", "mean_gain"]).withColumnRenamed("state", "C0")
    d = U.constant_gain(d, F.col("mean_gain"), length=n, keep=["target", "Full", "C0"]).withColumnRenamed("state", "Cmean")
    long = d.select(*SEQUENCE, TIME, "target", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("state")) for m in ("Full", "C0", "Cmean")])))
    return M.rmse(long, "state", extra=["method"])


_CMP = f"""WITH RECURSIVE {S.PANEL}, {S.context()}, {S.tracker()}, mg AS (SELECT avg(a) AS g FROM (SELECT group_id, avg(alpha) AS a FROM full_ GROUP BY group_id)),
pg AS MATERIALIZED (SELECT p.*, g FROM panel p, mg), {S.linear('c0_', f'{ALPHA}::DOUBLE', carry='target')}, {S.linear('cm_', '@g', 'pg', carry='target, g')},
m AS (SELECT method, group_id, avg(x) AS rmse FROM (
  SELECT method, group_id, seed, sqrt(avg(pow(target - state, 2))) AS x FROM (SELECT 'Full' AS method, group_id, seed, target, state FROM full_
    UNION ALL SELECT 'C0', group_id, seed, target, state FROM c0_ UNION ALL SELECT 'Cmean', group_id, seed, target, state FROM cm_) GROUP BY ALL) GROUP BY ALL),
w AS (SELECT group_id, max(rmse) FILTER (method = 'Full') AS "Full", max(rmse) FILTER (method = 'C0') AS C0, max(rmse) FILTER (method = 'Cmean') AS Cmean FROM m GROUP BY group_id),
c AS MATERIALIZED (SELECT *, "Full" - C0 AS d0, "Full" - Cmean AS dm, C0 - Cmean AS K FROM w)"""
_CC = ("Full", "C0", "Cmean", "d0", "dm", "K")


@query("comparator_contrasts", f"""{_CMP} SELECT group_id, {', '.join(q('"Full"', '"Full"') if c == 'Full' else q(c) for c in _CC)} FROM c""")
def comparator_contrasts(spark, sf):
    return C.contrasts(comparator_metrics(spark, sf), "rmse").select(GROUP, *[r(c) for c in _CC])


def _class_inputs(spark, sf):
    """Mean, BCa interval and signs of the three contrasts."""
    long = cut(C.unpivot(C.contrasts(comparator_metrics(spark, sf), "rmse"), [GROUP], ["d0", "dm", "K"]))
    s = long.groupBy("quantity").agg(
        F.avg("value").alias("mean"),
        F.count_if(F.col("value") > 1e-12).alias("positive_groups"), F.count_if(F.col("value") < -1e-12).alias("negative_groups"),
        F.count_if(F.abs("value") <= 1e-12).alias("zero_groups"))
    s = s.join(I.bca_family(long, ["quantity"]).select("quantity", "lower", "upper"), "quantity")
    return C.majority(C.support(s))


_SUPPORT = "CASE WHEN lower_ > 0 THEN 'positive' WHEN upper_ < 0 THEN 'negative' ELSE 'includes_zero' END"
_CLASS = f"""{_CMP}, l AS MATERIALIZED (SELECT group_id, unnest(['d0', 'dm', 'K']) AS quantity, unnest([d0, dm, K]) AS value FROM c),
{S.bca('l', 'quantity')},
s AS (SELECT quantity, avg(value) AS mean, any_value(lower_) AS lower_, any_value(upper_) AS upper_,
  count(*) FILTER (value > 1e-12) AS pos, count(*) FILTER (value < -1e-12) AS neg, count(*) FILTER (abs(value) <= 1e-12) AS zero FROM l JOIN bc USING (quantity) GROUP BY quantity),
k AS (SELECT *, {_SUPPORT} AS support, sign(pos - neg) AS polarity FROM s)"""


@query("contrast_support", f"""{_CLASS} SELECT quantity, {q('mean')}, support, pos AS positive_groups, neg AS negative_groups,
  CASE WHEN neg + zero = 0 THEN 'ALL_POSITIVE' WHEN pos + zero = 0 THEN 'ALL_NEGATIVE' WHEN pos > neg THEN 'POSITIVE_MAJORITY' WHEN neg > pos THEN 'NEGATIVE_MAJORITY' ELSE 'TIED_MAJORITY' END AS majority FROM k""")
def contrast_support(spark, sf):
    return _class_inputs(spark, sf).select("quantity", r("mean"), "support", "positive_groups", "negative_groups", "majority")


@query("canonical_orientation", f"""{_CLASS} SELECT quantity, {q('-mean', 'mean')}, {q('-upper_', 'lower')}, {q('-lower_', 'upper')}, neg AS positive_groups, pos AS negative_groups FROM k""")
def canonical_orientation(spark, sf):
    d = C.flip_orientation(_class_inputs(spark, sf))
    return d.select("quantity", r("mean"), r("lower"), r("upper"), "positive_groups", "negative_groups")


@query("construction_class", f"""{_CLASS} SELECT CASE WHEN sign(a.mean) <> sign(b.mean) OR a.support <> b.support OR a.polarity <> b.polarity THEN 'construction-sensitive'
  WHEN k3.support <> 'includes_zero' THEN 'magnitude-sensitive' ELSE 'construction-robust' END AS classification, {q('a.mean', 'd0_mean')}, {q('b.mean', 'dm_mean')}
FROM k a, k b, k k3 WHERE a.quantity = 'd0' AND b.quantity = 'dm' AND k3.quantity = 'K'""")
def construction_class(spark, sf):
    s = _class_inputs(spark, sf)
    pick = lambda qn, c: F.max(F.when(F.col("quantity") == qn, F.col(c)))
    one = s.agg(*[pick(n, c).alias(f"{n}_{a}") for n in ("d0", "dm") for c, a in (("mean", "mean"), ("support", "support"), ("majority_polarity", "polarity"))],
                pick("K", "support").alias("k_support"))
    return C.classify_construction(one).select("classification", r("d0_mean"), r("dm_mean"))
