"""Joins, metrics, candidate summaries and selection over the events panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, SEQUENCE, TIME
from panelseq.operators import blocks as B
from panelseq.operators import joins as J
from panelseq.operators import metrics as M
from panelseq.operators import nested as N
from panelseq.operators import oof as O
from panelseq.operators import select as C
from panelseq.operators import updaters as U
from panelseq.plans import panels as P
from panelseq.plans import sql_parts as S
from panelseq.plans import updater_queries as UQ
from panelseq.plans.registry import q, query, r
from panelseq.session import cut

KT = [*SEQUENCE, TIME]
MAX_LAG = 5


def _panel(spark, sf):
    return P.event_panel(spark, sf), P.event_length(spark, sf)


# ------------------------------------------------------------------ joins
@query("one_to_one_merge", """WITH l AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, quantity, lines FROM orders JOIN l USING (o_orderkey)""")
def one_to_one_merge(spark, sf):
    lines = P.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    return J.merge_one_to_one(P.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


def _long_metrics(spark, sf):
    p = P.event_panel(spark, sf)
    parts = [M.rmse(p, m).withColumn("method", F.lit(m)) for m in ("fast", "slow")]
    return parts[0].unionByName(parts[1])


def _rmse_sql(method: str, src: str = "panel", extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    return f"(SELECT {e}group_id, avg(x) AS rmse FROM (SELECT {e}group_id, seed, sqrt(avg(pow(target - {method}, 2))) AS x FROM {src} GROUP BY ALL) GROUP BY ALL)"


@query("paired_difference", f"""WITH {S.PANEL} SELECT group_id, {q('a.rmse', 'first')}, {q('b.rmse', 'second')}, {q('a.rmse - b.rmse', 'difference')}
FROM {_rmse_sql('fast')} a JOIN {_rmse_sql('slow')} b USING (group_id)""")
def paired_difference(spark, sf):
    d = J.paired_diff(_long_metrics(spark, sf), GROUP, "method", "rmse", "fast", "slow")
    return d.select(GROUP, r("first"), r("second"), r("difference"))


@query("shift_join", f"""WITH {S.PANEL}, s AS (SELECT *, lag(slow, 2) OVER w AS slow_lagm2, lead(slow, 3) OVER w AS slow_lag3 FROM panel
  WINDOW w AS (PARTITION BY {S.K} ORDER BY time_index)) SELECT {S.KT}, {q('target')}, {q('slow_lagm2')}, {q('slow_lag3')} FROM s""")
def shift_join(spark, sf):
    d = J.shift_join(P.event_panel(spark, sf), [-2, 3], "slow")
    return d.select(*KT, r("target"), r("slow_lagm2"), r("slow_lag3"))


@query("root_slices", f"""WITH {S.SEQ}, roots AS (SELECT group_id, recording_id, time_index AS t0 FROM seq),
h AS (SELECT r.*, o, r.t0 + o AS time_index FROM roots r, range(20) t(o))
SELECT o::INTEGER AS "offset", count(*) AS n, {q('avg(value)', 'mean_value', 4)} FROM h JOIN seq USING (group_id, recording_id, time_index) GROUP BY o""")
def root_slices(spark, sf):
    seq = P.event_sequences(spark, sf)
    roots = seq.select(GROUP, RECORDING, F.col(TIME).alias("t0"))
    d = J.slice_roots(roots, seq, P.HORIZON, [GROUP, RECORDING])
    return d.groupBy("offset").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4, "mean_value"))


@query("missing_extra_keys", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT k AS o_custkey, 'extra' AS kind FROM (FROM a EXCEPT FROM b) UNION ALL SELECT k, 'missing' FROM (FROM b EXCEPT FROM a)""")
def missing_extra_keys(spark, sf):
    o = P.table(spark, sf, "orders")
    return J.missing_extra(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), ["o_custkey"])


@query("fan_out", f"""WITH {S.SEQ} SELECT group_id, seed, sign, count(*) AS n, {q('sum(value * sign)', 'signed_sum', 4)}
FROM seq, (VALUES (42), (123), (2026)) a(seed), (VALUES (-1), (1)) b(sign) GROUP BY ALL""")
def fan_out(spark, sf):
    d = J.fanout(P.event_sequences(spark, sf), seed=[42, 123, 2026], sign=[-1, 1])
    return d.groupBy(GROUP, "seed", "sign").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("value") * F.col("sign")), 4, "signed_sum"))


# ------------------------------------------------------------------ metrics
@query("rmse", f"WITH {S.PANEL} SELECT 'fast' AS method, group_id, {q('rmse')} FROM {_rmse_sql('fast')} UNION ALL SELECT 'slow', group_id, {q('rmse')} FROM {_rmse_sql('slow')}")
def rmse(spark, sf):
    return _long_metrics(spark, sf).select("method", GROUP, r("rmse"))


def _mafd_sql(method: str, src: str, extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    return f"""(SELECT {e}group_id, median(m) AS mafd FROM (SELECT {e}group_id, seed, median(m) AS m FROM (
  SELECT {e}{S.K}, avg(abs(d)) AS m FROM (SELECT {e}{S.K}, {method} - lag({method}) OVER (PARTITION BY {e}{S.K} ORDER BY time_index) AS d FROM {src}) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""


@query("mafd", f"WITH {S.PANEL} SELECT group_id, {q('mafd')} FROM {_mafd_sql('fast', 'panel')}")
def mafd(spark, sf):
    return M.mafd(P.event_panel(spark, sf), "fast").select(GROUP, r("mafd"))


def lag_ctes(name: str, method: str, src: str, keys: str = S.K) -> str:
    """CTE with signed lag, correlation, boundary and run widths per sequence."""
    lags = range(-MAX_LAG, MAX_LAG + 1)
    w = f"OVER (PARTITION BY {keys} ORDER BY time_index)"
    shifted = ", ".join(f"{'lead' if g >= 0 else 'lag'}({method}, {abs(g)}) {w} AS s{g + MAX_LAG}" for g in lags)
    # Correlations of constant inputs are null on both sides.
    corrs = ", ".join(
        f"CASE WHEN stddev_pop(CASE WHEN s{i} IS NOT NULL THEN target END) > 0 AND stddev_pop(s{i}) > 0 THEN corr(target, s{i}) END AS c{i}" for i in range(2 * MAX_LAG + 1))
    pairs = ", ".join(f"({g}, c{g + MAX_LAG})" for g in lags)
    return f"""{name}_s AS (SELECT {keys}, target, {shifted} FROM {src}),
{name}_c AS (SELECT {keys}, {corrs} FROM {name}_s GROUP BY {keys}),
{name}_l AS (SELECT {keys}, g, c, max(c) OVER (PARTITION BY {keys}) AS top FROM {name}_c, LATERAL (VALUES {pairs}) v(g, c)),
{name} AS (SELECT {keys}, top AS max_correlation,
  arg_min(g, abs(g) * 100 + g) FILTER (c = top) AS signed_lag,
  string_agg(CASE WHEN c >= top - 1e-6 THEN '1' ELSE '0' END, '' ORDER BY g) AS marks FROM {name}_l GROUP BY {keys}, top)"""


@query("cross_correlation_lag", f"""WITH {S.PANEL}, {lag_ctes('x', 'slow', 'panel')}
SELECT {S.K}, signed_lag, abs(signed_lag) AS absolute_lag, {q('max_correlation')}, abs(signed_lag) = {MAX_LAG} AS boundary_hit,
  len(regexp_extract_all(marks, '1+')) > 1 AS ambiguous FROM x""")
def cross_correlation_lag(spark, sf):
    d = M.xcorr_lag(P.event_panel(spark, sf), "slow", MAX_LAG)
    return d.select(*SEQUENCE, "signed_lag", "absolute_lag", r("max_correlation"), "boundary_hit", "ambiguous")


@query("lag_metric", f"""WITH {S.PANEL}, {lag_ctes('x', 'slow', 'panel')}, s AS (SELECT group_id, seed, median(abs(signed_lag)) AS l FROM x GROUP BY ALL)
SELECT group_id, {q('median(l)', 'absolute_lag')} FROM s GROUP BY group_id""")
def lag_metric(spark, sf):
    return M.lag_metric(M.xcorr_lag(P.event_panel(spark, sf), "slow", MAX_LAG)).select(GROUP, r("absolute_lag"))


@query("max_seed_delta", f"""WITH {S.PANEL}, d AS (SELECT group_id, seed, sqrt(avg(pow(target - slow, 2))) - sqrt(avg(pow(target - fast, 2))) AS d FROM panel GROUP BY ALL)
SELECT group_id, {q('max(d)', 'max_seed_rmse_delta')} FROM d GROUP BY group_id""")
def max_seed_delta(spark, sf):
    d = M.error_metrics(P.event_panel(spark, sf), "slow", [GROUP, SEED], baseline="fast")
    return M.max_seed_delta(d, [GROUP]).select(GROUP, r("max_seed_rmse_delta"))


@query("error_metrics", f"""WITH {S.PANEL} SELECT group_id, seed, {q('sqrt(avg(pow(target - slow, 2)))', 'rmse')}, {q('avg(abs(target - slow))', 'mae')},
  {q('corr(target, slow)', 'pcc')}, {q(UQ.CCC.format(c='slow'), 'ccc')},
  {q('sqrt(avg(pow(target - slow, 2))) - sqrt(avg(pow(target - fast, 2)))', 'rmse_delta')},
  {q(UQ.CCC.format(c='slow') + ' - ' + UQ.CCC.format(c='fast'), 'ccc_gain')} FROM panel GROUP BY group_id, seed""")
def error_metrics(spark, sf):
    d = M.error_metrics(P.event_panel(spark, sf), "slow", [GROUP, SEED], baseline="fast")
    return d.select(GROUP, SEED, *[r(c) for c in ("rmse", "mae", "pcc", "ccc", "rmse_delta", "ccc_gain")])


@query("ensemble_mean", f"WITH {S.PANEL} SELECT group_id, recording_id, time_index, {q('avg(fast)', 'prediction')}, count(*) AS members FROM panel GROUP BY ALL")
def ensemble_mean(spark, sf):
    d = P.event_panel(spark, sf).withColumnRenamed("fast", "prediction")
    return M.ensemble_mean(d, [GROUP, RECORDING, TIME]).select(GROUP, RECORDING, TIME, r("prediction"), "members")


GAINS = [i / 1000 for i in range(1001)]
_GRID = f"""gain AS MATERIALIZED (SELECT p.*, k::INTEGER AS gain_index, k / 1000.0::DOUBLE AS a FROM panel p, range(1001) g(k)),
{S.linear('gs', '@a', 'gain', S.K + ', gain_index, a', carry='target')},
obj AS MATERIALIZED (SELECT group_id, gain_index, a AS alpha, avg(x) AS rmse FROM (
  SELECT group_id, seed, gain_index, a, sqrt(avg(pow(target - state, 2))) AS x FROM gs GROUP BY ALL) GROUP BY ALL)"""


def gain_objective(spark, sf):
    p, n = _panel(spark, sf)
    return M.gain_grid_objective(p, GAINS, n)


@query("gain_grid_objective", f"WITH RECURSIVE {S.PANEL}, {_GRID} SELECT group_id, gain_index, {q('alpha')}, {q('rmse')} FROM obj")
def gain_grid_objective(spark, sf):
    return gain_objective(spark, sf).select(GROUP, "gain_index", r("alpha"), r("rmse"))


@query("select_gain", f"""WITH RECURSIVE {S.PANEL}, {_GRID}, m AS (SELECT alpha, avg(rmse) AS mean_rmse FROM obj GROUP BY alpha)
SELECT {q('alpha')}, {q('mean_rmse')} FROM m ORDER BY round(m.mean_rmse, 12), m.alpha LIMIT 1""")
def select_gain(spark, sf):
    return C.select_gain(gain_objective(spark, sf)).select(r("alpha"), r("mean_rmse"))


def outer_choices(spark, sf):
    """Per outer group: the gain with the lowest mean RMSE over all other groups."""
    p, n = _panel(spark, sf)
    return O.leave_group_out(cut(M.gain_grid_rows(p, GAINS, n)), "gain_index", "rmse")


_OUTER = """o AS (SELECT group_id AS outer_group, gain_index, ((sum(rmse) OVER (PARTITION BY gain_index)) - rmse) / ((count(*) OVER (PARTITION BY gain_index)) - 1) AS m FROM obj),
dev AS (SELECT a.group_id AS outer_group, count(*) FILTER (b.group_id <> a.group_id) AS development_rows FROM (SELECT DISTINCT group_id FROM obj) a, obj b GROUP BY 1)"""


@query("selection_lock", f"""WITH RECURSIVE {S.PANEL}, {_GRID}, {_OUTER}, c AS (SELECT outer_group, first(gain_index ORDER BY round(m, 10), gain_index) AS gain_index FROM o GROUP BY outer_group),
n AS (SELECT c.*, development_rows, 0::BIGINT AS outer_rows_used FROM c JOIN dev USING (outer_group))
SELECT *, sha256('{{"development_rows":' || development_rows || ',"gain_index":' || gain_index || ',"outer_group":' || outer_group || ',"outer_rows_used":0}}') AS lock_sha256 FROM n""")
def selection_lock(spark, sf):
    """Locks with the audit of the rows that entered each outer selection."""
    return O.lock(outer_choices(spark, sf))


# ------------------------------------------------------------------ candidates
EMAS = (0.05, 0.2, 0.4, 0.7, 1.0)
KALMANS = ((0.0103, 0.1), (0.001, 0.1), (0.01, 0.01), (0.01, 0.1), (0.0097, 0.1))
EMA_IDS = [f"ema_{int(a * 100):03d}" for a in EMAS]
KALMAN_IDS = [f"kalman_{i}" for i in range(len(KALMANS))]


def candidate_states(spark, sf):
    """EMA and fixed-Kalman candidates, each over every sequence."""
    p, n = _panel(spark, sf)
    keys = [*SEQUENCE, "candidate_id"]
    spec = [F.struct(F.lit(i).alias("candidate_id"), F.lit(a).alias("a"), F.lit(0.0).alias("kq"), F.lit(1.0).alias("kr")) for i, a in zip(EMA_IDS, EMAS)]
    e = p.select(*KT, "fast", "target", F.inline(F.array(*spec)))
    e = U.ema(e, F.col("a"), keys=keys, length=n, keep=["target"]).select(*keys, TIME, "target", "state")
    spec = [F.struct(F.lit(i).alias("candidate_id"), F.lit(a).alias("kq"), F.lit(b).alias("kr")) for i, (a, b) in zip(KALMAN_IDS, KALMANS)]
    k = p.select(*KT, "fast", "target", F.inline(F.array(*spec)))
    k = U.kalman_fixed(k, F.col("kq"), F.col("kr"), keys=keys, length=n, keep=["target"]).select(*keys, TIME, "target", "state")
    # Three metrics read the states, so they are kept as a stage table.
    return cut(e.unionByName(k).withColumn("family", F.split("candidate_id", "_")[0]))


def candidate_metrics(spark, sf, extra=("family", "candidate_id")):
    """RMSE, MAFD and lag of every candidate and group; states are written only where a sequence is longer than a chunk."""
    p, n = _panel(spark, sf)
    if n > B.CHUNK:
        return M.subject_metrics(candidate_states(spark, sf), "state", MAX_LAG, list(extra))
    names = F.array(*[F.lit(i) for i in EMA_IDS + KALMAN_IDS])
    rows = M.candidate_recordings(p, EMAS, KALMANS, MAX_LAG).withColumn("candidate_id", F.element_at(names, F.col("place") + 1))
    return M.recording_metrics(cut(rows.withColumn("family", F.split("candidate_id", "_")[0]).drop("place")), list(extra))


def candidate_summary(spark, sf):
    per_group = candidate_metrics(spark, sf)
    return M.summarize_candidates(per_group, ["family", "candidate_id"])


_EMA_VALUES = ", ".join(f"('{i}', {a}::DOUBLE)" for i, a in zip(EMA_IDS, EMAS))
_KAL_VALUES = ", ".join(f"('{i}', {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in zip(KALMAN_IDS, KALMANS))
CK = S.K + ", candidate_id"
SUMMARY = f"""{S.PANEL},
ep AS MATERIALIZED (SELECT p.*, candidate_id, a FROM panel p, (VALUES {_EMA_VALUES}) v(candidate_id, a)),
{S.linear('es', '@a', 'ep', CK, start='fast', carry='target')},
kp AS MATERIALIZED (SELECT p.*, candidate_id, kq, kr FROM panel p, (VALUES {_KAL_VALUES}) v(candidate_id, kq, kr)),
ks AS (SELECT {CK}, time_index, target, fast AS state, 1.0::DOUBLE AS variance FROM kp WHERE time_index = 0
  UNION ALL SELECT {CK}, time_index, target, m + g * (fast - m), (1 - g) * prior FROM (
    SELECT p.group_id, p.seed, p.recording_id, p.candidate_id, p.time_index, p.target, p.fast, k.state AS m, k.variance + kq AS prior,
      (k.variance + kq) / (k.variance + kq + kr) AS g
    FROM ks k JOIN kp p ON {S.same('p', 'k', CK)} AND p.time_index = k.time_index + 1)),
st AS MATERIALIZED (SELECT {CK}, time_index, target, state FROM es UNION ALL SELECT {CK}, time_index, target, state FROM ks),
{lag_ctes('x', 'state', 'st', CK)},
lg AS (SELECT candidate_id, group_id, median(l) AS absolute_lag FROM (
  SELECT candidate_id, group_id, seed, median(abs(signed_lag)) AS l FROM x GROUP BY ALL) GROUP BY ALL),
gm AS MATERIALIZED (SELECT candidate_id, group_id, rmse, mafd, absolute_lag FROM {_rmse_sql('state', 'st', 'candidate_id')}
  JOIN {_mafd_sql('state', 'st', 'candidate_id')} USING (candidate_id, group_id) LEFT JOIN lg USING (candidate_id, group_id)),
summary AS MATERIALIZED (SELECT split_part(candidate_id, '_', 1) AS family, candidate_id, count(*) AS group_count, avg(rmse) AS mean_rmse,
  stddev_samp(rmse) / sqrt(count(*)) AS rmse_se, median(absolute_lag) AS median_absolute_lag, median(mafd) AS median_mafd FROM gm GROUP BY ALL),
pool AS (SELECT s.*, b.mean_rmse + b.rmse_se AS threshold FROM summary s,
  (SELECT mean_rmse, rmse_se FROM summary ORDER BY mean_rmse, candidate_id LIMIT 1) b WHERE s.mean_rmse <= b.mean_rmse + b.rmse_se)"""


#: What a nested lock covers, in the order of its JSON.
LOCKED = ("best_candidate", "best_ema", "best_kalman", "development_rows", "fast_candidate", "median_absolute_lag_match", "median_mafd_match", "outer_group", "outer_rows_used", "slow_candidate")
_LOCK = " || ',' || ".join(
    f"""'"{c}":' || {c}""" if c in ("development_rows", "outer_group", "outer_rows_used") else f"""'"{c}":"' || {c} || '"'""" for c in LOCKED)
NESTED_SQL = f"""WITH RECURSIVE {SUMMARY},
os AS MATERIALIZED (SELECT o.group_id AS outer_group, split_part(candidate_id, '_', 1) AS family, candidate_id, round(avg(rmse), 9) AS mean_rmse,
  round(stddev_samp(rmse) / sqrt(count(*)), 9) AS rmse_se, round(median(absolute_lag), 9) AS lag, round(median(mafd), 9) AS mafd, count(*) AS n
  FROM (SELECT DISTINCT group_id FROM gm) o JOIN gm ON gm.group_id <> o.group_id GROUP BY ALL),
best AS (SELECT *, mean_rmse + rmse_se AS threshold FROM os QUALIFY row_number() OVER (PARTITION BY outer_group ORDER BY mean_rmse, candidate_id) = 1),
pl AS (SELECT os.*, threshold FROM os JOIN best USING (outer_group) WHERE os.mean_rmse <= threshold),
fa AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY outer_group ORDER BY lag NULLS LAST, mean_rmse, candidate_id) = 1),
sl AS (SELECT pl.* FROM pl JOIN fa ON fa.outer_group = pl.outer_group AND fa.candidate_id <> pl.candidate_id
  QUALIFY row_number() OVER (PARTITION BY pl.outer_group ORDER BY pl.mafd, pl.mean_rmse, pl.candidate_id) = 1),
fam AS (SELECT * FROM os QUALIFY row_number() OVER (PARTITION BY outer_group, family ORDER BY mean_rmse, lag NULLS LAST, mafd, candidate_id) = 1),
near AS (SELECT a.outer_group, a.candidate_id, a.mean_rmse, round(abs(a.mafd - b.mafd), 9) AS dm, round(abs(a.lag - b.lag), 9) AS dl, b.mafd AS rm
  FROM os a JOIN os b ON a.outer_group = b.outer_group AND a.family = 'ema' AND b.candidate_id = 'kalman_1'),
nm AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY outer_group ORDER BY dm NULLS LAST, mean_rmse, candidate_id) = 1),
nl AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY outer_group ORDER BY dl NULLS LAST, mean_rmse, candidate_id) = 1),
dv AS (SELECT outer_group, sum(n)::BIGINT AS development_rows FROM os GROUP BY outer_group), pz AS (SELECT outer_group, count(*) AS pool_size FROM pl GROUP BY outer_group)
SELECT *, sha256('{{' || {_LOCK} || '}}') AS lock_sha256 FROM (
SELECT outer_group, best.candidate_id AS best_candidate, {q('best.threshold', 'threshold')}, pool_size::INTEGER AS pool_size, pool_size >= 2 AS pool_ok,
  fa.candidate_id AS fast_candidate, sl.candidate_id AS slow_candidate, e.candidate_id AS best_ema, k.candidate_id AS best_kalman,
  nm.candidate_id AS median_mafd_match, nm.dm <= 0.1 * greatest(abs(nm.rm), 1e-12) AS median_mafd_within,
  nl.candidate_id AS median_absolute_lag_match, nl.dl <= 0.5 AS median_absolute_lag_within, development_rows, 0::BIGINT AS outer_rows_used
FROM best JOIN pz USING (outer_group) JOIN fa USING (outer_group) LEFT JOIN sl USING (outer_group) JOIN nm USING (outer_group) JOIN nl USING (outer_group) JOIN dv USING (outer_group)
JOIN fam e ON e.outer_group = best.outer_group AND e.family = 'ema' JOIN fam k ON k.outer_group = best.outer_group AND k.family = 'kalman')"""


@query("nested_selection", NESTED_SQL)
def nested_selection(spark, sf):
    """Pool, roles and matched points of every outer group, each over all other groups."""
    per_group = candidate_metrics(spark, sf)
    d = N.outer_choices(N.outer_summaries(per_group), 2, ("ema", "kalman"), "kalman_1", matched_family="ema")
    return d.withColumn("threshold", r("threshold")).withColumn("lock_sha256", O.fingerprint_of(*LOCKED))


@query("group_metrics", f"WITH RECURSIVE {SUMMARY} SELECT candidate_id, group_id, {q('rmse')}, {q('mafd')}, {q('absolute_lag')} FROM gm")
def group_metrics(spark, sf):
    d = candidate_metrics(spark, sf, ["candidate_id"])
    return d.select("candidate_id", GROUP, r("rmse"), r("mafd"), r("absolute_lag"))


_SUM = ("mean_rmse", "rmse_se", "median_absolute_lag", "median_mafd")


@query("candidate_summary", f"WITH RECURSIVE {SUMMARY} SELECT family, candidate_id, group_count, {', '.join(q(c) for c in _SUM)} FROM summary")
def summary(spark, sf):
    return candidate_summary(spark, sf).select("family", "candidate_id", "group_count", *[r(c) for c in _SUM])


@query("one_se_pool", f"""WITH RECURSIVE {SUMMARY} SELECT candidate_id, {q('mean_rmse')}, {q('threshold')}, count(*) OVER () AS pool_size,
  count(*) OVER () >= 2 AS pool_ok FROM pool""")
def one_se_pool(spark, sf):
    d = C.one_se_pool(candidate_summary(spark, sf))
    return d.select("candidate_id", r("mean_rmse"), r("threshold"), "pool_size", "pool_ok")


@query("role_pick", f"""WITH RECURSIVE {SUMMARY}, f AS (SELECT * FROM pool ORDER BY median_absolute_lag, mean_rmse, candidate_id LIMIT 1),
s AS (SELECT * FROM pool WHERE candidate_id <> (SELECT candidate_id FROM f) ORDER BY median_mafd, mean_rmse, candidate_id LIMIT 1)
SELECT 'fast' AS role, candidate_id, {q('mean_rmse')} FROM f UNION ALL SELECT 'slow', candidate_id, {q('mean_rmse')} FROM s""")
def role_pick(spark, sf):
    d = C.pick_roles(C.one_se_pool(candidate_summary(spark, sf)))
    return d.select("role", "candidate_id", r("mean_rmse"))


@query("best_operating_point", f"""WITH RECURSIVE {SUMMARY}, o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean_rmse, median_absolute_lag, median_mafd, candidate_id) AS n FROM summary)
SELECT family, candidate_id, {q('mean_rmse')} FROM o WHERE n = 1""")
def best_operating_point(spark, sf):
    return C.best_operating_point(candidate_summary(spark, sf)).select("family", "candidate_id", r("mean_rmse"))


def _match_sql(metric: str, tol: float, relative: bool) -> str:
    d = f"abs(s.{metric} - b.{metric})"
    judged = f"dist / greatest(abs(ref), 1e-12) <= {tol}" if relative else f"dist <= {tol}"
    return f"""SELECT '{metric}' AS matched_on, family, candidate_id, {q('dist', 'absolute_distance')}, {q('dist / greatest(abs(ref), 1e-12)', 'relative_distance')}, {judged} AS within_tolerance
FROM (SELECT s.*, b.{metric} AS ref, {d} AS dist, row_number() OVER (PARTITION BY s.family ORDER BY {d}, s.mean_rmse, s.candidate_id) AS n
  FROM (SELECT * FROM summary WHERE family = 'ema') s, (SELECT * FROM summary WHERE candidate_id = 'kalman_1') b) WHERE n = 1"""


@query("matched_operating_points", f"WITH RECURSIVE {SUMMARY} {_match_sql('median_mafd', 0.1, True)} UNION ALL {_match_sql('median_absolute_lag', 0.5, False)}")
def matched_operating_points(spark, sf):
    s = candidate_summary(spark, sf)
    ref, pool = s.where("candidate_id = 'kalman_1'"), s.where("family = 'ema'")
    parts = []
    for metric, tol, rel in (("median_mafd", 0.1, True), ("median_absolute_lag", 0.5, False)):
        d = C.match_operating_point(pool, ref, metric, tol, rel)
        parts.append(d.select(F.lit(metric).alias("matched_on"), "family", "candidate_id", r("absolute_distance"), r("relative_distance"), "within_tolerance"))
    return parts[0].unionByName(parts[1])


@query("selected_methods", f"""WITH RECURSIVE {SUMMARY}, o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean_rmse, median_absolute_lag, median_mafd, candidate_id) AS n FROM summary)
SELECT family, 'best_rmse' AS role, candidate_id, v.a AS alpha, w.kq AS q, w.kr AS r FROM o LEFT JOIN (VALUES {_EMA_VALUES}) v(candidate_id, a) USING (candidate_id)
LEFT JOIN (VALUES {_KAL_VALUES}) w(candidate_id, kq, kr) USING (candidate_id) WHERE n = 1""")
def selected_methods(spark, sf):
    best = C.best_operating_point(candidate_summary(spark, sf)).withColumn("role", F.lit("best_rmse"))
    ids = {i: f'{{"alpha": {a}}}' for i, a in zip(EMA_IDS, EMAS)} | {i: f'{{"q": {a}, "r": {b}}}' for i, (a, b) in zip(KALMAN_IDS, KALMANS)}
    params = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return C.selected_methods(best.withColumn("parameters", params[F.col("candidate_id")]))


@query("tracker_ranking", UQ.GRID_SQL + f""",
m AS (SELECT config, sqrt(avg(pow(target - state, 2))) AS rmse, {UQ.CCC.format(c='state')} AS ccc FROM full_ GROUP BY config),
e AS (SELECT config, rmse, ccc, rmse <= (SELECT avg(rmse) FROM m) AS eligible, rmse - 0.1::DOUBLE * ccc AS selection_score FROM m),
k AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, selection_score, rmse, ccc DESC, config) AS rank FROM e)
SELECT config, rank::INTEGER AS rank, eligible, rank = 1 AND eligible AS winner, {q('selection_score')} FROM k""")
def tracker_ranking(spark, sf):
    m = M.error_metrics(UQ.grid_states(spark, sf), "state", ["config"])
    m = C.with_totals(m, (), {"_mean": F.avg("rmse")})
    d = C.rank_candidates(m, (), F.col("rmse") <= F.col("_mean"), F.col("rmse") - 0.1 * F.col("ccc"), "config")
    return d.select("config", "rank", "eligible", "winner", r("selection_score"))


@query("canonical_order", f"WITH {S.PANEL} SELECT {S.KT}, {q('fast')} FROM panel ORDER BY {S.KT}")
def canonical_order(spark, sf):
    return C.order_canonical(P.event_panel(spark, sf), KT).select(*KT, r("fast"))


@query("leave_one_out", f"""WITH {S.PANEL}, v AS (SELECT group_id, avg(fast - slow) AS x FROM panel GROUP BY group_id),
t AS (SELECT group_id, (sum(x) OVER () - x) / (count(*) OVER () - 1) AS m, avg(x) OVER () AS a FROM v)
SELECT group_id, {q('m', 'mean_without', 9)}, CASE WHEN m > 1e-12 THEN '+' WHEN m < -1e-12 THEN '−' ELSE '0' END AS direction,
  sign(m) <> sign(a) AS direction_changed FROM t""")
def leave_one_out(spark, sf):
    v = P.event_panel(spark, sf).groupBy(GROUP).agg(F.avg(F.col("fast") - F.col("slow")).alias("x"))
    return C.leave_one_out(v, "x").select(GROUP, r("mean_without", 9), "direction", "direction_changed")
