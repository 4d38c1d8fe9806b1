"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from statistics import NormalDist

from panelseq.functions import normal

SEQ = """seq AS MATERIALIZED (
  SELECT user_id AS group_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS recording_id, value,
    row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2024-01-16' ORDER BY ts, event_id) - 1 AS time_index
  FROM events)"""

PANEL = SEQ + """,
panel AS MATERIALIZED (
  SELECT group_id, seed, recording_id, time_index, value / (value + c) AS fast,
    avg(value / (value + c)) OVER (PARTITION BY group_id, recording_id, seed ORDER BY time_index ROWS 9 PRECEDING) AS slow,
    avg(value / (value + 50)) OVER (PARTITION BY group_id, recording_id, seed ORDER BY time_index ROWS 4 PRECEDING) AS target
  FROM seq, (VALUES (42, 40.0::DOUBLE), (123, 50.0::DOUBLE), (2026, 60.0::DOUBLE)) AS curves(seed, c))"""

K = "group_id, seed, recording_id"
KT = K + ", time_index"


def same(a: str, b: str, cols: str = K) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in cols.split(","))


def linear(name: str, gain: str, src: str = "panel", keys: str = K, start: str = "slow", carry: str = "") -> str:
    """Recursive CTE of the linear update over ``src`` with gain expression ``gain``."""
    extra = f", {carry}" if carry else ""
    pk = ", ".join(f"p.{c.strip()}" for c in (keys + ", time_index" + extra).split(","))
    g0, g1 = gain.replace("@", ""), gain.replace("@", "p.")
    return f"""{name} AS (
  SELECT {keys}, time_index{extra}, ({g0}) * fast + (1 - ({g0})) * {start} AS state FROM {src} WHERE time_index = 0
  UNION ALL
  SELECT {pk}, ({g1}) * p.fast + (1 - ({g1})) * t.state
  FROM {name} t JOIN {src} p ON {same('p', 't', keys)} AND p.time_index = t.time_index + 1)"""


def context(name: str = "ctx", src: str = "panel", keys: str = K, order: str = "time_index", value: str = "fast", k: int = 10, carry: str = "slow, target") -> str:
    extra = f", {carry}" if carry else ""
    w = f"PARTITION BY {keys} ORDER BY {order}"
    past = f"OVER ({w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    less = f"OVER ({w} ROWS BETWEEN {k - 1} PRECEDING AND 1 PRECEDING)"
    return f"""{name}_d AS (
  SELECT *, {value} - lag({value}) OVER ({w}) AS step FROM {src}),
{name} AS MATERIALIZED (
  SELECT {keys}, {order}, {value}{extra},
    CASE WHEN count({value}) {past} >= 2 THEN regr_slope({value}, {order}) {past} ELSE 0 END AS past_slope,
    CASE WHEN count({value}) {past} >= 2 THEN coalesce(abs(avg(CASE WHEN abs(step) > 1e-12 THEN sign(step) END) {less}), 0) ELSE 0 END AS past_consistency,
    CASE WHEN count({value}) {past} >= 2 THEN var_pop({value}) {past} ELSE 0 END AS past_variance
  FROM {name}_d)"""


DEFAULTS = dict(
    innovation_scale=0.08, disagreement_scale=0.08, slope_scale=0.025, variance_scale=0.01, temperature=0.75,
    outlier_bias=0.0, stable_bias=0.0, transition_bias=0.0, alpha_outlier=0.04, alpha_stable=0.20, alpha_transition=0.75)


def tracker_body(src: str, keep: str, **over) -> str:
    """Nested selects from (fast, slow, prev, past_*) to the tracker's outputs.

    A parameter may be a number or the name of a column of ``src``.
    """
    p = {k: (v if isinstance(v, str) else f"{v}::DOUBLE") for k, v in {**DEFAULTS, **over}.items()}
    return f"""SELECT {keep}, fast, slow, prev, innovation, gap, past_slope, past_consistency, past_variance, agree, so, ss, st,
    e1 / (e1 + e2 + e3) AS p1, e2 / (e1 + e2 + e3) AS p2, e3 / (e1 + e2 + e3) AS p3,
    (e1 * {p['alpha_outlier']} + e2 * {p['alpha_stable']} + e3 * {p['alpha_transition']}) / (e1 + e2 + e3) AS alpha,
    least(1, greatest(0, (e1 * {p['alpha_outlier']} + e2 * {p['alpha_stable']} + e3 * {p['alpha_transition']}) / (e1 + e2 + e3) * fast
      + (1 - (e1 * {p['alpha_outlier']} + e2 * {p['alpha_stable']} + e3 * {p['alpha_transition']}) / (e1 + e2 + e3)) * prev)) AS state
  FROM (SELECT *, exp((so - greatest(so, ss, st)) / {p['temperature']}) AS e1, exp((ss - greatest(so, ss, st)) / {p['temperature']}) AS e2,
      exp((st - greatest(so, ss, st)) / {p['temperature']}) AS e3
    FROM (SELECT *,
        {p['outlier_bias']} + 1.6::DOUBLE * qi + 1.2::DOUBLE * qd + 1.1::DOUBLE * (1 - past_consistency) + 1.1::DOUBLE * (1 - agree) + 0.5::DOUBLE * qv - 0.4::DOUBLE * qs AS so,
        {p['stable_bias']} + 1.5::DOUBLE * (1 - qi) + (1 - qd) + 0.8::DOUBLE * (1 - qs) + 0.8::DOUBLE * (1 - qv) + 0.3::DOUBLE * past_consistency AS ss,
        {p['transition_bias']} + 1.4::DOUBLE * qi + 1.1::DOUBLE * qd + qs + past_consistency + 1.2::DOUBLE * agree - 0.5::DOUBLE * qv AS st
      FROM (SELECT *, 1 - exp(-abs(innovation) / {p['innovation_scale']}) AS qi, 1 - exp(-abs(gap) / {p['disagreement_scale']}) AS qd,
          1 - exp(-abs(past_slope) / {p['slope_scale']}) AS qs, 1 - exp(-greatest(past_variance, 0) / {p['variance_scale']}) AS qv,
          CASE WHEN abs(past_slope) <= 1e-12 OR abs(innovation) <= 1e-12 THEN 0.5::DOUBLE
            WHEN sign(past_slope) = sign(innovation) THEN 1::DOUBLE ELSE 0::DOUBLE END AS agree
        FROM (SELECT *, fast - prev AS innovation, fast - slow AS gap FROM ({src})))))"""


def tracker(name: str = "full_", ctx: str = "ctx", keys: str = K, carry: str = "target", **over) -> str:
    extra = f", {carry}" if carry else ""
    keep = f"{keys}, time_index{extra}"
    return f"""{name} AS (
  {tracker_body(f'SELECT *, slow AS prev FROM {ctx} WHERE time_index = 0', keep, **over)}
  UNION ALL
  {tracker_body(f'SELECT c.*, t.state AS prev FROM {name} t JOIN {ctx} c ON {same("c", "t", keys)} AND c.time_index = t.time_index + 1', keep, **over)})"""


ADAPTIVE = f"""kal AS (
  SELECT {KT}, fast, target, slow AS mean0, 1.0::DOUBLE AS p0, 0.01::DOUBLE AS r0,
    slow + (1.0001::DOUBLE / (1.0001::DOUBLE + 0.01)) * (fast - slow) AS state,
    1.0001::DOUBLE / (1.0001::DOUBLE + 0.01) AS gain,
    (1 - 1.0001::DOUBLE / (1.0001::DOUBLE + 0.01)) * 1.0001 AS covariance,
    0.01::DOUBLE AS r_used, 0.01::DOUBLE AS r_after, fast - slow AS innovation
  FROM panel WHERE time_index = 0
  UNION ALL
  SELECT {KT}, fast, target, mean0, p0, r0, mean0 + g * (fast - mean0), g, greatest(0, (1 - g) * (p0 + 0.0001)), r0,
    CASE WHEN time_index + 1 > 10 THEN least(1, greatest(0.000001, 0.95 * r0 + 0.05 * pow(least(1, greatest(-1, fast - mean0)), 2))) ELSE r0 END,
    fast - mean0
  FROM (SELECT p.group_id, p.seed, p.recording_id, p.time_index, p.fast, p.target, k.state AS mean0, k.covariance AS p0, k.r_after AS r0,
      (k.covariance + 0.0001::DOUBLE) / (k.covariance + 0.0001::DOUBLE + k.r_after) AS g
    FROM kal k JOIN panel p ON {same('p', 'k')} AND p.time_index = k.time_index + 1))"""

SPATIAL = """e AS (SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS time_index, embedding FROM embeddings),
cells AS MATERIALIZED (
  SELECT recording_id, time_index, pos, pos // 4 AS channel, pos % 4 AS band, value,
    pos // 16 AS channel2, (pos % 16) // 4 AS group2, pos % 16 AS bin2
  FROM (SELECT recording_id, time_index, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS value FROM e))"""


def bca(source: str, key: str, prefix: str = "bc", seed: int = 20260905, resamples: int = 10_000) -> str:
    """CTEs ending in ``{prefix}`` (key, estimate, lower_, upper_, n, acceleration) from ``source`` (key, group_id, value)."""
    p = prefix
    tails = [NormalDist().inv_cdf(x) for x in ((1 - 0.95) / 2, 1 - (1 - 0.95) / 2)]
    at = "(list_extract(means, floor({x})::BIGINT + 1) + (list_extract(means, ceil({x})::BIGINT + 1) - list_extract(means, floor({x})::BIGINT + 1)) * ({x} - floor({x})))"
    return f"""{p}_v AS MATERIALIZED (SELECT {key}, dense_rank() OVER (ORDER BY {key}) AS bk, value, row_number() OVER (PARTITION BY {key} ORDER BY md5(group_id::VARCHAR), group_id) - 1 AS idx, count(*) OVER (PARTITION BY {key}) AS n
  FROM {source} WHERE value IS NOT NULL),
{p}_m AS MATERIALIZED (SELECT bk, count(*) AS n, avg(value) AS estimate, max(value) > min(value) AS varies, min(value) AS low, max(value) AS high, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM {p}_v GROUP BY bk),
{p}_a AS (SELECT bk, sum(pow(value - estimate, 3)) / (6 * pow(sum(pow(value - estimate, 2)), 1.5)) AS acceleration FROM {p}_v JOIN {p}_m USING (bk) GROUP BY bk),
{p}_l AS MATERIALIZED (SELECT bk, any_value(n) AS n, list(value ORDER BY idx) AS vals FROM {p}_v GROUP BY bk),
{p}_d AS (SELECT bk, b, list_avg(list_transform(range(n), lambda i: vals[('0x' || substr(md5('{seed}:' || b || ':' || i), 1, 8))::BIGINT % n + 1])) AS m
  FROM {p}_l, range({resamples}) t(b)),
{p}_s AS (SELECT bk, avg(CASE WHEN abs(m - estimate) <= 1e-15 THEN 0.5 WHEN m < estimate THEN 1.0 ELSE 0.0 END) AS share, list(m ORDER BY m) AS means
  FROM {p}_d JOIN {p}_m USING (bk) GROUP BY bk),
{p}_f AS (SELECT *, {normal.sql_first_inverse('share')} AS x FROM {p}_s JOIN {p}_m USING (bk) JOIN {p}_a USING (bk) WHERE varies AND share > 0 AND share < 1),
{p}_z AS (SELECT *, {normal.sql_refined('x', 'share')} AS z0 FROM {p}_f),
{p}_t AS (SELECT *, z0 + (z0 + {tails[0]!r}) / (1 - acceleration * (z0 + {tails[0]!r})) AS tl, z0 + (z0 + {tails[1]!r}) / (1 - acceleration * (z0 + {tails[1]!r})) AS tu FROM {p}_z),
{p}_p AS (SELECT *, {normal.sql_cdf('tl')} * {resamples - 1} AS pl, {normal.sql_cdf('tu')} * {resamples - 1} AS pu FROM {p}_t),
{p} AS MATERIALIZED (SELECT x.{key}, m.estimate, m.n, a.acceleration, {at.format(x='pl')} AS lower_, {at.format(x='pu')} AS upper_, (m.estimate * m.n - m.high) / (m.n - 1) AS leave_out_low,
  (m.estimate * m.n - m.low) / (m.n - 1) AS leave_out_high, m.q1, m.med, m.q3 FROM {p}_m m JOIN (SELECT DISTINCT bk, {key} FROM {p}_v) x USING (bk) JOIN {p}_a a USING (bk) LEFT JOIN {p}_p p USING (bk))"""
