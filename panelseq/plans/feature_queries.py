"""Feature queries over the events and embeddings panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEQUENCE, TIME
from panelseq.operators import blocks as B
from panelseq.operators import features as X
from panelseq.operators import updaters as U
from panelseq.plans import panels as P
from panelseq.plans import sql_parts as S
from panelseq.plans.registry import q, query, r

REC = [RECORDING, TIME]
UNIT = [GROUP, RECORDING]


def _entries(df, array, name, index):
    return df.select(*REC, F.posexplode(array).alias(index, "_x")).select(*REC, F.col(index), r("_x", name=name))


@query("band_mean", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, band::INTEGER AS band, {q('avg(value)', 'band_mean')}
FROM cells GROUP BY recording_id, time_index, band""")
def band_mean(spark, sf):
    return _entries(X.band_mean(P.spatial_rows(spark, sf), "values", 16, 4), "band_mean", "band_mean", "band")


@query("grouped_bin_mean", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, group2::INTEGER AS bin_group, {q('avg(value)', 'group_mean')}
FROM cells GROUP BY recording_id, time_index, group2""")
def grouped_bin_mean(spark, sf):
    return _entries(X.grouped_bin_mean(P.spatial_rows(spark, sf), "values", 4, 16, 4), "group_mean", "group_mean", "bin_group")


@query("robust_stats", f"""WITH {S.SPATIAL},
m AS (SELECT recording_id, time_index, band, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25,
  quantile_cont(value, 0.75) AS q75 FROM cells GROUP BY ALL),
d AS (SELECT recording_id, time_index, band, quantile_cont(abs(value - median), 0.5) AS mad
  FROM cells JOIN m USING (recording_id, time_index, band) GROUP BY ALL)
SELECT recording_id, time_index, band::INTEGER AS band, {q('median')}, {q('mad')}, {q('q25')}, {q('q75')}, {q('q75 - q25', 'iqr')}
FROM m JOIN d USING (recording_id, time_index, band)""")
def robust_stats(spark, sf):
    stats = ("median", "mad", "q25", "q75", "iqr")
    d = X.robust_stats(P.spatial_rows(spark, sf), "values", 16, 4)
    return d.select(*REC, F.posexplode(F.arrays_zip(*stats)).alias("band", "_s")).select(
        *REC, "band", *[r(F.col("_s")[s], name=s) for s in stats])


@query("log_energy", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, band::INTEGER AS band, {q('ln(1 + avg(value * value))', 'log_energy')}
FROM cells GROUP BY recording_id, time_index, band""")
def log_energy(spark, sf):
    return _entries(X.log_energy(P.spatial_rows(spark, sf), "values", 16, 4), "log_energy", "log_energy", "band")


@query("cross_view", f"""WITH {S.SPATIAL},
a AS (SELECT recording_id, time_index, band AS b, avg(value) AS x FROM cells GROUP BY ALL),
g AS (SELECT recording_id, time_index, group2 AS b, avg(value * value) AS y FROM cells GROUP BY ALL)
SELECT recording_id, time_index, b::INTEGER AS band, {q('x - y', 'cross_view')} FROM a JOIN g USING (recording_id, time_index, b)""")
def cross_view(spark, sf):
    d = X.band_mean(P.spatial_rows(spark, sf), "values", 16, 4).withColumn("two", F.transform("values", lambda x: x * x))
    d = X.cross_view(X.grouped_bin_mean(d, "two", 4, 16, 4))
    return _entries(d, "cross_view", "cross_view", "band")


@query("channel_mean", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, channel::INTEGER AS channel, {q('avg(value)', 'channel_mean')}
FROM cells GROUP BY recording_id, time_index, channel""")
def channel_mean(spark, sf):
    return _entries(X.channel_mean(P.spatial_rows(spark, sf), "values", 16, 4), "channel_mean", "channel_mean", "channel")


@query("global_energy", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, {q('avg(abs(value))', 'global_energy')}
FROM cells GROUP BY recording_id, time_index""")
def global_energy(spark, sf):
    return X.global_energy(P.spatial_rows(spark, sf), "values").select(*REC, r("global_energy"))


def _holed(spark, sf):
    """embeddings with values above 0.2 made NaN, so missing-value rules have work."""
    return P.spatial_rows(spark, sf).withColumn(
        "values", F.transform("values", lambda x: F.when(x > 0.2, float("nan")).otherwise(x)))


@query("missing_rate", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, channel::INTEGER AS channel,
  {q('avg(CASE WHEN value > 0.2 THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM cells GROUP BY recording_id, time_index, channel""")
def missing_rate(spark, sf):
    return _entries(X.missing_rate(_holed(spark, sf), "values", 16, 4), "missing_rate", "missing_rate", "channel")


@query("current_features", f"""WITH {S.SPATIAL} SELECT recording_id, time_index, {', '.join(
    q(f'max(CASE WHEN channel = {c} AND band = {b} THEN value END)', f'current_c{c}_f{b}') for c in range(16) for b in range(4))}
FROM cells GROUP BY recording_id, time_index""")
def current_features(spark, sf):
    d = X.flatten(P.spatial_rows(spark, sf), "values", 16, 4)
    return d.select(*REC, *[r(f"current_c{c}_f{b}") for c in range(16) for b in range(4)])


_ROLL = [f"fast_w{k}_{s}" for k in X.WINDOWS for s in ("mean", "std", "slope", "deviation")]
_WIN = "OVER (PARTITION BY group_id, recording_id ORDER BY time_index ROWS {n} PRECEDING)"


def _roll_sql(col: str, k: int) -> str:
    w = _WIN.format(n=k - 1)
    return (
        f"avg({col}) {w} AS {col}_w{k}_mean, stddev_pop({col}) {w} AS {col}_w{k}_std, "
        f"CASE WHEN time_index = 0 THEN 0 ELSE regr_slope({col}, time_index) {w} END AS {col}_w{k}_slope")


def _dev_sql(col: str, k: int) -> str:
    return (f"({col} - {col}_w{k}_mean) / CASE WHEN {col}_w{k}_std > 1e-8 THEN {col}_w{k}_std ELSE 1 END")


def _fast_seq(spark, sf):
    return P.event_sequences(spark, sf).select(*UNIT, TIME, (F.col("value") / (F.col("value") + 50.0)).alias("fast"))


_FAST = f"{S.SEQ}, f AS (SELECT group_id, recording_id, time_index, value / (value + 50) AS fast FROM seq)"


@query("rolling_stats", f"""WITH {_FAST}, w AS (SELECT *, {', '.join(_roll_sql('fast', k) for k in X.WINDOWS)} FROM f)
SELECT group_id, recording_id, time_index, {', '.join(
    [q(f'fast_w{k}_{s}') for k in X.WINDOWS for s in ('mean', 'std', 'slope')]
    + [q(_dev_sql('fast', k), f'fast_w{k}_deviation') for k in X.WINDOWS])} FROM w""")
def rolling_stats(spark, sf):
    d = X.rolling_stats(_fast_seq(spark, sf), ["fast"], keys=UNIT)
    return d.select(*UNIT, TIME, *[r(c) for c in _ROLL])


def _pattern_sql(col: str, k: int, part: str = "group_id, recording_id") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY time_index ROWS {k - 2} PRECEDING)"
    return (
        f"CASE WHEN time_index >= 2 AND stddev_pop(later) {w} > 1e-8 AND stddev_pop(prev) {w} > 1e-8 THEN corr(prev, later) {w} ELSE 0 END AS {col}_w{k}_autocorrelation, "
        f"coalesce(abs(avg(sign({col} - prev)) {w}), 0) AS {col}_w{k}_trend_consistency")


_PATTERN = [f"fast_w{k}_{s}" for k in X.WINDOWS for s in ("autocorrelation", "trend_consistency")]


@query("temporal_pattern", f"""WITH {_FAST}, p AS (SELECT *, lag(fast) OVER (PARTITION BY group_id, recording_id ORDER BY time_index) AS prev,
  CASE WHEN time_index > 0 THEN fast END AS later FROM f), w AS (SELECT *, {', '.join(_pattern_sql('fast', k) for k in X.WINDOWS)} FROM p)
SELECT group_id, recording_id, time_index, {', '.join(q(c) for c in _PATTERN)} FROM w""")
def temporal_pattern(spark, sf):
    return X.temporal_pattern(_fast_seq(spark, sf), "fast", keys=UNIT).select(*UNIT, TIME, *[r(c) for c in _PATTERN])


@query("differences", f"""WITH {_FAST}, d AS (SELECT *, coalesce(fast - lag(fast) OVER w, 0) AS d1 FROM f WINDOW w AS (PARTITION BY group_id, recording_id ORDER BY time_index))
SELECT group_id, recording_id, time_index, {q('d1', 'fast_d1')}, {q('CASE WHEN time_index = 0 THEN 0 ELSE d1 - lag(d1) OVER (PARTITION BY group_id, recording_id ORDER BY time_index) END', 'fast_d2')} FROM d""")
def differences(spark, sf):
    return X.differences(_fast_seq(spark, sf), "fast", keys=UNIT).select(*UNIT, TIME, r("fast_d1"), r("fast_d2"))


@query("past_context", f"""WITH {S.PANEL}, {S.context()} SELECT {S.KT}, {q('past_slope')}, {q('past_consistency')}, {q('past_variance')} FROM ctx""")
def past_context(spark, sf):
    d = U.past_context(P.event_panel(spark, sf), 10)
    return d.select(*SEQUENCE, TIME, r("past_slope"), r("past_consistency"), r("past_variance"))


_BODY = S.tracker_body("SELECT *, slow AS prev FROM ctx", S.KT)


@query("score_states", f"""WITH {S.PANEL}, {S.context()}, b AS ({_BODY})
SELECT {S.KT}, {q('so', 'score_outlier')}, {q('ss', 'score_stable')}, {q('st', 'score_transition')}, {q('p1', 'p_outlier')}, {q('p2', 'p_stable')},
  {q('p3', 'p_transition')}, {q('alpha')}, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS state_index FROM b""")
def score_states(spark, sf):
    d = U.past_context(P.event_panel(spark, sf), 10).withColumn("gap", F.col("fast") - F.col("slow"))
    d = U.score_states(d, "gap", "gap")
    cols = [f"{p}_{n}" for p in ("score", "p") for n in U.STATES]
    return d.select(*SEQUENCE, TIME, *[r(c) for c in cols], r("alpha"), "state_index")


# ------------------------------------------------------------------ named feature sets
def features(spark, sf, feature_set):
    d = P.spatial_rows(spark, sf).withColumnRenamed("values", "five").withColumn("two", F.transform("five", lambda x: x * x))
    return X.extract_features(
        d, feature_set, X.WINDOWS, [RECORDING], TIME, "five", "two", 16, 4, 4, 16)


def _family_sql(feature_set: str) -> str:
    part = "PARTITION BY recording_id"
    parts = [
        *[f"SELECT 'five_{s}_band_' || band AS feature, {s}::FLOAT AS v FROM rob" for s in ("median", "mad", "q25", "q75", "iqr")],
        "SELECT 'five_log_energy_band_' || band, ln(1 + avg(value * value))::FLOAT FROM cells GROUP BY recording_id, time_index, band",
        "SELECT 'cross_view_index_agreement_' || s.i, (s.v - g.v)::FLOAT FROM series s JOIN series g ON s.p = 'five_band' AND g.p = 'two_group' AND s.i = g.i AND s.recording_id = g.recording_id AND s.time_index = g.time_index",
        "SELECT 'five_channel_mean_' || channel, avg(value)::FLOAT FROM cells GROUP BY recording_id, time_index, channel",
        "SELECT 'two_channel_mean_' || channel2, avg(value * value)::FLOAT FROM cells GROUP BY recording_id, time_index, channel2",
        "SELECT 'five_channel_missing_' || channel, 0::FLOAT FROM cells GROUP BY recording_id, time_index, channel",
        "SELECT 'two_channel_missing_' || channel2, 0::FLOAT FROM cells GROUP BY recording_id, time_index, channel2",
    ]
    for k in X.WINDOWS:
        for s in ("mean", "std", "slope"):
            parts.append(f"SELECT p || '_w{k}_{s}_' || i, v_w{k}_{s}::FLOAT FROM rolled")
        parts.append(f"SELECT p || '_w{k}_normalized_deviation_' || i, ({_dev_sql('v', k)})::FLOAT FROM rolled")
        for s in ("autocorrelation", "trend_consistency"):
            parts.append(f"SELECT 'global_w{k}_{s}', g_w{k}_{s}::FLOAT FROM pat")
    if feature_set != "enhanced":
        parts.append("SELECT 'five_current_c' || channel || '_f' || band, value::FLOAT FROM cells")
    if feature_set == "enhanced_full":
        parts += [
            "SELECT 'five_first_difference_c' || channel || '_f' || band, d1::FLOAT FROM dif",
            "SELECT 'five_second_difference_c' || channel || '_f' || band, CASE WHEN time_index = 0 THEN 0 ELSE d1 - lag(d1) OVER (PARTITION BY recording_id, pos ORDER BY time_index) END::FLOAT FROM dif",
        ]
    roll = ", ".join(_roll_sql("v", k).replace("PARTITION BY group_id, recording_id", "PARTITION BY recording_id, p, i") for k in X.WINDOWS)
    pats = ", ".join(_pattern_sql("g", k, "recording_id") for k in X.WINDOWS)
    return f"""WITH {S.SPATIAL},
med AS (SELECT recording_id, time_index, band, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM cells GROUP BY ALL),
rob AS (SELECT c.recording_id, c.time_index, c.band, median, q25, q75, q75 - q25 AS iqr, quantile_cont(abs(value - median), 0.5) AS mad
  FROM cells c JOIN med USING (recording_id, time_index, band) GROUP BY ALL),
series AS (SELECT recording_id, time_index, 'five_band' AS p, band AS i, avg(value) AS v FROM cells GROUP BY ALL
  UNION ALL SELECT recording_id, time_index, 'two_group', group2, avg(value * value) FROM cells GROUP BY ALL),
rolled AS (SELECT *, {roll} FROM series),
energy AS (SELECT recording_id, time_index, avg(abs(value)) AS g FROM cells GROUP BY ALL),
energy2 AS (SELECT *, lag(g) OVER ({part} ORDER BY time_index) AS prev, CASE WHEN time_index > 0 THEN g END AS later FROM energy),
pat AS (SELECT *, {pats} FROM energy2),
dif AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY recording_id, pos ORDER BY time_index), 0) AS d1 FROM cells),
fam AS ({' UNION ALL '.join(parts)})
SELECT feature, {q('avg(v)', 'mean_value', 5)}, count(*) AS n FROM fam GROUP BY feature"""


def _feature_means(spark, sf, feature_set):
    """Mean of every feature column: the set's schema and values in one table."""
    d = features(spark, sf, feature_set)
    names = [c for c in d.columns if c not in REC]
    one = d.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in names])
    return one.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in names]))).select(
        "feature", r("v", 5, "mean_value"), F.col("_n").alias("n"))


for _set in ("enhanced", "enhanced_raw5", "enhanced_full"):
    query(f"feature_set_{_set}", _family_sql(_set))(lambda spark, sf, s=_set: _feature_means(spark, sf, s))


@query("stacked_features", f"""WITH {_FAST}, w AS (SELECT *, {_roll_sql('fast', 5)} FROM f),
t AS (SELECT group_id, recording_id, time_index, avg(value / (value + 50)) OVER (PARTITION BY group_id, recording_id ORDER BY time_index ROWS 4 PRECEDING) AS target FROM seq)
SELECT group_id, recording_id, time_index, {q('target')}, {q('fast_w5_mean')}, {q('fast_w5_slope')} FROM w JOIN t USING (group_id, recording_id, time_index)""")
def stacked_features(spark, sf):
    seq = P.event_sequences(spark, sf).withColumn("fast", F.col("value") / (F.col("value") + 50.0))
    d = X.rolling_stats(seq, ["fast"], [5], UNIT)
    d = B.trailing(d, UNIT, lambda rows: {"target": F.avg("fast").over(rows(-4, 0))}, before=4)
    cols = ["fast_w5_mean", "fast_w5_slope"]
    parts = [d.where(F.col(RECORDING) == i).select(*UNIT, TIME, "target", *cols) for i in (0, 1)]
    return X.stack_features(parts, cols).select(*UNIT, TIME, r("target"), *[r(c) for c in cols])
