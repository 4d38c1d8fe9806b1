"""Causal features. Spatial statistics are row-local; temporal ones use halo windows.

A view is one array per time row, channel-major: position = channel * bands + band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import SEQUENCE, TIME
from panelseq.functions import expr as X
from panelseq.operators import blocks as B

WINDOWS = (5, 10, 20, 40)
FEATURE_SETS = ("base81", "enhanced", "enhanced_raw5", "enhanced_full")


# ------------------------------------------------------------------ array parts
def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _band(values: Column, bands: int, b: int) -> Column:
    return F.filter(values, lambda x, i: i % bands == b)


def _bin_group(values: Column, bins: int, width: int, g: int) -> Column:
    return F.filter(values, lambda x, i: F.floor((i % bins) / width) == g)


def _channel(values: Column, bands: int, c: int) -> Column:
    return F.slice(values, c * bands + 1, bands)


def _quantile(ordered: Column, n: int, p: float) -> Column:
    """Linear quantile of a sorted array of known length."""
    pos = p * (n - 1)
    lo = int(pos)
    low = ordered[lo]
    return low if pos == lo else low + (ordered[lo + 1] - low) * F.lit(pos - lo)


def clean_view(values: str | Column) -> Column:
    return F.transform(X.col(values), lambda x: F.when(X.nonfinite(x), 0.0).otherwise(x))


# ------------------------------------------------------------------ C1..C5, C9..C11
def band_mean(df: DataFrame, values: str = "values", channels: int = 17, bands: int = 5, out: str = "band_mean") -> DataFrame:
    v = F.col(values)
    return df.withColumn(out, F.array(*[_sum(_band(v, bands, b)) / channels for b in range(bands)]))


def grouped_bin_mean(
    df: DataFrame, values: str, channels: int = 17, bins: int = 25, width: int = 5, out: str = "group_mean"
) -> DataFrame:
    v = F.col(values)
    return df.withColumn(out, F.array(*[
        _sum(_bin_group(v, bins, width, g)) / (channels * width) for g in range(bins // width)
    ]))


def robust_stats(df: DataFrame, values: str = "values", channels: int = 17, bands: int = 5) -> DataFrame:
    """Median, MAD, q25, q75 and IQR over channels, one array entry per band."""
    v = F.col(values)
    df = df.withColumn("_sorted", F.array(*[F.array_sort(_band(v, bands, b)) for b in range(bands)]))
    s = F.col("_sorted")
    df = df.withColumns({
        "median": F.array(*[_quantile(s[b], channels, 0.5) for b in range(bands)]),
        "q25": F.array(*[_quantile(s[b], channels, 0.25) for b in range(bands)]),
        "q75": F.array(*[_quantile(s[b], channels, 0.75) for b in range(bands)]),
    })
    m = F.col("median")

    def away(b: int) -> Column:
        centre = m[b]
        return F.array_sort(F.transform(s[b], lambda x: F.abs(x - centre)))

    df = df.withColumn("_away", F.array(*[away(b) for b in range(bands)]))
    return df.withColumns({
        "mad": F.array(*[_quantile(F.col("_away")[b], channels, 0.5) for b in range(bands)]),
        "iqr": F.zip_with("q75", "q25", lambda a, b: a - b),
    }).drop("_sorted", "_away")


def log_energy(df: DataFrame, values: str = "values", channels: int = 17, bands: int = 5) -> DataFrame:
    v = F.col(values)
    return df.withColumn("log_energy", F.array(*[
        F.log1p(_sum(F.transform(_band(v, bands, b), lambda x: x * x)) / channels) for b in range(bands)
    ]))


def cross_view(df: DataFrame, first: str = "band_mean", second: str = "group_mean", out: str = "cross_view") -> DataFrame:
    """Difference of two per-band arrays of the same row."""
    return df.withColumn(out, F.zip_with(first, second, lambda a, b: a - b))


def channel_mean(df: DataFrame, values: str = "values", channels: int = 17, bands: int = 5, out: str = "channel_mean") -> DataFrame:
    v = F.col(values)
    return df.withColumn(out, F.array(*[_sum(_channel(v, bands, c)) / bands for c in range(channels)]))


def global_energy(df: DataFrame, values: str = "values", out: str = "global_energy") -> DataFrame:
    v = F.col(values)
    return df.withColumn(out, _sum(F.transform(v, lambda x: F.abs(x))) / F.size(v))


def missing_rate(df: DataFrame, values: str = "values", channels: int = 17, bands: int = 5, out: str = "missing_rate") -> DataFrame:
    flags = F.transform(F.col(values), lambda x: F.when(X.nonfinite(x), 1.0).otherwise(0.0))
    return df.withColumn(out, F.array(*[_sum(_channel(flags, bands, c)) / bands for c in range(channels)]))


def flatten(df: DataFrame, values: str = "values", channels: int = 17, bands: int = 5, prefix: str = "current") -> DataFrame:
    v = F.col(values)
    return df.withColumns({f"{prefix}_c{c}_f{b}": v[c * bands + b] for c in range(channels) for b in range(bands)})


# ------------------------------------------------------------------ C6..C8, C12
def _add_rolling(halo: DataFrame, cols: Sequence[str], windows: Sequence[int], w, t: str) -> DataFrame:
    made, dev = {}, {}
    for c in cols:
        for k in windows:
            rows = w.rowsBetween(-(k - 1), 0)
            made[f"{c}_w{k}_mean"] = F.avg(c).over(rows)
            made[f"{c}_w{k}_std"] = F.stddev_pop(c).over(rows)
            slope = F.regr_slope(F.col(c), F.col(t).cast("double")).over(rows)
            made[f"{c}_w{k}_slope"] = F.when(F.col(t) == 0, 0.0).otherwise(slope)
            sd = F.col(f"{c}_w{k}_std")
            dev[f"{c}_w{k}_deviation"] = (F.col(c) - F.col(f"{c}_w{k}_mean")) / F.when(sd > 1e-8, sd).otherwise(1.0)
    return halo.withColumns(made).withColumns(dev)


def _add_pattern(halo: DataFrame, col: str, windows: Sequence[int], w, t: str) -> DataFrame:
    base = halo.withColumn("_prev", F.lag(col).over(w))
    later = F.when(F.col("_prev").isNotNull(), F.col(col))
    made = {}
    for k in windows:
        pairs = w.rowsBetween(-(k - 2), 0)
        varies = (F.stddev_pop(later).over(pairs) > 1e-8) & (F.stddev_pop("_prev").over(pairs) > 1e-8)
        made[f"{col}_w{k}_autocorrelation"] = F.when(
            (F.col(t) >= 2) & varies, X.corr("_prev", later, pairs)
        ).otherwise(0.0)
        made[f"{col}_w{k}_trend_consistency"] = F.coalesce(
            F.abs(F.avg(F.signum(F.col(col) - F.col("_prev"))).over(pairs)), F.lit(0.0)
        )
    return base.withColumns(made).drop("_prev")


def _add_array_differences(halo: DataFrame, values: str, w) -> DataFrame:
    v = F.col(values)
    zeros = F.transform(v, lambda x: F.lit(0.0))
    base = halo.withColumn("_l1", F.lag(v).over(w)).withColumn("_l2", F.lag(v, 2).over(w))
    d1 = F.when(F.col("_l1").isNull(), zeros).otherwise(F.zip_with(v, "_l1", lambda a, b: a - b))
    before = F.when(F.col("_l2").isNull(), zeros).otherwise(F.zip_with("_l1", "_l2", lambda a, b: a - b))
    d2 = F.when(F.col("_l1").isNull(), zeros).otherwise(F.zip_with(f"{values}_d1", "_before", lambda a, b: a - b))
    out = base.withColumn(f"{values}_d1", d1).withColumn("_before", before).withColumn(f"{values}_d2", d2)
    return out.drop("_l1", "_l2", "_before")


def rolling_stats(
    df: DataFrame, cols: Sequence[str], windows: Sequence[int] = WINDOWS, keys: Sequence[str] = SEQUENCE,
    t: str = TIME, chunk: int = B.CHUNK,
) -> DataFrame:
    """Causal mean, std, slope and normalised deviation, current row included."""
    halo = B.with_halo(df, t, before=max(windows), chunk=chunk)
    return B.drop_halo(_add_rolling(halo, cols, windows, B.chunk_window(keys, t), t))


def temporal_pattern(
    df: DataFrame, col: str, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = SEQUENCE, t: str = TIME,
    chunk: int = B.CHUNK,
) -> DataFrame:
    """Lag-1 autocorrelation and trend consistency per window."""
    halo = B.with_halo(df, t, before=max(windows) + 1, chunk=chunk)
    return B.drop_halo(_add_pattern(halo, col, windows, B.chunk_window(keys, t), t))


def differences(df: DataFrame, col: str, keys: Sequence[str] = SEQUENCE, t: str = TIME, chunk: int = B.CHUNK) -> DataFrame:
    """First and second in-sequence difference; zero on the first row."""
    w = B.chunk_window(keys, t)
    base = B.with_halo(df, t, before=2, chunk=chunk)
    d1 = F.coalesce(F.col(col) - F.lag(col).over(w), F.lit(0.0))
    base = base.withColumn(f"{col}_d1", d1)
    d2 = F.when(F.col(t) == 0, 0.0).otherwise(F.col(f"{col}_d1") - F.lag(f"{col}_d1").over(w))
    return B.drop_halo(base.withColumn(f"{col}_d2", d2))


def array_differences(df: DataFrame, values: str = "values", keys: Sequence[str] = SEQUENCE, t: str = TIME, chunk: int = B.CHUNK) -> DataFrame:
    """``differences`` for every array entry: columns ``<values>_d1`` and ``_d2``."""
    halo = B.with_halo(df, t, before=2, chunk=chunk)
    return B.drop_halo(_add_array_differences(halo, values, B.chunk_window(keys, t)))


# ------------------------------------------------------------------ C13, C14
def feature_names(
    feature_set: str, channels: int, bands: int, groups: int, windows: Sequence[int], second_channels: int,
) -> list[str]:
    # The names of the columns.
    names = [f"five_{s}_band_{b}" for s in ("median", "mad", "q25", "q75", "iqr") for b in range(bands)]
    names += [f"five_log_energy_band_{b}" for b in range(bands)]
    names += [f"cross_view_index_agreement_{b}" for b in range(bands)]
    names += [f"five_channel_mean_{c}" for c in range(channels)]
    names += [f"two_channel_mean_{c}" for c in range(second_channels)]
    for prefix, n in (("five_band", bands), ("two_group", groups)):
        names += [
            f"{prefix}_w{k}_{s}_{i}" for k in windows
            for s in ("mean", "std", "slope", "normalized_deviation") for i in range(n)
        ]
    names += [f"global_w{k}_{s}" for k in windows for s in ("autocorrelation", "trend_consistency")]
    names += [f"five_channel_missing_{c}" for c in range(channels)]
    names += [f"two_channel_missing_{c}" for c in range(second_channels)]
    if feature_set in ("enhanced_raw5", "enhanced_full"):
        names += [f"five_current_c{c}_f{b}" for c in range(channels) for b in range(bands)]
    if feature_set == "enhanced_full":
        names += [f"five_{o}_difference_c{c}_f{b}" for o in ("first", "second") for c in range(channels) for b in range(bands)]
    return names


def extract_features(
    df: DataFrame, feature_set: str = "enhanced", windows: Sequence[int] = WINDOWS, keys: Sequence[str] = SEQUENCE,
    t: str = TIME, five: str = "five", two: str = "two", channels: int = 17, bands: int = 5,
    second_channels: int = 17, bins: int = 25, keep: Sequence[str] = (), chunk: int = B.CHUNK,
) -> DataFrame:
    """Named float32 feature columns of one feature set, never reading a target.

    ``base81`` is declared but its columns are not known, so asking for it raises.
    """
    if feature_set not in FEATURE_SETS or feature_set == "base81":
        raise ValueError(f"feature set not available: {feature_set}")
    width = bins // bands
    df = df.withColumns({
        "_five_missing": F.transform(F.col(five), lambda x: F.when(X.nonfinite(x), 1.0).otherwise(0.0)),
        "_two_missing": F.transform(F.col(two), lambda x: F.when(X.nonfinite(x), 1.0).otherwise(0.0)),
        five: clean_view(five), two: clean_view(two),
    })
    df = band_mean(df, five, channels, bands, "_bm")
    df = grouped_bin_mean(df, two, second_channels, bins, width, "_gm")
    df = robust_stats(df, five, channels, bands)
    df = log_energy(df, five, channels, bands)
    df = cross_view(df, "_bm", "_gm", "_cv")
    df = channel_mean(df, five, channels, bands, "_cm5")
    df = channel_mean(df, two, second_channels, bins, "_cm2")
    df = channel_mean(df, "_five_missing", channels, bands, "_ms5")
    df = channel_mean(df, "_two_missing", second_channels, bins, "_ms2")
    df = global_energy(df, five, "global")
    series = {f"five_band_{i}": F.col("_bm")[i] for i in range(bands)}
    series |= {f"two_group_{i}": F.col("_gm")[i] for i in range(bands)}
    # One halo and one window partitioning serve all temporal columns.
    w = B.chunk_window(keys, t)
    df = B.with_halo(df.withColumns(series), t, before=max(windows) + 1, chunk=chunk)
    if feature_set == "enhanced_full":
        df = _add_array_differences(df, five, w)
    df = _add_rolling(df, list(series), windows, w, t)
    df = B.drop_halo(_add_pattern(df, "global", windows, w, t))

    def at(array: str, i: int) -> Column:
        return F.col(array)[i]

    made: dict[str, Column] = {}
    for stat in ("median", "mad", "q25", "q75", "iqr", "log_energy"):
        made |= {f"five_{stat}_band_{b}": at(stat, b) for b in range(bands)}
    made |= {f"cross_view_index_agreement_{b}": at("_cv", b) for b in range(bands)}
    for pre, arr, n in (("five", "_cm5", channels), ("two", "_cm2", second_channels)):
        made |= {f"{pre}_channel_mean_{c}": at(arr, c) for c in range(n)}
    for pre, arr, n in (("five", "_ms5", channels), ("two", "_ms2", second_channels)):
        made |= {f"{pre}_channel_missing_{c}": at(arr, c) for c in range(n)}
    for pre in ("five_band", "two_group"):
        for i in range(bands):
            for k in windows:
                for s in ("mean", "std", "slope"):
                    made[f"{pre}_w{k}_{s}_{i}"] = F.col(f"{pre}_{i}_w{k}_{s}")
                made[f"{pre}_w{k}_normalized_deviation_{i}"] = F.col(f"{pre}_{i}_w{k}_deviation")
    for k in windows:
        for s in ("autocorrelation", "trend_consistency"):
            made[f"global_w{k}_{s}"] = F.col(f"global_w{k}_{s}")
    for c in range(channels):
        for b in range(bands):
            made[f"five_current_c{c}_f{b}"] = at(five, c * bands + b)
            if feature_set == "enhanced_full":
                made[f"five_first_difference_c{c}_f{b}"] = at(f"{five}_d1", c * bands + b)
                made[f"five_second_difference_c{c}_f{b}"] = at(f"{five}_d2", c * bands + b)
    names = feature_names(feature_set, channels, bands, bands, windows, second_channels)
    return df.select(*keys, t, *keep, *[made[n].cast("float").alias(n) for n in names])


def stack_features(parts: Sequence[DataFrame], feature_cols: Sequence[str]) -> DataFrame:
    """Union of feature tables that must agree on columns and their order."""
    first = parts[0].columns
    for p in parts[1:]:
        if p.columns != first:
            raise ValueError("feature order changed between tables")
    missing = set(feature_cols) - set(first)
    if missing:
        raise ValueError(f"missing feature columns: {sorted(missing)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
