"""Bootstrap, BCa intervals, exact sign flips and Holm adjustment over group values."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelseq import GROUP
from panelseq.functions import expr as X
from panelseq.functions import normal
from panelseq.functions.keyed import draw_hashes
from panelseq.operators import blocks as B
from panelseq.operators import scan
from panelseq.operators.select import with_totals
from panelseq.session import cut, ship

RESAMPLES = 10_000
METRIC_SEED, THETA_SEED, FAMILY_SEED = 20260830, 20260905, 20260728
#: Most groups for all sign patterns, and those of them in the sorted table.
EXACT_GROUPS, TABLE_GROUPS = 44, 20
#: Draws of one task, the most group values of one key that a task takes, those that it takes of keys of one size together, and values of a packed row.
DRAW_BLOCK, TASK_VALUES, BUNDLE_VALUES, PACK_VALUES = 250, 1 << 22, 1 << 20, 1 << 12


def group_index(df: DataFrame, group: str = GROUP, by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """0-based position of each group in md5 order: even buckets for any kind of id."""
    h = F.md5(F.col(group).cast("string"))
    return B.dense_index(df.withColumn("_h", h), list(by), F.substring("_h", 1, 3), ["_h", group], name).drop("_h")


def bootstrap_means(values: DataFrame, cols: Sequence[str], resamples: int = RESAMPLES, seed: int = THETA_SEED, group: str = GROUP) -> DataFrame:
    """(draw, mean of each column): every column shares the same keyed draws.

    The values are one row per group and are written once; a task takes all of them and a block of draws.
    """
    cols = list(dict.fromkeys(cols))
    vec = cut(group_index(values.select(group, *cols), group).select(F.lit(0).alias("_all"), "idx", *[F.col(c).cast("double").alias(c) for c in cols]))
    return family_means(vec, ["_all"], resamples, seed, {c: c for c in cols}).select("draw", *cols)


def identity_gaps(means: DataFrame, identities: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Largest gap of each identity over the draws of ``means``: (identity, max_abs_error)."""
    one = means.agg(*[F.max(F.abs(a - b)).alias(n) for n, (a, b) in identities.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("identity"), F.col(n).alias("max_abs_error")) for n in identities])))


def paired_bootstrap(values: DataFrame, cols: Sequence[str], identities: dict[str, tuple[Column, Column]], **kw) -> DataFrame:
    """Largest gap of each identity over the shared draws: (identity, max_abs_error)."""
    return identity_gaps(bootstrap_means(values, cols, **kw), identities)


def jackknife_acceleration(values: DataFrame, col: str) -> DataFrame:
    """One row: acceleration from leave-one-out means (null when degenerate)."""
    loo = with_totals(values, (), {"_s": F.sum(col), "_m": F.count(col)}).select(
        F.try_divide(F.col("_s") - F.col(col), F.col("_m") - 1).alias("_j"))
    dev = F.col("_c") - F.col("_j")
    centred = with_totals(loo, (), {"_c": F.avg("_j")})
    return centred.agg(F.try_divide(F.sum(dev * dev * dev), 6.0 * F.pow(F.sum(dev * dev), F.lit(1.5))).alias("acceleration"))


def bca_mean(values: DataFrame, cols: Sequence[str], resamples: int = RESAMPLES, seed: int = THETA_SEED, level: float = 0.95, group: str = GROUP) -> DataFrame:
    """BCa interval of the mean per column: ``bca_family`` of the columns as quantities. A constant vector has no interval; its status says so."""
    long = values.select(group, F.inline(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("value")) for c in cols])))
    return bca_family(long, ["quantity"], "value", resamples, seed, level, group).select("quantity", "estimate", "lower", "upper", "n", "acceleration", "status")


def _block_means(seed: int, resamples: int, by: Sequence[str], cols: dict[str, str]):
    """Means of one block of draws of keys of one size; they have the same slots, so a draw is hashed once for all."""

    def run(table: pa.Table) -> pa.Table:
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        draws = range(block * DRAW_BLOCK, min(resamples, (block + 1) * DRAW_BLOCK))
        keys: dict[tuple, int] = {}
        row = np.array([keys.setdefault(k, len(keys)) for k in zip(*[table.column(k).to_pylist() for k in by], strict=True)])
        lists = table.column("idx").combine_chunks()
        at = np.repeat(row, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        values, known = {}, {}
        for c in cols:
            flat = table.column(c).combine_chunks().flatten()
            values[c] = np.empty((len(keys), n))
            values[c][at] = flat.fill_null(0.0).to_numpy()
            if flat.null_count:
                known[c] = np.zeros((len(keys), n), bool)
                known[c][at] = flat.is_valid().to_numpy(zero_copy_only=False)
        means, empty = ({c: np.zeros((len(keys), len(draws)), kind) for c in cols} for kind in (float, bool))
        for i, hashes in enumerate(draw_hashes(seed, draws, n)):
            hits = (hashes % np.uint32(n)).astype(np.intp)
            for c, v in values.items():
                if c in known:
                    count = known[c].take(hits, 1).sum(1)
                    empty[c][:, i] = count == 0
                    means[c][:, i] = v.take(hits, 1).sum(1) / np.maximum(count, 1)
                else:
                    means[c][:, i] = v.take(hits, 1).mean(1)
        first = np.unique(row, return_index=True)[1]
        out = [table.column(k).take(pa.array(np.repeat(first, len(draws)))) for k in by]
        out.append(pa.array(np.tile(np.array(draws, np.int64), len(keys))))
        out += [pa.array(means[c].ravel(), mask=empty[c].ravel()) for c in cols]
        return pa.Table.from_arrays(out, names=[*by, "draw", *cols.values()])

    return run


def family_means(vec: DataFrame, by: Sequence[str], resamples: int, seed: int, cols: dict[str, str] | None = None) -> DataFrame:
    """(by, draw, means): bootstrap means of every key of (by, idx, columns), nulls left out; ``cols`` names the mean of each column.

    The values of a key go once to each block of DRAW_BLOCK draws, packed, and a task gives one mean for each draw, so what is
    exchanged is groups x blocks and not groups x draws. Keys of one size go together, about BUNDLE_VALUES at a time, since their draws
    are the same. A key of more than TASK_VALUES groups joins its draws instead.
    """
    spark = vec.sparkSession
    ship(spark)
    by, cols = list(by), cols or {"value": "m"}
    sizes = vec.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > TASK_VALUES))
    small = sizes.where(F.col("n") <= TASK_VALUES)
    bundles = F.ceil(F.col("_keys") * F.col("n") / BUNDLE_VALUES)
    small = small.join(small.groupBy("n").agg(F.count(F.lit(1)).alias("_keys")), "n").select(*by, "n", F.pmod(F.xxhash64(*by), bundles).alias("_bundle"))
    packed = vec.groupBy(*by, F.floor(F.col("idx") / PACK_VALUES).alias("_pack")).agg(F.collect_list(F.struct("idx", *cols)).alias("_p"))
    packed = packed.join(small, by).select(*by, "n", "_bundle", F.col("_p.idx").alias("idx"), *[F.col(f"_p.{c}").alias(c) for c in cols])
    blocks = -(-resamples // DRAW_BLOCK)
    dealt = ["n", "_bundle", "block"]
    # Few rows, but much work on each: Spark would merge them to fewer tasks than there are blocks.
    tasks = max(4 * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *dealt)
    kinds = "".join(f"`{k}` {vec.schema[k].dataType.simpleString()}, " for k in by)
    out = spread.groupBy(*dealt).applyInArrow(_block_means(seed, resamples, by, cols), f"{kinds}draw bigint, {', '.join(f'`{m}` double' for m in cols.values())}")
    if large.limit(1).count() > 0:
        slots = large.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long")))).withColumn("slot", F.explode(F.expr("sequence(0L, n - 1)")))
        hit = slots.select(*by, "draw", X.draw_index("n", seed, F.col("draw"), F.col("slot")).alias("idx"))
        out = out.unionByName(hit.join(vec, [*by, "idx"]).groupBy(*by, "draw").agg(*[F.avg(c).alias(m) for c, m in cols.items()]))
    return out


def bca_family(long: DataFrame, by: Sequence[str], value: str = "value", resamples: int = RESAMPLES, seed: int = THETA_SEED, level: float = 0.95, group: str = GROUP) -> DataFrame:
    """BCa interval of the mean of every key at once: (by, estimate, lower, upper, n, acceleration, leave_out_low, leave_out_high, q1, median, q3, status).

    ``leave_out_low`` and ``_high`` are the least and largest mean without one group. Normal quantiles are column
    expressions, so no row leaves the JVM but for the draws. Keys without variation have no interval. Null values are left out.
    """
    by = list(by)
    src = long.where(F.col(value).isNotNull()).select(*by, group, F.col(value).cast("double").alias("value"))
    vec = cut(group_index(src, group, by).select(*by, "idx", "value"))
    first = vec.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("estimate"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    quartiles = B.exact_quantiles(vec, by, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    away = F.col("value") - F.col("estimate")
    stats = vec.join(first, by).groupBy(*by, "n", "estimate", "_min", "_max").agg(
        F.try_divide(F.sum(away * away * away), 6.0 * F.pow(F.sum(away * away), F.lit(1.5))).alias("acceleration")).join(quartiles, by)
    stats = cut(stats)
    means = family_means(vec, by, resamples, seed).join(stats.select(*by, "estimate"), by)
    tie = F.abs(F.col("m") - F.col("estimate")) <= 1e-15
    shares = means.groupBy(*by).agg(
        F.avg(F.when(tie, 0.5).when(F.col("m") < F.col("estimate"), 1.0).otherwise(0.0)).alias("_share"), F.array_sort(F.collect_list("m")).alias("_means"))
    # Written between the steps, so that no step's expressions are repeated inside the next.
    d = cut(stats.join(shares, by).withColumn("_z0", normal.inverse(F.when(F.col("_max") > F.col("_min"), F.col("_share")))))

    def limit(p: float) -> Column:
        shifted = F.col("_z0") + NormalDist().inv_cdf(p)
        at = normal.cdf(F.col("_z0") + shifted / (1 - F.col("acceleration") * shifted)) * (F.size("_means") - 1)

        def between(x: Column) -> Column:
            a, b = F.get("_means", F.floor(x).cast("int")), F.get("_means", F.ceil(x).cast("int"))
            return a + (b - a) * (x - F.floor(x))

        return normal.let(at, between)

    d = d.withColumn("lower", limit((1 - level) / 2)).withColumn("upper", limit(1 - (1 - level) / 2))
    without = lambda end: F.try_divide(F.col("estimate") * F.col("n") - F.col(end), F.col("n") - 1)
    return d.select(
        *by, "estimate", "lower", "upper", "n", "acceleration", without("_max").alias("leave_out_low"), without("_min").alias("leave_out_high"), "q1", "median", "q3",
        F.when(F.col("lower").isNull(), "DEGENERATE").otherwise("AVAILABLE").alias("status"))


def _half_sums(values: np.ndarray) -> np.ndarray:
    """Signed sums of all 2^n patterns of the columns' values; bit i set flips value i."""
    sums = np.zeros((1, values.shape[1]))
    for v in values:
        sums = np.concatenate([sums + v, sums - v])
    return sums


def _count_extreme(table: np.ndarray, first: np.ndarray, observed: np.ndarray, n: int, tolerance: float):
    """For each pattern of the first half, how many of the second half make the mean extreme."""

    def run(batches):
        order = np.sort(table, axis=0)
        least = (observed / n - tolerance) * n
        for b in batches:
            ids = b.column("id").to_numpy()
            total = np.broadcast_to(first[0], (len(ids), table.shape[1])).copy()
            for i in range(1, len(first)):
                total += np.where((ids >> (i - 1) & 1)[:, None] == 0, first[i], -first[i])
            counts = [int((len(order) - np.searchsorted(order[:, c], least[c] - total[:, c], "left")
                           + np.searchsorted(order[:, c], -least[c] - total[:, c], "right")).sum()) if least[c] > 0 else len(ids) * len(order)
                      for c in range(table.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids) * len(order)])], ["extreme", "total"])

    return run


def _flip_sums(cols: Sequence[str], draws: int, seed: int):
    """Partial sums of every random pattern over a task's groups; a group's signs are keyed by its index."""

    def run(batches):
        sums = np.zeros((len(cols), draws))
        for b in batches:
            values = np.stack([b.column(c).to_numpy() for c in cols])
            for k, idx in enumerate(b.column("idx").to_pylist()):
                bits = np.random.Generator(np.random.Philox(key=[seed, idx])).bytes(-(-draws // 8))
                up = np.unpackbits(np.frombuffer(bits, np.uint8), count=draws).astype(bool)
                sums += np.where(up, values[:, k, None], -values[:, k, None])
        for lo in range(0, draws, 10_000):
            part = sums[:, lo: lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + part.shape[1])), *[pa.array(x) for x in part]], ["draw", *cols])

    return run


def sign_flip(
    values: DataFrame, cols: Sequence[str], method: str = "exact", tolerance: float = 7.1e-15, sampled: int = 100_000,
    seed: int = FAMILY_SEED, group: str = GROUP,
) -> DataFrame:
    """Two-sided sign-flip test of a zero mean, one row per column (comparison_id); ``method`` stands in the result.

    ``exact`` counts all patterns. A pattern and its mirror have the same absolute mean, so the first sign is
    fixed; the other signs are cut into two halves, one of them a sorted table of at most 2^20 sums in which each
    pattern of the other is looked up. It raises above EXACT_GROUPS groups. ``sampled`` draws ``sampled``
    keyed patterns and adds the observed one; a task gives one sum for each pattern, whatever its groups.
    """
    if method not in ("exact", "sampled"):
        raise ValueError("method must be exact or sampled")
    cols = list(cols)
    spark = values.sparkSession
    ship(spark)
    vec = cut(group_index(values.select(group, *cols).na.drop(), group).select("idx", *[F.col(c).cast("double").alias(c) for c in cols]))
    n = vec.count()
    if n == 0:
        raise ValueError("no values")
    if method == "exact":
        if n > EXACT_GROUPS:
            raise ValueError(f"{n} groups are too many for all patterns; ask for method='sampled'")
        v = np.array([[r[c] for c in cols] for r in sorted(vec.collect(), key=lambda r: r["idx"])])
        back = min(n // 2, TABLE_GROUPS)
        table, first = _half_sums(v[n - back:]), v[: n - back]
        parts = spark.range(2 ** (n - back - 1)).mapInArrow(
            _count_extreme(table, first, np.abs(v.sum(0)), n, tolerance), "extreme array<bigint>, total bigint")
        out = parts.agg(*[(2 * F.sum(F.col("extreme")[i])).alias(c) for i, c in enumerate(cols)], (2 * F.sum("total")).alias("total"))
    else:
        fields = ", ".join(f"`{c}` double" for c in cols)
        per = vec.repartition("idx").mapInArrow(_flip_sums(cols, sampled, seed), f"draw bigint, {fields}").groupBy("draw").agg(*[F.sum(c).alias(c) for c in cols])
        observed = vec.agg(*[(F.abs(F.sum(c)) / n).alias(f"_o_{c}") for c in cols], F.lit(1).alias("_k"))
        out = per.withColumn("_k", F.lit(1)).join(F.broadcast(observed), "_k").agg(
            *[(1 + F.count_if(F.abs(F.col(c)) / n >= F.col(f"_o_{c}") - tolerance)).alias(c) for c in cols],
            (1 + F.count(F.lit(1))).alias("total"))
    long = out.select("total", F.inline(F.array(*[F.struct(F.lit(c).alias("comparison_id"), F.col(c).alias("extreme")) for c in cols])))
    means = vec.agg(*[F.avg(c).alias(c) for c in cols]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("comparison_id"), F.col(c).alias("mean_effect")) for c in cols])))
    return long.join(F.broadcast(means), "comparison_id").select(
        "comparison_id", F.lit(method).alias("method"), F.lit(n).alias("m"), "total", "extreme", (F.col("extreme") / F.col("total")).alias("p"), "mean_effect")


def holm(pvals: DataFrame, by: Sequence[str] = (), p: str = "p", comparison: str = "comparison_id", ranges: int | None = None) -> DataFrame:
    """Step-down adjusted p within a family of comparisons: ``holm_p`` beside all columns.

    Ranks and the running maximum are scans by ranges (``scan.ranged``), so a family may hold all rows. Equal p get
    equal results. A null p is no comparison: it is not counted and its ``holm_p`` is null.
    """
    fam, order = list(by), [p, comparison]
    tested = scan.ranks(scan.ranged(pvals.where(F.col(p).isNotNull()), fam, order, ranges), fam, order, "_r", "_m")
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    done = scan.running(tested, fam, ["_r"], step, "max", "holm_p").drop("_r", "_m", "_range")
    return done.unionByName(pvals.where(F.col(p).isNull()).withColumn("holm_p", F.lit(None).cast("double")))
