"""Ridge models from Gram sums: out-of-fold and held-out predictions, selection locks.

Rows are read once to make one Gram matrix per group. Every model is a weighted
sum of group matrices, so bootstrap members and folds never reread the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelseq import GROUP, SEED, TIME
from panelseq.functions import expr as X
from panelseq.operators import blocks as B
from panelseq.operators.select import with_totals
from panelseq.session import cut, ship


#: Rows of one group that one product reads, and bytes of sums a task holds before it passes them on.
GRAM_ROWS, SUM_BYTES = 4096, 32 << 20


def _list_column(values: np.ndarray) -> pa.ListArray:
    """A matrix as one list for each row."""
    n, p = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), pa.array(values.ravel()))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def sum_arrays(df: DataFrame, by: Sequence[str], cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Sums of array columns entry by entry (weighted), and the number of rows ``n``.

    The plan does not depend on the arrays' length. A task adds up what it reads before the exchange and adds
    the partial sums after it in key order, so it holds SUM_BYTES of sums at most, whatever the size of a key.
    """
    ship(df.sparkSession)
    by, cols = list(by), list(cols)
    src = df.select(*by, *cols, *([F.col(weight).cast("double").alias("_w")] if weight else []))
    schema = T.StructType([*[df.schema[k] for k in by], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in cols], T.StructField("n", T.LongType())])

    def out(held: dict, kinds: list):
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k in keys], kinds[i]) for i in range(len(by))],
             *[_list_column(np.stack([held[k][0][j] for k in keys])) for j in range(len(cols))], pa.array([held[k][1] for k in keys], pa.int64())],
            [*by, *cols, "n"])

    def run(batches):
        held: dict = {}
        kinds: list = []
        for b in batches:
            if not b.num_rows:
                continue
            kinds = [b.schema.field(k).type for k in by]
            values = [_matrix(b.column(c), b.num_rows) for c in cols]
            w = b.column("_w").to_numpy() if "_w" in b.schema.names else np.ones(b.num_rows)
            count = b.column("n").to_numpy() if "n" in b.schema.names else np.ones(b.num_rows, np.int64)
            for i, key in enumerate(zip(*[b.column(k).to_pylist() for k in by], strict=True)):
                if key not in held:
                    held[key] = [[np.zeros(v.shape[1]) for v in values], 0]
                for total, v in zip(held[key][0], values, strict=True):
                    total += w[i] * v[i]
                held[key][1] += int(count[i])
            width = sum(v.shape[1] for v in values) * 8
            if len(held) * width > SUM_BYTES:
                yield out(held, kinds)
                held = {}
        if held:
            yield out(held, kinds)

    part = src.mapInArrow(run, schema)
    last = part.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge_sorted(run, by), schema)
    return last


def _merge_sorted(add, by: Sequence[str]):
    """Add up partial sums that come in key order; a key is passed on when the next begins."""

    def run(batches):
        open_key, parts = None, []
        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in by], strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != open_key and parts:
                    yield from add(parts)
                    parts = []
                open_key = keys[lo]
                parts = list(add([*parts, b.slice(lo, hi - lo)]))
                lo = hi
        if parts:
            yield from add(parts)

    return run


def group_gram(rows: DataFrame, features: Sequence[str], target: str = "target", by: Sequence[str] = (GROUP,)) -> DataFrame:
    """Per group: upper triangle of X'X with intercept, X'y, and y'y, as three arrays.

    Each group's rows are cut into runs of GRAM_ROWS time steps, one matrix product each; the products of a
    group are then added. The plan has the same size for any number of features.
    """
    by, features = list(by), list(features)
    p = len(features) + 1
    upper = np.triu_indices(p)
    run_of = F.expr(f"{TIME} div {GRAM_ROWS}") if TIME in rows.columns else F.expr(f"monotonically_increasing_id() div {GRAM_ROWS}")
    src = rows.select(*by, run_of.alias("_run"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("_y"))
    schema = T.StructType([*[rows.schema[k] for k in by], T.StructField("gram", T.ArrayType(T.DoubleType())), T.StructField("moment", T.ArrayType(T.DoubleType())), T.StructField("square", T.ArrayType(T.DoubleType()))])

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        x = np.stack([np.ones(n), *[B.floats(table, f"_x{i}") for i in range(p - 1)]], axis=1)
        y = B.floats(table, "_y")
        grams, moments, squares = np.empty((len(starts), len(upper[0]))), np.empty((len(starts), p)), np.empty((len(starts), 1))
        for i, (a, z) in enumerate(zip(starts, np.append(starts[1:], n), strict=True)):
            grams[i] = (x[a:z].T @ x[a:z])[upper]
            moments[i] = x[a:z].T @ y[a:z]
            squares[i] = y[a:z] @ y[a:z]
        made = zip(("gram", "moment", "square"), (grams, moments, squares), strict=True)
        out = table.select(by).take(pa.array(starts))
        for name, values in made:
            out = out.append_column(name, _list_column(values))
        return out

    parts = B.map_units(src, [*by, "_run"], [], kernel, schema)
    return sum_arrays(parts, by, ["gram", "moment", "square"]).drop("n")


def feature_blocks(features: Sequence[str], candidates: dict[str, Sequence[str]] | None) -> dict[str | None, np.ndarray]:
    """Places of each candidate's features (and of the intercept) in the matrix of all; one unnamed block without candidates."""
    if candidates is None:
        return {None: np.arange(len(features) + 1)}
    at = {f: i + 1 for i, f in enumerate(features)}
    return {name: np.array([0, *sorted(at[f] for f in own)]) for name, own in candidates.items()}


def _full(gram: np.ndarray, p: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = gram
    return out + np.triu(out, 1).T


def ridge_coefficients(gram: np.ndarray, moment: np.ndarray, block: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients over all columns, zero outside the block; the intercept is not penalised."""
    p = len(moment)
    own = _full(gram, p)[np.ix_(block, block)]
    inner = np.arange(1, len(block))
    own[inner, inner] += penalty
    coef = np.zeros(p)
    coef[block] = np.linalg.lstsq(own, moment[block], rcond=None)[0]
    return coef


def solve_ridge(grams: DataFrame, keys: Sequence[str], features: Sequence[str], penalty: float, candidates: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Coefficients (intercept first) per key, and with ``candidates`` per feature set of it, as (keys, candidate_id, coef).

    All sets are blocks of one Gram matrix, so rows are read once however many sets there are. Coefficients have the length of all features, with zeros
    outside the set.
    """
    ship(grams.sparkSession)
    keep, blocks = list(keys), feature_blocks(features, candidates)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g, m = _matrix(b.column("gram"), b.num_rows), _matrix(b.column("moment"), b.num_rows)
            coef = np.array([ridge_coefficients(g[i], m[i], block, penalty) for i in range(b.num_rows) for block in blocks.values()])
            at = pa.array(np.repeat(np.arange(b.num_rows), len(blocks)))
            columns, names = [b.column(k).take(at) for k in keep], list(keep)
            if candidates is not None:
                columns.append(pa.array(list(blocks) * b.num_rows, pa.string()))
                names.append("candidate_id")
            yield pa.RecordBatch.from_arrays([*columns, _list_column(coef)], names=[*names, "coef"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.select(*keep).schema.fields)
    if candidates is not None:
        ddl += ", candidate_id string"
    return grams.select(*keep, "gram", "moment").mapInArrow(run, f"{ddl}, coef array<double>")


def linear_score(features: Sequence[str], coef: str = "coef") -> Column:
    terms = F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), F.slice(coef, 2, max(1, len(features))), lambda x, c: x * c)
    return F.aggregate(terms, F.col(coef)[0], lambda total, x: total + x)


def member_weights(folds: DataFrame, k: int, members: int, group: str = GROUP) -> DataFrame:
    """(seed, fold, member, group, weight): bootstrap of each fold's train groups.

    Folds are contiguous ranges of the shuffled rank, so the j-th train group of a
    fold is found by arithmetic and a draw needs one join to reach its group.
    """
    ranges = folds.groupBy(SEED, "fold").agg(F.min("rank").alias("_lo"), F.count(F.lit(1)).alias("_size"))
    ranges = with_totals(ranges, [SEED], {"_n": F.sum("_size")})
    slots = (
        folds.join(F.broadcast(ranges.select(SEED, F.col("fold").alias("f"), "_lo", "_size", "_n")), SEED)
        .where("fold <> f")
        .withColumn("_j", F.when(F.col("rank") < F.col("_lo"), F.col("rank")).otherwise(F.col("rank") - F.col("_size")))
        .withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    )
    idx = X.draw_index(F.col("_n") - F.col("_size"), F.col(SEED), F.col("f"), F.col("member"), F.col("_j"))
    hit = slots.select(SEED, "f", "member", "_lo", "_size", idx.alias("_i")).withColumn(
        "rank", F.when(F.col("_i") < F.col("_lo"), F.col("_i")).otherwise(F.col("_i") + F.col("_size")))
    counts = hit.groupBy(SEED, F.col("f").alias("fold"), "member", "rank").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(folds.select(SEED, "rank", group), [SEED, "rank"]).select(SEED, "fold", "member", group, "weight")


def oof_models(
    rows: DataFrame, folds: DataFrame, features: Sequence[str], k: int, members: int, penalty: float, target: str = "target",
    candidates: dict[str, Sequence[str]] | None = None, gram: DataFrame | None = None,
) -> DataFrame:
    """Coefficients per (seed, fold, member), and per feature set if there are ``candidates``, fitted on bootstraps of the train groups."""
    gram = group_gram(rows, features, target) if gram is None else gram
    picked = member_weights(folds, k, members).join(gram, GROUP)
    sums = sum_arrays(picked, [SEED, "fold", "member"], ["gram", "moment"], "weight")
    return solve_ridge(sums, [SEED, "fold", "member"], features, penalty, candidates)


def mean_coefficients(models: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Average model: for linear members the mean prediction is its prediction."""
    total = sum_arrays(models, by, ["coef"])
    return total.select(*by, F.transform("coef", lambda x: x / F.col("n")).alias("coef"), F.col("n").alias("members"))


def oof_predict(rows: DataFrame, folds: DataFrame, features: Sequence[str], k: int = 5, members: int = 3, penalty: float = 1e-3, target: str = "target", per_member: bool = False) -> DataFrame:
    """Each row predicted once per seed by the models that did not see its group.

    The model table has seeds x folds (x members) rows; whether it is broadcast is left to Spark's size estimate.
    """
    models = oof_models(rows, folds, features, k, members, penalty, target)
    table = models if per_member else mean_coefficients(models, [SEED, "fold"], features)
    held = rows.drop(SEED).join(folds.select(SEED, GROUP, "fold"), GROUP)
    return held.join(table, [SEED, "fold"]).withColumn("prediction", linear_score(features)).drop("coef")


def oof_candidate_errors(
    rows: DataFrame, folds: DataFrame, features: Sequence[str], candidates: dict[str, Sequence[str]], k: int = 5, members: int = 3, penalty: float = 1e-3,
    target: str = "target",
) -> DataFrame:
    """(seed, group, candidate_id, rmse): out-of-fold error of every feature set, from one reading of the rows.

    The squared error of a linear model over a group follows from the group's Gram matrix, X'y and y'y, so neither fits nor errors of
    the sets read the rows again. The plan has the same size for any number of features and sets.
    """
    gram = cut(group_gram(rows, features, target))
    models = mean_coefficients(oof_models(rows, folds, features, k, members, penalty, target, candidates, gram), [SEED, "fold", "candidate_id"], features)
    packed = models.groupBy(SEED, "fold").agg(F.sort_array(F.collect_list(F.struct("candidate_id", "coef"))).alias("_m")).select(
        SEED, "fold", F.col("_m.candidate_id").alias("names"), F.flatten(F.col("_m.coef")).alias("coefs"))
    held = gram.join(folds.select(SEED, GROUP, "fold"), GROUP).join(packed, [SEED, "fold"])
    p = len(features) + 1

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g, m, y = (_matrix(b.column(c), b.num_rows) for c in ("gram", "moment", "square"))
            coef = _matrix(b.column("coefs"), b.num_rows).reshape(b.num_rows, -1, p)
            error = np.empty(coef.shape[:2])
            for i in range(b.num_rows):
                fitted = coef[i] @ _full(g[i], p)
                error[i] = y[i, 0] - 2 * coef[i] @ m[i] + (fitted * coef[i]).sum(1)
            rmse = np.sqrt(np.maximum(error, 0) / g[:, :1])
            at = pa.array(np.repeat(np.arange(b.num_rows), coef.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(SEED).take(at), b.column(GROUP).take(at), b.column("names").flatten(), pa.array(rmse.ravel())], names=[SEED, GROUP, "candidate_id", "rmse"])

    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    return held.mapInArrow(run, f"{SEED} {kinds[SEED]}, {GROUP} {kinds[GROUP]}, candidate_id string, rmse double")


#: Ranks of one block of the prefix sums.
RANKS = 256


def scan_arrays(df: DataFrame, key: str, order: str, value: str, reverse: bool = False) -> DataFrame:
    """(key, order, value): the sum of the arrays of all earlier rows of the key, or of all later ones.

    Rows of a key stream through one task in order, which holds one array; give it totals of blocks, not rows.
    """
    ship(df.sparkSession)
    src = df.select(key, order, value)
    sort = F.col(order).desc() if reverse else F.col(order)

    def run(batches):
        own, total = None, None
        for b in batches:
            keys, values = b.column(key).to_pylist(), _matrix(b.column(value), b.num_rows)
            out = np.zeros_like(values)
            for i, k in enumerate(keys):
                if k != own:
                    own, total = k, np.zeros(values.shape[1])
                out[i] = total
                total = total + values[i]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(key), b.column(order), _list_column(out)], names=[key, order, value])

    return src.repartition(key).sortWithinPartitions(key, sort).mapInArrow(run, src.schema)


def outer_draws(splits: DataFrame, members: int) -> DataFrame:
    """(seed, rank, low, high): how often each member draws the group of a rank, for held-out groups of higher and of lower rank.

    A member draws as many slots as a split has train groups, with replacement. Train groups are the ranks from ``cutoff`` on without the held-out
    one, so slot j is rank ``cutoff + j`` below the held-out rank and ``cutoff + j + 1`` above it (and always, where the held-out
    group is among the first ``cutoff``, whose place the validation part then takes).
    """
    train = F.col("others") - F.col("cutoff")
    slots = splits.where(F.col("rank") < train).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    drawn = slots.select(SEED, "cutoff", "member", X.draw_index(train, F.col(SEED), "outer", F.col("member"), F.col("rank")).alias("slot"))
    counts = drawn.groupBy(SEED, "cutoff", "member", "slot").agg(F.count(F.lit(1)).cast("double").alias("w"))
    both = counts.select(SEED, "member", "w", F.inline(F.array(*[
        F.struct((F.col("slot") + F.col("cutoff") + k).alias("rank"), F.lit(k).alias("side")) for k in (0, 1)])))

    def weights(side: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("member") == m), F.col("w"))), F.lit(0.0)) for m in range(members)])

    return both.groupBy(SEED, "rank").agg(weights(0).alias("low"), weights(1).alias("high"))


def outer_models(
    rows: DataFrame, splits: DataFrame, features: Sequence[str], members: int, penalty: float, target: str = "target",
    candidates: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(seed, group, member, [candidate_id,] coef): models for each held-out group, fitted on draws of its train groups.

    ``splits`` are those of ``loso_splits``: neither the held-out group nor its validation part is drawn, and a sample has as many groups as
    the train part. The draws of a member are the same slots for all held-out groups, so a model's Gram matrix is a prefix sum over lower ranks
    plus a suffix sum over higher ones: blocks of RANKS ranks are summed, scanned, and summed again inside. Groups without
    a train part have no model.
    """
    ship(rows.sparkSession)
    blocks = feature_blocks(features, candidates)
    p = len(features) + 1
    width = p * (p + 1) // 2
    zeros = F.array_repeat(F.lit(0.0), members)
    placed = splits.where("others > cutoff").join(outer_draws(splits, members), [SEED, "rank"], "left").select(
        SEED, "rank", GROUP, F.expr(f"rank div {RANKS}").alias("block"), F.coalesce("low", zeros).alias("low"), F.coalesce("high", zeros).alias("high"))
    table = cut(placed.join(group_gram(rows, features, target).select(GROUP, F.concat("gram", "moment").alias("sums")), GROUP))
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    def total(side: str):
        def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
            n = t.num_rows
            values, w = _matrix(t.column("sums"), n), _matrix(t.column(side), n)
            ends = np.append(starts[1:], n)
            out = np.stack([(w[a:z].T @ values[a:z]).ravel() for a, z in zip(starts, ends, strict=True)])
            return t.select([SEED, "block"]).take(pa.array(starts)).append_column(side, _list_column(out))

        return kernel

    flush = max(RANKS, SUM_BYTES // (8 * (width + p)))
    scanned = []
    for side in ("low", "high"):
        sums = B.map_units(table.select(SEED, "block", "rank", side, "sums"), [SEED, "block"], ["rank"], total(side), f"{SEED} {kinds[SEED]}, block bigint, {side} array<double>", flush)
        scanned.append(scan_arrays(sums, SEED, "block", side, reverse=side == "high"))
    around = cut(scanned[0].join(scanned[1], [SEED, "block"]))

    def solve(t: pa.Table, outside: pa.Table) -> pa.Table:
        n = t.num_rows
        order = np.argsort(t.column("rank").to_numpy())
        t = t.take(pa.array(order))
        values = _matrix(t.column("sums"), n)
        coef, at = [], []
        low, high = (_matrix(t.column(c), n) for c in ("low", "high"))
        before, after = (_matrix(outside.column(c), 1).reshape(members, -1) for c in ("low", "high"))
        for m in range(members):
            below = low[:, m: m + 1] * values
            above = high[:, m: m + 1] * values
            sums = before[m] + np.cumsum(below, 0) - below + after[m] + np.cumsum(above[::-1], 0)[::-1] - above
            for i in range(n):
                at.append(i)
                coef.append([ridge_coefficients(sums[i, :width], sums[i, width:], block, penalty) for block in blocks.values()])
        at, coef = np.repeat(at, len(blocks)), np.array(coef).reshape(-1, p)
        out = t.select([SEED, GROUP]).take(pa.array(at))
        out = out.append_column("member", pa.array(np.repeat(np.arange(members), n * len(blocks)).astype(np.int32)))
        if candidates is not None:
            out = out.append_column("candidate_id", pa.array(list(blocks) * (members * n), pa.string()))
        return out.append_column("coef", _list_column(coef))

    ddl = f"{SEED} {kinds[SEED]}, {GROUP} {kinds[GROUP]}, member int, " + ("candidate_id string, " if candidates is not None else "") + "coef array<double>"
    return table.groupBy(SEED, "block").cogroup(around.groupBy(SEED, "block")).applyInArrow(solve, ddl)


def outer_predict(
    rows: DataFrame, splits: DataFrame, features: Sequence[str], members: int = 3, penalty: float = 1e-3, target: str = "target",
) -> DataFrame:
    """Each row predicted once per seed by the mean of the models that have not seen its group nor its validation part."""
    models = mean_coefficients(outer_models(rows, splits, features, members, penalty, target), [SEED, GROUP], features)
    return rows.drop(SEED).join(models, GROUP).withColumn("prediction", linear_score(features)).drop("coef")


def leave_out_selection(values: DataFrame, left_out: DataFrame, candidate: str, value: str, group: str = GROUP) -> DataFrame:
    """Per outer group: the candidate with the lowest mean over the rows that stay, and an audit of these rows.

    ``values`` is (group, candidate, value), ``left_out`` (outer_group, group): what each outer selection must not
    see. Sums over what stays are the totals less the rows left out, so no table of outer and other groups is made. The
    audit counts the outer group's own rows among those summed: what the table has of them less what was taken out.
    """
    every = values.groupBy(candidate).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    out = left_out.join(values, group).groupBy("outer_group", candidate).agg(
        F.sum(value).alias("_os"), F.count(value).alias("_on"), F.count_if(F.col(group) == F.col("outer_group")).alias("_own_out"))
    own = values.groupBy(F.col(group).alias("outer_group"), candidate).agg(F.count(value).alias("_own"))
    outer = values.select(F.col(group).alias("outer_group")).distinct()
    pairs = outer.join(own, "outer_group").join(out, ["outer_group", candidate], "left").join(every, candidate).na.fill(0, ["_os", "_on", "_own_out"])
    mean = (F.col("_s") - F.col("_os")) / (F.col("_n") - F.col("_on"))
    return pairs.groupBy("outer_group").agg(
        F.min(F.struct(F.round(mean, 10).alias("m"), F.col(candidate))).alias("_b"), F.sum(F.col("_n") - F.col("_on")).alias("development_rows"),
        F.sum(F.col("_own") - F.col("_own_out")).alias("outer_rows_used")).select(
        "outer_group", F.col(f"_b.{candidate}").alias(candidate), "development_rows", "outer_rows_used")


def leave_group_out(rows: DataFrame, candidate: str, value: str, group: str = GROUP) -> DataFrame:
    """``leave_out_selection`` with each group its own outer group, from rows (group, array with a ``value`` for each candidate).

    A candidate is named by its place in the array. Only totals and a count a group travel. The audit compares the values that
    all rows of a group have with those taken out for it, which a second row of a group would show.
    """
    each = rows.select(F.posexplode(value).alias("_i", "_x"))
    sums = each.groupBy("_i").agg(F.sum("_x").alias("_s"), F.count("_x").alias("_n"))
    totals = sums.agg(F.array_sort(F.collect_list(F.struct("_i", "_s", "_n"))).alias("_t"), F.sum("_n").alias("_all"))
    taken = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + F.when(x.isNotNull(), 1).otherwise(0))
    own = rows.select(group, taken.alias("_m")).groupBy(group).agg(F.sum("_m").alias("_own"))
    mean = lambda x: (x["_t"]["_s"] - F.coalesce(x[value], F.lit(0.0))) / (x["_t"]["_n"] - F.when(x[value].isNotNull(), 1).otherwise(0))
    best = F.array_min(F.transform(F.arrays_zip(value, "_t"), lambda x, i: F.struct(F.round(mean(x), 10).alias("m"), i.alias("i"))))
    return rows.crossJoin(F.broadcast(totals)).join(own, group).select(
        F.col(group).alias("outer_group"), best["i"].alias(candidate), (F.col("_all") - taken).alias("development_rows"),
        (F.col("_own") - taken).alias("outer_rows_used"))


def fingerprint_of(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def lock(choices: DataFrame) -> DataFrame:
    """A fingerprint over all columns of each choice."""
    return choices.withColumn("lock_sha256", fingerprint_of(*choices.columns))


def selection_lock(choices: DataFrame, development: DataFrame, fold: str = "outer_group", group: str = GROUP) -> DataFrame:
    """One row per fold: the choice, outer rows used (must be 0) and a fingerprint.

    ``development`` is (fold, group, ...) as it entered the selection.
    """
    used = development.groupBy(fold).agg(
        F.count_if(F.col(group) == F.col(fold)).alias("outer_rows_used"), F.count(F.lit(1)).alias("development_rows"))
    return lock(choices.join(used, fold))
