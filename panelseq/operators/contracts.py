"""Data contracts. Each check returns its violations; ``assert_empty`` acts on them.

A violation is (rule_id, severity, key, detail), all strings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, SEQUENCE, TIME
from panelseq.functions import expr as X
from panelseq.operators.joins import missing_extra
from panelseq.session import cut

RATE_COLUMNS = ("missing_rate", "feature_missing_rate", "label_missing_rate")


class ContractError(ValueError):
    pass


def assert_empty(violations: DataFrame, show: int = 5) -> None:
    found = violations.limit(show).collect()
    if found:
        raise ContractError("; ".join(f"{r.rule_id} {r.key}: {r.detail}" for r in found))


def _key(cols: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    return F.concat_ws("|", *parts) if parts else F.lit("")


def _as_violations(df: DataFrame, rule: str, keys: Sequence[str], detail: Column | str, severity: str = "error") -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), _key(keys).alias("key"), d.alias("detail"))


def _rules(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple]) -> DataFrame:
    """Several row rules in one pass: (rule id, condition, detail[, severity])."""
    made = []
    for rule, broken, detail, *severity in rules:
        d = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
        made.append(F.when(broken, F.struct(
            F.lit(rule).alias("rule_id"), F.lit(severity[0] if severity else "error").alias("severity"),
            _key(keys).alias("key"), d.alias("detail"))))
    return df.select(F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ manifest rules
def _coverage(observed: DataFrame, expected: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return _as_violations(missing_extra(observed, expected, keys), rule, keys, F.col("kind"))


def validate_manifest(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Coverage, mapping, file quality, duplicates and cross-role alignment."""
    df = cut(df)
    good = df.where(F.col("scan_status").isin("ok", "success", "dry_run"))
    known = good.where(f"{RECORDING} is not null and {GROUP} is not null")
    owner = mapping.select(RECORDING, F.col(GROUP).alias("_owner"))
    fine = F.col("scan_status").isin("ok", "success", "dry_run")
    has_ids = F.expr(f"{RECORDING} is not null and {GROUP} is not null")
    by_row = [
        ("file_error", F.col("scan_status") == "error", F.coalesce("error_message", F.lit(""))),
        ("unresolved", fine & ~has_ids, "no recording or group"),
        ("mapping_conflict", fine & has_ids & ~F.col("_owner").eqNullSafe(F.col(GROUP)), F.concat_ws(" is not ", GROUP, "_owner")),
        ("empty_file", fine & (F.col("file_size_bytes") <= 0), "empty"),
        ("sample_count", fine & (F.col("sample_count") <= 0), F.col("sample_count")),
        ("label_range", fine & F.expr("label_min > label_max"), "min above max"),
        ("label_range", fine & F.expr("label_min <= label_max and (label_min < 0 or label_max > 1)"), "outside [0,1]", "warning"),
        *[(c, fine & F.expr(f"{c} < 0 or {c} > 1"), F.col(c)) for c in RATE_COLUMNS],
    ]
    rules = [
        _rules(df.join(owner, RECORDING, "left"), ["relative_path"], by_row),
        _coverage(known.select(GROUP), mapping.select(GROUP), [GROUP], "group_coverage"),
        _coverage(known.select(RECORDING), mapping.select(RECORDING), [RECORDING], "recording_coverage"),
    ]

    def repeated(src: DataFrame, keys: Sequence[str], rule: str, severity: str = "error") -> DataFrame:
        twice = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        return _as_violations(twice, rule, keys, F.col("_n"), severity)

    rules += [
        repeated(df.where("file_path is not null"), ["file_path"], "duplicate_path"),
        repeated(good.where("sha256 is not null"), ["sha256"], "duplicate_hash", "warning"),
        repeated(good.where(f"{RECORDING} is not null"), ["condition", RECORDING], "duplicate_recording"),
    ]
    counts = good.where(f"{RECORDING} is not null").groupBy(RECORDING).agg(
        F.min("sample_count").alias("_lo"), F.max("sample_count").alias("_hi"))
    rules.append(_as_violations(counts.where("_lo < _hi"), "sample_mismatch", [RECORDING], F.concat_ws("..", "_lo", "_hi")))
    several = mapping.groupBy(GROUP).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(GROUP)
    rules.append(_coverage(
        known.select(GROUP, RECORDING).join(several, GROUP, "left_semi"),
        mapping.select(GROUP, RECORDING).join(several, GROUP, "left_semi"), [GROUP, RECORDING], "multi_recording_group"))
    return union_all(rules)


def validate_mapping(mapping: DataFrame, groups: DataFrame, recordings: DataFrame) -> DataFrame:
    """Exact id sets; a recording has one owner."""
    owners = mapping.groupBy(RECORDING).agg(F.count_distinct(GROUP).alias("_n"), F.count(F.lit(1)).alias("_m"))
    return union_all([
        _coverage(mapping, groups, [GROUP], "group_ids"),
        _coverage(mapping, recordings, [RECORDING], "recording_ids"),
        _as_violations(owners.where("_m > 1"), "shared_recording", [RECORDING], F.col("_m")),
    ])


def manifest_summary(df: DataFrame, columns: Sequence[str] = ("condition", "data_role", "scan_status")) -> DataFrame:
    """(measure, value, n): totals, distinct ids and value counts per column."""
    total = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("scan_status").isin("ok", "success")).alias("ok"),
        F.count_if(F.col("scan_status") == "error").alias("error"),
        F.count_distinct(GROUP).alias("groups"), F.count_distinct(RECORDING).alias("recordings"),
    )
    names = ["total", "ok", "error", "groups", "recordings"]
    head = total.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.lit(None).cast("string").alias("value"), F.col(n).alias("n")) for n in names])))
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in columns])))
    return head.unionByName(values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")))


def require_roles(df: DataFrame, roles: Sequence[str], role: str = "data_role") -> DataFrame:
    """Each recording has exactly one file of each role."""
    counts = df.groupBy(RECORDING).agg(*[F.count_if(F.col(role) == r).alias(f"_r{i}") for i, r in enumerate(roles)])
    rows = counts.select(RECORDING, F.inline(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(f"_r{i}").alias("n")) for i, r in enumerate(roles)])))
    return _as_violations(rows.where("n <> 1"), "one_file_per_role", [RECORDING, "role"], F.col("n"))


# ------------------------------------------------------------------ shapes
# The six axis orders of a 3-D array as (time, channel, band) positions.
AXIS_ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def canonical_axes(df: DataFrame, samples: int | Column, channels: int, bands: int, shape: str = "shape", values: str = "values") -> DataFrame:
    """Flat row-major array of any axis order -> rows (time_index, channel, band, value).

    ``matches`` counts the axis orders that fit the declared sizes; arrays for
    which it is not 1 give one row with null indices instead of values.
    """
    n = samples if isinstance(samples, Column) else F.lit(samples)
    want = [n, F.lit(channels), F.lit(bands)]
    s = F.col(shape)
    options = F.array(*[
        F.when((F.size(s) == 3) & (s[o[0]] == want[0]) & (s[o[1]] == want[1]) & (s[o[2]] == want[2]), F.array(*[F.lit(x) for x in o]))
        for o in AXIS_ORDERS
    ])
    tagged = df.withColumn("_fit", F.filter(options, lambda o: o.isNotNull())).withColumn("matches", F.size("_fit"))
    rest = [c for c in df.columns if c not in (shape, values)]
    bad = tagged.where("matches <> 1").select(
        *rest, "matches", *[F.lit(None).cast("int").alias(c) for c in (TIME, "channel", "band")],
        F.lit(None).cast("double").alias("value"))
    flat = tagged.where("matches = 1").select(
        *rest, "matches", s.alias("_shape"), F.element_at("_fit", 1).alias("_axis"), F.posexplode(values).alias("_p", "value"))
    axes = [F.expr(f"_p div (_shape[1] * _shape[2])"), F.expr("(_p div _shape[2]) % _shape[1]"), F.expr("_p % _shape[2]")]
    flat = flat.withColumn("_i", F.array(*[a.cast("int") for a in axes]))
    i, ax = F.col("_i"), F.col("_axis")
    good = flat.select(*rest, "matches", i[ax[0]].alias(TIME), i[ax[1]].alias("channel"), i[ax[2]].alias("band"), "value")
    return good.unionByName(bad)


def canonical_vector(df: DataFrame, samples: int | Column, vector: str = "label") -> DataFrame:
    """Accept shapes (T,1) and (1,T) given as nested arrays; (T) is a single row of T.

    Adds ``valid`` and the flat ``vector_out`` (null when the shape is not allowed).
    """
    n = samples if isinstance(samples, Column) else F.lit(samples)
    v = F.col(vector)
    row = (F.size(v) == 1) & (F.size(v[0]) == n)
    column = (F.size(v) == n) & F.forall(v, lambda r: F.size(r) == 1)
    return df.withColumn("valid", row | column).withColumn("vector_out", F.when(F.col("valid"), F.flatten(v)))


def handle_nonfinite(df: DataFrame, cols: Sequence[str], strategy: str = "error") -> DataFrame:
    """``zero`` replaces null, NaN and infinities; ``error`` raises on the first."""
    if strategy not in ("error", "zero"):
        raise ValueError(f"unknown strategy {strategy!r}")
    def fixed(c: str) -> Column:
        if strategy == "zero":
            return F.when(X.nonfinite(c), 0.0).otherwise(F.col(c))
        return F.when(X.nonfinite(c), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c))
    return df.withColumns({c: fixed(c) for c in cols})


def nonfinite_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Repair count per modality (column)."""
    agg = df.groupBy(*by).agg(*[F.count_if(X.nonfinite(c)).alias(c) for c in cols])
    return agg.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("modality"), F.col(c).alias("nonfinite_count")) for c in cols])))


def validate_alignment(first: DataFrame, second: DataFrame, label: DataFrame, key: str = RECORDING, strict: bool = True) -> DataFrame:
    """The three modalities of a recording have the same number of rows."""
    parts = [
        d.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(m))
        for m, d in (("first", first), ("second", second), ("label", label))
    ]
    lengths = union_all(parts).groupBy(key).agg(*[
        F.coalesce(F.max(F.when(F.col("m") == m, F.col("n"))), F.lit(0)).alias(m) for m in ("first", "second", "label")])
    bad = lengths.where("first <> second or second <> label")
    return _as_violations(bad, "modality_length", [key], F.concat_ws(",", "first", "second", "label"), "error" if strict else "warning")


# ------------------------------------------------------------------ keys, order, domain
def check_contiguous(df: DataFrame, keys: Sequence[str] = SEQUENCE, t: str = TIME) -> DataFrame:
    """Index is exactly 0..n-1: (min, max, rows, distinct) per sequence."""
    s = (
        df.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("_m"))
        .groupBy(*keys).agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.sum("_m").alias("n"), F.count(F.lit(1)).alias("d"))
    )
    bad = s.where("lo <> 0 or hi <> n - 1 or d <> n")
    return _as_violations(bad, "contiguous_index", keys, F.concat_ws(",", "lo", "hi", "n", "d"))


def first_gap(df: DataFrame, keys: Sequence[str] = SEQUENCE, t: str = TIME) -> DataFrame:
    """First index of each sequence whose predecessor is absent (0 excepted)."""
    have = df.select(*keys, F.col(t).alias("_t")).distinct()
    need = have.withColumn("_prev", F.col("_t") - 1)
    gap = need.join(have.withColumnRenamed("_t", "_prev"), [*keys, "_prev"], "left_anti").where("_t > 0")
    return gap.groupBy(*keys).agg(F.min("_t").alias("first_gap"))


def require_target_free(df: DataFrame, allowed: Sequence[str] = (*SEQUENCE, TIME, "fast", "slow")) -> DataFrame:
    """Column-set firewall: schema only, no job."""
    extra, missing = sorted(set(df.columns) - set(allowed)), sorted(set(allowed) - set(df.columns))
    if extra or missing:
        raise ContractError(f"column set differs: extra={extra} missing={missing}")
    return df.select(*allowed)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _as_violations(twice, "unique_key", keys, F.col("_n"))


def check_domain(df: DataFrame, cols: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Columns with non-finite values or values outside [low, high], with counts."""
    out = lambda c: X.nonfinite(c) | (F.col(c) < low) | (F.col(c) > high)
    agg = df.agg(*[F.count_if(out(c)).alias(c) for c in cols])
    rows = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in cols])))
    return _as_violations(rows.where("n > 0"), "value_domain", ["column"], F.col("n"))


def validate_inventory(df: DataFrame, mapping: DataFrame, seeds: Sequence[int], rows: int | None = None) -> DataFrame:
    """Group -> recording -> seed all present, with the declared row count.

    The count is ``rows``, or the mapping's ``rows`` column when not given.
    """
    need = mapping.withColumn(SEED, F.explode(F.array(*[F.lit(s) for s in seeds])))
    need = need.withColumn("_want", F.lit(rows).cast("long") if rows is not None else F.col("rows").cast("long"))
    have = df.groupBy(*SEQUENCE).agg(F.count(F.lit(1)).alias("_have"))
    j = have.join(need.select(*SEQUENCE, "_want"), list(SEQUENCE), "full")
    seq = [_rules(j, SEQUENCE, [
        ("inventory_missing", F.col("_have").isNull(), F.col("_want")),
        ("inventory_extra", F.col("_want").isNull(), F.col("_have")),
        ("inventory_rows", F.col("_have") != F.col("_want"), F.concat_ws(" of ", "_have", "_want")),
    ])]
    owners = mapping.groupBy(RECORDING).agg(F.count_distinct(GROUP).alias("_n")).where("_n > 1")
    seq.append(_as_violations(owners, "shared_recording", [RECORDING], F.col("_n")))
    return union_all(seq)


def validate_ledger(ledger: DataFrame, roots: DataFrame, dims: dict[str, Sequence], root: Sequence[str] = (GROUP, RECORDING, "t0")) -> DataFrame:
    """Every root carries the full combination of ``dims`` once, and nothing else.

    Distinct combinations inside the declared domain, rows and expected number
    per root prove full coverage without building the product.
    """
    root = list(root)
    want = 1
    inside = F.lit(True)
    for c, values in dims.items():
        want *= len(values)
        inside = inside & F.coalesce(F.col(c).isin(*values), F.lit(False))
    combos = ledger.groupBy(*root, *dims).agg(F.count(F.lit(1)).alias("_m")).withColumn("_in", inside)
    per_root = combos.groupBy(*root).agg(
        F.count_if("_in").alias("_ok"), F.count_if(~F.col("_in")).alias("_foreign"), F.count_if(F.col("_m") > 1).alias("_twice"))
    j = per_root.join(roots.select(*root).distinct().withColumn("_root", F.lit(1)), root, "full")
    return _rules(j, root, [
        ("extra_root", F.col("_root").isNull(), "not an accepted root"),
        ("missing_root", F.col("_ok").isNull(), "no rows"),
        ("incomplete_root", (F.col("_root") == 1) & (F.col("_ok") < want), F.col("_ok")),
        ("foreign_branch", F.col("_foreign") > 0, F.col("_foreign")),
        ("repeated_branch", F.col("_twice") > 0, F.col("_twice")),
    ])


def validate_roots(roots: DataFrame, expected: DataFrame | None, low: int, high: int | None, count: int | None = None, root: Sequence[str] = (GROUP, RECORDING, "t0")) -> DataFrame:
    root = list(root)
    outside = F.col("t0") < low
    if high is not None:
        outside = outside | (F.col("t0") > high)
    rules = [_as_violations(roots.where(outside), "root_range", root, F.col("t0"))]
    if expected is None:
        rules.append(check_unique(roots, root))
    else:
        # Both sides are counted in one grouping, which serves the two rules about keys.
        sides = roots.select(*root, F.lit(1).alias("_o"), F.lit(0).alias("_e")).unionByName(expected.select(*root, F.lit(0).alias("_o"), F.lit(1).alias("_e")))
        counts = sides.groupBy(*root).agg(F.sum("_o").alias("_o"), F.sum("_e").alias("_e"))
        rules.append(_rules(counts, root, [
            ("unique_key", F.col("_o") > 1, F.col("_o")), ("root_set", F.col("_e") == 0, "extra"), ("root_set", F.col("_o") == 0, "missing")]))
    if count is not None:
        n = roots.agg(F.count(F.lit(1)).alias("_n"))
        rules.append(_as_violations(n.where(F.col("_n") != count), "root_count", [], F.col("_n")))
    return union_all(rules)


# ------------------------------------------------------------------ agreement of two tables
def _paired(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    left = a.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    right = b.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    return left.join(right, list(keys), "full")


def align_frames(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Keys on one side only, and values further apart than ``eps``."""
    j = _paired(a, b, keys, cols)
    rules: list[tuple] = [("only_left", F.col("_r").isNull(), ""), ("only_right", F.col("_l").isNull(), "")]
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in cols:
        gap = F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))
        one_null = F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull()
        rules.append((f"differs_{c}", both & (F.coalesce(gap > eps, F.lit(False)) | one_null), gap))
    return _rules(j, keys, rules)


def max_abs_error(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(column, max_abs_error, paired, unpaired): one pass over the joined keys."""
    j = _paired(a, b, keys, cols)
    aggs = [F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(c) for c in cols]
    one = j.agg(*aggs, F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("_p"), F.count(F.lit(1)).alias("_t"))
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("max_abs_error"), F.coalesce("_p", F.lit(0)).alias("paired"),
                 (F.col("_t") - F.coalesce("_p", F.lit(0))).alias("unpaired")) for c in cols])))


def check_groups(df: DataFrame, expected: DataFrame, method: str | None = None, methods: Sequence[str] = (), group: str = GROUP) -> DataFrame:
    """Exactly the expected groups, once each, for every method."""
    keys = [group] + ([method] if method else [])
    need = expected.select(group).distinct()
    if method:
        need = need.withColumn(method, F.explode(F.array(*[F.lit(m) for m in methods])))
    return union_all([_coverage(df, need, keys, "group_set"), check_unique(df, keys)])


def check_bindings(files: DataFrame, registry: DataFrame, path: str = "relative_path") -> DataFrame:
    """Each registered file exists and has its registered hash."""
    j = registry.select(path, F.col("sha256").alias("_want")).join(
        files.select(path, F.col("sha256").alias("_have"), F.lit(1).alias("_f")), path, "left")
    return _rules(j, [path], [
        ("missing_file", F.col("_f").isNull(), "absent"),
        ("changed_file", F.col("_f").isNotNull() & ~F.col("_have").eqNullSafe(F.col("_want")), "hash differs"),
    ])


def check_splits(splits: DataFrame, group: str = GROUP) -> DataFrame:
    """(seed, fold, group, role): roles disjoint, each group validated exactly once."""
    per_fold = splits.groupBy(SEED, "fold", group).agg(F.count_distinct("role").alias("_roles"))
    per_seed = splits.groupBy(SEED, group).agg(F.count_if(F.col("role") == "validation").alias("_v"))
    return union_all([
        _as_violations(per_fold.where("_roles > 1"), "overlapping_roles", [SEED, "fold", group], F.col("_roles")),
        _as_violations(per_seed.where("_v <> 1"), "validated_once", [SEED, group], F.col("_v")),
    ])


def check_printed(stored: DataFrame, printed: DataFrame, keys: Sequence[str], value: str = "value", token: str = "token") -> DataFrame:
    """A printed decimal equals the stored value within half a unit of its last digit.

    Tokens in exponent form are taken to nine digits.
    """
    j = stored.select(*keys, F.col(value).alias("_v")).join(printed.select(*keys, F.col(token).alias("_tok")), list(keys), "full")
    tok = F.regexp_replace("_tok", "−", "-")
    digits = F.when(F.lower(tok).contains("e"), 9).otherwise(F.coalesce(F.length(F.split(tok, "[.]").getItem(1)), F.lit(0)))
    j = j.withColumn("_gap", F.abs(F.col("_v") - tok.cast("double"))).withColumn("_tol", 0.5 * F.pow(F.lit(10.0), -digits) + 1e-15)
    return _rules(j, keys, [
        ("unpaired_number", F.expr("_v is null or _tok is null"), "one copy only"),
        ("printed_number", F.expr("_gap > _tol"), F.col("_tok")),
    ])


def printed_numbers(df: DataFrame, cell: str) -> DataFrame:
    """Decimal tokens of a text cell, in order."""
    return df.withColumn("tokens", F.regexp_extract_all(cell, F.lit(r"([+−-]?\d+\.\d+(?:[eE][+-]?\d+)?)"), 1))


def check_copies(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one copy without an equal row in the other."""
    cols = a.columns
    if set(cols) != set(b.columns):
        raise ContractError("copies have different columns")
    return union_all([
        _as_violations(a.exceptAll(b.select(*cols)), "only_in_first", keys, ""),
        _as_violations(b.select(*cols).exceptAll(a), "only_in_second", keys, ""),
    ])


def check_identity(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Configuration rows agree on every field (nulls equal)."""
    cols = [c for c in a.columns if c not in keys] if cols is None else list(cols)
    j = _paired(a, b, keys, cols)
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").cast("string").alias("x"), F.col(f"_b_{c}").cast("string").alias("y"))
        for c in cols])
    both = j.where("_l = 1 and _r = 1").select(*keys, F.inline(fields)).where(~F.col("x").eqNullSafe(F.col("y")))
    return union_all([
        _as_violations(j.where("_r is null or _l is null"), "unpaired_identity", keys, F.when(F.col("_l").isNull(), "second").otherwise("first")),
        _as_violations(both, "identity_field", [*keys, "field"], F.concat_ws(" is not ", F.coalesce("x", F.lit("null")), F.coalesce("y", F.lit("null")))),
    ])
