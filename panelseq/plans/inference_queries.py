"""Bootstrap, sign flips, claims, folds and out-of-fold models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, TIME
from panelseq.operators import claims as C
from panelseq.operators import infer as I
from panelseq.operators import oof as O
from panelseq.operators import splits as SP
from panelseq.operators.select import with_totals
from panelseq.plans import feature_queries as FQ
from panelseq.plans import panels as P
from panelseq.plans import sql_parts as S
from panelseq.plans.registry import q, query, r
from panelseq.session import cut

LANGS = ("de", "es", "fr")

# ------------------------------------------------------------------ group vectors
_LANG_SQL = """t AS MATERIALIZED (SELECT source AS group_id, avg(ln(1 + n_chars)) FILTER (lang = 'en') AS en,
  avg(ln(1 + n_chars)) FILTER (lang = 'de') AS de, avg(ln(1 + n_chars)) FILTER (lang = 'es') AS es, avg(ln(1 + n_chars)) FILTER (lang = 'fr') AS fr
  FROM documents GROUP BY source),
v AS MATERIALIZED (SELECT group_id, en - de AS de, en - es AS es, en - fr AS fr FROM t WHERE en IS NOT NULL AND de IS NOT NULL AND es IS NOT NULL AND fr IS NOT NULL),
i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS idx, count(*) OVER () AS n FROM v)"""


def lang_gaps(spark, sf) -> DataFrame:
    """Per source: mean log length of English texts minus each other language."""
    d = P.table(spark, sf, "documents").select(F.col("source").alias(GROUP), "lang", F.log1p(F.col("n_chars").cast("double")).alias("n"))
    wide = d.groupBy(GROUP).agg(*[F.avg(F.when(F.col("lang") == x, F.col("n"))).alias(x) for x in ("en", *LANGS)])
    return wide.na.drop().select(GROUP, *[(F.col("en") - F.col(x)).alias(x) for x in LANGS])


_USER_SQL = f"{S.SEQ}, u AS MATERIALIZED (SELECT group_id, avg(value) AS x, max(value) AS y, row_number() OVER (ORDER BY md5(group_id::VARCHAR)) - 1 AS idx, count(*) OVER () AS n FROM seq GROUP BY group_id)"


def user_values(spark, sf) -> DataFrame:
    return P.event_sequences(spark, sf).groupBy(GROUP).agg(F.avg("value").alias("x"), F.max("value").alias("y"))


@query("bootstrap_means", f"""WITH {_USER_SQL}, d AS (SELECT b AS draw, ('0x' || substr(md5('20260905:' || b || ':' || u.idx), 1, 8))::BIGINT % u.n AS idx FROM range(10000) t(b), u)
SELECT draw, {q('avg(u.x)', 'x')}, {q('avg(u.y)', 'y')} FROM d JOIN u USING (idx) GROUP BY draw""")
def bootstrap_means(spark, sf):
    return I.bootstrap_means(user_values(spark, sf), ["x", "y"]).select("draw", r("x"), r("y"))


@query("paired_bootstrap", f"""WITH {_USER_SQL}, d AS (SELECT b AS draw, ('0x' || substr(md5('20260905:' || b || ':' || u.idx), 1, 8))::BIGINT % u.n AS idx FROM range(10000) t(b), u),
m AS (SELECT draw, avg(x) AS x, avg(y) AS y, avg(y - x) AS gap FROM d JOIN u USING (idx) GROUP BY draw)
SELECT 'difference' AS identity, max(abs(gap - (y - x))) < 1e-9 AS holds, {q('max(gap)', 'top_gap')} FROM m""")
def paired_bootstrap(spark, sf):
    v = user_values(spark, sf).withColumn("gap", F.col("y") - F.col("x"))
    means = cut(I.bootstrap_means(v, ["x", "y", "gap"]))
    d = I.identity_gaps(means, {"difference": (F.col("gap"), F.col("y") - F.col("x"))})
    top = means.agg(r(F.max("gap"), 6, "top_gap"))
    return d.select("identity", (F.col("max_abs_error") < 1e-9).alias("holds"), F.lit(1).alias("_k")).join(
        F.broadcast(top.withColumn("_k", F.lit(1))), "_k").drop("_k")


_BCA = ("estimate", "lower", "upper", "acceleration", "leave_out_low", "leave_out_high", "q1", "median", "q3")
_BCA_SQL = f"""{q('estimate')}, {q('lower_', 'lower')}, {q('upper_', 'upper')}, {q('acceleration')}, {q('leave_out_low')}, {q('leave_out_high')}, {q('q1')}, {q('med', 'median')}, {q('q3')}, n,
  CASE WHEN lower_ IS NULL THEN 'DEGENERATE' ELSE 'AVAILABLE' END AS status"""


@query("bca_interval", f"""WITH {_LANG_SQL}, lv AS ({' UNION ALL '.join(f"SELECT '{x}' AS quantity, group_id, {x} AS value FROM v" for x in LANGS)}), {S.bca('lv', 'quantity')}
SELECT quantity, {_BCA_SQL} FROM bc""")
def bca_interval(spark, sf):
    long = C.unpivot(lang_gaps(spark, sf), [GROUP], list(LANGS))
    return I.bca_family(long, ["quantity"]).select("quantity", *[r(c) for c in _BCA], "n", "status")


@query("jackknife", f"""WITH {_LANG_SQL}, j AS (SELECT (sum(de) OVER () - de) / (n - 1) AS j FROM i), c AS (SELECT avg(j) OVER () - j AS d FROM j)
SELECT {q('sum(d * d * d) / (6 * pow(sum(d * d), 1.5))', 'acceleration')} FROM c""")
def jackknife(spark, sf):
    return I.jackknife_acceleration(lang_gaps(spark, sf), "de").select(r("acceleration"))


_FLIP = " UNION ALL ".join(
    f"SELECT '{x}' AS comparison_id, k, abs(sum(CASE WHEN (k >> idx) & 1 = 0 THEN {x} ELSE -{x} END)) / any_value(n) AS m, any_value(o.obs) AS obs FROM i, range((1 << (SELECT count(*) FROM i))::BIGINT) g(k), (SELECT abs(avg({x})) AS obs FROM i) o GROUP BY k"
    for x in LANGS)
_P = f"""{_LANG_SQL}, f AS ({_FLIP}), p AS (SELECT comparison_id, count(*) AS total, count(*) FILTER (m >= obs - 7.1e-15) AS extreme,
  count(*) FILTER (m >= obs - 7.1e-15) / count(*)::DOUBLE AS p FROM f GROUP BY comparison_id)"""


def flip_tests(spark, sf) -> DataFrame:
    return I.sign_flip(cut(lang_gaps(spark, sf)), LANGS)


@query("sign_flip_test", f"WITH {_P} SELECT comparison_id, 'exact' AS method, total, extreme, {q('p', 'p', 9)} FROM p")
def sign_flip_test(spark, sf):
    return flip_tests(spark, sf).select("comparison_id", "method", "total", "extreme", r("p", 9))


@query("holm_adjustment", f"""WITH {_P}, s AS (SELECT *, row_number() OVER (ORDER BY p, comparison_id) AS k, count(*) OVER () AS m FROM p)
SELECT comparison_id, {q('p', 'p', 9)}, {q('max(least(1, (m - k + 1) * p)) OVER (ORDER BY p, comparison_id ROWS UNBOUNDED PRECEDING)', 'holm_p', 9)} FROM s""")
def holm_adjustment(spark, sf):
    return I.holm(flip_tests(spark, sf)).select("comparison_id", r("p", 9), r("holm_p", 9))


# One comparison an order: whether its mean line price differs from that of all lines. The p value is the
# bound 2 exp(-z^2 / 2) of a normal tail, and the family is the whole table.
_ORDER_P = """t AS MATERIALIZED (SELECT l_orderkey AS comparison_id, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY l_orderkey),
p AS MATERIALIZED (SELECT comparison_id, least(1.0, 2 * exp(-n * pow((m - (SELECT avg(l_extendedprice) FROM lineitem)) / sd, 2) / 2)) AS p FROM t WHERE n > 1 AND sd > 0)"""


def order_p_values(spark, sf) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("comparison_id"), "l_extendedprice")
    price = F.col("l_extendedprice")
    orders = lines.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), F.stddev_samp(price).alias("sd"))
    of_all = with_totals(orders, (), {"_total": F.sum("total"), "_n": F.sum("n")}).where("n > 1 AND sd > 0")
    z = (F.col("total") / F.col("n") - F.col("_total") / F.col("_n")) / F.col("sd")
    return of_all.select("comparison_id", F.least(F.lit(1.0), 2 * F.exp(-F.col("n") * z * z / 2)).alias("p"))


@query("holm_whole_table", f"""WITH {_ORDER_P}, s AS (SELECT *, row_number() OVER (ORDER BY p, comparison_id) AS k, count(*) OVER () AS m FROM p)
SELECT comparison_id, {q('p', 'p', 6)}, {q('max(least(1, (m - k + 1) * p)) OVER (ORDER BY p, comparison_id ROWS UNBOUNDED PRECEDING)', 'holm_p', 6)} FROM s""")
def holm_whole_table(spark, sf):
    return I.holm(order_p_values(spark, sf)).select("comparison_id", r("p", 6), r("holm_p", 6))


# ------------------------------------------------------------------ claims
# A claim is a (language, construction): per source, a centre of log length minus
# the source's own centre; the constructions are the mean and the maximum.
_CLAIM_SQL = f"""b AS (SELECT source AS group_id, avg(ln(1 + n_chars)) AS m, max(ln(1 + n_chars)) AS x FROM documents GROUP BY source),
l AS (SELECT source AS group_id, lang, avg(ln(1 + n_chars)) AS m, max(ln(1 + n_chars)) AS x FROM documents GROUP BY ALL),
long AS MATERIALIZED (SELECT lang || '__mean' AS claim_id, group_id, l.m - b.m AS value FROM l JOIN b USING (group_id)
  UNION ALL SELECT lang || '__max', group_id, l.x - b.x FROM l JOIN b USING (group_id)),
{S.bca('long', 'claim_id')},
st AS MATERIALIZED (SELECT claim_id, avg(value) AS mean, count(*) AS n, any_value(lower_) AS lower_, any_value(upper_) AS upper_,
  count(*) FILTER (value > 1e-12) AS pos, count(*) FILTER (value < -1e-12) AS neg, count(*) FILTER (abs(value) <= 1e-12) AS zero FROM long JOIN bc USING (claim_id) GROUP BY claim_id),
cs AS MATERIALIZED (SELECT *, CASE WHEN neg + zero = 0 THEN 'ALL_POSITIVE' WHEN pos + zero = 0 THEN 'ALL_NEGATIVE' WHEN pos > neg THEN 'POSITIVE_MAJORITY' WHEN neg > pos THEN 'NEGATIVE_MAJORITY' ELSE 'TIED_MAJORITY' END AS majority,
  CASE WHEN mean > 1e-12 THEN 'POSITIVE' WHEN mean < -1e-12 THEN 'NEGATIVE' ELSE 'ZERO' END AS mean_direction,
  CASE WHEN lower_ > 0 THEN 'POSITIVE_SUPPORTED' WHEN upper_ < 0 THEN 'NEGATIVE_SUPPORTED' ELSE 'SPANS_ZERO' END AS ci_support FROM st)"""


def claim_values(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = P.table(spark, sf, "documents").select(F.col("source").alias(GROUP), "lang", F.log1p(F.col("n_chars").cast("double")).alias("n"))
    base = d.groupBy(GROUP).agg(F.avg("n").alias("_m"), F.max("n").alias("_x"))
    per = d.groupBy(GROUP, "lang").agg(F.avg("n").alias("m"), F.max("n").alias("x")).join(base, GROUP)
    long = per.select(GROUP, F.inline(F.array(
        F.struct(F.concat("lang", F.lit("__mean")).alias("claim_id"), (F.col("m") - F.col("_m")).alias("value")),
        F.struct(F.concat("lang", F.lit("__max")).alias("claim_id"), (F.col("x") - F.col("_x")).alias("value")))))
    long = cut(long)
    return long, I.bca_family(long, ["claim_id"]).select("claim_id", "lower", "upper")


def claim_pairs(spark) -> DataFrame:
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", *LANGS)]))
    return spark.range(1).select(langs.alias("comparison_id")).withColumns({
        "source_claim": F.concat("comparison_id", F.lit("__mean")), "destination_claim": F.concat("comparison_id", F.lit("__max"))})


def claim_transitions(long: DataFrame) -> DataFrame:
    lang = F.split("claim_id", "__")[0].alias("comparison_id")
    side = lambda s: long.where(F.col("claim_id").endswith(s)).select(lang, GROUP, "value")
    return C.transition_rows(side("__mean"), side("__max"))


@query("claim_states", f"WITH {_CLAIM_SQL} SELECT claim_id, {q('mean', 'population_mean')}, n AS n_groups, pos AS positive_groups, neg AS negative_groups, zero AS zero_groups, majority, mean_direction, ci_support FROM cs")
def claim_states(spark, sf):
    d = C.claim_states(*claim_values(spark, sf))
    return d.select("claim_id", r("population_mean"), "n_groups", "positive_groups", "negative_groups", "zero_groups", "majority", "mean_direction", "ci_support")


@query("sign_counts", f"WITH {_CLAIM_SQL} SELECT claim_id, pos AS positive_groups, neg AS negative_groups, zero AS zero_groups FROM cs")
def sign_counts(spark, sf):
    return C.sign_counts(claim_values(spark, sf)[0], "value", ["claim_id"])


@query("majority_category", f"""WITH {_CLAIM_SQL} SELECT claim_id, majority, CASE WHEN majority IN ('ALL_POSITIVE', 'POSITIVE_MAJORITY') THEN 1
  WHEN majority IN ('ALL_NEGATIVE', 'NEGATIVE_MAJORITY') THEN -1 ELSE 0 END AS majority_polarity FROM cs""")
def majority_category(spark, sf):
    d = C.majority(C.sign_counts(claim_values(spark, sf)[0], "value", ["claim_id"]))
    return d.select("claim_id", "majority", "majority_polarity")


@query("heterogeneity", f"""WITH {_CLAIM_SQL}, qs AS (SELECT claim_id, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3,
  sum(value) FILTER (value > 1e-12) AS ps, sum(value) FILTER (value < -1e-12) AS ns, max(abs(value)) AS top FROM long GROUP BY claim_id),
md AS (SELECT claim_id, median(abs(value - med)) AS mad FROM long JOIN qs USING (claim_id) GROUP BY claim_id),
x AS (SELECT *, abs(pos - neg) AS margin FROM cs JOIN qs USING (claim_id) JOIN md USING (claim_id))
SELECT claim_id, {q('q3 - q1', 'iqr')}, {q('mad')}, margin AS majority_margin,
  CASE WHEN margin > 0 THEN margin // 2 + 1 WHEN pos + neg > 0 THEN 1 END AS flips_to_reverse,
  {q('abs(mean) / (q3 - q1)', 'abs_mean_over_iqr', 5)}, {q('coalesce(ps, 0)', 'positive_sum')}, {q('coalesce(ns, 0)', 'negative_sum')},
  mean_direction <> CASE WHEN med > 1e-12 THEN 'POSITIVE' WHEN med < -1e-12 THEN 'NEGATIVE' ELSE 'ZERO' END AS mean_median_disagree,
  mean_direction <> 'ZERO' AND ci_support = 'SPANS_ZERO' AS directional_but_spans_zero,
  (SELECT max(group_id) FROM long WHERE long.claim_id = x.claim_id AND abs(long.value) = x.top) AS largest_group FROM x""")
def heterogeneity(spark, sf):
    long, intervals = claim_values(spark, sf)
    d = C.heterogeneity(long, intervals=intervals)
    return d.select("claim_id", r("iqr"), r("mad"), "majority_margin", "flips_to_reverse", r("abs_mean_over_iqr", 5), r("positive_sum"), r("negative_sum"),
                    "mean_median_disagree", "directional_but_spans_zero", "largest_group")


_MARK = "CASE WHEN {c} > 1e-12 THEN '+' WHEN {c} < -1e-12 THEN '−' ELSE '0' END"
_TRANS = f"""{_CLAIM_SQL}, tr AS MATERIALIZED (SELECT split_part(a.claim_id, '__', 1) AS comparison_id, a.group_id, {_MARK.format(c='a.value')} AS s, {_MARK.format(c='b.value')} AS d
  FROM long a JOIN long b ON a.group_id = b.group_id AND a.claim_id = split_part(b.claim_id, '__', 1) || '__mean' AND b.claim_id LIKE '%\\_\\_max' ESCAPE '\\')"""


@query("sign_transitions", f"""WITH {_TRANS}, g AS (SELECT comparison_id, a.m AS s, b.m AS d FROM (SELECT DISTINCT comparison_id FROM tr), (VALUES ('+'), ('−'), ('0')) a(m), (VALUES ('+'), ('−'), ('0')) b(m)),
c AS (SELECT comparison_id, s, d, count(*) AS n FROM tr GROUP BY ALL), x AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (comparison_id, s, d))
SELECT comparison_id, s AS source_sign, d AS destination_sign, n, sum(n) OVER (PARTITION BY comparison_id, s)::BIGINT AS source_total, sum(n) OVER (PARTITION BY comparison_id, d)::BIGINT AS destination_total FROM x""")
def sign_transitions(spark, sf):
    return C.sign_transitions(claim_transitions(claim_values(spark, sf)[0]))


@query("claim_retention", f"""WITH {_TRANS}, k AS (SELECT comparison_id, count(*) FILTER (s = d AND s <> '0') AS kept, count(*) FILTER (s <> d AND s <> '0' AND d <> '0') AS flipped,
  count(*) FILTER (s = '0' OR d = '0') AS via, count(*) FILTER (s = d) AS same, count(*) AS n FROM tr GROUP BY comparison_id)
SELECT k.comparison_id, CASE WHEN a.mean_direction = b.mean_direction THEN 'YES' ELSE 'NO' END AS mean_direction_retained,
  CASE WHEN a.ci_support = b.ci_support THEN 'YES' ELSE 'NO' END AS ci_support_retained, CASE WHEN a.majority = b.majority THEN 'YES' ELSE 'NO' END AS majority_category_retained,
  kept AS matched_sign_retained, flipped AS matched_sign_flipped, via AS transitions_via_zero, same AS state_retained, k.n AS n_groups,
  a.mean_direction || b.mean_direction IN ('POSITIVENEGATIVE', 'NEGATIVEPOSITIVE') AS direction_reversed
FROM k JOIN cs a ON a.claim_id = k.comparison_id || '__mean' JOIN cs b ON b.claim_id = k.comparison_id || '__max'""")
def claim_retention(spark, sf):
    long, intervals = claim_values(spark, sf)
    d = C.claim_retention(C.claim_states(long, intervals), claim_pairs(spark), claim_transitions(long))
    return d.drop("source_claim", "destination_claim", "majority_direction_retained", "retained_sign_share")


@query("resisting_groups", f"""WITH {_TRANS} SELECT tr.comparison_id, group_id, s AS source_sign FROM tr JOIN cs a ON a.claim_id = tr.comparison_id || '__mean' JOIN cs b ON b.claim_id = tr.comparison_id || '__max'
WHERE s = d AND s <> '0' AND a.mean_direction || b.mean_direction IN ('POSITIVENEGATIVE', 'NEGATIVEPOSITIVE')""")
def resisting_groups(spark, sf):
    long, intervals = claim_values(spark, sf)
    rows = claim_transitions(long)
    return C.resisting_groups(C.claim_retention(C.claim_states(long, intervals), claim_pairs(spark), rows), rows)


# ------------------------------------------------------------------ splits
SEEDS = (42, 123, 2026)
K = 5
_RANK = f"""{S.SEQ}, gr AS (SELECT DISTINCT group_id FROM seq),
rk AS MATERIALIZED (SELECT group_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || group_id), group_id) - 1 AS rank,
  ntile({K}) OVER (PARTITION BY seed ORDER BY md5(seed || ':' || group_id), group_id) - 1 AS fold, count(*) OVER (PARTITION BY seed) AS n FROM gr, (VALUES (42), (123), (2026)) s(seed))"""


def _groups(spark, sf):
    return P.table(spark, sf, "events").select(F.col("user_id").alias(GROUP)).distinct()


def _folds(spark, sf):
    return SP.grouped_kfold(_groups(spark, sf), SEEDS, K)


@query("grouped_kfold", f"WITH {_RANK} SELECT seed, group_id, rank, fold::INTEGER AS fold FROM rk")
def grouped_kfold(spark, sf):
    return _folds(spark, sf)


@query("fold_roles", f"WITH {_RANK} SELECT seed, f::INTEGER AS fold, group_id, CASE WHEN f = fold THEN 'validation' ELSE 'train' END AS role FROM rk, range({K}) t(f)")
def fold_roles(spark, sf):
    return SP.fold_roles(_folds(spark, sf), K)


def _add(values: str, step: str) -> str:
    """The list with ``step`` added at the lightest fold."""
    return f"list_transform({values}, lambda x, j: x + CASE WHEN j = list_position(l, list_min(l)) THEN {step} ELSE 0 END)"


@query("balanced_group_folds", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c DESC) AS i FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)),
g AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS l, [0, 0, 0, 0, 0]::BIGINT[] AS k
  UNION ALL SELECT s.i, {_add('l', 'c')}, {_add('k', '1')} FROM g JOIN s ON s.i = g.i + 1)
SELECT unnest(range({K}))::INTEGER AS fold, unnest(l)::BIGINT AS rows, unnest(k)::BIGINT AS groups FROM (SELECT l, k FROM g ORDER BY i DESC LIMIT 1)""")
def balanced_group_folds(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_custkey").alias(GROUP))
    d = SP.balanced_group_folds(o, K)
    return d.groupBy("fold").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"))


@query("loso_splits", f"WITH {_RANK} SELECT seed, group_id, rank, greatest(1, floor((n - 1) * 0.2 + 0.5))::BIGINT AS cutoff, n - 1 AS others FROM rk")
def loso_splits(spark, sf):
    return SP.loso_splits(_groups(spark, sf), SEEDS, 0.2)


_TESTS = (1, 2, 3)


@query("loso_roles", f"""WITH {_RANK}, t AS (SELECT seed, group_id AS test_group, rank AS tr FROM rk WHERE group_id IN {_TESTS})
SELECT rk.seed, test_group, group_id, CASE WHEN rank = tr THEN 'test' WHEN rank - CASE WHEN tr < rank THEN 1 ELSE 0 END < greatest(1, floor((n - 1) * 0.2 + 0.5)) THEN 'validation' ELSE 'train' END AS role
FROM rk JOIN t ON t.seed = rk.seed""")
def loso_roles(spark, sf):
    """Roles of all groups where one of three groups is held out."""
    return SP.loso_roles(SP.loso_splits(_groups(spark, sf), SEEDS, 0.2), _TESTS)


@query("group_bootstrap", f"""WITH {S.SEQ}, g AS (SELECT group_id, row_number() OVER (ORDER BY md5(group_id::VARCHAR)) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM seq)),
d AS (SELECT idx AS draw, ('0x' || substr(md5('7:' || idx), 1, 8))::BIGINT % n AS pick FROM g), e AS (SELECT group_id, count(*) AS rows, sum(value) AS total FROM seq GROUP BY group_id)
SELECT draw, -(draw + 1) AS bootstrap_id, group_id, rows, {q('total', 'total', 2)} FROM d JOIN g ON g.idx = pick JOIN e USING (group_id)""")
def group_bootstrap(spark, sf):
    seq = P.event_sequences(spark, sf)
    draws = SP.group_bootstrap(seq, 7)
    rows = SP.bootstrap_rows(seq, draws)
    return rows.groupBy("draw", "bootstrap_id", GROUP).agg(F.count(F.lit(1)).alias("rows"), r(F.sum("value"), 2, "total"))


# ------------------------------------------------------------------ out-of-fold models
MEMBERS, PENALTY = 2, 0.5


def model_rows(spark, sf):
    p = P.event_panel(spark, sf)
    return p.where(F.col(SEED) == 42).select(GROUP, RECORDING, TIME, "slow", "fast", "target")


_ROWS = "tr AS MATERIALIZED (SELECT group_id, recording_id, time_index, slow, fast, target FROM panel WHERE seed = 42), gm AS MATERIALIZED (SELECT group_id, count(*)::DOUBLE AS n0, sum(slow) AS sx, sum(slow * slow) AS sxx, sum(target) AS sy, sum(slow * target) AS sxy FROM tr GROUP BY group_id)"
_SOLVE = f"""((sxx + {PENALTY}) * sy - sx * sxy) / (n0 * (sxx + {PENALTY}) - sx * sx) AS b0, (n0 * sxy - sx * sy) / (n0 * (sxx + {PENALTY}) - sx * sx) AS b1"""
_PANEL_RANK = S.PANEL + _RANK[len(S.SEQ):]
_OOF = f"""{_PANEL_RANK}, {_ROWS},
fr AS (SELECT seed, fold, min(rank) AS lo, count(*) AS size, any_value(n) AS n FROM rk GROUP BY ALL),
sl AS (SELECT r.seed, f.fold, m AS member, lo, size, ('0x' || substr(md5(r.seed || ':' || f.fold || ':' || m || ':' || (CASE WHEN r.rank < lo THEN r.rank ELSE r.rank - size END)), 1, 8))::BIGINT % (r.n - size) AS i
  FROM rk r JOIN fr f ON r.seed = f.seed AND r.fold <> f.fold, range({MEMBERS}) t(m)),
wt AS (SELECT seed, fold, member, CASE WHEN i < lo THEN i ELSE i + size END AS rank, count(*) AS w FROM sl GROUP BY ALL),
sm AS (SELECT wt.seed, wt.fold, member, sum(w * n0) AS n0, sum(w * sx) AS sx, sum(w * sxx) AS sxx, sum(w * sy) AS sy, sum(w * sxy) AS sxy
  FROM wt JOIN rk ON rk.seed = wt.seed AND rk.rank = wt.rank JOIN gm USING (group_id) GROUP BY ALL),
md AS MATERIALIZED (SELECT seed, fold, member, {_SOLVE} FROM sm)"""


@query("oof_models", f"WITH {_OOF} SELECT seed, fold::INTEGER AS fold, member::INTEGER AS member, {q('b0')}, {q('b1')} FROM md")
def oof_models(spark, sf):
    d = O.oof_models(model_rows(spark, sf), _folds(spark, sf), ["slow"], K, MEMBERS, PENALTY)
    return d.select(SEED, "fold", "member", r(F.col("coef")[0], name="b0"), r(F.col("coef")[1], name="b1"))


@query("oof_predict", f"""WITH {_OOF}, av AS (SELECT seed, fold, avg(b0) AS b0, avg(b1) AS b1 FROM md GROUP BY ALL)
SELECT rk.seed, rk.fold::INTEGER AS fold, tr.group_id, recording_id, time_index, {q('b0 + b1 * slow', 'prediction')} FROM tr JOIN rk USING (group_id) JOIN av ON av.seed = rk.seed AND av.fold = rk.fold""")
def oof_predict(spark, sf):
    d = O.oof_predict(model_rows(spark, sf), _folds(spark, sf), ["slow"], K, MEMBERS, PENALTY)
    return d.select(SEED, "fold", GROUP, RECORDING, TIME, r("prediction"))


def _det(a, b, c):
    """Determinant of three columns."""
    return f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"


_C1, _C2, _C3, _CY = ("n0", "sx", "sz"), ("sx", f"(sxx + {PENALTY})", "sxz"), ("sz", "sxz", f"(szz + {PENALTY})"), ("sy", "sxy", "szy")
_WIDE = _OOF.replace("sum(slow * target) AS sxy FROM tr", "sum(slow * target) AS sxy, sum(fast) AS sz, sum(fast * fast) AS szz, sum(slow * fast) AS sxz, sum(fast * target) AS szy FROM tr").replace(
    "sum(w * sxy) AS sxy\n", "sum(w * sxy) AS sxy, sum(w * sz) AS sz, sum(w * szz) AS szz, sum(w * sxz) AS sxz, sum(w * szy) AS szy\n").replace(
    _SOLVE, ", ".join(f"{_det(*x)} / {_det(_C1, _C2, _C3)} AS b{i}" for i, x in enumerate(((_CY, _C2, _C3), (_C1, _CY, _C3), (_C1, _C2, _CY)))))


@query("oof_predict_wide", f"""WITH {_WIDE}, av AS (SELECT seed, fold, avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2 FROM md GROUP BY ALL)
SELECT rk.seed, tr.group_id, {q('sqrt(avg(pow(target - b0 - b1 * slow - b2 * fast, 2)))', 'rmse')} FROM tr JOIN rk USING (group_id) JOIN av ON av.seed = rk.seed AND av.fold = rk.fold GROUP BY ALL""")
def oof_predict_wide(spark, sf):
    """Two-feature models."""
    d = O.oof_predict(model_rows(spark, sf), _folds(spark, sf), ["slow", "fast"], K, MEMBERS, PENALTY)
    return d.groupBy(SEED, GROUP).agg(r(F.sqrt(F.avg(F.pow(F.col("target") - F.col("prediction"), 2))), 6, "rmse"))


FRACTION = 0.2
# Draws are slots of the train part, the same for every held-out group; a slot's rank jumps over the held-out group or the validation part.
_OUTER_FIT = f"""{_PANEL_RANK}, {_ROWS},
lo AS MATERIALIZED (SELECT *, greatest(1, floor((n - 1) * {FRACTION} + 0.5))::BIGINT AS c FROM rk),
h AS (SELECT seed, c, m AS member, ('0x' || substr(md5(seed || ':outer:' || m || ':' || rank), 1, 8))::BIGINT % (n - 1 - c) AS slot FROM lo, range({MEMBERS}) t(m) WHERE rank < n - 1 - c),
wt AS MATERIALIZED (SELECT seed, c, member, slot, count(*)::DOUBLE AS w FROM h GROUP BY ALL),
dr AS (SELECT t.seed, t.group_id AS test_group, member, w, slot + t.c + CASE WHEN t.rank < t.c OR slot + t.c >= t.rank THEN 1 ELSE 0 END AS rank FROM lo t JOIN wt ON wt.seed = t.seed),
lf AS (SELECT dr.seed, test_group, member, sum(w) AS drawn, sum(w * n0) AS n0, sum(w * sx) AS sx, sum(w * sxx) AS sxx, sum(w * sy) AS sy, sum(w * sxy) AS sxy
  FROM dr JOIN rk ON rk.seed = dr.seed AND rk.rank = dr.rank JOIN gm ON gm.group_id = rk.group_id GROUP BY ALL),
md AS MATERIALIZED (SELECT seed, test_group AS group_id, member, {_SOLVE} FROM lf)"""


def _splits(spark, sf):
    return SP.loso_splits(_groups(spark, sf), SEEDS, FRACTION)


@query("outer_models", f"WITH {_OUTER_FIT} SELECT seed, group_id, member::INTEGER AS member, {q('b0')}, {q('b1')} FROM md")
def outer_models(spark, sf):
    """A model for each held-out group and member, on draws of the train part alone."""
    d = O.outer_models(model_rows(spark, sf), _splits(spark, sf), ["slow"], MEMBERS, PENALTY)
    return d.select(SEED, GROUP, "member", r(F.col("coef")[0], name="b0"), r(F.col("coef")[1], name="b1"))


@query("outer_predict", f"""WITH {_OUTER_FIT}, av AS (SELECT seed, group_id, avg(b0) AS b0, avg(b1) AS b1 FROM md GROUP BY ALL)
SELECT av.seed, tr.group_id, recording_id, time_index, {q('b0 + b1 * slow', 'prediction')} FROM tr JOIN av USING (group_id)""")
def outer_predict(spark, sf):
    d = O.outer_predict(model_rows(spark, sf), _splits(spark, sf), ["slow"], MEMBERS, PENALTY)
    return d.select(SEED, GROUP, RECORDING, TIME, r("prediction"))


# ------------------------------------------------------------------ candidate feature sets
SETS = {"slow": ["slow"], "fast": ["fast"], "both": ["slow", "fast"]}


def _single(x: str) -> tuple[str, str]:
    """Intercept and slope of one feature from the sums of both."""
    sq, cross = f"(s{x}{x} + {PENALTY})", "sxy" if x == "x" else "szy"
    det = f"(n0 * {sq} - s{x} * s{x})"
    return f"({sq} * sy - s{x} * {cross}) / {det}", f"(n0 * {cross} - s{x} * sy) / {det}"


_SETS_SQL = f"""WITH {_WIDE}, cf AS (SELECT seed, fold, 'both' AS candidate_id, b0, b1, b2 FROM md
  UNION ALL SELECT seed, fold, 'slow', {_single('x')[0]}, {_single('x')[1]}, 0 FROM sm UNION ALL SELECT seed, fold, 'fast', {_single('z')[0]}, 0, {_single('z')[1]} FROM sm),
av AS (SELECT seed, fold, candidate_id, avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2 FROM cf GROUP BY ALL)
SELECT rk.seed, tr.group_id, candidate_id, {q('sqrt(avg(pow(target - b0 - b1 * slow - b2 * fast, 2)))', 'rmse')} FROM tr JOIN rk USING (group_id) JOIN av ON av.seed = rk.seed AND av.fold = rk.fold GROUP BY ALL"""


@query("oof_candidates", _SETS_SQL)
def oof_candidates(spark, sf):
    """Three feature sets, fitted and judged from one Gram matrix a group."""
    d = O.oof_candidate_errors(model_rows(spark, sf), _folds(spark, sf), ["slow", "fast"], SETS, K, MEMBERS, PENALTY)
    return d.select(SEED, GROUP, "candidate_id", r("rmse"))


def enhanced_rows(spark, sf):
    """All columns of the enhanced set, one energy as the target; what is not finite counts as zero."""
    d = FQ.features(spark, sf, "enhanced")
    names = [c for c in d.columns if c not in FQ.REC]
    target = "five_log_energy_band_0"
    finite = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names]
    return d.select(F.col(RECORDING).alias(GROUP), TIME, *finite).withColumnRenamed(target, "target"), [c for c in names if c != target]


def enhanced_sets(names):
    rolling = [c for c in names if "_w" in c]
    return {"current": [c for c in names if c not in rolling], "rolling": rolling, "enhanced": names}


@query("oof_candidates_enhanced")
def oof_candidates_enhanced(spark, sf):
    """Three feature sets of all enhanced columns; too wide for SQL, so tested against a plain solution."""
    rows, names = enhanced_rows(spark, sf)
    folds = SP.grouped_kfold(rows.select(GROUP).distinct(), SEEDS, K)
    d = O.oof_candidate_errors(rows, folds, names, enhanced_sets(names), K, MEMBERS, PENALTY)
    return d.select(SEED, GROUP, "candidate_id", r("rmse"))
