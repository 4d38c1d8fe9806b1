"""Data contracts, manifests, sources and sinks on the given tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, SEQUENCE, TIME
from panelseq.operators import contracts as B
from panelseq.operators import updaters as U
from panelseq.plans import panels as P
from panelseq.plans import sql_parts as S
from panelseq.plans.registry import q, query, r
from panelseq.session import checkpoint_dir, cut
from panelseq.sources import fingerprints as FP
from panelseq.sources import manifest as A
from panelseq.sources import panel_io as IO
from panelseq.streaming import updaters as ST


def stage_path(spark, name: str) -> str:
    """A new folder for a stage table, below the session's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def violation(rule: str, key: str, detail: str, source: str, severity: str = "error") -> str:
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, {key} AS key, {detail} AS detail FROM {source}"


# ------------------------------------------------------------------ documents read as files
# Mapping of recordings to groups: nation key -> region key.
_FILES = """docs AS MATERIALIZED (SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN lang || '/session_' || lpad((doc_id % 27)::VARCHAR, 2, '0') || '/part_' || source || '.csv'
    WHEN 'de' THEN lang || '/' || source || '/' || (doc_id % 29) || '.npy' WHEN 'fr' THEN lang || '/rec' || doc_id || 'x_sess' || lpad((doc_id % 23)::VARCHAR, 2, '0') || '.npz'
    ELSE lang || '/plain' || doc_id || '.mat' END AS relative_path, sha256(text) AS sha256, n_chars::BIGINT AS file_size_bytes, len(string_split(text, ' '))::BIGINT AS sample_count FROM documents),
ids AS (SELECT *, string_split(relative_path, '/')[-1] AS file_name FROM docs),
res AS MATERIALIZED (SELECT *, regexp_replace(file_name, '\\.[^.]+$', '') AS stem,
  CASE WHEN lang = 'en' AND doc_id % 27 <= 22 THEN doc_id % 27 END AS folder_id FROM ids),
man AS MATERIALIZED (SELECT *, CASE WHEN folder_id IS NOT NULL THEN folder_id WHEN regexp_full_match(stem, '\\d{1,9}') AND stem::BIGINT BETWEEN 0 AND 22 THEN stem::BIGINT
    WHEN regexp_extract(stem, '(session|sess|s)[_-]?(\\d{1,2})', 2, 'i') <> '' AND regexp_extract(stem, '(session|sess|s)[_-]?(\\d{1,2})', 2, 'i')::BIGINT BETWEEN 0 AND 22 THEN regexp_extract(stem, '(session|sess|s)[_-]?(\\d{1,2})', 2, 'i')::BIGINT END AS recording_id,
  CASE WHEN folder_id IS NOT NULL THEN 'directory_name' WHEN regexp_full_match(stem, '\\d{1,9}') AND stem::BIGINT BETWEEN 0 AND 22 THEN 'file_name_exact_integer'
    WHEN regexp_extract(stem, '(session|sess|s)[_-]?(\\d{1,2})', 2, 'i') <> '' AND regexp_extract(stem, '(session|sess|s)[_-]?(\\d{1,2})', 2, 'i')::BIGINT BETWEEN 0 AND 22 THEN 'file_name_pattern' ELSE 'unresolved' END AS resolution_source FROM res),
own AS MATERIALIZED (SELECT man.*, n_regionkey AS group_id, 'feature' AS data_role, CASE WHEN recording_id IS NULL THEN 'error' ELSE 'ok' END AS scan_status,
  regexp_extract(file_name, '\\.[^.]+$') AS file_suffix FROM man LEFT JOIN nation ON n_nationkey = recording_id)"""


def document_files(spark, sf):
    d = P.table(spark, sf, "documents")
    two = lambda n: F.lpad((F.col("doc_id") % n).cast("string"), 2, "0")
    path = (
        F.when(F.col("lang") == "en", F.concat("lang", F.lit("/session_"), two(27), F.lit("/part_"), "source", F.lit(".csv")))
        .when(F.col("lang") == "de", F.concat("lang", F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 29).cast("string"), F.lit(".npy")))
        .when(F.col("lang") == "fr", F.concat("lang", F.lit("/rec"), F.col("doc_id").cast("string"), F.lit("x_sess"), two(23), F.lit(".npz")))
        .otherwise(F.concat("lang", F.lit("/plain"), F.col("doc_id").cast("string"), F.lit(".mat"))))
    base = d.select("doc_id", path.alias("file_path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").cast("long").alias("file_size_bytes"),
                    F.size(F.split("text", " ")).cast("long").alias("sample_count"))
    return A.supported(A.path_parts(base))


def document_manifest(spark, sf):
    files = A.resolve_recording(document_files(spark, sf))
    mapping = P.table(spark, sf, "nation").select(F.col("n_nationkey").alias(RECORDING), F.col("n_regionkey").alias(GROUP))
    out = A.attach_group(files, mapping)
    return out.withColumns({
        "data_role": F.lit("feature"), "scan_status": F.when(F.col(RECORDING).isNull(), "error").otherwise("ok"),
        "error_message": F.when(F.col(RECORDING).isNull(), "unresolved").otherwise("")})


def nation_mapping(spark, sf):
    return P.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias(RECORDING), F.col("n_regionkey").alias(GROUP))


@query("file_manifest_scan")
def file_manifest_scan(spark, sf):
    """The data folder itself: one row per file with size, hash and status."""
    d = A.scan_manifest(spark, sf)
    return d.select("relative_path", "file_suffix", "condition", "file_size_bytes", "sha256", "scan_status")


@query("recording_resolution", f"WITH {_FILES} SELECT doc_id, coalesce(recording_id, -1) AS recording_id, resolution_source FROM man")
def recording_resolution(spark, sf):
    d = A.resolve_recording(document_files(spark, sf))
    return d.select("doc_id", F.coalesce(RECORDING, F.lit(-1)).alias(RECORDING), "resolution_source")


@query("group_lookup", f"WITH {_FILES} SELECT doc_id, coalesce(group_id, -1) AS group_id, false AS group_conflict FROM own")
def group_lookup(spark, sf):
    return document_manifest(spark, sf).select("doc_id", F.coalesce(GROUP, F.lit(-1)).alias(GROUP), "group_conflict")


@query("column_choice", """WITH m AS (SELECT DISTINCT o_custkey AS f, o_orderpriority AS n FROM orders),
p AS (SELECT *, n LIKE '%NOT SPEC%' AS lab, CASE n WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS r FROM m)
SELECT f AS customer, coalesce(arg_min(n, r || lower(n)) FILTER (NOT lab), '') AS feature_key, coalesce(min(n) FILTER (lab), '') AS label_key,
  CASE WHEN count(*) FILTER (NOT lab) > 0 AND count(*) FILTER (lab) > 0 THEN 'feature+label' WHEN count(*) FILTER (lab) > 0 THEN 'label' ELSE 'feature' END AS data_role,
  greatest(count(*) FILTER (NOT lab) - 1, 0)::INTEGER AS runners_up FROM p GROUP BY f""")
def column_choice(spark, sf):
    meta = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("name")).distinct().withColumn("numeric", F.lit(True))
    d = A.choose_columns(meta, ("2-high", "5-low"), "not spec", "customer")
    return d.select("customer", F.coalesce("feature_key", F.lit("")).alias("feature_key"), F.coalesce("label_key", F.lit("")).alias("label_key"), "data_role", F.size("runners_up").alias("runners_up"))


def _holed_long(spark, sf):
    return P.spatial_long(spark, sf).withColumn("value", F.when(F.col("value") > 0.2, float("nan")).otherwise(F.col("value")))


@query("array_stats", f"""WITH {S.SPATIAL}, g AS (SELECT recording_id, {q('min(value) FILTER (value <= 0.2)', 'min')}, {q('max(value) FILTER (value <= 0.2)', 'max')}, {q('avg(value) FILTER (value <= 0.2)', 'mean')},
  {q('stddev_pop(value) FILTER (value <= 0.2)', 'std')}, {q('avg(CASE WHEN value > 0.2 THEN 1.0 ELSE 0.0 END)', 'missing_rate')}, count(*) AS size FROM cells GROUP BY recording_id) SELECT * FROM g""")
def array_stats(spark, sf):
    d = A.array_stats(_holed_long(spark, sf), [RECORDING])
    return d.select(RECORDING, *[r(c) for c in ("min", "max", "mean", "std", "missing_rate")], "size")


@query("combined_missing_rate", f"""WITH {S.SPATIAL} SELECT recording_id, {q('avg(CASE WHEN value > 0.2 THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM cells GROUP BY recording_id""")
def combined_missing_rate(spark, sf):
    """Rates of the channels, weighted by their sizes."""
    per = A.array_stats(_holed_long(spark, sf), [RECORDING, "channel"])
    return A.combined_missing_rate(per, [RECORDING]).select(RECORDING, r("missing_rate"))


@query("manifest_round_trip", f"WITH {_FILES} SELECT relative_path, sha256, file_size_bytes, sample_count, scan_status FROM own")
def manifest_round_trip(spark, sf):
    """Saved as CSV and JSON lines with the abnormal rows and summary, then read back."""
    out = stage_path(spark, "manifest")
    A.save_manifest(document_manifest(spark, sf), out)
    d = A.load_manifest(spark, f"{out}/manifest_jsonl")
    return d.select("relative_path", "sha256", "file_size_bytes", "sample_count", "scan_status")


@query("successful_rows", f"WITH {_FILES} SELECT relative_path, group_id::INTEGER AS group_id, recording_id::INTEGER AS recording_id FROM own WHERE scan_status = 'ok'")
def successful_rows(spark, sf):
    return A.load_ok(document_manifest(spark, sf)).select("relative_path", GROUP, RECORDING)


@query("panel_scan", f"WITH {S.PANEL} SELECT {S.KT}, fast FROM panel")
def panel_scan(spark, sf):
    """Panel written as CSV and read back with a declared schema and five columns."""
    out = stage_path(spark, "panel")
    IO.write_result(P.event_panel(spark, sf), out, "csv")
    return IO.read_panel(spark, out, [*SEQUENCE, TIME, "fast"]).withColumn(RECORDING, F.col(RECORDING).cast("int"))


@query("ledger_scan", f"WITH {S.PANEL} SELECT group_id, recording_id, time_index AS t0, seed, 1::INTEGER AS sign, fast AS A FROM panel")
def ledger_scan(spark, sf):
    out = stage_path(spark, "ledger")
    d = P.event_panel(spark, sf).select(GROUP, RECORDING, F.col(TIME).alias("t0"), SEED, F.lit(1).alias("sign"), F.col("fast").alias("A"))
    d.write.json(out)
    return IO.read_ledger(spark, out).select(GROUP, RECORDING, "t0", SEED, "sign", "A")


@query("fold_union", f"WITH {S.PANEL} SELECT seed AS fold, count(*) AS n, {q('sum(fast)', 'total', 4)}, 0::BIGINT AS misplaced FROM panel GROUP BY seed")
def fold_union(spark, sf):
    """One folder per seed, read as one table with the path checked against the rows."""
    out = stage_path(spark, "folds")
    d = P.event_panel(spark, sf).select(F.col(SEED).alias("fold"), "fast")
    IO.write_result(d.withColumn("part", F.col("fold")), out, "parquet", ["part"])
    rows, wrong = IO.read_folds(spark, f"{out}/part=*", "fold int, fast double", pattern=r"part=(\d+)", fold="fold")
    bad = wrong.groupBy("fold").agg(F.count(F.lit(1)).alias("misplaced"))
    s = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r(F.sum("fast"), 4, "total"))
    return s.join(bad, "fold", "left").withColumn("misplaced", F.coalesce("misplaced", F.lit(0)))


@query("trajectory_table", f"""WITH RECURSIVE {S.PANEL}, {S.linear('a', '0.2::DOUBLE')}, {S.linear('b', '0.3::DOUBLE', start='fast')}
SELECT {S.KT}, {q('target')}, {q('a.state', 'c0')}, {q('b.state', 'ema')} FROM panel JOIN a USING ({S.KT}) JOIN b USING ({S.KT})""")
def trajectory_table(spark, sf):
    methods = {
        "c0": lambda d, n, keep: U.constant_gain(d, 0.2, length=n, keep=keep),
        "ema": lambda d, n, keep: U.ema(d, 0.3, length=n, keep=keep)}
    d = IO.build_trajectories(P.event_panel(spark, sf), methods, length=P.event_length(spark, sf))
    return d.select(*SEQUENCE, TIME, r("target"), r("c0"), r("ema"))


# Three kinds of files stand for the five types of events.
KINDS = {"click": ("click", "signup"), "view": ("view", "error"), "purchase": ("purchase",)}
_KIND_SQL = "CASE WHEN event_type IN ('click', 'signup') THEN 'click' WHEN event_type IN ('view', 'error') THEN 'view' ELSE 'purchase' END"


def _kind():
    return F.when(F.col("event_type").isin(*KINDS["click"]), "click").when(F.col("event_type").isin(*KINDS["view"]), "view").otherwise("purchase")


def _typed(spark, sf, kind: str):
    from panelseq.operators.blocks import dense_index

    ev = P.table(spark, sf, "events").where(_kind() == kind).select(F.col("user_id").alias(RECORDING), "ts", "event_id", F.col("value").alias(kind))
    return dense_index(ev, [RECORDING], F.date_trunc("minute", "ts"), ["ts", "event_id"]).select(RECORDING, TIME, kind)


_TYPED = f"ek AS (SELECT *, {_KIND_SQL} AS kind FROM events), " + ", ".join(f"{k} AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS time_index, value AS {k} FROM ek WHERE kind = '{k}')" for k in KINDS)


@query("recording_assembly", f"WITH {_TYPED} SELECT recording_id, time_index, coalesce(click, -1) AS click, coalesce(view, -1) AS view, coalesce(purchase, -1) AS purchase FROM click FULL JOIN view USING (recording_id, time_index) FULL JOIN purchase USING (recording_id, time_index)")
def recording_assembly(spark, sf):
    d = IO.assemble_recordings(*[_typed(spark, sf, k) for k in ("click", "view", "purchase")])
    return d.select(RECORDING, TIME, *[F.coalesce(k, F.lit(-1.0)).alias(k) for k in ("click", "view", "purchase")])


# ------------------------------------------------------------------ contracts
_MV = [
    violation("file_error", "relative_path", "'unresolved'", "own WHERE scan_status = 'error'"),
    violation("group_coverage", "n_regionkey::VARCHAR", "'missing'", "(SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT group_id FROM good))"),
    violation("recording_coverage", "n_nationkey::VARCHAR", "'missing'", "nation WHERE n_nationkey NOT IN (SELECT recording_id FROM good)"),
    violation("empty_file", "relative_path", "'empty'", "good WHERE file_size_bytes <= 0"),
    violation("duplicate_path", "relative_path", "n::VARCHAR", "(SELECT relative_path, count(*) AS n FROM own GROUP BY 1 HAVING count(*) > 1)"),
    violation("duplicate_hash", "sha256", "n::VARCHAR", "(SELECT sha256, count(*) AS n FROM good GROUP BY 1 HAVING count(*) > 1)", "warning"),
    violation("duplicate_recording", "lang || '|' || recording_id", "n::VARCHAR", "(SELECT lang, recording_id, count(*) AS n FROM good GROUP BY ALL HAVING count(*) > 1)"),
    violation("sample_mismatch", "recording_id::VARCHAR", "lo || '..' || hi", "(SELECT recording_id, min(sample_count) AS lo, max(sample_count) AS hi FROM good GROUP BY 1 HAVING min(sample_count) < max(sample_count))"),
    violation("multi_recording_group", "n_regionkey || '|' || n_nationkey", "'missing'", "nation WHERE n_nationkey NOT IN (SELECT recording_id FROM good)"),
]


@query("manifest_validation", f"WITH {_FILES}, good AS (SELECT * FROM own WHERE scan_status = 'ok') " + " UNION ALL ".join(_MV))
def manifest_validation(spark, sf):
    m = document_manifest(spark, sf)
    for c in ("label_min", "label_max", *B.RATE_COLUMNS):
        m = m.withColumn(c, F.lit(None).cast("double"))
    return B.validate_manifest(m, nation_mapping(spark, sf))


# Ids are moved so that every rule finds something: groups beyond 24, recordings beyond a million, pairs of one recording.
_OWNERS = """o AS MATERIALIZED (SELECT CASE WHEN s_suppkey % 13 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS k, CASE WHEN s_nationkey % 9 = 2 THEN s_nationkey + 100 ELSE s_nationkey END AS g FROM supplier),
rs AS (SELECT DISTINCT k FROM o), rg AS (SELECT DISTINCT g FROM o), eg AS (SELECT n_nationkey AS g FROM nation),
re AS (SELECT DISTINCT CASE WHEN l_suppkey % 11 = 3 THEN l_suppkey + 1000000 ELSE l_suppkey END AS k FROM lineitem),
sh AS (SELECT k, count(*) AS m FROM o GROUP BY k HAVING count(*) > 1)"""


@query("mapping_validation", f"WITH {_OWNERS} " + " UNION ALL ".join([
    violation("group_ids", "g::VARCHAR", "'missing'", "(FROM eg EXCEPT FROM rg)"), violation("group_ids", "g::VARCHAR", "'extra'", "(FROM rg EXCEPT FROM eg)"),
    violation("recording_ids", "k::VARCHAR", "'missing'", "(FROM re EXCEPT FROM rs)"), violation("recording_ids", "k::VARCHAR", "'extra'", "(FROM rs EXCEPT FROM re)"),
    violation("shared_recording", "k::VARCHAR", "m::VARCHAR", "sh")]))
def mapping_validation(spark, sf):
    moved = lambda c, n, at, by: F.when(F.col(c) % n == at, F.col(c) + by).otherwise(F.col(c))
    m = P.table(spark, sf, "supplier").select(moved("s_suppkey", 13, 1, -1).alias(RECORDING), moved("s_nationkey", 9, 2, 100).alias(GROUP))
    groups = P.table(spark, sf, "nation").select(F.col("n_nationkey").alias(GROUP))
    recs = P.table(spark, sf, "lineitem").select(moved("l_suppkey", 11, 3, 1_000_000).alias(RECORDING))
    return B.validate_mapping(m, groups, recs)


@query("manifest_summary", f"""WITH {_FILES} SELECT 'total' AS measure, '' AS value, count(*) AS n FROM own UNION ALL SELECT 'ok', '', count(*) FILTER (scan_status = 'ok') FROM own
UNION ALL SELECT 'error', '', count(*) FILTER (scan_status = 'error') FROM own UNION ALL SELECT 'groups', '', count(DISTINCT group_id) FROM own UNION ALL SELECT 'recordings', '', count(DISTINCT recording_id) FROM own
UNION ALL SELECT 'condition', lang, count(*) FROM own GROUP BY lang UNION ALL SELECT 'scan_status', scan_status, count(*) FROM own GROUP BY scan_status""")
def manifest_summary(spark, sf):
    d = B.manifest_summary(document_manifest(spark, sf), ["condition", "scan_status"])
    return d.withColumn("value", F.coalesce("value", F.lit("")))


@query("one_file_per_role", f"""WITH c AS (SELECT user_id, t.k, count(*) FILTER ({_KIND_SQL} = t.k) AS n FROM events, (VALUES ('click'), ('view'), ('purchase')) t(k) GROUP BY ALL) {violation('one_file_per_role', "user_id || '|' || k", 'n::VARCHAR', 'c WHERE n <> 1')}""")
def one_file_per_role(spark, sf):
    d = P.table(spark, sf, "events").select(F.col("user_id").alias(RECORDING), _kind().alias("data_role"))
    return B.require_roles(d, ["click", "view", "purchase"])


# Embeddings stored with axes (1,16,4), (4,16,1) or (16,1,4), by label.
@query("canonical_axes", """WITH e AS (SELECT vec_id, label % 3 AS o, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT vec_id, 1 AS matches, 0 AS time_index, CASE o WHEN 0 THEN p // 4 WHEN 1 THEN p % 16 ELSE p // 4 END::INTEGER AS channel, CASE o WHEN 0 THEN p % 4 WHEN 1 THEN p // 16 ELSE p % 4 END::INTEGER AS band, """ + q("value") + " FROM e")
def canonical_axes(spark, sf):
    o = F.col("label") % 3
    shape = F.when(o == 0, F.array(F.lit(1), F.lit(16), F.lit(4))).when(o == 1, F.array(F.lit(4), F.lit(16), F.lit(1))).otherwise(F.array(F.lit(16), F.lit(1), F.lit(4)))
    d = P.table(spark, sf, "embeddings").select("vec_id", shape.alias("shape"), F.col("embedding").cast("array<double>").alias("values"))
    return B.canonical_axes(d, 1, 16, 4).select("vec_id", "matches", TIME, "channel", "band", r("value"))


@query("canonical_vector", """SELECT vec_id, label % 3 < 2 AS valid, CASE WHEN label % 3 < 2 THEN 64 ELSE -1 END AS length FROM embeddings""")
def canonical_vector(spark, sf):
    o, e = F.col("label") % 3, F.col("embedding").cast("array<double>")
    nested = F.when(o == 0, F.array(e)).when(o == 1, F.transform(e, lambda x: F.array(x))).otherwise(F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)))
    d = B.canonical_vector(P.table(spark, sf, "embeddings").select("vec_id", nested.alias("label_vector")), 64, "label_vector")
    return d.select("vec_id", "valid", F.coalesce(F.size("vector_out"), F.lit(-1)).alias("length"))


@query("nonfinite_policy", f"""WITH {S.SPATIAL} SELECT recording_id, 'value' AS modality, count(*) FILTER (value > 0.2) AS nonfinite_count, {q('sum(CASE WHEN value > 0.2 THEN 0 ELSE value END)', 'repaired_sum', 4)} FROM cells GROUP BY recording_id""")
def nonfinite_policy(spark, sf):
    d = _holed_long(spark, sf)
    fixed = B.handle_nonfinite(d, ["value"], "zero").groupBy(RECORDING).agg(r(F.sum("value"), 4, "repaired_sum"))
    return B.nonfinite_counts(d, ["value"], [RECORDING]).join(fixed, RECORDING)


@query("modality_alignment", f"""WITH c AS (SELECT user_id, count(*) FILTER (kind = 'click') AS a, count(*) FILTER (kind = 'view') AS b, count(*) FILTER (kind = 'purchase') AS l FROM (SELECT *, {_KIND_SQL} AS kind FROM events) GROUP BY 1)
{violation('modality_length', 'user_id::VARCHAR', "a || ',' || b || ',' || l", 'c WHERE a <> b OR b <> l')}""")
def modality_alignment(spark, sf):
    return B.validate_alignment(*[_typed(spark, sf, k) for k in ("click", "view", "purchase")])


@query("contiguous_index", f"""WITH s AS (SELECT l_orderkey, min(l_linenumber - 1) AS lo, max(l_linenumber - 1) AS hi, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1)
{violation('contiguous_index', 'l_orderkey::VARCHAR', "lo || ',' || hi || ',' || n || ',' || d", 's WHERE lo <> 0 OR hi <> n - 1 OR d <> n')}""")
def contiguous_index(spark, sf):
    d = P.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias(TIME))
    return B.check_contiguous(d, ["l_orderkey"])


@query("target_firewall", f"WITH {S.PANEL} SELECT {S.KT}, {q('fast')}, {q('slow')} FROM panel")
def target_firewall(spark, sf):
    d = B.require_target_free(P.event_panel(spark, sf).drop("target"))
    return d.select(*SEQUENCE, TIME, r("fast"), r("slow"))


@query("unique_key", violation("unique_key", "l_orderkey || '|' || l_linenumber", "n::VARCHAR", "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)"))
def unique_key(spark, sf):
    return B.check_unique(P.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("value_domain", " UNION ALL ".join(violation("value_domain", f"'{c}'", "n::VARCHAR", f"(SELECT count(*) AS n FROM lineitem WHERE {c} < 0 OR {c} > 0.05) WHERE n > 0") for c in ("l_discount", "l_tax", "l_quantity")))
def value_domain(spark, sf):
    return B.check_domain(P.table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"], 0.0, 0.05)


@query("panel_inventory", f"""WITH {S.SEQ}, h AS (SELECT group_id, recording_id, count(*) AS n FROM seq GROUP BY ALL), s(seed) AS (VALUES (42), (123), (2026))
{violation('inventory_rows', "group_id || '|' || seed || '|' || recording_id", "n || ' of 33'", 'h, s WHERE n <> 33')} UNION ALL
{violation('inventory_missing', "group_id || '|7|' || recording_id", "'33'", 'h')}
UNION ALL {violation('shared_recording', "recording_id::VARCHAR", "n::VARCHAR", "(SELECT recording_id, count(DISTINCT group_id) AS n FROM h GROUP BY 1 HAVING count(DISTINCT group_id) > 1)")}""")
def panel_inventory(spark, sf):
    p = P.event_panel(spark, sf)
    return B.validate_inventory(p, p.select(GROUP, RECORDING).distinct(), (42, 123, 2026, 7), 33)


@query("ledger_coverage", f"""WITH c AS (SELECT user_id, ts::DATE AS d, event_type, count(*) AS m FROM events GROUP BY ALL), g AS (SELECT user_id, d, count(*) AS k, count(*) FILTER (m > 1) AS tw FROM c GROUP BY ALL)
{violation('incomplete_root', "user_id || '|0|' || datediff('day', DATE '2024-01-01', d)", 'k::VARCHAR', 'g WHERE k < 5')} UNION ALL {violation('repeated_branch', "user_id || '|0|' || datediff('day', DATE '2024-01-01', d)", 'tw::VARCHAR', 'g WHERE tw > 0')}""")
def ledger_coverage(spark, sf):
    d = P.table(spark, sf, "events").select(F.col("user_id").alias(GROUP), F.lit(0).alias(RECORDING), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("t0"), "event_type")
    return B.validate_ledger(d, d.select(GROUP, RECORDING, "t0"), {"event_type": ["view", "signup", "purchase", "click", "error"]})


# A start point that a side does not have is a thousand rows further on there.
_SIDE = "SELECT group_id, recording_id, CASE WHEN {c} > 0.4 THEN time_index ELSE time_index + 1000 END AS time_index FROM panel"


@query("root_manifest_check", f"""WITH {S.PANEL}, os AS MATERIALIZED ({_SIDE.format(c='slow')}), es AS ({_SIDE.format(c='fast')}), o AS (SELECT DISTINCT * FROM os), e AS (SELECT DISTINCT * FROM es),
t AS (SELECT group_id, recording_id, time_index, count(*) AS n FROM os GROUP BY ALL)
{violation('unique_key', "group_id || '|' || recording_id || '|' || time_index", 'n::VARCHAR', 't WHERE n > 1')} UNION ALL
{violation('root_range', "group_id || '|' || recording_id || '|' || time_index", 'time_index::VARCHAR', 'os WHERE time_index < 5 OR time_index > 30')} UNION ALL
{violation('root_set', "group_id || '|' || recording_id || '|' || time_index", "'extra'", '(FROM o EXCEPT FROM e)')} UNION ALL
{violation('root_set', "group_id || '|' || recording_id || '|' || time_index", "'missing'", '(FROM e EXCEPT FROM o)')}""")
def root_manifest_check(spark, sf):
    p = P.event_panel(spark, sf).withColumnRenamed(TIME, "t0")
    side = lambda c: p.select(GROUP, RECORDING, F.when(F.col(c) > 0.4, F.col("t0")).otherwise(F.col("t0") + 1000).alias("t0"))
    return B.validate_roots(side("slow"), side("fast"), 5, 30)


_AL = "(SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS k, o_totalprice AS a FROM orders) x FULL JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1) y USING (k)"


@query("paired_key_alignment", f"""WITH j AS (SELECT k, a, b FROM {_AL}) SELECT 'price' AS "column", {q('max(abs(a - b))', 'max_abs_error', 2)}, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired,
  count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired FROM j""")
def paired_key_alignment(spark, sf):
    a = P.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("k"), F.col("o_totalprice").alias("price"))
    b = P.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("price"))
    return B.max_abs_error(a, b, ["k"], ["price"]).select("column", r("max_abs_error", 2), "paired", "unpaired")


# Small events belong to other groups, a million further on.
@query("group_completeness", """WITH s AS MATERIALIZED (SELECT CASE WHEN value > 200 THEN user_id ELSE user_id + 1000000 END AS user_id, event_type FROM events), o AS (SELECT DISTINCT * FROM s), e AS (SELECT user_id, k FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click'), ('view')) t(k)),
d AS (SELECT user_id, event_type, count(*) AS n FROM s GROUP BY ALL) """ + " UNION ALL ".join([
    violation("group_set", "user_id || '|' || k", "'missing'", "(FROM e EXCEPT FROM o)"), violation("group_set", "user_id || '|' || event_type", "'extra'", "(FROM o EXCEPT FROM e)"),
    violation("unique_key", "user_id || '|' || event_type", "n::VARCHAR", "d WHERE n > 1")]))
def group_completeness(spark, sf):
    ev = P.table(spark, sf, "events").select(F.col("user_id").alias(GROUP), "event_type", "value")
    moved = ev.select(F.when(F.col("value") > 200, F.col(GROUP)).otherwise(F.col(GROUP) + 1_000_000).alias(GROUP), "event_type")
    return B.check_groups(moved, ev, "event_type", ["click", "view"])


@query("source_bindings", """WITH f AS (SELECT CASE WHEN n_chars < 200 THEN 'moved/' ELSE '' END || doc_id AS p, sha256(CASE WHEN lang = 'fr' THEN upper(text) ELSE text END) AS h FROM documents), r AS (SELECT doc_id::VARCHAR AS p, sha256(text) AS w FROM documents), j AS (SELECT * FROM r LEFT JOIN f USING (p)) """
       + violation("missing_file", "p", "'absent'", "j WHERE h IS NULL") + " UNION ALL " + violation("changed_file", "p", "'hash differs'", "j WHERE h <> w"))
def source_bindings(spark, sf):
    d = P.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), "text", "lang", "n_chars")
    registry = d.select("relative_path", F.sha2("text", 256).alias("sha256"))
    files = d.select(F.concat(F.when(F.col("n_chars") < 200, "moved/").otherwise(""), "relative_path").alias("relative_path"), F.sha2(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"))
    return B.check_bindings(files, registry)


@query("config_fingerprint", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS fingerprint FROM orders""")
def config_fingerprint(spark, sf):
    d = P.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return FP.fingerprint(d, d.columns).select("o_orderkey", "fingerprint")


@query("table_fingerprint")
def table_fingerprint(spark, sf):
    d = P.table(spark, sf, "lineitem")
    return FP.table_fingerprint(d, d.columns)


_SPLITS = """sp AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS seed, event_type AS fold, user_id AS g, CASE WHEN value > 100 THEN 'validation' ELSE 'train' END AS role FROM events)"""


@query("split_disjointness", f"""WITH {_SPLITS}, a AS (SELECT seed, fold, g, count(DISTINCT role) AS n FROM sp GROUP BY ALL), b AS (SELECT seed, g, count(*) FILTER (role = 'validation') AS v FROM sp GROUP BY ALL)
{violation('overlapping_roles', "seed || '|' || fold || '|' || g", 'n::VARCHAR', 'a WHERE n > 1')} UNION ALL {violation('validated_once', "seed || '|' || g", 'v::VARCHAR', 'b WHERE v <> 1')}""")
def split_disjointness(spark, sf):
    d = P.table(spark, sf, "events").select(
        F.when(F.col("ts") < F.lit(P.SPLIT_DAY).cast("timestamp"), 0).otherwise(1).alias(SEED), F.col("event_type").alias("fold"),
        F.col("user_id").alias(GROUP), F.when(F.col("value") > 100, "validation").otherwise("train").alias("role"))
    return B.check_splits(d)


@query("printed_numbers", violation("printed_number", "c_custkey::VARCHAR", "(floor(c_acctbal / 10) / 100)::VARCHAR", "customer WHERE abs(c_acctbal / 1000 - (floor(c_acctbal / 10) / 100)::VARCHAR::DOUBLE) > 0.5 * pow(10.0::DOUBLE, -len(split_part((floor(c_acctbal / 10) / 100)::VARCHAR, '.', 2))) + 1e-15"))
def printed_numbers(spark, sf):
    c = P.table(spark, sf, "customer")
    stored = c.select("c_custkey", (F.col("c_acctbal") / 1000).alias("value"))
    printed = c.select("c_custkey", (F.floor(F.col("c_acctbal") / 10) / 100).cast("string").alias("token"))
    return B.check_printed(stored, printed, ["c_custkey"])


_COPY = "(SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer)"


@query("two_copies", f"""WITH a AS (SELECT c_custkey, c_name, c_acctbal FROM customer), b AS {_COPY} {violation('only_in_first', 'c_custkey::VARCHAR', "''", '(FROM a EXCEPT ALL FROM b)')} UNION ALL {violation('only_in_second', 'c_custkey::VARCHAR', "''", '(FROM b EXCEPT ALL FROM a)')}""")
def two_copies(spark, sf):
    a = P.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    b = a.withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return B.check_copies(a.drop("c_mktsegment"), b.drop("c_mktsegment"), ["c_custkey"])


@query("identity_table", """WITH j AS (SELECT p_partkey, p_size, p_type, CASE WHEN p_brand = 'Brand#2' THEN p_size + 1 ELSE p_size END AS s2 FROM part) """
       + violation("identity_field", "p_partkey || '|p_size'", "p_size || ' is not ' || s2", "j WHERE p_size <> s2"))
def identity_table(spark, sf):
    a = P.table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    b = a.withColumn("p_size", F.when(F.col("p_brand") == "Brand#2", F.col("p_size") + 1).otherwise(F.col("p_size")))
    return B.check_identity(a, b, ["p_partkey"])


# ------------------------------------------------------------------ streams
def _in_slice_order(spark, src: str) -> None:
    """Give the files of a slice a modification time by its number: a file stream takes the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{src}/slice=*/*.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath() for f in fs.globStatus(path)]
    slices = [int(f.getParent().getName().removeprefix("slice=")) for f in files]
    start = int(time.time() * 1000) - max(slices, default=0)
    for f, k in zip(files, slices, strict=True):
        fs.setTimes(f, start + k, -1)


#: Rows of a slice in one task and file; a trigger takes four files.
SLICE_ROWS = 1 << 20


def _streamed(spark, sf, run):
    """Panel slices as a file stream in order of time, run to its end; the sink is read back.

    Every row of the panel has to come out as a state: late rows, gaps and rows that still wait raise.
    """
    src, out, ck = (stage_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    p = P.event_panel(spark, sf)
    # A slice is a share of all rows, so it is dealt to tasks and files of bounded size by its sequences.
    sliced = p.withColumn("slice", F.expr("time_index div 20"))
    parts = F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int")
    sizes = cut(sliced.groupBy("slice").agg(parts.alias("_parts")))
    tasks = sizes.agg(F.sum("_parts")).first()[0] or 1
    dealt = sliced.join(F.broadcast(sizes), "slice").withColumn("_part", F.pmod(F.xxhash64(*SEQUENCE), "_parts"))
    dealt.repartition(tasks, "slice", "_part").drop("_part", "_parts").write.partitionBy("slice").parquet(src)
    _in_slice_order(spark, src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 4).parquet(f"{src}/slice=*")
    done = run(stream).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
    done.awaitTermination()
    got = spark.read.parquet(out)
    n, states, events = spark.read.parquet(src).count(), got.where("event = 'state'").count(), got.count()
    if not n == states == events:
        raise ValueError(f"{n} rows streamed, {states} states and {events - states} late rows or gaps came out")
    return got


@query("stream_ema", f"WITH RECURSIVE {S.PANEL}, {S.linear('s', '0.3::DOUBLE', start='fast')} SELECT {S.KT}, {q('state')} FROM s")
def stream_ema(spark, sf):
    return _streamed(spark, sf, lambda s: ST.stream_update(s, "ema", 0.3)).select(*SEQUENCE, TIME, r("state"))


@query("stream_kalman_fixed", f"""WITH RECURSIVE {S.PANEL}, k AS (
  SELECT {S.KT}, fast AS state, 1.0::DOUBLE AS variance, 0.0::DOUBLE AS gain FROM panel WHERE time_index = 0
  UNION ALL
  SELECT {S.KT}, m + g * (fast - m), (1 - g) * (v + 0.001), g
  FROM (SELECT p.group_id, p.seed, p.recording_id, p.time_index, p.fast, k.state AS m, k.variance AS v,
      (k.variance + 0.001::DOUBLE) / (k.variance + 0.001::DOUBLE + 0.01) AS g
    FROM k JOIN panel p ON {S.same('p', 'k')} AND p.time_index = k.time_index + 1))
SELECT {S.KT}, {q('state')}, {q('gain')} FROM k""")
def stream_kalman_fixed(spark, sf):
    d = _streamed(spark, sf, lambda s: ST.stream_update(s, "kalman_fixed", U.KalmanParams(q=0.001, r=0.01)))
    return d.select(*SEQUENCE, TIME, r("state"), r("gain"))


@query("stream_kalman", f"WITH RECURSIVE {S.PANEL}, {S.ADAPTIVE} SELECT {S.KT}, {q('state')}, {q('gain')} FROM kal")
def stream_kalman(spark, sf):
    d = _streamed(spark, sf, lambda s: ST.stream_update(s, "kalman_adaptive", U.KalmanParams()))
    return d.select(*SEQUENCE, TIME, r("state"), r("gain"))


@query("stream_change_aware", f"WITH RECURSIVE {S.PANEL}, {S.context()}, {S.tracker()} SELECT {S.KT}, {q('state')}, {q('alpha', 'gain')} FROM full_")
def stream_change_aware(spark, sf):
    d = _streamed(spark, sf, ST.stream_change_aware)
    return d.select(*SEQUENCE, TIME, r("state"), r("gain"))


@query("stream_prefix_check", f"WITH RECURSIVE {S.PANEL} SELECT group_id, seed, recording_id, count(*) AS streamed_rows, count(*) AS prefix_rows, count(*) AS equal_rows FROM panel GROUP BY ALL")
def stream_prefix_check(spark, sf):
    """Rows of each sequence that the streamed and the batch constant gain agree on: all."""
    d = _streamed(spark, sf, lambda s: ST.stream_update(s, "constant_gain", 0.2))
    return ST.prefix_counts(d, U.constant_gain(P.event_panel(spark, sf), 0.2, length=P.event_length(spark, sf)))
