"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelseq.llm import chat, chat_repair, decontam, embed_join, lang_id, licenses, merkle, pieces, quality, sentence_spans, shards, simhash, suffix_dedup
from panelseq.llm.common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


CHAT_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss_text,
    sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n'))
      + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) - 1) AS formatted_chars
  FROM all_turns GROUP BY conv_id),
steps AS (
  SELECT conv_id, role, row_number() OVER w AS i, coalesce(lag(role) OVER w, '') AS before, coalesce(lag(role, 2) OVER w, '') AS earlier
  FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
machine AS (
  SELECT conv_id, min(i) FILTER (NOT CASE role WHEN 'system' THEN i = 1 WHEN 'user' THEN i = 1 OR before = 'assistant' OR (before = 'system' AND i = 2)
    WHEN 'assistant' THEN before = 'user' ELSE false END) - 1 AS stopped_at, arg_max(role, i) AS last_role FROM steps GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss_text) AS loss_chars,
  sha256(loss_text) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  stopped_at IS NULL AND last_role = 'assistant' AS valid, stopped_at::INT AS stopped_at
FROM joined JOIN machine USING (conv_id)
"""


@query("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    out = chat.format_chats(given.union(more))
    turns = chat.read_turns(F.col("formatted"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("turns", turns).withColumn("loss", chat.loss_text(F.col("segments"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "stopped_at")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_byte_shards")
def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


@query("op10_embedding_join", EMBEDDING_SQL)
def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op7_importance_resample")
def op7_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


LICENSE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, range(1, len(w) + 1) AS i FROM w),
f AS (
  SELECT doc_id, w, s,
    list_filter(i, lambda k: w[k] = 'cc' AND k < len(w) AND w[k + 1] = 'by') AS cc,
    list_filter(i, lambda k: w[k] = 'general' AND k + 1 < len(w) AND w[k + 1] = 'public' AND w[k + 2] = 'license') AS gpl,
    list_filter(i, lambda k: w[k] = 'all' AND k + 1 < len(w) AND w[k + 1] = 'rights' AND w[k + 2] = 'reserved') AS res
  FROM p),
l AS (
  SELECT doc_id, w, list_concat(list_concat(cc, gpl), res) AS places,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END,
      CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
    list_filter([
      CASE WHEN contains(s, ' licensed under the apache license version 2 ') THEN 'apache-2.0-notice' END,
      CASE WHEN regexp_matches(s, ' released under (the terms of )?the mit license ') THEN 'mit-notice' END,
      CASE WHEN regexp_matches(s, ' licensed under (the terms of )?the gnu (lesser )?general public license ') THEN 'gpl-notice' END,
      CASE WHEN regexp_matches(s, ' licensed under (a )?cc by (nc )?(sa )?[^ ]+ ') THEN 'cc-notice' END,
      CASE WHEN regexp_matches(s, ' copyright (c )?([^ ]+ ){1,8}all rights reserved ') THEN 'copyright-notice' END
    ], lambda x: x IS NOT NULL) AS more
  FROM f)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_concat(base, more)), ','), '') AS labels,
  CASE WHEN len(more) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM l
"""


@query("op9_license_scan", LICENSE_SQL)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("places")


SENTENCE_SQL = r"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(
    regexp_replace(coalesce(text, ''), '([.!?])[ \t\r\x0B\x0C]', '\1' || chr(10), 'g'), chr(10)),
    lambda x: regexp_replace(x, '^[ \t\r\x0B\x0C]+|[ \t\r\x0B\x0C]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^ \t\r\x0B\x0C]+'))) AS w FROM s),
ends AS (
  SELECT a.doc_id, a.i, a.l, list_position(list_transform(range(a.i, len(a.l) + 1), lambda k: list_sum(a.w[a.i:k]) >= 20), true) - 1 + a.i AS j
  FROM (SELECT doc_id, l, w, unnest(range(1, len(l) + 1)) AS i FROM w) a),
spans AS (SELECT doc_id, i, j, array_to_string(l[i:j], chr(10)) AS run FROM ends WHERE j IS NOT NULL),
again AS (SELECT doc_id, i, j FROM spans QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM again),
per AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(l) AS n_sentences, coalesce(len(g), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: g IS NULL OR NOT list_contains(g, k)), lambda k: l[k]), chr(10)), '')) AS kept_sha256
FROM s LEFT JOIN per USING (doc_id)
"""


@query("op3_sentence_spans", SENTENCE_SQL)
def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.sentence_dedup(documents(spark, sf_dir)).drop("text")


@query("op5_piece_nbest")
def op5_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir))


#: CRC-32 of a list of byte values.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], {bytes}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
  lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII expression."""
    return CRC32_SQL.format(bytes=f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)")


def leaf_sql(n_chars: str) -> str:
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {leaf_sql("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf_sql("(n_chars + 1)")} END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM leaves),
nodes AS (
  SELECT grp, 0 AS level, slot, leaf AS node, count(*) OVER (PARTITION BY grp) AS size FROM placed
  UNION ALL
  SELECT grp, level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), (any_value(size) + 1) // 2
  FROM nodes WHERE size > 1 GROUP BY grp, level, slot // 2),
subroots AS (SELECT grp, level AS height, node AS subroot FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, grp AS slot, subroot AS node, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), (any_value(size) + 1) // 2
  FROM tops WHERE size > 1 GROUP BY level, slot // 2),
roots AS (SELECT level AS height, node AS root FROM tops WHERE size = 1),
siblings AS (
  SELECT grp, level, slot, node FROM nodes
  UNION ALL SELECT s.grp, s.height + t.level, -1 - t.slot, t.node FROM tops t, subroots s),
climb AS (
  SELECT doc_id, p.grp, leaf, p.slot AS leaf_slot, 0 AS level, CASE WHEN s.height = 0 THEN p.grp ELSE p.slot END AS slot, '' AS proof,
    coalesce(tampered, leaf) AS node FROM placed p JOIN subroots s USING (grp)
  UNION ALL
  SELECT c.doc_id, c.grp, c.leaf, c.leaf_slot, c.level + 1,
    CASE WHEN c.level + 1 = s.height THEN c.grp ELSE c.slot // 2 END,
    c.proof || coalesce(n.node, ''),
    sha256(CASE WHEN c.slot % 2 = 1 THEN coalesce(n.node, '') || c.node ELSE c.node || coalesce(n.node, '') END)
  FROM climb c JOIN subroots s ON s.grp = c.grp CROSS JOIN roots r
  LEFT JOIN siblings n ON n.grp = c.grp AND n.level = c.level
    AND n.slot = CASE WHEN c.level < s.height THEN xor(c.slot, 1) ELSE -1 - xor(c.slot, 1) END
  WHERE c.level < s.height + r.height),
start AS (
  SELECT doc_id, p.grp, leaf, p.slot AS leaf_slot, s.subroot, r.root, s.height, r.height AS top FROM placed p JOIN subroots s USING (grp) CROSS JOIN roots r)
SELECT b.doc_id, b.leaf, b.subroot, b.root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = b.root AS verified
FROM start b JOIN climb c ON c.grp = b.grp AND c.leaf_slot = b.leaf_slot AND c.level = b.height + b.top
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


REPAIR_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND copy <= CASE WHEN kind = 3 THEN 2 ELSE 1 END),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM ordered),
marked AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(solid[-1], '[.!?]') THEN 'truncated' END AS fault,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS r FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id),
inserts(q, p, more, letters) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'),
    (0, 3, 4, 'II'), (1, 3, 4, 'II')),
edits(p, t, needs, price, letter) AS (
  VALUES (0, 0, NULL, 3, 'D'), (1, 1, NULL, 3, 'D'), (2, 2, NULL, 3, 'D'), (3, 3, NULL, 3, 'D'),
    (0, 2, '*', 2, 'R'), (1, 2, '*', 2, 'R'), (2, 3, '*', 2, 'R'), (3, 2, '*', 2, 'R'),
    (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (3, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K')),
moves AS (SELECT q, t, needs, more + price AS price, letters || letter AS letters, letter FROM inserts JOIN edits USING (p)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS b FROM counts
  UNION ALL
  SELECT m.conv_id, m.i, v.t, min({{'cost': b.b.cost + v.price + CASE WHEN m.fault = 'truncated' AND v.letter <> 'D' THEN 1 ELSE 0 END, 'audit': b.b.audit || v.letters}})
  FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1
  JOIN moves v ON v.q = b.q AND (v.needs IS NULL OR ((m.fault IS NULL OR m.fault = 'truncated') AND v.needs IN ('*', m.r)))
  GROUP BY m.conv_id, m.i, v.t),
plans AS (
  SELECT b.conv_id, min({{'cost': b.b.cost + e.more, 'audit': b.b.audit || e.letters}}) AS b
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) e(q, more, letters) ON e.q = b.q GROUP BY b.conv_id),
letters AS (
  SELECT conv_id, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS p FROM plans),
placed AS (
  SELECT conv_id, p, audit[p] AS letter, p - (length(audit[1:p]) - length(replace(audit[1:p], 'I', ''))) AS i,
    length(replace(audit[1:p], 'D', '')) AS o FROM letters),
lines AS (
  SELECT l.conv_id, l.p, l.letter, l.o, m.role, m.text, coalesce(bool_or(l.o = 1 AND l.letter = 'K' AND m.r = 's') OVER (PARTITION BY l.conv_id), false) AS headed
  FROM placed l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i AND l.letter <> 'I'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o % 2 = 1) <> headed THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body FROM lines WHERE letter <> 'D' GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(p.b.cost, 0)::BIGINT AS cost, coalesce(p.b.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op11_chat_repair", REPAIR_SQL)
def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_repair.repair_report(chat_repair.damage(given), given)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_report(documents(spark, sf_dir))
