"""The kernel and its ridge solution against plain computations, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelseq.llm import lang_id as li
from panelseq.llm.common import text_bytes
from panelseq.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string"


def plain_ngrams(text):
    """Strings of one to three symbols of the text between spaces, runs of other bytes being one space."""
    raw = [chr(b).lower() if b < 128 else chr(b) for b in (text or "").encode()]
    letters = [c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in raw]
    out = [" "]
    for c in [*letters, " "]:
        if c != " " or out[-1] != " ":
            out.append(c)
    s = "".join(out)
    return {*s.replace(" ", ""), *(s[k: k + 2] for k in range(len(s) - 1)), *(s[k: k + 3] for k in range(len(s) - 2))}


def name(code):
    def sign(v):
        return " " if v == 0 else chr(v + 96) if v < 27 else chr(v + 101)

    if code < li.BASE:
        return sign(code)
    code -= li.BASE
    if code < li.BASE**2:
        return sign(code // li.BASE) + sign(code % li.BASE)
    code -= li.BASE**2
    return sign(code // li.BASE**2) + sign(code // li.BASE % li.BASE) + sign(code % li.BASE)


def test_ngrams_of_a_batch():
    texts = ["Hi, you", "", None, "  a--b ", "é!", "x", "Ab ab", "..."]
    rows, codes = li.ngrams(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        assert {name(c) for c in codes[rows == k]} == plain_ngrams(t), t


def test_letters():
    texts = ["1 2!", "é", "…", None, "", "я", "x"]
    assert li.has_letter(*text_bytes(pa.array(texts))).tolist() == [False, True, False, False, False, True, True]


def test_weights_are_the_ridge_solution():
    """Scores by weights equal kernel values times the dual solution, with all rows as landmarks."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.int32) for _ in range(40)]
    vocabulary = np.unique(np.concatenate(sets)).astype(np.int64)
    y = np.eye(3)[rng.integers(0, 3, 40)]
    k = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    dual = np.linalg.solve(k + 0.05 * len(sets) * np.eye(40), y)
    w = li.solve(sets, sets, vocabulary, y, 0.05)
    p = np.array([np.isin(vocabulary, s) / np.sqrt(len(s)) for s in sets])
    assert np.abs(p @ w - k @ dual).max() < 1e-4


def test_odd_rows(spark):
    rows = [(k, f"the {w} and of thing", "en") for k, w in enumerate("cat dog hen fox cow pig".split())]
    rows += [(10 + k, f"le {w} et la chose", "fr") for k, w in enumerate("chat chien poule".split())]
    train = spark.createDataFrame([*rows, (50, "nolang", None), (51, None, "de"), (52, "123 456", "de")], SCHEMA)
    model = li.fit(train)
    assert model.langs == ["en", "fr"] and model.usual == 0
    asked = [(1, "the thing", "xx"), (1, "the thing", "xx"), (None, "la chose", None), (3, None, "en"), (4, "", "en"), (5, "42 ...", "en"), (6, "ШШШ", "en"), (7, "la chose " * 40000, "en")]
    docs = spark.createDataFrame(asked, SCHEMA).withColumn("lang_pred", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(3)
    got = sorted(((str(r.doc_id), r.lang_pred, r.score > 0) for r in li.predict(docs, model, "doc_id").collect()))
    assert got == sorted([("1", "en", True), ("1", "en", True), ("None", "fr", True), ("3", "und", False), ("4", "und", False), ("5", "und", False),
                          ("6", "en", False), ("7", "fr", True)])
    assert all(0 <= r.score <= 1 for r in li.predict(docs, model, "doc_id").collect())
    none = li.fit(train.where("lang = 'zz'"))
    assert {(r.lang_pred, r.score) for r in li.predict(docs, none, "doc_id").collect()} == {("und", 0.0)}
    assert li.predict(docs.limit(0), model).collect() == []


def test_bounded_sample_takes_each_lang(spark):
    rows = [(k, f"word{chr(97 + k % 26)} thing of the {k}", "en") for k in range(900)] + [(k, "rare le la", "fr") for k in range(2)]
    model = li.fit(spark.createDataFrame(rows, SCHEMA), max_rows=20, max_landmarks=6)
    assert model.langs == ["en", "fr"] and len(model.codes) < 400


def test_held_out_accuracy_and_no_peeking(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = QUERIES["op12_language_id"](spark, d)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 200
    # Labels of held-out rows change nothing.
    hidden = docs.withColumn("lang", F.when(li.fold(F.col("doc_id")) == 1, "zz").otherwise(F.col("lang")))
    a, b = got.toPandas(), li.language_report(hidden).toPandas()
    assert a.sort_values("doc_id").lang_pred.tolist() == b.sort_values("doc_id").lang_pred.tolist()
