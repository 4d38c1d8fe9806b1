"""Importance resampling: models, cut, selection and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelseq.llm import quality as Q
from panelseq.llm.common import text_bytes


def test_ngrams_count_words_and_pairs():
    texts = ["a b, b", "", None, "a b", "!!x", "é é"]
    buf, offs = text_bytes(pa.array(texts))
    bucket, row = Q.ngrams(buf, offs)
    assert np.bincount(row, minlength=6).tolist() == [7, 0, 0, 3, 3, 3]
    of = [Counter(bucket[row == r].tolist()) for r in range(6)]
    assert not of[3] - of[0] and max(of[5].values()) == 2


def test_log_ratio_and_cut():
    raw, target = np.array([10.0, 30, 0, 60]), np.array([5.0, 1, 0, 4])
    r = Q.log_ratio(target, raw)
    assert r[0] > 0 > r[1] and r[2] < 0 and abs(r[3]) < abs(r[1])
    assert Q.best_cut([(-3.0, 0), (-1.0, 0), (0.5, 1), (2.0, 1), (-0.5, 1)]) == -0.5 and Q.best_cut([(-3.0, 1), (-2.0, 0), (-1.0, 0), (0.5, 1)]) == -3.0
    assert Q.best_cut([(-3.0, 1)]) == -np.inf and Q.best_cut([]) == -np.inf and Q.best_cut([(1.0, 0)]) == -np.inf


@pytest.mark.parametrize("k", [1, 2, 57, 199, 200])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(0)
    v = [*rng.integers(-(2**63), 2**63 - 1, 150).tolist(), *([12345] * 30), *range(-10, 10)]
    df = spark.createDataFrame([(int(x),) for x in v], "rank_key long")
    assert Q.kth_largest(df, k) == sorted(v, reverse=True)[k - 1]


def test_held_out_accuracy_and_selection(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where(F.pmod(F.hash("doc_id"), F.lit(3)) > 0)
    out = Q.importance_resample(docs, half).cache()
    unseen = out.join(labels.join(half, "doc_id", "left_anti"), "doc_id").toPandas()
    good, bad = unseen[unseen.quality == 1], unseen[unseen.quality == 0]
    assert len(bad) > 100 and good.kept.mean() > 0.99 and bad.kept.mean() < 0.1
    rows = out.toPandas()
    assert len(rows) == docs.count()
    # Kept rows are the k largest perturbed weights; k is the number of weights at or above the cut.
    assert rows[rows.kept].log_weight.min() > rows[~rows.kept].log_weight.max() - 2.5
    again = Q.importance_resample(docs.repartition(7), half.repartition(2)).toPandas()
    assert again.set_index("doc_id").kept.sort_index().equals(rows.set_index("doc_id").kept.sort_index())


def test_nulls_no_labels_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "fine words here"), (3, "fine words here"), (None, "!!! ###"), (4, "z" * 300_000)]
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, log_weight double, kept boolean")
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.importance_resample(df, none).collect()
    assert len(got) == 6 and all(r.kept and r.log_weight == 0 for r in got)
    some = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (1, 0)], "doc_id long, quality int")
    got = Q.importance_resample(df, some).collect()
    assert len(got) == 6 and {r.n_grams for r in got if r.doc_id in (1, 2)} == {0}
    kept = Q.resampled(df, some)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert Q.importance_resample(df.limit(0), some).count() == 0 and Q.resampled(df.limit(0), none).count() == 0
