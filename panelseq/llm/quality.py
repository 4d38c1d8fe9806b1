"""Quality filter by importance resampling over hashed n-grams.

Two generative models, each a smoothed distribution over hashed words and word pairs: one of the target
(rows labelled good), one of the raw corpus (all rows). The logarithm of their ratio, over the root of the
number of n-grams, is a document's importance weight; Gumbel noise makes the k largest perturbed weights a sample without replacement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq.llm.common import U, mix, narrow, prefix_hash, range_hash, row_offsets, runs, slices, text_bytes
from panelseq.session import cut, ship

BUCKET_BITS = 16
#: Most labelled rows that the target model and the calibration use, taken by hash of the id.
MAX_LABELLED = 20_000
SMOOTHING = 1.0
#: Pseudo-counts of the target model as a share of the number of buckets.
PRIOR_SHARE = 0.05
#: What a good row below the cut counts against a bad row above it.
GOOD_WEIGHT = 3
#: Scale of the Gumbel noise: what is sampled are the importance weights to the power 1 / TEMPERATURE.
TEMPERATURE = 0.05
#: Bytes in three classes: white space, letters and digits, the rest.
TOKEN_CLASS = np.full(256, 2, np.uint8)
TOKEN_CLASS[:33] = 0
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    TOKEN_CLASS[_low:_high] = 1


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each token and each pair of neighbouring tokens."""
    start, end, row = runs(buf, offs, TOKEN_CLASS)
    h = range_hash(prefix_hash(buf), start, end)
    pair = row[1:] == row[:-1]
    two = mix(h[:-1][pair] * U(3) + h[1:][pair])
    return (np.concatenate([h, two]) >> U(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def _count(batches):
    """One row for each bucket a task has met."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in batches:
        for part in slices(b, "text"):
            total += np.bincount(ngrams(*text_bytes(part.column("text")))[0], minlength=len(total))
    at = np.flatnonzero(total)
    for lo in range(0, len(at), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(at[lo: lo + (1 << 14)]), pa.array(total[at[lo: lo + (1 << 14)]])], ["bucket", "n"])


def _model(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets: a table of fixed size, whatever the input."""
    rows = docs.mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BUCKET_BITS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw for each bucket; both are pulled towards the raw distribution where counts are small."""
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    prior = PRIOR_SHARE * len(raw)
    return np.log((target + prior * p_raw) / (target.sum() + prior) / p_raw)


def _weights(part: pa.RecordBatch, ratio: np.ndarray, seed: int):
    bucket, row = ngrams(*text_bytes(part.column("text")))
    n = part.num_rows
    size = np.bincount(row, minlength=n)
    # Over the root of the length, weights of short and long texts are on one scale.
    w = np.bincount(row, weights=ratio[bucket], minlength=n).astype(np.float64) / np.sqrt(np.maximum(size, 1))
    ids = part.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy().astype(U)
    u = ((mix(ids * U(0x9E3779B97F4A7C15) + U(seed)) >> U(11)).astype(np.float64) + 0.5) / 2.0**53
    bits = (w - TEMPERATURE * np.log(-np.log(u)) + 0.0).view(np.int64)
    return w, size, np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _weigh(shared, seed: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                w, size, rank = _weights(part, shared.value, seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w), pa.array(size), pa.array(rank)], ["doc_id", "log_weight", "n_grams", "rank_key"])

    return run


def _keep(shared, seed: int, least: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                yield part.filter(pa.array(_weights(part, shared.value, seed)[2] >= least))

    return run


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of the long column ``rank_key``, from four histograms of at most 65,536 bins."""
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = keys if prefix is None else keys.where(F.shiftright("rank_key", shift + 16) == prefix)
        bins = rows.groupBy(F.shiftright("rank_key", shift).alias("bin")).count().collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if k <= r["count"]:
                prefix = r["bin"]
                break
            k -= r["count"]
    return prefix


class Resampler:
    """Fitted models and the cut of one corpus."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 17, max_labelled: int = MAX_LABELLED) -> None:
        spark = docs.sparkSession
        ship(spark)
        self.seed = seed
        rows = narrow(docs, "doc_id", "text")
        known = narrow(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        sample = cut(rows.join(F.broadcast(known), "doc_id").withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0))
        target = _model(sample.where("fit and quality = 1").select("doc_id", "text"))
        ratio = log_ratio(target, _model(rows)) if target.any() else np.zeros(1 << BUCKET_BITS)
        self.shared = spark.sparkContext.broadcast(ratio)
        kind = rows.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, log_weight double, n_grams bigint, rank_key bigint"
        held = sample.where("not fit").select("doc_id", "text", "quality")
        seen = held.select("doc_id", "text").mapInArrow(_weigh(self.shared, seed), schema).join(held.select("doc_id", "quality").distinct(), "doc_id")
        self.cut_weight = best_cut([(r["log_weight"], r["quality"]) for r in seen.select("log_weight", "quality").collect()])
        self.scored = cut(rows.mapInArrow(_weigh(self.shared, seed), schema))
        k = self.scored.where(F.col("log_weight") >= self.cut_weight).count()
        self.least = kth_largest(self.scored, k) if k else 2**63 - 1

    def scores(self) -> DataFrame:
        return self.scored.select("doc_id", "log_weight", "n_grams", (F.col("rank_key") >= F.lit(self.least)).alias("kept"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The sampled rows of ``docs`` with all columns, by a second reading instead of a shuffle of the texts."""
        return docs.mapInArrow(_keep(self.shared, self.seed, self.least), docs.schema)


def best_cut(rows: list[tuple[float, int]]) -> float:
    """The weight that tells good from bad held-out rows with the least errors, the lowest such; without bad rows, none.

    A good row lost counts as GOOD_WEIGHT bad rows kept.
    """
    rows = sorted(rows)
    good = np.array([q == 1 for _, q in rows], bool)
    if good.all() or not good.any():
        return -np.inf
    errors = GOOD_WEIGHT * np.concatenate([[0], np.cumsum(good)]) + (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    at = int(np.argmin(errors))
    return rows[at][0] if at < len(rows) else np.inf


def importance_resample(docs: DataFrame, labels: DataFrame, seed: int = 17, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, log_weight, n_grams, kept): one row for each document.

    At most ``max_labelled`` labelled rows, the first by hash of the id, are used: half of them, those
    labelled 1, make the target model, the other half sets the cut between good and bad. The raw model
    counts the n-grams of all documents. k is the number of documents whose weight reaches the cut, and the k
    largest of weight plus Gumbel noise are kept; noise is keyed by id and ``seed``. Null and empty texts have
    weight 0. Without good labels all weights are 0, and without labels of both kinds all rows are kept.
    Repeated ids share their noise; rows that tie at the last place are all kept. An empty table gives no rows.
    """
    return Resampler(docs, labels, seed, max_labelled).scores()


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 17, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that importance resampling keeps, with all columns."""
    return Resampler(docs, labels, seed, max_labelled).kept(docs)
