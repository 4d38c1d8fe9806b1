"""Substring deduplication over sliding runs of sentences.

From every sentence the run of consecutive sentences that has enough words is hashed; runs with equal hashes are joined over all
documents, and the sentences under any but the first of them go. Only hashes and places are shuffled for the
search; texts move once, when what was found is taken out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelseq.llm.common import POWERS, U, mix, narrow, prefix_hash, range_hash, row_offsets, safe_text, slices, text_bytes
from panelseq.session import cut, ship

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each sentence without the white space around it.

    A sentence ends at a newline and after a full stop, exclamation or question mark before white space.
    """
    if len(buf) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    space = SPACE[buf]
    ends = buf == 10
    ends[:-1] |= STOP[buf[:-1]] & space[1:]
    piece = np.zeros(len(buf), np.int64)
    np.cumsum(ends[:-1], out=piece[1:])
    solid = np.flatnonzero(~space)
    row = np.searchsorted(offs, solid, "right") - 1
    new = np.ones(len(solid), bool)
    new[1:] = (piece[solid[1:]] != piece[solid[:-1]]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(solid)) - 1
    return solid[first], solid[last[: len(first)]] + 1, row[first]


def span_ends(buf: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, words: int, least: int) -> np.ndarray:
    """For each sentence the end (exclusive) of the shortest run from it that has enough words and sentences, or -1."""
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[start] = True
    upto = np.append(0, np.cumsum(first))
    total = np.append(0, np.cumsum(upto[end] - upto[start]))
    n = len(start)
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), np.arange(n) + least)
    inside = ends <= n
    inside[inside] = row[np.flatnonzero(inside)] == row[ends[inside] - 1]
    return np.where(inside, ends, -1)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first sentence of each span."""
    ends = span_ends(buf, start, end, row, words, least)
    at = np.flatnonzero(ends >= 0)
    h = range_hash(prefix_hash(buf), start, end)
    up, down = POWERS.upto(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[ends[at]] - sums[at]) * down[at] + (ends[at] - at).astype(U)).view(np.int64), at


def _spans(words: int, least: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                buf, offs = text_bytes(part.column("text"))
                start, end, row = sentences(buf, offs)
                h, at = span_hashes(buf, start, end, row, words, least)
                place = at - row_offsets(row, part.num_rows)[row[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), *[part.column(c).take(pa.array(row[at])) for c in ("doc", "dup")], pa.array(place.astype(np.int32))], ["h", "doc", "dup", "place"])

    return run


def _take_out(words: int, least: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                buf, offs = text_bytes(part.column("text"))
                data = buf.tobytes()
                start, end, row = sentences(buf, offs)
                own = row_offsets(row, part.num_rows)
                ends = span_ends(buf, start, end, row, words, least)
                texts, counts, removed, digests = [], [], [], []
                for k, places in enumerate(part.column("places").to_pylist()):
                    lo, hi = int(own[k]), int(own[k + 1])
                    gone = np.zeros(hi - lo, bool)
                    for p in places or ():
                        gone[p: ends[lo + p] - lo] = True
                    left = (np.flatnonzero(~gone) + lo).tolist()
                    digests.append(hashlib.sha256(b"\n".join([data[start[s]: end[s]] for s in left])).hexdigest())
                    text = data[offs[k]: offs[k + 1]]
                    if gone.any():
                        # A sentence goes with the white space after it, the last one with that before it too.
                        edge = [0, *(start[lo + 1: hi] - offs[k]).tolist(), len(text)]
                        text = b"".join(text[edge[s - lo]: edge[s - lo + 1]] for s in left)
                    texts.append(text.decode("utf-8", "replace"))
                    counts.append(hi - lo)
                    removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                    ["doc_id", "text", "n_sentences", "n_removed", "kept_sha256"])

    return run


def sentence_dedup(docs: DataFrame, words: int = 20, least: int = 1) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, kept_sha256), one row for each document.

    A span is the shortest run of sentences from a given one that has ``words`` words (runs of other bytes than ASCII white space)
    and ``least`` sentences; equal passages have equal spans however they are cut before and after. ``text`` is what stays; ``kept_sha256``
    is the digest of the remaining sentences, trimmed and joined by newlines. The first of equal spans, by doc_id and place, stays, a
    null id counting as the largest; a span may repeat inside its own document. Texts of fewer words stay whole, null texts
    count as empty. Long texts are cut at any number of places; a sentence of any length is one. Different texts of one id are told apart and ordered by hash; repeated rows
    of one id and text count as one document, so both stay alike. Other columns are left out. An empty table gives no rows. Ids have to be integers, or null.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = narrow(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), safe_text().alias("text"))
    texts = rows.select("doc", F.xxhash64("text").alias("text_hash")).distinct()
    if texts.groupBy("doc").count().where("count > 1").limit(1).count():
        names = cut(texts.withColumn("dup", F.row_number().over(Window.partitionBy("doc").orderBy("text_hash")) - 1))
        rows = rows.withColumn("text_hash", F.xxhash64("text")).join(names, ["doc", "text_hash"]).drop("text_hash")
    else:
        rows = rows.withColumn("dup", F.lit(0))
    spans = rows.select("doc", "dup", "text").mapInArrow(_spans(words, least), "h bigint, doc bigint, dup int, place int")
    at = F.struct("doc", "dup", "place")
    # Written, so that the join has two plain exchanges and a very common span can be dealt to many tasks.
    first = cut(spans.groupBy("h").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").drop("n"))
    again = spans.join(first, "h").where(at != F.col("first"))
    places = cut(again.groupBy("doc", "dup").agg(F.sort_array(F.collect_set("place")).alias("places")))
    joined = rows.join(places, ["doc", "dup"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_take_out(words, least), "doc_id bigint, text string, n_sentences bigint, n_removed bigint, kept_sha256 string")
