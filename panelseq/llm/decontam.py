"""Benchmark decontamination by spaced seeds.

A document is contaminated by a benchmark item if ``WINDOW`` consecutive words of both agree but for at
most two substitutions. Fixed masks pick six of the words; for any two substituted places in a window one of
the masks fits beside them, so each such window shares a seed hash with the test side. Documents are
scanned once against each bounded block of the benchmark's seeds; hits give diagonals, and
each diagonal is compared word by word. No document is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq.llm.common import U, expand, mix, narrow, row_offsets, slices, text_bytes, word_hashes
from panelseq.session import cut, ship

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Items shorter than a window are compared whole; eight words or more may have one substitution.
SHORT_MASK, SHORT_SUBSTITUTION, MIN_WORDS = (0, 1, 2, 3), 8, 5
SEGMENT_WORDS = 1024
#: Words of benchmark text that are broadcast at a time, eight bytes each and two seeds of sixteen bytes.
BLOCK_WORDS = 1 << 21
FILTER_BITS = 22
PAIRS = 1 << 20
_FACTORS = np.random.default_rng(99).integers(1, 1 << 62, 16, dtype=np.int64).astype(U) * U(2) + U(1)


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words under the mask at each place where it fits."""
    n = max(0, len(words) - mask[-1])
    out = np.full(n, len(mask) * 1000 + mask[-1] * 37 + sum(mask), U)
    for k, o in enumerate(mask):
        out += words[o: o + n] * _FACTORS[k]
    return mix(out)


def _segments(batches):
    """Pieces of each item that overlap so that every window lies in one of them."""
    for b in batches:
        ids, starts, packed = [], [], []
        for part in slices(b, "text"):
            _, _, row, h = word_hashes(*text_bytes(part.column("text")))
            offs = row_offsets(row, part.num_rows)
            for k, item in enumerate(part.column("item_id").to_pylist()):
                w = h[offs[k]: offs[k + 1]]
                if len(w) < MIN_WORDS:
                    continue
                for at in range(0, max(1, len(w) - WINDOW + 1), SEGMENT_WORDS):
                    ids.append(item)
                    starts.append(at)
                    packed.append(w[at: at + SEGMENT_WORDS + WINDOW - 1].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, b.schema.field("item_id").type), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], ["item_id", "at", "words"])


class Index:
    """The seeds of one block of benchmark segments."""

    def __init__(self, items: list, packed: list[bytes]) -> None:
        self.items = items
        parts = [np.frombuffer(p, U) for p in packed]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.size)])
        self.words = np.concatenate([*parts, np.zeros(0, U)])
        self.window = np.minimum(self.size, WINDOW)
        self.allowed = np.where(self.size >= WINDOW, SUBSTITUTIONS, np.where(self.size >= SHORT_SUBSTITUTION, 1, 0))
        segment = np.repeat(np.arange(len(parts)), self.size)
        self.tables = []
        for mask in (*MASKS, SHORT_MASK):
            h = seeds(self.words, mask)
            at = np.arange(len(h))
            short = self.size < WINDOW
            fits = (segment[at] == segment[at + mask[-1]]) & (short[segment[at]] == (mask == SHORT_MASK))
            at = at[fits]
            order = np.argsort(h[fits], kind="stable")
            key, first = np.unique(h[fits][order], return_index=True)
            filled = np.zeros(1 << FILTER_BITS, bool)
            filled[(key >> U(64 - FILTER_BITS)).astype(np.int64)] = True
            if len(key):
                self.tables.append((mask, key, np.append(first, len(at)), at[order], filled))
        self.segment = segment

    def hits(self, words: np.ndarray, row: np.ndarray):
        """(word, benchmark word) for each common seed, in bounded pieces."""
        for mask, key, first, at, filled in self.tables:
            h = seeds(words, mask)
            i = np.flatnonzero(filled[(h >> U(64 - FILTER_BITS)).astype(np.int64)])
            i = i[row[i] == row[i + mask[-1]]]
            k = np.searchsorted(key, h[i])
            k[k == len(key)] = 0
            same = key[k] == h[i]
            i, k = i[same], k[same]
            total = np.cumsum(first[k + 1] - first[k])
            lo = 0
            while lo < len(i):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
                owner, pos = expand(first[k[lo:hi]], first[k[lo:hi] + 1])
                yield i[lo:hi][owner], at[pos]
                lo = hi

    def overlaps(self, words: np.ndarray, row: np.ndarray, row_offs: np.ndarray):
        """(row, segment, windows, least substitutions, first word) of verified diagonals."""
        out, reach = [], SEGMENT_WORDS + WINDOW
        wide = len(words) + 2 * reach
        for i, j in self.hits(words, row):
            seg = self.segment[j]
            out.append(np.unique(np.stack([seg * wide + i - (j - self.offs[seg]) + reach, row[i]], 1), axis=0))
        if not out:
            return None
        pair = np.unique(np.concatenate(out), axis=0)
        seg, diag, r = pair[:, 0] // wide, pair[:, 0] % wide - reach, pair[:, 1]
        lo = np.maximum(diag, row_offs[r])
        hi = np.minimum(diag + self.size[seg], row_offs[r + 1])
        res, total, a = [], np.cumsum(hi - lo), 0
        while a < len(seg):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            owner, pos = expand(lo[a:z], hi[a:z])
            s = seg[a:z][owner]
            same = words[pos] == self.words[pos - diag[a:z][owner] + self.offs[s]]
            c = np.concatenate([[0], np.cumsum(same)])
            w = self.window[s]
            fits = pos + w <= hi[a:z][owner]
            p = np.flatnonzero(fits)
            subs = w[p] - (c[p + w[p]] - c[p])
            ok = subs <= self.allowed[s[p]]
            p, subs = p[ok], subs[ok]
            res.append(np.stack([r[a:z][owner[p]], s[p], subs, pos[p] - row_offs[r[a:z][owner[p]]]], 1))
            a = z
        return np.concatenate(res)


def _scan(shared):
    def run(batches):
        index = shared.value
        items = pa.array(index.items, pa.int64())
        for b in batches:
            for part in slices(b, "text"):
                _, _, row, h = word_hashes(*text_bytes(part.column("text")))
                found = index.overlaps(h, row, row_offsets(row, part.num_rows))
                if found is not None and len(found):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(found[:, 0])), items.take(pa.array(found[:, 1])),
                         pa.array(found[:, 2]), pa.array(found[:, 3])], ["doc_id", "item_id", "subs", "word"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, substitutions, first_word), one row for each document and item that overlap.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A to Z.
    ``n_windows`` counts aligned windows, ``substitutions`` is the least in one of them and
    ``first_word`` the first word of the document in one. Items of fewer than 13 words are compared
    whole: with one substitution from eight words on, else exactly; items under five words say too little
    and match nothing. Null texts count as empty; rows with a null id are left out, as nothing could be
    named; repeated rows add up. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = narrow(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    tests = narrow(benchmark, "item_id", "text").where("item_id is not null").select(F.col("item_id").cast("long"), "text").distinct()
    parts = cut(tests.mapInArrow(_segments, "item_id bigint, at bigint, words binary"))
    total = parts.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    found = None
    for k in range(blocks):
        block = parts.where(F.pmod(F.xxhash64("item_id", "at"), F.lit(blocks)) == k).select("item_id", "words").collect()
        shared = spark.sparkContext.broadcast(Index([r[0] for r in block], [bytes(r[1]) for r in block]))
        one = rows.mapInArrow(_scan(shared), "doc_id bigint, item_id bigint, subs bigint, word bigint")
        one = one.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.min("subs").alias("s"), F.min("word").alias("w"))
        one = cut(one)
        shared.unpersist()
        found = one if found is None else found.union(one)
    return found.groupBy("doc_id", "item_id").agg(
        F.sum("n").alias("n_windows"), F.min("s").alias("substitutions"), F.min("w").alias("first_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all columns; rows with a null id stay."""
    bad = contamination(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(c) for c in docs.columns])
