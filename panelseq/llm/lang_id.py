"""Language identification by string kernels: one-versus-rest kernel ridge regression on Nyström landmarks.

The kernel of two texts is the number of n-grams of one to three bytes that both have (presence, not counts), over the root of the product of
their numbers of n-grams; n-grams count that occur in a landmark. With ``m`` landmarks L the ridge solution in
their span is ``k(x, L) @ a`` with ``a = (K_nm' K_nm + ridge K_mm)^-1 K_nm' Y``. As the kernel is an inner product of presence vectors,
``k(x, L) @ a`` is one product of a batch of presence vectors with a matrix (n-grams x langs), which is what is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelseq.llm.common import LOWER, narrow, slices, text_bytes
from panelseq.session import ship

UNKNOWN = "und"
#: Rows that a matrix product takes at a time.
BATCH = 256
#: Letters A to Z without case, bytes of other characters, and one symbol for everything between words.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
BASE = 155
#: Codes of one, two and three symbols lie one after the other.
SPACE = BASE + BASE**2 + BASE**3


@dataclass(frozen=True)
class Model:
    """Learned langs in order, the codes of the n-grams, weights (n-grams x langs) and the most frequent lang."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    usual: int


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all places of all n-grams; what is between words counts as one symbol, also before and after the text."""
    n = len(offs) - 1
    body = np.zeros(len(buf) + n + 1, np.int64)
    row_of = np.repeat(np.arange(n), np.diff(offs))
    at = np.arange(len(buf)) + row_of + 1
    body[at] = SYMBOL[LOWER[buf]]
    rows = np.repeat(np.arange(n + 1), np.append(np.diff(offs) + 1, 1))
    keep = np.ones(len(body), bool)
    keep[1:] = (body[1:] != 0) | (body[:-1] != 0) | (rows[1:] != rows[:-1])
    s, r = body[keep], rows[keep]
    found_rows, found = [r[s > 0]], [s[s > 0]]
    code, lead = s, BASE
    # No n-gram goes over the gap between a row that ends outside a word and the next one.
    gap = np.append((s[1:] == 0) & (s[:-1] == 0), True)
    for k in (1, 2):
        code = code[:-1] * BASE + s[k:]
        # The symbol that opens the next row closes this one, so an n-gram may end on it but not go beyond it.
        inside = (r[k - 1: -1] == r[: -k]) & ((r[k:] == r[:-k]) | (s[k:] == 0)) & ~gap[:-k] & ~gap[k - 1: -1]
        found_rows.append(r[:-k][inside])
        found.append(code[inside] + lead)
        lead += BASE ** (k + 1)
    rows, codes = np.concatenate(found_rows), np.concatenate(found)
    real = rows < n
    return rows[real], codes[real]


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = LOWER[buf]
    ascii_letter = np.append(0, np.cumsum((low >= 97) & (low <= 122)))
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[k] = any(c.isalpha() for c in buf[offs[k]: offs[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def presence(rows: np.ndarray, columns: np.ndarray, n: int, width: int) -> np.ndarray:
    p = np.zeros((n, width), np.float32)
    known = columns >= 0
    p[rows[known], columns[known]] = 1
    return p


def _codes(batches) -> Iterator[pa.RecordBatch]:
    """(lang, rank, codes): the distinct n-grams of each text that has a letter, as one binary value."""
    for b in batches:
        for part in slices(b, "text"):
            buf, offs = text_bytes(part.column("text"))
            rows, codes = ngrams(buf, offs)
            pairs = np.unique(rows * SPACE + codes)
            ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * SPACE)
            distinct = (pairs % SPACE).astype(np.int32)
            keep = np.flatnonzero(has_letter(buf, offs))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(pa.array(keep)) for c in ("lang", "rank")], pa.array([distinct[ends[k]: ends[k + 1]].tobytes() for k in keep], pa.binary())],
                ["lang", "rank", "codes"])


def fit(rows: DataFrame, max_rows: int = 4096, max_landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """Learn from ``text`` and ``lang`` of at most ``max_rows`` rows, as many of each lang as there are, chosen by a hash of the text.

    Rows without a lang or a letter teach nothing. Langs beyond ``max_rows`` in order of frequency are not
    learned. What comes to the driver are the distinct n-grams of the chosen rows, so it does not grow with the table.
    """
    ship(rows.sparkSession)
    rows = narrow(rows, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not counts:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), 0)
    quota = max(1, max_rows // len(counts))
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * quota + 32) / r["count"])) for r in counts], "known string, share double")
    ranked = rows.withColumn("rank", F.xxhash64("text", "lang"))
    drawn = ranked.join(F.broadcast(share), F.col("lang") == F.col("known")).where((F.col("rank") / 2.0**64 + 0.5) < F.col("share"))
    # Equal texts have one rank; they teach nothing new, so one of them is enough.
    chosen = drawn.select("lang", "rank", "text").dropDuplicates(["lang", "rank"]).mapInArrow(_codes, "lang string, rank bigint, codes binary")
    first = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("k") <= quota)
    sample = sorted(first.select("lang", "k", "codes").collect(), key=lambda r: (r["lang"], r["k"]))
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), 0)
    each = max(1, max_landmarks // len(langs))
    sets = [np.frombuffer(r["codes"], np.int32) for r in sample]
    marks = [s for s, r in zip(sets, sample, strict=True) if r["k"] <= each]
    vocabulary = np.unique(np.concatenate(marks)).astype(np.int64)
    target = np.array([[float(r["lang"] == x) for x in langs] for r in sample])
    weights = solve(sets, marks, vocabulary, target, ridge)
    frequency = {r["lang"]: r["count"] for r in counts}
    return Model(langs, vocabulary, weights.astype(np.float32), max(range(len(langs)), key=lambda k: frequency[langs[k]]))


def _matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    codes = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    return presence(rows, np.where(vocabulary[at] == codes, at, -1), len(sets), len(vocabulary))


def _unit(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(np.maximum(1, p.sum(1)))[:, None]


def solve(sets: list[np.ndarray], marks: list[np.ndarray], vocabulary: np.ndarray, target: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (n-grams x langs) of the ridge solution in the span of the landmarks."""
    landmark = _unit(_matrix(marks, vocabulary)).astype(np.float64)
    m = len(marks)
    gram, right = np.zeros((m, m)), np.zeros((m, target.shape[1]))
    for lo in range(0, len(sets), BATCH):
        k = _unit(_matrix(sets[lo: lo + BATCH], vocabulary)) @ landmark.T
        gram += k.T @ k
        right += k.T @ target[lo: lo + BATCH]
    inner = landmark @ landmark.T
    system = gram + ridge * len(sets) * inner + 1e-9 * len(sets) * np.eye(m)
    return landmark.T @ np.linalg.solve(system, right)


def _predict(model):
    def run(batches):
        m = model.value
        table = np.full(SPACE, -1, np.int32)
        table[m.codes] = np.arange(len(m.codes))
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        for b in batches:
            for part in slices(b, "text"):
                for lo in range(0, part.num_rows, BATCH):
                    piece = part.slice(lo, BATCH)
                    buf, offs = text_bytes(piece.column("text"))
                    letters = has_letter(buf, offs)
                    n = piece.num_rows
                    best, score = np.full(n, len(m.langs)), np.zeros(n)
                    if m.langs:
                        rows, codes = ngrams(buf, offs)
                        p = presence(rows, table[codes], n, len(m.codes))
                        size = p.sum(1)
                        scores = (p @ m.weights) / np.sqrt(np.maximum(1, size))[:, None]
                        best = np.where(size > 0, scores.argmax(1), m.usual)
                        score = np.clip(scores.max(1).astype(np.float64), 0, 1)
                        best[~letters], score[~letters] = len(m.langs), 0
                    own = [c for c in piece.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays(
                        [*[piece.column(c) for c in own], pa.array(names[best].tolist(), pa.string()), pa.array(score)], [*own, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (0 to 1), one row for each row of ``docs``.

    Only ``text`` is read, whole. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if nothing was learned. A text without any n-gram of the landmarks gets the most frequent lang with score 0. Equal scores go to
    the first lang. Repeated rows give repeated results; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = narrow(docs, *keep, "text")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), ", ".join(filter(None, [fields, "lang_pred string, score double"])))


def fold(id_: Column, folds: int = 3) -> Column:
    """A fold from the CRC-32 of the id as text; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % folds


def language_report(docs: DataFrame, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the folds other than ``held`` and told for every document.

    A document with a null id is neither held out nor learned from.
    """
    rows = narrow(docs, "doc_id", "text", "lang")
    model = fit(rows.where(fold(F.col("doc_id")) != held))
    marked = rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, "doc_id", "held_out")
