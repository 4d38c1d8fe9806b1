"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte under a string of ``WINDOW`` bytes that also starts in a document with a smaller id goes.

1. Dealing. Each window has an anchor, the least hash of the short strings in it. Equal windows have equal
   anchors, so windows are dealt out by anchor. Neighbouring windows with one anchor form a fragment. A
   fragment travels as two hashes and its place, ten bytes and the place, in packed arrays. A fragment that occurs whole in an
   earlier document is settled. An anchor with different fragments in several documents needs their bytes.
2. Merging. Fragments of an anchor meet in one task, in batches of bounded size. A batch is two shards; each
   has its suffix order and transform, and the two are merged by refining the interleave once for each
   symbol of depth: the order after k rounds is that of the first k symbols. The round in which a boundary appears
   gives the common prefix of two neighbours, and what is not divided after WINDOW rounds is a repeated interval.
3. Taking out. Covered windows come back to their documents by id, and their bytes go. Before a shuffle of texts a bit
   table of fixed size leaves out most documents that nothing was found for; once it is full, they travel too.

An anchor with over HOT_FRAGMENTS different fragments is not gathered. Hashes of what stands around the anchor are dealt
for its fragments; of the windows, those whose surroundings all meet another document are dealt by their own hash.
Both travel packed by bucket, as fragments do. What a unit can answer itself stays there, so a hash has few entries a unit.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from panelseq.llm.common import POWERS, U, expand, mix, narrow, prefix_hash, range_hash, row_offsets, safe_text, shuffle_partitions, slices, text_bytes, tidy
from panelseq.session import cut, ship

WINDOW, GRAM = 50, 20
#: A common window reaches WINDOW - GRAM bytes beyond its anchor on both sides together. In steps of SIDE_STEP that is
#: at least SIDES, for what is lost to the steps.
SIDE_STEP = 5
SIDES = -(-(WINDOW - GRAM - 2 * (SIDE_STEP - 1)) // SIDE_STEP) * SIDE_STEP
#: Text bytes that a task works on at a time.
SLICE_BYTES = 1 << 18
#: Text bytes that one task packs together; text bytes whose fragments make a bucket; fragments of one merge.
UNIT_BYTES, BUCKET_BYTES, BATCH_ROWS = 2 << 20, 4 << 20, 1 << 13
HOT_FRAGMENTS = 4096
#: Hashes of hot fragments that a task packs together; bytes of one in a packed row, about.
UNIT_KEYS, KEY_BYTES = 1 << 18, 22
#: Different fragments of an anchor in one unit from which they are spread over all buckets.
SPREAD_FRAGMENTS = 64
#: Bytes of an Arrow batch.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
DUP_SHIFT = 28
#: No byte of UTF-8 text has this value; it ends a fragment.
END = 255
LAST_ID = 2**63 - 1
COVERED, NEEDED, HOT = 0, 1, 2
#: Bits of a place that say which window or surrounding of a fragment is meant.
PART_BITS = 5
#: For a window with that many bytes left of its anchor: the surroundings inside it, a bit for each.
INSIDE = np.array([sum(1 << i for i in range(SIDES // SIDE_STEP + 1) if left - (WINDOW - GRAM - SIDES) <= i * SIDE_STEP <= left)
                   for left in range(WINDOW - GRAM + 1)], np.int64)
#: Bits, as a power of two, of the table of ids that lets texts stay where they are: eight megabytes.
ID_BITS = 26


def anchors(buf: np.ndarray, offs: np.ndarray):
    """First and last window, row, anchor hash, content hash and anchor place of each fragment, in order."""
    n, w = len(buf), WINDOW - GRAM + 1
    if n < WINDOW:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U), e.astype(U), e
    prefix = prefix_hash(buf)
    _, down = POWERS.upto(n + 1)
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    # The place in the low bits makes the leftmost of equal hashes the least.
    low = U((1 << max(24, n.bit_length())) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U)
    blocks = np.concatenate([key, np.full(-len(key) % w, ~U(0))]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = n - WINDOW + 1
    least = np.minimum(tail[:m], head[w - 1: w - 1 + m]) & low
    fits = np.zeros(n + 1, np.int8)
    sizes = np.diff(offs)
    long = sizes >= WINDOW
    fits[offs[:-1][long]] += 1
    np.add.at(fits, offs[1:][long] - WINDOW + 1, -1)
    p = np.flatnonzero(np.cumsum(fits[:m]))
    q = least[p].astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = p[first], p[np.append(first[1:], len(p)) - 1]
    return lo, hi, np.searchsorted(offs, lo, "right") - 1, h[q[first]], range_hash(prefix, lo, hi + WINDOW), q[first]


def _low_bytes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _from_bytes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data.reshape(n, width)
    return out.view("<u8").ravel()


def _width(top: int) -> int:
    return next(w for w in (2, 3, 4, 8) if top < 1 << (8 * w) or w == 8)


_PACKED = "bucket bigint, base bigint, n int, wd int, wk int, payload binary"
_PACKED_NAMES = ("bucket", "base", "n", "wd", "wk", "payload")


def _pack(bucket, h, f, doc, k, wide=(5, 5)):
    """One packed row for each bucket; ``bucket`` is ascending, ``wide`` are the bytes kept of h and f."""
    rows = [[] for _ in _PACKED_NAMES]
    if len(bucket) == 0:
        return
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    base = int(doc.min())
    wd, wk = _width(int(doc.max()) - base), _width(int(k.max()))
    hb, fb, db, kb = (_low_bytes(x, w) for x, w in ((h, wide[0]), (f, wide[1]), (doc - base, wd), (k, wk)))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        payload = b"".join(x[lo:hi].tobytes() for x in (hb, fb, db, kb))
        for column, value in zip(rows, (int(bucket[lo]), base, hi - lo, wd, wk, payload), strict=True):
            column.append(value)
        if len(rows[0]) >= 256:
            yield _packed_batch(rows)
            rows = [[] for _ in _PACKED_NAMES]
    if rows[0]:
        yield _packed_batch(rows)


def _packed_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], list(_PACKED_NAMES))


def _unpack(row, wide=(5, 5)) -> tuple[np.ndarray, ...]:
    n, widths, data = row["n"], (*wide, row["wd"], row["wk"]), np.frombuffer(row["payload"], np.uint8)
    at = np.cumsum([0, *(w * n for w in widths)])
    h, f, d, k = (_from_bytes(data[a:z], n, w) for a, z, w in zip(at[:-1], at[1:], widths, strict=True))
    return h, f, d.astype(np.int64) + row["base"], k.astype(np.int64)


def _rows(batch):
    """The packed rows of a batch; payloads are not copied."""
    rest = batch.select([c for c in _PACKED_NAMES if c != "payload"]).to_pylist()
    for row, payload in zip(rest, batch.column("payload"), strict=True):
        yield row | {"payload": payload.as_buffer()}


def _buckets(batches, wide=(5, 5), asked: bool = True):
    """Bucket and arrays of each bucket; rows come by bucket. Where something is asked, buckets below zero are answers and come as they are, without a bucket."""
    bucket, parts = None, []
    for b in batches:
        if asked:
            asks = b.column("bucket").to_numpy() >= 0
            if not asks.all():
                yield None, b.filter(pa.array(~asks))
            b = b.filter(pa.array(asks))
        for row in _rows(b):
            if row["bucket"] != bucket and parts:
                whole, parts = [np.concatenate(x) for x in zip(*parts, strict=True)], []
                yield bucket, whole
            bucket = row["bucket"]
            parts.append(_unpack(row, wide))
    if parts:
        whole, parts = [np.concatenate(x) for x in zip(*parts, strict=True)], []
        yield bucket, whole


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _flush(unit, bits: int, most: int):
    """The fragments of a unit: those settled inside it to buckets below zero, one row a fragment for the rest."""
    h, f, doc, k = (np.concatenate(x) for x in zip(*unit, strict=True))
    order = np.lexsort((doc, f, h))
    h, f, doc, k = h[order], f[order], doc[order], k[order]
    new = _groups(h, f)
    first = doc[new][np.cumsum(new) - 1]
    again = doc > first
    if again.any():
        yield from _answers(bits, doc[again], (k[again] << PART_BITS) + COVERED)
    h, f, doc, k = h[~again], f[~again], doc[~again], k[~again]
    head = _groups(h)
    group = np.cumsum(head) - 1
    spread = (np.bincount(group, weights=_groups(h, f)) > most)[group]
    shift = U(64 - bits)
    low = lambda x: (x << U(bits)) >> U(24)
    one = ~spread
    yield from _pack((h[one] >> shift).astype(np.int64), low(h[one]), f[one] >> U(24), doc[one], k[one])
    if spread.any():
        # What is spread keeps its own buckets above the others, and leaves a mark in the anchor's.
        far = mix(h[spread] ^ f[spread]) >> shift
        order = np.argsort(far, kind="stable")
        yield from _pack((far[order] + U(1 << bits)).astype(np.int64), low(h[spread])[order], (f[spread] >> U(24))[order], doc[spread][order], k[spread][order])
        mark = np.flatnonzero(spread & head)
        yield from _pack((h[mark] >> shift).astype(np.int64), low(h[mark]), np.full(len(mark), (1 << 40) - 1, U), np.full(len(mark), LAST_ID), np.zeros(len(mark), np.int64))


def _deal(bits: int, most: int):
    def run(batches):
        unit, size = [], 0
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                buf, offs = text_bytes(part.column("text"))
                lo, _, row, h, f, _ = anchors(buf, offs)
                if not len(lo):
                    continue
                k = np.arange(len(lo)) - row_offsets(row, part.num_rows)[row]
                dup = part.column("dup").to_numpy().astype(np.int64)
                unit.append((h, f, part.column("doc").to_numpy()[row], k + (dup[row] << DUP_SHIFT)))
                size += len(buf)
                if size >= UNIT_BYTES:
                    yield from _flush(unit, bits, most)
                    unit, size = [], 0
        if unit:
            yield from _flush(unit, bits, most)

    return run


def _meet(h, f, doc, k, spread: bool, most: int):
    """What is settled and what needs its bytes in one bucket."""
    order = np.lexsort((doc, f, h))
    h, f, doc, k = h[order], f[order], doc[order], k[order]
    both, head = _groups(h, f), _groups(h)
    first = doc[both][np.cumsum(both) - 1]
    again = doc > first
    marked = np.zeros(len(doc), bool) if spread else (f == U((1 << 40) - 1)) & (k == 0) & (doc == LAST_ID)
    group = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))[group]
    count = np.bincount(group, weights=both)[group]
    hot = np.full(len(doc), spread) | np.logical_or.reduceat(marked, at)[group] | (count > most)
    need = ~again & ((several & (count > 1)) | hot)
    kind = np.where(again, COVERED, np.where(hot, HOT, NEEDED))
    out = (again | need) & ~marked
    return doc[out], (k[out] << PART_BITS) + kind[out]


def _gathered(bits: int, found):
    """Answers of many buckets packed together, as many as UNIT_KEYS; packed ones pass."""
    told, size = [], 0
    for x in found:
        if isinstance(x, pa.RecordBatch):
            yield x
            continue
        told.append(x)
        size += len(x[0])
        if size >= UNIT_KEYS:
            yield from _answers(bits, *(np.concatenate(c) for c in zip(*told, strict=True)))
            told, size = [], 0
    if told:
        yield from _answers(bits, *(np.concatenate(c) for c in zip(*told, strict=True)))


def _settle(bits: int, most: int):
    def run(batches):
        yield from _gathered(bits, (found if bucket is None else _meet(*found, bucket >= 1 << bits, most) for bucket, found in _buckets(batches)))

    return run


def _slot(c: str = "doc") -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS)).cast("int").alias("slot")


def _id_table(ids: DataFrame) -> np.ndarray:
    """A bit for each id's slot: of fixed size, whatever the number of ids."""
    words = ids.select(_slot()).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
    table = np.zeros(1 << (ID_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def _has_slot(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    slot = batch.column("slot").to_numpy()
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def _packed_texts(shared):
    """Rows whose id may be in the table, with the text compressed for the shuffle; the rest do not travel."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            names = [c for c in b.schema.names if c not in ("slot", "text")]
            for part in slices(b, "text", 4 * SLICE_BYTES):
                part = part.filter(pa.array(_has_slot(part, shared.value)))
                z = [press.compress(x) for x in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(z, pa.binary())], [*names, "z"])

    return run


def _opened(batches, limit: int = SLICE_BYTES // 3):
    """Slices of bounded size with the text in place of its compressed form."""
    press = zstandard.ZstdDecompressor()
    for b in batches:
        names = [c for c in b.schema.names if c != "z"]
        for part in slices(b, "z", limit):
            text = pa.array([press.decompress(x) for x in part.column("z").to_pylist()], pa.binary())
            whole = pa.RecordBatch.from_arrays([*[part.column(c) for c in names], text], [*names, "text"])
            yield from slices(whole, "text", SLICE_BYTES)


def _chosen(part: pa.RecordBatch, column: str):
    """Bytes, window ranges, anchors and row of the fragments that ``column`` lists for each row."""
    buf, offs = text_bytes(part.column("text"))
    lo, hi, row, h, _, q = anchors(buf, offs)
    own = row_offsets(row, part.num_rows)
    lists = part.column(column)
    r = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
    flat = lists.flatten()
    k = (flat.field("k") if pa.types.is_struct(flat.type) else flat).to_numpy()
    return buf, lo, hi, h, q, own[r] + k, r, k


def _fragments(batches):
    for part in _opened(batches):
        buf, lo, hi, h, q, at, r, k = _chosen(part, "need")
        data = buf.tobytes()
        frags = [data[a: z + WINDOW] for a, z in zip(lo[at].tolist(), hi[at].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[at].view(np.int64)), pa.array((q[at] - lo[at]).astype(np.int8)), pa.array(frags, pa.binary()),
             part.column("doc").take(pa.array(r)), pa.array(_place(part, r, k))],
            ["h", "anchor", "fragment", "doc", "k"])


def _place(part, r, k):
    return k + (part.column("dup").to_numpy().astype(np.int64)[r] << DUP_SHIFT)


def _arounds(part):
    """Hashes of GRAM + SIDES bytes about the anchors of hot fragments; fragments of a common window have one in common."""
    buf, lo, hi, _, q, at, r, k = _chosen(part, "hot")
    prefix, q, left_end, right_end = prefix_hash(buf), q[at], lo[at], hi[at] + WINDOW
    keys, which, bit = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, left in enumerate(range(0, SIDES + 1, SIDE_STEP)):
        fits = np.flatnonzero((q - left >= left_end) & (q + GRAM + SIDES - left <= right_end))
        p = q[fits] - left
        keys.append(mix(range_hash(prefix, p, p + GRAM + SIDES) + U(left)))
        which.append(fits)
        bit.append(np.full(len(fits), i))
    key, which = np.concatenate(keys), np.concatenate(which)
    return key, np.zeros(len(key), U), part.column("doc").to_numpy()[r[which]], (_place(part, r, k)[which] << PART_BITS) + np.concatenate(bit)


def _windows(part):
    """Two hashes of each window of hot fragments whose surroundings have all met another document."""
    buf, lo, hi, _, q, at, r, k = _chosen(part, "hot")
    met = part.column("hot").flatten().field("mask").to_numpy()
    which, p = expand(lo[at], hi[at] + 1)
    inside = INSIDE[q[at][which] - p]
    keep = met[which] & inside == inside
    which, p = which[keep], p[keep]
    one, two = prefix_hash(buf), prefix_hash(buf ^ np.uint8(0x5A))
    return (range_hash(one, p, p + WINDOW), range_hash(two, p, p + WINDOW), part.column("doc").to_numpy()[r[which]],
            (_place(part, r, k)[which] << PART_BITS) + p - lo[at][which])


def _answered(one, two, doc, k, later: bool):
    """Hashes in order, with which of them have an answer here: a smaller document, or just another one, has the same hash."""
    order = np.lexsort((doc, two, one))
    one, two, doc, k = one[order], two[order], doc[order], k[order]
    new = _groups(one, two)
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first, last = doc[at][group], doc[np.append(at[1:], len(doc)) - 1][group]
    return one, two, doc, k, new, (doc > first) if later else (first < last)


def _answers(bits: int, doc, k):
    """Parts of a place as a mask; packed by document, in buckets below zero."""
    if len(doc) == 0:
        return
    bucket = -1 - (mix(doc.astype(U)) >> U(64 - bits)).astype(np.int64)
    order = np.lexsort((k, doc, bucket))
    bucket, doc, k = bucket[order], doc[order], k[order]
    at = np.flatnonzero(_groups(doc, k >> PART_BITS))
    mask = np.bitwise_or.reduceat(U(1) << (k & ((1 << PART_BITS) - 1)).astype(U), at)
    yield from _pack(bucket[at], mask, mask, doc[at], k[at] >> PART_BITS, (4, 0))


def _ask(keys, bits: int, wide: tuple[int, int], later: bool):
    """Hashes of hot fragments dealt by bucket, one row a bucket and unit. What is answered in the unit does not ask any more."""

    def flush(unit):
        one, two, doc, k, new, done = _answered(*(np.concatenate(x) for x in zip(*unit, strict=True)), later)
        yield from _answers(bits, doc[done], k[done])
        # Two of an answered hash tell other units of the documents here: the first and, where any other counts, the last.
        go = ~done if later else ~done | new | np.append(new[1:], True)
        yield from _pack((one[go] >> U(64 - bits)).astype(np.int64), one[go], two[go], doc[go], k[go], wide)

    def run(batches):
        unit, size = [], 0
        for part in _opened(batches):
            found = keys(part)
            if len(found[0]):
                unit.append(found)
                size += len(found[0])
            if size >= UNIT_KEYS:
                yield from flush(unit)
                unit, size = [], 0
        if unit:
            yield from flush(unit)

    return run


def _tell(bits: int, wide: tuple[int, int], later: bool):
    """Answers of buckets that come in order; those already given pass."""

    def meet(found):
        _, _, doc, k, _, done = _answered(*found, later)
        return doc[done], k[done]

    def run(batches):
        yield from _gathered(bits, (found if bucket is None else meet(found) for bucket, found in _buckets(batches, wide)))

    return run


def _by_document(batches):
    """Document, text, first row of each, place and mask, for each bucket of answers. All answers of a document come in one bucket."""
    for _, (mask, _, doc, k) in _buckets(batches, (4, 0), asked=False):
        order = np.lexsort((k, doc))
        mask, doc, k = mask[order], doc[order], k[order]
        at = np.flatnonzero(_groups(doc, k))
        mask, doc, k = np.bitwise_or.reduceat(mask, at), doc[at], k[at]
        dup, k = k >> DUP_SHIFT, k & ((1 << DUP_SHIFT) - 1)
        at = np.flatnonzero(_groups(doc, dup))
        yield pa.array(doc[at]), pa.array(dup[at], pa.int32()), np.append(at, len(k)), k, mask.astype(np.int64)


def _listed(batches):
    """One row a document and text: its places with their masks."""
    for doc, dup, edge, k, mask in _by_document(batches):
        places = pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(mask)], ["k", "mask"])
        yield pa.RecordBatch.from_arrays([doc, dup, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), places)], ["doc", "dup", "masks"])


def _kinds(batches):
    """One row a document and text: the places that are covered, that need their bytes, and that are hot."""
    for doc, dup, edge, k, mask in _by_document(batches):
        lists = []
        for kind in (COVERED, NEEDED, HOT):
            is_kind = (mask >> kind) & 1 == 1
            before = np.concatenate([[0], np.cumsum(is_kind)])
            lists.append(pa.ListArray.from_arrays(pa.array(before[edge], pa.int32()), pa.array(k[is_kind], pa.int32())))
        yield pa.RecordBatch.from_arrays([doc, dup, *lists], ["doc", "dup", "covered", "need", "hot"])


def shard_order(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Rotations of ``text`` in the order of their first ``depth`` symbols, by doubling."""
    n = len(text)
    rank = np.zeros(n, U)
    for k in range(7):
        rank |= np.roll(text, -k).astype(U) << U(8 * (6 - k))
    known = 7
    while True:
        order = np.argsort(rank)
        if known >= depth:
            return order
        new = np.ones(n, U)
        new[0] = 0
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        dense = np.empty(n, U)
        dense[order] = np.cumsum(new, dtype=U)
        rank = (dense << U(32)) | np.roll(dense, -known)
        known *= 2


def merge_transforms(first: np.ndarray, second: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(from_second, lcp) of two merged transforms.

    ``from_second`` says for each place of the merged order which shard's next rotation stands there;
    ``lcp`` is the common prefix with the place before, ``depth`` meaning at least that. Round k looks at each place
    in the present order, takes the symbol before its rotation, and deals the places by it, keeping their order.
    """
    n, bwt = len(first) + len(second), np.concatenate([first, second])
    side = np.zeros(n, bool)
    side[len(first):] = True
    block, parted, new = np.zeros(n, np.int32), np.zeros(n, np.int16), np.zeros(n, bool)
    base = np.arange(n, dtype=np.int32)
    for _ in range(depth):
        ones = np.cumsum(side, dtype=np.int32)
        symbol = bwt[np.where(side, len(first) - 1 + ones, base - ones)]
        order = np.argsort(symbol, kind="stable")
        side, symbol, block = side[order], symbol[order], block[order]
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        # A boundary stays once it is there, so its rounds give the common prefix.
        parted += new
        block = np.cumsum(new, dtype=np.int32)
    lcp = depth - parted
    lcp[:1] = 0
    return side, lcp


def repeated_intervals(fragments: list[bytes], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragment, window and interval of each whole window; equal windows share an interval."""
    half = max(1, len(fragments) // 2)
    end, orders, sides = bytes([END]), [], []
    texts = [np.frombuffer(end.join(x) + end, np.uint8) for x in (fragments[:half], fragments[half:]) if x]
    for t in texts:
        order = shard_order(t, depth)
        orders.append(order)
        sides.append(t[order - 1])
    if len(texts) == 1:
        sides.append(np.zeros(0, np.uint8))
        orders.append(np.zeros(0, np.int64))
    second, lcp = merge_transforms(*sides, depth)
    place = np.empty(len(second), np.int64)
    place[~second], place[second] = orders[0], orders[1] + len(texts[0])
    interval = np.cumsum(lcp < depth)
    size = np.array([len(x) + 1 for x in fragments])
    start = np.cumsum(size) - size
    of = np.searchsorted(start, place, "right") - 1
    j = place - start[of]
    whole = j + depth < size[of]
    return of[whole], j[whole], interval[whole]


def _covered(fragments, doc, k):
    of, j, interval = repeated_intervals(fragments)
    least = np.full(int(interval.max()) + 1 if len(interval) else 0, LAST_ID)
    np.minimum.at(least, interval, doc[of])
    hit = doc[of] > least[interval]
    mask = np.zeros(len(fragments), np.int64)
    np.bitwise_or.at(mask, of[hit], np.int64(1) << j[hit])
    found = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(k[found]), pa.array(mask[found])], ["doc", "k", "mask"])


def _shared(h: np.ndarray, anchor: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which fragments have enough beside their anchor in common with another one to share a window."""
    prefix, q = prefix_hash(buf), offs[:-1] + anchor
    right = offs[1:] - q - GRAM
    keep = np.zeros(len(h), bool)
    for left in range(0, SIDES + 1, SIDE_STEP):
        fits = np.flatnonzero((anchor >= left) & (right >= SIDES - left))
        p = q[fits]
        around = range_hash(prefix, p - left, p + GRAM + SIDES - left)
        _, at, count = np.unique(around, return_inverse=True, return_counts=True)
        keep[fits] |= count[at] > 1
    return keep


def _merge(batches):
    """Rows come by anchor; whole anchors are gathered to batches of about BATCH_ROWS.

    Fragments that cannot share a window with another one of the batch stay out.
    """
    open_rows: list[pa.RecordBatch] = []
    size = 0

    def work(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        buf, offs = text_bytes(t.column("fragment").chunk(0))
        t = t.filter(pa.array(_shared(t.column("h").to_numpy(), t.column("anchor").to_numpy(), buf, offs)))
        if t.num_rows:
            yield _covered(t.column("fragment").to_pylist(), t.column("doc").to_numpy(), t.column("k").to_numpy())

    for b in batches:
        h = b.column("h").to_numpy()
        lo = 0
        for at in np.flatnonzero(_groups(h)).tolist() if len(h) else []:
            if at == 0 and open_rows and open_rows[-1].column("h")[-1].as_py() == h[0]:
                continue
            part = b.slice(lo, at - lo)
            if size + at - lo >= BATCH_ROWS and (open_rows or at > lo):
                yield from work([*open_rows, part])
                open_rows, size, lo = [], 0, at
        if len(h) > lo:
            open_rows.append(b.slice(lo))
            size += len(h) - lo
    if open_rows:
        yield from work(open_rows)


def _ids(docs: DataFrame) -> DataFrame:
    """All columns as c0, c1, ... with doc, text, sha and n_bytes beside them."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    rows = rows.withColumn("doc", F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(LAST_ID)))
    text = safe_text(names["text"])
    return rows.withColumn("sha", F.sha2(F.encode(text, "UTF-8"), 256)).withColumn("n_bytes", F.octet_length(text).cast("long"))


@contextmanager
def _small_batches(spark: SparkSession):
    """Packed rows go to the Python workers in batches of BATCH_BYTES: by Spark's default a batch may be a whole partition of them."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def _dealt(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket")


class Repeats:
    """What the search finds in one table: whole copies, and for each other text its covered windows."""

    def __init__(self, docs: DataFrame, hot_fragments: int = HOT_FRAGMENTS, spread_fragments: int = SPREAD_FRAGMENTS) -> None:
        spark = docs.sparkSession
        ship(spark)
        self.given = docs
        pair = narrow(docs, "doc_id", "text")
        rows = _ids(pair)
        n = shuffle_partitions(spark)
        narrow_rows = cut(rows.select(F.col("c0").alias("doc_id"), "doc", "sha", "n_bytes"))
        # ``dup`` tells different texts of one id apart; it is 0 everywhere where ids have one text each.
        texts = narrow_rows.select("doc", "sha").distinct()
        self.names = None
        if texts.groupBy("doc").count().where("count > 1").limit(1).count():
            self.names = cut(texts.withColumn("dup", F.row_number().over(Window.partitionBy("doc").orderBy("sha")) - 1))
        narrow_rows = self._named(narrow_rows)
        self.rows = self._named(rows).select(F.col("c0").alias("doc_id"), "doc", "dup", safe_text("c1").alias("text"))
        firsts = narrow_rows.groupBy("sha").agg(F.min("doc").alias("first"))
        self.sizes = cut(narrow_rows.join(firsts, "sha").withColumn("copy", F.col("doc") > F.col("first")).drop("first"))
        total = self.sizes.agg(F.sum("n_bytes")).first()[0] or 0
        bits = max(4, (max(total // BUCKET_BYTES, 4 * n) - 1).bit_length())
        text = self.rows.select("doc", "dup", "text")
        if self.sizes.groupBy("doc", "dup").count().where("count > 1").limit(1).count():
            text = text.dropDuplicates(["doc", "dup"])
        with _small_batches(spark):
            self.edits = self._search(text, bits, n, hot_fragments, spread_fragments)

    def _search(self, text: DataFrame, bits: int, n: int, hot_fragments: int, spread_fragments: int) -> DataFrame:
        """(doc, dup, covered, masks) of the texts that something is found for."""
        packed = _dealt(text.mapInArrow(tidy(_deal(bits, spread_fragments)), _PACKED), n)
        found = _dealt(packed.mapInArrow(tidy(_settle(bits, hot_fragments)), _PACKED), n)
        own = F.shiftright("k", DUP_SHIFT).cast("int").alias("dup")
        copies = self.sizes.where("copy").select("doc", "dup").distinct()
        kinds = found.mapInArrow(tidy(_kinds), "doc bigint, dup int, covered array<int>, need array<int>, hot array<int>")
        marks = cut(kinds.join(copies, ["doc", "dup"], "left_anti"))
        asked = self._texts_of(text, marks.where("size(need) > 0").select("doc", "dup", "need"))
        fragments = asked.mapInArrow(tidy(_fragments), "h bigint, anchor tinyint, fragment binary, doc bigint, k bigint")
        masks = fragments.repartition(n, "h").sortWithinPartitions("h").mapInArrow(tidy(_merge), "doc bigint, k bigint, mask bigint")
        masks = masks.groupBy("doc", own).agg(F.collect_list(F.struct(
            F.col("k").bitwiseAND((1 << DUP_SHIFT) - 1).cast("int").alias("k"), "mask")).alias("masks"))
        hot = marks.where("size(hot) > 0").select("doc", "dup", "hot")
        count = hot.agg(F.sum(F.size("hot"))).first()[0]
        if count:
            met = cut(self._common(text, hot, _arounds, count * (SIDES // SIDE_STEP + 1), (8, 0), False).withColumnRenamed("masks", "hot"))
            count = met.agg(F.sum(F.aggregate("hot", F.lit(0), lambda n, x: n + F.bit_count(x["mask"])))).first()[0] or 0
            # A surrounding is inside WINDOW - GRAM - SIDES + 1 windows.
            found = self._common(text, met, _windows, count * (WINDOW - GRAM - SIDES + 1), (8, 8), True)
            masks = masks.union(found).groupBy("doc", "dup").agg(F.flatten(F.collect_list("masks")).alias("masks"))
        return cut(marks.where("size(covered) > 0").select("doc", "dup", "covered").join(masks, ["doc", "dup"], "full"))

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("dup", F.lit(0)) if self.names is None else rows.join(self.names, ["doc", "sha"])

    def _common(self, text: DataFrame, wanted: DataFrame, keys, count: int, wide: tuple[int, int], later: bool) -> DataFrame:
        """(doc, dup, masks) of the hot fragments: the hashes by ``keys``, about ``count``, that another document has, or an earlier one."""
        n = shuffle_partitions(text.sparkSession)
        bits = max(4, (max(count * KEY_BYTES // BUCKET_BYTES, 4 * n) - 1).bit_length())
        asked = _dealt(self._texts_of(text, wanted).mapInArrow(tidy(_ask(keys, bits, wide, later)), _PACKED), n)
        told = _dealt(asked.mapInArrow(tidy(_tell(bits, wide, later)), _PACKED), n)
        return told.mapInArrow(tidy(_listed), "doc bigint, dup int, masks array<struct<k:int,mask:bigint>>")

    def _texts_of(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows joined to ``wanted`` by id, with compressed texts; most rows without a partner are left out before the shuffle."""
        shared = rows.sparkSession.sparkContext.broadcast(_id_table(wanted))
        fields = [f for f in rows.schema.fields if f.name != "text"]
        packed = rows.select("*", _slot()).mapInArrow(tidy(_packed_texts(shared)), StructType([*fields, StructField("z", BinaryType())]))
        return packed.join(wanted, ["doc", "dup"])

    def removals(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        gone = F.col("copy") & (F.col("n_bytes") >= WINDOW)
        edited = self.edits.select("doc", "dup").withColumn("edited", F.lit(True))
        rest = self.sizes.join(edited, ["doc", "dup"], "left").where(F.col("edited").isNull()).select(
            "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
            gone.cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"))
        kind = self.rows.schema["doc_id"].dataType.simpleString()
        cut_out = self._texts_of(self.rows.select("doc_id", "doc", "dup", "text"), self.edits).mapInArrow(
            tidy(_digest), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
        return rest.select(*names).union(cut_out.select(*names))

    def rewritten(self) -> DataFrame:
        """The given rows with what stays of their texts, by one shuffle of the texts."""
        docs = self.given
        text, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
        whole = self.sizes.where(F.col("copy") & (F.col("n_bytes") >= WINDOW)).select("doc", "dup").distinct()
        changes = self.edits.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)), allowMissingColumns=True)
        columns = [f"c{i}" for i in range(len(docs.columns))]
        rows = self._named(_ids(docs)).select(*columns, "doc", "dup")
        shared = docs.sparkSession.sparkContext.broadcast(_id_table(changes))
        pick = lambda maybe: rows.select("*", _slot()).mapInArrow(tidy(_by_slot(shared, maybe)), rows.schema)
        joined = pick(True).join(changes, ["doc", "dup"], "left").select(*columns, "covered", "masks", "whole")
        schema = StructType([StructField(f.name, f.dataType) for f in docs.schema])
        same = pick(False).select(*[F.col(n).alias(f.name) for n, f in zip(columns, docs.schema, strict=True)])
        return joined.mapInArrow(tidy(_rewrite(text, count)), schema).union(same)


def _by_slot(shared, maybe: bool):
    def run(batches):
        for b in batches:
            b = b.filter(pa.array(_has_slot(b, shared.value) == maybe))
            yield b.select([c for c in b.schema.names if c != "slot"])

    return run


def _removed(part: pa.RecordBatch, text: str = "text"):
    """Bytes, row offsets and which bytes go."""
    buf, offs = text_bytes(part.column(text))
    lo, hi, row, *_ = anchors(buf, offs)
    own = row_offsets(row, part.num_rows)
    step = np.zeros(len(buf) + 1, np.int64)
    whole = part.column("covered")
    r = np.repeat(np.arange(part.num_rows), whole.value_lengths().fill_null(0).to_numpy())
    at = own[r] + whole.flatten().to_numpy()
    np.add.at(step, lo[at], 1)
    np.add.at(step, hi[at] + WINDOW, -1)
    some = part.column("masks")
    r = np.repeat(np.arange(part.num_rows), some.value_lengths().fill_null(0).to_numpy())
    flat = some.flatten()
    at, mask = own[r] + flat.field("k").to_numpy(), flat.field("mask").to_numpy()
    for j in range(WINDOW - GRAM + 1):
        p = lo[at[(mask >> j) & 1 == 1]] + j
        np.add.at(step, p, 1)
        np.add.at(step, p + WINDOW, -1)
    return buf, offs, np.cumsum(step[:-1]) > 0


def _digest(batches):
    for part in _opened(batches):
        buf, offs, gone = _removed(part)
        total = np.concatenate([[0], np.cumsum(gone)])
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        head = offs[:-1][offs[:-1] < offs[1:]]
        starts[head] = gone[head]
        spans = np.concatenate([[0], np.cumsum(starts)])
        digests = [hashlib.sha256(buf[a:z][~gone[a:z]].tobytes()).hexdigest() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(offs)), pa.array(total[offs[1:]] - total[offs[:-1]]),
             pa.array(spans[offs[1:]] - spans[offs[:-1]]), pa.array(digests, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rewrite(text: int, count: int | None):
    def run(batches):
        for b in batches:
            for part in slices(b, f"c{text}", SLICE_BYTES):
                buf, offs, gone = _removed(part, f"c{text}")
                whole, columns = part.column("whole").to_pylist(), part.columns[: len(part.columns) - 3]
                old, kept, sizes = columns[text], [], []
                changed = np.add.reduceat(np.append(gone, False), offs[:-1]) > 0 if len(buf) else np.zeros(part.num_rows, bool)
                changed &= np.diff(offs) > 0
                for k in range(part.num_rows):
                    if whole[k]:
                        kept.append("")
                    elif changed[k]:
                        kept.append(buf[offs[k]: offs[k + 1]][~gone[offs[k]: offs[k + 1]]].tobytes().decode("utf-8", "ignore"))
                    else:
                        kept.append(old[k].as_py())
                columns[text] = pa.array(kept, old.type)
                if count is not None:
                    known = columns[count].to_pylist()
                    sizes = [len(kept[k]) if whole[k] or changed[k] else known[k] for k in range(part.num_rows)]
                    columns[count] = pa.array(sizes, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def repeated_bytes(docs: DataFrame, hot_fragments: int = HOT_FRAGMENTS, spread_fragments: int = SPREAD_FRAGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each input row.

    A byte goes if a string of 50 bytes over it also starts in a document with a smaller id; strings are judged on
    the input. ``n_spans`` counts maximal removed runs and ``kept_sha256`` is the digest of the remaining bytes. Null
    texts count as empty, and texts under 50 bytes stay whole. A null id counts as the largest. Rows
    that share an id never remove each other's bytes, whether their texts are equal or not. An empty table gives no rows.
    """
    return Repeats(docs, hot_fragments, spread_fragments).removals()


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what stays of each text and, if there is a column n_chars, its new length.

    A character that loses a byte goes whole. Rows stay even if nothing is left of their text; null texts stay
    null, and rows that lose nothing stay as they are.
    """
    return Repeats(docs).rewritten()
