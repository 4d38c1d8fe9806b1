"""SimHash near duplicates: popcounts of segments, a grid join under Manhattan distance, exact check.

A fingerprint of 64 bits is read as 32 segments of two bits. Its point is the vector of the segments'
bit counts. Flipping one bit moves one coordinate by one, so the Manhattan distance of two points
never exceeds the number of differing bits. With three bands of coordinates and at most five differing
bits, some band has distance zero or one. The grid of a band has a cell for each integer point; a fingerprint lives in its own cell and also looks into the cells one step up in one coordinate, which
finds each pair at distance one from exactly one side. Pairs that meet are checked on all bits.

Texts of similarity 0.8 differ in too many of 64 bits for any grid, so the filter for near copies takes its candidates
from the grid join and, for those farther apart, from bands of minima, and checks each by the exact Jaccard similarity of the sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq.llm.common import U, expand, forest, mix, narrow, shuffle_partitions, tidy
from panelseq.llm.components import components
from panelseq.session import cut, ship

#: Ranges of segments that make the bands of a 64-bit fingerprint: three, for at most five differing bits.
BANDS = ((0, 11), (11, 22), (22, 32))
#: The search for near copies: bands of minima over the set of shingles. A pair of Jaccard similarity s meets with probability
#: 1 - (1 - s ** NEAR_ROWS) ** NEAR_BANDS: 0.9996 at 0.8, 0.9999 at 0.83.
NEAR_BANDS, NEAR_ROWS = 20, 5
#: Least Jaccard similarity of a link between near copies.
NEAR = 0.8
_XOR, _ODD = np.random.default_rng(31).integers(0, 1 << 63, (2, NEAR_BANDS * NEAR_ROWS), dtype=np.int64).astype(U) * U(2) + U(1)
#: Homes of one cell that one task compares; fuller cells are dealt into several.
CELL_ROWS = 1024
#: Cells above CELL_ROWS that may be broadcast, 16 bytes each.
BROADCAST_CELLS = 100_000
PAIR_BLOCK = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), last.tolist(), strict=True)], U)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo: lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 hashes of all shingles."""
    return majority(shingle_hashes(text, shingle))


def wide_fingerprint(text: str | None, shingle: int, words: int) -> list[int]:
    """Several independent words of majority bits over the set of shingles."""
    h = np.unique(shingle_hashes(text, shingle))
    return [majority(mix(h + U(k) * U(0x9E3779B97F4A7C15))) for k in range(words)]


def _word_columns(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, w0, ...): one row for each input row; null text counts as empty and gets zero.

    One word is the fingerprint of all shingles, more are a wide one of the set of shingles.
    """
    ship(docs.sparkSession)
    rows = narrow(docs, id_col, text_col).toDF("doc_id", "text")
    names = _word_columns(words)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            fps = [[fingerprint(t, shingle)] for t in texts] if words == 1 else [wide_fingerprint(t, shingle, words) for t in texts]
            fps = np.array(fps, U).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(fps[:, k]) for k in range(words)]], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, one row for each fingerprint (a row of words)."""
    s = (fps[:, :, None] >> (U(2) * np.arange(32, dtype=U))) & U(3)
    return ((s & U(1)) + (s >> U(1))).astype(np.int64).reshape(len(fps), -1)


def _words(b: pa.RecordBatch, words: int) -> np.ndarray:
    return np.stack([b.column(c).to_numpy().view(U) for c in _word_columns(words)], axis=1)


def _grid(words: int, bands):
    """Home and probe rows of each distinct fingerprint."""

    def run(batches):
        for b in batches:
            fp, rep = _words(b, words), b.column("rep").to_numpy()
            counts = segment_counts(fp)
            for band, (lo, hi) in enumerate(bands):
                weight = 3 ** np.arange(hi - lo, dtype=np.int64) * len(bands)
                home = (counts[:, lo:hi] * weight).sum(1) + band
                who, step = np.nonzero(counts[:, lo:hi] < 2)
                at = np.concatenate([np.arange(len(fp)), who])
                probe = np.concatenate([np.zeros(len(fp), bool), np.ones(len(who), bool)])
                signed = fp[at].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, home[who] + weight[step]])), pa.array(probe), pa.array(rep[at]), *[pa.array(signed[:, k]) for k in range(words)]],
                    ["cell", "probe", "rep", *_word_columns(words)])

    return run


def _compare(left_fp, left_rep, right_fp, right_rep, i, j, bits, out):
    near = np.bitwise_count(left_fp[i] ^ right_fp[j]).sum(1, dtype=np.int64) <= bits
    if near.any():
        out.append((left_rep[i[near]], right_rep[j[near]]))


def _links(bits: int, words: int):
    def run(batches):
        """Rows come by (cell, deal) with homes first; homes of the open cell are carried along."""
        key, fps, reps = None, np.zeros((0, words), U), np.zeros(0, np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            cell, deal = b.column("cell").to_numpy(), b.column("deal").to_numpy()
            probe = b.column("probe").to_numpy(zero_copy_only=False)
            fp, rep = _words(b, words), b.column("rep").to_numpy()
            out: list = []
            new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (deal[1:] != deal[:-1])])
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(cell))
            if key == (cell[0], deal[0]):
                step = max(1, PAIR_BLOCK // max(1, len(fps)))
                for lo in range(0, end[0], step):
                    hi = min(end[0], lo + step)
                    i = np.repeat(np.arange(len(fps)), hi - lo)
                    j = np.tile(np.arange(lo, hi), len(fps))
                    _compare(fps, reps, fp, rep, i, j, bits, out)
            homes = np.flatnonzero(~probe)
            stop = np.repeat(end, end - first)[homes]
            pairs = np.cumsum(stop - homes - 1)
            lo = 0
            while lo < len(homes):
                base = pairs[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(pairs, base + PAIR_BLOCK, "right")))
                owner, j = expand(homes[lo:hi] + 1, stop[lo:hi])
                _compare(fp, rep, fp, rep, homes[lo:hi][owner], j, bits, out)
                lo = hi
            last = slice(first[-1], None)
            mine = ~probe[last]
            if key == (cell[-1], deal[-1]) and len(first) == 1:
                fps, reps = np.concatenate([fps, fp[last][mine]]), np.concatenate([reps, rep[last][mine]])
            else:
                fps, reps = fp[last][mine], rep[last][mine]
            key = (cell[-1], deal[-1])
            if out:
                a, z = forest(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])

    return run


def near_links(points: DataFrame, bits: int = 4, words: int = 1, bands=BANDS) -> DataFrame:
    """Edges (a, b) that connect the representatives that meet in a band and differ in at most ``bits`` bits.

    ``points`` has distinct rows (w0, ..., rep). With three bands of one word and at most five bits no pair is lost. A dense cell yields a spanning forest instead of all pairs.
    A cell with over CELL_ROWS homes is dealt: each home goes to one deal by its fingerprint, each
    probe and home to every deal it has to meet.
    """
    spark = points.sparkSession
    ship(spark)
    names = _word_columns(words)
    grid = points.select(*names, "rep").mapInArrow(tidy(_grid(words, bands)), "cell bigint, probe boolean, rep bigint, " + ", ".join(f"{n} bigint" for n in names))
    full = cut(grid.where("not probe").groupBy("cell").count().where(F.col("count") > CELL_ROWS)
               .select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("deals")))
    full = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full
    grid = grid.join(full, "cell", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    own = F.pmod(F.xxhash64(*names), F.col("deals")).cast("int")
    dealt = grid.withColumn("own", own).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    dealt = dealt.withColumn("probe", F.col("probe") | (F.col("deal") != F.col("own")))
    n = shuffle_partitions(spark)
    placed = dealt.select("cell", "deal", "probe", "rep", *names).repartition(n, "cell", "deal")
    return placed.sortWithinPartitions("cell", "deal", "probe").mapInArrow(tidy(_links(bits, words)), "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, shingle: int = 5, bits: int = 4, words: int = 1, bands=BANDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, w0, ..., component_id): documents joined by chains of fingerprints within ``bits`` bits.

    Words are runs of other bytes than ASCII white space after lower-casing A to Z. Equal fingerprints are compared
    once, through the smallest id that has them; rows with a null id never name a component unless all of
    its rows have one. Null and empty texts have fingerprint zero and form one component with all
    that is near zero. Repeated rows give repeated result rows; an empty table gives no rows.
    """
    names = _word_columns(words)
    fps = cut(fingerprints(docs, shingle, words, id_col, text_col))
    points = cut(fps.groupBy(*names).agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    found = components(near_links(points, bits, words, bands), "a", "b")
    named = points.join(found, points["rep"] == found["id"], "left").select(
        *[points[n] for n in names], F.coalesce(found["component"], points["rep"]).alias("component_id"))
    return fps.join(named, names, "left").select(F.col("doc_id").alias(id_col), *names, "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of minima of a set of hashes; empty sets have no key."""
    if len(h) == 0:
        return np.zeros(0, U)
    low = np.full(len(_ODD), np.iinfo(U).max, U)
    for lo in range(0, len(h), 1024):
        np.minimum(low, ((h[lo: lo + 1024, None] ^ _XOR) * _ODD).min(0), out=low)
    low = mix(low).reshape(NEAR_BANDS, NEAR_ROWS)
    key = np.arange(NEAR_BANDS, dtype=U)
    for k in range(NEAR_ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + low[:, k])
    return key


def _sketch(shingle: int):
    def run(batches):
        for b in batches:
            nodes, sizes, words, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_set(t, shingle)
                nodes.append(mix(mix(h).sum(keepdims=True, dtype=U) + U(len(h)))[0])
                sizes.append(len(h))
                words.append(majority(h))
                keys.append(band_keys(h).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(np.array(nodes, U).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(np.array(words, U).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "size", "w0", "keys"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _check(shingle: int):
    def run(batches):
        """Rows come in runs of ``b``, so that its set is made once."""
        known, right = None, None
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), bool)
            for k in range(len(a)):
                if known != b[k]:
                    known, right = b[k], shingle_set(batch.column("text_b")[k].as_py(), shingle)
                keep[k] = jaccard(shingle_set(batch.column("text_a")[k].as_py(), shingle), right) >= NEAR
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _near_pairs(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of NEAR at least."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(_check(shingle)), "a bigint, b bigint"))


#: Blocks of shingles by which what two sets can share is bounded.
COUNT_BLOCKS = 64


def _shingle_rows(shingle: int):
    def run(batches):
        for b in batches:
            for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = shingle_set(text, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(h)], ["node", "h"])

    return run


def _shared_counts(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shared, counts): how many shingles of a set another set of ``nodes`` has too, in all and by block."""
    rows = cut(texts.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(tidy(_shingle_rows(shingle)), "node bigint, h bigint"))
    common = cut(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    blocks = rows.join(common, "h").groupBy("node", F.pmod("h", F.lit(COUNT_BLOCKS)).alias("block")).agg(F.count("*").cast("int").alias("n"))
    held = blocks.groupBy("node").agg(F.sum("n").cast("int").alias("shared"), F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("_m"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(COUNT_BLOCKS - 1).cast("long"))
    return held.select("node", "shared", F.transform(at, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))).alias("counts"))


def _reaches(common, x: str, y: str):
    """Whether sets of sizes ``x`` and ``y`` with ``common`` shingles in common have a similarity of NEAR at least."""
    return common >= (F.col(x) + F.col(y) - common) * F.lit(NEAR) - F.lit(1e-6)


def _can_reach(x: str, y: str):
    """Bounds of the similarity of two nodes that lose no link, the cheap ones first."""
    by_block = F.aggregate(F.zip_with(f"counts_{x}", f"counts_{y}", lambda p, q: F.least(p, q)), F.lit(0), lambda t, n: t + n)
    sizes = (f"size_{x}", f"size_{y}")
    return (F.least(*sizes) >= F.greatest(*sizes) * F.lit(NEAR) - F.lit(1e-6)) & _reaches(F.least(f"shared_{x}", f"shared_{y}"), *sizes) & _reaches(by_block, *sizes)


#: Differing bits up to which the grid join hands a pair of fingerprints to the exact check; BANDS lose none of them.
CLOSE_BITS = 5


def _grid_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b), a > b, of the grid join: nodes of one fingerprint with the smallest of them, and these where fingerprints are close."""
    points = cut(nodes.groupBy("w0").agg(F.min("node").alias("rep")))
    equal = nodes.join(points, "w0").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    grid = near_links(points, CLOSE_BITS).where("a <> b")
    return equal.union(grid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()


def _near_parts(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, part), one row for each row of ``docs``; see ``near_duplicates``."""
    spark = docs.sparkSession
    ship(spark)
    rows = narrow(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = cut(rows.mapInArrow(tidy(_sketch(shingle)), f"doc_id {kind}, text_hash bigint, node bigint, size bigint, w0 bigint, keys array<bigint>"))
    keyed = found.select("node", "size", F.explode("keys").alias("key")).distinct()
    heads = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("head")).where("n > 1").drop("n")
    met = cut(keyed.join(heads, "key").select("key", "node", "size", F.col("head.node").alias("head"), F.col("head.size").alias("head_size")))
    close = cut(_grid_pairs(found.select("node", "w0").distinct()))
    known = met.select("node").union(close.select("a")).union(close.select("b")).distinct()
    named = found.join(known, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("node", "row.*")
    same = rows["doc_id"].eqNullSafe(named["doc_id"]) & (rows["text_hash"] == named["text_hash"])
    texts = cut(rows.join(named, same).select("node", "text"))

    def parted(links: DataFrame) -> DataFrame:
        return components(links, "a", "b").select(F.col("id").alias("node"), F.col("component").alias("part"))

    fits = F.least("size", "head_size") >= F.greatest("size", "head_size") * F.lit(NEAR) - F.lit(1e-6)
    stars = met.where(F.col("node") != F.col("head")).where(fits).select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = _near_pairs(close.union(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), texts, shingle)
    others = met.where(F.col("node") != F.col("head")).select("key", "node", "size")

    def apart(parts: DataFrame) -> DataFrame:
        """The nodes, heads aside, of keys that still hold more than one part."""
        now = others.join(parts, "node", "left").select("key", "node", "size", F.coalesce("part", "node").alias("part"))
        several = now.groupBy("key").agg((F.min("part") < F.max("part")).alias("several")).where("several").select("key")
        return cut(now.join(several, "key", "left_semi"))

    left = apart(parted(links))
    if left.limit(1).count():
        counts = _shared_counts(left, texts, shingle)
        # A set whose shared shingles are too few has no link; of the others the one that shares most is the next head of its key.
        alive = cut(left.select("key", "node", "size").join(counts, "node").where(F.col("shared") >= F.col("size") * F.lit(NEAR) - F.lit(1e-6)))
        best = alive.groupBy("key").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("share"), "node")).alias("best")).select("key", F.col("best.node").alias("b"))
        sides = [alive.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "shared", "counts")]) for x in ("a", "b")]
        centre = sides[1].join(best, "key").where("node_b = b").drop("b")
        more = sides[0].join(centre, "key").where("node_a <> node_b").where(_can_reach("a", "b"))
        found_links = _near_pairs(more.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), texts, shingle)
        # Nodes that are linked to their key's centre need no other link between them, and neither do nodes of one part.
        held = found_links.join(best, "b").select("key", F.col("a").alias("node")).union(best.select("key", F.col("b").alias("node"))).withColumn("held", F.lit(True))
        at = left.select("key", "node", "part").join(held, ["key", "node"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
        placed = cut(alive.join(at, ["key", "node"]))
        a, b = (placed.select([F.col(c).alias(f"{c}_{x}") for c in placed.columns]) for x in "ab")
        near = (F.col("key_a") == F.col("key_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("part_a") != F.col("part_b")) & ~(F.col("held_a") & F.col("held_b"))
        rest = a.join(b, near & _can_reach("a", "b"))
        links = links.union(found_links)
        links = links.union(_near_pairs(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), texts, shingle))
    joined = parted(links)
    return found.select("doc_id", "text_hash", "node").join(joined, "node", "left").select("doc_id", "text_hash", F.coalesce("part", "node").alias("part"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id): documents joined by chains of links of Jaccard similarity NEAR and more.

    A node is a set of shingles, named by 64 bits; equal sets are one node, and null and empty texts have the
    empty set. Nodes whose fingerprints (majority bits over the set) are within
    CLOSE_BITS are candidates, found by the grid join; so are nodes that share a band key, since fingerprints of similarity 0.8 differ in more. First each node of a key is checked against the smallest one. Nodes of keys
    that are then still apart are held against each other by what they can share at most: only shingles that some other such set has
    count, in all and block by block, which loses no link. Those within the bound are checked, first against the node
    that shares most. So copies cost one check a member, and sets of one key that only look alike cost a comparison of counts for each pair, but no row.
    Ids are named as in ``simhash_components``. Repeated rows give repeated results, other columns are left out, an empty table gives no rows.
    """
    ids = _near_parts(docs, shingle)
    return ids.join(ids.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part").select("doc_id", "component_id")


def near_duplicates_removed(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: that of the smallest id, and of its smallest text hash.

    Rows go by id and text, so of an id with two texts only the copy goes; of repeated rows one stays. A row with a null id stays.
    """
    ids = cut(_near_parts(docs, shingle).where("doc_id IS NOT NULL"))
    first = ids.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = ids.join(first, "part").where(F.struct("doc_id", "text_hash") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    left = hashed.join(gone, (hashed["doc_id"] == gone["_id"]) & (F.col("_text_hash") == F.col("_hash")), "left_anti")
    if ids.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        known = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_text_hash"])
        left = known.unionByName(left.where("doc_id IS NULL"))
    return left.select(*[F.col(c) for c in docs.columns])
