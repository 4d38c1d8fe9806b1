"""Near duplicates among embeddings by an exact metric range join.

Unit vectors are compared by Euclidean distance: a cosine of at least c is a distance of at most
r = sqrt(2 - 2c). Pivots cut each label's vectors into cells by the nearest pivot. If y in cell j lies
within r of x in cell i, the triangle inequality gives d(y, p_i) <= d(y, p_j) + 2r; and y is no
further than r from the plane between the two cells, so d(y, p_i)^2 - d(y, p_j)^2 <= 2r d(p_i, p_j).
Rows that meet both bounds are copied into cell i. Each cell then finds all partners of its own rows by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelseq.llm.common import forest, narrow, shuffle_partitions
from panelseq.llm.components import components
from panelseq.session import cut, ship

#: Vectors of one label that a pivot should draw, most pivots, and own rows of a cell that one task compares.
ROWS_PER_PIVOT, MAX_PIVOTS, CELL_ROWS = 4096, 64, 2048
#: Cells above CELL_ROWS that may be broadcast.
BROADCAST_CELLS = 100_000
BLOCK = 2048
SLACK = 1e-9


def _clean(batches):
    """Rows with a usable vector, as eight-byte floats."""
    for b in batches:
        col, rows, packed, dims = b.column("vector"), [], [], []
        for k, v in enumerate(col.to_pylist()):
            if v is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64) + 0.0
            if x.size and np.isfinite(x).all() and x.any():
                rows.append(k)
                packed.append(x.tobytes())
                dims.append(x.size)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(at), b.column("label").take(at), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "label", "dim", "v"])


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _deal(pivots: list[bytes], radius: float):
    points = [np.frombuffer(p, np.float64) for p in pivots]

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                x = _units(own.column("v"), dim)
                p = np.stack([np.resize(q, dim) for q in points])
                p = p / np.maximum(np.sqrt((p * p).sum(1, keepdims=True)), 1e-300)
                d = np.sqrt(np.maximum(0.0, ((x * x).sum(1)[:, None] + (p * p).sum(1)[None]) - 2 * x @ p.T))
                home = d.argmin(1)
                near = d[np.arange(len(x)), home][:, None]
                between = np.sqrt(np.maximum(0.0, ((p[:, None] - p[None]) ** 2).sum(2)))[home]
                meets = (d <= near + 2 * radius + SLACK) & (d * d - near * near <= 2 * radius * between + SLACK)
                meets[np.arange(len(x)), home] = True
                row, cell = np.nonzero(meets)
                at = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [at.column("label"), at.column("dim"), pa.array(cell.astype(np.int32)), pa.array(cell != home[row]),
                     at.column("rep"), at.column("copies"), at.column("v")], ["label", "dim", "cell", "guest", "rep", "copies", "v"])

    return run


class _Cell:
    """Own rows of one deal of one cell, complete before its guests come."""

    def __init__(self, least: float) -> None:
        self.least, self.parts, self.x, self.found = least, [], None, []

    def homes(self, x, rep, copies) -> None:
        self.parts.append((x, rep, copies))

    def close(self) -> None:
        if self.x is None and self.parts:
            self.x, self.rep, self.copies = (np.concatenate(z) for z in zip(*self.parts, strict=True))
            self.links = np.zeros(len(self.rep), np.int64)
            self.meet(self.x, self.rep, self.copies)

    def meet(self, x, rep, copies) -> None:
        for lo in range(0, len(rep), BLOCK):
            near = self.x @ x[lo: lo + BLOCK].T >= self.least
            near &= self.rep[:, None] != rep[None, lo: lo + BLOCK]
            self.links += near @ copies[lo: lo + BLOCK]
            i, j = np.nonzero(near)
            self.found.append(forest(self.rep[i], rep[lo: lo + BLOCK][j]))

    def guests(self, x, rep, copies) -> None:
        self.close()
        if self.x is not None:
            self.meet(x, rep, copies)

    def result(self) -> list[pa.RecordBatch]:
        self.close()
        if self.x is None:
            return []
        a, b = forest(*(np.concatenate(z) for z in zip(*self.found, strict=True))) if self.found else (self.rep[:0], self.rep[:0])
        n, m = len(self.rep), len(a)
        return [pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([False, True], [n, m])), pa.array(np.concatenate([self.rep, a])), pa.array(np.concatenate([self.links, b]))], ["edge", "a", "b"])]


def _join(least: float):
    def run(batches):
        key, cell = None, _Cell(least)
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("group", "dim", "cell", "deal")]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            first = np.flatnonzero(new)
            guest = b.column("guest").to_numpy(zero_copy_only=False)
            for lo, hi in zip(first, np.append(first[1:], b.num_rows), strict=True):
                now = tuple(k[lo] for k in keys)
                if now != key:
                    yield from cell.result()
                    key, cell = now, _Cell(least)
                part = b.slice(lo, hi - lo)
                x, rep, copies = _units(part.column("v"), int(keys[1][lo])), part.column("rep").to_numpy(), part.column("copies").to_numpy()
                n = int(np.searchsorted(guest[lo:hi], True))
                if n:
                    cell.homes(x[:n], rep[:n], copies[:n])
                if n < hi - lo:
                    cell.guests(x[n:], rep[n:], copies[n:])
        yield from cell.result()

    return run


def embedding_links(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row for each input row.

    Rows link when their labels are equal and not null and their cosine in double precision is at least
    ``cosine``; vectors of different lengths never do. Null, empty and zero vectors and those with a null
    or non-finite component link with nothing, as rows with a null label or id do: they have no links and
    name their own component. Equal vectors of a label are compared once and counted as often as they
    occur, so repeated rows link to each other. An empty table gives no rows.

    A cell with over CELL_ROWS own rows is dealt into several tasks, each with some of them and all rows
    they have to meet. A task gives a count for each own row and a forest of its links, not the pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = narrow(vectors, id_col, vector_col, label_col).toDF("id", "vector", "label").select(F.col("id").cast("long"), F.col("label").cast("string"), F.col("vector").cast("array<double>"))
    clean = rows.where("id is not null and label is not null").mapInArrow(_clean, "id bigint, label string, dim int, v binary")
    signed = clean.withColumn("sig", F.md5("v"))
    distinct = cut(signed.groupBy("label", "dim", "sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    most = distinct.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    n_pivots = min(MAX_PIVOTS, max(1, math.ceil(most / ROWS_PER_PIVOT)))
    pivots = [r["v"] for r in distinct.orderBy(F.xxhash64("sig"), "rep").select("v").limit(n_pivots).collect()]
    dealt = distinct.mapInArrow(_deal(pivots, radius), "label string, dim int, cell int, guest boolean, rep bigint, copies bigint, v binary")
    full = cut(dealt.where("not guest").groupBy("label", "dim", "cell").count().where(F.col("count") > CELL_ROWS).select(
        "label", "dim", "cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("deals")))
    full = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full
    dealt = dealt.join(full, ["label", "dim", "cell"], "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("deals")).cast("int"))
    dealt = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    dealt = dealt.withColumn("guest", F.col("guest") | (F.col("deal") != F.col("own"))).withColumn("group", F.col("label"))
    keys = ["group", "dim", "cell", "deal"]
    placed = dealt.select(*keys, "guest", "rep", "copies", "v").repartition(shuffle_partitions(spark), *keys)
    found = cut(placed.sortWithinPartitions(*keys, "guest").mapInArrow(_join(cosine), "edge boolean, a bigint, b bigint"))
    links = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    parts = components(found.where("edge"), "a", "b")
    result = distinct.join(links, "rep").join(parts, distinct["rep"] == parts["id"], "left").select(
        "label", "dim", "sig", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = signed.select("id", "label", "dim", "sig").join(result, ["label", "dim", "sig"]).select("id", "n_links", "component_id")
    alone = rows.where("id is null or label is null").select("id").union(
        rows.where("id is not null and label is not null").where(_unusable()).select("id"))
    out = named.union(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unusable():
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(bad | ~F.exists("vector", lambda x: x != 0), F.lit(True))
