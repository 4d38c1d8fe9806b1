"""Time blocks: exact windows, folds and quantiles with bounded task sizes.

A sequence may hold any share of the rows, so nothing here partitions by the
sequence key alone. Rows are cut into time chunks of fixed length; a chunk also
receives the few neighbour rows its windows reach into (the halo).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelseq import TIME
from panelseq.session import cut, ship

CHUNK = 4096
FLUSH_ROWS = 65_536


# ---------------------------------------------------------------- halo windows
def with_halo(df: DataFrame, t: str = TIME, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and ``_home``; rows near a border are copied to the neighbour.

    Chunk c gets the rows of [c*chunk - before, (c+1)*chunk + after). ``_home``
    is true on the one copy whose windows are complete.
    """
    if before > chunk or after > chunk:
        raise ValueError("a halo may not be longer than a chunk")
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"(`{t}` - {after}) div {chunk}"))
    last = F.expr(f"(`{t}` + {before}) div {chunk}")
    out = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return out.withColumn("_home", F.col("_chunk") == F.expr(f"`{t}` div {chunk}"))


def chunk_window(keys: Sequence[str], t: str = TIME) -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(t)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_chunk")


def trailing(
    df: DataFrame, keys: Sequence[str], build: Callable[[Callable], dict], before: int, after: int = 0,
    t: str = TIME, chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that reach ``before`` rows back and ``after`` rows on.

    ``build(rows)`` gets a function rows(lo, hi) -> window and returns
    {column name: expression}.
    """
    base = chunk_window(keys, t)

    def rows(lo: int | None = None, hi: int | None = None):
        return base if lo is None else base.rowsBetween(lo, hi)

    made = build(rows)
    return drop_halo(with_halo(df, t, before, after, chunk).withColumns(made))


# ---------------------------------------------------------------- dense index
def dense_index(
    df: DataFrame, keys: Sequence[str], bucket, order: Sequence[str], name: str = TIME
) -> DataFrame:
    """0-based position of each row within ``keys``, ordered by ``order``.

    ``bucket`` is a coarse order-preserving column (such as the minute): rows are
    numbered inside their bucket and shifted by the rows of earlier buckets, so
    one large key is spread over its buckets. ``order`` must break ties.
    """
    tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_pos") + F.col("_offset") - 1).cast("long"))
        .drop("_bucket", "_pos", "_offset")
    )


def longest(panel: DataFrame, t: str = TIME) -> int:
    """Largest number of rows a sequence can have, read as one aggregate."""
    top = panel.agg(F.max(t)).first()[0]
    return 0 if top is None else int(top) + 1


# ---------------------------------------------------------------- unit kernels
def _starts(table: pa.Table, unit: Sequence[str]) -> np.ndarray:
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for name in unit:
        c = table.column(name).combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = c.chunk(0)
        differs = pc.not_equal(c.slice(1), c.slice(0, n - 1)) if n > 1 else pa.array([], pa.bool_())
        change[1:] |= np.asarray(differs.to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(change)


def map_units(
    df: DataFrame, unit: Sequence[str], order: Sequence[str],
    kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str | T.StructType,
    flush_rows: int = FLUSH_ROWS, together: Sequence[str] | None = None,
    then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Run ``kernel(table, unit_starts)`` over whole units, many units at a time.

    Units that agree in ``together``, the first of the unit keys, come to one task; ``then`` reads there what the kernel made, in order.

    Units are hash-spread and sorted; a task streams its Arrow batches, keeps at
    most ``flush_rows`` rows plus one unfinished unit, and never splits a unit.
    Unit keys must not be null and units must be bounded by the caller.
    """
    ship(df.sparkSession)
    cols = list(df.columns)
    ready = df.repartition(*(together or unit)).sortWithinPartitions(*unit, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < flush_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, unit)
            if len(starts) > 1:
                last = int(starts[-1])
                yield from kernel(table.slice(0, last).combine_chunks(), starts[:-1]).to_batches(max_chunksize=50_000)
                held = table.slice(last).combine_chunks().to_batches()
            else:
                held = table.to_batches()
            rows = sum(x.num_rows for x in held)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from kernel(table, _starts(table, unit)).to_batches(max_chunksize=50_000)

    assert set(unit) <= set(cols)
    return ready.mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


def floats(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(), dtype=np.float64)


def ints(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(), dtype=np.int64)


def unit_layout(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit starts ordered by descending length, and those lengths."""
    lengths = np.diff(np.append(starts, n))
    by = np.argsort(-lengths, kind="stable")
    return starts[by], lengths[by]


def steps(starts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Yield (step, row positions, live units): all units move one row on."""
    first, lengths = unit_layout(starts, n)
    if not len(first):
        return
    live = len(first)
    for s in range(int(lengths[0])):
        while lengths[live - 1] <= s:
            live -= 1
        yield s, first[:live] + s, live


def extend(table: pa.Table, keep: Sequence[str], extra: dict[str, np.ndarray]) -> pa.Table:
    out = table.select(list(keep))
    for name, values in extra.items():
        out = out.append_column(name, pa.array(values))
    return out


def schema_of(df: DataFrame, keep: Sequence[str], extra: str) -> T.StructType:
    base = T.StructType([df.schema[c] for c in keep])
    added = T.StructType.fromDDL(extra)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in [*base.fields, *added.fields]])


# ---------------------------------------------------------------- exact quantiles
SMALL_GROUP = 100_000


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
    small: int = SMALL_GROUP, splits: int = 256,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for groups of any size.

    The values are written once as a stage table, whose largest group picks the
    way: groups of at most ``small`` values use the built-in percentile, whose
    buffer they bound; larger ones are cut into value buckets, and only the
    buckets that hold a wanted rank are sorted. Nulls are ignored.
    """
    by = list(by)
    unit = by or ["_all"]
    src = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if not by:
        src = src.withColumn("_all", F.lit(1))
    src = cut(src)
    sizes = src.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))

    def built_in(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*unit).agg(*[F.percentile("_v", F.lit(float(p))).alias(nm) for p, nm in zip(probs, names)])

    if (sizes.agg(F.max("_n")).first()[0] or 0) <= small:
        out = built_in(src)
    else:
        big = sizes.where(F.col("_n") > small).select(*unit)
        out = built_in(src.join(big, unit, "left_anti")).unionByName(
            _bucketed_quantiles(src.join(big, unit, "left_semi"), unit, probs, names, splits))
    return out if by else out.drop("_all")


def _bucketed_quantiles(src: DataFrame, unit: list[str], probs, names, splits: int) -> DataFrame:
    counts = src.groupBy(*unit, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*unit).agg(
        F.percentile_approx("_v", [i / splits for i in range(1, splits)], 10 * splits).alias("_cuts")
    )
    placed = counts.join(cuts, unit).withColumn(
        "_b", F.expr("aggregate(_cuts, 0, (n, c) -> n + int(c < _v))")
    ).drop("_cuts")
    per_bucket = placed.groupBy(*unit, "_b").agg(F.sum("_n").alias("_m"))
    over = Window.partitionBy(*unit).orderBy("_b")
    upto = per_bucket.select(
        *unit, "_b", "_m",
        (F.sum("_m").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_below"),
        F.sum("_m").over(Window.partitionBy(*unit)).alias("_total"),
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(nm).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
        for p, nm in zip(probs, names)
    ]))
    targets = (
        upto.withColumn("_w", wanted)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_w.pos"), F.ceil("_w.pos")))))
        .where("_rank >= _below and _rank < _below + _m")
        .select(*unit, "_b", "_below", F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"), "_rank")
    )
    inner = Window.partitionBy(*unit, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        placed.join(targets.select(*unit, "_b").distinct(), [*unit, "_b"], "left_semi")
        .withColumn("_hi", F.sum("_n").over(inner))
    )
    hit = targets.join(ranked, [*unit, "_b"]).where(
        "_rank - _below < _hi and _rank - _below >= _hi - _n"
    )
    picked = hit.groupBy(*unit, "_name", "_pos").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_up"))
    value_at = F.col("_lo") + (F.col("_up") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    return picked.groupBy(*unit).agg(
        *[F.max(F.when(F.col("_name") == nm, value_at)).alias(nm) for nm in names]
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, by, value, [0.5], [name])
