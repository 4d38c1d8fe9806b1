"""Merkle manifest of a table of documents: leaf coordinates by ranks in merged bitmaps, levels by slot arrays.

The ids of a group are held as one compressed bitmap: only 64-bit words that have a bit are rows, merged by
OR from all tasks. A directory of counts over words, and over runs of 2**16 words, of 2**16 such
runs and so on, gives the rank of an id, so leaves are never sorted and no window is longer than 2**16 rows,
whatever the ids. Nodes of 4096 neighbouring slots then meet in one array, in which each node stands at its slot, and
are reduced by twelve levels (of pairs) at once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelseq.llm.common import narrow
from panelseq.session import cut, ship

#: Nodes that one round of reduction brings together, at most.
BLOCK = 4096
#: Bits of an id below a word, and below each run of words: every directory has 2**16 children at most.
SHIFTS = (6, 22, 38, 54)
#: Langs are ordered in one window and sent to all tasks.
MAX_LANGS = 1 << 14
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, or else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[field(n_chars if c == "n_chars" else F.col(c)) for c in LEAF_COLUMNS]), 256)


def bitmap_ranks(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """``rows`` with ``slot``, the place of a row in its group by ``key`` (bigint, null first), and ``size``, the group's rows.

    Rows of one key are ordered by ``tie``; only rows of words with such ties are sorted, within their word.
    """
    id_ = F.coalesce(key, F.lit(-(2**63)))
    rows = rows.withColumn("word", F.shiftright(id_, SHIFTS[0]))
    place_in_word = f"cast(coalesce({key}, 0L) & 63 as int)"
    words = cut(rows.groupBy(group, "word").agg(F.bit_or(F.expr(f"shiftleft(1L, {place_in_word})")).alias("bits"), F.count("*").alias("n")))
    counts = [words.select(group, F.col("word").alias("at"), "n")]
    for low, high in zip(SHIFTS, SHIFTS[1:], strict=False):
        step = counts[-1].groupBy(group, F.shiftright("at", high - low).alias("at")).agg(F.sum("n").alias("n"))
        counts.append(step)
    above = None
    for k in reversed(range(len(SHIFTS))):
        up = (SHIFTS[k + 1] if k + 1 < len(SHIFTS) else 64) - SHIFTS[k]
        table = counts[k].withColumn("up", F.shiftright("at", up) if up < 64 - SHIFTS[k] else F.lit(0).cast("long"))
        inside = Window.partitionBy(group, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        table = table.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        if above is None:
            whole = Window.partitionBy(group, "up")
            above = table.select(group, "at", "before", F.sum("n").over(whole).alias("size"))
            continue
        a = above.select(F.col(group).alias("g"), F.col("at").alias("up_at"), F.col("before").alias("base"), "size")
        joined = table.join(a, table[group].eqNullSafe(a["g"]) & (table["up"] == a["up_at"]))
        above = joined.select(group, "at", (F.col("before") + F.col("base")).alias("before"), "size")
    a = above.select(F.col(group).alias("g"), "at", "before", "size")
    directory = cut(words.join(a, words[group].eqNullSafe(a["g"]) & (words["word"] == a["at"])).select("g", "at", "bits", "n", "before", "size"))
    found = rows.join(directory, rows[group].eqNullSafe(directory["g"]) & (rows["word"] == directory["at"])).drop("g", "at")
    single = F.col("n") == F.bit_count("bits")
    below = F.bit_count(F.expr(f"bits & ~shiftleft(-1L, {place_in_word})"))
    alone = found.where(single).withColumn("slot", F.col("before") + below)
    if directory.where(~single).limit(1).count():
        place = Window.partitionBy(group, "word").orderBy(F.col(key).asc_nulls_first(), tie)
        tied = found.where(~single).withColumn("slot", F.col("before") + F.row_number().over(place) - 1)
        alone = alone.unionByName(tied)
    return alone.drop("word", "bits", "n", "before")


def level_up(nodes: list[str], fan: int) -> list[str]:
    """The digests of every ``fan`` consecutive nodes; the last run may be shorter, even one node."""
    return [digest(*nodes[k: k + fan]) for k in range(0, len(nodes), fan)]


def levels_of(nodes: list[str], depth: int, fan: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(depth):
        out.append(level_up(out[-1], fan))
    return out


def round_depth(fan: int, block: int = BLOCK) -> int:
    """Levels of one round: as many as a block of at most ``block`` nodes has."""
    d = 1
    while fan ** (d + 1) <= block:
        d += 1
    return d


def _depth(size: int, fan: int, most: int) -> int:
    """Levels that a round takes from a group of ``size`` nodes."""
    d = 0
    while size > 1 and d < most:
        size = -(-size // fan)
        d += 1
    return d


def path_of(levels: list[list[str]], slot: int, fan: int) -> str:
    """For each level the digests of the run's other nodes, with a dot in place of the own node, ended by a slash."""
    out = []
    for nodes in levels[:-1]:
        lo = slot - slot % fan
        run = nodes[lo: lo + fan]
        run[slot - lo] = "."
        out.append("".join(run) + "/")
        slot //= fan
    return "".join(out)


def fold(node: str, path: str) -> str:
    """The root that a node and its siblings give."""
    for run in path.split("/")[:-1]:
        node = digest(run.replace(".", node))
    return node


def _reduce(fan: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        slots, nodes = _array(table)
        depth = _depth(table.column("size")[0].as_py(), fan, most)
        top = levels_of(nodes, depth, fan)[-1]
        return pa.table({"grp": table.column("grp")[:1], "block": table.column("block")[:1], "node": pa.array(top[:1])})

    return run


def _array(table: pa.Table) -> tuple[list[int], list[str]]:
    """The slots of the rows in their block, and the block's nodes, each at its slot."""
    block = table.column("block")[0].as_py() * table.column("width")[0].as_py()
    slots = [s - block for s in table.column("slot").to_pylist()]
    nodes: list[str] = [""] * len(slots)
    for s, n in zip(slots, table.column("node").to_pylist(), strict=True):
        nodes[s] = n
    return slots, nodes


def _paths(fan: int, most: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        """The path of each node to the very top: through its block, and then the block's own."""
        slots, nodes = _array(table)
        levels = levels_of(nodes, _depth(table.column("size")[0].as_py(), fan, most), fan)
        up = above.column("path")[0].as_py()
        return pa.table({
            "grp": table.column("grp"), "slot": table.column("slot"), "path": pa.array([path_of(levels, s, fan) + up for s in slots])})

    return run


def _prove(fan: int, most: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        if table.num_rows == 0 or above.num_rows == 0:
            raise ValueError("a block of leaves has no path")
        slots, nodes = _array(table)
        levels = levels_of(nodes, _depth(table.column("size")[0].as_py(), fan, most), fan)
        up, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        proofs, folded = [], []
        for s, own, other in zip(slots, table.column("node").to_pylist(), table.column("tampered").to_pylist(), strict=True):
            path = path_of(levels, s, fan) + up
            proofs.append(digest(path.replace(".", "").replace("/", "")))
            folded.append(fold(other or own, path))
        n = len(slots)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": table.column("node"), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])})

    return run


def _blocked(nodes: DataFrame, fan: int, most: int) -> DataFrame:
    width = fan**most
    return nodes.withColumn("width", F.lit(width)).withColumn("block", F.expr(f"slot div {width}L"))


def _tower(nodes: DataFrame, fan: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocked nodes of each round, and (grp, node) of the tops; ``nodes`` has grp, slot, size and node."""
    rounds = []
    while True:
        here = _blocked(nodes, fan, most)
        rounds.append(here)
        up = here.groupBy("grp", "block").applyInArrow(_reduce(fan, most), "grp bigint, block bigint, node string")
        width = fan**most
        sizes = here.select("grp", F.col("size").alias("was")).distinct()
        up = cut(up.join(sizes, "grp").select("grp", F.col("block").alias("slot"), F.expr(f"(was + {width - 1}L) div {width}L").alias("size"), "node"))
        if up.where("size > 1").limit(1).count() == 0:
            return rounds, up.select("grp", "node")
        nodes = up


def _down(rounds: list[DataFrame], paths: DataFrame, fan: int, most: int) -> DataFrame:
    """(grp, slot, path) for the blocks of the first round, from (grp, path) of the tops."""
    above = paths.select("grp", F.lit(0).cast("long").alias("block"), "path")
    for here in reversed(rounds[1:]):
        found = here.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_paths(fan, most), "grp bigint, slot bigint, path string")
        above = cut(found.select("grp", F.col("slot").alias("block"), "path"))
    return above


def merkle_manifest(docs: DataFrame, tamper: Column | None = None, fan: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each document.

    A leaf is the digest of the five fields, each as byte count and value. Leaves of one ``lang`` ascend by doc_id;
    every ``fan`` consecutive nodes become their digest until one is left. The tops, ordered by lang (null first, by
    bytes), are reduced in the same way. ``proof_sha256`` is the digest of all siblings from the leaf to the root;
    ``folded_root`` is what these and the leaf give, where ``tamper`` holds with n_chars one larger.
    Null fields count as a dash, a null doc_id comes first, empty texts have length zero. Rows of one
    lang and doc_id are leaves of their own, ordered by digest; equal rows so share digests but have proofs of their own.
    Other columns are left out. Empty tables give no rows. Texts are read once and not shuffled. More than
    MAX_LANGS langs raise an error.
    """
    spark = docs.sparkSession
    ship(spark)
    most = round_depth(fan, block)
    rows = narrow(docs, *LEAF_COLUMNS)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    wrong = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False))
    leaves = cut(rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_digest(F.col("n_chars")).alias("node"),
        F.when(wrong & F.col("n_chars").isNotNull(), leaf_digest(F.col("n_chars") + 1)).alias("tampered")))
    langs = cut(leaves.select("lang").distinct())
    n_langs = langs.count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"{n_langs} different langs; {MAX_LANGS} at most")
    order = Window.orderBy(F.col("lang").asc_nulls_first())
    names = langs.select("lang", (F.row_number().over(order) - 1).cast("long").alias("grp"))
    named = leaves.join(F.broadcast(names.withColumnRenamed("lang", "name")), F.col("lang").eqNullSafe(F.col("name"))).drop("lang", "name")
    placed = cut(bitmap_ranks(named, "grp", "doc_id", "node"))
    rounds, tops = _tower(placed.select("grp", "slot", "size", "node", "doc_id", "tampered"), fan, most)
    over, root = _tower(tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("slot"), F.lit(n_langs).cast("long").alias("size"), "node"), fan, most)
    start = root.select("grp", F.lit("").alias("path"))
    first = over[0].groupBy("grp", "block").cogroup(_down(over, start, fan, most).groupBy("grp", "block")).applyInArrow(_paths(fan, most), "grp bigint, slot bigint, path string")
    tops_path = cut(first.select(F.col("slot").alias("grp"), "path"))
    above = _down(rounds, tops_path, fan, most)
    top = root.first()
    above = above.join(tops.select("grp", F.col("node").alias("subroot")), "grp").withColumn("root", F.lit(top["node"] if top else None).cast("string"))
    kind = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = rounds[0].groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_prove(fan, most), kind)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
