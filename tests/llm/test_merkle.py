"""Merkle manifests against a plain tree, on ids that are negative, far apart, repeated or null."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from panelseq.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fan):
    """The levels of a tree from the leaves to the top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k: k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def climb(levels, slot, fan, node):
    proof = ""
    for nodes in levels[:-1]:
        lo = slot - slot % fan
        run = nodes[lo: lo + fan]
        proof += "".join(run[: slot - lo] + run[slot - lo + 1:])
        node = h(*run[: slot - lo], node, *run[slot - lo + 1:])
        slot //= fan
    return proof, node


def plain(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fan)
    top = tree([trees[g][-1][0] for g in langs], fan)
    out = []
    for k, g in enumerate(langs):
        for slot, r in enumerate(groups[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            proof, node = climb(trees[g], slot, fan, leaf(r, 1 if bad else 0))
            rest, node = climb(top, k, fan, node)
            out.append((str(r[0]), leaf(r), trees[g][-1][0], top[-1][0], h(proof + rest), node, node == top[-1][0]))
    return sorted(out)


def got(spark, rows, fan=2, block=merkle.BLOCK):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("slot", F.lit(1)).repartition(5)
    found = merkle.merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fan, block)
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


ODD = [
    (5, "a", "en", "s", 1), (5, "b", "en", "s", 1), (5, "b", "en", "s", 1), (None, "x", "en", None, None), (None, None, "en", None, None),
    (-1, "neg", "en", "s", 3), (-(2**63), "low", "en", "s", 3), (2**63 - 1, "high", "en", "s", 4), (63, "w", "en", "s", 1), (64, "w", "en", "s", 1),
    (7, "", None, "", 0), (8, "é" * 3, "", "s", 3), (9, "long " * 20000, "zz", "s", 100000), (1 << 40, "far", "zz", "s", 3),
]


@pytest.mark.parametrize("fan", [2, 3])
def test_odd_rows(spark, fan):
    assert got(spark, ODD, fan) == plain(ODD, fan)


def test_one_leaf_and_none(spark):
    assert got(spark, ODD[:1]) == plain(ODD[:1], 2)
    assert got(spark, ODD[:1])[0][4] == h("")
    assert got(spark, []) == []


def test_blocks_of_several_rounds(spark):
    """With blocks of eight nodes a hundred leaves take three rounds."""
    rows = [(k * 37 - 900, f"t{k}", "en" if k % 10 else "fr", "s", k) for k in range(110)]
    assert merkle.round_depth(2, 8) == 3
    assert got(spark, rows, 2, 8) == plain(rows, 2)


def test_tampering_is_found(spark):
    rows = [(k, "t", "en", "s", k if k % 2 else None) for k in range(60)]
    bad = {str(k) for k in range(60) if k % 2 and zlib.crc32(str(k).encode()) % 7 == 0}
    assert bad and {r[0] for r in got(spark, rows) if not r[-1]} == bad
