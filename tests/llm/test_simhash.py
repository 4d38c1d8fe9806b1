"""Fingerprints and links against plain versions."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from panelseq.llm import simhash as H
from panelseq.llm.common import forest
from panelseq.llm.components import components


def plain_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i: i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits=4):
    """id -> smallest id reachable, for (id, fingerprint) rows; null ids come last."""
    ids = [x for x, _ in fps]
    best = {k: k for k in range(len(fps))}

    def root(k):
        while best[k] != k:
            k = best[k]
        return k

    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a][1] ^ fps[b][1]).count("1") <= bits:
            x, y = root(a), root(b)
            best[max(x, y)] = min(x, y)
    low = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            low[root(k)] = min(ids[k], low.get(root(k), ids[k]))
    return [low.get(root(k)) for k in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for t in ["", None, " \t\n", "One", "a b c", "A b\x0bC d", "a b c d e f g h", "é à ü ß x", "x " * 70_000, "\x1c a b \x85 c d"]:
        assert H.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("cell_rows", [1024, 4])
def test_components_equal_all_pairs(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(H, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(4)
    fps = []
    for c in range(30):
        base = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(12):
            fps.append(base ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))))
    centre = int(rng.integers(0, 1 << 63))
    fps += [centre ^ (1 << b) for b in range(64)] + [centre, 0, 1, (1 << 64) - 1]
    fps = sorted(set(fps))
    points = spark.createDataFrame([(signed(f), k) for k, f in enumerate(fps)], "w0 long, rep long").repartition(4)
    links = H.near_links(points).collect()
    assert all(bin(fps[r.a] ^ fps[r.b]).count("1") <= 4 * 64 for r in links)
    found = {r.id: r.component for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"), "a", "b").collect()}
    assert [found.get(k, k) for k in range(len(fps))] == plain_components(list(enumerate(fps)))


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, "one"), (1004, "ONE"), (1004, "one"), (None, "one"), (None, "nothing like it here at all")]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, w0 int, component_id string").repartition(3)
    got = sorted(((r.doc_id, r.w0, r.component_id) for r in H.simhash_components(df, 4).collect()), key=str)
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(((i, signed(f), c) for (i, f), c in zip(fps, plain_components(fps), strict=True)), key=str)
    assert got == want
    kept = H.near_duplicates_removed(df)
    assert kept.columns == df.columns and kept.where("doc_id in (1003, 1004)").count() == 1 and kept.where("doc_id is null").count() == 2
    assert H.simhash_components(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_forest():
    a, b = forest(np.array([5, 7, 9, 2]), np.array([7, 9, 5, 3]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 2), (7, 5), (9, 5)]


def test_near_copies_of_the_filter(spark):
    rng = np.random.default_rng(11)
    pool = [f"word{k}" for k in range(3000)]
    rows, want = [], {}
    for k in range(40):
        base = rng.choice(pool, 200).tolist()
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for at in rng.choice(200, 3, replace=False):
                copy[at] = "changed"
            rows.append((10 * k + c, " ".join(copy)))
            want[10 * k + c] = 10 * k
    rows += [(1000 + k, " ".join(rng.choice(pool, 150))) for k in range(200)] + [(2000, "a b c"), (2001, "a b d"), (2002, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in H.near_duplicates(df).collect()}
    assert all(got[i] == i for i, _ in rows if i not in want and i != 2002) and got[2002] == 2000
    assert sum(got[i] == c for i, c in want.items()) >= 118


def test_near_copies_are_those_of_similarity_four_fifths(spark):
    """Pairs about the limit, chains and a large group: components of the exact similarity, no more and no less."""
    rng = np.random.default_rng(12)
    pool = [f"word{k}" for k in range(5000)]
    texts = []
    for k in range(120):
        base = rng.choice(pool, 300).tolist()
        copy = list(base)
        for at in np.linspace(10, 280, 3 + k % 12).astype(int):
            copy[at] = "changed"
        texts += [base, copy]
    core = rng.choice(pool, 100).tolist()
    texts += [[*core, *rng.choice(pool, 10 + k % 30).tolist()] for k in range(120)]
    # A group in which many are alike to the middle and not to each other.
    middle = rng.choice(pool, 160).tolist()
    for k in range(150):
        copy = list(middle)
        for at in rng.choice(160, 1 + k % 9, replace=False):
            copy[at] = f"own{k}"
        texts.append(copy)
    rows = list(enumerate(" ".join(t) for t in texts))
    sets = [set(zip(*(t[j:] for j in range(5)))) for t in texts]
    best = list(range(len(rows)))

    def root(k):
        while best[k] != k:
            k = best[k]
        return k

    linked = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            best[max(x, y)] = min(x, y)
            linked += 1
    assert 100 < linked and len({root(k) for k in range(240)}) > 150
    got = {r.doc_id: r.component_id for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: root(k) for k in range(len(rows))}


def test_removal_goes_by_row(spark):
    """Of one id with two texts only the copy goes, of repeated rows one stays, and null ids stay."""
    words = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(1, words[0]), (2, words[0]), (2, words[1]), (3, words[2]), (3, words[2]), (None, words[0]), (None, words[0])]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, part int, first string").repartition(3)
    left = H.near_duplicates_removed(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text[:1]) for r in left.collect()) == [("1", "a"), ("2", "b"), ("3", "c"), ("None", "a"), ("None", "a")]
    assert H.near_duplicates_removed(df.limit(0)).count() == 0
