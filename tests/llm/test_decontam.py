"""Spaced seeds against comparing every window with every window."""

import itertools
import re

import numpy as np
import pytest

from panelseq.llm import decontam as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def plain(docs, items):
    """Every aligned window of every pair; items of the same id and text count once."""
    out = {}
    for (d, t), (i, q) in itertools.product(docs, sorted({x for x in items if x[0] is not None}, key=str)):
        a, b = words(t), words(q)
        if d is None or len(b) < 5:
            continue
        w = min(13, len(b))
        allowed = 2 if len(b) >= 13 else 1 if len(b) >= 8 else 0
        for p, s in itertools.product(range(len(a) - w + 1), range(len(b) - w + 1)):
            subs = sum(x != y for x, y in zip(a[p: p + w], b[s: s + w], strict=True))
            if subs <= allowed:
                n, least, first = out.get((d, i), (0, 99, 10**9))
                out[d, i] = (n + 1, min(least, subs), min(first, p))
    return sorted((*k, *v) for k, v in out.items())


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "item_id", "n_windows", "substitutions", "first_word").collect())


def test_masks_meet_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(all(o + p not in bad for p in m) for m in D.MASKS for o in range(D.WINDOW - m[-1]))
    for n in range(D.SHORT_SUBSTITUTION, D.WINDOW):
        assert all(any(all(o + p != bad for p in D.SHORT_MASK) for o in range(n - 3)) for bad in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "straße"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(n)) for k, n in enumerate([30, 13, 12, 9, 8, 7, 5, 4, 1, 60])] + [(20, None), (21, ""), (None, text(20)), (1, text(14)), (22, "a a a a a a a a a a a a a a a")]
    docs = []
    for k in range(120):
        q = items[k % 10][1].split()
        for at in rng.integers(0, len(q), int(rng.integers(0, 4))):
            q[at] = "other"
        docs.append((k, f"{text(int(rng.integers(0, 30)))} {', '.join(q).upper()}! {text(int(rng.integers(0, 30)))}"))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "a " * 300), (3, docs[3][1]), (203, "b " * 5000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 40])
def test_equals_all_windows(spark, tables, block_words):
    docs, items = tables
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame([(*i, 2, "x") for i in items], "item_id long, text string, doc_id int, words string")
    got = found(D.contamination(left, right, block_words))
    want = plain(docs, items)
    assert got == want and len({r[0] for r in got}) > 40
    kept = D.decontaminated(left, right)
    assert kept.columns == left.columns
    bad = {r[0] for r in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_long_item_and_empty_tables(spark):
    rng = np.random.default_rng(8)
    long = [f"t{x}" for x in rng.integers(0, 10**6, 3000)]
    docs = spark.createDataFrame([(1, " ".join(long[1015:1040])), (2, " ".join(long[2040:2053]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(long))], "item_id long, text string")
    assert found(D.contamination(docs, items)) == [(1, 7, 13, 0, 0), (2, 7, 1, 0, 0)]
    assert D.contamination(docs.limit(0), items).count() == 0 and D.contamination(docs, items.limit(0)).count() == 0


def test_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = found(D.contamination(docs, items))
    hit = {r[0] for r in got}
    some = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id in hit or r.doc_id < 40]
    assert got == plain(some, [tuple(r) for r in items.select("item_id", "text").collect()]) and got
