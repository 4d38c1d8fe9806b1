"""Segmentations against listing all of them, and exact round trips."""

from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelseq.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary(Path(P.MODEL).read_bytes())


def every(v, text):
    """(score, ids) of all segmentations."""
    if not text:
        return [(0.0, [])]
    out = []
    for n in range(1, min(v.longest, len(text)) + 1):
        known = v.ids.get(text[:n])
        if known:
            out += [(known[1] + s, [known[0], *ids]) for s, ids in every(v, text[n:])]
    if text[0] not in v.ids:
        out += [(v.unknown + s, v.fallback(text[0]) + ids) for s, ids in every(v, text[1:])]
    return out


@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_equals_listing(vocabulary, n):
    texts = ["the end", "a▁b  c", "", "12 ab².", " x\n\ny", "日本語zz\x00", "elle ou, ab", "aaaaaaa", "The he", "  ", "\n", "_a_"]
    ids, offs, scores, more = P.Encoder(vocabulary, n).encode(texts)
    assert vocabulary.decode(ids, offs) == texts
    for k, t in enumerate(texts):
        own = ids[offs[k]: offs[k + 1]].tolist()
        ways = sorted(every(vocabulary, " " + t if t else ""), key=lambda x: -x[0])
        assert scores[k] == pytest.approx(ways[0][0]) and (ways[0][0], own) in [(pytest.approx(s), i) for s, i in ways]
        assert [m["loss"] for m in more[k]] == pytest.approx([ways[0][0] - s for s, _ in ways[1:n]])
        by = {tuple(i): s for s, i in ways}
        made = [tuple(P.apply_edits(own, m["edits"])) for m in more[k]]
        assert len({*made, tuple(own)}) == len(made) + 1
        assert [by[m] for m in made] == pytest.approx([ways[0][0] - m["loss"] for m in more[k]])


def test_ties_do_not_explode(vocabulary):
    best = vocabulary.best_n("ab" * 1500, 6)
    assert len(best) == 6 and [s for s, _ in best] == sorted((s for s, _ in best), reverse=True) and len({tuple(i) for _, i in best}) == 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), max_size=8))
def test_round_trip(vocabulary, texts):
    ids, offs, _, _ = P.Encoder(vocabulary, 2).encode(texts)
    assert vocabulary.decode(ids, offs) == texts


def test_small_cache_gives_the_same(vocabulary, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["an", "other", "le", "thndre", "of,", "x9"], 20)) for _ in range(12)]
    want = P.Encoder(vocabulary, 3).encode(texts)
    monkeypatch.setattr(P, "CACHE_UNITS", 4)
    small = P.Encoder(vocabulary, 3)
    for k, t in enumerate(texts):
        ids, _, scores, more = small.encode([t])
        assert ids.tolist() == want[0][want[1][k]: want[1][k + 1]].tolist() and scores[0] == want[2][k] and more[0] == want[3][k]


def test_table_nulls_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "The end."), (3, "The end."), (None, "▁ 　é"), (4, "Thu " * 60_000), (5, "ab" * 3000)]
    df = spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "doc_id long, text string, n_pieces int, ids array<int>")
    out = P.encode(df)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    assert all(r.n_pieces == 0 and r.score == 0 and r.alternatives == [] for r in got if r.doc_id in (1, 2))
    assert all(len(r.alternatives) == 3 for r in got if r.doc_id in (3, 4, 5))
    back = sorted((tuple(r) for r in P.decode(out).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert P.encode(df.limit(0)).count() == 0 and P.decode(out.limit(0)).count() == 0
