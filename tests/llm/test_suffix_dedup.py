"""Removal of repeated byte strings against a plain search."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from panelseq.llm import suffix_dedup as S

LAST = 2**63 - 1


def plain(rows):
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for d, _, b in texts:
        for p in range(len(b) - 49):
            w = b[p: p + 50]
            first[w] = min(d, first.get(w, LAST))
    out = []
    for d, i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p: p + 50]] < d:
                gone[p: p + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "of", "the", "zeta", "日本"], n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    shared = words(rng, 30)
    common = "This line stands in a great many of the documents, word for word. "
    out = [(k, words(rng, 12) + shared[k % 7:] + words(rng, 9)) for k in range(20)]
    out += [(k, words(rng, 5) + common + words(rng, 25)) for k in range(20, 60)]
    out += [(60, None), (61, ""), (62, "short"), (63, "x" * 49), (64, "x" * 50), (65, "x" * 200), (66, "x" * 50)]
    out += [(70, out[3][1]), (71, out[3][1]), (72, words(rng, 4000)), (2, out[30][1]), (None, out[5][1] + "tail"), (None, words(rng, 20)), (5, out[5][1]), (5, out[5][1])]
    return out


@pytest.mark.parametrize(("hot", "spread"), [(S.HOT_FRAGMENTS, S.SPREAD_FRAGMENTS), (3, 1000), (1000, 3), (2, 2)])
def test_equals_plain_search(spark, rows, hot, spread):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(S.repeated_bytes(df, hot, spread)) == plain(rows)


def test_hot_windows_travel_packed(spark, monkeypatch):
    """No step makes a row for each window of the hot fragments; their number has no say in the rows of a step."""
    rng = np.random.default_rng(7)
    common = "This line stands in a great many of the documents, word for word, and it is longer than a window is. "
    rows = [(k, words(rng, 4) + common + words(rng, 6)) for k in range(300)]
    counts = []

    def counting(run):
        made = spark.sparkContext.accumulator(0)
        counts.append((run.__qualname__, made))

        def wrapped(batches):
            for b in run(batches):
                made.add(b.num_rows)
                yield b

        return wrapped

    monkeypatch.setattr(S, "tidy", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(S.repeated_bytes(df, 3, 3)) == plain(rows)
    lo, *_ = S.anchors(*S.text_bytes(pa.array([t for _, t in rows])))
    assert max(made.value for _, made in counts) <= len(lo), [(name, made.value) for name, made in counts]


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = found(S.repeated_bytes(docs))
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(r[2] for r in got)


def test_empty_and_extra_columns(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, text string, k int, sha string, doc int, n_chars long")
    assert S.repeated_bytes(empty).count() == 0
    df = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], empty.schema)
    assert found(S.repeated_bytes(df)) == plain(rows)
    kept = S.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    by = {r.doc_id: r for r in kept.where("doc_id in (60, 66, 70, 72)").collect()}
    assert by[60].text is None and by[66].text == "" and by[66].n_chars == 0 and by[70].text == ""
    assert by[72].n_chars in (3, len(by[72].text))


def test_intervals_and_common_prefixes():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.choice(list(b"abc"), int(rng.integers(1, 90)))) for _ in range(60)] + [b"xyzxyz" * 12] * 3
    of, j, interval = S.repeated_intervals(parts, 6)
    by = {}
    for a, b, c in zip(of, j, interval, strict=True):
        by.setdefault(c, set()).add(parts[a][b: b + 6])
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({p[i: i + 6] for p in parts for i in range(len(p) - 5)})
    assert len(of) == sum(max(0, len(p) - 5) for p in parts)

    a, b = (np.frombuffer(bytes(rng.choice(list(b"ab"), 300)) + b"\xff", np.uint8) for _ in range(2))
    orders = [S.shard_order(x, 20) for x in (a, b)]
    second, lcp = S.merge_transforms(a[orders[0] - 1], b[orders[1] - 1], 20)
    turn = [iter(orders[0]), iter(orders[1])]
    rows = [np.roll((a, b)[s], -next(turn[s]))[:20] for s in second.astype(int)]
    for x, y, n in zip(rows[:-1], rows[1:], lcp[1:], strict=True):
        differ = np.flatnonzero(x != y)
        assert n == (differ[0] if len(differ) else 20) and x.tolist() <= y.tolist()
