"""Template automata against regular expressions."""

import itertools
import re

import numpy as np
import pytest

from panelseq.llm import licenses as L


def pattern(template):
    out = []
    for m in L._PART.finditer(template):
        p = m.group()
        out.append("(?:" if p == "[[" else ")?" if p == "]]" else rf"(?:\S+ ){{{m.group(1)},{m.group(2)}}}" if m.group(1) else re.escape(p) + " ")
    return re.compile("".join(out))


def longest(rx, words):
    return max((n for n in range(1, len(words) + 1) if rx.fullmatch(" ".join(words[:n]) + " ")), default=-1)


@pytest.mark.parametrize("template", ["a [[b [[c]] d]] e", "a {{x:0-2}} b", "a {{x:1-3}} b [[c]] {{y:1-1}}", "a [[b]] [[c]] d", *L.TEMPLATES.values()])
def test_automaton_equals_regular_expression(template):
    a, rx = L.Automaton(template), pattern(template)
    own = sorted(set(re.findall(r"[a-z0-9]+", re.sub(r"\{\{.*?\}\}", "", template))))
    rng = np.random.default_rng(1)
    for n in range(1, 5 if len(own) > 5 else 7):
        tries = itertools.product([*own[:5], "z"], repeat=n) if len(own) <= 5 else [rng.choice([*own, "z"], 12).tolist() for _ in range(200)]
        for w in itertools.islice(tries, 3000):
            h = np.array([L.word_hash(x) for x in w], np.uint64)
            assert a.longest(h, 0, len(h)) == longest(rx, list(w)), w


def test_bad_templates():
    for t in ("[[a]]", "{{x:1-2}} a", "a [[b"):
        with pytest.raises(ValueError):
            L.Automaton(t)


def test_rows(spark):
    texts = [None, "", "...", "CC-BY 4.0, cc by", "All Rights\nReserved. all rights", "licensed under the Apache License, Version 2.0.",
             "This is licensed under the terms of the GNU General Public License", "Licensed under CC BY-NC 4.0", "copyright (c) 2020 Ann B. All rights reserved",
             "general public", "x " * 50_000 + "cc by", "écc by ccé by", "licensed under the apache license version 3"]
    df = spark.createDataFrame([(k, t, "l", 1.0) for k, t in enumerate(texts)] + [(None, "cc by", "l", 1.0), (3, "cc by", "l", 1.0)], "doc_id long, text string, labels string, score double")
    got = {(r.doc_id, r.n_words): r for r in L.license_scan(df).collect()}
    assert len(got) == df.count()
    view = {k[0]: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for k, r in got.items() if k != (3, 2)}
    nothing = (0, None, None, "", "", 0.0)
    assert view[0] == view[1] == view[2] == view[9] == view[11] == view[12] == nothing
    assert view[3] == (2, 0, 4, "cc-by", "cc-by", 0.5)
    assert view[4] == (1, 0, 0, "reserved", "reserved", 0.5)
    assert view[5] == (0, None, None, "", "apache-2.0-notice", 1.0)
    assert view[6] == (1, 9, 9, "gpl", "gpl,gpl-notice", 1.0)
    assert view[7] == (1, 2, 2, "cc-by", "cc-by,cc-notice", 1.0)
    assert view[8] == (1, 5, 5, "reserved", "copyright-notice,reserved", 1.0)
    assert view[10] == (1, 50_000, 50_000, "cc-by", "cc-by", 0.5)
    assert L.license_scan(df.limit(0)).count() == 0
