import re
import textwrap

import numpy as np

from loamline.llm import license_scan as ls
from loamline.llm.license_templates import TEXTS, templates


def test_templates_find_themselves():
    for name, text in templates():
        got = ls.classify(text)
        assert got[2] and got[0] == name, (name, text[:60], got)


def test_variants():
    mit = TEXTS["MIT"].replace("to deal in", "to  deal\nin").replace("persons", "people")
    assert ls.classify(mit)[:1] == ("MIT",) and ls.classify(mit)[2] and ls.classify(mit)[3:] == (["persons"], ["people"])
    assert ls.classify("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0"
    assert not ls.classify("Licensed under CC BY-XX 9.0.")[2]
    assert not ls.classify("A licence to print money is what the copyright office gave the warranty clerk.")[2]


def test_blocks():
    text = "Some prose. More prose here.\nLicensed under the Apache License, Version 2.0.\nOther text follows. And more."
    (s, e), = ls.candidate_blocks(text)
    assert text[s:e] == "Licensed under the Apache License, Version 2.0."
    long = "word " * 50_000 + "\n" + TEXTS["MIT"] + "\n" + "word. " * 1000
    (s, e), = ls.candidate_blocks(long)
    assert long[s:e] == TEXTS["MIT"] and ls.classify(long[s:e])[2]


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-rights-reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = sorted((r.doc_id, lines[x]) for r in docs.collect() for x in r.text.split("\n") if x in lines)
    got = sorted((r.doc_id, r.license) for r in ls.scan_licenses(docs).filter("confirmed").collect())
    assert got == want
    loose = {r.doc_id for r in docs.collect() if re.search(ls.CUE, r.text)}
    assert {r.doc_id for r in ls.scan_licenses(docs).collect()} == loose


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "no such words"), (None, "Released under MIT."), (4, "Released under MIT."), (4, "Released under MIT."), (5, "x\n" * 9 + "All rights reserved.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, start int")
    got = sorted(((r.doc_id, r.license, r.confirmed, r.start) for r in ls.scan_licenses(df).collect()), key=str)
    assert got == sorted([(None, "MIT", True, 0), (4, "MIT", True, 0), (4, "MIT", True, 0), (5, "All-rights-reserved", True, 18)], key=str)
    assert ls.scan_licenses(df.limit(0)).collect() == []


def test_templates_in_documents(spark):
    """Every template in a document, verbatim, wrapped, and wrapped in a comment."""
    rows, want = [], {}
    for name, text in templates():
        for form in (text, "\n".join(textwrap.wrap(text, 72)), "\r\n".join(textwrap.wrap(text, 30, break_long_words=False)), "\n".join(f" * {x}" for x in textwrap.wrap(text, 72))):
            want[len(rows)] = name
            rows.append((len(rows), f"A first line of prose.\n\n{form}\n\nA last line of prose. And one more."))
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("confirmed").collect()}
    assert {k: r.license for k, r in got.items()} == want
    assert not any(r.missing or r.extra for r in got.values())
    texts = [text for _, text in templates() for _ in range(4)]
    assert all(ls.words(t[got[k].start : got[k].end]) == ls.words(texts[k]) for k, t in rows)


def test_other_wording_nearby():
    """What else a block holds doesn't change a notice's verdict."""
    before = ("", "Copyright 2021 Example Corp.\n", "Copyright (c) 2021 Jane Doe and the other contributors. ", "The warranty of the vendor is void. Some prose stands here, too. Copyright 2019, 2020 and 2021 by several people.\n")
    for name, text in templates():
        alone = ls.classify(text)
        for x in before:
            for after in ("", "\nSee the LICENSE file for details."):
                d = x + text + after
                got = [r for r in ls.rows(d, ls.candidate_blocks(d)) if r[5]]
                assert [r[3:] for r in got] == [alone], (name, d)
    # An unconfirmed notice, too, keeps its template beside other wording.
    assert ls.classify("Licensed under CC BY-XX 9.0.")[0]
    assert ls.classify("The warranty of the vendor is void. Copyright 2019, 2020 and 2021 by several people, who wrote much prose. Licensed under CC BY-XX 9.0.")[0]


def test_several_licences(spark):
    """Each licence of a block has a row, and so has wording that no template confirms."""
    wrapped = "\n".join(textwrap.wrap(TEXTS["Apache-2.0"], 72))
    docs = [
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT"]),
        (f"Copyright (c) 2021 Jane Doe. All rights reserved.\n{TEXTS['MIT']}\n{wrapped}", ["All-rights-reserved", "Apache-2.0", "MIT", None]),
        (f"{TEXTS['BSD-3-Clause']}\n{TEXTS['BSD-2-Clause']}\n{TEXTS['BSD-3-Clause']}", ["BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause"]),
        ("Released under MIT. " * 3 + "This vendor sells a licence to print money, not to lend it.", ["MIT", "MIT", "MIT", None]),
        ("\n".join(text for _, text in templates()), [name for name, _ in templates()]),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string")
    got = ls.scan_licenses(df).collect()
    for k, (t, want) in enumerate(docs):
        mine = sorted((r.start, r.end) for r in got if r.doc_id == k)
        assert sorted((r.license if r.confirmed else None for r in got if r.doc_id == k), key=str) == sorted(want, key=str)
        assert all(e <= s for (_, e), (s, _) in zip(mine, mine[1:]))


def test_long_block():
    """A licence behind any number of sentences with licence wording is found, and its block isn't cut."""
    text = "This vendor sells a licence to print money. " * 1500 + TEXTS["MIT"] + " That licence is void." * 500
    (block,) = ls.candidate_blocks(text)
    assert block == (0, len(text))
    (hit,) = [r for r in ls.rows(text, [block]) if r[5]]
    assert hit[3] == "MIT" and ls.words(text[hit[1] : hit[2]]) == ls.words(TEXTS["MIT"])


def indel_costs(want, have):
    """By all windows: the least words that differ between ``want`` and a window of ``have`` that ends at each place."""
    least = [len(want)] * (len(have) + 1)
    for s in range(len(have) + 1):
        row = list(range(len(want) + 1))
        least[s] = min(least[s], row[-1])
        for e in range(s, len(have)):
            new = [row[0] + 1]
            for i, w in enumerate(want):
                new.append(row[i] if w == have[e] else 1 + min(row[i + 1], new[i]))
            row = new
            least[e + 1] = min(least[e + 1], row[-1])
    return least


def test_wordings_against_all_windows(monkeypatch):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 12, 26), rng.integers(0, 12, 40), rng.integers(0, 12, 4)]
    has = np.stack([np.bincount(x, minlength=12) for x in ids])
    may = [3, 4, 0]
    monkeypatch.setattr(ls, "_wordings", lambda: ({}, ids, has, may))
    monkeypatch.setattr(ls, "CHUNK", 37)  # so that wordings lie over the ends of chunks
    found = 0
    for _ in range(25):
        parts = [rng.integers(-1, 12, rng.integers(0, 30))]
        for k in rng.integers(0, 3, 3):
            x = ids[k].tolist()
            for _ in range(rng.integers(0, 6)):
                at = int(rng.integers(0, len(x)))
                x[at : at + int(rng.integers(0, 2))] = [int(rng.integers(0, 12))] * int(rng.integers(0, 2))
            parts += [np.array(x, np.int64), rng.integers(-1, 12, rng.integers(0, 20))]
        have = np.concatenate(parts).astype(np.int64)
        got = {}
        for score, k, s, e, missing, extra in ls.wordings(have):
            cost = len(missing) + len(extra)
            assert score == len(ids[k]) - 2 * len(missing) - len(extra) and cost <= may[k]
            assert [w for i, w in enumerate(ids[k].tolist()) if i not in missing] == [have[j] for j in range(s, e) if j not in extra]
            got.setdefault(k, []).append((e, cost))
        for k, want in enumerate(ids):
            least = indel_costs(want.tolist(), have.tolist())
            near = [e for e, c in enumerate(least) if c <= may[k]]
            # Each run of ends that are near enough has a window in the result, the best of the run (or of its part in a chunk).
            runs = [r for r in np.split(np.array(near, int), np.flatnonzero(np.diff(near) > 1) + 1) if len(r)]
            ends = dict(got.get(k, []))
            assert all(least[e] == c for e, c in ends.items())
            for run in runs:
                assert any(e in ends and least[e] == min(least[x] for x in run) for e in run.tolist()), (k, run, ends)
            found += len(runs)
    assert found > 30


def test_identifiers_and_terms():
    for text, want in [("// SPDX-License-Identifier: Apache-2.0\nint main() {}", "Apache-2.0"), ("License: GPL-3.0-only", "GPL-3.0-only"), ("It is distributed under the terms of the MIT license.", "MIT"),
                       ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later")]:
        got = [(r[3], r[5]) for r in ls.rows(text, ls.candidate_blocks(text)) if r[5]]
        assert got == [(want, True)], (text, got)


def test_every_template_has_a_cue_and_ranks_first_on_itself():
    for k, (name, text) in enumerate(ls.templates()):
        assert ls._CUE.search(text), name
        first = ls.ranking(text)[0]
        assert ls.templates()[first][0].split("-")[0] == name.split("-")[0] or set(ls.words(text)) <= set(ls.words(ls.templates()[first][1])), (name, ls.templates()[first])


def test_blocks_against_the_whole_document():
    """Only candidate blocks are searched; nothing is lost against a search of all words."""
    import random

    rng = random.Random(6)
    texts = [t for _, t in ls.templates()]
    noise = "the quick brown fox jumps over a lazy dog while licences, copyright and other words pass by in no order at all".split()
    for _ in range(60):
        parts = [" ".join(rng.choice(noise) for _ in range(rng.randrange(0, 120))) for _ in range(4)]
        text = "\n".join(x for p in parts for x in (p, rng.choice(texts)))
        own = ls.places(text)
        have = np.array([ls._wordings()[0].get(w, -1) for w, _, _ in own], np.int64)
        part = ls.licences(text, own, have, ls.candidate_blocks(text))
        assert part == ls.licences(text, own, have, [(0, len(text))]) and len(part) >= 4
