import random
import re
from collections import Counter

from helpers import corpus, documents

from sievework.llm import licenses


SHORT = {name: [t for t in ts if len(t) < 600] for name, ts in licenses.TEMPLATES.items()}


def brute(text, templates, threshold=0.8):
    """Every passage of every length against every template; of those that overlap the heaviest counts."""
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    grams = list(zip(ws, ws[1:]))
    found = []
    for name, ts in templates.items():
        for t in ts:
            tw = re.findall(r"[^\W_]+", t.lower())
            have = Counter(zip(tw, tw[1:]))
            for i in range(len(grams)):
                seen, shared, best = Counter(), 0, None
                for j in range(i, len(grams)):
                    seen[grams[j]] += 1
                    shared += seen[grams[j]] <= have[grams[j]]
                    score = 2 * shared / (j - i + 1 + len(tw) - 1)
                    if score >= threshold and (best is None or score > best[1]):
                        best = (-shared * score, score, name, i, j - i + 2)
                if best and have[grams[i]]:
                    found.append((best[0], -best[1], *best[2:]))
    kept = []
    for _, score, name, i, n in sorted(found):
        if all(i + n <= a or a + m <= i for _, _, a, m in kept):
            kept.append((name, -score, i, n))
    return sorted(kept, key=lambda m: m[2])


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = corpus(20)[:20]
    filler = "lorem ipsum the of license under and a public released".split()
    for i in range(60):
        parts = []
        for _ in range(rng.choice([1, 1, 2])):
            ws = rng.choice(SHORT[rng.choice(list(SHORT))]).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                ws[rng.randrange(len(ws))] = rng.choice(filler)
            if rng.random() < 0.3:
                ws.insert(rng.randrange(len(ws)), "inserted words")
            parts += [" ".join(ws[: rng.choice([len(ws), len(ws), len(ws) * 3 // 4])]), " ".join(rng.choices(filler, k=rng.randint(0, 12)))]
        rows.append((100 + i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(500, None), (501, ""), (502, "license"), (500, None), (None, "All rights reserved.")]
    got = {}
    for r in licenses.scan(documents(spark, rows), templates=SHORT).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["similarity"], 9), r["first_word"], r["n_words"]))
    for i, t in rows:
        expected = [(n, round(s, 9), a, m) for n, s, a, m in brute(t, SHORT)]
        assert sorted(got.get(i, [])) == sorted(expected), (i, t)


def test_shorter_passages_and_several_licences():
    known = licenses.Templates(licenses.TEMPLATES)
    assert [m[0] for m in known.matches("all our sources are licensed under the MIT and others")] == ["MIT"]
    gpl3, gpl2 = licenses.TEMPLATES["GPL-3.0"][1], "This work is licensed under GNU General Public License version 2"
    assert [m[0] for m in known.matches(f"{gpl3} and elsewhere some more words. {gpl2}")] == ["GPL-3.0", "GPL-2.0"]
    twice = "Released under the MIT License. " + "word " * 30 + "Released under the MIT License."
    assert [m[0] for m in known.matches(twice)] == ["MIT", "MIT"]


def test_whole_licences_inside_of_texts():
    known = licenses.Templates(licenses.TEMPLATES)
    rng = random.Random(1)
    for name, files in licenses.TEXTS.items():
        for text in licenses.TEMPLATES[name][-len(files) :]:
            ws = text.split()
            changed = [w for w in ws if rng.random() > 0.03]
            (found,) = known.matches("some words before " + " ".join(changed) + " and some after")
            assert found[0] == name and 0.9 < found[1] < 1 and found[2] == 3 and abs(found[3] - len(licenses.words(" ".join(changed)))) < 20, (name, found)


def test_bounds_and_known_notices(spark):
    known = licenses.Templates(licenses.TEMPLATES)
    assert known.bounds(9) == (6, 13)
    assert [m[0] for m in known.matches("x y\nReleased under the MIT License.\nz")] == ["MIT"]
    assert [m[0] for m in known.matches("This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0"]
    assert known.matches("the license of the work is under public discussion") == []
    assert licenses.scan(documents(spark, [])).count() == 0


def test_headers_and_spdx_lines_are_named_by_their_own_licence():
    known = licenses.Templates(licenses.TEMPLATES)
    header = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for name, what, title, version in (("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL", "library", "Lesser General Public License", "2.1"), ("LGPL", "program", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3")):
        assert [m[0] for m in known.matches("x y\n" + header.format(what, title, version) + "\nz")] == [name], (name, version)
    for name, spdx in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD", "BSD-3-Clause"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("LGPL", "LGPL-2.1-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC-BY", "CC-BY-4.0"), ("CC-BY-SA", "CC-BY-SA-4.0"), ("CC-BY-NC", "CC-BY-NC-4.0"), ("CC0", "CC0-1.0"), ("Unlicense", "Unlicense")):
        assert [m[0] for m in known.matches(f"# SPDX-License-Identifier: {spdx}\nimport x")] == [name], spdx
    for name, templates in licenses.TEMPLATES.items():
        assert all([m[0] for m in known.matches(t)] == [name] for t in templates), name
