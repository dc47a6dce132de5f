"""License scans against unbanded alignment of every template with every text."""

import random

import numpy as np

from weft.llm import licenses as L


def telling(words):
    return {w for w in words if w in L.TELLING or (L.is_version(w))}


def brute(text):
    """Names of the licenses whose notices align with a text by a whole table of local alignment scores, and tell the same."""
    words, out = L.WORD.findall(text.lower()), set()
    for name, notice in L.TEMPLATES:
        wanted = L.WORD.findall(notice.lower())
        if len(set(wanted) & set(words)) < 0.5 * len(set(wanted)):
            continue
        last, best = [(0, 0, None)] * (len(words) + 1), (0, 0, None, None)
        for w in wanted:
            row = [(0, 0, None)]
            for j, x in enumerate(words):
                s, m, at = last[j]
                cell = (s + L.MATCH, m + 1, j if not s else at) if x == w else (s + L.MISMATCH, m, at)
                cell = max(cell, (last[j + 1][0] + L.GAP, *last[j + 1][1:]), (row[j][0] + L.GAP, *row[j][1:]), key=lambda c: c[0])
                row.append(cell if cell[0] > 0 else (0, 0, None))
                if cell[:2] > best[:2]:
                    best = (*cell, j + 1)
            last = row
        if best[1] >= L.COVERAGE * len(wanted) and telling(words[best[2] : best[3]]) == telling(wanted):
            out.add(name)
    return out


def test_table_against_full_alignment(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("n_chars < 3000")
    got = {}
    for r in L.license_matches(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.coverage >= L.COVERAGE
    for r in docs.select("doc_id", "text").collect():
        want = brute(r.text)
        assert bool(want) == (r.doc_id in got) and got.get(r.doc_id, set()) <= want


def test_other_versions_and_relatives_are_named_right_or_not_at_all():
    index = L.Index(L.TEMPLATES)
    names = lambda text: [r[0] for r in L.scan(text, index)]
    assert names("Released under the BSD 2-Clause License.") == ["BSD-2-Clause"]
    assert names("Licensed under CC BY 3.0.") == ["CC-BY-3.0"]
    assert names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 2.1.") == ["LGPL-2.1"]
    assert names("This work is licensed under the GNU General Public License, version 1.") == ["GPL-1.0"]
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.") == ["CC-BY-NC-ND-4.0"]
    assert names("Licensed under the Academic License, Version 2.0.") == []
    assert names("This work is licensed under the GNU General Public License, version 7.") == []
    assert names("Licensed under CC BY 4.5.") == [] and names("Licensed under the Apache License, Version 2.0.1.") == []
    bsd = dict((n, t) for n, t in L.TEMPLATES if n.startswith("BSD") and len(t) > 99)
    assert names(bsd["BSD-2-Clause"]) == ["BSD-2-Clause"] and names(bsd["BSD-3-Clause"]) == ["BSD-3-Clause"]


def test_edited_notices_spans_and_repeats(spark):
    rng = random.Random(4)
    filler = " ".join(f"w{rng.randrange(999)}" for _ in range(300))
    mit = L.TEMPLATES[3][1].replace("free of charge", "entirely free of any charge").replace("merge, ", "")
    apache = L.TEMPLATES[5][1].upper()
    texts = [f"{filler}\n{mit}\n{filler}", f"{apache} {filler} {apache}", "licensed under", None, "", "Licensed under CC BY-NC 4.0.\n" * 3, "İ Released under the MIT License. İ", filler, " ".join(f"the {w} of" for w in filler.split())]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[5])], "doc_id long, text string").selectExpr("*", "1 as license", "2 as start")
    out = {}
    for r in L.license_matches(docs).orderBy("start").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [r.license for r in out[0]] == ["MIT"] and out[0][0].snippet.startswith("Permission is hereby") and out[0][0].snippet.endswith("of the Software")
    assert [r.license for r in out[1]] == ["Apache-2.0"] * 2 and out[1][0].coverage == 1.0 and out[1][0].start == 0
    assert [r.license for r in out[5]] == ["CC-BY-NC-4.0"] * 3 and [r.license for r in out[6]] == ["MIT"]
    assert len(out[None]) == 3 and set(out) == {0, 1, 5, 6, None}
    assert L.license_matches(docs.limit(0)).count() == 0


def test_shared_run_shares_a_fingerprint():
    index = L.Index(L.TEMPLATES)
    ids = index.words[3]
    for a in range(0, len(ids) - 4):
        at, h = index.winnow(np.array([0, 0] + ids[a : a + L.GRAM + L.WINDOW - 1] + [0]))
        assert np.isin(h, index.hashes).any()


def test_back_to_back_notices():
    index = L.Index(L.TEMPLATES)
    for name, notice in L.TEMPLATES:
        for text in (f"{notice}\n" * 5, f"{notice} of " * 4, f"{notice}\nand\n{notice}"):
            n = text.count(notice)
            rows = L.scan(text, index)
            spans = [text[a:b] for *_, a, b in rows]
            assert [r[0] for r in rows] == [name] * n and len({x.lower() for x in spans}) == 1, (name, rows)
    mixed = "Released under the MIT License.\nLicensed under CC BY 4.0.\n" * 200
    assert [r[0] for r in L.scan(mixed, index)] == ["MIT", "CC-BY-4.0"] * 200


def test_titles_lists_short_forms_and_identifiers():
    index = L.Index(L.TEMPLATES)
    names = lambda text: [r[0] for r in L.scan(text, index)]
    assert names("Licensed under the MIT License or the Apache License, Version 2.0") == ["MIT", "Apache-2.0"]
    assert names("Dual licensed under the Apache License, Version 2.0 or the MIT license at your option.") == ["Apache-2.0", "MIT"]
    assert names("it is covered by the GNU General Public License v3.0 and more") == ["GPL-3.0"]
    assert names("you can modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.") == ["GPL-2.0"]
    assert names("See the GNU Lesser General Public License, version 2.1 for details") == ["LGPL-2.1"]
    assert names("Code is licensed under the GPLv3 here") == ["GPL-3.0"] and names("licensed under the GPL version 2.") == ["GPL-2.0"]
    for line, want in [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-only", "GPL-2.0"), ("LGPL-2.1-or-later", "LGPL-2.1"), ("BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("EUPL-1.2", "EUPL-1.2")]:
        assert names(f"// SPDX-License-Identifier: {line}\nint main") == [want], line
    assert names("# SPDX-License-Identifier: WTFPL\n") == [] and names("SPDX-License-Identifier: GPL-7.0") == []
    assert names("Released under the ISC License.") == ["ISC"] and names("MIT License\n\nCopyright (c) 2020 Someone") == ["MIT"]
    assert names("this font is licensed under the SIL Open Font License, Version 1.1.") == ["OFL-1.1"]
    assert names("Licensed under the EUPL 1.2") == ["EUPL-1.2"] and names("released under the CC0 1.0 Universal") == ["CC0-1.0"]
    assert names("This is NOT licensed under the MIT License.") == [] and names("not licensed under the MIT License or the Apache License, Version 2.0") == []
    assert names("It is never released under the ISC License. Licensed under the MIT License.") == ["MIT"]
    assert names("the license or the general public, version of the terms, under the boost") == []


def test_every_template_names_its_own_license():
    index = L.Index(L.TEMPLATES)
    for name, text in L.TEMPLATES:
        assert [r[0] for r in L.scan(f"Some words. {text} More words", index)] == [name], text
