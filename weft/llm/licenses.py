"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, whole_text

#: Words of a fingerprinted gram, and grams of a winnowing window: shared runs of GRAM + WINDOW - 1 words are found.
GRAM, WINDOW = 3, 2
#: Share of a template's fingerprints that a candidate region holds, at least one.
HITS = 0.3
#: Words that an alignment may drift from its diagonal, as a share of the template and at least.
BAND_SHARE, BAND_LEAST = 0.15, 6
#: Share of a template's words that must align.
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

WORD = re.compile(r"[^\W_]+")

# License names with notices in use for them.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0."),
    ("ECL-2.0", "Licensed under the Educational Community License, Version 2.0."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
# names and versions of families of licenses, and what their notices say of them
GNU = [("GPL", "General", "1 2 3"), ("LGPL", "Library General", "2"), ("LGPL", "Lesser General", "2.1 3"), ("AGPL", "Affero General", "3")]
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
COMMONS_VERSIONS = [("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")]
# licenses that are named by title, and the words that come before or after a title in a notice
TITLES = [
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-1.0", "Eclipse Public License, Version 1.0"), ("EPL-2.0", "Eclipse Public License, Version 2.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("BSL-1.0", "Boost Software License 1.0"),
    ("OFL-1.1", "SIL Open Font License, Version 1.1"), ("OFL-1.1", "SIL Open Font License 1.1"), ("EUPL-1.2", "European Union Public Licence, version 1.2"), ("EUPL-1.2", "European Union Public License v1.2"), ("EUPL-1.2", "EUPL 1.2"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("Artistic-2.0", "Artistic License 2.0"), ("AFL-3.0", "Academic Free License 3.0"), ("ECL-2.0", "Educational Community License 2.0"),
]
TITLE_PHRASES = ["licensed under the {}", "licensed under {}", "released under the {}", "distributed under the {}", "available under the {}", "or the {}", "and the {}", "{} Copyright (c)"]
GNU_PHRASES = [
    "the GNU {words} Public License, version {v}", "the GNU {words} Public License v{v}", "GNU {words} Public License v{v}.0", "under the terms of the GNU {words} Public License version {v}",
    "under the terms of the GNU {words} Public License as published by the Free Software Foundation, version {v}", "licensed under the {short}v{v}", "licensed under the {short} version {v}", "licensed under the {short} v{v}",
]
SPDX = "MIT ISC Zlib Unlicense BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 BSL-1.0 OFL-1.1 EUPL-1.2 CC0-1.0 Artistic-2.0 AFL-3.0 ECL-2.0".split()
# words before a notice that turn it round
NEGATIONS = frozenset("not never neither nor cannot isn aren wasn weren without".split())
# words that tell licenses apart, beside numbers: a notice names a license where both have the same of them
TELLING = (
    "mit apache academic educational artistic boost eclipse bsd mozilla gnu lesser library affero clause creative commons attribution sharealike noncommercial noderivatives noderivs "
    "cc by sa nc nd endorse unencumbered waived misrepresented isc zlib unlicense sil font european eupl cc0 gpl lgpl agpl mpl epl bsl ofl afl ecl "
    "gplv1 gplv2 gplv3 lgplv2 lgplv3 agplv3"
).split()


def notices() -> list[tuple[str, str]]:
    """(license, notice): the single ones and those of the families."""
    out = list(NOTICES)
    for short, words, versions in GNU:
        for v in versions.split():
            name = f"{short}-{v}" + ("" if "." in v else ".0")
            out.append((name, f"This work is licensed under the GNU {words} Public License, version {v}."))
            out.append((name, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {words} Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."))
            for phrase in GNU_PHRASES if "." not in v else [p for p in GNU_PHRASES if not p.endswith("{v}.0")]:
                out.append((name, phrase.format(words=words, short=short, v=v)))
            out.append((name, f"SPDX-License-Identifier: {name}"))
    for name, title in TITLES:
        out += [(name, phrase.format(title)) for phrase in TITLE_PHRASES]
    for name in SPDX:
        out.append((name, f"SPDX-License-Identifier: {name}"))
        if len(WORD.findall(name)) > 1:
            out.append((name, f"or {name}"))
    for short, words in COMMONS:
        for v, place in COMMONS_VERSIONS:
            out.append((f"CC-{short}-{v}", f"Licensed under CC {short} {v}."))
            out.append((f"CC-{short}-{v}", f"SPDX-License-Identifier: CC-{short}-{v}"))
            out.append((f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {words} {v} {place} License."))
    return [n for n in dict.fromkeys(out) if len(WORD.findall(n[1])) > GRAM]


TEMPLATES = notices()


class Index:
    """Templates as word numbers, and their winnowed fingerprints in an inverted index."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        words = [WORD.findall(text.lower()) for _, text in templates]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws} | set(TELLING)))}
        telling = [i for w, i in self.vocab.items() if w in TELLING or is_version(w)]
        self.telling = frozenset(telling)
        self.words = [[self.vocab[w] for w in ws] for ws in words]
        self.told = [self.telling.intersection(ws) for ws in self.words]
        self.salt = np.array([xxhash.xxh64_intdigest(w, 7) for w in ["", *sorted(self.vocab)]], dtype=np.uint64)
        postings = []
        self.n_prints = []
        for t, ws in enumerate(self.words):
            at, h = self.winnow(np.array(ws))
            self.n_prints.append(len(at))
            postings += [(int(x), t, int(p)) for x, p in zip(h, at)]
        postings.sort()
        self.hashes = np.array([p[0] for p in postings], dtype=np.uint64)
        self.template = np.array([p[1] for p in postings])
        self.position = np.array([p[2] for p in postings])

    def winnow(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the least gram of every window, the rightmost of equal ones.

        Grams with a word that no template has take no part; in a window without them the choice is the
        same as in the template, so a run shared whole with a template shares its fingerprints.
        """
        n = len(ids) - GRAM + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                part = ids[k : k + n]
                h = h * np.uint64(0x100000001B3) + self.salt[part]
                ok &= part > 0
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h[~ok] = np.iinfo(np.uint64).max
        windows = np.lib.stride_tricks.sliding_window_view(h, min(WINDOW, n))
        least = np.unique(windows.shape[1] - 1 - windows[:, ::-1].argmin(axis=1) + np.arange(len(windows)))
        least = least[ok[least]]
        return least, h[least]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int, int, list[int]]]:
        """(template, diagonal, least and greatest diagonal of the region, words of its hits) where enough of its fingerprints lie together."""
        at, h = self.winnow(ids)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        seen = np.flatnonzero(hi > lo)
        hits: dict[int, list[tuple[int, int]]] = {}
        for k in seen:
            for p in range(lo[k], hi[k]):
                hits.setdefault(int(self.template[p]), []).append((int(at[k]) - int(self.position[p]), int(at[k])))
        out = []
        for t, found in hits.items():
            found.sort()
            need, drift = max(1, int(np.ceil(HITS * self.n_prints[t]))), band(len(self.words[t]))
            start = 0
            for k in range(1, len(found) + 1):
                if k == len(found) or found[k][0] - found[k - 1][0] > drift:
                    group = found[start:k]
                    low, high = group[0][0], group[-1][0]
                    reach = ids[max(0, low - drift) : high + drift + len(self.words[t]) + 1]
                    if len({p for _, p in group}) >= need and self.told[t] <= set(reach.tolist()):
                        out.append((t, (low + high) // 2, low, high, sorted({p for _, p in group})))
                    start = k
        return out


def is_version(word: str) -> bool:
    digits = word.removeprefix("v")
    return digits.isdecimal() and len(digits) <= 2 and digits.strip("0") != ""


def band(size: int) -> int:
    return max(BAND_LEAST, int(BAND_SHARE * size))


def align(template: list[int], ids: np.ndarray, diagonal: int, width: int, first: int = 0, stop: int | None = None) -> tuple[int, int, int]:
    """Best local alignment of a template to words near a diagonal: (words matched, first word, end word).

    Only cells whose word position is within width of template position + diagonal, and from first up to stop, are
    filled. Equal scores prefer more matches, then the earlier end.
    """
    stop = len(ids) if stop is None else stop
    zero = (0, 0, -1)
    best, last = zero, {}
    for i, w in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(first, i + diagonal - width), min(stop, i + diagonal + width + 1)):
            score, matched, start = last.get(j - 1, zero)
            if w and ids[j] == w:
                cell = (score + MATCH, matched + 1, start if score > 0 else j)
            else:
                cell = (score + MISMATCH, matched, start)
            for score, matched, start in (last.get(j, zero), row.get(j - 1, zero)):
                if score + GAP > cell[0]:
                    cell = (score + GAP, matched, start)
            if cell[0] <= 0:
                continue
            row[j] = cell
            if (cell[0], cell[1]) > (best[0], best[1]):
                best, end = cell, j + 1
        last = row
    return (best[1], best[2], end) if best[0] > 0 else (0, 0, 0)


def matches(template: list[int], ids: np.ndarray, diagonal: int, width: int, hits: list[int]) -> list[tuple[int, int, int]]:
    """(words matched, first word, end word) of the region's best alignment and of others that share no word with it or one another.

    Every hit that lies in no alignment yet is tried again among the free words around it, as far as an alignment reaches.
    """
    reach = 3 * len(template)  # an alignment has under one gap for each point of its matches
    starts: list[int] = []
    ends: list[int] = []
    found: list[tuple[int, int, int]] = []

    def add(first: int, stop: int) -> bool:
        matched, start, end = align(template, ids, diagonal, width, first, stop)
        if matched < COVERAGE * len(template):
            return False
        k = bisect_left(starts, start)
        starts.insert(k, start), ends.insert(k, end), found.append((matched, start, end))
        return True

    if not add(0, len(ids)):
        return found
    for at in hits:
        while True:
            k = bisect_right(starts, at)
            free = ends[k - 1] if k else 0
            if at < free or not add(max(free, at - reach), min(at + reach, starts[k] if k < len(starts) else len(ids))):
                break
    return found


def word_spans(text: str, n: int) -> list[tuple[int, int]]:
    spans = [m.span() for m in WORD.finditer(text)]
    # lower-casing changes the words of odd texts: count on the lower-cased one then
    return spans if len(spans) == n else [m.span() for m in WORD.finditer(text.lower())]


def named(text: str, words: list[str], ids: np.ndarray, spans: list[tuple[int, int]], start: int, end: int, telling: frozenset[int]) -> set[int]:
    """The telling words from start to end; a version goes on over its points (2.1), and what hyphens join goes on too (BY-NC)."""
    while end < len(words) and text[spans[end - 1][1] : spans[end][0]] in (".", "-") and (words[end].isdecimal() or ids[end] in telling):
        if words[end].strip("0"):
            return {-1}
        end += 1
    return telling.intersection(ids[start:end].tolist())


def scan(text: str, index: Index) -> list[tuple[str, int, float, int, int, int]]:
    """(license, template, coverage, matched words, start, end in characters) of a text, in text order.

    A match counts where its words and the template's are the same in TELLING and in version numbers, so that a notice of
    another version or another license of the family is none. A notice with a word like not within the two before it is refused, and so is
    what "or" or "and" adds to it. Of matches that share words the one of most matched words stays, then of most coverage, then of the first template.
    """
    words = WORD.findall(text.lower())
    ids = np.fromiter(map(index.vocab.get, words, [0] * len(words)), np.int64, len(words))
    found, spans = [], []
    for t, diagonal, low, high, hits in index.candidates(ids):
        template = index.words[t]
        for matched, start, end in matches(template, ids, diagonal, band(len(template)) + (high - low + 1) // 2, hits):
            spans = spans or word_spans(text, len(words))
            if index.told[t] == named(text, words, ids, spans, start, end, index.telling):
                found.append((matched, matched / len(template), t, start, end))
    kept: list[tuple] = []
    starts: list[int] = []
    ends: list[int] = []
    for m in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
        k = bisect_left(starts, m[4])
        if not k or ends[k - 1] <= m[3]:
            starts.insert(k, m[3]), ends.insert(k, m[4]), kept.append(m)
    if not kept:
        return []
    kept, refused = sorted(kept, key=lambda k: k[3]), set()
    for _, _, _, start, end in kept:  # "not under A or B" refuses both
        if NEGATIONS.intersection(words[max(0, start - 2) : start]) or (start in refused and words[start] in ("or", "and")):
            refused.add(end)
    kept = [k for k in kept if k[4] not in refused]
    return [(index.names[t], t, cov, n, spans[a][0], spans[b - 1][1]) for n, cov, t, a, b in sorted(kept, key=lambda k: k[3])]


@lru_cache(4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(list(templates))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, coverage, matched_words, start, end, snippet): a row for each license notice in the whole texts.

    start and end count code points, end is exclusive; coverage is the share of the template's words aligned;
    template is its position in the list. Null and empty texts, and texts without a notice, give no row;
    a notice repeated in a text gives a row each time. Null ids and repeated rows are kept; an empty table gives
    an empty result; other columns are ignored. templates (name, text) with under GRAM words are not found. A very long
    text costs in proportion to its words and its notices.
    """
    wanted = tuple(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(wanted)
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                rows += [(id_.as_py(), *m, text[m[-2] : m[-1]]) for m in scan(text, index)]
            types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "template", "coverage", "matched_words", "start", "end", "snippet"])

    arrow_rows(docs.sparkSession, 512)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, license string, template int, coverage double, matched_words int, start int, end int, snippet string")
