"""License scans by patience alignment.

Places where three words of a template follow each other in a text seed a region; there, text and template are
anchored on the words that are unique in both, the longest increasing subsequence of anchors is kept, and the gaps
between them are aligned in turn. A region's coverage is the share of the template's words that are aligned. In
notices, words that tell the licenses of a family apart have to agree, whatever the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import table

#: Published notices by license, in one or more wordings (fixed values).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    **{
        name: [
            f"This work is licensed under the GNU {kind}General Public License, version {version}.",
            f"This {noun} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep} either version {version} of the License, or (at your option) any later version.",
            f"SPDX-License-Identifier: {name}-or-later",
            f"SPDX-License-Identifier: {name}-only",
        ]
        for name, kind, version, noun, mark, sep in (
            ("GPL-2.0", "", "2", "program", ";", ";"),
            ("LGPL-2.1", "Lesser ", "2.1", "library", ";", ";"),
            ("LGPL-3.0", "Lesser ", "3", "program", ":", ","),
            ("AGPL-3.0", "Affero ", "3", "program", ":", ","),
        )
    },
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "all-rights-reserved": ["All rights reserved."],
}
#: Words that tell the licenses of a family apart, besides numbers.
MARKS = frozenset(b"lesser library affero sharealike sa noncommercial nc noderivatives noderivs nd".split())
#: Wordings of up to so many words are notices, longer ones terms.
NOTICE_WORDS = 90
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


@cache
def all_templates() -> dict[str, list[str]]:
    """The notices, and the full texts of license_texts (their names without .txt)."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for f in sorted(resources.files("postsieve.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            out.setdefault(f.name.removesuffix(".txt"), []).append(f.read_text("utf-8"))
    return out


def agrees(w: list[bytes], t: list[bytes], pairs: list[tuple[int, int]]) -> bool:
    """A notice's marks and numbers are all in the text, and the text has no other mark between."""
    if len(t) > NOTICE_WORDS:
        return True
    met, here = {t[j] for _, j in pairs}, {i for i, _ in pairs}
    return all(x in met for x in t if x in MARKS or x.isdigit()) and not any(w[i] in MARKS for i in range(pairs[0][0], pairs[-1][0]) if i not in here)


def patience(a: list[bytes], b: list[bytes], i0: int = 0, i1: int | None = None, j0: int = 0, j1: int | None = None) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), rising in both; runs that no unique word anchors are aligned at their ends alone."""
    out, todo = [], [(i0, len(a) if i1 is None else i1, j0, len(b) if j1 is None else j1)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {w: j for j, w in enumerate(b[j0:j1], j0) if cb[w] == 1 and ca.get(w) == 1}
        pairs = [(i, at[w]) for i, w in enumerate(a[i0:i1], i0) if w in at]
        tops: list[int] = []  # least last place in b of a rising run of each length
        piles: list[tuple[int, int]] = []  # (pair, the pair before) by run
        last: list[int] = []
        for n, (_, j) in enumerate(pairs):
            k = bisect_left(tops, j)
            piles.append((n, last[k - 1] if k else -1))
            tops[k:] = [j] + tops[k + 1 :] if k < len(tops) else [j]
            last[k:] = [n] + last[k + 1 :] if k < len(last) else [n]
        n, kept = last[-1] if last else -1, []
        while n >= 0:
            kept.append(pairs[n])
            n = piles[n][1]
        if not kept:
            continue
        kept.reverse()
        for (pi, pj), (qi, qj) in zip([(i0 - 1, j0 - 1), *kept], [*kept, (i1, j1)], strict=True):
            todo.append((pi + 1, qi, pj + 1, qj))
        out += kept
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], percent: int):
        self.percent = percent
        self.wordings = [(name, words_of(t.encode())) for name, texts in templates.items() for t in texts]
        self.counts = [Counter(w) for _, w in self.wordings]
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.wordings):
            grams = [tuple(w[at : at + 3]) for at in range(len(w) - 2)]
            often = Counter(grams)
            for at, g in enumerate(grams):
                if len(w) <= NOTICE_WORDS or often[g] == 1:  # a phrase of the terms that comes back would join copies in one region
                    self.grams[g].append((k, at))

    def scan(self, text: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, license, percent) in words, the best of overlapping regions of a license."""
        w = words_of(text)
        if self.grams.keys().isdisjoint(zip(w, w[1:], w[2:], strict=False)):
            return []
        shifts = defaultdict(list)
        for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
            for k, at in self.grams.get(g, ()):
                shifts[k].append(i - at)
        found = []
        for k, at in shifts.items():
            name, t = self.wordings[k]
            if 100 * len(w) < self.percent * len(t):
                continue
            slack, at = 2 + len(t) // 4, sorted(at)
            first = 0
            for n in range(1, len(at) + 1):
                if n < len(at) and at[n] - at[n - 1] <= slack:
                    continue
                low, high = at[first], at[n - 1]
                first = n
                for more in (0, slack):  # with room around it only if the bare region doesn't do
                    i0, i1 = max(0, low - more), min(len(w), high + len(t) + more)
                    if len(t) > NOTICE_WORDS and 100 * (Counter(w[i0:i1]) & self.counts[k]).total() < self.percent * len(t):
                        continue  # no alignment has more words than are in both
                    pairs = patience(w, t, i0, i1, 0, len(t))
                    if pairs and 100 * len(pairs) >= self.percent * len(t) and agrees(w, t, pairs):
                        found.append((100 * len(pairs) // len(t), len(pairs), pairs[0][0], pairs[-1][0] + 1, name))
                        break
        best: list[tuple[int, int, str, int]] = []
        for percent, _, s, e, name in sorted(found, key=lambda x: (-x[1], -x[0], x[2], x[4])):
            if not any(s < y and x < e for x, y, _, _ in best):
                best.append((s, e, name, percent))
        return sorted(best)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_licenses, and licenses: array of (start, end, license, percent) by start.

    Offsets count words (runs of letters and digits), ends exclusive; of overlapping notices the one with more aligned words stays.
    Null and empty texts have none. Repeated rows are scanned each, null doc_ids stay null, an empty table gives an
    empty result; other columns of docs are left out. Templates of under three words seed nothing.
    """
    templates = templates or all_templates()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("percent", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent)
        for batch in batches:
            found = [scanner.scan(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = [[dict(zip(("start", "end", "license", "percent"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_licenses", "licenses"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_licenses bigint, licenses array<struct<start:bigint,end:bigint,license:string,percent:bigint>>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["percent"].cast("string"))), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_licenses", listed.alias("licenses"))
