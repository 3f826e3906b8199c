"""Licences of files by TF-IDF cosine to templates, and by the nearest directory that has a licence file.

Templates are headers, notices and whole short licence texts. Lines are compared with all of them as sparse TF-IDF
vectors, and so is every window of a text that is as long as a template, across lines, so that wrapped headers, licence
texts and notices within longer lines are found. A template's anchors are its heaviest words: what has none of them
can't reach the least cosine, so only what has one is scored, and nothing is lost. Document frequencies are counted over
the whole corpus, for the words of the templates only, so their table is bounded. A file whose matched lines make up a
good part of it, or which is named like one, is the licence file of its directory. A file without a licence of its own
takes that of the nearest directory above it, found by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, strings, written

# Fixed values: (licence, a typical notice or the start of its text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "BSD-2-Clause", "ISC", "EPL-2.0", "Unlicense")),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0") for end in ("", "-only", "-or-later")),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)
WORD = re.compile(r"licen[sc]|copyright|reserved|granted|redistribut|domain|spdx", re.I)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"


@dataclass(frozen=True)
class ScanLimits:
    #: Least cosine of a match.
    least_score: float = 0.75
    #: A file of which matched lines have this share of the words is a licence file.
    file_share: float = 0.25


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = frozenset(t for _, x in TEMPLATES for t in terms(x))


class Matcher:
    """Cosines of lines and windows to the templates under document frequencies of a corpus."""

    def __init__(self, n_docs: int, df: dict[str, int], least: float = 0.75) -> None:
        self.idf = {t: math.log((n_docs + 1) / (df.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.other = math.log(n_docs + 1) + 1
        self.templates = [(name, self.vector(text)) for name, text in TEMPLATES]
        self.lengths = [len(terms(text)) for _, text in TEMPLATES]
        self.anchors = [anchors(v, least) for _, v in self.templates]
        self.any_anchor = frozenset().union(*self.anchors)

    def vector(self, text: str) -> dict[str, float]:
        return self.weights(terms(text))

    def weights(self, words: list[str]) -> dict[str, float]:
        found = {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in found.values()))
        return {t: x / norm for t, x in found.items()}

    def best(self, line: str) -> tuple[float, str]:
        """The greatest cosine, and its licence (ties: the first by name)."""
        found = self.vector(line)
        scores = [(sum(x * found.get(t, 0.0) for t, x in v.items()), name) for name, v in self.templates]
        return min(scores, key=lambda s: (-round(s[0], 12), s[1]))


    def windows(self, words: list[str], least: float) -> Iterator[tuple[float, str, int, int]]:
        """(cosine, licence, from, to) of the windows of terms that are as long as a template and reach ``least``."""
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.any_anchor:
                places.setdefault(w, []).append(i)
        mass = [self.idf.get(w, self.other) ** 2 for w in words]
        for (name, v), size, wanted in zip(self.templates, self.lengths, self.anchors, strict=True):
            share = least_share(size, least)
            at = [c for w in wanted if w in places for c in places[w]]
            starts = {min(s, max(0, len(words) - size)) for c in at for s in range(max(0, c - size + 1), c + 1)}
            for s in sorted(starts):
                part = words[s : s + size]
                hit = sum(m for w, m in zip(part, mass[s : s + size], strict=True) if w in v)
                if hit < share * sum(mass[s : s + size]):
                    continue
                found = self.weights(part)
                score = sum(x * found.get(t, 0.0) for t, x in v.items())
                if score >= least:
                    yield score, name, s, s + len(part)


def anchors(v: dict[str, float], least: float) -> frozenset[str]:
    """The fewest heaviest words of a template without any of which a cosine stays below ``least``: the rest of its vector is shorter than that."""
    found, rest = [], 1.0
    for t in sorted(v, key=lambda t: (-v[t], t)):
        if rest < least * least - 1e-9:
            break
        found.append(t)
        rest -= v[t] * v[t]
    return frozenset(found)


def least_share(size: int, least: float) -> float:
    """The least share of a template's words in the mass (sum of squared idf) of a window of ``size`` terms whose cosine reaches ``least``.

    n occurrences weigh (1 + ln n) idf in the vector, so its square is at most 1.48 and at least ``low`` times their mass.
    """
    low = min(1.0, (1 + math.log(size)) ** 2 / size)
    return 1 / (1 + 1.48 * (1 - least * least) / (least * least * low))


def scan(text: str, matcher: Matcher, limits: ScanLimits) -> tuple[str | None, float | None, int | None, float]:
    """(licence, score, line, share of the words in matched lines and windows): the best match of the text, the first line of those that tie.

    A reservation of rights decides only where no licence is found, as licences often stand below one.
    """
    if matcher.any_anchor.isdisjoint(terms(text)):
        return None, None, None, 0.0
    found, matched, at, where, n_words = [], set(), [], [], 0
    words: list[str] = []
    for i, line in enumerate(text.split("\n")):
        pieces, before = line.split(), len(words)
        for k, piece in enumerate(pieces, n_words):
            here = terms(piece)
            words += here
            at += [k] * len(here)
            where += [i] * len(here)
        if not matcher.any_anchor.isdisjoint(words[before:]):
            score, name = matcher.best(line)
            if score >= limits.least_score:
                found.append((name == "proprietary", -round(score, 12), i, name))
                matched.update(range(n_words, n_words + len(pieces)))
        n_words += len(pieces)
    for score, name, start, stop in matcher.windows(words, limits.least_score):
        found.append((name == "proprietary", -round(score, 12), where[start], name))
        matched.update(at[start:stop])
    if not found:
        return None, None, None, 0.0
    _, score, line, name = min(found)
    return name, -score, line, len(matched) / max(1, n_words)


def document_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """(documents, documents that have a template's word); one row for each such word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                found.update(VOCABULARY & set(terms(text)))
            found[""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    df = {r.term: r.n for r in files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return df.pop("", 0), df


def scan_licenses(files: DataFrame, limits: ScanLimits = ScanLimits(), id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, own_license, score, line, license, inherited_from) for each row of ``files``.

    ``license`` is the own one, else that of the nearest directory above that has a licence file (of several in one
    directory: the most frequent licence, then the first by name), else null. A null or empty text has none of its own;
    a null path has no directory. Repeated rows each get a row; an empty table gives an empty result; other columns are
    ignored.
    """
    small_batches(files.sparkSession)
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    n_docs, df = document_frequencies(rows)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(n_docs, df, limits.least_score)
        for batch in batches:
            found = [scan(x, matcher, limits) for x in strings(batch.column(2))]
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in found], k) for i, k in enumerate(kinds))], ["id", "path", "own_license", "score", "line", "share"])

    found = written(rows.mapInArrow(run, f"id {kind}, path string, own_license string, score double, line int, share double"))
    directory = F.regexp_extract("path", r"^([\s\S]*)/[^/]*$", 1)
    placed = found.withColumn("dir", F.when(F.col("path").isNotNull(), directory))
    is_file = F.col("own_license").isNotNull() & ((F.col("share") >= limits.file_share) | F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAME))
    counted = placed.where(is_file & F.col("dir").isNotNull()).groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    owners = counted.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("own_license"))).alias("top")).select(F.col("dir").alias("ancestor"), F.col("top.own_license").alias("dir_license"))
    # Each directory once, with all directories above it.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))
    dirs = placed.where("dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("up")).select("dir", "up.depth", "up.ancestor")
    nearest = dirs.join(broadcast_if_small(written(owners), 200_000), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("near"))
    joined = placed.join(broadcast_if_small(written(nearest), 200_000), "dir", "left")
    own = F.col("own_license")
    return joined.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "score", "line",
        F.coalesce(own, F.col("near.dir_license")).alias("license"), F.when(own.isNull(), F.col("near.ancestor")).alias("inherited_from"),
    )
