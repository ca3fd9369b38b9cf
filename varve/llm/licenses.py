"""License scans: TF-IDF cosine to templates, and inheritance from the nearest directory above.

Templates are short notices and full licence texts. Every statement of a file
that a cue word marks is compared with every template by the cosine of sparse
TF-IDF vectors; so is the whole text of a licence file. Statements are the
cue's line, the paragraph from its first cue on, and the windows of a notice's
length in which the cue stands where it stands in that notice, so a notice is
found in a line of any length. Full texts get such windows where the words
around their first cue stand.

Document frequencies are counted over all files, for all words. A word's weight
depends on the share of files that have it, not on their number; words in less
than ``RARE`` of them weigh as if in that share, so what the driver holds is
bounded by the words of a file. A file has its own licence if its best cosine
reaches ``LEAST``. Licence files speak for their directory: a file without its
own takes the licence of the nearest directory above that has one.

The inheritance is joins on paths. Each different directory is expanded to its
ancestors, so a directory of many files costs one row a level, and the files
meet the result by directory, a join that adaptive execution splits where one
directory is hot.

Defined results. Null texts count as empty; null paths are files of the root.
Of several licence files of a directory the best cosine speaks, then the first
path. Ties of templates go to the first listed. Rows that repeat a path are
files each, and null ids are kept as they are. A text of any length is scanned
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.common import checkpoint

#: Cosine from which a statement carries a template's licence.
LEAST = 0.6
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: Share of the files under which a word's weight grows no more.
RARE = 1e-3
#: Different words a task counts before it passes them on, and statements whose cosine it remembers.
COUNTED, REMEMBERED = 500_000, 100_000

# The public short notices of common licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]

CUE = re.compile(r"(?i)licen[cs]e|copyright|permission|redistribut|public domain|rights reserved|free software")
TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def full_texts() -> list[tuple[str, str]]:
    """Full licence texts by name, without their copyright lines."""
    return [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def cues(low: str, starts: list[int]) -> list[int]:
    """Positions of the words in which cues begin, ascending; ``starts`` are the places of the words."""
    return sorted({bisect.bisect_right(starts, m.start()) - 1 for m in CUE.finditer(low)})


class Templates:
    """Unit TF-IDF vectors of the templates by word, for cosines of statements."""

    def __init__(self, files: int, frequency: dict[str, int]) -> None:
        self.idf = {t: 1 - math.log(n / files) for t, n in frequency.items() if n > RARE * files}
        self.rare = 1 - math.log(RARE)
        self.names, self.vectors = [], {}
        self.windows: set[tuple[int, int]] = set()  # (length, place of a cue) of the notices
        self.openings: dict[tuple[str, ...], set[tuple[int, int]]] = {}  # the same of full texts, by the words around the first cue
        self.memory: dict[tuple[str, ...], tuple[float, str]] = {}
        for name, text in TEMPLATES:
            self._add(name, text)
            self.windows |= {(len(tokens(text)), j) for j in self._cues(text)}
        for name, text in full_texts():
            self._add(name, text)
            words, j = tokens(text), self._cues(text)[0]
            self.openings.setdefault(tuple(words[j : j + 3]), set()).add((len(words), j))

    def _cues(self, text: str) -> list[int]:
        return cues(text.lower(), [m.start() for m in TOKEN.finditer(text.lower())])

    def _add(self, name: str, text: str) -> None:
        for t, x in self._unit(tokens(text)).items():
            self.vectors.setdefault(t, []).append((len(self.names), x))
        self.names.append(name)

    def _unit(self, words: list[str] | tuple[str, ...]) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf.get(t, self.rare) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / norm for t, x in raw.items()}

    def best(self, words: list[str] | tuple[str, ...]) -> tuple[float, str]:
        """The greatest cosine of a statement's words and its licence; (0, "") for none."""
        cosines = [0.0] * len(self.names)
        for t, x in self._unit(words).items():
            for i, y in self.vectors.get(t, ()):
                cosines[i] += x * y
        found = (0.0, "")
        for cosine, name in zip(cosines, self.names, strict=True):
            if cosine > found[0] + 1e-12:
                found = (min(1.0, cosine), name)
        return found

    def remembered(self, words: tuple[str, ...]) -> tuple[float, str]:
        found = self.memory.get(words)
        if found is None:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            found = self.memory[words] = self.best(words)
        return found

    def scan(self, text: str, whole: bool) -> tuple[float, str]:
        """The best of all marked statements, and of the whole text of a licence file."""
        found = self.best(tokens(text)) if whole and text else (0.0, "")
        if not CUE.search(text):
            return found
        for statement in self.statements(text):
            now = self.remembered(statement) if len(statement) <= 64 else self.best(statement)
            if now[0] > found[0] + 1e-12:
                found = now
        return found

    def statements(self, text: str) -> Iterator[tuple[str, ...]]:
        """Words of the statements around the cues of a text."""
        lines, fresh = text.splitlines(), True
        for i, line in enumerate(lines):
            if not line.strip():
                fresh = True
            elif CUE.search(line):
                yield tuple(tokens(line))
                if fresh:
                    yield tuple(tokens("\n".join(paragraph(lines, i))))
                fresh = False
        low = text.lower()
        places = list(TOKEN.finditer(low))
        words, marked = [m[0] for m in places], cues(low, [m.start() for m in places])
        met = set()
        for p in marked:
            for length, j in (*self.windows, *self.openings.get(tuple(words[p : p + 3]), ())):
                part = (max(0, p - j), p - j + length)
                if part not in met:
                    met.add(part)
                    yield tuple(words[part[0] : part[1]])


def paragraph(lines: list[str], at: int) -> list[str]:
    out = []
    for line in lines[at:]:
        if not line.strip():
            break
        out.append(line)
    return out


def directory(path: Column) -> Column:
    """The path without its last part; files of the root have an empty one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of files, and of those that each word is in, for words in more than ``RARE`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

        found = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update({"", *tokens(text.as_py() or "")})
                if len(found) > COUNTED:
                    yield told()
                    found = Counter()
        yield told()

    counts = checkpoint(files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    n = sum(r["n"] for r in counts.where("term = ''").collect())
    rows = counts.where(F.col("n") > RARE * n).collect()  # the words of 1 / RARE files at most
    return n, {r["term"]: r["n"] for r in rows if r["term"]}


def scan(files: DataFrame) -> DataFrame:
    """``id, path, license, score, origin, from_dir`` for ``files (id, path, text)``.

    ``origin``: ``own`` for a statement or licence text of the file itself,
    ``inherited``, or ``none`` (with an empty licence).
    """
    files = files.select("id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    templates = Templates(*frequencies(files))
    speaks = F.regexp_replace("path", "^.*/", "").rlike(LICENCE_FILE)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [templates.scan(t.as_py(), w.as_py()) for t, w in zip(batch.column(2), batch.column(3), strict=True)]
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array([n if s >= LEAST else "" for s, n in found]), pa.array([s for s, _ in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "path", "speaks", "license", "score"])

    kind = dict(files.dtypes)["id"]
    own = files.select("id", "path", "text", speaks.alias("speaks")).mapInArrow(marked, f"id {kind}, path string, speaks boolean, license string, score double")
    own = checkpoint(own.withColumn("dir", directory(F.col("path"))))  # without the texts, which are scanned once
    spoken = own.where("speaks and license <> ''").groupBy(F.col("dir").alias("above"))
    spoken = spoken.agg(F.min(F.struct((-F.col("score")).alias("low"), "path", "license")).alias("best")).select("above", F.col("best.license").alias("given"))
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    levels = own.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(chain)).alias("depth", "above"))
    nearest = levels.join(spoken, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near")).select("dir", "near.above", "near.given")
    found = own.join(nearest, "dir", "left")
    origin = F.when(F.col("license") != "", "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    found = found.withColumn("origin", origin)
    return found.select(
        "id",
        "path",
        F.when(F.col("origin") == "inherited", F.col("given")).otherwise(F.col("license")).alias("license"),
        "score",
        "origin",
        F.when(F.col("origin") == "inherited", F.col("above")).when(F.col("origin") == "own", F.col("dir")).otherwise("").alias("from_dir"),
    )


def tree_path(doc_id: Column, source: Column) -> Column:
    """A file tree over a flat table: source, thousands, hundreds and tens as directories; round ids are their licence files."""
    root = F.coalesce(source, F.lit("unknown"))
    level = lambda n: F.floor(doc_id / n).cast("string")
    at = F.when(doc_id % 1000 == 0, F.concat_ws("/", root, level(1000))).when(doc_id % 100 == 0, F.concat_ws("/", root, level(1000), level(100)))
    at = at.otherwise(F.concat_ws("/", root, level(1000), level(100), level(10)))
    return F.concat_ws("/", at, F.when(doc_id % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(doc_id.cast("string"), F.lit(".txt"))))
