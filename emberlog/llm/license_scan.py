"""Licences by TF-IDF cosine to templates, and inheritance from licence files in ancestor directories.

Every line of every text is a possible header: its sparse TF-IDF vector is compared with the notices among the
templates. So is every run of as many words as a notice has across line breaks, and for long notices anywhere. A text that as a whole is close to a
notice or to a licence's own text, or that starts with the opening of a long licence, is a licence file. Documents without
a licence of their own inherit that of the nearest directory above them that holds a licence file; paths are joined
directory by directory, so a directory with a third of all files costs one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_of, written

#: Fixed values: (licence, text of a notice or of the opening of the licence).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("proprietary", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License"),
)
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. ")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.")
#: Short licences whole.
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_ADVICE = "Creative Commons Corporation (\"Creative Commons\") is not a law firm and does not provide legal services or legal advice."
#: Openings of long licences, as only their own texts have them.
OPENINGS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _VERBATIM),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, "
                 "Inc. " + _VERBATIM),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software "
                 "Foundation, Inc. " + _VERBATIM),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software "
                 "Foundation, Inc. " + _VERBATIM),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity "
                "that creates, contributes to the creation of, or owns Covered Software."),
    ("CC-BY-4.0", "Attribution 4.0 International " + _ADVICE),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International " + _ADVICE),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International " + _ADVICE),
)
#: Words of a notice from which on it is looked for inside lines, too; shorter ones must be most of a line or be wrapped.
LONG_NOTICE = 10
#: Words before which an opening must start: titles and names of holders may come first.
OPENING_WITHIN = 60
LEAST_COSINE = 0.75
#: Folders with a licence above them up to which they go to every task; more are joined by a shuffle.
BROADCAST_FOLDERS = 200_000
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
#: Comment marks that would be words; all others are none.
MARK = re.compile(r"^[ \t]*(?:@?rem|dnl)(?![a-z0-9.+-])", re.MULTILINE)
FOUND = "doc_id long, path string, license string, score double, line int, is_file boolean"


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Matcher:
    """The best template for a list of terms under given weights of the terms."""

    def __init__(self, templates, idf: dict[str, float], unseen: float):
        self.idf, self.unseen = idf, unseen
        self.names, self.norms = [], []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (name, text) in enumerate(templates):
            vector = self.vector(terms(text))
            self.names.append(name)
            self.norms.append(math.sqrt(sum(w * w for w in vector.values())))
            for term, weight in vector.items():
                self.postings.setdefault(term, []).append((k, weight))

    def vector(self, words: list[str]) -> dict[str, float]:
        return {t: (1 + math.log(n)) * self.idf.get(t, self.unseen) for t, n in Counter(words).items()}

    def best(self, words: list[str]) -> tuple[float, str]:
        vector = self.vector(words)
        dots: dict[int, float] = {}
        for term, weight in vector.items():
            for k, other in self.postings.get(term, ()):
                dots[k] = dots.get(k, 0.0) + weight * other
        norm = math.sqrt(sum(w * w for w in vector.values()))
        return max(((round(dot / (norm * self.norms[k]), 9), self.names[k]) for k, dot in dots.items()),
                   key=lambda x: (x[0], x[1]), default=(0.0, ""))


class Windows:
    """The runs of words of a text that are as long as a template and close to it, across lines or inside one."""

    def __init__(self, templates, matcher: Matcher, least: float):
        self.matcher, self.least = matcher, least
        self.names = [name for name, _ in templates]
        self.lengths = [len(terms(text)) for _, text in templates]
        self.vectors = [matcher.vector(terms(text)) for _, text in templates]
        self.squares = [{t: w * w for t, w in vector.items()} for vector in self.vectors]
        self.norms = [sum(squares.values()) for squares in self.squares]
        self.by_cue: dict[str, list[int]] = {}
        for k, squares in enumerate(self.squares):
            for term in _heaviest(squares, least):
                self.by_cue.setdefault(term, []).append(k)

    def cosine(self, k: int, words: list[str]) -> float:
        vector, template = self.matcher.vector(words), self.vectors[k]
        dot = sum(w * template.get(t, 0.0) for t, w in vector.items())
        return round(dot / math.sqrt(sum(w * w for w in vector.values()) * self.norms[k]), 9)

    def able(self, k: int, words: list[str]) -> bool:
        """Whether the template's terms among the words can give the cosine: it is at most their share of the norm."""
        squares = self.squares[k]
        return sum(squares[t] for t in squares.keys() & words) >= self.least ** 2 * self.norms[k] * (1 - 1e-9)

    def close(self, words: list[str], lines: list[int]) -> Iterator[tuple[float, int, int]]:
        """(cosine, template, start) of the best run for each template that has one, the first among equals.

        ``lines``: the line of each word.
        """
        best: dict[int, tuple[float, int]] = {}
        after = [0] * len(self.lengths)
        for place, word in enumerate(words):
            for k in self.by_cue.get(word, ()):
                size = self.lengths[k]
                low, high = max(after[k], place - size + 1), min(place, len(words) - size)
                if high < low:
                    continue
                after[k] = high + 1
                if not self.able(k, words[low:high + size]):
                    continue
                for start in range(low, high + 1):
                    if size < LONG_NOTICE and lines[start] == lines[start + size - 1]:
                        continue
                    run = words[start:start + size]
                    if self.able(k, run) and (score := self.cosine(k, run)) >= max(self.least, best.get(k, (0,))[0]):
                        if k not in best or score > best[k][0]:
                            best[k] = score, start
        return ((score, k, start) for k, (score, start) in best.items())


def _heaviest(squares: dict[str, float], least: float, known: Iterable[str] = ()) -> list[str]:
    """The heaviest terms without any of which, and of the known ones, no text can reach the cosine."""
    norm = sum(squares.values())
    rest, out = norm - sum(squares.get(t, 0.0) for t in set(known)), []
    for term in sorted(squares.keys() - set(known), key=lambda t: (-squares[t], t)):
        if math.sqrt(max(0.0, rest) / norm) < least:
            break
        out.append(term)
        rest -= squares[term]
    return out


def term_weights(docs: DataFrame, templates, text_col: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all documents, and the weight of any other term."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})

    def make():
        known = set(vocabulary)

        def run(batches) -> Iterator[tuple]:
            counts, n = Counter(), 0
            for (text,) in rows_of(batches):
                n += 1
                counts.update(known.intersection(WORD.findall((text or "").lower())))
            yield "", n
            yield from counts.items()

        return run

    rows = arrow_map(docs.select(text_col), make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in rows.collect()}
    n = counts.pop("", 0)
    return {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def own_licenses(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE, id_col: str = "doc_id",
                 text_col: str = "text", path: str = "path", texts=TEXTS, openings=OPENINGS) -> DataFrame:
    """(doc_id, path, license, score, line, is_file): the best match of each text, null where none is close enough.

    A licence's own text or opening goes before notices, and any licence before "proprietary", whose words stand in
    the notices of others; then the cosine counts, then the longer template, then the first place. Score and line are those of the best line or
    whole text with that licence if there is one, else of the run of words.
    """
    everything = (*templates, *texts, *openings)
    idf, unseen = term_weights(docs, everything, text_col)
    # a line below this weight of template terms can't reach the cosine; the rarest term of every template is a cue
    cues = sorted({max(terms(text), key=lambda t: (idf[t], t)) for _, text in templates})

    def make():
        matcher, whole_texts = Matcher(templates, idf, unseen), Matcher(texts, idf, unseen)
        windows = Windows(everything, matcher, least)
        cue = _cue_pattern(templates, idf, least, cues, (*texts, *openings))
        notices, opening = len(templates), len(templates) + len(texts)

        def matches(low: str) -> Iterator[tuple]:
            """(rank, cosine, words compared, - line, name, whether of a licence file, whether no run of words)"""
            for number, part in enumerate(low.split("\n")):
                if cue.search(part):
                    found = WORD.findall(part)
                    score, name = matcher.best(found)
                    if score >= least:
                        yield int(name != "proprietary"), score, len(found), -number, name, False, True
            words, lines = [], []
            for number, part in enumerate(MARK.sub("", low).split("\n")):
                words += (here := WORD.findall(part))
                lines += [number] * len(here)
            for rank, known in ((1, matcher), (2, whole_texts)):
                score, name = known.best(words)
                if score >= least:
                    yield rank if name != "proprietary" else 0, score, len(words), 0, name, True, True
            for score, k, start in windows.close(words, lines):
                at_top = k >= opening and start < OPENING_WITHIN
                rank = 2 if at_top or notices <= k < opening else int(windows.names[k] != "proprietary")
                if k < opening or at_top:
                    yield rank, score, windows.lengths[k], -lines[start], windows.names[k], at_top, False

        def run(batches) -> Iterator[tuple]:
            for doc_id, where, text in rows_of(batches):
                low = (text or "").lower()
                found = list(matches(low)) if cue.search(low) else []
                if not found:
                    yield doc_id, where, None, None, None, False
                    continue
                best = max(found)
                _, score, _, line, name, *_ = max((f for f in found if f[4] == best[4] and f[6]), default=best)
                yield doc_id, where, name, score, -line, any(f[5] for f in found)

        return run

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(path).cast("string").alias("path"),
                         F.col(text_col).alias("text"))
    return arrow_map(source, make, FOUND)


def _cue_pattern(templates, idf: dict[str, float], least: float, cues: list[str], others=()) -> re.Pattern:
    """Terms of which any line close to a template, and any text close to one of ``others``, has one.

    A line that lacks a set of a template's terms reaches a cosine of at most the norm of the rest. So the heaviest
    terms whose removal brings that below ``least`` are cues: a line without any of them can't match.
    """
    def squares(text: str) -> dict[str, float]:
        return {t: ((1 + math.log(n)) * idf[t]) ** 2 for t, n in Counter(terms(text)).items()}

    needed = set(cues)
    for _, text in templates:
        needed.update(_heaviest(squares(text), least))
    for _, text in others:
        needed.update(_heaviest(squares(text), least, needed))
    return re.compile("|".join(map(re.escape, sorted(needed, key=lambda t: (-len(t), t)))))


def ancestors(path: str):
    """All directories above a path, itself left out, as (directory, depth); the root is '' at depth 0."""
    return F.expr(f"""transform(sequence(0, size(split({path}, '/')) - 1),
        d -> struct(array_join(slice(split({path}, '/'), 1, d), '/') AS directory, d AS depth))""")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE, id_col: str = "doc_id",
                  text_col: str = "text", path: str = "path") -> DataFrame:
    """(doc_id, path, license, score, line, origin, directory) for every row.

    ``origin`` is "own" for a header in the text, "inherited" for the licence of the nearest ancestor directory with a
    licence file, else null; ``directory`` says where that is. ``path`` is an expression over the columns of ``docs``;
    rows without a path or without text inherit nothing or as others do. If a directory has licence files that
    disagree, the highest score counts, then the smallest id. ``line`` is where the match begins, 0 for whole texts;
    ties of a line go to the template last by name. An empty table gives an empty one.
    """
    own = written(own_licenses(docs, templates, least, id_col, text_col, path), "licenses")
    folder = F.expr("CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '' END")
    own = own.withColumn("folder", folder)
    files = own.filter("is_file AND license IS NOT NULL AND folder IS NOT NULL").groupBy("folder").agg(
        F.max_by(F.struct("license", "score"), F.struct("score", -F.col("doc_id"))).alias("given"))
    files = files.select(F.col("folder").alias("directory"), F.col("given.license").alias("given_license"),
                         F.col("given.score").alias("given_score"))
    folders = own.select("folder").filter("folder IS NOT NULL").distinct()
    above = folders.select("folder", F.explode(ancestors("concat(folder, '/')")).alias("a")).select("folder", "a.*")
    nearest = written(above.join(files, "directory").groupBy("folder").agg(
        F.max_by(F.struct("directory", "given_license", "given_score"), "depth").alias("n")).select("folder", "n.*"),
        "nearest")
    if nearest.count() <= BROADCAST_FOLDERS:  # then a folder with a third of all files needn't meet in one task
        nearest = F.broadcast(nearest)
    joined = own.join(nearest, "folder", "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("license", "given_license").alias("license"),
        F.coalesce("score", "given_score").alias("score"), "line",
        F.when(mine, "own").when(F.col("given_license").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("directory")).alias("directory"))
