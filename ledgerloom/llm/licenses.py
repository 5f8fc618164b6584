"""License scan: TF-IDF cosine of header lines, whole headers and whole files to templates, then the nearest directory above.

Every line of a file, its header (the first lines without a blank one among them) and the whole file are compared with every template
as sparse TF-IDF vectors over all words; document frequencies of all words are counted over all files, so the weight of a word does not
depend on whether a template has it. The best part at or above the threshold gives the file's own licence. A file that is named
like a licence file, or that holds nothing but licence text, also gives its licence to its directory. A file without its
own takes that of the nearest directory above that has one, found by joins on paths.

Tasks know the weights of the templates' words only. They pass over what cannot reach the threshold whatever its other words weigh,
for every word weighs at least as much as one that all files hold; the few parts left bring their other words to a join with the
counted words, which completes their lengths.

Defined results: null and empty texts have no own licence; a null path has no directory to inherit from. Equal cosines go
to the template whose name sorts first, then to the part that starts first; two licence files in one directory, to the smaller path. Repeated
rows get equal results. An empty table gives no rows. Columns named like a result are replaced by it.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import WORD_BYTES, annotate, shielded, slices, texts_of
from ledgerloom.plans.joins import lookup_join
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

THRESHOLD = 0.6
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
# Headers by which public licences are stated; names are SPDX identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, the Creative Commons Attribution ShareAlike 4.0 License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
}

# Longer texts of public licences: what stands in headers and licence files. Fixed values.
LONG_TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
ALL_TEMPLATES = (*TEMPLATES.items(), *LONG_TEMPLATES.items())
# Words that a task counts before it hands them on.
TASK_WORDS = 300_000


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def word_frequencies(files: DataFrame) -> tuple[DataFrame, int]:
    """(word, n) for all words: in how many files each occurs; and how many files there are. Written once."""

    def count(batches):
        found, n = {}, 0
        for batch in batches:
            for part in slices(batch):
                n += part.num_rows
                for text in texts_of(part):
                    for w in set(words(text or b"")):
                        found[w] = found.get(w, 0) + 1
                if len(found) > TASK_WORDS:
                    yield counted(found)
                    found = {}
        yield counted({**found, b"": n})

    def counted(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    got = staged(files.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "licenses-words")
    none = F.lit(b"")
    row = got.filter(F.col("word") == none).first()
    return got.filter(F.col("word") != none), row["n"] if row else 0


class Matcher:
    """Template vectors over the words of all templates, given in how many of all files each word occurs."""

    def __init__(
        self, templates: dict[str, str] | list[tuple[str, str]], frequency: dict[bytes, int], files: int, threshold: float
    ) -> None:
        given = sorted(templates.items() if isinstance(templates, dict) else templates)
        self.names = [name for name, _ in given]
        self.idf = {w: math.log((files + 1) / (n + 1)) + 1 for w, n in frequency.items()}
        self.other = math.log(files + 1) + 1
        self.threshold = threshold
        self.vectors = [self.weights(words(text.encode())) for _, text in given]
        self.bounds: dict[frozenset[bytes], float] = {}
        self.seen: dict[bytes, tuple[str | None, float]] = {}
        self.having: dict[bytes, list[tuple[int, float]]] = {}
        for number, vector in enumerate(self.vectors):
            for w, x in vector.items():
                self.having.setdefault(w, []).append((number, x))
        self.most = {w: max(x for _, x in own) ** 2 for w, own in self.having.items()}

    def part(self, text: list[bytes]) -> tuple[str, float, float, list[tuple[bytes, float]]] | None:
        """What tells the cosine of a part of a file once the weights of its other words are known: the best template, the product with it,
        the square of the length so far, and the other words with the square of what multiplies their weights. None if no
        weights that words can have bring it to the threshold."""
        most = self.most
        if sum(most.get(w, 0.0) for w in set(text)) < self.threshold**2 - 1e-9:
            return None
        count: dict[bytes, int] = {}
        for w in text:
            count[w] = count.get(w, 0) + 1
        products, known, rest = [0.0] * len(self.names), 0.0, []
        for w, n in count.items():
            factor = 1 + math.log(n)
            if w not in self.having:
                rest.append((w, factor * factor))
                continue
            own = factor * self.idf[w]
            known += own * own
            for number, x in self.having[w]:
                products[number] += own * x
        # No word weighs less than one that stands in all files.
        longest = max(range(len(products)), key=lambda i: (round(products[i] / math.sqrt(known or 1.0), 9), -i), default=None)
        if longest is None or products[longest] < (self.threshold - 1e-9) * math.sqrt(known + sum(x for _, x in rest)):
            return None
        return self.names[longest], products[longest], known, rest

    def weights(self, line: list[bytes]) -> dict[bytes, float]:
        count: dict[bytes, int] = {}
        for w in line:
            count[w] = count.get(w, 0) + 1
        raw = {w: (1 + math.log(n)) * self.idf.get(w, self.other) for w, n in count.items()}
        size = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / size for w, x in raw.items()}

    def bound(self, line: list[bytes]) -> float:
        """No cosine of the line is higher: the longest part that any template vector has over the terms the line holds."""
        held = frozenset(self.idf.keys() & line)
        if held not in self.bounds:
            if len(self.bounds) > 50_000:
                self.bounds.clear()
            self.bounds[held] = max((math.sqrt(sum(x * x for w, x in v.items() if w in held)) for v in self.vectors), default=0.0)
        return self.bounds[held]

    def match(self, line: bytes) -> tuple[str | None, float]:
        """The best template of a line and its cosine, or none below the threshold."""
        if line in self.seen:
            return self.seen[line]
        own = self.weights(words(line))
        cosine = [round(sum(x * own.get(w, 0.0) for w, x in v.items()), 9) for v in self.vectors]
        best = int(np.argmax(cosine)) if cosine else 0
        result = (self.names[best], cosine[best]) if cosine and cosine[best] >= self.threshold else (None, 0.0)
        if len(self.seen) > 50_000:
            self.seen.clear()
        if len(line) < 1000:
            self.seen[line] = result
        return result


def parts_of(text: bytes) -> tuple[list[tuple[int, int, list[bytes]]], int]:
    """(number of the first line, how many lines, words) of the lines, header and whole of a text, and how many lines with words it has."""
    lines = [words(line) for line in text.splitlines()]
    full = [i for i, line in enumerate(lines) if line]
    parts = [(number, 1, lines[i]) for number, i in enumerate(full)]
    block = [i for number, i in enumerate(full) if i - number == full[0]]
    if len(block) > 1:
        parts.append((0, len(block), [w for i in block for w in lines[i]]))
    if len(full) > len(block):
        parts.append((0, len(full), [w for i in full for w in lines[i]]))
    return parts, len(full)


def own_licenses(
    files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """Add own_license, similarity, own_line (where it starts, counting lines with words from 0) and only_license (whether all is such)."""
    given = list(ALL_TEMPLATES if templates is None else templates.items())
    counted, total = word_frequencies(files)
    wanted = {w for _, text in given for w in words(text.encode())}
    frequency = dict.fromkeys(wanted, 0)
    for row in counted.filter(F.col("word").isin(*[F.lit(w) for w in wanted])).collect():  # as many as the templates have words
        frequency[bytes(row["word"])] = row["n"]
    made: list[Matcher] = []

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(Matcher(given, frequency, total, threshold))
        likely, lines = [], []
        for text in texts_of(part):
            parts, n = parts_of(text or b"")
            found = [(number, size, made[0].part(own)) for number, size, own in parts]
            likely.append([
                {"no": number, "size": size, "name": hit[0], "product": hit[1], "known": hit[2], "rest": [{"word": w, "x": x} for w, x in hit[3]]}
                for number, size, hit in found if hit is not None
            ])
            lines.append(n)
        return [pa.array(likely, kind_of_part), pa.array(lines, pa.int32())]

    kind_of_part = pa.list_(pa.struct([
        ("no", pa.int32()), ("size", pa.int32()), ("name", pa.string()), ("product", pa.float64()), ("known", pa.float64()),
        ("rest", pa.list_(pa.struct([("word", pa.binary()), ("x", pa.float64())]))),
    ]))
    fields = T.StructType.fromDDL(
        "_likely array<struct<no: int, size: int, name: string, product: double, known: double, rest: array<struct<word: binary, x: double>>>>, _lines int"
    ).fields
    rows = staged(annotate(files, run, fields, keep).withColumn("_row", F.monotonically_increasing_id()), "licenses-parts")
    parts = rows.select("_row", "_lines", F.posexplode("_likely").alias("_part", "p"))
    single = parts.select("_row", "_part", F.explode("p.rest").alias("r")).select("_row", "_part", "r.word", "r.x")
    heard = single.select("word").distinct().join(counted, "word")
    idf = F.log((F.lit(total) + 1) / (F.col("n") + 1)) + 1
    lengths = lookup_join(single, heard, ["word"], spread_by=["_row"]).groupBy("_row", "_part").agg(F.sum(F.col("x") * idf * idf).alias("more"))
    cosine = F.round(F.col("p.product") / F.sqrt(F.col("p.known") + F.coalesce("more", F.lit(0.0))), 9)
    hits = parts.join(lengths, ["_row", "_part"], "left").withColumn("cosine", cosine).filter(F.col("cosine") >= threshold)
    whole = (F.count_if(F.col("p.size") == 1) == F.max("_lines")) | (F.max("p.size") == F.max("_lines"))
    first = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("p.name").alias("name"), F.col("p.no").alias("no")))
    best = hits.groupBy("_row").agg(first.alias("_best"), whole.alias("_only"))
    out = rows.join(best, "_row", "left")
    return out.select(
        *[c for c in rows.columns if c not in ("_likely", "_lines", "_row")],
        F.col("_best.name").alias("own_license"), F.coalesce(-F.col("_best.c"), F.lit(0.0)).alias("similarity"),
        F.col("_best.no").alias("own_line"), F.coalesce("_only", F.lit(False)).alias("only_license"),
    )


def licence_file() -> Column:
    """Files that speak for their directory: named like a licence, or holding nothing else."""
    return F.col("only_license") | F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAME)


def inherit(scanned: DataFrame, speaks: Column | None = None) -> DataFrame:
    """Add license and license_from (`own`, the directory it comes from, or null) to files with path and own_license.

    `speaks` is the condition for a file with an own licence to give it to its directory.

    Directories are made distinct before their ancestors are listed, so a directory with very many files costs no more than
    one with few until its files read the answer, in a join with one row per directory.
    """
    return shielded(scanned, ["path", "own_license", "similarity", "own_line", "only_license"], lambda d, _: _inherited(d, speaks))


def _inherited(base: DataFrame, speaks: Column | None) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = base.withColumn("_dir", F.when(F.col("path").contains("/"), folder).when(F.col("path").isNotNull(), ""))
    given = rows.filter(
        "own_license IS NOT NULL AND _dir IS NOT NULL"
    ).filter(licence_file() if speaks is None else speaks).groupBy(
        F.col("_dir").alias("_above")
    ).agg(F.min_by("own_license", "path").alias("_given"))
    steps = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    folders = rows.filter("_dir IS NOT NULL").select("_dir").distinct()
    chains = folders.select("_dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("_above"))
    nearest = chains.join(given, "_above").groupBy("_dir").agg(
        F.max_by("_given", F.length("_above")).alias("_license"), F.max_by("_above", F.length("_above")).alias("_from")
    )
    own = F.col("own_license").isNotNull()
    found = rows.join(nearest, "_dir", "left")
    return found.select(
        *base.columns, F.coalesce("own_license", "_license").alias("license"), F.when(own, "own").otherwise(F.col("_from")).alias("license_from")
    )


def scan_licenses(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None, speaks: Column | None = None) -> DataFrame:
    """Licence of every file (path, text) with where it comes from. `speaks` may use the path and what was found in a file."""

    def scan(files: DataFrame, kept: list[str] | None) -> DataFrame:
        return inherit(staged(own_licenses(files, templates, threshold, kept), "licenses-own"), speaks)

    return shielded(files, ["path", "text"], scan, None if keep is None else list(dict.fromkeys([*keep, "path"])))
