"""License detection by TF-IDF cosine, inherited along directories (operator 7).

A text's candidate segments are, in each paragraph with a trigger word, the
paragraph (a header), its lines with such a word, what follows each of those to the paragraph's
end, and its sentences, also where they are wrapped over lines; and the whole
text of a licence file.  Each segment is compared with the templates by
the cosine of sparse TF-IDF vectors; inverse document frequencies are counted
over all texts, for every term of a segment or a template, and joined to the
distinct candidate texts.  A template only counts where a segment has all its
numbers and, if it has terms that no other licence's templates have, one of those.
The best template of ``least`` or more is the text's own licence.  A text without one inherits from the licence file of its nearest
ancestor directory: the distinct directories are exploded into their
ancestors, joined to the directories of the licence files by path, and the
nearest goes back to the rows by a join on the directory.

Defined results: null and empty texts have no own licence and inherit like
others; a null path inherits nothing; of several licence files in one directory
the best score counts, then the first name; of templates with the same score the
one with the most terms, then the first name; repeated rows are judged alike; an
empty table gives an empty result; input columns named like an output are
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import checked_broadcast, written
from .rows import need, others
from .textkit import regrouped, slices, tidy

#: The notices that the licences' own texts ask for, and their short forms.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": ["Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "Unlicense": ["This is free and unencumbered software released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "Proprietary": ["Copyright, all rights reserved. No part may be reproduced without permission."],
}
#: Every template has one of these words.
TRIGGER = r"(?i)licen[cs]e|spdx|permission|redistribut|copyright|all rights|public domain"
#: Names of files that license their directory.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)(\.[a-z0-9]+)?$"
OUTPUTS = {"license": T.StringType(), "license_score": T.DoubleType(), "license_from": T.StringType()}
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def terms_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def segments_of(text: str, whole: bool) -> list[str]:
    """The distinct candidate segments of a text; whole: the text itself is one too."""
    segments = [text] if whole else []
    for paragraph in re.split(r"\n[ \t\r]*\n", text):
        if not re.search(TRIGGER, paragraph):
            continue
        lines = paragraph.split("\n")
        segments.append(paragraph)
        for i, line in enumerate(lines):
            if re.search(TRIGGER, line):
                segments += [line, "\n".join(lines[i:])] if i else [line]
        segments += [x for x in re.split(r"(?<=[.!?])\s+", paragraph) if re.search(TRIGGER, x)]
    return list(dict.fromkeys(segments))


@dataclass
class Matcher:
    """TF-IDF vectors of the templates, and what a segment must have for each."""

    n_docs: int
    df: dict[str, int]

    def __post_init__(self):
        of = {name: {t for text in texts for t in terms_of(text)} for name, texts in TEMPLATES.items()}
        self.vectors = []
        for name, texts in sorted(TEMPLATES.items()):
            elsewhere = set().union(*(terms for other, terms in of.items() if other != name))
            for text in texts:
                terms = set(terms_of(text))
                numbers = {t for t in terms if t[0].isdigit()}
                self.vectors.append((name, self.vector(text, self.df), numbers, terms - elsewhere))
        self.vectors.sort(key=lambda v: -len(v[1]))

    def vector(self, text: str, df: dict[str, int]) -> dict[str, float]:
        v = {t: (1 + log(n)) * (log((1 + self.n_docs) / (1 + df.get(t, 0))) + 1) for t, n in Counter(terms_of(text)).items()}
        size = sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    def best(self, text: str, whole: bool, df: dict[str, int]) -> tuple[str | None, float]:
        """(licence, cosine) of the best segment, df having the frequencies of all its terms; ties go to the longest template."""
        found, score = None, 0.0
        for segment in segments_of(text, whole):
            v = self.vector(segment, df)
            for name, t, numbers, own in self.vectors:
                s = sum(x * t[k] for k, x in v.items() if k in t)
                if s > score + 1e-12 and numbers <= v.keys() and (not own or own & v.keys()):
                    found, score = name, s
        return found, score


def template_terms() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for text in texts for t in terms_of(text)})


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, c): in how many texts of a text column each term occurs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in regrouped(batches, "text", 8 << 20):
            counts = Counter()
            for text in part.column("text"):
                counts.update(set(terms_of(text.as_py() or "")))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), type=pa.string()), pa.array(counts.values(), type=pa.int64())], names=["term", "c"])

    return texts.mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))


def segment_terms(candidates: DataFrame) -> DataFrame:
    """(key, file, term) of the distinct terms of each candidate's segments."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                terms = [list({t for s in segments_of(text, file) for t in terms_of(s)}) for text, file in zip(part.column("text").to_pylist(), part.column("file").to_pylist())]
                row = np.repeat(np.arange(part.num_rows), [len(t) for t in terms])
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), part.column("file").take(pa.array(row)), pa.array([x for t in terms for x in t], type=pa.string())], names=["key", "file", "term"])

    return candidates.select("key", "file", "text").mapInArrow(run, "key string, file boolean, term string")


def own_licenses(texts: DataFrame, least: float) -> DataFrame:
    """(key, file, license, license_score) of the distinct texts of (key, file, text) that have a licence by themselves."""
    marked = texts.where(F.col("text").rlike(TRIGGER))
    candidates = written(marked.groupBy("key", "file").agg(F.min("text").alias("text")), "licence-candidates")
    terms = written(segment_terms(candidates), "licence-terms")
    spark = texts.sparkSession
    named = spark.createDataFrame([(t,) for t in template_terms()], "term string")
    wanted = checked_broadcast(written(terms.select("term").union(named).distinct(), "licence-wanted"))
    frequencies = written(document_frequencies(texts.select("text")).join(wanted, "term", "left_semi"), "licence-frequencies")
    rows = {r["term"]: r["c"] for r in frequencies.join(F.broadcast(named), "term").collect()}
    shared = spark.sparkContext.broadcast(Matcher(texts.count(), rows))
    of = terms.join(checked_broadcast(frequencies), "term").groupBy("key", "file").agg(F.collect_list("term").alias("terms"), F.collect_list("c").alias("counts"))
    known = candidates.join(of, ["key", "file"], "left").select("key", "file", "text", "terms", "counts")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shared.value.best(r["text"], r["file"], dict(zip(r["terms"] or [], r["counts"] or []))) for r in part.to_pylist()]
                good = pa.array([score >= least for _, score in found], type=pa.bool_())
                out = [part.column("key"), part.column("file"), pa.array([n for n, _ in found], type=pa.string()), pa.array([s for _, s in found], type=pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["key", "file", "license", "license_score"]).filter(good)

    return known.mapInArrow(run, "key string, file boolean, license string, license_score double")


def license_scan(df: DataFrame, path: str = "path", text: str = "text", least: float = 0.7) -> DataFrame:
    """df with license, license_score and license_from (own, or the licence file's path; null: none)."""
    need(df, path, text)
    columns = others(df, *OUTPUTS)
    df = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{path}`").alias("__at"), F.col(f"`{text}`").alias("__body"))
    path, text, named, columns = "__at", "__body", columns, [f"c{i}" for i in range(len(columns))]
    where = F.col(f"`{path}`").cast("string")
    parts = F.split(where, "/", -1)
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    marked = df.select(*columns, path, text, F.when(where.isNotNull(), folder).alias("__dir"), F.element_at(parts, -1).rlike(FILE_NAMES).alias("__is_file"))
    body = F.col(f"`{text}`").cast("string")
    # rows without a text have keys of their own, so that none is hot
    keyed = marked.select("*", F.coalesce(F.md5(body), F.concat(F.lit("-"), where)).alias("__key"), F.coalesce("__is_file", F.lit(False)).alias("__file"))
    verdicts = written(own_licenses(keyed.select(F.col("__key").alias("key"), F.col("__file").alias("file"), body.alias("text")), least), "licence-verdicts")
    own = verdicts.select(F.col("key").alias("__key"), F.col("file").alias("__file"), F.col("license").alias("__own"), F.col("license_score").alias("__own_score"))
    narrow = keyed.select("__dir", "__is_file", where.alias("__path"), "__key", "__file")
    files = narrow.where("__is_file").join(checked_broadcast(own), ["__key", "__file"])
    files = written(files.groupBy(F.col("__dir").alias("dir")).agg(F.min_by(F.struct(F.col("__own").alias("license"), F.col("__own_score").alias("license_score"), "__path"), F.struct(-F.col("__own_score"), F.col("__path"))).alias("f")), "licence-files")
    dirs = narrow.where("__dir is not null").select("__dir").distinct()
    steps = F.split("__dir", "/", -1)
    above = dirs.select("__dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).select("__dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/")).alias("dir"))
    nearest = written(above.join(checked_broadcast(files), "dir").groupBy("__dir").agg(F.max_by("f", "depth").alias("f")), "nearest")
    near = checked_broadcast(nearest).select(F.col("__dir").alias("__near"), "f")
    joined = keyed.join(checked_broadcast(own), ["__key", "__file"], "left").join(near, F.col("__dir") == F.col("__near"), "left")
    has = F.col("__own").isNotNull()
    return joined.select(*[F.col(c).alias(n) for c, n in zip(columns, named)], F.coalesce("__own", "f.license").alias("license"), F.coalesce("__own_score", "f.license_score").alias("license_score"), F.when(has, F.lit("own")).otherwise(F.col("f.__path")).alias("license_from"))
