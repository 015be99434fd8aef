"""Operator 5, license scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance.

A file's whole text is compared with every template, among them full licence texts: one that is near enough is a
licence file. Else its header, the lines that speak of a licence, is compared, line by line and as one. Both are bags
of words, weighted by TF-IDF over the templates and compared by cosine: a fixed, small matrix of the templates'
weights goes to each task. A
file without a match of its own takes the licence of the nearest directory above it that has a licence file: its
ancestors' paths are joined to the directories that have one, and the longest path wins. Licences that are another's text with
a few passages of their own (AGPL-3.0, BSD-4-Clause) have such a text as template, so the nearer one names the file.

Scale: each text is turned into terms once, and isn't shuffled. Licence
directories are aggregated before the join; the ancestors of a file are as many as its path is deep.

Edge cases: null and empty texts have no header; equal scores go to the first template name; several licence files in a
directory: the highest score, then the first name; files at the root, a null path: inherit only from ""; repeated
rows are files of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Licences by SPDX id: how else they are named, and sentences of their notices. Full texts are in licenses/<id>.txt.
NAMES = {
    "Apache-2.0": (("Apache License, Version 2.0", "Apache License 2.0"), ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",)),
    "AGPL-3.0": (("GNU Affero General Public License, version 3", "AGPLv3"), ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",)),
    "BSD-4-Clause": (("BSD 4-Clause License", "Original BSD License"), ()),
    "BSD-2-Clause": (("BSD 2-Clause License", "Simplified BSD License"), ()),
    "BSD-3-Clause": (("BSD License", "BSD 3-Clause License", "BSD-style license"), ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",)),
    "BSL-1.0": (("Boost Software License, Version 1.0",), ()),
    "CC0-1.0": (("CC0 1.0", "CC0 1.0 Universal"), ("Creative Commons CC0 1.0 Universal Public Domain Dedication",)),
    **{
        f"CC-{x}-4.0": ((f"CC {x} 4.0", f"Creative Commons {name} 4.0 International License"), (f"Creative Commons {name} 4.0 International License.",))
        for x, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    },
    **{
        f"{short}-{v}": ((f"GNU {name} Public License, version {v.removesuffix('.0')}", f"{short}v{v.removesuffix('.0')}"), (f"under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {v.removesuffix('.0')} of the License, or any later version",))
        for short, name, v in (("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"))
    },
    "ISC": (("ISC License",), ()),
    "MIT": (("MIT License",), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License.",)),
    "MPL-2.0": (("Mozilla Public License, version 2.0",), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    "Unlicense": (("Unlicense",), ("This is free and unencumbered software released into the public domain.",)),
    "Zlib": (("zlib License",), ()),
}


#: Licences whose full text is another's with a few passages of its own: (the other, what is replaced, what comes with it).
ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the copyright holder.

4. Neither"""
NETWORK = """13. Remote Network Interaction; Use with the GNU General Public License.

Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer
all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity
to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at
no charge, through some standard or customary means of facilitating copying of software."""
VARIANTS = {
    "AGPL-3.0": ("GPL-3.0", (("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE"), ("GNU General Public License", "GNU Affero General Public License"), ("GNU Affero Affero", "GNU Affero")), NETWORK),
    "BSD-4-Clause": ("BSD-3-Clause", (("3. Neither", ADVERTISING),), ""),
}


def full_text(spdx: str) -> str | None:
    """A licence's whole text, where there is one."""
    other, changes, more = VARIANTS.get(spdx, (spdx, (), ""))
    path = Path(__file__).parent / "licenses" / f"{other}.txt"
    if not path.exists():
        return None
    text = path.read_text()
    for old, new in changes:
        text = text.replace(old, new)
    return f"{text}\n{more}" if more else text


def default_templates() -> dict[str, tuple[str, ...]]:
    """Of each licence: its full text where there is one, statements of its names, SPDX lines and sentences of notices."""
    out = {}
    for spdx, (names, notices) in NAMES.items():
        full = full_text(spdx)
        ids = [spdx, *([f"{spdx}-only", f"{spdx}-or-later"] if "GPL" in spdx else [])]
        said = [f"{verb} under the {n}" for n in names for verb in ("Licensed", "Released", "This work is licensed")]
        out[spdx] = (*([full] if full else []), *said, *(f"SPDX-License-Identifier: {i}" for i in ids), *notices)
    return out


_SPEAKS = r"(?i)licen[cs]e|licenci|copyright|spdx-|creative commons|redistribut|hereby granted|public domain"


@dataclass(frozen=True)
class Scan:
    least_cosine: float = 0.4
    #: The whole text of a licence file is so near to a template.
    least_whole_cosine: float = 0.75


def terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def weights(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, str, int, float, float]]:
    """(term, licence, number of its template, unit weight, idf): TF-IDF over all templates."""
    bags = {(n, i): Counter(terms(t)) for n, ts in templates.items() for i, t in enumerate(ts)}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + c)) + 1 for w, c in df.items()}
    out = []
    for (name, i), bag in sorted(bags.items()):
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in bag.items()))
        out += [(w, name, i, c * idf[w] / norm, idf[w]) for w, c in sorted(bag.items())]
    return out


class Model:
    """The templates' weights as a matrix, terms by templates."""

    def __init__(self, weight: list[tuple[str, str, int, float, float]]) -> None:
        self.row = {w: i for i, w in enumerate(dict.fromkeys(x[0] for x in weight))}
        column = {t: i for i, t in enumerate(sorted({x[1:3] for x in weight}))}
        self.names = [name for name, _ in column]
        self.idf, self.of = np.zeros(len(self.row)), np.zeros((len(self.row), len(column)))
        for w, name, k, v, idf in weight:
            self.idf[self.row[w]], self.of[self.row[w], column[name, k]] = idf, v
        self.unknown = math.log(1 + len(column)) + 1  # a word that no template has

    def best(self, text: str) -> tuple[str, float]:
        """The nearest template's name, the first of equally near ones, and the cosine."""
        bag = Counter(terms(text))
        known = sorted((i, c) for w, c in bag.items() if (i := self.row.get(w)) is not None)
        if not known:
            return "", 0.0
        at = np.array([i for i, _ in known])
        x = np.array([c for _, c in known]) * self.idf[at]
        norm = math.sqrt(float(x @ x) + self.unknown**2 * sum(c * c for w, c in bag.items() if w not in self.row))
        score = np.round(x @ self.of[at] / norm, 9)
        k = int(np.argmax(score))
        return self.names[k], float(score[k])


def header(text: Column) -> Column:
    """The lines that speak of a licence."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(_SPEAKS)))


def matches(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, scan: Scan = Scan()) -> DataFrame:
    """(file, path, own, score, is_license_file) of each row of `files` (file, path, text); own is null where neither the
    whole text nor the header matches a template."""
    weight = weights(default_templates() if templates is None else templates)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weight)
        for batch in batches:
            rows = []
            for file, path, text, head in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own, score = model.best(text) if text else ("", 0.0)
                if not (whole := score >= scan.least_whole_cosine):
                    # each line by itself, too: a licence that is named among others still matches
                    found = [model.best(x) for x in dict.fromkeys([*head, "\n".join(head)])]
                    own, score = min(found, key=lambda x: (-x[1], x[0]), default=("", 0.0))
                fits = whole or score >= scan.least_cosine
                rows.append((file, path, own if fits else None, score if fits else 0.0, whole))
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "path", "own", "score", "is_license_file"])

    texts = files.select("file", "path", "text", header(F.col("text")).alias("head"))
    return texts.mapInArrow(compare, "file string, path string, own string, score double, is_license_file boolean")


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, how: Scan = Scan()) -> DataFrame:
    """(file, path, license, score, found: header, file, inherited or none, from_path) of each file."""
    found = written(matches(files, templates, how))
    dirs = found.filter("is_license_file").groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("name"))).alias("l"))
    # directories, not files, look for their ancestors: there are fewer, and a hot one is looked up once
    asked = found.select(directory(F.col("path")).alias("of")).distinct().select("of", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(F.split("of", "/"))), lambda n: F.array_join(F.slice(F.split("of", "/"), F.lit(1), n), "/")))).alias("dir"))
    nearest = asked.join(dirs, "dir").groupBy("of").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", F.col("l.name").alias("name"))).alias("near")).select("of", F.col("near.dir").alias("dir"), F.col("near.name").alias("name"))
    out = found.withColumn("of", directory(F.col("path"))).join(nearest, "of", "left")
    kind = F.when(F.col("own").isNotNull(), F.when(F.col("is_license_file"), "file").otherwise("header")).when(F.col("name").isNotNull(), "inherited").otherwise("none")
    return out.select("file", "path", F.coalesce("own", "name").alias("license"), "score", kind.alias("found"), F.when(F.col("own").isNull(), F.col("dir")).alias("from_path"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree: source / language / hundred of doc_id / doc_id."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    out = scan(docs.select(F.col("doc_id").cast("string").alias("file"), path.alias("path"), "text"))
    return out.select(F.col("file").cast("bigint").alias("doc_id"), "path", "license", "score", "found", "from_path")
