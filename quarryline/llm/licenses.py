"""Licence scan: cosine of passages to templates, and inheritance along directories.

Every line and every paragraph of a file is a passage. Passages and templates are sparse TF-IDF
vectors, with document frequencies over the templates. Templates whose cosine reaches the threshold name
the licences that a passage may state. Among these the one with the highest sum of two cosines counts, that of
terms and that of pairs of neighbouring terms, which tell "version 2" from "version 3" and one family's notice
from another's; if the best template of another licence comes too close, the passage states none for sure.
Terms that no template has only lengthen a passage's vector, so a passage whose known terms weigh too little
beside them can't reach the threshold and needs no product.

Identifiers decide where they stand: a passage with the identifiers of several licences states the expression
of them, and one that says that something is not licensed states nothing.

Licence files pass their licence on to the files below their directory: a file without a statement
of its own takes the one of its nearest ancestor directory that has a licence file, found by joining
directories with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows

#: Least cosine of a passage that states a licence.
THRESHOLD = 0.6
#: Least lead of the best licence's sum of two cosines over that of the next licence.
MARGIN = 0.03
#: SPDX identifiers, names by which texts call the licence, and openings or notices of its full text.
LICENCES = (
    ("MIT", ("the MIT License",),
     ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
      "documentation files, to deal in the Software without restriction",)),
    ("Apache-2.0", ("the Apache License, Version 2.0", "Apache License 2.0"),
     ("Apache License Version 2.0, January 2004",
      "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "GNU GPL v2"),
     ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
      "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
      "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "GNU GPL v3"),
     ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
      "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    ("LGPL-2.1", ("the GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
     ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
      "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
      "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "GNU LGPL v3"),
     ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
      "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "GNU AGPL v3"),
     ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
      "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the Simplified BSD License"), ()),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the New BSD License"),
     ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
      "following conditions are met",
      "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software")),
    ("ISC", ("the ISC License",),
     ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
      "provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("0BSD", ("the BSD Zero Clause License", "the Zero-Clause BSD License"),
     ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)),
    ("Zlib", ("the zlib License", "the zlib/libpng License"),
     ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
      "damages arising from the use of this software.",)),
    ("BSL-1.0", ("the Boost Software License, Version 1.0", "Boost Software License 1.0"),
     ("Boost Software License - Version 1.0 - August 17th, 2003",
      "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
      "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software")),
    ("MPL-2.0", ("the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
     ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("EPL-2.0", ("the Eclipse Public License, version 2.0",), ()),
    ("Unlicense", ("the Unlicense",), ("This is free and unencumbered software released into the public domain.",)),
    ("CC0-1.0", ("CC0 1.0 Universal", "the Creative Commons Zero v1.0 Universal licence"),
     ("To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0.",)),
    ("CC-BY-4.0", ("a Creative Commons Attribution 4.0 International License", "CC BY 4.0"), ()),
    ("CC-BY-SA-4.0", ("a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"), ()),
    ("CC-BY-NC-4.0", ("a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"), ()),
    ("CC-BY-ND-4.0", ("a Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"), ()),
    ("CC-BY-NC-SA-4.0", ("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"), ()),
    ("CC-BY-NC-ND-4.0", ("a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"), ()),
    ("CC-BY-3.0", ("a Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"), ()),
    ("CC-BY-SA-3.0", ("a Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"), ()),
)
#: How headers state a licence of some name, and of some identifier.
BY_NAME = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")
BY_ID = ("SPDX-License-Identifier: {}", "License: {}")


#: Endings of identifiers of the GNU family, which has them in place of the bare ones.
SUFFIXES = ("-only", "-or-later")


def identifiers(spdx: str) -> tuple[str, ...]:
    """An identifier and its variants."""
    return (spdx, *(spdx + x for x in SUFFIXES)) if "GPL" in spdx else (spdx,)


def templates(licences=LICENCES) -> tuple[tuple[str, str], ...]:
    """(identifier, text) of all templates."""
    return tuple((spdx, t) for spdx, names, texts in licences for t in (
        *(form.format(n) for form in BY_NAME for n in names), *(form.format(i) for form in BY_ID for i in identifiers(spdx)), *texts))


TEMPLATES = templates()
#: Terms that are a licence's identifier and can't be words of a text.
BY_TERM = {i.lower(): spdx for spdx, *_ in LICENCES for i in identifiers(spdx) if re.search("[0-9-]", i)} | {"mit": "MIT", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense"}
#: A statement of what is not so, in terms joined by blanks.
DENIED = re.compile(r"(?:^| )(?:not|never|no longer|isn t|aren t)(?: [a-z]+){0,2} (?:licensed|released|distributed|available|covered)(?: |$)")
#: An expression of identifiers, in terms joined by blanks.
EXPRESSION = re.compile(r"(?:^| )(?:license|spdx-license-identifier) (?P<all>(?P<first>\S+)(?: (?:or|and) \S+)+)$")
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: A file of such a name is a licence file.
LICENCE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)([.-].*)?$"


def terms(passage: str) -> list[str]:
    return TERM.findall(passage.lower())


class Space:
    """TF-IDF vectors of the templates over one kind of terms."""

    def __init__(self, counts: list[Counter]):
        df = Counter(t for c in counts for t in c)
        self.rare = math.log(1 + len(counts)) + 1
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.postings.setdefault(t, []).append((i, n * self.idf[t] / norm))

    def cosines(self, found: list[str], least: float = 0.0) -> dict[int, float]:
        """Cosine of a passage of these terms to the templates that share some; none if all are sure to be
        under least."""
        idf = self.idf
        known = Counter(t for t in found if t in idf)
        if not known:
            return {}
        own = sum((n * idf[t]) ** 2 for t, n in known.items())
        n_other = len(found) - known.total()
        # Other terms are at their lightest if all differ; the cosine is then that of the known part at most.
        if own < least * least * (own + n_other * self.rare**2) * (1 - 1e-9):
            return {}
        norm = math.sqrt(own + sum((n * self.rare) ** 2 for n in Counter(t for t in found if t not in idf).values()))
        dots: dict[int, float] = {}
        for t, n in known.items():
            w = n * idf[t]
            for i, v in self.postings[t]:
                dots[i] = dots.get(i, 0.0) + w * v
        return {i: round(d / norm, 9) for i, d in dots.items()}


def pairs(found: list[str]) -> list[str]:
    """Neighbouring terms, with the borders of the passage."""
    return [f"{a} {b}" for a, b in zip(["", *found], [*found, ""], strict=True)]


class Templates:
    def __init__(self, templates):
        counts = [(name, terms(text)) for name, text in templates]
        self.names = [name for name, _ in counts]
        self.single, self.double = Space([Counter(c) for _, c in counts]), Space([Counter(pairs(c)) for _, c in counts])

    def best(self, found: list[str], least: float = THRESHOLD) -> tuple[float, str | None]:
        """Cosine and licence of a passage of these terms: of the licences with a template of cosine `least` or more the
        one with the highest sum of both cosines, if it leads by MARGIN. (0, None) if the passage states none."""
        said = " ".join(found)
        expression = EXPRESSION.search(said)
        if expression:
            words = expression["all"].split(" ")
            if len(words) % 2 and all(w in BY_TERM for w in words[::2]) and len({BY_TERM[w] for w in words[::2]}) > 1:
                return max(self.single.cosines(found).values()), " ".join(BY_TERM[w] if k % 2 == 0 else w.upper() for k, w in enumerate(words))
        near = {i: c for i, c in self.single.cosines(found, least).items() if c >= least}
        if not near or DENIED.search(said):
            return 0.0, None
        double = self.double.cosines(pairs(found))
        top: dict[str, tuple[float, float]] = {}
        for i, c in near.items():
            top[self.names[i]] = max(top.get(self.names[i], (0.0, 0.0)), (round(c + double.get(i, 0.0), 9), c))
        ranked = sorted((-s, name) for name, (s, _) in top.items())
        if len(ranked) > 1 and ranked[0][0] + MARGIN > ranked[1][0]:
            return 0.0, None
        return top[ranked[0][1]][1], ranked[0][1]

    def scan(self, text: str | None) -> tuple[float, str | None, int]:
        """Best cosine, licence and passages that state one, over the lines of a text and its paragraphs
        of several lines. Of equal passages the first counts."""
        top, found, n = 0.0, None, 0
        paragraph: list[list[str]] = []

        def judge(passage: list[str]) -> None:
            nonlocal top, found, n
            score, name = self.best(passage)
            if name:
                n += 1
                if score > top:
                    top, found = score, name

        for line in [*(text or "").split("\n"), ""]:
            if line.strip(" \t"):
                paragraph.append(terms(line))
                judge(paragraph[-1])
            else:
                if len(paragraph) > 1:
                    judge([t for x in paragraph for t in x])
                paragraph = []
        return top, found, n


def statements(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """path, own_license (null if no passage states one for sure), own_score (its passage's cosine, six
    decimals, 0 without one), n_statements for each row of files (path, text)."""
    def each(batches):
        t = Templates(templates)
        for d in rows(batches):
            found = [t.scan(x) for x in d["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["path"], pa.string()), pa.array([f[1] for f in found], pa.string()),
                 pa.array([round(f[0], 6) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())],
                ["path", "own_license", "own_score", "n_statements"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(
        each, "path string, own_license string, own_score double, n_statements long")


def licences(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """For each row of files (path, text): path, own_license, own_score, n_statements, is_licence_file,
    license (own, or inherited) and inherited_from (the directory, "" for the root; null if own).

    A null or empty text states nothing. A null path inherits nothing. Where a directory has several
    licence files, the first by path counts. Repeated rows stay; other columns are ignored; an empty
    table gives no rows.
    """
    name = F.substring_index("path", "/", -1)
    folder = F.expr("left(path, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))")
    scanned = cut(statements(files, templates).withColumns(
        {"dir": folder, "is_licence_file": F.coalesce(name.rlike(LICENCE_NAME), F.lit(False))}))
    first = scanned.where("is_licence_file and own_license is not null").groupBy("dir").agg(F.min(F.struct("path", "own_license")).alias("x"))
    given = first.select(F.col("dir").alias("ancestor"), F.col("x.own_license").alias("given"))
    dirs = scanned.where("dir is not null").select("dir").distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn(
        "ancestor", F.expr("substring_index(dir, '/', depth)"))
    nearest = above.join(given, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("x"))
    # Written, so that Spark can split the files of a hot directory in the join.
    nearest = cut(nearest.select("dir", F.col("x.ancestor").alias("ancestor"), F.col("x.given").alias("given")))
    out = scanned.join(nearest, "dir", "left")
    return out.select("path", "own_license", "own_score", "n_statements", "is_licence_file",
                      F.coalesce("own_license", "given").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("ancestor")).alias("inherited_from"))


def laid_out(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source) as files (path, text): source/lang/class/doc_id.txt, the
    class being a hash of the doc_id. A short document that is little more than a licence statement is
    the licence file of its class if the hash is odd, else of its language.

    A null or empty source, lang or doc_id gives the name "none"; a slash in a name becomes "_", so
    no name shifts the tree. Repeated rows stay; an empty table gives no rows.
    """
    part = F.lpad(F.hex(F.pmod(F.xxhash64("doc_id"), F.lit(16))), 2, "0")
    name = lambda c: F.coalesce(F.nullif(F.replace(F.col(c).cast("string"), F.lit("/"), F.lit("_")), F.lit("")), F.lit("none"))
    short = F.coalesce((F.length("text") < 600) & F.col("text").rlike(r"(?i)licen[sc]ed?\b"), F.lit(False))
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    file = F.when(short, F.concat(F.lit("LICENSE-"), name("doc_id"))).otherwise(F.concat(name("doc_id"), F.lit(".txt")))
    return documents.select(F.concat_ws("/", name("source"), name("lang"), F.when(~short | odd, part), file).alias("path"), "text")
