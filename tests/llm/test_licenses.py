import math
import random
import re
from collections import Counter

import pytest

from quarryline.llm import licenses


def terms(text):
    return Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))


def couples(text):
    own = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
    return Counter(zip(["", *own], [*own, ""], strict=True))


VECTORS = [terms(t) for _, t in licenses.TEMPLATES]
COUPLES = [couples(t) for _, t in licenses.TEMPLATES]
DF = Counter(t for c in VECTORS for t in c)
DF2 = Counter(t for c in COUPLES for t in c)


def cosines(own, vectors, df):
    """Cosine to every template by dense vectors over all terms."""
    weigh = lambda c: {t: n * (math.log((1 + len(vectors)) / (1 + df[t])) + 1) for t, n in c.items()}
    own, out = weigh(own), []
    for c in vectors:
        b = weigh(c)
        norm = math.sqrt(sum(v * v for v in own.values()) * sum(v * v for v in b.values()))
        out.append(round(sum(v * b.get(t, 0) for t, v in own.items()) / norm, 9) if norm else 0.0)
    return out


def brute_passage(p):
    """(cosine, licence) of a passage without denials and expressions, from all cosines."""
    one, two = cosines(terms(p), VECTORS, DF), cosines(couples(p), COUPLES, DF2)
    found = {}
    for (name, _), u, b in zip(licenses.TEMPLATES, one, two, strict=True):
        if u >= licenses.THRESHOLD:
            found[name] = max(found.get(name, (0, 0)), (round(u + b, 9), u))
    ranked = sorted(((-s, name) for name, (s, _) in found.items()))
    if not ranked or len(ranked) > 1 and ranked[0][0] + licenses.MARGIN > ranked[1][0]:
        return 0.0, None
    return found[ranked[0][1]][1], ranked[0][1]


def brute_scan(text):
    """(licence, score, passages) over all lines and paragraphs, without any bound."""
    text, hits = text or "", []
    passages = []
    for p in re.split(r"\n(?:[ \t]*\n)+", "\n" + text + "\n"):
        own = [x for x in p.split("\n") if x.strip(" \t")]
        passages += own + (["\n".join(own)] if len(own) > 1 else [])
    hits = [(s, n) for s, n in map(brute_passage, passages) if n]
    top = max((s for s, _ in hits), default=0.0)
    return next((n for s, n in hits if s == top), None), round(top, 6), len(hits)


@pytest.mark.parametrize("spdx, text", licenses.TEMPLATES)
def test_each_licence_is_told_from_all_others(spdx, text):
    t = licenses.Templates(licenses.TEMPLATES)
    assert t.scan(text)[1] == spdx
    assert t.scan(f"# {text} See the file for details.")[1] in (spdx, None)


@pytest.mark.parametrize("text, spdx", [
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("// SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"),
    ("SPDX-License-Identifier: 0BSD", "0BSD"), ("SPDX-License-Identifier: Zlib", "Zlib"), ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0"), ("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("SPDX-License-Identifier: MIT AND ISC AND Zlib", "MIT AND ISC AND Zlib"),
    ("This project is not licensed under the MIT License.", None), ("It is no longer released under the ISC License", None), ("This work isn't licensed under CC BY 4.0", None),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "BSL-1.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0")])
def test_suffixes_expressions_and_denials(text, spdx):
    assert licenses.Templates(licenses.TEMPLATES).scan(text)[1] == spdx


@pytest.mark.parametrize("text, spdx", [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("CC BY 4.0", "CC-BY-4.0"),
    ("Released under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("BSD 3-Clause", "BSD-3-Clause"), ("License: ISC", "ISC"), ("The Unlicense", "Unlicense"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"), ("This is licensed under the BSD 2-Clause License", "BSD-2-Clause"),
    ("This library is licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004", "Apache-2.0"),
    ("# distributed under the Mozilla Public License, v. 2.0", "MPL-2.0"), ("the license of the poets", None),
    ("The general public was free to use the software of the work under version control.", None)])
def test_statements_that_are_no_templates(text, spdx):
    found = licenses.Templates(licenses.TEMPLATES).scan(text)
    assert found[1] == spdx and brute_scan(text) == (found[1], round(found[0], 6), found[2])


def test_scan_equals_brute_force(spark):
    r, vocab = random.Random(3), sorted(DF)
    docs = [(0, None), (1, ""), (2, "\n \n"), (3, "word " * 60_000 + "\nReleased under the MIT License.")]
    for i in range(4, 160):
        lines = [" ".join(r.choice(vocab if r.random() < 0.8 else ["zzz", "other", "qq"]) for _ in range(r.randrange(0, 7))) for _ in range(6)]
        if r.random() < 0.5:
            w = r.choice(licenses.TEMPLATES)[1].split()
            lines[r.randrange(6)] = " ".join(w[: len(w) // 2] + ["extra"] * r.randrange(3) + w[len(w) // 2 :])
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(str(i), t) for i, t in docs], "path string, text string").selectExpr("*", "1 as own_score", "2 as n_statements")
    got = {int(x.path): (x.own_license, x.own_score, x.n_statements) for x in licenses.statements(df).collect()}
    assert got == {i: brute_scan(t) for i, t in docs} and sum(x[0] is not None for x in got.values()) > 60
    assert all(licenses.Templates(licenses.TEMPLATES).scan(t)[1] is not None for _, t in licenses.TEMPLATES)


def test_inheritance_equals_walking_up(spark):
    files = [("LICENSE", "Released under the MIT License."), ("a/b/COPYING.txt", "x\n\nThis work is licensed under the GNU General Public License, version 3.\ny"),
             ("a/b/LICENSE", "no statement"), ("a/b/c/d/f.txt", "text"), ("a/x.txt", "text"), ("a/b/own.txt", "Licensed under CC BY-NC 4.0.\n" + "word " * 99),
             ("top.txt", None), ("a/bc/f", ""), (None, "Released under the MIT License."), ("a/x.txt", "text"), ("z/licensed.txt", "the license of the poets"),
             ("a/b/c/LICENSE.a", "Licensed under CC BY 4.0."), ("a/b/c/LICENSE.b", "Released under the ISC License.")]
    r = random.Random(5)
    for i in range(60):
        d = "/".join(r.choice("xyz") for _ in range(r.randrange(1, 6)))
        files.append((f"{d}/LICENSE", r.choice(licenses.TEMPLATES)[1]) if i % 6 == 0 else (f"{d}/f{i}", "nothing here"))
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 as dir", "2 as ancestor", "3 as given")
    own = {}
    for path, given in sorted((p, brute_scan(t)[0] or "") for p, t in files if p is not None):  # of one path, the lesser licence
        folder, name = path.rpartition("/")[::2]
        if re.match(licenses.LICENCE_NAME, name) and given:
            own.setdefault(folder, given)

    def walked(path, text):
        mine, folder = brute_scan(text)[0], None if path is None else path.rpartition("/")[0]
        if mine or path is None:
            return path, mine, mine, None
        while folder not in own and folder:
            folder = folder.rpartition("/")[0]
        return path, None, own.get(folder), folder if folder in own else None

    got = Counter((x.path, x.own_license, x.license, x.inherited_from) for x in licenses.licences(df).collect())
    assert got == Counter(walked(*f) for f in files) and licenses.licences(df.limit(0)).count() == 0


def test_layout_of_odd_names(spark):
    docs = [(None, "t", "en", "a"), (1, "t", None, "a/b"), (2, None, "", ""), (3, "Released under the MIT License.", "x/y", None)]
    paths = [x.path for x in licenses.laid_out(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["none.txt", "1.txt", "2.txt", "LICENSE-3"]
    assert [p.split("/")[:2] for p in paths] == [["a", "en"], ["a_b", "none"], ["none", "none"], ["none", "x_y"]]
    assert all(len(p.split("/")) in ((3, 4) if "LICENSE" in p else (4,)) for p in paths)
