"""Whole licence files, SPDX lines and licences other than the corpus's own of operator 5."""

from pathlib import Path

import pytest

from parlance.llm import license_scan

MIT = """The MIT License (MIT)

Copyright (c) 2019-2021 Jane Roe and the contributors of Example Software

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
CODE = "def f(x):\n    return x\n" * 30


def test_whole_files_spdx_and_other_licences(spark):
    full = {p.stem: p.read_text() for p in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
    files = [("mit", "m/LICENSE", MIT, "MIT", "file"), ("below", "m/src/x.py", CODE, "MIT", "inherited")]
    files += [(f"full {n}", f"{n}/LICENSE", f"Copyright 2020 Jane Roe\n\n{t}\n", n, "file") for n, t in full.items()]
    files += [(f"spdx {n}", "s/x.py", f"# SPDX-License-Identifier: {n}\n{CODE}", n, "header") for n in ("Apache-2.0", "GPL-3.0", "MPL-2.0", "BSD-3-Clause", "MIT", "ISC", "CC-BY-SA-4.0")]
    files += [(f"says {n}", "t/x.md", f"Licensed under CC {n} 4.0.\n{CODE}", f"CC-{n}-4.0", "header") for n in ("BY", "BY-SA", "BY-NC", "BY-NC-ND")]
    files += [("unknown", "t/y.py", f"# SPDX-License-Identifier: Foo-1.0\n{CODE}", None, "none"), ("code", "u/y.py", CODE, None, "none"), ("embedded", "t/z.py", f"{MIT}\n{CODE * 4}", "MIT", "header")]
    out = {r["file"]: (r["license"], r["found"]) for r in license_scan.scan(spark.createDataFrame([f[:3] for f in files], "file string, path string, text string")).collect()}
    assert out == {f[0]: f[3:] for f in files}


@pytest.mark.parametrize("name", sorted(license_scan.NAMES))
def test_a_licence_is_nearest_to_its_own_templates(name):
    templates = license_scan.default_templates()
    model = license_scan.Model(license_scan.weights(templates))
    assert {model.best(t)[0] for t in templates[name]} == {name}


def test_near_licences_and_repeated_rows(spark):
    gpl, bsd = ((Path(license_scan.__file__).parent / "licenses" / f"{n}.txt").read_text() for n in ("GPL-3.0", "BSD-3-Clause"))
    affero = gpl.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public License", "GNU Affero General Public License") + "\nan opportunity to receive the Corresponding Source from a network server, all users interacting with it remotely through a computer network"
    four = bsd.replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Jane Roe.\n\n4. Neither")
    rows = [("a", "a/COPYING", affero), ("b", "b/LICENSE", four), ("c", "c/COPYING", gpl), ("d", "d/LICENSE", bsd), ("x", "a/x.py", CODE)]
    out = {r["file"]: (r["license"], r["found"]) for r in license_scan.scan(spark.createDataFrame(rows, "file string, path string, text string")).collect()}
    assert out == {"a": ("AGPL-3.0", "file"), "b": ("BSD-4-Clause", "file"), "c": ("GPL-3.0", "file"), "d": ("BSD-3-Clause", "file"), "x": ("AGPL-3.0", "inherited")}
    same = [("r", "e/x", MIT), ("r", "e/x", CODE), ("r", "e/x", CODE), (None, None, None), (None, None, ""), ("n", None, CODE)]
    df = spark.createDataFrame([(*r, 1, "l", "o") for r in same], "file string, path string, text string, score int, own string, of string")
    got = sorted(((r["file"], r["license"], r["found"]) for r in license_scan.scan(df).collect()), key=str)
    assert got == sorted([("r", "MIT", "file"), ("r", "MIT", "inherited"), ("r", "MIT", "inherited"), (None, None, "none"), (None, None, "none"), ("n", None, "none")], key=str)
    assert license_scan.scan(df.limit(0)).collect() == []


def test_scores_against_brute_force(spark):
    """TF-IDF cosines without the matrix, over pairs of dictionaries."""
    import math
    from collections import Counter

    templates = license_scan.default_templates()
    listed = [(n, t) for n, ts in templates.items() for t in ts]
    df = Counter(w for _, t in listed for w in set(license_scan.terms(t)))
    idf = lambda w: math.log((1 + len(listed)) / (1 + df[w])) + 1 if w in df else math.log(1 + len(listed)) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(license_scan.terms(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(n, vector(t)) for n, t in listed]
    texts = [MIT, CODE, f"{MIT}\nwith more words of its own", "Licensed under the Apache License, Version 2.0", "Copyright 2020, all rights reserved"]
    for text in texts:
        own = vector(text)
        best = max(((sum(v * own.get(w, 0) for w, v in t.items()) / norm(t) / norm(own)), n) for n, t in vectors)
        name, score = license_scan.Model(license_scan.weights(templates)).best(text)
        assert abs(score - best[0]) < 1e-8 and (name == best[1] or score == 0)
