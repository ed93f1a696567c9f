"""Whole licence texts, alone and inside other texts."""

from __future__ import annotations

from pathlib import Path

import pytest

from ledgerloom.llm.license_scan import license_scan, licenses_within

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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


def test_whole_and_wrapped_texts(spark):
    commented = "x = 1\n" + "\n".join(f"# {x}" for x in MIT.split("\n")) + "\ny = 2"
    texts = [
        "MIT License\n\nCopyright (c) 2020 A B\n\n" + MIT, MIT, commented, "a\n# Licensed under the Apache\n# License, Version 2.0.\nb",
        MIT.replace("sell", "rent"), MIT[:300] + "\n" + MIT, "unreleased under the MIT License", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.whole_license for r in license_scan(df).collect()} == {0: "MIT", 1: "MIT", **dict.fromkeys(range(2, 9))}
    within = {r.doc_id: list(r.licenses) for r in licenses_within(df).collect()}
    assert within == {0: ["MIT"], 1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0"], 4: [], 5: ["MIT"], 6: [], 7: [], 8: []}


def test_altered_clauses_are_not_known(spark):
    """List letters and wrapped sentences are part of the text; notices of a holder are not."""
    path = Path("/usr/share/common-licenses/Apache-2.0")
    if not path.exists():
        pytest.skip("the text is not here")
    text = path.read_text()
    clause = next(x for x in text.split("\n") if x.strip().startswith("(c) You must retain"))
    rewrapped = MIT.replace("The above copyright notice", "The above\ncopyright notice")
    texts = [
        text, text.replace(clause, "      (c) You may remove whatever you like and"), text.replace(clause + "\n", ""), "Copyright 2001-2024 A\n(c) 2020 B\n" + text,
        rewrapped, rewrapped.replace("copyright notice and", "copyright notice or"), "Copyright by A\n[c] © 1999 B\n\n" + MIT, "(c) Someone wrote this\n" + MIT,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.whole_license for r in license_scan(df).collect()}
    assert found == {0: "Apache-2.0", 1: None, 2: None, 3: "Apache-2.0", 4: "MIT", 5: None, 6: None, 7: None}


def test_within_odd_rows(spark):
    rows = [(None, MIT, "x"), (1, MIT, "x"), (1, MIT, "x"), (2, None, "x"), (3, "", "x"), (4, "a " * 200_000 + MIT, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    found = sorted(((r.doc_id, list(r.licenses)) for r in licenses_within(df).collect()), key=repr)
    assert found == sorted([(d, ["MIT"] if t and "Permission" in t else []) for d, t, _ in rows], key=repr)
    assert licenses_within(df).columns == ["doc_id", "licenses"] and licenses_within(df.limit(0)).collect() == []


def test_published_texts(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    if not folder.exists():
        pytest.skip("the texts are not here")
    df = spark.createDataFrame([(f, (folder / f).read_text()) for f in names], "doc_id string, text string")
    assert {r.doc_id: r.whole_license for r in license_scan(df).collect()} == names
    assert all(names[r.doc_id] in r.licenses for r in licenses_within(df).collect())
