import textwrap

import numpy as np
import pytest

from assayer.llm import licenses

GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
NOTICES = {
    "gpl-3.0": GNU.format("program", ":", "", ",", "3"),
    "gpl-2.0": GNU.format("program", ";", "", ";", "2"),
    "lgpl-2.1": GNU.format("library", ";", "Lesser ", ";", "2.1"),
    "lgpl-3.0": GNU.format("library", ":", "Lesser ", ",", "3"),
    "agpl-3.0": GNU.format("program", ":", "Affero ", ",", "3"),
    "bsd": licenses.TEMPLATES["bsd"][0] + ":",
    "mit": licenses.TEMPLATES["mit"][1] + ' (the "Software"), to deal in the Software without restriction.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_wrapped_and_unwrapped_notices_name_their_family(spark, model):
    layouts = (
        lambda t: t,
        lambda t: "\n".join(textwrap.wrap(t, 70)),
        lambda t: "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 45)) + "\n */\nint main() { return 0; }",
        lambda t: "A file of the tool.\nIt reads rows and writes rows.\n" + "\n".join("# " + x for x in textwrap.wrap(t, 70)) + "\n\nimport os",
    )
    rows = [(10 * i + j, lay(t)) for i, t in enumerate(NOTICES.values()) for j, lay in enumerate(layouts)]
    got = {r.id: sorted(set(r.families)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {10 * i + j: [f] for i, f in enumerate(NOTICES) for j in range(len(layouts))}


def test_lines_of_notices_and_paragraphs(spark, model):
    gpl, mit = textwrap.wrap(NOTICES["gpl-3.0"], 70), "Released under the MIT License."
    text = "\n".join(["first words", "", *gpl, *gpl, " \t", mit, mit, ""])
    rows = [(1, text), (2, " \n\n"), (3, "")]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    n = len(gpl)
    assert got[1].families == ["gpl-3.0", "gpl-3.0", "mit", "mit"] and got[1].n_paragraphs == 3
    assert got[1].lines == [2, 2 + n, 3 + 2 * n, 4 + 2 * n] and got[1].ends == [1 + n, 1 + 2 * n, 3 + 2 * n, 4 + 2 * n]
    assert got[2].n_paragraphs == got[3].n_paragraphs == 0 and not got[2].families


def test_sample_has_each_line_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licenses, "variants", lambda t, filler, *_: seen.append(list(filler)) or [t] * 10)
    docs = spark.createDataFrame([("same line\n" * 50 + f"line of its own {i}",) for i in range(30)], "text string")
    licenses.train(docs, sample=20)
    assert len(seen[0]) == 20 == len(set(seen[0]))


def test_sample_is_bounded_by_windows_of_long_lines(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}x{j}" for j in range(20_000)) + " " + "y" * 100_000,) for i in range(4)], "text string")
    lines = licenses.sample_lines(docs, sample=3)
    assert len(lines) == 3 and all(len(x.split()) == licenses.REACH[-1] and len(x) <= (licenses.LONGEST + 1) * licenses.REACH[-1] for x in lines)


NEAR = [
    ("Creative Commons Attribution-NoDerivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("no version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", None),
    ("other licence", "Licensed under the Foo License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", None),
    ("older Apache", "Licensed under the Apache License, Version 1.1.", None),
    ("prose", "The committee granted permission to use the hall, free of charge, to any person who asked for it.", None),
]


def test_near_families_and_unknown_ones(spark, model):
    rows = [(i, t) for i, (_, t, _) in enumerate(NEAR)]
    got = {r.id: r.families for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, (name, _, family) in enumerate(NEAR):
        assert got[i] == ([family] if family else []), name


def plain_scan(model, text):
    """One text by lists and strings: every window of lines scored and confirmed alone."""
    lines = (text or "").split("\n")
    full, a = [bool(x.strip(" \t\n\r\f\v")) for x in lines], 0
    spans, paragraphs = set(), 0
    for a in range(len(lines)):
        if not full[a]:
            continue
        paragraphs += a == 0 or not full[a - 1]
        end = next((b for b in range(a, len(lines)) if not full[b]), len(lines))
        for want in (-1, -2, *licenses.REACH):
            b, n = a, 0
            while b < end and (b - a < -want if want < 0 else n < want):
                n += len(lines[b].split())
                b += 1
            spans.add((a, max(b, a + 1)))
    keys = sorted(spans)
    joined = ["\n".join(lines[a:b]) for a, b in keys]
    picked = []
    for span, t in zip(keys, joined):
        f = licenses._features([t])[0]
        z = model.weights[:, f].sum(axis=1, dtype=float) / max(1, len(f)) ** 0.5 + model.weights[:, -1]
        if any(1 / (1 + np.exp(-z)) >= model.thresholds):
            picked.append(span)
    found = {}
    for a, b in picked:
        share, family = licenses.confirmed("\n".join(lines[a:b]))
        if family:
            while b - a > 1 and licenses.confirmed("\n".join(lines[a : b - 1])) >= (share, family):
                b, (share, family) = b - 1, licenses.confirmed("\n".join(lines[a : b - 1]))
            while b - a > 1 and licenses.confirmed("\n".join(lines[a + 1 : b])) >= (share, family):
                a, (share, family) = a + 1, licenses.confirmed("\n".join(lines[a + 1 : b]))
            found[a, b] = (family, share)
    out = []
    for (a, b), (family, share) in sorted(found.items(), key=lambda x: (-x[1][1], x[0][1] - x[0][0], x[0])):
        if all(b <= c or d <= a for c, d, *_ in out):
            out.append((a, b, family, share))
    return paragraphs, sorted(out)


def test_scan_matches_a_plain_one(spark, model, odd_docs):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()[:120]]
    docs = [(i, "\n".join(t.split("\n")[:40])) for i, t in docs]  # a plain scan of long texts takes minutes
    docs += [(10_000 + i, f"some text\n{textwrap.fill(t, 50)}\n\nmore\n{t}") for i, t in enumerate(NOTICES.values())]
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect():
        text = dict(docs)[r.id]
        paragraphs, want = plain_scan(model, text)
        assert r.n_paragraphs == paragraphs
        assert [(a, b + 1, f) for a, b, f in zip(r.lines, r.ends, r.families)] == [x[:3] for x in want]
        assert np.allclose(r.shares, [x[3] for x in want])
