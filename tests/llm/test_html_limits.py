"""Pages that would make one row fail or grow: over-long references, hostile spans; list numbers; lists in cells."""

import time

import pytest

from assayer.llm import html_text


@pytest.mark.parametrize("digits", [12, 4300, 4400, 200_000])
@pytest.mark.parametrize("form", ["{}", "<p title='{}'>x</p>", "<img alt='{}'>", "<textarea>{}</textarea>"])
def test_over_long_references(digits, form):
    text = html_text.to_text(form.format("&#" + "9" * digits + ";"))
    assert text == ("x" if "title" in form else "�")
    zeros = html_text.to_text(form.format("&#" + "0" * digits + "65;"))
    assert zeros == ("x" if "title" in form else "A")


@pytest.mark.parametrize("source, text", [("&#x" + "0" * 5000 + "41;", "A"), ("&#x" + "f" * 5000 + ";", "�"), ("&#65&#66;&#0;", "AB�"), ("&#" + "1" * 20 + "x", "�x")])
def test_references_of_odd_forms(source, text):
    assert html_text.to_text(source) == text


def test_a_bad_row_does_not_fail_the_job(spark):
    rows = spark.createDataFrame([(1, "&#" + "1" * 4400), (2, "<p>fine")], "page_id long, html string")
    assert {r.id: r.text for r in html_text.extract(rows).collect()} == {1: "�", 2: "fine"}


HOSTILE = {
    "stairs": lambda n: "<table>" + "<tr><td rowspan=65534>a" * n,
    "double stairs": lambda n: "<table>" + "<tr><td rowspan=65534>a<td>b" * n,
    "wide": lambda n: "<table>" + "<tr><td colspan=1000>a<td>b" * n,
    "one wide column": lambda n: "<table>" + "<tr><td>" + "x" * 500 + "<tr><td>a<td>b" * n,
    "many columns": lambda n: "<table><tr>" + "<td>a" * (n // 2) + "<tr>" + "<td>a" * (n // 2) + "<tr><td><td>b" * 10,
    "long lists in cells": lambda n: "<table>" + f"<tr><td>{'y' * 400}<td><ul>" + "<li>a" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_output_and_time_grow_in_proportion(name):
    sizes, times = [], []
    for n in (5_000, 20_000):
        page = HOSTILE[name](n)
        began = time.process_time()
        text = html_text.to_text(page)
        times.append(time.process_time() - began)
        sizes.append(len(text))
        assert len(text) <= 20 * len(page)
        assert sum(c.isalpha() for c in text) == sum(c.isalpha() for c in page.replace("<table>", "").replace("<tr>", "").replace("<td>", "").replace("<ul>", "").replace("<li>", "").replace("<td rowspan=65534>", "").replace("<td colspan=1000>", ""))
    assert sizes[1] <= 5 * sizes[0] + 1000 and times[1] <= 10 * times[0] + 1


LISTS = [
    ("<ol start=1234567890><li>x<li>y</ol>", "1234567890. x\n1234567891. y"),
    ("<ol start=-2><li>x<li>y<li>z</ol>", "-2. x\n-1. y\n0. z"),
    ("<ol start=' +3x'><li>x</ol>", "3. x"),
    ("<ol start=x><li>x</ol>", "1. x"),
    (f"<ol start={'9' * 5000}><li>x</ol>", "1. x"),
    (f"<ol start={'0' * 5000}7><li>x</ol>", "7. x"),
    ("<ol reversed><li>x<li>y<li>z</ol>", "3. x\n2. y\n1. z"),
    ("<ol reversed start=10><li>x<li hidden>no<li>y</ol>", "10. x\n9. y"),
    ("<ol><li>x<li value=7>y<li>z</ol>", "1. x\n7. y\n8. z"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"),
    ("<ol type=I start=1994><li>x</ol>", "MCMXCIV. x"),
    ("<ol type=i><li>x<li>y<li>z<li>w</ol>", "i. x\nii. y\niii. z\niv. w"),
    ("<ol type=A start=0><li>x<li>y</ol>", "0. x\nA. y"),
    ("<ul start=4><li value=9>x</ul>", "- x"),
    ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
]


@pytest.mark.parametrize("source, text", LISTS)
def test_list_numbers(source, text):
    assert html_text.to_text(source) == text


CELLS = [
    ("<table><tr><th>plan<th>holds<tr><td>small<td><ul><li>one<li>two</ul><tr><td>large one<td>all</table>", "plan       holds\nsmall      - one\n           - two\nlarge one  all"),
    ("<table><tr><td><ol><li>a<li>bb</ol><td>x<td><pre>p\n q</pre></table>", "1. a   x  p\n2. bb      q"),
    ("<table><tr><td><p>a<p>b<td>c</table>", "a b  c"),
    ("<table><tr><td><table><tr><td>in</table><td>side</table>", "in\n\nside"),
]


@pytest.mark.parametrize("source, text", CELLS)
def test_lists_in_cells(source, text):
    assert html_text.to_text(source) == text


def plain_grid(rows):
    """Cells as lists of lines, padded to the widest line of their column, a row as high as its highest cell."""
    width = [max(len(line) for row in rows for line in row[c]) for c in range(len(rows[0]))]
    out = []
    for row in rows:
        for k in range(max(map(len, row))):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(w) for cell, w in zip(row, width)).rstrip())
    return "\n".join(out)


def test_grids_match_a_plain_layout():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(100):
        rows, source = [], "<table>"
        for _ in range(rng.integers(1, 6)):
            row = []
            source += "<tr>"
            for _ in range(4):
                lines = ["w" * rng.integers(1, 9) for _ in range(rng.integers(1, 4))]
                listed = rng.random() < 0.5
                source += "<td>" + ("<ul>" + "".join(f"<li>{x}" for x in lines) + "</ul>" if listed else " <br>".join(lines))
                row.append([f"- {x}" for x in lines] if listed else [" ".join(lines)])
            rows.append(row)
        assert html_text.to_text(source + "</table>") == plain_grid(rows)
