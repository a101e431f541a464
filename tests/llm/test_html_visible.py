import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from assayer.llm import html_text

CASES = [
    ("<table>lost<tr><td>a</table>", "lost\n\na"),
    ("<table><div>inside</div><tr><td>a</table>", "inside\n\na"),
    ("<table><tr>stray<td>a</table>", "stray\n\na"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<select><option>a<option selected>b<option>c</select>x", "b x"),
    ("<select><option disabled>a<option>b<option>c</select>", "b"),
    ("<select multiple><option>a<option>b</select>", "a b"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
    ("<svg><title>no</title><defs><text>no</text></defs>no<text>one</text><text>two</text></svg>", "one two"),
    ("<svg><path d=x /><g>no</g><p>broken out</svg>", "broken out"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("a<input type=submit value=Send><input type=submit><input type=hidden value=no><input value=typed>b", "a Send Submit typed b"),
    ("<button>Go</button>", "Go"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
    ("<div style='visibility:hidden'><table><tr><td>no<td style='visibility:visible'>yes</table></div>", "yes"),
    ("<style>.x{display:none} #y, p.z {visibility:hidden}</style><p class='a x'>no<p id=y>no<p class=z>no<p><b class=z>yes</b>", "yes"),
    ("<style>/* .a{display:none} */ @media print { .b {display:none} } .c {display:none}</style><i class=a>1</i><i class=b>2</i><i class=c>3</i>", "12"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>yes", "yes"),
    ("<!-->a<!--->b<!-- c --!>d", "abd"),
    ("a</>b</ no>c<?no>d", "abcd"),
    ("a<b title='never closed>x", "a"),
    ("a<b never closed", "a"),
    ("<p a=1 b c='2' d=\"3\"e>x</p>", "x"),
    ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "a\n\nb"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_visible_text(source, text):
    assert html_text.to_text(source) == text


MEGABYTE = 1 << 20
HOSTILE = {
    "unclosed tags": "<a " * (MEGABYTE // 3),
    "unclosed quotes": "<a b='" * (MEGABYTE // 6),
    "stray end tags": "<div>" * 90_000 + "</b></i>" * 70_000 + "x",
    "stray end tags in a table": "<b><table>" * 3 + "<div>" * 90_000 + "</b></i>" * 70_000 + "x",
    "nested tables": "<table><tr><td>" * (MEGABYTE // 15),
    "nested lists": "<ul><li>x" * (MEGABYTE // 9),
    "unended scripts": "<script>" + "</script" * (MEGABYTE // 8),
    "comments": "<!-- x -" * (MEGABYTE // 8),
    "open paragraphs": "<p><b>" * (MEGABYTE // 6),
    "spans": "<table>" + "".join(f"<tr><td rowspan={20_000 - i}>x<td colspan=900>y" for i in range(20_000)),
    "style rules": "<style>" + ".a{display:none}" * 30_000 + "{" * 100_000 + "</style>" + "<i class=b>x</i>" * 30_000,
    "style without braces": "<style>" + "a " * (MEGABYTE // 2),
    "whitespace in tags": "<a" + " \n" * (MEGABYTE // 2) + ">x",
    "ampersands": "&" * MEGABYTE,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_seconds(name):
    began = time.process_time()
    html_text.to_text(HOSTILE[name])
    assert time.process_time() - began < 20


def test_a_page_of_tens_of_megabytes(spark):
    word = "<p>some words of a paragraph</p>\n"
    df = spark.createDataFrame([(1, word)], "page_id long, html string").selectExpr("page_id", f"repeat(html, {(24 << 20) // len(word)}) as html")
    row = html_text.extract(df).selectExpr("length(text) as n").first()
    assert row.n == (24 << 20) // len(word) * len("some words of a paragraph\n\n") - 2


class Walker(HTMLParser):
    """A second, naive reader: words outside hidden elements, in order, without any layout."""

    SKIP = set("script style template noscript iframe head object canvas audio video datalist".split())

    def __init__(self):
        super().__init__()
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        gone = tag in self.SKIP or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if tag in html_text.VOID:
            if tag == "img" and not self.hidden and not gone:
                self.take(a.get("alt") or "")
        elif self.hidden:
            if tag == self.hidden[0]:
                self.hidden.append(tag)
        elif gone:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[0]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.take(data)

    def take(self, text):
        self.words += re.findall(r"[^\W\d_]+", text)


def test_words_match_a_naive_walker(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        walker = Walker()
        walker.feed(r.html)
        walker.close()
        assert Counter(re.findall(r"[^\W\d_]+", html_text.to_text(r.html))) == Counter(walker.words), r.page_id
