import pytest

from assayer.llm import html_text

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>b<td>22</table>", "name       n\nlong name  1\nb          22"),
    ("a<script>var t='</p>';</script>b<style>p{}</style><!-- no --> c", "ab c"),
    ("x<div style='display: none'>no</div><span hidden>no</span><b aria-hidden=true>no</b>y", "xy"),
    ("<head><title>T</title></head><body>b", "b"),
    ("one<br>two<br><br>three", "one\ntwo\n\nthree"),
    ("<pre>a\n  b\n</pre>c", "a\n  b\n\n\nc"),
    ("a < b and <i>c</i> &lt;d&gt;", "a < b and c <d>"),
    ("<script>never closed", ""),
    ("<!-- never closed", ""),
    ("</p></div>x", "x"),
    ("<b>bold<br><p>para</b> more", "bold\n\npara\n\nmore"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ('<a title="a>b" href=x>link</a>', "link"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\nd1\nd2"),
    ("<table><tr><td><ul><li>in</ul><td>side</table>", "- in  side"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_layout(source, text):
    assert html_text.to_text(source) == text


def test_all_visible_words_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html_text.extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.text and "track(" not in r.text and "margin:0" not in r.text and "<" not in r.text.replace(" < ", "")


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "<p>a", "x"), (None, "b" * 300_000, "x")], "page_id long, html string, text string")
    got = sorted((r.id or 0, len(r.text) if r.text is not None else None) for r in html_text.extract(df).collect())
    assert got == [(0, 300_000), (1, None), (2, 0), (2, 1)]
    assert html_text.extract(df.filter("false")).count() == 0
