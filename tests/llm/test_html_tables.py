import pytest

from assayer.llm import html_text

CASES = [
    ("<table><form><tr><td>x</td></tr></form></table>", "x"),
    ("<table><center><tr><td>a<td>b</tr></center><tr><td>ccc<td>d</table>", "a    b\nccc  d"),
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<p>p</p><table>loose<tr><td>x</td></tr></table>", "p\n\nloose\n\nx"),
    ("one <table>two<tr>three <td>x</td></tr></table>", "one twothree\n\nx"),
    ("<table><tbody><div>d</div><tr><td>x</td></tr></tbody></table>", "d\n\nx"),
    ("<table><tr><td>x</td><b>y</b></tr><img alt=z></table>", "y z\n\nx"),
    ("<table><form><caption>c</caption><tr><td>x</td></tr></form></table>", "c\nx"),
    ("<table>only text</table>", "only text"),
    ("<table><form hidden><tr><td>no</td></tr></form><tr><td>x</td></tr></table>", "x"),
    ("<pre>a</pre><table>\n<tr>\n<td>x</td>\n</tr>\n</table>", "a\n\nx"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_all_visible_text_of_tables(source, text):
    assert html_text.to_text(source) == text


def test_large_tables_are_aligned():
    got = html_text.to_text("<table>" + "".join(f"<tr><td>{'n' * (1 + i % 9)}<td>{i}" for i in range(5000)) + "</table>").split("\n")
    assert got == [("n" * (1 + i % 9)).ljust(9) + f"  {i}" for i in range(5000)]


def test_a_long_cell_does_not_pad_the_others():
    got = html_text.to_text(f"<table><tr><td>{'y' * 100_000}<td>1" + "<tr><td>ab<td>c" * 2000 + "</table>").split("\n")
    assert got == ["y" * 100_000 + "  1"] + ["ab  c"] * 2000


SPANS = [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td rowspan=3>a<td>b<tr><td>c<tr><td rowspan=2>d<td>e</table>", "a  b\n   c\n   d  e"),
    ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>y</table>", "wide one  x\na  b      y"),
    ("<table><tr><td colspan=900>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"),
    ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
]


@pytest.mark.parametrize("source, text", SPANS)
def test_spans(source, text):
    assert html_text.to_text(source) == text


def plain_columns(rows):
    """The standard's table model on a set of taken cells."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        x, places = 0, []
        for cell in row:
            while (r, x) in taken:
                x += 1
            wide, deep = (int(cell.attributes.get(k, 1)) for k in ("colspan", "rowspan"))
            places.append((x, x + wide))
            taken |= {(r + i, x + j) for i in range(deep) for j in range(wide)}
            x += wide
        out.append(places)
    return out


def test_columns_match_the_plain_table_model():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        # Cells one column wide never overlap; wider ones do only where the standard calls it an error.
        rows = [[html_text.Element("td", {"rowspan": str(rng.integers(1, 4))}) for _ in range(rng.integers(0, 5))] for _ in range(6)]
        assert html_text.columns(rows) == plain_columns(rows)
        rows = [[html_text.Element("td", {"colspan": str(rng.integers(1, 4))}) for _ in range(rng.integers(0, 5))] for _ in range(6)]
        assert html_text.columns(rows) == plain_columns(rows)
