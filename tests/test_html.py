import pytest

from quillspark.functions.html import body_text, parse, table_text


def test_elements_that_go():
    assert body_text("<p>Hello</p>") == "Hello"
    assert body_text("a &amp; b") == "a & b"
    out = body_text("<head><title>T</title></head><script>s()</script><style>c{}</style><!-- c --><p>x</p><blockquote>q</blockquote>y")
    assert out == "x\ny"
    assert body_text("a<br>b<br/>c") == "a\nb\nc"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "A: 1, B: 2"),
        ("<table><tr><td>Key</td><td>V</td></tr><tr><td>K2:</td><td>W</td></tr></table>", "Key: V\nK2: W"),
        ("<table><tr><td>a</td><td>b</td><td>c</td></tr></table>", "a, b, c"),
        ("<table><tr><td>only</td><td> </td></tr></table>", "only"),
        ("<table><tr><th>H</th></tr></table>", "H"),
        ("<table><tr><th>P</th><th>Q</th></tr><tr><td>x</td><td></td></tr><tfoot><tr><td>Total</td><td>9</td></tr></tfoot></table>", "P: x\nTotal: 9"),
        ("<table><tr><th>r</th><td>v</td></tr></table>", "v"),
        ("<table><caption>words</caption></table>", "words"),
        ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", "a: b\nc: d"),
    ],
)
def test_tables(html, expected):
    assert table_text(parse(html).children[0]) == expected


def test_nested_tables():
    out = body_text("<table><tr><td>out</td><td><table><tr><td>k</td><td>v</td></tr></table></td></tr></table>")
    assert out == "out: k: v"


def test_hidden_wrappers():
    for mark in ("mobile-hide", "Mobile-HIDE x", "moe-hide", "footer-copyright"):
        assert body_text(f'<div class="{mark}">gone</div>stays') == "stays"
    assert body_text('<td id="hidemobile">gone</td>stays') == "stays"
    assert body_text('<div data-sonar-role="Footer">gone</div>stays') == "stays"
    assert body_text('<span class="mobile-hide">stays</span><div class="x">too</div>') == "staystoo"


def test_unclosed():
    assert body_text("<p>a<p>b<ul><li>c<li>d</ul>") == "a\nb\nc\nd"
    assert body_text("") == ""


def test_loose_content_goes_before_its_table():
    assert body_text("<p>a</p><table>loose<tr><td>k</td><td>v</td></tr></table>") == "a\nloose\nk: v"
    assert body_text("<table><tr><b>bold</b> words<td>k</td><td>v</td></tr></table>") == "bold words\nk: v"
    assert body_text("<table><tr><td>k<b>1</b></td><td>v</td></tr> \n </table>") == "k1: v"
    assert body_text("<table><tr><td><table>in<tr><td>x</td></tr></table></td></tr></table>after") == "in x\nafter"
    assert body_text("<table><div>d<tr><td>x</td></tr></table>") == "d\n\nx"


def test_deeply_nested_tables():
    n = 1500
    out = body_text("<table><tr><td>k</td><td>" * n + "v" + "</td></tr></table>" * n + "<p>end")
    assert out.split() == ["k:"] * n + ["v", "end"]


def test_many_open_elements_and_parts():
    n = 20_000  # each part of a table looks at the innermost holder, not at all that is open
    out = body_text("<table><tr><td>" + "<b>" * n + "x" + "<td>y" * n)
    assert out == "x, " + ", ".join(["y"] * n)
