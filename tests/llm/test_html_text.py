import pytest

from tessera.llm.html_text import extracted, page_text

CASES = [
    ("<p>One<p>Two <b>bold</b>\n  text", "One\n\nTwo bold text"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  1. x\n  2. y\n- c\n\nafter"),
    ("<ol start=3><li>a</li><li><p>b</p><p>c</p></li></ol>", "3. a\n4. b\n\n   c"),
    ("<table><tr><th>Name<th>No<tr><td>Al<td>1<tr><td>Longer name<td>22</table>", "Name         No\nAl           1\nLonger name  22"),
    ("<table><td>x<td>y</table>z", "x  y\n\nz"),
    ("a<br>b<br/>c</br>d", "a\nb\nc\nd"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<pre>  x\n    y  </pre>", "  x\n    y  "),
    ("<head><title>t</title><style>.h{display:none}#i,u{visibility:hidden}</style></head><body>a<i class='q h'>b</i><u>c</u><b id=i>d</b><script>var t='</p>';</script><em hidden>e</em><s style='display: none'>f</s>g</body>", "ag"),
    ("x &lt;b&gt; &amp;amp; &nbsp;y &eacute;", "x <b> &amp; \xa0y é"),
    ("<!-- <p>no</p> -->yes<!doctype html><?php x ?>", "yes"),
    ("<details><summary>s</summary>hid<p>den</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    ("1 < 2 and <3 <b", "1 < 2 and <3 <b"),
    ('<a title="a>b" href=x>link</a><img src=a alt=b>', "link"),
    ("<select><option>a<option>b</select><textarea> k </textarea>", "a\nb\n k "),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<p>a<table><tr><td><p>b</td><td>c</p></td></tr></table>d</p>", "a\n\nb  c\n\nd"),
    ("", ""),
    ("<script>x", ""),
    ("<noscript>no</noscript><template>t</template>v", "v"),
    ("\x00a", "�a"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert page_text(page) == text


def test_deep_and_long_pages():
    assert page_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert page_text("<b>" * 20000 + "x") == "x"
    assert page_text("<p>w " * 50000).count("w") == 50000
    assert len(page_text('<a "' * 20000)) > 0


def test_rows(spark):
    rows = [(1, "<p>a"), (2, None), (None, "b"), (1, "<p>a"), (3, "")]
    got = extracted(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")).collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted([(1, "a"), (2, None), (None, "b"), (1, "a"), (3, "")], key=str)
    assert extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><h1>A</h1><p>B", "A\n\nB"),
        ("<!doctype html><head><meta charset=utf-8>\n<link rel=x>\n<p>B<p>C</html>", "B\n\nC"),
        ("<head><title>T</title> words <b>on</b>", "words on"),
        ("<head><title>T</title>1 < 2", "1 < 2"),
        ("<head><title>T</title>&nbsp;</br>b", "\xa0\nb"),
        ("<head><style>.h{display:none}</style><div class=h>no</div><div>yes</div>", "yes"),
        ("<head><template><p>no</p>nor</template><script>no</script><noscript>no</noscript><title>no</title> </head>yes", "yes"),
        ("<head><title>T</title><body>a</body>", "a"),
    ],
)
def test_open_heads(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>@media print{p{display:none}}</style><p>a", "a"),
        ("<style>@media screen and (max-width: 600px){p{display:none}} @media (min-width:40em){b{display:none}}</style><p>a<b>b</b>", "a"),
        ("<style media=print>p{display:none}</style><style>@supports (x:y){i{display:none}}</style><p>a<i>b</i>", "a"),
        ("<style>.m{display:none} .m{display:block}</style><p class=m>a", "a"),
        ("<style>.m{display:block} p{display:none} #i{display:none} p.n{display:none!important}</style><p class=m>a<p id=i class=m>b<p class='m n' style='display:block'>c", "a"),
        ("<p class=m>a</p><p>b</p><style>.m{display:none}</style>", "b"),
        ("<style>p::before{content:'}'} @font-face{font-family:x} @keyframes k{from{display:none}} u{display:none}</style><p>a<u>b</u>", "a"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b><ul><li>c<li style='visibility:visible'>d</ul></div>", "b\n\n- d"),
        ("<div style='display:none'>a<b style='display:block'>b</b></div>c", "c"),
        ("<p hidden>a<p hidden class=s>b<style>.s{display:block}</style>", "b"),
        ("a<!-- x --!>b<!-->c<!--->d", "abcd"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<ol reversed><li>a<li hidden>x<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<table><tr><td colspan=2>wide head<td>x<tr><td>a<td>b<td>c</table>", "wide head  x\na  b       c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td>long one<td>c</table>", "a            b\nlong one  c"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>z", "a  b\n   c\n\nz"),
        ("<input type=submit value=Go><input value=typed>x", "Go x"),
    ],
)
def test_visibility_and_spans(page, text):
    assert page_text(page) == text


SELECTED = [
    ("<style>.a .b{display:none}</style><div class=a><p class=b>no</p><p>yes</p></div><p class=b>kept</p>", "yes\n\nkept"),
    ("<style>.a>.b{display:none}</style><div class=a><b class=b>no</b><i><b class=b>yes</b></i></div>", "yes"),
    ("<style>p:not(.x){display:none}</style><p>no</p><p class=x>yes</p>", "yes"),
    ("<style>h1+p,h2~i,a:hover{display:none}</style><h1>t</h1><p>no</p><p>yes</p><h2>u</h2>v<b>w</b><i>no</i><a>x</a>", "t\n\nyes\n\nu\n\nvwx"),
    ("<style>ul>li:first-child,[data-x='a,b'],[lang|=de],[title^=no i]{display:none}</style><ul><li>no<li>yes</ul><p data-x='a,b'>no</p><b lang=de-AT>no</b><b title='NOT'>no</b>", "- yes"),
    ("<style>li:nth-child(2n),li:nth-last-child(1){display:none}</style><ol><li>1<li>2<li>3<li>4<li>5</ol>", "1. 1\n2. 3"),
    ("<style>:is(.a,.b):not(:is(p .c)){display:none}</style><b class=a>x</b><p><i class='b c'>y</i></p>", "y"),
    (r"<style>.md\:hidden,#\31 0{display:none}</style><p class='md:hidden'>no</p><p id=10>no</p><p>y</p>", "y"),
    ("<style>p::before,p:target,p:unknown(x){display:none}p .{display:none}</style><p>yes", "yes"),
    ("<style>.a{display:none}div .a{display:inline}:where(#b){display:none}#b{display:block}</style><div>x<b class=a>y</b></div><i class=a>no</i><u id=b>z</u>", "xy\nz"),
    ("<span style='display:block'>a</span>b<div style='display:inline'>c</div><div style='display:inline'>d</div>", "a\nbcd"),
    ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
    ('abc<div class="x', "abc"),
    ("abc<div class=x <b>d</b>", "abc<div class=x d"),
]


@pytest.mark.parametrize(("page", "text"), SELECTED)
def test_selectors_display_and_ends(page, text):
    assert page_text(page) == text


def test_words_equal_a_second_parser():
    """All words of random pages in order, against the standard library's parser without a tree."""
    import random
    from html.parser import HTMLParser

    from tessera.llm import html_text

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden = [], []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.NEVER:
                self.hidden.append(tag)

        def handle_endtag(self, tag):
            if self.hidden and self.hidden[-1] == tag:
                self.hidden.pop()

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    r = random.Random(3)
    plain = ["p", "div", "b", "i", "span", "section", "h2", "ul", "li", "pre", "blockquote", "table", "tr", "td", "dl", "dt", "dd", "a", "em"]
    for _ in range(300):
        page, n = [], 0
        for _ in range(r.randint(1, 60)):
            n += 1
            tag = r.choice(plain)
            page.append(r.choice([f"<{tag} class='c{n}'>", f"<{tag}>", f"</{tag}>", f" w{n} ", f" w{n}&amp;x ", f"<script>no{n} < 3</script>", f"<style>.c{n - 1}{{color:red}}</style>", f"<!-- no{n} -->", "<br>", "<img alt=no>"]))
        second = Words()
        second.feed("".join(page))
        second.close()
        got = [w for w in page_text("".join(page)).split() if w != "-"]
        assert sorted(got) == sorted(second.words), "".join(page)
        if not any(t in "".join(page) for t in ("<table", "<tr", "<td")):
            assert got == second.words, "".join(page)
