"""Layout-aware text of pages."""

import random

import pytest

from lintel.llm import layout_html
from tests.llm import brute


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a  b\n<b>c</b><p>d<br>e<div>f</div>g", "a b c\n\nd\ne\n\nf\ng"),
        ("<ul><li>a<li>b<ol start=3><li>c<li value=7>d<li>e</ol><li>f</ul>x", "- a\n- b\n  3. c\n  7. d\n  8. e\n- f\n\nx"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>1<tr><td><td>2</table>", "Name       Qty\napple pie  1\n           2"),
        ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r  x\n   y"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
        ("<table><tfoot><tr><td>f</tfoot><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
        ("<table>stray<tr><td>in</table>", "stray\n\nin"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
        ('<p style="display:none">x</p><i hidden>y</i><b style="visibility:hidden">z<u style="visibility:visible">v</u></b>', "v"),
        ("<style>.a{display:none} #b{visibility:hidden}</style><p class='x a'>1</p><p id=b>2</p><p>3", "3"),
        ("<head><title>t</title><script>var a='</p>';</script></head><body>x<!-- c --><noscript>n</noscript>", "xn"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("a &amp; b &lt;c&gt; &eacute; 1 < 2 <", "a & b <c> é 1 < 2 <"),
        ("<p>a</b></p></div>b</p>c", "a\n\nb\n\nc"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<textarea>a\n b</textarea><input type=submit value=Go><input value=no>", "a\n bGo"),
        ("", ""),
        ("   \n ", ""),
    ],
)
def test_text(html, text):
    assert layout_html.text_of(html).strip("\n") == text.strip("\n")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=it's>hello don't go</p><p>next</p>", "hello don't go\n\nnext"),
        ('a<p title="unclosed>hello</p>', "a"),
        ("<style>@media print{.a{display:none}}</style><p class=a>x", "x"),
        ("<style>@media screen and (min-width:600px){.a{display:none}}</style><p class=a>x<p>y", "y"),
        ("<style>@media (max-width:600px){.a{display:none}}</style><p class=a>x", "x"),
        ("<style media=print>.a{display:none}</style><p class=a>x", "x"),
        ("<style>.a{display:none} .a{display:block}</style><p class=a>x", "x"),
        ("<style>.a{display:none !important} .a{display:block}</style><p class=a>x<p>y", "y"),
        ("<style>#i{display:block} .a{display:none}</style><p class=a id=i>x", "x"),
        ("<style>.m .a{display:none}</style><div class=m><p><b class=a>x</b>y</div><p class=a>z", "y\n\nz"),
        ("<style>.m>.a{display:none}</style><div class=m><p><b class=a>x</b>y</div>", "xy"),
        ("<style>.a.b,p[data-x='1']{display:none}</style><p class=a>1<p class='b a'>2<p data-x=1>3", "1"),
        ("<style>h1+p{display:none} h2~p{visibility:hidden}</style><h1>t</h1><p>1<p>2<h2>u</h2><p>3<p>4", "t\n\n2\n\nu"),
        ("<style>p:not(.k):first-child{display:none} a:hover{display:none} p::before{display:none}</style><div><p>1<p>2</div><div><p class=k>3</div><a>4</a>", "2\n\n3\n\n4"),
        ("<style>li:nth-child(2n){display:none}</style><ul><li>1<li>2<li>3</ul>", "- 1\n- 3"),
        ("<style>/* .a{display:none} */ .b{color:red;display:none}</style><p class=a>x<p class=b>y", "x"),
        ("<style>@import url('x;y.css'); @font-face{font-family:x} .md\\:hide{display:none}</style><p class='md:hide'>x<p>y", "y"),
        ("<style>[hidden]{display:block}</style><p hidden>x", "x"),
        ("<p style='display:none;display:block'>x<p style='DISPLAY : NONE'>y", "x"),
        ("<!-->a<!--->b<!-- c --!>d</ e>f</>g<!doctype x>h<?pi?>i", "abdfghi"),
        ("<a b='1'c=\"2\"d==e f = g/ h>x</a i='>'>y<q", "xy"),
        ("<div a=\"<p>\" / >x</div>", "x"),
        ("<script><!-- </p> </scriptx> </script >x", "x"),
        ("a<plaintext>b<p>c", "a\n\nb<p>c"),
    ],
)
def test_tokens_and_cascade(html, text):
    assert layout_html.text_of(html).strip("\n") == text


def states(html):
    """Tags and text of a page, character by character, by the states of the standard's tokenizer."""
    out, state, k, quote = [], "data", 0, ""
    name = attr = value = buf = ""
    attrs, closing = {}, False
    ws = " \t\n\f\r"

    def text(c):
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + c, 0)
        else:
            out.append(("text", c, 0))

    def keep():
        if attr:
            attrs.setdefault(attr.lower(), value)

    while k < len(html):
        c = html[k]
        k += 1
        if state == "data":
            if c != "<":
                text(c)
            elif html[k : k + 3] == "!--":
                k, state, buf = k + 3, "comment", ""
                if html[k : k + 1] == ">" or html[k : k + 2] == "->":
                    k, state = html.index(">", k) + 1, "data"
            elif html[k : k + 1] in ("!", "?") and k < len(html):
                state = "bogus"
            elif html[k : k + 1] == "/" and k + 1 < len(html):
                if html[k + 1].isascii() and html[k + 1].isalpha():
                    k, state, name, attrs, closing, attr, value = k + 1, "name", "", {}, True, "", ""
                else:
                    state = "bogus"
            elif k < len(html) and html[k].isascii() and html[k].isalpha():
                state, name, attrs, closing, attr, value = "name", "", {}, False, "", ""
            else:
                text(c)
        elif state == "comment":
            buf += c
            if buf.endswith("-->") or buf.endswith("--!>"):
                state = "data"
        elif state == "bogus":
            state = "data" if c == ">" else state
        elif state == "name" and c not in ws + "/>":
            name += c
        elif state in ("name", "between", "slash") or state == "attr" and c in ws + "/>=" and attr or state == "after" or state == "bare" and c in ws + ">" or state == "closed":
            if state == "attr" and c == "=" or state == "after" and c == "=":
                state = "before value"
                continue
            if state == "attr" and c in ws or state == "after" and c in ws:
                state = "after"
                continue
            if state in ("attr", "after", "bare", "closed"):
                keep()
                attr = value = ""
            if c == ">":
                out.append(("end", name.lower(), 0) if closing else ("start", name.lower(), attrs))
                state = "data"
            elif c in ws + "/":
                state = "between"
            else:
                state, attr, value = "attr", c, ""
        elif state == "attr":
            attr += c
        elif state == "before value":
            if c in ws:
                continue
            if c in "\"'":
                state, quote = "quoted", c
            elif c == ">":
                keep()
                out.append(("end", name.lower(), 0) if closing else ("start", name.lower(), attrs))
                state = "data"
            else:
                state, value = "bare", c
        elif state == "quoted":
            if c == quote:
                state = "closed"
            else:
                value += c
        elif state == "bare":
            value += c
    return out


def test_tokens_against_the_states():
    rng = random.Random(5)
    pieces = ["<", "<", ">", ">", "/", "=", '"', "'", " ", "\n", "a", "b", "x1", "<p", "</p", "<!--", "-->", "--!>", "-", "!", "?", "é"]
    for _ in range(30_000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 16)))
        got = []
        for kind, a, b in layout_html.tokens(html):
            if kind == "text" and got and got[-1][0] == "text":
                got[-1] = ("text", got[-1][1] + a, 0)
            else:
                got.append((kind, a, b))
        assert got == states(html), html


@pytest.mark.parametrize("piece", ["<div>", "<table><tr><td>", "<ul><li>", "<b>", "<p><b>", "<blockquote>", "<!--", "<a href='", "</p>", "<td>"])
def test_deep_or_broken_pages_end(piece):
    layout_html.text_of(piece * 3000 + "x")


def test_column(spark):
    df = brute.messy(spark, [(1, "<p>a"), (2, None), (3, ""), (4, "x " * 300_000), (None, "<li>b")])
    out = layout_html.rendered(df, "text", "t")
    got = {r.doc_id: r.t for r in out.collect()}
    assert (got[1], got[2], got[3], got[None]) == ("a", None, "", "- b") and len(got[4]) == 599_999
    assert sorted(out.columns) == sorted(df.columns) and layout_html.rendered(df.where("false"), "text", "o").count() == 0
