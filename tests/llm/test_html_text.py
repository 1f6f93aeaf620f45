import random
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curaloom.llm import html_text
from curaloom.llm.html_text import extract_text as text

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apples<td>3</table>", "Name    Qty\nApples  3"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>a<td>b<td>d</table>", "ab    c\na  b  d"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table>stray<tr><td>x</table>", "stray\n\nx"),
    ("<pre>\n x  y\n   z</pre>", " x  y\n   z"),
    ("x<script>var a='</p>'</script>y<style>p{}</style>z", "xyz"),
    ("<div style='display:none'>no</div><span hidden>no</span><p style='VISIBILITY: hidden'>no</p>yes", "yes"),
    ("<details><summary>S</summary>gone</details><details open><summary>T</summary>there</details>", "S\nT\nthere"),
    ("<head><title>t</title></head><body>b", "b"),
    ("a &amp; b &lt;c&gt; &#233; &copy 1 < 2", "a & b <c> é © 1 < 2"),
    ("<!-- no --><!DOCTYPE html><?php no ?>yes<!-- open", "yes"),
    ("one <b>t</b>wo  \n three", "one two three"),
    ("<blockquote>q<p>w</blockquote>after", "  q\n\n  w\n\nafter"),
    ("<p>x</p><ul><li>a<li><p>b</p><p>c</p><li></ul><p>y", "x\n\n- a\n- b\n\n  c\n\ny"),
    ("<ul><li><ul><li>a</ul>b</ul>", "- - a\n  b"),
    ("<style>.h{display:none} #i, b.k {visibility:hidden}/* p{display:none} */ @media print { p{display:none} }</style><p class='x h'>no</p><p id=i>no</p><b class=k>no</b><i class=k>yes</i>", "yes"),
    ("<style>p{display:none}.on{display:block}</style><p>no<p class=on>yes<p class=on style='display:none'>no", "yes"),
    ("<style>p{display:none !important}</style><p style='display:block'>no</p><div hidden style='display:block'>yes", "yes"),
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes<b style='visibility:hidden'>no</b></p>no</div>", "yes"),
    ("<div style='display:none'>no<p style='display:block;visibility:visible'>no</p></div>yes", "yes"),
    ("<p>a</p><p>late<style>p.z{display:none}</style></p><p class=z>no</p>", "a\n\nlate"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><title>no</title><defs><text>no</text></defs>no<text>label</text><text>two</text></svg> y", "x=2 label two y"),
    ("<table><tr><td>日本<td>a<tr><td>é<td>b</table>", "日本  a\né     b"),
    ("<div hidden>" + "<b>" * 600 + "x</div><p>VISIBLE</p>", "VISIBLE"),
    ("<p style='display:none;display:block'>yes</p><p style='visibility:visible;visibility:hidden'>no</p>", "yes"),
    ("<p style='display:block !important;display:none'>yes", "yes"),
    ("a<span style='display:block'>b</span>c", "a\nb\nc"),
    ("a<div style='display:inline'>b</div>c<p style='display:inline'>d</p>", "abcd"),
    ("<style>i{display:block}</style>a<i>b</i><i>c", "a\nb\nc"),
    ("<b><p>x</b>y</p>z", "xy\n\nz"),
    ("<b style='visibility:hidden'><p>no</b>yes</p>", "yes"),
    ("<b hidden><i><div>no<p>no</b>yes</p>yes</div></i>yes", "yes\n\nyes\nyes"),
    ("<span><p>a</span>b</p>c", "ab\n\nc"),
    ("<style>nav li.x, div > p {display:none}</style><nav><ul><li class=x>no<li>yes</ul></nav><li class=x>yes<div><p>no</p><b><p>yes</p></b></div>", "- yes\n- yes\n\n  yes"),
    ("<style>#a .b i{display:none}.b{visibility:hidden}</style><u id=a><u class='c b'><i>no</i>no</u><i>yes</i></u>", "yes"),
    ("<style>@media screen{.s{display:none}}@media print{.t{display:none}}@media (max-width:9px){.t{display:none}}@supports (a:b){.t{display:none}}.u{display:none}</style><i class=s>no</i><i class=t>yes</i><i class=u>no</i>", "yes"),
    ("<style media=print>p{display:none}</style><style media='all'>b{display:none}</style><p>yes<b>no</b>", "yes"),
    ("<style>p:hover, p[x], a p ~ b {display:none}</style><p x>yes", "yes"),
    ("<a href='x", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert text(page) == want


class Words(HTMLParser):
    """All words outside script, style and head: what must show, whatever its layout."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_all_words_of_whole_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert len(got) == len(pages)
    for r in got:
        w = Words()
        w.feed(pages[r["id"]])
        squeeze = lambda s: re.sub(r"\s+", "", s)
        shown = re.sub(r"(?m)^- ", "", r["text"])
        assert squeeze(shown) == squeeze("".join(w.out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<ol>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<br>", "<a href='", "<!--", "<script>", "</script>", "<details>", "<summary>", "x ", "y\n", "&amp;", "<", ">", "'", '"', "<td colspan=9999999999>", "<caption>", "<select><option>", "</td>", "</body>", "<body>"]), max_size=40))
def test_any_soup_is_read(parts):
    out = text("".join(parts))
    assert isinstance(out, str) and "\x00" not in out


def test_deep_and_long_pages():
    assert text("<div><ul><li>" * 3000 + "x").strip().endswith("x")
    assert text("<table><tr><td>" * 300 + "x").strip() == "x"
    assert text("<b>" * 30_000 + "x" + "</i>" * 30_000) == "x"
    assert text("word " * 200_000).count("word") == 200_000


def tree(rng, depth=0):
    """A random block as nested tuples."""
    word = lambda: rng.choice(("ab", "c", "déf", "ghi jk"))
    kind = rng.choice(("p", "p", "pre", "table", "ul", "ol", "blockquote") if depth < 3 else ("p",))
    if kind in ("ul", "ol"):
        return kind, [(word(), [tree(rng, depth + 1) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(1, 3))]
    if kind == "blockquote":
        return kind, [tree(rng, depth + 1) for _ in range(rng.randint(1, 3))]
    if kind == "table":
        return kind, [[word() for _ in range(3)] for _ in range(rng.randint(1, 3))]
    return kind, word() if kind == "p" else f"{word()}\n  {word()}"


def markup(block):
    kind, inner = block
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{w}{''.join(map(markup, blocks))}" for w, blocks in inner) + f"</{kind}>"
    if kind == "blockquote":
        return "<blockquote>" + "".join(map(markup, inner)) + "</blockquote>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in inner) + "</table>"
    return f"<{kind}>{inner}</{kind}>"


def plain(block, nested=False):
    """Lines of a block, by recursion."""
    kind, inner = block
    if kind in ("ul", "ol"):
        out = []
        for n, (w, blocks) in enumerate(inner, 1):
            mark = f"{n}. " if kind == "ol" else "- "
            lines = [w]
            for b in blocks:
                lines += ([] if b[0] in ("ul", "ol") else [""]) + plain(b, True)
            out += [(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines)]
        return out
    if kind == "blockquote":
        out = []
        for i, b in enumerate(inner):
            out += ([""] if i and not (nested and b[0] in ("ul", "ol")) else []) + plain(b, nested)
        return ["  " + x if x else x for x in out]
    if kind == "table":
        wide = [max(len(row[c]) for row in inner) for c in range(3)]
        return ["  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in inner]
    return inner.split("\n")


@pytest.mark.parametrize("seed", range(300))
def test_layout_against_a_plain_renderer(seed):
    rng = random.Random(seed)
    blocks = [tree(rng) for _ in range(rng.randint(1, 4))]
    assert text("".join(map(markup, blocks))) == "\n\n".join("\n".join(plain(b)) for b in blocks)


NESTS = ["<blockquote>x", "<ul><li>x", "<dl><dd>x", "<table><tr><td>x", "<div style='visibility:hidden'>x", "<i><b></i>x", "<td><i>x", "<tr><td rowspan=9 colspan=9>x", "<style>.a{display:none}</style><p class='a b c'>x", "<table><tr><td><i><b></i>x", "<b><div></b>x", "<b><i><div>x</b>", "<style>a b .c{display:none}</style><a><b class=c>x"]


@pytest.mark.parametrize("part", NESTS)
def test_a_megabyte_of_nesting_takes_seconds(part):
    """Work and output grow with the page: twice the page, about twice of both, and no page is minutes of work."""
    half, whole = (part * (n // len(part)) for n in (500_000, 1_000_000))
    began = time.process_time()
    small = text(half)
    middle = time.process_time()
    large = text(whole)
    took = time.process_time() - middle
    assert len(large) <= 2.2 * len(small) + 100 and len(large) < 80 * len(whole)
    assert took < 25 and took < 4 * (middle - began) + 2


WRAPS = ["b", "i", "div", "span", "p", "ul", "li", "table", "td", "section", "a", "blockquote"]


@pytest.mark.parametrize("seed", range(60))
def test_hidden_and_visible_words_never_swap(seed):
    """Well-formed nesting at any depth: a word shows if nothing around it is off, or the nearest that says so is visible."""
    rng = random.Random(seed)
    page, around, want, n = [], [], [], 0
    for _ in range(rng.choice((30, 3000))):
        kind = rng.random()
        if kind < 0.45:
            tag = rng.choice([w for w in WRAPS if w not in ("p", "li", "td", "table", "a", "ul")])
            style = rng.choice(["", "", "", "display:none", "visibility:hidden", "visibility:visible"])
            page.append(f"<{tag} style='{style}'>")
            around.append((tag, style))
        elif kind < 0.7 and around:
            page.append(f"</{around.pop()[0]}>")
        else:
            n += 1
            page.append(f" w{n} ")
            styles = [s for _, s in around]
            said = [s for s in styles if s.startswith("visibility")]
            if "display:none" not in styles and (not said or said[-1] == "visibility:visible"):
                want.append(f"w{n}")
    assert text("".join(page)).split() == want


def test_wide_cells_do_not_widen_every_row():
    page = "<table><tr><td>" + "w" * 100_000 + "<td>end" + "<tr><td>a<td>b" * 5000 + "</table>"
    got = text(page)
    assert len(got) < 2_000_000 and "w  end" in got and got.splitlines()[1] == "a" + " " * 81 + "b"


def test_awkward(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "<p>x", "c"), (3, "<p>y", "d"), (3, "<p>y", "d")], "page_id bigint, html string, id string")
    got = sorted(((r["id"], r["text"]) for r in html_text.extract(rows).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (None, "x"), (3, "y"), (3, "y")], key=str)
    assert html_text.extract(rows.limit(0)).count() == 0
