import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from curaloom.functions import syntax, text
from curaloom.vocabulary import STUDENT_MODELS


def value(spark, column, **cells):
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string"}
    row = spark.createDataFrame([tuple(cells.values()) or (1,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in (cells or {"one": 1}).items()))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("s", ["\t\n x  ", " x\r\n", " x ", "x", "", "\x1cx\x1f", "a b"])
def test_stripped_is_what_python_strips(spark, s):
    assert value(spark, text.stripped(F.col("s")), s=s) == s.strip()
    assert value(spark, text.is_blank(F.col("s")), s=s) == (not s.strip())


def test_token_sets(spark):
    assert sorted(value(spark, text.token_set(F.col("s")), s="Write-a fn, write IT 2x")) == ["2x", "a", "fn", "it", "write"]
    sim = lambda a, b: value(spark, text.jaccard(text.token_set(F.col("a")), text.token_set(F.col("b"))), a=a, b=b)
    assert sim("", "") == 1.0 and sim("", "a") == 0.0 and sim("a b c", "b c d") == 0.5 and sim("A b", "b a a") == 1.0
    assert sim("Write a function to add two numbers in JavaScript now", "Write a function to add two numbers in JavaScript now please") >= 0.9


def test_json_objects_of_replies(spark):
    found = lambda s: value(spark, text.json_object(F.col("s")), s=s)
    assert found('```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert found('Sure! {"a": 1} done') == '{"a": 1}' and found("nothing") is None


def test_responses(spark):
    got = lambda d, p: value(spark, text.response_of(F.col("d"), F.col("p")), d=d, p=p)
    assert got("P ### Response:\n x ### Response: y ", "P") == "x ### Response: y"
    assert got("Prompt code ", "Prompt") == "code" and got(" other ", "Prompt") == "other"


def test_sft_text(spark):
    got = value(spark, text.sft_text(F.col("i"), F.col("c")), i=" do \n", c="\tcode ")
    assert got == "### Instruction:\ndo\n\n### Response:\ncode"


def test_small_functions(spark):
    assert value(spark, text.cost_usd(F.lit(1_000_000), F.lit(200_000), 3, 15)) == 6.0
    assert value(spark, text.percent(F.lit(0.4567))) == "45.7%"
    table = STUDENT_MODELS
    assert value(spark, text.hub_id(F.lit("Qwen2.5-Coder-0.5B"), table)) == "Qwen/Qwen2.5-Coder-0.5B"
    assert value(spark, text.hub_id(F.lit("a/b"), table)) == "a/b" and value(spark, text.hub_id(F.lit("zz"), table)) is None
    assert value(spark, text.rendered(F.lit("{{A}} {{B}} {{A}}"), {"A": F.lit("x"), "B": F.lit("y")})) == "x y x"
    assert value(spark, text.gigabytes(F.lit(2**31))) == 2.0
    assert value(spark, text.words(F.lit(" write-a  b\t"))) == ["write", "a", "b"]


@pytest.mark.parametrize("code,fault", [
    ("export const a = {}", None), ("const a = {}", "missing export or function declaration"), ("function f() { {", "unbalanced braces"), ("function f() {}", None),
])
def test_javascript(spark, code, fault):
    assert value(spark, syntax.javascript(F.col("c")), c=code) == fault


@pytest.mark.parametrize("code,fault", [
    ("<#macro a><#list x as y>${y}</#list></#macro>", None), ("<#if a>", "unclosed <#if> block"), ("</#if>", "unexpected </#if> without matching opener"),
    ("<#attempt>a<#recover>b</#attempt>", "unexpected </#attempt> without matching opener"), ("<#assign x=1></#assign>", "unexpected </#assign> without matching opener"),
    ("${a", "unclosed ${ expression"), ("${a}", None), ("<#if a><#else></#if>", None), ("<#IF a></#if>", None), ("<#list a></#if></#list>", "unexpected </#if> without matching opener"), ("", None),
])
def test_freemarker(spark, code, fault):
    assert value(spark, syntax.freemarker(F.col("c")), c=code) == fault


def plain_freemarker(code):
    stack = []
    for m in re.finditer(r"</#(\w+)>|<#(\w+)\b", code):
        if m[1]:
            if not stack or stack.pop() != m[1].lower():
                return f"unexpected </#{m[1].lower()}> without matching opener"
        elif m[2].lower() in syntax.BLOCKS:
            stack.append(m[2].lower())
    if stack:
        return f"unclosed <#{stack[-1]}> block"
    return "unclosed ${ expression" if "${" in code and "}" not in code else None


def test_freemarker_on_random_templates(spark):
    rng = random.Random(3)
    parts = ["<#if a>", "</#if>", "<#list x>", "</#list>", "<#else>", "${a}", "x", "</#macro>", "<#macro m>"]
    codes = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(300)]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", syntax.freemarker(F.col("c")).alias("f")).collect()
    assert [(r["c"], r["f"]) for r in rows] == [(c, plain_freemarker(c)) for c in codes]


@pytest.mark.parametrize("code,fault", [
    ("<html><body><p>a<br></p></body></html>", None), ("<p>a</p>", "missing <html> root element"), ("<html><p>", "unclosed tag <p>"), ("<html></p></html>", "mismatched tag: expected </html>, got </p>"),
    ("<html></html></b>", "unexpected closing tag </b>"), ("<html><script>var a = '</p>'</script></html>", None), ("<HTML><img><input></HTML>", None),
])
def test_html(spark, code, fault):
    assert value(spark, syntax.html(F.col("c")), c=code) == fault


def test_fault_by_language(spark):
    rows = spark.createDataFrame([("JavaScript", "x"), ("HTML", "x"), ("FreeMarker", "x"), ("HTML", None)], "l string, c string")
    got = [r[0] for r in rows.select(syntax.fault(F.col("l"), F.col("c"))).collect()]
    assert got == ["missing export or function declaration", "missing <html> root element", None, None]


def test_long_runs_stay_cheap(spark):
    import time

    rows = spark.createDataFrame([("x" + " " * 100_000 + "y",), ("{" * 50_000,), (" " * 100_000 + "```",)], "t string")
    began = time.time()
    rows.select(F.sum(F.length(text.stripped(F.col("t")))), F.count(text.json_object(F.col("t")))).collect()
    assert time.time() - began < 30


class Stack(HTMLParser):
    """The check by a parser and a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.fault, self.opened = None, []

    def handle_starttag(self, tag, attrs):
        if tag not in syntax.VOID:
            self.opened.append(tag)

    def handle_endtag(self, tag):
        if tag not in syntax.VOID:
            above = self.opened.pop() if self.opened else None
            if above != tag and self.fault is None:
                self.fault = f"mismatched tag: expected </{above}>, got </{tag}>" if above else f"unexpected closing tag </{tag}>"


def plain_html(code):
    if "<html" not in code.lower():
        return "missing <html> root element"
    parser = Stack()
    parser.feed(code)
    parser.close()
    return parser.fault or (f"unclosed tag <{parser.opened[-1]}>" if parser.opened else None)


PARTS = ["<p>", "</p>", "<b>", "</b>", "</B >", "< b>", "</ p>", "<div/>", "<br/>", "<br>", "</br>", "<i a='>'>", '<i b=">" c>', "</i>", "<a href=x/>", "</a>", "<a 'q' x>", "<a b='>", "<!-- <p> -->", "<!-- <p>", "<!doctype html>", "<?x <b>", "<!x>", "<![CDATA[ <p> ]]>",
         "<script>", "</script>", "</script >", "<script src=a/>", "<script/>", "var a = '</p>';", "<STYLE>", "</style>", "</>", "<3", "x < y", "a=\"", ">", "</p", "<", "<td a = 1 b>", "</td x>", "<a b=\"1\"c='2'>"]


def test_html_is_what_a_parser_says(spark):
    rng = random.Random(11)
    codes = ["".join(["<html>"] * (rng.random() < 0.9) + [rng.choice(PARTS) for _ in range(rng.randint(0, 9))] + ["</html>"] * (rng.random() < 0.7)) for _ in range(1500)]
    codes += ["<html>" + f"<{t}>" * 700 + f"</{t}>" * n + "</html>" for t, n in (("p", 700), ("p", 699), ("br", 0))]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", syntax.html(F.col("c")).alias("f")).collect()
    assert [(r["c"], r["f"]) for r in rows] == [(c, plain_html(c)) for c in codes]


def test_html_of_any_size(spark):
    """Long tags take no stack, and many tags take no square of time."""
    import time

    attributes = " ".join(f'a{i}="{i}>"' for i in range(20_000))
    codes = [f"<html><p {attributes}></p></html>", "<html>" + "<p><b>x</b></p>" * 10_000 + "</html>", "<html>" + "<b>" * 20_000]
    began = time.time()
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select(syntax.html(F.col("c")).alias("f")).collect()
    assert [r["f"] for r in rows] == [None, None, "unclosed tag <b>"] and time.time() - began < 60
