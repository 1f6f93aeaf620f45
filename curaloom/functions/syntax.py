"""Syntax checks of generated code: a message where one fails, else null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of

# Elements that need no closing tag, blocks of templates, and openers that are no blocks.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("if", "list", "macro", "attempt", "compress", "switch", "function", "recover")
NOT_BLOCKS = ("else", "elseif", "break", "continue", "return", "sep", "assign", "global", "local")


def javascript(code: Column) -> Column:
    """The check that needs no interpreter: a declaration, and as many opening braces as closing ones."""
    declared = F.contains(code, F.lit("export ")) | F.contains(code, F.lit("function "))
    return F.when(~declared, "missing export or function declaration").when(count_of(code, "{") != count_of(code, "}"), "unbalanced braces")


def freemarker(code: Column) -> Column:
    """Directives are pushed and popped in order; the first closer without its opener fails.

    The state holds the stack as an array and the first error; matches of one text
    are folded, without Python.
    """
    tags = F.transform(F.regexp_extract_all(code, F.lit(r"(?U)(</#\w+>|<#\w+\b)"), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, "[<#>]", "")))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, tag: Column) -> Column:
        name, opened = F.ltrim(tag, F.lit("/")), state["open"]
        top = F.try_element_at(opened, F.lit(-1))
        closes = F.startswith(tag, F.lit("/"))
        wrong = closes & ~F.coalesce(top == name, F.lit(False))
        rest = F.when(closes, F.slice(opened, 1, F.size(opened) - 1)).when(name.isin(*BLOCKS), F.concat(opened, F.array(name))).otherwise(opened)
        error = F.when(wrong, F.concat(F.lit("unexpected </#"), name, F.lit("> without matching opener")))
        done = state["error"].isNotNull() | wrong
        return F.struct(F.when(done, opened).otherwise(rest).alias("open"), F.coalesce(state["error"], error).alias("error"))

    end = F.aggregate(tags, start, step)
    top = F.try_element_at(end["open"], F.lit(-1))
    bare = F.when(F.contains(code, F.lit("${")) & ~F.contains(code, F.lit("}")), "unclosed ${ expression")
    return F.coalesce(end["error"], F.when(top.isNotNull(), F.concat(F.lit("unclosed <#"), top, F.lit("> block"))), bare)


#: One attribute, and what a tag has before its end.  Possessive repetitions take no stack, however long a tag is.
_ATTRIBUTE = r"""(?<=['"\s/])[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+))?+"""
_GAP = r"(?:\s|/(?!>))*+"
_REST = rf"(?:{_GAP}{_ATTRIBUTE})*+{_GAP}"
_NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*+"
#: Markup in the order in which it is tried: comments, marked sections, whole elements of raw text, raw text that never ends, tags, and what is passed over up to the next bracket.
_MARKUP = "|".join((
    r"<!--(?s:.*?)--\s*+>", r"<!\[(?i:cdata|temp|ignore|include|rcdata)(?s:.*?)\]\s*+\]\s*+>", r"<!\[(?i:if|else|endif)(?s:.*?)\]\s*+>",
    rf"<(?i:(?<raw>script|style))(?=[\t\n\r\f />]){_REST}>(?s:.*?)</\s*+(?i:\k<raw>)\s*+>", rf"<(?i:script|style)(?=[\t\n\r\f />]){_REST}>(?s:.*+)",
    rf"<{_NAME}{_REST}/?>", r"</\s*+[a-zA-Z][-.a-zA-Z0-9:_]*+\s*+>", r"<[/!?a-zA-Z][^>]*+>",
))
#: A whole element of raw text opens and closes, and so does a tag that ends in a slash of its own.
_BALANCED = rf"^<(?:(?i:(?<raw>script|style))(?=[\t\n\r\f />]){_REST}>(?s:.*)</\s*+(?i:\k<raw>)\s*+>|{_NAME}{_REST}/>)\z"
_CLOSES = r"^</(?:\s*+[a-zA-Z][-.a-zA-Z0-9:_]*+\s*+>\z|[a-zA-Z])"
_OPENS = rf"^<{_NAME}{_REST}>"
#: Tags whose depths are summed in one go.
BLOCK = 256


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a lambda would work out an expression for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(steps: Column) -> Column:
    """The running sums of an array of numbers: within blocks, from the sums of the blocks before."""
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda x, y: x + y)

    def summed(blocks: Column) -> Column:
        before = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))
        within = lambda block, start: F.transform(block, lambda _, i: start + total(F.slice(block, F.lit(1), i + 1)))
        return named(F.transform(blocks, total), lambda sums: F.flatten(F.zip_with(blocks, before(sums), within)))

    return named(F.transform(starts, lambda n: F.slice(steps, n * BLOCK + 1, F.lit(BLOCK))), summed)


def html(code: Column) -> Column:
    """Elements must close in the order in which they opened; the first tag that doesn't fit fails.

    No stack is kept.  A tag's depth is a running sum of those opened and closed
    before.  At one depth, tags open and close in turn up to the first fault, so a
    closing tag's opener is its predecessor among the tags of its depth, and one
    sort brings the two together.

    Comments, marked sections and the content of ``script`` and ``style`` hold no
    tags; void elements and tags closed by a slash need none.  What opens a bracket
    and is no markup is passed over up to the next ``>``.  Null gives null.
    """
    tags = F.regexp_extract_all(code, F.lit(f"({_MARKUP})"), F.lit(1))
    closes, opens = (lambda p: lambda t: F.regexp_like(t, F.lit(p)))(_CLOSES), (lambda p: lambda t: F.regexp_like(t, F.lit(p)))(_OPENS)
    read = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, rf"^</?\s*+({_NAME})", 1)).alias("name"), F.when(closes(t), -1).when(opens(t) & ~F.regexp_like(t, F.lit(_BALANCED)), 1).otherwise(0).alias("step")))
    # a closing name ends where its own pattern does
    counted = F.filter(read, lambda t: (t["step"] != 0) & ~t["name"].isin(*VOID))
    return F.when(~F.contains(F.lower(code), F.lit("<html")), "missing <html> root element").otherwise(named(counted, lambda own: named(running(F.transform(own, lambda t: t["step"])), lambda after: _first_fault(own, after))))


def _first_fault(own: Column, after: Column) -> Column:
    """The verdict over tags (name, step) with the depth after each."""
    level = lambda t, depth: depth + F.when(t["step"] < 0, 1).otherwise(0)
    placed = F.transform(own, lambda t, i: F.struct(level(t, F.get(after, i)).alias("level"), i.alias("place"), t["step"].alias("step"), t["name"].alias("name")))

    def verdict(tags: Column) -> Column:
        def wrong(t: Column, i: Column) -> Column:
            opener = F.get(tags, i - 1)["name"]
            bare = F.when(t["level"] < 1, F.format_string("unexpected closing tag </%s>", t["name"]))
            other = F.when(opener != t["name"], F.format_string("mismatched tag: expected </%s>, got </%s>", opener, t["name"]))
            return F.struct(t["place"].alias("place"), F.when(t["step"] < 0, F.coalesce(bare, other)).alias("message"))

        first = F.array_min(F.filter(F.transform(tags, wrong), lambda w: w["message"].isNotNull()))["message"]
        left = F.try_element_at(F.filter(tags, lambda t: (t["level"] == F.try_element_at(after, F.lit(-1))) & (t["step"] > 0)), F.lit(-1))["name"]
        return F.coalesce(first, F.when(F.try_element_at(after, F.lit(-1)) > 0, F.format_string("unclosed tag <%s>", left)))

    return named(F.sort_array(placed), verdict)


def fault(language: Column, code: Column) -> Column:
    """The message of the language's check."""
    return F.when(language == "JavaScript", javascript(code)).when(language == "HTML", html(code)).otherwise(freemarker(code))
