"""Scalar functions on text, as Spark SQL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it.
BLANK = r"[\s\x1c-\x1f]"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes off spaces alone).

    A run of blanks is tried from its start alone, so long runs stay cheap.
    """
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|(?<!{BLANK}){BLANK}+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(~c.rlike(rf"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def token_set(c: Column) -> Column:
    """Distinct runs of ``[a-z0-9]`` of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty ones are alike, an empty and a filled one are not."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0)))


def words(c: Column) -> Column:
    """Words between white space, hyphens counting as such."""
    return F.filter(F.split(F.replace(c, F.lit("-"), F.lit(" ")), rf"(?U){BLANK}+"), lambda w: w != "")


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def sft_text(instruction: Column, code: Column) -> Column:
    """A training text of an instruction and its response."""
    empty = F.lit("")
    return F.concat(F.lit("### Instruction:\n"), stripped(F.coalesce(instruction, empty)), F.lit("\n\n### Response:\n"), stripped(F.coalesce(code, empty)))


def json_object(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` of a reply, code fences taken off; null if there is none."""
    bare = stripped(F.regexp_replace(stripped(c), r"(?m)^```(?:json)?\s*|(?<!\s)\s*```$", ""))
    found = F.regexp_extract(bare, r"(?s)\A[^{]*(\{.*\})", 1)
    return F.when(found != "", found)


def response_of(decoded: Column, prompt: Column, marker: str = "### Response:") -> Column:
    """What a model wrote after the marker, else after the prompt."""
    after = F.substr(decoded, F.instr(decoded, marker) + len(marker))
    rest = F.when(F.startswith(decoded, prompt), F.substr(decoded, F.length(prompt) + 1)).otherwise(decoded)
    return stripped(F.when(F.contains(decoded, F.lit(marker)), after).otherwise(rest))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """``{{KEY}}`` replaced by its value, key by key."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def percent(c: Column, digits: int = 1) -> Column:
    """A share in per cent; a value halfway between two goes to the even one."""
    return F.format_string(f"%.{digits}f%%", F.bround(c * 100, digits))


def cost_usd(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Price of tokens, given dollars for a million."""
    return input_tokens * F.lit(float(input_price)) / F.lit(1e6) + output_tokens * F.lit(float(output_price)) / F.lit(1e6)


def hub_id(model: Column, known: dict[str, str]) -> Column:
    """A hub id stays as it is, a short name is looked up, anything else is null."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(F.contains(model, F.lit("/")), model).otherwise(F.try_element_at(table, model))


def gigabytes(size: Column) -> Column:
    return size / F.lit(1024.0**3)


def number_prefix(c: Column, digits: int = 16) -> Column:
    """The first hex digits of a text's SHA-256 as a number."""
    return F.conv(F.substr(F.sha2(c, 256), F.lit(1), F.lit(digits)), 16, 10).cast("decimal(20,0)")
