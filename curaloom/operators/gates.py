"""The quality gates: one reason a row, the first in order that rejects it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Gates, Taxonomy
from ..functions import syntax, text
from ..storage import store
from ..vocabulary import GATES, LANGUAGES, PREFIX
from . import contamination
from .dedup import ordered_duplicates


def anchored(pattern: str) -> str:
    """The pattern with an end that a line break can't follow."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def schema_fault(tax: Taxonomy, synthetic: bool = True, require_metadata: bool = True) -> Column:
    """The first failing check of a record as a message, else null.

    Works on the columns of ``schemas.EXAMPLE``.  Null and absent are the same.
    """
    record_id = F.coalesce("id", F.lit("<unknown>"))
    patterns = [tax.synthetic_id] if synthetic else [tax.seed_id, tax.reference_id]
    known = F.lit(False)
    for p in patterns:
        known = known | record_id.rlike(anchored(p))
    language = F.col("targetLanguage")
    prefix = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])
    domain = F.create_map(*[x for k, v in tax.domain.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    tags = F.col("tags")
    unlike = F.array(*map(F.lit, tax.difficulty))
    checks: list[tuple[Column, str, Column | str]] = [
        (~known, "id", "must match syn-(js|html|fmt)-NNNN" if synthetic else "must match seed-(js|html|fmt)-NNN or REF-(js|html|fmt)-NNN"),
        (~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), "targetLanguage", "must be JavaScript, HTML, or FreeMarker"),
        (~F.contains(record_id, F.concat(F.lit("-"), F.try_element_at(prefix, language), F.lit("-"))), "id", F.format_string("language prefix '%s' must appear in id for %s", F.try_element_at(prefix, language), language)),
        (text.is_blank(F.col("instruction")), "instruction", "must be a non-empty string"),
        (F.length("instruction") < tax.instruction_length, "instruction", f"must be at least {tax.instruction_length} characters"),
        (text.is_blank(F.col("code")), "code", "must be a non-empty string"),
        (F.length("code") < tax.code_length, "code", f"must be at least {tax.code_length} characters"),
        (F.coalesce(F.size(tags), F.lit(0)) < tax.tag_count, "tags", f"must be an array with at least {tax.tag_count} items"),
        (F.exists(tags, lambda t: text.is_blank(t)), "tags", "each tag must be a non-empty string"),
        (F.size(F.array_intersect(tags, unlike)) != 1, "tags", "must include exactly one difficulty tag (L1-trivial … L4-edge-case)"),
        (~F.arrays_overlap(tags, F.try_element_at(domain, language)), "tags", F.format_string("must include at least one domain tag for %s", language)),
    ]
    there = F.col("metadata").isNotNull()
    if require_metadata:
        checks.append((~there, "metadata", "is required"))
    checks += [(there & text.is_blank(F.col(f"metadata.{m}")), f"metadata.{m}", "is required") for m in tax.required_metadata]
    checks.append((there & ~F.col("metadata.source").isin(*tax.sources), "metadata.source", "invalid source value"))
    if synthetic:
        checks.append((there & (F.col("metadata.source") != "synthetic"), "metadata.source", "must be 'synthetic' for synthetic examples"))
    faults = [F.when(wrong, F.concat(F.lit("SeedValidationError ["), record_id, F.lit(f"] {field}: "), m if isinstance(m, Column) else F.lit(m))) for wrong, field, m in checks]
    return F.coalesce(*faults)


def quality_fault(gates: Gates, instruction: Column) -> Column:
    """Too short, vague (of several phrases the first in the alphabet is named), or without an imperative verb.

    A verb is a whole word between white space or hyphens; one search finds it, so
    long texts aren't split.
    """
    lowered = F.lower(instruction)
    inner = lowered if all(p == p.strip() for p in gates.vague_phrases) else text.stripped(lowered)
    vague = F.array_min(F.filter(F.array(*map(F.lit, gates.vague_phrases)), lambda p: F.contains(inner, p)))
    edge = r"[\s\x1c-\x1f-]"
    verb = lowered.rlike(rf"(?U)(?:^|{edge})(?:{'|'.join(map(re.escape, gates.verbs))})(?:\z|{edge})")
    return (
        F.when(F.length(instruction) < gates.instruction_length, f"instruction shorter than {gates.instruction_length} characters")
        .when(vague.isNotNull(), F.concat(F.lit("instruction contains vague phrase '"), vague, F.lit("'")))
        .when(~F.coalesce(verb, F.lit(False)), "instruction must start with an imperative verb (write, create, build, …)")
    )


def judge_fault(gates: Gates, score: Column) -> Column:
    return F.when(score.isNull(), "missing judgeScore").when(score < gates.judge_score, F.format_string("judgeScore %.2f below minimum", score))


def decide(faults: dict[str, Column], on: dict[str, bool] | None = None) -> list[Column]:
    """``accepted, reasonCode, message, gatesPassed`` from a message by reason, null where a gate passes.

    Gates that are off are left out; of the rest the first message in order decides.
    """
    names = [(reason, gate) for reason, gate in GATES if reason in faults and (on is None or on.get(reason, True))]
    if not names:
        return [F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reasonCode"), F.lit(None).cast("string").alias("message"), F.array().cast("array<string>").alias("gatesPassed")]
    reason = F.coalesce(*[F.when(faults[r].isNotNull(), r) for r, _ in names])
    place = F.coalesce(*[F.when(faults[r].isNotNull(), i) for i, (r, _) in enumerate(names)], F.lit(len(names)))
    passed = F.slice(F.array(*[F.lit(g) for _, g in names]), F.lit(1), place)
    return [reason.isNull().alias("accepted"), reason.alias("reasonCode"), F.coalesce(*[faults[r] for r, _ in names]).alias("message"), passed.alias("gatesPassed")]


def cascade(candidates: DataFrame, tax: Taxonomy, gates: Gates, keywords: list[contamination.Keyword] | DataFrame, baseline: DataFrame | None = None, baseline_text: str = "instruction", ord_col: str = "ord") -> DataFrame:
    """Every candidate with ``accepted, reasonCode, message, gatesPassed``.

    Keywords are a list that people write, tried one after the other, or a table of
    any size (``schemas.KEYWORDS``), met by key.

    Candidates have the columns of ``schemas.EXAMPLE`` and an order.  A candidate
    is a duplicate of a baseline row or of an earlier *accepted* one of any
    language.  The lint gate needs a program that isn't here; it is never run and
    never recorded as passed.
    """
    ok = {"SCHEMA_INVALID": gates.schema, "SYNTAX_FAIL": gates.syntax, "QUALITY_BAR": gates.quality, "DUPLICATE": gates.duplicate, "HELD_OUT_LEAK": gates.leak, "LOW_JUDGE_SCORE": gates.judge}
    # rows are stored where other tables meet them by number
    met_by_row = gates.duplicate or isinstance(keywords, DataFrame)
    rows = candidates.withColumn("__row", F.monotonically_increasing_id()).withColumn("__schema", schema_fault(tax) if gates.schema else F.lit(None).cast("string"))
    rows = store(rows, "gated") if met_by_row else rows
    sound = F.col("__schema").isNull()
    if isinstance(keywords, DataFrame):
        hay = F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n"), F.coalesce("code", F.lit("")))
        met = contamination.keyword_leaks(rows.where(sound) if gates.leak else rows.limit(0), "__row", hay, "targetLanguage", keywords)
        rows = rows.join(met.select(F.col("key").alias("__row"), F.struct("topic", "keyword").alias("__found")), "__row", "left")
        found = F.col("__found")
    else:
        found = contamination.leak(keywords, F.col("instruction"), F.col("code"), F.col("targetLanguage"))
    rows = rows.withColumns({
        "__syntax": F.when(sound & F.lit(gates.syntax), syntax.fault(F.col("targetLanguage"), F.when(sound, F.col("code")))),
        "__quality": F.when(sound & F.lit(gates.quality), quality_fault(gates, F.col("instruction"))),
        "__leak": F.when(sound & F.lit(gates.leak), contamination.leak_message(F.col("id"), found)),
        "__judge": F.when(sound & F.lit(gates.judge), judge_fault(gates, F.col("judgeScore"))),
    })
    rows = store(rows, "gated") if gates.duplicate else rows
    copy = F.lit(None).cast("string")
    if gates.duplicate:
        passes = "__schema IS NULL AND __syntax IS NULL AND __quality IS NULL AND __leak IS NULL AND __judge IS NULL"
        # only rows that reach the gate are compared
        reach = rows.where("__schema IS NULL AND __syntax IS NULL AND __quality IS NULL")
        copies = ordered_duplicates(reach, "__row", ord_col, "instruction", passes, gates.similarity, baseline=baseline, baseline_text=baseline_text)
        rows = rows.join(copies.where("duplicate").select(F.col("key").alias("__row"), F.lit(True).alias("__copy")), "__row", "left")
        copy = F.when(F.col("__copy"), f"instruction similarity at or above {gates.similarity:.2f} with prior example")
    faults = {"SCHEMA_INVALID": F.col("__schema"), "SYNTAX_FAIL": F.col("__syntax"), "QUALITY_BAR": F.col("__quality"), "DUPLICATE": copy, "HELD_OUT_LEAK": F.col("__leak"), "LOW_JUDGE_SCORE": F.col("__judge")}
    return rows.select(*candidates.columns, *decide(faults, ok))


def reason_counts(decided: DataFrame) -> DataFrame:
    """How many rows each reason rejected."""
    return decided.where("NOT accepted").groupBy("reasonCode").agg(F.count(F.lit(1)).alias("rows"))


def gate_summary(decided: DataFrame, gates: Gates) -> DataFrame:
    """One row: counts, the syntax pass rate (0.0 without rows) and the two thresholds."""
    one = decided.agg(
        F.count(F.lit(1)).alias("candidateCount"), F.count_if("accepted").alias("acceptedCount"), F.count_if(~F.col("accepted")).alias("rejectedCount"),
        F.count_if(F.array_contains("gatesPassed", "SyntaxValidation")).alias("syntaxPassCount"),
    )
    rate = F.coalesce(F.try_divide(F.col("syntaxPassCount").cast("double"), F.col("candidateCount")), F.lit(0.0))
    return one.withColumn("syntaxPassRate", rate).withColumns({"br005SyntaxSatisfied": F.col("syntaxPassRate") >= gates.min_syntax_rate, "br005CountSatisfied": F.col("acceptedCount") >= gates.min_accepted, "readyForManualReview": F.col("acceptedCount") > 0})


def promotion_failures(seeds: DataFrame, tax: Taxonomy, keywords: list[contamination.Keyword], pairs: DataFrame | None = None) -> DataFrame:
    """``seed_id, gate, message``: every gate that a gold seed fails; a schema failure hides the others.

    ``pairs`` are similar seeds (``left_id, right_id, similarity``); each counts
    against the left one.
    """
    rows = seeds.withColumn("__schema", schema_fault(tax, synthetic=False))
    found = contamination.leak(keywords, F.col("instruction"), F.col("code"), F.col("targetLanguage"))
    sound = rows.where("__schema IS NULL")
    out = rows.where("__schema IS NOT NULL").select(F.coalesce("id", F.lit("<unknown>")).alias("seed_id"), F.lit("SchemaValidation").alias("gate"), F.col("__schema").alias("message"))
    out = out.unionByName(sound.select(F.col("id").alias("seed_id"), F.lit("SyntaxValidation").alias("gate"), syntax.fault(F.col("targetLanguage"), F.col("code")).alias("message")).where("message IS NOT NULL"))
    out = out.unionByName(sound.select(F.col("id").alias("seed_id"), F.lit("HeldOutLeak").alias("gate"), contamination.leak_message(F.col("id"), found).alias("message")).where("message IS NOT NULL"))
    if pairs is not None:
        out = out.unionByName(pairs.select(F.col("left_id").alias("seed_id"), F.lit("DuplicateCheck").alias("gate"), F.format_string("instruction similarity %.2f with %s", "similarity", "right_id").alias("message")))
    return out


def counts_by_language(rows: DataFrame) -> DataFrame:
    """``targetLanguage, rows`` with a row for each language, zero where there are none."""
    every = rows.sparkSession.createDataFrame([(name,) for name in LANGUAGES], "targetLanguage string")
    counted = rows.groupBy("targetLanguage").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "targetLanguage", "left").select("targetLanguage", F.coalesce("n", F.lit(0)).alias("rows"))
