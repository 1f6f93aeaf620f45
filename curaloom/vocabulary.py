"""Closed sets of values of the data model."""

from __future__ import annotations

# Languages, their prefixes in ids and their directories.
LANGUAGES = ("JavaScript", "HTML", "FreeMarker")
PREFIX = {"JavaScript": "js", "HTML": "html", "FreeMarker": "fmt"}
DIRECTORY = {"JavaScript": "javascript", "HTML": "html", "FreeMarker": "freemarker"}

# Rejection reasons in the order of their gates, with the name a passed gate is recorded under.
GATES = (
    ("SCHEMA_INVALID", "SchemaValidation"),
    ("SYNTAX_FAIL", "SyntaxValidation"),
    ("LINT_FAIL", "LintPass"),
    ("QUALITY_BAR", "InstructionQuality"),
    ("DUPLICATE", "DuplicateCheck"),
    ("HELD_OUT_LEAK", "HeldOutLeak"),
    ("LOW_JUDGE_SCORE", "LLMJudge"),
)
REASONS = tuple(reason for reason, _ in GATES) + ("BUDGET_EXCEEDED",)

# How candidates are expanded, the cycle of methods by batch, compression methods and schedules.
EXPANSION_METHODS = ("self-instruct", "evol-deepen", "evol-widen", "evol-shorten")
METHOD_CYCLE = ("self-instruct", "self-instruct", "self-instruct", "evol-deepen", "evol-widen", "evol-shorten")
COMPRESSION_METHODS = ("FewShot", "LoRA", "QLoRA", "DoRA")
RANKED_METHODS = ("LoRA", "QLoRA", "DoRA")
DATA_SCHEDULES = ("SingleLanguage", "MixedLanguages")
REVIEW_STATUS = ("Pending", "Approved", "Rejected")
DECISIONS = ("accept", "reject")
EVIDENCE = {"Established": "L1", "QuantumInspired": "L2", "NovelApplication": "L3", "Speculative": "L4"}

# Legal transitions of the three kinds of runs, and the states they end in.
TRANSITIONS = {
    "generation": (
        ("Pending", "Generating", "start"),
        ("Generating", "Filtering", "generationComplete"),
        ("Generating", "Failed", "generationFailed"),
        ("Filtering", "AwaitingManualReview", "awaitReview"),
        ("Filtering", "Completed", "filterComplete"),
        ("AwaitingManualReview", "Completed", "approve"),
        ("AwaitingManualReview", "Failed", "reject"),
    ),
    "training": (
        ("Pending", "Running", "start"),
        ("Running", "Completed", "complete"),
        ("Running", "Failed", "fail"),
        ("Pending", "Failed", "fail"),
        ("Pending", "Cancelled", "cancel"),
        ("Running", "Cancelled", "cancel"),
    ),
}
TRANSITIONS["benchmark"] = TRANSITIONS["training"]
TERMINAL = ("Failed", "Cancelled")

# Short names of student models and their hub ids.
STUDENT_MODELS = {"Qwen2.5-Coder-0.5B": "Qwen/Qwen2.5-Coder-0.5B", "Qwen2.5-Coder-1.5B": "Qwen/Qwen2.5-Coder-1.5B"}
