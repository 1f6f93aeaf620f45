"""Configuration: YAML files into plain dataclasses on the driver.

The small dimensions (topics, keywords) also have a form as DataFrames.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_yaml(path: str | Path) -> dict[str, Any]:
    """A configuration file; one of JSON, which is YAML as well, needs no package."""
    if str(path).endswith(".json"):
        return json.loads(Path(path).read_text(encoding="utf-8"))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml; build the dataclass in code instead") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


@dataclass(frozen=True)
class Taxonomy:
    """What a record may say.  The defaults are the fixed values of version 1."""

    version: str = "v1"
    difficulty: tuple[str, ...] = ("L1-trivial", "L2-standard", "L3-composite", "L4-edge-case")
    domain: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "JavaScript": ("array", "object", "async", "dom", "validation", "module", "class", "functional", "error-handling"),
            "HTML": ("forms", "semantic", "accessibility", "layout", "metadata", "tables", "media"),
            "FreeMarker": ("macro", "include", "list", "condition", "formatting", "nested", "custom-directive"),
        }
    )
    required_metadata: tuple[str, ...] = ("author", "created", "source")
    sources: tuple[str, ...] = ("manual", "reference", "synthetic")
    seed_id: str = "^seed-(js|html|fmt)-[0-9]{3}$"
    reference_id: str = "^REF-(js|html|fmt)-[0-9]{3}$"
    synthetic_id: str = "^syn-(js|html|fmt)-[0-9]{4}$"
    instruction_length: int = 20
    code_length: int = 10
    tag_count: int = 2


def taxonomy(path: str | Path) -> Taxonomy:
    raw = read_yaml(path)
    ids, limits, meta = raw["idPatterns"], raw["limits"], raw["metadata"]
    return Taxonomy(
        raw["version"], tuple(raw["difficultyTags"]), {k: tuple(v) for k, v in raw["domainTags"].items()}, tuple(meta["requiredFields"]), tuple(meta["allowedSources"]),
        ids["seed"], ids["reference"], ids["synthetic"], int(limits["instructionMinLength"]), int(limits["codeMinLength"]), int(limits["tagsMinCount"]),
    )


@dataclass(frozen=True)
class Gates:
    """Which gates run, and their thresholds.  The defaults are the fixed values of version 1."""

    version: str = "v1"
    schema: bool = True
    syntax: bool = True
    lint: bool = True
    quality: bool = True
    duplicate: bool = True
    leak: bool = True
    judge: bool = False
    judge_score: float = 0.7
    similarity: float = 0.95
    instruction_length: int = 20
    vague_phrases: tuple[str, ...] = ("help me", "fix this", "make it better", "something that", "your code here", "todo")
    verbs: tuple[str, ...] = ("write", "create", "build", "implement", "define", "export", "render", "add", "develop", "construct", "design", "produce", "generate")
    min_accepted: int = 1500
    min_syntax_rate: float = 0.90


def gates(path: str | Path) -> Gates:
    raw = read_yaml(path)
    on, limits, publish = raw["gates"], raw["thresholds"], raw["publishDefaults"]
    return Gates(
        raw["version"], *(bool(on[k]) for k in ("schemaValidation", "syntaxValidation", "lintPass", "instructionQuality", "duplicateCheck", "heldOutLeak")),
        bool(on["llmJudge"]["enabled"]), float(on["llmJudge"]["minScore"]), float(limits["duplicateSimilarity"]), int(limits["instructionMinLength"]),
        tuple(p.lower() for p in raw["vaguePhrases"]), tuple(v.lower() for v in raw["imperativeVerbs"]), int(publish["minAcceptedPerLanguage"]), float(publish["minSyntaxPassRate"]),
    )


@dataclass(frozen=True)
class Scope:
    """Topics to train on and topics held out, in file order."""

    version: str
    test_set_version: str
    training: tuple[dict[str, Any], ...]
    held_out: tuple[dict[str, Any], ...]
    out_of_scope: dict[str, tuple[str, ...]]

    def keywords(self) -> list[tuple[str, int, str, int, str]]:
        """``(language, topic_ord, topic_id, kw_ord, keyword)`` in order."""
        return [(t["language"], i, t["id"], k, w.lower()) for i, t in enumerate(self.held_out) for k, w in enumerate(t["keywords"])]

    def keyword_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.keywords(), schemas.KEYWORDS)

    def training_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t["id"], t["language"], t["difficulty"], list(t["tags"]), t["pattern"]) for t in self.training], schemas.TOPICS)

    def held_out_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t["id"], t["language"], t["pattern"], [w.lower() for w in t["keywords"]]) for i, t in enumerate(self.held_out)]
        return spark.createDataFrame(rows, "ord INT, id STRING, language STRING, pattern STRING, keywords ARRAY<STRING>")


def scope(path: str | Path) -> Scope:
    raw = read_yaml(path)
    outside = {k: tuple(v.get("outOfScopePhase1", ())) for k, v in raw["targetLanguages"].items()}
    return Scope(raw["version"], raw["heldOutTestSetVersion"], tuple(raw["trainingTopics"]), tuple(raw["heldOutTopics"]), outside)


@dataclass(frozen=True)
class Expansion:
    target_count: int = 1500
    batch_size: int = 25
    max_budget_usd: float = 200.0
    min_gold_seeds: int = 50
    prompt_version: str = "v1"
    model: str = "mock-teacher"
    max_tokens: int = 4096
    input_usd: float = 3.0
    output_usd: float = 15.0


def expansion(path: str | Path) -> Expansion:
    raw = read_yaml(path)
    d, teacher, price = raw["defaults"], raw["teacher"], raw["pricingUsdPerMillionTokens"]
    return Expansion(int(d["targetCount"]), int(d["batchSize"]), float(d["maxBudgetUsd"]), int(d["minGoldSeeds"]), raw["promptVersion"], teacher["model"], int(teacher["maxTokens"]), float(price["input"]), float(price["output"]))


@dataclass(frozen=True)
class Publish:
    version_pattern: str = "^ds-[0-9]{4}-[0-9]{2}-[0-9]{2}-(js|html|fmt|mixed)-v[0-9]+$"
    min_accepted: int = 1500
    min_syntax_rate: float = 0.90
    require_review: bool = True
    require_completed: bool = True


def publish(path: str | Path) -> Publish:
    raw = read_yaml(path)
    t = raw["thresholds"]
    return Publish(raw["datasetVersionPattern"], int(t["minAcceptedPerLanguage"]), float(t["minSyntaxPassRate"]), bool(t["requireManualReview"]), bool(t["requireRunCompleted"]))


@dataclass(frozen=True)
class Review:
    version: str = "v1"
    sample_rate: float = 0.05
    min_sample: int = 1
    all_accepted: bool = True
    criteria: tuple[str, ...] = ()


def review(path: str | Path) -> Review:
    raw = read_yaml(path)
    return Review(raw["version"], float(raw["sampleRate"]), int(raw["minSampleSize"]), bool(raw["requireAllSampleAccepted"]), tuple(raw.get("reviewCriteria", ())))


@dataclass(frozen=True)
class Benchmark:
    test_set_version: str = "held-out-v1"
    samples_per_task: int = 5
    mock_pass_ratio: float = 0.72
    real_max_tasks: int = 5


def benchmark(path: str | Path) -> Benchmark:
    d = read_yaml(path)["defaults"]
    return Benchmark(d["heldOutTestSetVersion"], int(d["samplesPerTask"]), float(d["mockPassRatio"]), int(d["realMaxTasksPerLanguage"]))


@dataclass(frozen=True)
class Train:
    student_model: str = "Qwen2.5-Coder-0.5B"
    data_schedule: str = "MixedLanguages"
    compression_method: str = "LoRA"
    lora_rank: int = 16
    batch_size: int = 4
    learning_rate: float = 2e-4
    epochs: int = 1
    default_profile: str = "smoke"
    profiles: dict[str, dict[str, Any]] = field(default_factory=lambda: {"ci": {"maxSteps": 20, "maxTrainExamples": 50, "seeds": [42]}, "smoke": {"maxSteps": 100, "maxTrainExamples": 200, "seeds": [42]}, "publication": {"maxSteps": 500, "maxTrainExamples": 1500, "seeds": [42, 123, 456, 789, 1024]}})

    def profile(self, name: str) -> dict[str, Any]:
        if name not in self.profiles:
            raise ValueError(f"unknown profile: {name}")
        return self.profiles[name]


def train(path: str | Path) -> Train:
    raw = read_yaml(path)
    d = raw["defaults"]
    return Train(d["studentModel"], d["dataSchedule"], d["compressionMethod"], int(d["loraRank"]), int(d["batchSize"]), float(d["learningRate"]), int(d["epochs"]), raw["defaultProfile"], raw["profiles"])


@dataclass(frozen=True)
class Smoke:
    profile: str = "smoke"
    student_model: str = "Qwen2.5-Coder-0.5B"
    compression_method: str = "LoRA"
    lora_rank: int = 16
    max_examples: int = 200
    epochs: int = 1
    batch_size: int = 4
    eval_tasks: int = 20
    min_pass_at_1: float = 0.60
    seed: int = 42
    hints: tuple[str, ...] = ()


def smoke(path: str | Path) -> Smoke:
    raw = read_yaml(path)
    d = raw["defaults"]
    return Smoke(raw["profile"], d["studentModel"], d["compressionMethod"], int(d["loraRank"]), int(d["maxTrainExamples"]), int(d["epochs"]), int(d["batchSize"]), int(d["smokeEvalTasks"]), float(d["minPassAt1"]), int(d["randomSeed"]), tuple(raw.get("iterationHints", ())))


@dataclass(frozen=True)
class Phase:
    """Any of the numbered phase files: its defaults, and the rest as read."""

    version: str
    defaults: dict[str, Any]
    raw: dict[str, Any]

    def experiments(self) -> dict[str, dict[str, Any]]:
        return self.raw.get("experiments", {})

    def tie_breakers(self) -> tuple[str, ...]:
        return tuple(self.raw.get("ranking", {}).get("tieBreakers", ("peakVramGb", "durationSeconds", "trainableParamCount")))

    def run_ids(self, kind: str, profile: str) -> list[str]:
        """Run ids of every experiment, from its template."""
        return [e["runIdTemplates"][kind].replace("{profile}", profile) for e in self.experiments().values()]


def phase(path: str | Path) -> Phase:
    raw = read_yaml(path)
    return Phase(raw["version"], raw.get("defaults", {}), raw)


def run_id(template: str, **values: str | int) -> str:
    """A template with its ``{name}`` places filled in."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


def run_id_column(template: Column, **values: Column) -> Column:
    """The same for a column of templates."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def first_filled(*sources) -> list[str]:
    """The first non-empty list of run ids; a source may be a callable, called when its turn comes."""
    for source in sources:
        found = source() if callable(source) else source
        if found:
            return list(found)
    return []
