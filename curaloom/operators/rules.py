"""Resolving rules by keyword: a small theta join in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(keywords: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule`` in the order of ``ord``, each once: those always applied, and those with a trigger that contains a keyword or lies in one.

    ``keywords`` has ``keyword``; ``rules`` has ``ord, rule, trigger, always``, one
    row per trigger.  Both are lists that people write.
    """
    asked, own = F.lower("keyword"), F.lower("trigger")
    meets = F.contains(own, asked) | F.contains(asked, own)
    hit = rules.join(F.broadcast(keywords.where("keyword <> ''")), meets & (F.col("trigger") != ""), "left_semi")
    return hit.unionByName(rules.where("always")).groupBy("rule").agg(F.min("ord").alias("ord")).orderBy("ord")
