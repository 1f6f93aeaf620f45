"""Deduplication whose outcome depends on order: a row is a duplicate of an accepted earlier one."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, store
from .components import components
from .similarity import similar_classes, token_classes

#: Pairs of a connected group that one task decides in one pass; larger groups are decided in rounds.
GROUP = 200_000
#: Rounds over all open classes before groups are looked for.
ROUNDS = 3


def decided_at_once(waiting: pd.DataFrame) -> pd.DataFrame:
    """The verdicts of one connected group, in its order.

    ``earlier`` holds a class's open neighbours before it; ``taken`` says that one
    outside of the group excludes it.
    """
    verdict: dict[str, bool] = {}
    for row in waiting.sort_values("o").itertuples(index=False):
        verdict[row.class_id] = not row.taken and not any(verdict[x] for x in row.earlier)
    return pd.DataFrame({"class_id": list(verdict), "accepted": list(verdict.values())}, columns=["class_id", "accepted"]).astype({"class_id": object, "accepted": bool})


def decided_in_rounds(rest: DataFrame, edges: DataFrame, said: DataFrame, most: int | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Verdicts by rounds, a table each, and what is open after ``most`` of them: classes and their edges.

    ``rest`` (class_id, o) is what is open before, ``said`` the verdicts so far.  A
    round decides the classes whose earlier neighbours (``other``) are decided; the
    first open class has no open neighbour before it, so every round decides some.
    """
    state: list[DataFrame] = []
    last, rounds = said, 0
    while rounds != most and not rest.isEmpty():
        rounds += 1
        before = last.select(F.col("class_id").alias("other"), "accepted")
        verdict = edges.join(before, "other", "left").groupBy("class_id").agg(F.max(F.coalesce("accepted", F.lit(False))).alias("taken"), F.count_if(F.col("accepted").isNull()).alias("open"))
        last = store(rest.join(verdict.where("taken OR open = 0"), "class_id").select("class_id", "o", (~F.col("taken")).alias("accepted")), "state")
        state = [*state, last] if len(state) < 20 else [store(reduce(DataFrame.unionByName, state), "state"), last]
        known, gone = last.select("class_id"), (rest, edges)
        rest = store(rest.join(known, "class_id", "left_anti"), "open")
        # what this round has taken into account says nothing more to the classes that are still open
        edges = store(edges.join(known, "class_id", "left_anti").join(before.select("other"), "other", "left_anti"), "edges")
        for table in gone if rounds > 1 else ():  # the first are the caller's
            forget(table)
    return state, rest, edges


def decided_by_groups(rest: DataFrame, edges: DataFrame, said: DataFrame, group: int) -> list[DataFrame]:
    """Verdicts of open classes by connected groups; those of more than ``group`` pairs by rounds.

    Finding the groups takes rounds in proportion to the logarithm of a chain.
    """
    # neighbours that were decided in the meantime: an accepted one excludes, the others say nothing
    told = edges.join(said.select(F.col("class_id").alias("other"), "accepted"), "other", "left")
    inner = store(told.where("accepted IS NULL").select("class_id", "other"), "inner")
    taken = store(told.where("accepted").select("class_id").distinct().withColumn("taken", F.lit(True)), "taken")
    roots = store(components(inner, "class_id", "other").select(F.col("node").alias("class_id"), "root"), "groups")
    rows = store(rest.join(roots, "class_id", "left").select("class_id", "o", F.coalesce("root", "class_id").alias("root")), "open")
    large = store(inner.join(rows, "class_id").groupBy("root").agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > group).select("root"), "large-groups")
    small = rows.join(large, "root", "left_anti")
    earlier = inner.groupBy("class_id").agg(F.collect_list("other").alias("earlier"))
    none = F.array().cast(earlier.schema["earlier"].dataType)
    waiting = small.join(earlier, "class_id", "left").join(taken, "class_id", "left").select("root", "class_id", "o", F.coalesce("earlier", none).alias("earlier"), F.coalesce("taken", F.lit(False)).alias("taken"))
    solved = store(waiting.groupBy("root").applyInPandas(decided_at_once, f"class_id {rest.schema['class_id'].dataType.simpleString()}, accepted boolean"), "decided")
    state = [solved.join(rest, "class_id").select("class_id", "o", "accepted")]
    if large.isEmpty():
        return state
    left = store(rows.join(large, "root", "left_semi").select("class_id", "o"), "open")
    rounds, _, _ = decided_in_rounds(left, store(edges.join(left.select("class_id"), "class_id", "left_semi"), "edges"), said)
    return [*state, *rounds]


def accepted_classes(first: DataFrame, edges: DataFrame, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``class_id, o`` of the classes of ``first`` (class_id, o) that no accepted neighbour before them excludes.

    ``edges`` lead from a class to its neighbours (``other``) before it.  A few rounds
    over tables decide nearly all classes, since chains are mostly short.  What is
    still open then is decided by connected groups, each in one pass of one task;
    only groups of more than ``group`` pairs go on by rounds.
    """
    waits = edges.select("class_id").distinct()
    free = store(first.join(waits, "class_id", "left_anti").select("class_id", "o", F.lit(True).alias("accepted")), "state")
    rest = store(first.join(waits, "class_id", "left_semi"), "open")
    state, rest, edges = decided_in_rounds(rest, edges, free, rounds)
    state = [free, *state]
    if not rest.isEmpty():
        state = [*state, *decided_by_groups(rest, edges, reduce(DataFrame.unionByName, state), group)]
    return reduce(DataFrame.unionByName, state).where("accepted").select("class_id", "o")


def ordered_duplicates(rows: DataFrame, key: str, ord_col: str, text_col: str, eligible: str, threshold: float = 0.95, by: str | None = None, baseline: DataFrame | None = None, baseline_text: str | None = None, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Per row ``key``, ``duplicate``: whether a similar row before it was accepted, or a baseline row is similar.

    A row is accepted if it is eligible and no duplicate, in the order of
    ``ord_col``: the outcome of one pass that remembers what it accepted.  Only
    rows that pass all other gates are eligible, so a row that fails one never
    stands in the way of a later row.

    Of a class of equal token sets only its first eligible row can be accepted, so
    classes are decided, and groups of classes that hang together one by one.
    """
    base = rows.select(F.col(key).alias("k"), F.col(ord_col).cast("bigint").alias("o"), F.col(text_col).alias("t"), F.col(by).alias("b") if by else F.lit("").alias("b"), F.coalesce(F.expr(eligible), F.lit(False)).alias("fit"))
    if baseline is not None:
        # rows of the baseline come first and always stay
        old = baseline.select(F.lit(None).cast(base.schema["k"].dataType).alias("k"), F.lit(-1).cast("bigint").alias("o"), F.col(baseline_text or text_col).alias("t"), F.col(by).alias("b") if by else F.lit("").alias("b"), F.lit(True).alias("fit"))
        base = base.unionByName(old)
    base = store(base.withColumn("row_no", F.monotonically_increasing_id()), "ordered")
    members, classes = token_classes(base, "row_no", "o", "t", "b" if by else None)
    classes = store(classes, "classes")
    joined = store(members.select(F.col("key").alias("row_no"), "class_id").join(base.select("row_no", "k", "o", "fit"), "row_no"), "members")
    first = store(joined.where("fit").groupBy("class_id").agg(F.min("o").alias("o")), "first")
    pairs = store(similar_classes(classes, threshold).select("a", "b"), "similar")
    both = pairs.union(pairs.select("b", "a")).toDF("class_id", "other")
    starts = first.select(F.col("class_id").alias("other"), F.col("o").alias("other_o"))
    # edges from an eligible class to eligible ones before it
    edges = store(both.join(starts, "other").join(first, "class_id").where("other_o < o").select("class_id", "other"), "edges")
    kept = store(accepted_classes(first, edges, group, rounds).withColumnRenamed("o", "kept_o"), "kept")
    near = both.join(kept.select(F.col("class_id").alias("other"), "kept_o"), "other").groupBy("class_id").agg(F.min("kept_o").alias("near_o"))
    reach = kept.join(near, "class_id", "full").select("class_id", F.least("kept_o", "near_o").alias("first_o"))
    found = joined.join(reach, "class_id", "left").where("o >= 0")
    return found.select(F.col("k").alias("key"), F.coalesce(F.col("first_o") < F.col("o"), F.lit(False)).alias("duplicate"))
