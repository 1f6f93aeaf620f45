"""Awkward tables: nulls, empty and long texts, repeated rows, columns whose names clash with the operators' own."""

import random

CLASHES = ["id", "x", "row_no", "recipe", "digest", "fp", "key", "found", "score", "pos", "part", "rank", "length", "block", "payload", "a", "b", "l", "k", "w", "item", "spans", "owner", "pairs"]


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ka", "lo", "min", "ter", "sa", "ve")) for _ in range(rng.randint(1, 4))) for _ in range(n))


LONG = words(60_000, 5)
TEXTS = [None, "", " \t\n", "one", "one two", words(40, 1), words(40, 1), words(40, 1).replace(" ", "\n"), LONG, LONG + ".", "ÄÖ é 日本語 😀 \x00\x1f tail", "a" * 3000, words(12, 3) + " secret", "the <|endoftext|> string"]


def awkward(spark):
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "without an id", None, None, None), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {c} string" for c in CLASHES)
    return spark.createDataFrame([r + tuple("c" for _ in CLASHES) for r in rows], schema).repartition(3)


def empty(spark):
    return awkward(spark).limit(0)
