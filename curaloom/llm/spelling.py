"""Groups of spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words with the same
letters in any order share it.  Adding, removing or exchanging a letter changes
the key by a known value.  Two words whose keys differ so both reach one number by
giving up a letter at most: an added letter by removing it from the longer word, an
exchanged one by removing it from both.  Words therefore meet on their keys with
each of their letters taken off, which is a few rows a word instead of one for each
possible change, and no change is missed.  Where they meet, the order of their
letters is verified.

Numbers that many words reach (their letters make many anagrams) are counted
first.  There the order of the remaining letters becomes part of the key, so
candidates grow with the words and not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, once, store, text_or_empty

#: What words are made of, and the capitals that are lowered.
LETTERS = r"[A-Za-zÀ-ÿ]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: With the fourth power, no text that Spark can hold overflows a sum, and no two changes of letters have the same value.
POWER = 4
#: Words that meet at one number by their keys alone.
FULL = 16


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    return code * code * code * code


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, drop_one_in: int | None = None) -> DataFrame:
    """``word, n`` of the lower-cased runs of letters of all texts.

    With ``drop_one_in``, runs lose a letter where that number divides the CRC-32 of
    ``id:run``; which one, the checksum says.  This plants spelling errors that any
    engine can plant again.
    """
    # shorter runs can't become words
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(LETTERS + f"{{{least_length},}}"), F.lit(0))).alias("run"))
    # lower() would change other capitals as well
    low = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", CAPITALS, CAPITALS.lower())).otherwise(F.lower("run"))
    rows = runs.select("id", low.alias("word"))
    if drop_one_in:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        rows = once(rows, F.col("word"), h=h)
        at = F.pmod("h", F.length("word")).cast("int")
        rows = rows.select(F.when(F.col("h") % drop_one_in == 0, F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))).otherwise(F.col("word")).alias("word"))
    return rows.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def reachable(words: DataFrame) -> DataFrame:
    """``number, left, letter, whole, word, n``: a word's key, and its key without each of its letters.

    ``left`` is how many letters remain, ``letter`` the one taken off (null for none),
    ``whole`` the key of the whole word.
    """
    lettered = once(words, F.col("word"), F.col("n"), letters=F.filter(F.split("word", ""), lambda c: c != ""))
    keyed = once(lettered, F.col("word"), F.col("n"), F.col("letters"), whole=F.aggregate("letters", F.lit(0).cast("bigint"), lambda total, c: total + letter_value(c)))
    none = F.lit(None).cast("string")
    offers = F.concat(F.array(none), F.array_distinct("letters"))
    each = keyed.select("word", "n", "whole", F.size("letters").alias("length"), F.explode(offers).alias("letter"))
    taken = F.col("letter").isNotNull()
    return each.select(F.when(taken, F.col("whole") - letter_value(F.col("letter"))).otherwise(F.col("whole")).alias("number"), (F.col("length") - taken.cast("int")).alias("left"), "letter", "whole", "word", "n")


def near_pairs(words: DataFrame, full: int = FULL) -> DataFrame:
    """``a, n_a, b, n_b`` (``a`` before ``b``) of words that differ by one inserted, deleted or replaced letter; each pair once."""
    offers = reachable(words)
    crowded = store(offers.groupBy("number").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") > full).select("number"), "crowded")

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        a, b = (rows.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in on]) for side in "ab")
        # a removal on one side or on both, and words of other letters
        return a.join(b, on).where("word_a < word_b AND whole_a <> whole_b AND (letter_a IS NOT NULL OR letter_b IS NOT NULL)")

    few = offers.join(crowded, "number", "left_anti")
    pairs = met(few, ["number", "left"]).where(F.levenshtein("word_a", "word_b", 1) == 1)
    many = offers.join(crowded, "number", "left_semi")
    # every place where the letter stands, and what remains in order
    places = F.when(F.col("letter").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(1), F.length("word")), lambda p: F.substr("word", p, F.lit(1)) == F.col("letter")))
    many = many.withColumn("place", F.explode(places))
    rest = F.when(F.col("place") == 0, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), F.col("place") - 1), F.substr("word", F.col("place") + 1)))
    ordered = met(many.withColumn("rest", rest), ["number", "left", "rest"]).where("place_a = place_b OR place_a = 0 OR place_b = 0")
    names = [F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b"]
    return pairs.select(*names).unionByName(ordered.select(*names).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: where following the forms ends.

    Each round doubles the steps that are taken at once.
    """
    at = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, at = at, store(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(before)
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, times: int = 10, full: int = FULL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``word, n`` (each word once).

    A word's form is its most frequent near word (of equals the first in the order
    of code points), if that has ``times`` as many occurrences or more; its root is
    where following the forms ends, the word itself if it has none.

    Defined cases: a null word isn't one; words without near words keep their row;
    an empty table gives an empty result.
    """
    words = store(words.select("word", "n").where("word IS NOT NULL"), "words")
    pairs = store(near_pairs(words, full), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    likely = -F.col("best.m") >= F.col("n") * times
    told = store(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.m")).alias("form_n")), "word-forms")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
