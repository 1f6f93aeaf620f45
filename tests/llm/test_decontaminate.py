from curaloom.llm import decontaminate, shared
from curaloom.llm.decontaminate import leaks

from .helpers import awkward, empty, words

QUESTION = "A train leaves the old station at 40 km per hour and Maria waits for 3 hours before she boards the next train to the coast"


def found(spark, texts, items, **how):
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], "doc_id bigint, text string, item string, key string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return {(r["id"], r["item_id"]): r["share"] for r in leaks(docs, bench, **how).collect()}


def test_reworded_values_are_caught_and_others_left(spark):
    other = QUESTION.replace("40", "65").replace("Maria", "Peter").replace("3 hours", "7 days")
    got = found(spark, [words(50, 1) + " " + QUESTION + " " + words(50, 2), other, QUESTION.upper(), words(200, 3), "the old station at noon"], [QUESTION])
    assert set(got) == {(0, 0), (1, 0), (2, 0)} and got[1, 0] == 1.0


def test_passages_wherever_they_start(spark):
    item = words(120, 8)
    parts = [" ".join(item.split()[i : i + 8]) for i in range(113)]
    texts = [words(30, 100 + i) + " " + part + " " + words(30, 300 + i) for i, part in enumerate(parts)]
    assert set(found(spark, [*texts, words(90, 3), " ".join(item.split()[30:37])], [item])) == {(i, 0) for i in range(113)}
    docs = spark.createDataFrame(list(enumerate([*texts, words(90, 3), " ".join(item.split()[:7])])), "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == {113, 114}


def test_slots_must_agree(spark):
    item = "If Anna gives 12 apples to Ben and later Anna takes 12 plums from the big brown basket near the gate then who has more fruit"
    even = item.replace("12", "30").replace("Anna", "Mary Jane Watson").replace("Ben", "Tom")
    odd = item.replace("12 apples", "30 apples").replace("Anna takes", "Maria takes").replace("brown", "red").replace("near", "by")  # values became two, and no eight words are left
    assert set(found(spark, [even, odd], [item])) == {(0, 0)}


UNSPACED = {
    "天气很好我们一起去公园散步吧": "今天天气很好我们一起去公园散步吧然后回家吃饭",
    "ひらがなとカタカナで書かれた長い質問です": "これはひらがなとカタカナで書かれた長い質問ですと言った",
    "วันนี้อากาศดีมากเราไปเดินเล่นกัน": "เขาบอกว่าวันนี้อากาศดีมากเราไปเดินเล่นกันเถอะ",
    "一列火车以每小时40公里的速度离开车站": "题目:一列火车以每小时40公里的速度离开车站。",
}


def test_scripts_without_spaces(spark):
    """A copy inside a longer run of characters is found; texts of the same script are left."""
    items, texts = list(UNSPACED), list(UNSPACED.values())
    got = found(spark, [*texts, "今天下雨所以我们留在家里看书", "วันจันทร์ฝนตก", "x" + items[0][:5] + "y"], items)
    assert set(got) == {(i, i) for i in range(len(items))}


def test_many_repetitions_take_seconds(spark):
    import time

    began = time.monotonic()
    phrase = "green apples never sleep well on hard "
    assert set(found(spark, [phrase * 2000], [phrase * 40])) == {(0, 0)} and time.monotonic() - began < 60


def test_literal_windows_beside_a_changed_value(spark):
    part = words(50, 8).split()
    item = " ".join(["The", *part[:25], "The", *part[25:40], "took 12", *part[40:], "and 12 more"])
    texts = [item.replace("The", "Bob", 1), item.replace("12", "30", 1)]
    assert set(found(spark, texts, [item])) == {(0, 0), (1, 0)}


def test_placeholders_alone_match_verbatim_only(spark):
    item = "11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 what single value follows after these long rows"
    rows = "31 32 33 34 35 36 37 38 39 40"
    got = found(spark, [item, "31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48", "so: " + rows, rows.replace("3", "5")], [item, rows])
    assert set(got) == {(0, 0), (1, 1), (2, 1)} and got[0, 0] == 1.0


def test_short_items(spark):
    got = found(spark, ["so green apples never sleep well", "green apples"], ["green apples never sleep", "too short here", "", None])
    assert set(got) == {(0, 0)}


ITEMS = ["Who wrote the novel Moby Dick?", "What is 12 times 15?", "What is 12 + 30 - 7 * 5 ?", "Solve 3 x + 12 = 40 for x", "Compute 17 + 28 - 9 * 4.", "Anna has 3 apples and Bob has 5 apples.", "The Old Man And The Sea Was Written By Ernest Hemingway In Cuba", "2 + 2 = ?", "name three rivers", "7 8 9 10 11 12 13 14 15"]


def test_every_item_is_found_in_its_copy(spark):
    texts = [words(30, i) + " " + t + " " + words(30, 50 + i) for i, t in enumerate(ITEMS)]
    shouted = [words(30, i) + " " + t.upper() + " " + words(30, 50 + i) for i, t in enumerate(ITEMS)]
    others = ["who wrote the novel war and peace", "What was 13 times 15?", "name four rivers", "?", "9 8 7 6 5 4 3 2 1"]
    n = len(ITEMS)
    assert set(found(spark, [*texts, *shouted, *others], [*ITEMS, "?"])) == {(i + k * n, i) for i in range(n) for k in (0, 1)}


def test_short_questions_with_other_values(spark):
    texts = ["Who wrote the novel Don Quixote?", "what is 13 times 14?", "What is 5 + 6 - 17 * 15 ?", "Solve 8 x + 2 = 90 for x", "Compute 1 + 2 - 3 * 5.", "Zoe has 13 apples and Uma has 25 apples."]
    assert set(found(spark, texts, ITEMS[:6])) == {(i, i) for i in range(6)}


def reworded(seed):
    """An item with numbers, number words, units and names of one to three words, and the same with other values."""
    import random

    rng = random.Random(seed)
    filler = iter(words(60, 1000 + seed).split())
    name = lambda: " ".join(w.capitalize() for w in words(rng.randint(1, 3), rng.randint(0, 10**6)).split())
    number = lambda: rng.choice((str(rng.randint(2, 9999)), f"{rng.randint(1, 99)}.{rng.randint(1, 99)}", "twenty five", "seven", "three hundred", "forty"))
    slots = {f"<{k}{i}>": [(name, number)[k == "n"]() for _ in range(2)] for k in "an" for i in range(2)}
    slots["<u0>"] = rng.sample(["km", "miles", "hours", "kg", "dollars"], 2)
    body = []
    for _ in range(rng.randint(3, 6)):
        body += [next(filler) for _ in range(rng.randint(1, 4))]
        body.append(rng.choice(("<a0>", "<a1>", "<n0>", "<n1>", "<n0> <u0>")))
    body += [next(filler) for _ in range(3)]
    made = []
    for side in range(2):
        text = " ".join(body)
        for slot, values in slots.items():
            text = text.replace(slot, values[side])
        made.append(text)
    return made


def test_recall_on_reworded_items(spark):
    """At least nine of ten are found, and hardly any text is taken for another item's."""
    pairs = [reworded(i) for i in range(150)]
    texts = [words(20, 5000 + i) + " " + new + " " + words(20, 7000 + i) for i, (_, new) in enumerate(pairs)]
    clean = [words(15, 9000 + i) + " " + reworded(500 + i)[0] + " " + words(15, 9500 + i) for i in range(150)]
    got = set(found(spark, texts + clean, [old for old, _ in pairs]))
    right = {(i, i) for i in range(150)}
    assert len(got & right) >= 0.9 * len(right)
    assert len(got & right) >= 0.98 * len(got)


def test_every_way_gives_the_same(spark, monkeypatch, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = lambda: sorted(tuple(r) for r in leaks(docs, bench).collect())
    want = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 10)
    assert rows() == want and want
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)
    assert rows() == want


def test_the_way_of_removal_does_not_matter(spark, monkeypatch):
    docs, bench = awkward(spark), spark.createDataFrame([(1, words(40, 1))], "item_id bigint, text string")
    want = sorted(decontaminate.drop_leaks(docs, bench).collect(), key=str)
    monkeypatch.setattr(shared, "BROADCAST_KEYS", 0)
    assert sorted(decontaminate.drop_leaks(docs, bench).collect(), key=str) == want and len(want) == docs.count() - 5


def test_awkward(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, words(40, 1)), (1, words(40, 1)), (None, "x y z w v"), (2, None)], "item_id bigint, text string")
    got = {(r["id"], r["item_id"]) for r in leaks(docs, bench).collect()}
    assert got == {(5, 1), (6, 1), (7, 1)}
    assert leaks(empty(spark), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
