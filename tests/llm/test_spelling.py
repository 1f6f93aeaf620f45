import re
import zlib
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from curaloom.llm import spelling

from .helpers import awkward, empty


def plain_words(rows, one_in=None, length=7, least=2):
    counts = Counter()
    for k, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{low}".encode())
            if one_in and h % one_in == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def one_apart(a, b):
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and len(b) - len(a) < 2 and a[same + (len(a) == len(b)) :] == b[same + 1 :]


def plain(counts, times=10):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(near[w], key=lambda o: (-counts[o], o), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= times * counts[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_awkward(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for one_in in (None, 3, 31):
        got = spelling.counted_words(docs, drop_one_in=one_in)
        assert {r["word"]: r["n"] for r in got.collect()} == plain_words(rows, one_in)
    assert rows_of(spelling.variants(spelling.counted_words(docs, drop_one_in=31))) == plain(plain_words(rows, 31))
    assert spelling.variants(spelling.counted_words(empty(spark))).count() == 0


def test_capitals_other_than_a_to_z_stay(spark):
    docs = spark.createDataFrame([(1, "ÄRGERLICH ärgerlich÷× ÄRGERlich"), (2, "ärgerlich÷× Xstraßenbahn XstraßenbahN")], "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in spelling.counted_words(docs).collect()} == {"Ärgerlich": 2, "ärgerlich÷×": 2, "xstraßenbahn": 2}


def test_crowded_numbers_give_the_same(spark):
    """Words of few letters meet at few numbers; with any bound the pairs are those of comparing all."""
    words = sorted({"".join(p) for p in ("aaaaaab abaaaba abbaaba ababababa babaaba aabbaab bbbbbbb aaaaaaa abcabca abcabcb acbacba bacabca abcabc abcabcab".split())} | {"a" * 6 + x for x in "abcdefgh"})
    counts = {w: 2 * 10 ** (i % 4) for i, w in enumerate(words)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    for full in (1, 4, 1000):
        assert rows_of(spelling.variants(rows, full=full)) == plain(counts)


@settings(max_examples=7, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcé", max_size=9), st.integers(1, 5000), max_size=25), st.sampled_from([1, 16]))
def test_any_words(spark, counts, full):
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(rows, full=full)) == plain(counts)


def test_long_chains_of_forms(spark):
    counts = {"a" * 7 + "b" * i: 10**i for i in range(12)}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    assert rows_of(found) == plain(counts) and {r["root"] for r in found.collect()} == {max(counts, key=counts.get)}


def test_no_two_changes_of_letters_have_one_value():
    """So a pair of words meets at one number alone."""
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    assert len({a**spelling.POWER - b**spelling.POWER for a in letters for b in letters if a != b}) == len(letters) * (len(letters) - 1)


def test_very_long_words(spark):
    long = "ab" * 20_000
    docs = spark.createDataFrame([(1, f"{long} {long}x"), (2, f"{long} {long}x")], "doc_id bigint, text string")
    assert rows_of(spelling.variants(spelling.counted_words(docs))) == [(long, None, long, 2, 1, None), (long + "x", None, long + "x", 2, 1, None)]
