import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curaloom.llm import packing
from curaloom.llm.queries import tokenizer_files

from .helpers import awkward, empty


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_patterns_hold_every_piece_once(histogram):
    groups = packing.patterns(histogram, 64)
    used = defaultdict(int)
    for count, lengths in groups:
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            used[n] += count
    assert used == histogram and len(groups) <= 2 * 64
    ranks = defaultdict(list)
    for length, lo, hi, _, _ in packing.slots(groups):
        ranks[length].append((lo, hi))
    for length, spans in ranks.items():
        assert sorted(spans)[0][0] == 0 and sorted(spans)[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))


def check(docs, rows, size, tok):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for own in by_seq.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= size
    for k, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = sorted(by_doc[k], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    return len(by_seq), sum(r["length"] for r in rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = tokenizer_files()
    sequences, tokens = check([tuple(r) for r in docs.collect()], packing.pack(docs.repartition(3), **files).collect(), 1024, Tokenizer.from_file(files["path"]))
    assert tokens / (sequences * 1024) > 0.95


def test_awkward(spark):
    files = tokenizer_files()
    docs = awkward(spark).dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], packing.pack(docs, size=128, **files).collect(), 128, Tokenizer.from_file(files["path"]))
    whole = packing.pack(awkward(spark), size=128, with_ids=True, **files).collect()
    assert sum(r["start"] == 0 for r in whole) == awkward(spark).count()
    assert all(len(r["ids"]) == r["length"] for r in whole)
    assert packing.pack(empty(spark), **files).count() == 0


@pytest.mark.parametrize("text", ["", "a  b \n\n c\t", "<|endoftext|> inside", "日本語 😀 é  ​", "it's we'll I'M 123,456", " " * 5000 + "x", "a" * 20_000, "\x00\x1c\x85"])
def test_ranks_give_the_ids_of_the_tokenizer(text):
    files = tokenizer_files()
    assert packing.encoder(**files)(text).tolist() == packing.encoder(files["path"])(text).tolist()


def test_ranks_agree_on_every_code_point():
    files = tokenizer_files()
    tok, fast = Tokenizer.from_file(files["path"]), packing.encoder(**files)
    points = [chr(c) for c in range(0, 0x30000, 3) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b {c}1{c} {c}{c}  {c}\n" for c in points]
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert fast(t).tolist() == e.ids


@settings(max_examples=600, deadline=None)
@given(st.one_of(
    st.text(max_size=200),
    st.lists(st.sampled_from(["the", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "don't", "123", "4567", "ÄÖ", "é", "e\u0301", "日本語", "한국", "😀", "👩\u200d👩", "\u00a0", "\u3000", "_", "--", "...", "<|endoftext|>", "<|", "|>", "\x00", "\x1f", "A", "b", "ß", "ﬁ", "\u202e", "١٢", "²", "!"]), max_size=40).map("".join),
    st.text(alphabet=st.characters(min_codepoint=0x80, max_codepoint=0x2FFF, exclude_categories=("Cs",)), max_size=80),
))
def test_ids_of_mixed_texts_are_those_of_tokenizers(text):
    files = tokenizer_files()
    fast, slow = packing.encoder(**files), packing.encoder(files["path"])
    assert fast(text).tolist() == slow(text).tolist()
