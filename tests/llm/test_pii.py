import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from curaloom.llm import pii

from .helpers import awkward, empty

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            odd = sum(int(d) for d in digits[-1::-2]) + sum(int(c) for d in digits[-2::-2] for c in str(2 * int(d)))
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(digits) <= 19 and odd % 10 == 0)) or (k == 3 and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@%+-_ 0123459()é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.find(docs).collect():
        want = plain(texts[r["id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)]
        assert {pii.written([s]) for s in want} <= set(r["spans"].split(",")) | {""}


def test_field_adds_other_spellings_and_leaves_plain_text():
    w = pii.trained()
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.all_spans(t, w)[1]]
    assert found("call me at (555) 234-5678 today") == [("phone", "(555) 234-5678")]
    assert ("email", "kalo (at) minter (dot) org") in found("mail kalo (at) minter (dot) org please")
    assert found("on 2024-05-17 version 3.14.1 cost 1,299.00 in 2024, see page 12345") == []
    assert found("We met at noon. At last it rained. 1234567890123456") == []


def test_field_on_unseen_sentences():
    w, right, all_ = pii.trained(), 0, 0
    for text, marks in pii.sentences(200, seed=77):
        right += {(a, k, b) for a, b, k in marks} == set(pii.field_spans(text, w))
        all_ += 1
    assert right / all_ > 0.9


#: Spellings that the generator of the training sentences doesn't write.
OTHERS = {
    "email": ["jane.doe {at} example {dot} com", "bob AT example DOT org", "kim(at)mail(dot)example(dot)co(dot)uk", "x.y-z+tag [AT] host [DOT] net", "anna @ example.com", "lee <at> corp <dot> io", "joe_at_site_dot_org", "max at uni dot edu dot au", "tom [@] web [.] de", "sue (at) sub.domain.example.org", "a.very.long.local.part.with.many.labels.and.more.than.forty.characters (at) mail.example.com"],
    "phone": ["0049 30 1234567", "(030) 1234 5678", "555 234 5678", "1 800 555 0199", "1.800.555.0199", "020 7946 0958", "(02) 9374 4000", "01 42 68 53 00", "555/234-5678", "(0171) 234 56 78"],
    "card": ["3782.822463.10005", "3782/822463/10005", "4222222222222", "5500 0000.0000 0004", "4012.8888.8888.1881", "6011/0009.9013/9424"],
    "ip": ["192.168.1[.]1", "192[.]168.1.1", "172(.)16(.)0(.)9", "8[.]8[.]8[.]8", "10.20[.]30[.]40"],
}
FRAMES = ("", ""), ("please use ", " for this"), ("you can write to ", " now."), ("(see ", ")"), ("it was ", ", they said"), ("kontakt: ", "")
CLEAN = ["in 2024-05-17 at 12:30 the total was 1,299.00", "version 3.14.1 of page 12345", "order 100200300 line 12", "at noon dot", "He was at home. At last", "look at foo.bar now", "year 1999 2001 2003", "isbn 978-3-16-148410-0", "1234567890123456", "12 34 56", "id 2024.05.17.12345", "1 2 3 4 5 6 7 8 9 10", "from 1914-1918 to 1939-1945", "room 101, floor 12, building 7", "0.123456789", "300.300.300.300", "10000000", "3/4/2024 12:00"]


def test_recall_on_other_spellings():
    """At least nine of ten are found exactly (0.906 when measured), and none of the clean texts is marked."""
    w, found, all_ = pii.trained(), 0, 0
    for kind, values in OTHERS.items():
        for value in values:
            for before, after in FRAMES:
                want = (len(before), pii.KINDS.index(kind), len(before) + len(value))
                found += want in pii.all_spans(before + value + after, w)[1]
                all_ += 1
    assert found >= 0.9 * all_
    assert [c for c in CLEAN if pii.all_spans(c, w)[1]] == []


#: Held apart: written once, after the generator and the features were fixed, and never used to change them.  Each stands behind a word that says what it is.
APART = {
    "email": ["jane dot doe at example dot com", "sam AT host.org", "r.lee (at) corp.io", "nina[at]shop[dot]fr", "otto (at) uni-bonn (dot) de", "p dot q dot r (at) lab (dot) eu", "info at firm dot com", "sales [AT] firm [DOT] com", "zoe_at_mail_dot_com", "w.x@y", "kim {at} mail {dot} net",
              "mary_dot_ann_at_home_dot_org", "t-rex (at) park.example.org", "ada@ lovelace.org", "leo @host.io", "u.v+w (at) mail.site.com", "big.boss AT corp.example.com", "bea(at)web.de", "ian <at> host <dot> io", "eva [@] mail.ru", "dev dot ops at cloud dot example dot net", "q1(at)z9(dot)co", "No.Reply [at] shop.example [dot] com"],
    "phone": ["030/1234567", "12 34 56 78 90", "06 12 34 56 78", "089/4567890", "(040) 123 456", "0171 2345678", "555.867.5309", "1-888-555-0123", "(555)234-5678", "212 555 0143", "0041 44 668 18 00", "02.98.76.54.32", "0800-123456", "(0)20 7946 0018", "416/555-0199", "800 555 0100", "0151/12345678", "91 234 56 78", "020-7946-0958", "(0221) 12 34 56", "1 (800) 555-0111", "0049-89-123456", "01 23 45 67 89", "555-0123 4567"],
    "card": ["4111.1111.1111.1111", "5105/1051/0510/5100", "4000 0000.0000 0002", "3714.496353.98431", "6011.1111/1111.1117", "3530/1113/3330/0000", "5555.5555 5555.4444", "3782/822463/10005"],
    "ip": ["192-168-0-1", "172-16-254-3", "10[.]0.0.1", "127[.]0[.]0[.]1", "8(.)8(.)4(.)4", "203.0[.]113.9", "198[.]51.100[.]7", "192[.]0[.]2[.]33"],
}
LEAD = {"email": ("mail ", "contact "), "phone": ("phone ", "call "), "card": ("card ", "visa "), "ip": ("ip ", "server ")}


def test_recall_on_spellings_held_apart():
    """At least 0.95 of 126 are found exactly (0.952 when measured)."""
    w, found, all_ = pii.trained(), 0, 0
    for kind, values in APART.items():
        for value in values:
            for lead in LEAD[kind]:
                text = f"please {lead}{value} today"
                at = text.index(value)
                found += (at, pii.KINDS.index(kind), at + len(value)) in pii.all_spans(text, w)[1]
                all_ += 1
    assert all_ == 126 and found >= 0.95 * all_, (found, all_)


def test_capitals_and_points_in_plain_text_are_left():
    w = pii.trained()
    for text in ("LOOK AT FOO.BAR NOW", "MEET ME AT NOON. THANKS", "we met dot at last", "a dot b", "12-10-20-30", "born 12-05-1990", "score 3-2-1-0", "see 12/05/1990 and 1/2/3", "AT THE END. AT LAST"):
        assert pii.all_spans(text, w)[1] == [], text


def test_long_texts_take_seconds():
    w = pii.trained()
    began = time.process_time()
    base, both = pii.all_spans("write to x@y.zz, " * 100_000, w)
    assert len(base) == len(both) == 100_000
    base, both = pii.all_spans("ask john.doe (at) example.org, " * 20_000, w)
    assert not base and len(both) == 20_000
    for text in ("1 2 3 " * 50_000, "a_at_" * 50_000, "a" * 200_000 + "@" + "b." * 100_000 + "c", "555 234 5678 " * 10_000):
        pii.all_spans(text, w)
    assert time.process_time() - began < 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", " ", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 234-5678", "x (at) y dot z", "(555) 234-5678", ", ", "é", "7"]), max_size=12))
def test_added_spans_overlap_no_base_span(parts):
    base, both = pii.all_spans("".join(parts), pii.trained())
    added = [s for s in both if s not in base]
    assert not any(a < d and c < b for a, _, b in base for c, _, d in added)
    assert {x for x in pii.field_spans("".join(parts), pii.trained()) if not any(a < x[2] and x[0] < b for a, _, b in base)} == set(added)


def test_best_labelling_is_the_best_of_all():
    """The dynamic program against every labelling of short texts."""
    w = pii.trained()
    for text in ("tel 555-123-4567 ok", "ip 10.0.0.1 x", "4111 1111 1111 1111"):
        for s in pii.stretches(text):
            n = len(s.tokens)

            def every(at, before):
                if at == n:
                    yield 0.0, []
                    return
                for i, k, names in [(at, 0, [])] + [(i, k, names) for j in range(at + 1, n + 1) for i, k, names in s.by_end[j] if i == at]:
                    end = at + 1 if k == 0 else next(j for j in range(at + 1, n + 1) if (i, k, names) in s.by_end[j])
                    for rest, tail in every(end, k):
                        yield pii.total(w, names) + w.get(pii.follow(before, k), 0.0) + rest, ([(at, k, end)] if k else []) + tail

            if any(s.by_end) and n <= 12:
                assert pii.best(s, w) == max(every(0, 0), key=lambda x: x[0])[1]


def test_awkward(spark):
    got = pii.find(awkward(spark)).collect()
    assert len(got) == awkward(spark).count() and all(r["spans"] == "" for r in got)
    assert pii.find(empty(spark)).count() == 0
    assert pii.base_spans("9" * 200_000 + "." + "a" * 200_000 + "@" * 1000) == []
    docs = spark.createDataFrame([(1, "write to a.b@c.org or +1 (555) 234-5678", "x"), (2, None, "y")], "doc_id bigint, text string, id string")
    assert [r["text"] for r in pii.mask(docs).orderBy("doc_id").collect()] == ["write to <email> or <phone>", None]
