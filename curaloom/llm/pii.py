"""Personal data by rules and by a semi-Markov conditional random field.

Base rules give spans that always stay.  The field adds spans in other spellings
(a phone number without its plus sign, an address that spells out its ``@``).  It
scores whole candidate segments of a bounded number of tokens, by features of the
segment's text and of the words around it, and a dynamic program chooses
boundaries and types together.  Its weights are fitted here, by gradient ascent
on the likelihood of sentences that a generator writes from a fixed seed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[Span]:
    """The spans of the base rules, in order.

    Work grows with the length of the text only: an address is looked for around
    its ``@``, and a run of digits is tried from its start alone.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (host := HOST.match(text, at + 1)):
            free = host.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(byte_sized, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# ---- the field

#: Most runs of digits in a number, and most digits.
GROUPS, DIGITS = 6, 19
#: Most tokens and characters of an entity, by kind (an address has 320 characters at most).
TOKENS = {"email": 128, "ip": 16, "card": 24, "phone": 24}
CHARS = {"email": 320, "ip": 64, "card": 64, "phone": 64}
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
#: Where numbers can be: digits with their separators.
NUMBERS = re.compile(r"[(+\[]?[0-9](?:[0-9]|[ ().\[\]/-]{1,3}(?=[0-9]))*")
#: Spellings of ``@`` and of the points of a host.  A bare word for ``@`` needs spelled points too.
OPEN, SHUT = r" ?[(\[{<] ?", r" ?[)\]}>] ?"
AT = re.compile(rf"{OPEN}(?:at|@){SHUT}| ?@ ?|(?P<bare> at |_at_)", re.I)
SPELLED = rf"{OPEN}(?:dot|\.){SHUT}| dot |_dot_"
DOT = re.compile(rf"{SPELLED}|\.", re.I)
SHOUTED = " AT "  # in capitals it stands out by itself, so a host may have plain points
LOCALS = re.compile(rf"[A-Za-z0-9._%+-]++(?:(?:{SPELLED})[A-Za-z0-9._%+-]++)*+", re.I)
#: What a spelled point ends with, read backwards from the name behind it.
POINT_BEFORE = re.compile(rf"(?:{SPELLED})\Z", re.I)
HOSTS = {bare: re.compile(rf"[A-Za-z0-9-]++(?:(?:{SPELLED}{'' if bare else '|[.]'})[A-Za-z0-9-]++)+", re.I) for bare in (False, True)}
MAYBE_AT = re.compile(r"[ _(\[{<]at[ _)\]}>]", re.I)
CUES = {
    "email": {"mail", "email", "contact", "write", "reach"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "cell", "ring", "dial", "contact"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "pay", "payment"},
    "ip": {"ip", "host", "server", "address", "node", "gateway", "ping"},
    "other": {"version", "order", "invoice", "id", "number", "date", "page", "price", "total", "isbn", "year", "ticket", "line"},
}
CUE_OF: dict[str, list[str]] = defaultdict(list)
for _name, _words in CUES.items():
    for _word in _words:
        CUE_OF[_word].append(_name)


def shape(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", text)))


def needs_words(mark: re.Match) -> bool:
    """Whether the points of the host must be spelled, as they must after a mere word."""
    return bool(mark["bare"]) and mark[0] != SHOUTED


def possible(text: str, kind: str) -> bool:
    """Whether a segment can be of a kind at all; everything else is left to the weights."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        marks = list(AT.finditer(text))
        return len(marks) == 1 and bool(LOCALS.fullmatch(text, 0, marks[0].start())) and bool(HOSTS[needs_words(marks[0])].fullmatch(text, marks[0].end()))
    if text[-1] not in "0123456789" or re.search(r"[^\W\d_]", text):
        return False
    if kind == "ip":
        parts = text.split("-") if "-" in text else re.split(r"[\[(]?\.[\])]?", text)
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and byte_sized(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19
    return 7 <= len(digits) <= 15


def features(text: str, kind: str, near: frozenset[str]) -> list[str]:
    """Names of the features of a whole segment as a kind, with the cues around it."""
    digits = re.sub(r"[^0-9]", "", text)
    out = [f"{kind}", f"{kind}|{shape(text)}"]
    out += [f"{kind}|cue {c}" for c in near]
    if kind == "email":
        mark = AT.search(text)
        local, labels = text[: mark.start()], DOT.split(text[mark.end() :])
        out += [f"{kind}|end {2 <= len(labels[-1]) <= 6 and labels[-1].isalpha()}", f"{kind}|plain at {'@' in text}", f"{kind}|bare {bool(mark['bare'])}", f"{kind}|local {bool(re.fullmatch(r'[A-Za-z0-9._%+-]+', local))}", f"{kind}|spelled point {bool(re.search(SPELLED, text[mark.end() :], re.I))}", f"{kind}|local points {len(re.findall(SPELLED, local, re.I))}", f"{kind}|shouted {mark[0] == SHOUTED and (text.isupper() and 'all' or 'at')}"]
    else:
        groups = re.findall(r"[0-9]+", text)
        lengths = [len(g) for g in groups]
        signs = "".join(sorted(set(re.sub(r"[0-9]", "", text))))
        out += [f"{kind}|lengths {lengths}", f"{kind}|signs {signs}", f"{kind}|least {min(lengths[1:], default=0)}", f"{kind}|digits {len(digits)}", f"{kind}|groups {len(groups)}"]
        if kind == "card":
            out += [f"{kind}|luhn {luhn(digits)}", f"{kind}|known start {digits[0] in '3456'}", f"{kind}|even {max(lengths) - min(lengths) < 3}"]
        elif kind == "ip":
            out += [f"{kind}|sized {all(map(byte_sized, groups))}"]
        else:
            out += [f"{kind}|head {'0' if digits[0] == '0' else '1' if groups[0] == '1' else ''} {min(lengths[0], 5)}", f"{kind}|bracket {'(' in text}", f"{kind}|plus {text[0] == '+'}", f"{kind}|last {lengths[-1]}", f"{kind}|grouped {len(groups) > 2 and min(lengths[1:]) > 1 and max(lengths) < 8}"]
    return out


class Stretch:
    """The tokens of one region and its candidate segments, by end."""

    def __init__(self, text: str, start: int, end: int, kinds: tuple[str, ...]):
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
        self.tokens = tokens
        around = re.findall(r"[^\W\d_]+", text[max(0, start - 32) : start])[-3:] + re.findall(r"[^\W\d_]+", text[end : end + 16])[:1]
        near = frozenset(c for w in around for c in CUE_OF.get(w.lower(), ()))
        self.near = near
        self.by_end: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        most_tokens, most_chars = max(TOKENS[k] for k in kinds), max(CHARS[k] for k in kinds)
        mail = kinds == ("email",)
        runs, digits = [0], [0]  # runs of digits and digits before each token
        for a, b in tokens:
            number = text[a] in "0123456789"
            runs.append(runs[-1] + number)
            digits.append(digits[-1] + (b - a) * number)
        for i, (a, _) in enumerate(tokens):
            if text[a] in ").]-/ " or (mail and AT.match(text, a)):
                continue
            # an address ends where its region does; numbers may end anywhere
            for j in (len(tokens) - 1,) if mail else range(i, min(i + most_tokens, len(tokens))):
                b = tokens[j][1]
                if b - a > most_chars or (not mail and (runs[j + 1] - runs[i] > GROUPS or digits[j + 1] - digits[i] > DIGITS)):
                    break
                if not mail and digits[j + 1] - digits[i] < 7 and runs[j + 1] - runs[i] != 4:
                    continue
                piece = text[a:b]
                for kind in kinds:
                    if j - i < TOKENS[kind] and possible(piece, kind):
                        # a segment that cuts a run of letters or digits is told apart by its neighbours
                        cut = (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "+.-/(" and kind != "email")) or (b < len(text) and (text[b].isalnum() or text[b] in "-/" or (text[b] == "." and b + 1 < len(text) and text[b + 1].isalnum())))
                        self.by_end[j + 1].append((i, KINDS.index(kind) + 1, features(piece, kind, near) + [f"{kind}|cut {cut}"]))


def total(weights: dict[str, float], names: list[str]) -> float:
    return sum(weights.get(n, 0.0) for n in names)


def follow(before: int, kind: int) -> str:
    """The feature of two neighbouring labels (0: none)."""
    return f"{before and 1}>{kind and 1}"


def best(stretch: Stretch, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """The segments ``(first token, label, token after the last)`` of the best labelling."""
    n, labels = len(stretch.tokens), range(len(KINDS) + 1)
    top = [[-math.inf] * len(labels) for _ in range(n + 1)]
    came: list[list[tuple[int, int] | None]] = [[None] * len(labels) for _ in range(n + 1)]
    top[0][0] = 0.0
    for j in range(1, n + 1):
        for i, k, names in [(j - 1, 0, []), *stretch.by_end[j]]:
            own = total(weights, names)
            for p in labels:
                if top[i][p] > -math.inf and (s := top[i][p] + own + weights.get(follow(p, k), 0.0)) > top[j][k]:
                    top[j][k], came[j][k] = s, (i, p)
    j, k, out = n, max(labels, key=lambda x: top[n][x]), []
    while j:
        i, p = came[j][k]
        if k:
            out.append((i, k, j))
        j, k = i, p
    return out[::-1]


def log_sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def ascend(stretch: Stretch, truth: set[tuple[int, int, int]], weights: dict[str, float], rate: float) -> None:
    """One step up the likelihood: true features in, expected ones out (forward and backward sums)."""
    n, labels = len(stretch.tokens), range(len(KINDS) + 1)
    pieces = [(i, j, k, names, total(weights, names)) for j in range(1, n + 1) for i, k, names in [(j - 1, 0, []), *stretch.by_end[j]]]
    fore = [[-math.inf] * len(labels) for _ in range(n + 1)]
    back = [[-math.inf] * len(labels) for _ in range(n + 1)]
    fore[0][0], back[n] = 0.0, [0.0] * len(labels)
    step = lambda p, k: weights.get(follow(p, k), 0.0)
    for i, j, k, _, own in pieces:
        fore[j][k] = log_sum([fore[j][k], *(fore[i][p] + step(p, k) + own for p in labels)])
    for i, j, k, _, own in sorted(pieces, key=lambda x: -x[1]):
        for p in labels:
            back[i][p] = log_sum([back[i][p], step(p, k) + own + back[j][k]])
    whole = log_sum(fore[n])
    move: dict[str, float] = defaultdict(float)
    for i, j, k, names, own in pieces:
        for p in labels:
            share = math.exp(min(0.0, fore[i][p] + step(p, k) + own + back[j][k] - whole)) if fore[i][p] > -math.inf else 0.0
            if share > 1e-9:
                move[follow(p, k)] -= share
                for name in names:
                    move[name] -= share
    covered, kind_at = {x for i, _, j in truth for x in range(i, j)}, {i: (k, j) for i, k, j in truth}
    known = {(i, k, j): names for i, j, k, names, _ in pieces}
    i, p = 0, 0
    while i < n:
        k, j = kind_at.get(i, (0, i + 1)) if i in covered else (0, i + 1)
        move[follow(p, k)] += 1
        for name in known.get((i, k, j), []):
            move[name] += 1
        i, p = j, k
    for name, g in move.items():
        weights[name] = weights.get(name, 0.0) * (1 - 1e-3) + rate * g


PAIRS = re.compile(r"[0-9]{2}(?:[ .-][0-9]{2})+")


def sentences(count: int, seed: int = 11):
    """``(text, [(start, end, kind)])`` of made-up sentences, with numbers that are no personal data among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "min", "ter", "sa", "ve", "on", "dri")) for _ in range(rng.randint(1, 3)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice((d, f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}/{d[4:8]}/{d[8:12]}/{d[12:]}", f"{d[:4]}.{d[4:8]} {d[8:12]}.{d[12:]}", f"{d[:4]}/{d[4:10]}/{d[10:]}"))

    def phone() -> str:
        a, b, c = rng.choice("23456789") + digits(2), digits(3), digits(4)
        if rng.random() < 0.5:  # any grouping
            groups = [digits(rng.choice((2, 3, 3, 4, 4))) for _ in range(rng.randint(2, 4))]
            joint = rng.choice((" ", " ", "-", "."))
            area = rng.choice(("0", "00", f"1{joint}", "")) + digits(rng.randint(2, 3))
            area = f"({area.strip()})" if rng.random() < 0.3 else area
            made = area + rng.choice((joint, joint, "/")) + joint.join(groups)
            if 9 <= sum(map(str.isdigit, made)) <= 14:
                return made
        if rng.random() < 0.3:  # pairs of digits, and an area code before a slash
            joint = rng.choice((" ", " ", ".", "-"))
            return rng.choice((joint.join(digits(2) for _ in range(rng.choice((4, 5, 5)))), f"0{digits(rng.randint(2, 4))}/{digits(rng.randint(5, 8))}", f"0{digits(2)}/{digits(3)}{joint}{digits(4)}"))
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}"))

    def email() -> str:
        a, b, c = word(), word(), rng.choice(("com", "org", "net", "de", "example"))
        return rng.choice((f"{a} (at) {b} (dot) {c}", f"{a}[at]{b}[dot]{c}", f"{a} [at] {b} [dot] {c}", f"{a} at {b} dot {c}", f"{a}@{b}.{c}", f"{a}.{word()}(at){b}.{c}", f"{a} (@) {b} (.) {c}", f"{a}-{word()} [at] {word()}.{b}.{c}", f"{a} dot {word()} at {b} dot {c}", f"{a} (dot) {word()} (at) {b} (dot) {c}", f"{a}[dot]{word()}[at]{b}[dot]{c}", f"{a}_dot_{word()}_at_{b}_dot_{c}", f"{a} dot {word()} dot {word()} (at) {b} (dot) {c}", f"{a} AT {b}.{c}", f"{a}.{word()} AT {b}.{c}"))

    def ip() -> str:
        p = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice((".".join(p), "[.]".join(p), f"{p[0]}.{p[1]}[.]{p[2]}[.]{p[3]}", "-".join(p)))

    def other() -> str:
        d = rng.choice("0123456789") + digits(14)
        wrong = d + next(c for c in "0123456789" if not luhn(d + c))
        return rng.choice((f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", wrong, wrong[:13], digits(rng.randint(7, 12)), f"{digits(2)}.{digits(2)}.{rng.randint(1900, 2099)}", f"{digits(3)}.{rng.randint(256, 999)}.{digits(2)}.{digits(3)}", f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(4)} {digits(4)} {digits(2)}", f"{digits(3)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(5)}-{digits(5)}", ".".join(str(rng.randint(200, 999)) for _ in range(4)), f"{digits(2)}/{digits(2)}/{digits(4)} {digits(4)}", f"{rng.randint(1900, 2099)}.{rng.randint(1, 12):02d}.{rng.randint(1, 28):02d}.{digits(5)}", " ".join(str(rng.randint(1, 99)) for _ in range(rng.randint(3, 6))), f"{rng.randint(1900, 2099)}-{rng.randint(1900, 2099)} {rng.randint(1900, 2099)}", f"at {word()} dot", f"{word()} at {word()}. {word()}", f"{digits(3)} {digits(2)} {digits(3)} {digits(1)}", f"{word()}. At {word()}. {word()}", f"{word()} AT {word()}. {word()}".upper(), f"{word()} {word()} AT {word()}.{word()}".upper(), f"{word()} dot {word()} at {word()}", "-".join(str(rng.randint(1, 31)) for _ in range(4)), f"{digits(2)}-{digits(2)}-{digits(2)}", "/".join((digits(2), digits(2), digits(4)))))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(count):
        text, marks = word(), []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice((*KINDS, "other", "other", "other"))
            value = makers[kind]() if kind in makers else other()
            # numbers in pairs and machines with dashes are told by the word before them
            sure = kind in ("phone", "ip") and (PAIRS.fullmatch(value) or (kind == "ip" and "-" in value))
            if sure or rng.random() < 0.4:
                text += " " + rng.choice(sorted(CUES[kind]))
            text += " " + rng.choice(("", "" if sure else word() + " "))
            if kind in makers:
                marks.append((len(text), len(text) + len(value), KINDS.index(kind)))
            text += value + rng.choice((" ", ". ", ", ")) + word()
        yield text, marks


def mail_regions(text: str) -> list[tuple[int, int]]:
    """Places around a spelling of ``@`` with a host behind it and a name before it, left to right."""
    out, free, at = [], 0, 0
    while m := AT.search(text, at):
        at = m.start() + 1
        host = HOSTS[needs_words(m)].match(text, m.end())
        start, least = m.start(), max(free, m.start() - CHARS["email"])
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        if host and start < m.start():
            # names before it that are joined by spelled points
            while point := POINT_BEFORE.search(text, max(least, start - 8), start):
                name = point.start()
                while name > least and text[name - 1] in LOCAL:
                    name -= 1
                if name == point.start():
                    break
                start = name
            free = at = host.end()
            out.append((start, free))
    return out


def stretches(text: str, base: list[Span] = []):  # noqa: B006
    """The regions in which the field looks: those of addresses that are no base span, and numbers outside of addresses."""
    mails = mail_regions(text) if "@" in text or MAYBE_AT.search(text) else []
    known, nth = [(a, b) for a, k, b in base if k == 0], 0
    for start, end in mails:
        while nth < len(known) and known[nth][1] <= start:
            nth += 1
        if nth == len(known) or known[nth][0] >= end:
            yield Stretch(text, start, end, ("email",))
    nth = 0
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        while nth < len(mails) and mails[nth][1] <= m.start():
            nth += 1
        if nth == len(mails) or mails[nth][0] >= m.end():
            yield Stretch(text, m.start(), m.end(), ("ip", "card", "phone"))


@cache
def trained(count: int = 1500, epochs: int = 6, rate: float = 0.2) -> dict[str, float]:
    """Weights by feature, the same in every process."""
    weights: dict[str, float] = {}
    made = []
    for text, marks in sentences(count):
        for s in stretches(text):
            starts, ends = {a: i for i, (a, _) in enumerate(s.tokens)}, {b: i + 1 for i, (_, b) in enumerate(s.tokens)}
            truth = {(starts[a], k + 1, ends[b]) for a, b, k in marks if a in starts and b in ends}
            made.append((s, {t for t in truth if any(i == t[0] and k == t[1] for i, k, _ in s.by_end[t[2]])}))
    made = [(s, t) for s, t in made if any(s.by_end)]
    for e in range(epochs):
        for s, truth in made:
            ascend(s, truth, weights, rate / (1 + e))
    return weights


def field_spans(text: str, weights: dict[str, float], base: list[Span] = []) -> list[Span]:  # noqa: B006
    """What the field finds by itself, beside the addresses among ``base``."""
    return [(s.tokens[i][0], k - 1, s.tokens[j - 1][1]) for s in stretches(text, base) if any(s.by_end) for i, k, j in best(s, weights)]


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and those together with the field's that overlap none of them."""
    base = base_spans(text)
    extra, nth, reach = [], 0, -1  # ``reach``: the end of the base spans that start before the one in hand ends
    for span in sorted(field_spans(text, weights, base)):
        while nth < len(base) and base[nth][0] < span[2]:
            reach = max(reach, base[nth][2])
            nth += 1
        if reach <= span[0]:
            extra.append(span)
    return base, sorted(base + extra)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns per input row ``id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``
    (base spans), ``base_sha256``, ``spans`` (all, as ``kind:start:end``),
    ``n_spans`` (their number) and ``found`` (the same as an array of kind, start,
    end, base).

    Defined cases: a null text is empty and has no spans; a null id and repeated
    rows keep their rows; an empty table gives an empty result; other columns
    aren't read.  Entities of the field are bounded: addresses by 320 characters,
    addresses of machines by 16 tokens, other numbers by 24, both by 64 characters.
    Base spans have any length.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    weights = trained()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            made = [all_spans(x or "", weights) for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == n for _, k, _ in base) for base, _ in made], pa.int64()) for n in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in made], pa.string())
            known = [set(base) for base, _ in made]
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in own} for a, k, b in both] for own, (_, both) in zip(known, made, strict=True)]
            numbers = pa.array([len(both) for _, both in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(both) for _, both in made], pa.string()), numbers, pa.array(found, pa.list_(item))], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans", "found"])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_spans bigint, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets.

    Defined cases: a null text stays null; of spans that overlap, the first gives
    the kind and all are covered; null ids and repeated rows are like any other;
    an empty table gives an empty result; other columns stay as they are, whatever
    their names.
    """
    small_batches(docs.sparkSession)
    weights, at = trained(), docs.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for a, k, b in all_spans(text, weights)[1]:
            if a >= end:
                out += [text[end:a], f"<{KINDS[k]}>"]
                end = b
            else:
                end = max(end, b)
        return "".join(out) + text[end:]

    def run(batches):
        for batch in batches:
            yield batch.set_column(at, text_col, pa.array([masked(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
