"""PII (11): a semi-Markov conditional random field over candidate spans, beside spans that fixed patterns find.

A text's candidates are whole spans of at most MOST_CHARS characters with a type. A span's score is a sum of weights of
features of the whole span (digits, check digits, groups, separators, what stands beside it); what lies in no span scores 0.
A segmentation's probability is proportional to the exponential of its spans' scores, so the best one, and the sums that
training needs, are dynamic programs over the spans' boundaries, which choose boundaries and types jointly. The weights are
fitted here, on windows made by a seeded generator, and are the same for every corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspring.llm.common import as_bytes, slices, trimmed

KINDS = ("email", "ip", "card", "phone")
#: Bounds of an entity: characters, and groups of digits.
MOST_CHARS, MOST_GROUPS = 64, 8
#: Windows that the weights are fitted on, and passes over them.
TRAIN_WINDOWS, TRAIN_ROUNDS = 700, 12

# The patterns of the contract. Emails are found from their "@", and numbers inside runs of the characters that
# they can have, so no text takes more than linear time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REGION = re.compile(r"[0-9+(][0-9\x20().+-]{6,}")

_GROUP = re.compile(r"[0-9]+")
_WIDE_LOCAL = re.compile(r"[\w.%+-]*\Z")
_WIDE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_SIGN = re.compile(r"@|\s?[\[(]at[\])]\s?", re.IGNORECASE)
_WORD = re.compile(r"([^\W\d_]+)[^\w]*\Z")

#: Words before a span that speak for a type, or against all.
CUES = {
    "phone": "phone tel telephone call mobile cell fax telefon telefono téléphone".split(),
    "card": "card visa mastercard amex credit debit karte tarjeta carte".split(),
    "ip": "ip host server address client from".split(),
    "email": "mail email write contact correo courriel".split(),
    "none": "version v release build isbn order invoice id ref part serial page no nr token license".split(),
}
_CUE_OF = {word: kind for kind, words in CUES.items() for word in words}


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find: leftmost, not overlapping within a type; matches that fail their check are dropped."""
    out, last, before, at = [], 0, 0, text.find("@")
    while at >= 0:
        held = text[max(last, before) : at]
        local = len(held) - len(held.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            out.append(Span(at - local, found.end(), "email"))
            last = found.end()
        before, at = at + 1, text.find("@", at + 1)
    for region in REGION.finditer(text):
        a, b = region.span()
        out += [Span(*m.span(), "ip") for m in IP.finditer(text, a, b) if all(map(at_most_255, m[0].split(".")))]
        for m in CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 38 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(*m.span(), "card"))
        out += [Span(*m.span(), "phone") for m in PHONE.finditer(text, a, b) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be entities: from one group of digits to another, and around signs of an address."""
    for region in REGION.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *region.span())]
        for i, (start, _) in enumerate(groups):
            mark = text[start - 1] if start > region.start() else ""
            n, dots, close = 0, 0, True  # digits; separators that are single dots; that are a space or a hyphen
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                a, b = groups[j]
                if j > i:
                    between = text[groups[j - 1][1] : a]
                    if len(between) > 3 or "+" in between:
                        break
                    dots += between == "."
                    close = close and between in (" ", "-")
                n += b - a
                if n > 19 or b - start > MOST_CHARS:
                    break
                if 16 <= n and close:
                    yield Span(start, b, "card")
                if j == i + 3 and dots == 3:
                    yield Span(start, b, "ip")
                if 8 <= n <= 15:
                    yield Span(start, b, "phone")
                    if mark in ("+", "("):
                        yield Span(start - 1, b, "phone")
    for sign in _SIGN.finditer(text):
        low = max(0, sign.start() - MOST_CHARS)
        local = _WIDE_LOCAL.search(text, low, sign.start())
        found = _WIDE_DOMAIN.match(text, sign.end(), sign.end() + MOST_CHARS)
        if local and local.end() > local.start() and found:
            labels = [m.end() for m in re.finditer(r"[\w-]+", found[0])]
            for end in labels[1:]:
                if sign.end() + end - local.start() <= MOST_CHARS:
                    yield Span(local.start(), sign.end() + end, "email")


def beside(text: str, i: int, step: int) -> str:
    """What stands there: an edge, a letter, a digit, a sign that joins it to a digit or letter, a space before a digit, or other."""
    if not 0 <= i < len(text):
        return "edge"
    c = text[i]
    beyond = text[i + step] if 0 <= i + step < len(text) else ""
    if c.isalpha() or c == "_":
        return "letter"
    if c.isdigit():
        return "digit"
    if c.isspace():
        return "space-digit" if beyond.isdigit() else "edge"
    if c in ".-@/=:+(" and (beyond.isdigit() or (beyond.isalpha() and c != ":")):
        return "joined"
    return "plus" if c == "+" else "other"


def features(text: str, span: Span) -> list[str]:
    """Names of the features of the whole span."""
    a, b, kind = span
    body = text[a:b]
    out = ["any", f"left {beside(text, a - 1, -1)}", f"right {beside(text, b, 1)}"]
    word = _WORD.search(text, max(0, a - 24), a)
    if word and (cue := _CUE_OF.get(word[1].lower())):
        out.append("cue own" if cue == kind else "cue none" if cue == "none" else "cue other")
    if kind == "email":
        name, _, top = re.split(_SIGN, body, maxsplit=1)[1].rpartition(".")
        out += ["written at" if "@" not in body else "sign at", "top letters" if top.isalpha() and 2 <= len(top) <= 12 and top == top.lower() else "top other", "name letter" if any(c.isalpha() for c in name) else "name digits"]
        out.append("starts well" if body[0].isalnum() else "starts with a mark")
    else:
        groups = _GROUP.findall(body)
        digits, marks = "".join(groups), set(re.sub("[0-9]", "", body))
        n = len(digits)
        if kind == "card":
            out += ["luhn" if luhn(digits) else "no luhn", "16" if n == 16 else "17 to 19", f"begins {digits[0]}" if digits[0] in "3456" else "begins other"]
            out.append("one group" if len(groups) == 1 else "fours" if all(len(g) == 4 for g in groups) and len(marks) == 1 else "odd groups")
        elif kind == "ip":
            out += ["parts" if all(map(at_most_255, groups)) else "parts above", "zeros" if any(len(g) > 1 and g[0] == "0" for g in groups) else "no zeros"]
            out.append("short" if n <= 5 else "long")
        else:
            out += ["8 or 9" if n < 10 else "10" if n == 10 else "11" if n == 11 else "12 or 13" if n < 14 else "14 or 15"]
            plus = body[0] == "+"
            shape = [len(g) for g in groups]
            out.append(("plus " if plus else "bare ") + ("one group" if len(groups) == 1 else "two" if len(groups) == 2 else "more"))
            if body.count("(") != body.count(")"):
                out.append("open bracket")
            elif "(" in body:
                out.append("brackets")
            if shape[-3:] == [3, 3, 4]:
                out.append("3 3 4" + ("" if marks - {" "} else " spaces"))
            if "." in marks:
                out.append("dots")
            if shape == [4, 2, 2] or shape == [2, 2, 4]:
                out.append("date")
            out.append("last long" if 3 <= shape[-1] <= 8 else "last short" if shape[-1] < 3 else "last very long")
            if max(shape) >= 9 and len(groups) > 1:
                out.append("mixed with a long number")
    return [f"{kind} {x}" for x in out]


def log_sums(spans: list[Span], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """The logarithm of the sum over all segmentations, and each span's probability."""
    edges = sorted({s.start for s in spans} | {s.end for s in spans})
    at = {x: i for i, x in enumerate(edges)}
    ending, starting = [[] for _ in edges], [[] for _ in edges]
    for k, s in enumerate(spans):
        ending[at[s.end]].append(k)
        starting[at[s.start]].append(k)
    n = len(edges)
    forward, backward = np.zeros(n), np.zeros(n)
    for i in range(n):
        forward[i] = np.logaddexp.reduce([forward[i - 1] if i else 0.0, *(forward[at[spans[k].start]] + scores[k] for k in ending[i])])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1] if i < n - 1 else 0.0, *(backward[at[spans[k].end]] + scores[k] for k in starting[i])])
    total = forward[-1] if n else 0.0
    return total, np.exp([forward[at[s.start]] + x + backward[at[s.end]] - total for s, x in zip(spans, scores, strict=True)])


def best_spans(spans: list[Span], scores: list[float]) -> list[Span]:
    """The segmentation of the greatest score. Spans that score 0 or less never help; of equal ones the earlier ending wins."""
    some = sorted((s.end, s.start, -x, s) for s, x in zip(spans, scores, strict=True) if x > 0)
    ends = [x[0] for x in some]
    best, taken = [0.0], [None]
    for i, (_, start, minus, span) in enumerate(some):
        before = bisect_right(ends, start, 0, i)
        with_it = best[before] - minus
        if with_it > best[i] + 1e-12:
            best.append(with_it)
            taken.append((before, span))
        else:
            best.append(best[i])
            taken.append(None)
    out, i = [], len(some)
    while i:
        if taken[i] is None:
            i -= 1
        else:
            i, span = taken[i]
            out.append(span)
    return out[::-1]


class Maker:
    """Windows of text with their entities, from a seed."""

    FILLER = "the of and then with a report on which was sent under les des une und der para ciudad".split()

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(str(self.rnd.randrange(10)) for _ in range(n))

    def card(self, good: bool = True) -> str:
        body = self.rnd.choice("3456") + self.digits(self.rnd.choice([14, 14, 14, 14, 17]))
        last = next(d for d in "0123456789" if luhn(body + d))
        number = body + (last if good else str((int(last) + self.rnd.randrange(1, 10)) % 10))
        return self.rnd.choice([number, number, " ".join(number[i : i + 4] for i in range(0, len(number), 4)), "-".join(number[i : i + 4] for i in range(0, len(number), 4))])

    def phone(self) -> str:
        d, cc = self.digits, self.rnd.choice(["1", "44", "49", "33", "34"])
        return self.rnd.choice([f"+{cc} ({d(3)}) {d(3)}-{d(4)}", f"+{cc} ({d(3)}) {d(3)}-{d(4)}", f"+{cc}-{d(3)}-{d(3)}-{d(4)}", f"+{cc} {d(2)} {d(7)}", f"+{cc}{d(9)}", f"+{cc} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])

    def ip(self) -> str:
        return ".".join(str(self.rnd.randrange(256)) for _ in range(4))

    def email(self) -> str:
        name = self.rnd.choice(["ann", "josé", "m.weiß", "info", "bob_k", "zoë.b"]) + self.rnd.choice(["", ".", "-", ""]) + self.digits(self.rnd.randrange(3))
        host = self.rnd.choice(["example", "bücher", "mail5.example", "firma-x"]) + "." + self.rnd.choice(["com", "org", "de", "net", "fr"])
        return name.rstrip(".-") + self.rnd.choice(["@", "@", "@", " [at] ", "(at)"]) + host

    def other(self) -> str:
        d, r = self.digits, self.rnd
        return r.choice([
            f"{r.randrange(1, 20)}.{r.randrange(10)}.{r.randrange(10)}", f"20{d(2)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", f"{r.randrange(10, 29)}.{r.randrange(10, 13)}.20{d(2)}", d(r.randrange(8, 16)), d(r.randrange(16, 20)) + "1" * 4,
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", " ".join(d(r.randrange(1, 4)) for _ in range(6)), hashlib.md5(d(5).encode()).hexdigest(), f"AKIA{d(3)}X{d(9)}", f"{d(3)} {d(4)}", f"{r.randrange(256, 999)}.{d(3)}.{r.randrange(300, 999)}.{d(2)}", f"1 {d(3)} {d(3)} {d(3)}",
            f"{d(2)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", ".".join(d(r.randrange(1, 3)) for _ in range(r.randrange(5, 8))), f"me@{d(2)}", f"x @home.{d(1)}", f"({d(4)}) {d(4)}-{d(4)}-{d(3)}", f"{d(4)}-{d(4)}",
        ])

    def window(self) -> tuple[str, list[Span]]:
        r, text, gold = self.rnd, "", []
        for _ in range(r.randrange(1, 5)):
            text += " ".join(r.choice(self.FILLER) for _ in range(r.choice([0, 0, 1, 3])))
            text += r.choice([" ", " ", "", ": ", ", ", "\n", "("]) if text else ""
            kind = r.choice([*KINDS, *KINDS, None, "bad card", None])
            if kind in KINDS and r.random() < 0.15:
                text += r.choice(CUES[kind]) + r.choice([" ", ": "])
            if kind is None and r.random() < 0.3:
                text += r.choice(CUES["none"]) + " "
            body = self.other() if kind is None else self.card(False) if kind == "bad card" else getattr(self, kind)()
            if text and (text[-1].isalnum() or text[-1] == "("):
                text += " "
            if kind in KINDS:
                gold.append(Span(len(text), len(text) + len(body), kind))
            text += body + r.choice([" ", " ", ".", ", ", ") ", "\n"])
        return text, gold


@lru_cache(maxsize=2)
def fitted(windows: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS, seed: int = 11) -> dict[str, float]:
    """Weights of features that maximise the windows' conditional likelihood (with a small quadratic penalty), by gradient steps
    window for window. An entity that isn't among its window's candidates is left out of its window."""
    maker, data, names = Maker(seed), [], {}
    for _ in range(windows):
        text, gold = maker.window()
        spans = list(dict.fromkeys(candidates(text)))
        if spans:
            rows = [np.array([names.setdefault(f, len(names)) for f in features(text, s)]) for s in spans]
            data.append((spans, rows, np.array([s in gold for s in spans])))
    w, order = np.zeros(len(names)), np.random.default_rng(seed)
    squares = np.full(len(names), 1e-2)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            spans, rows, gold = data[k]
            _, p = log_sums(spans, np.array([w[r].sum() for r in rows]))
            grad = -2e-4 * w
            for r, g in zip(rows, gold - p, strict=True):
                grad[r] += g
            squares += grad * grad
            w += 0.5 * grad / np.sqrt(squares)
    return {name: float(w[i]) for name, i in names.items()}


def added_spans(text: str, held: list[Span], weights: dict[str, float]) -> list[Span]:
    """The best segmentation of what overlaps none of these spans."""
    taken = sorted((s.start, s.end) for s in held)
    starts = [a for a, _ in taken]
    reach = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    some = []
    for s in candidates(text):
        k = bisect_left(starts, s.end)  # those that begin before its end
        if not k or reach[k - 1] <= s.start:
            some.append(s)
    some = list(dict.fromkeys(some))
    return best_spans(some, [sum(weights.get(f, 0.0) for f in features(text, s)) for s in some]) if some else []


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """For each row doc_id, the numbers n_email, n_ip, n_card and n_phone of the fixed patterns' spans, base (those spans) and
    spans (these and the ones that the model adds), both as kind:start:end in characters, by kind (in the order of KINDS), then
    start, joined by commas.

    The model adds spans where no fixed one stands, so adjoining numbers that a pattern runs together are told apart. A null
    text counts as empty: no spans. Texts are taken whole, in linear time; repeated rows are judged alike; an empty table gives
    no rows; other columns, whatever their names, are ignored. Every row is judged by itself, so nothing is shuffled.
    """
    held = weights or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                rows = []
                for x in texts[lo:hi]:
                    text = (x or b"").decode("utf-8", "replace")
                    base = base_spans(text)
                    every = sorted([*base, *added_spans(text, base, held)], key=lambda s: (KINDS.index(s.kind), s.start))
                    rows.append((*(sum(s.kind == k for s in base) for k in KINDS), joined(base), joined(every)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return plain.mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
