"""Personal data: base patterns, and spans that a character BiLSTM-CRF adds.

The base kinds are patterns for e-mail addresses, IP addresses, payment cards and phone numbers. The model, a
bidirectional LSTM over characters with CRF transitions, is trained in numpy from labelled spans that
training_texts() makes by rule: written-out and masked forms, among prose and things that look alike. A text is cut
into windows of WINDOW characters that overlap by OVERLAP, and every window is decoded, so that a span of up to OVERLAP
characters lies whole in one of them. Then the windows are reconciled over the whole text: spans of a kind that
touch a window's edge and overlap those of the next window are joined, and of all spans the set without overlaps and
with the largest total score stays. Model spans that touch a base span, score below SURE, or have fewer digits or
signs than any span of their kind are left out; base spans always stay.

A null or empty text has none. Very long texts take time in proportion. Repeated rows get equal spans; of equally good
sets of spans the one that ends first is taken. An empty table has no rows. Columns other than text are passed through;
the column of spans is named with underscores if its name is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import Tagger
from .spans import Span, digest, found, ordered, redact

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP, SURE = 2048, 64, 0.9
#: Characters of a training window, hidden units, and how long to train on how many texts.
TAUGHT, HIDDEN, STEPS, TEXTS = 128, 16, 900, 6000
#: Windows decoded at a time.
BATCH = 512
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each @ with its domain, and the whole run of local characters before it that no match has taken."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns; one that fails its test is dropped, not tried again."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 20) and all(len(p.lstrip("0")) < 4 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return ordered(out, KINDS)


_CLASSES = 99
_TABLE = np.full(0x250, 97, np.uint8)
_TABLE[32:127] = np.arange(1, 96)
_TABLE[[i for i in range(0x80, 0x250) if chr(i).isalpha()]] = 96
_TABLE[[9, 10, 11, 12, 13]] = 98


def classes(text: str) -> np.ndarray:
    """The class of each character: itself if printable ASCII, or letter, white space, other."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 97)


#: Words that training texts mix with invented ones, so that prose about times, places and numbers is known to be none.
_PROSE = (
    "the of and to in is that it was for on are with as be at one two three four five six seven eight nine zero ten dot com point "
    "from this have by not but what all were when we there can an your which their said if do will each about how up out them then "
    "mail phone card address call write meet look arrived stay noon home work school least first once night page number "
    "der die das und ist nicht ein eine mit auf von zu den im an bei um le la les des un une est dans pour que qui sur el los las del por con para una"
).split()
_DIGITS = "zero one two three four five six seven eight nine".split()
_ENDS = "com org net de fr es co.uk info example.com io edu".split()


class _Maker:
    """Invented texts and values."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def upto(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high))

    def number(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def letters(self, low: int, high: int) -> str:
        if self.rng.random() < 0.5:
            return "".join(chr(97 + c) for c in self.rng.integers(0, 26, self.upto(low, high)))
        return "".join(self.pick(*"bcdfghklmnprstvwz") + self.pick(*"aeiou") for _ in range(max(1, self.upto(low, high) // 2 + 1)))

    def word(self) -> str:
        w = self.pick(*_PROSE) if self.rng.random() < 0.5 else self.letters(1, 10)
        w = self.pick(w, w, w, w, w, w.title(), w.upper(), w.replace("a", "é").replace("o", "ü"))
        return w + self.pick("", "", "", "", "", ",", ".", ";", ":", "!", "***", "%%%", "###")

    def user(self) -> str:
        a, b = self.letters(2, 9), self.letters(2, 9)
        return self.pick(a, a + self.number(2), f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}.{b}", f"{a}.{self.number(2)}")

    def email(self) -> str:
        user, host, end = self.user(), self.letters(3, 10), self.pick(*_ENDS)
        name = f"{host}.{end}"
        case = self.pick(str, str, str.upper, str.title)
        at, dot = case("at"), case("dot")
        opened, closed = self.pick("()", "[]", "{}", "<>")
        spelled = self.pick(f" {dot} ", f" {opened}{dot}{closed} ", f"{opened}{dot}{closed}", f" {opened}.{closed} ")
        said = user.replace(".", f" {dot} ") if spelled == f" {dot} " and self.rng.random() < 0.5 else user
        form = self.upto(0, 8)
        if form == 0:
            return f"{user}@{name}"
        if form == 1:
            return f"{user}{self.pick(' @ ', ' @', '@ ')}{name}"
        if form == 2:
            return f"{user}{opened}{at}{closed}{name}"
        if form == 3:
            return f"{user} {opened}{at}{closed} {name}"
        if form == 4:
            return f"{user}{opened}{at}{closed}{name.replace('.', f'{opened}{dot}{closed}')}"
        if form == 5:
            return f"{user} {opened}{at}{closed} {name.replace('.', spelled)}"
        if form == 6 and ("." in user or any(c in "0123456789" for c in user)):
            return f"{user} {at} {name}"
        return f"{said} {at} {name.replace('.', f' {dot} ')}"

    def card(self) -> str:
        body = self.number(15)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return self.pick("", " ", "-", ".", "_", "/", " - ", "  ").join(digits[i : i + 4] for i in range(0, 16, 4))

    def ip(self) -> str:
        parts = [str(p) for p in self.rng.integers(0, 256, 4)]
        dot = self.pick("dot", "DOT", "point")
        return self.pick(".", ".", "[.]", "(.)", f" {dot} ", f"[{dot}]", f"({dot})", " . ").join(parts) + self.pick("", "", "", "/24")

    def phone(self) -> str:
        a, b, c = self.number(3), self.number(3), self.number(4)
        if self.rng.random() < 0.25:
            said = [_DIGITS[int(d)] for d in self.number(self.upto(7, 12))]
            return self.pick(str, str, str.upper, str.title)(self.pick(" ", " ", "-", ", ").join(said))
        return self.pick(f"+{self.number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{self.number(2)} {a} {b}{c}", f"0{a}/{b}{c}", f"0{a} {b} {c}", f"+{self.number(2)}-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}")

    def other(self) -> str:
        a, n = self.letters, self.number
        return self.pick(
            n(self.upto(1, 6)), f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}:{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(2)}.{n(2)}", f"[{n(2)}]", f"({a(2, 6)})", f"${n(3)}.00",
            "".join("0123456789abcdef"[c] for c in self.rng.integers(0, 16, self.upto(8, 64))), f"AKIA{a(6, 10).upper()}{n(8)}", f"password={a(3, 7)}{n(4)}", f"{a(2, 6)}@{a(2, 5)}",
            f"https://{a(3, 9)}.{self.pick(*_ENDS)}/{n(4)}", f"{a(3, 9)}.{self.pick(*_ENDS)}", f"{self.pick('look', 'meet', 'stay', 'arrived', 'call')} at {a(3, 9)}.{self.pick(*_ENDS)}", f"at {n(2)}:{n(2)}",
            n(self.upto(20, 40)), f"{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}", f"({n(4)})", f"§ {n(3)}", f"{n(3)},{n(3)}", f"x{n(10)}", f"{n(2)}, {n(2)}, {n(2)} and {n(2)}", f"{self.pick(*_DIGITS)} or {self.pick(*_DIGITS)}",
            f"{self.pick(*_DIGITS)}, {self.pick(*_DIGITS)}, {self.pick(*_DIGITS)}", f"at {a(3, 8)} the dot is {a(2, 6)}", f"a dot com {a(3, 8)}", f"{a(3, 8)} at the {a(3, 8)}", f"{a(3, 8)}. At {a(3, 8)}", f"{a(3, 8)}. {a(2, 6)} at {a(3, 8)}.", f"{n(2)} {n(2)} {n(2)}", f"1{n(3)}-2{n(3)}", f"{a(3, 6)}_{n(3)}", f"| {a(2, 8)} | {n(2)} |",
        )


def training_texts(count: int = TEXTS, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Invented texts with their labelled spans, in the written forms that the patterns miss as well as those they find."""
    maker = _Maker(seed)
    out = []
    for _ in range(count):
        text, spans = "", []
        words = maker.pick(3, 6, 6, 14, 40)
        while len(text) < TAUGHT:
            for _ in range(maker.upto(0, words)):
                text += maker.word() + " "
            kind = maker.pick(*KINDS, "other", "other", "other", "other")
            value = getattr(maker, kind)()
            text += maker.pick("", "", "", "(", '"', ": ")
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + maker.pick(" ", " ", ". ", ", ", ") ", "\n", '" ', "! ")
        out.append((text, spans))
    return out


def train(texts: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 5) -> Tagger:
    """A tagger fitted to labelled texts, each cut at TAUGHT characters or less from a random place."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((len(texts), TAUGHT), np.int64), np.zeros((len(texts), TAUGHT), np.int64)
    for r, (text, spans) in enumerate(texts):
        label = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            label[start:end] = 1 + KINDS.index(kind)
        at = int(rng.integers(0, max(1, len(text) - TAUGHT + 1)))
        end = at + (TAUGHT if rng.random() < 0.7 else int(rng.integers(20, TAUGHT)))  # some texts end within a window
        part = classes(text)[at:end]
        x[r, : len(part)], y[r, : len(part)] = part, label[at:end]
    tagger = Tagger.fresh(_CLASSES, 1 + len(KINDS), HIDDEN, seed)
    tagger.train(x, y, steps, 128, 0.02, seed)
    return tagger


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(training_texts())


Scored = tuple[str, int, int, float]


def joined_up(spans: list[tuple[Scored, bool, bool]]) -> list[Scored]:
    """Spans with whether a window's edge cuts their beginning and their end: those that go on in the next window are
    joined, what stays cut keeps half its score."""
    out: list[tuple[Scored, bool, bool]] = []
    for span in sorted(spans, key=lambda s: (s[0][0], s[0][1], s[0][2])):
        if out:
            (kind, start, end, score), left, right = out[-1]
            (kind_, start_, end_, score_), left_, right_ = span
            if kind == kind_ and start_ < end and (right or left_):
                size, size_ = end - start, end_ - start_
                ends_here = right if end > end_ else right_ if end_ > end else right and right_
                out[-1] = (kind, start, max(end, end_), (score * size + score_ * size_) / (size + size_)), left and (left_ or start < start_), ends_here
                continue
        out.append(span)
    return [(k, s, e, score * (0.5 if left or right else 1)) for (k, s, e, score), left, right in out]


def reconciled(spans: list[Scored]) -> list[Scored]:
    """The set of spans without overlaps that has the largest sum of score times length."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[1], s[0], s[3]))
    ends = [s[2] for s in spans]
    best = [0.0] * (len(spans) + 1)
    take = [-1] * (len(spans) + 1)
    for i, (_, start, end, score) in enumerate(spans, 1):
        before = bisect_right(ends, start, 0, i - 1)
        with_it = best[before] + score * (end - start)
        best[i], take[i] = (with_it, before) if with_it > best[i - 1] else (best[i - 1], -1)
    out, i = [], len(spans)
    while i:
        if take[i] >= 0:
            out.append(spans[i - 1])
            i = take[i]
        else:
            i -= 1
    return out[::-1]


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Scored]]:
    """The model's spans of each text with their scores, after reconciling its windows."""
    coded = [classes(t) for t in texts]
    places = [(r, start) for r, t in enumerate(coded) for start in range(0, max(1, len(t) - OVERLAP), WINDOW - OVERLAP) if len(t)]
    places.sort(key=lambda p: -min(WINDOW, len(coded[p[0]]) - p[1]))  # windows of a length together
    got: list[list[tuple[Scored, bool, bool]]] = [[] for _ in texts]
    for lo in range(0, len(places), BATCH):
        part = places[lo : lo + BATCH]
        r, start = part[0]
        x = np.zeros((len(part), 1 + min(WINDOW, len(coded[r]) - start)), np.int64)  # one of padding at least
        for k, (r, start) in enumerate(part):
            window = coded[r][start : start + WINDOW]
            x[k, : len(window)] = window
        label, sure = tagger.decode(x)
        for k in np.flatnonzero(label.any(axis=1)).tolist():
            r, start = part[k]
            text = texts[r]
            cut = np.flatnonzero(np.diff(label[k])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), label.shape[1]]):
                if label[k, a]:
                    s, e = start + a, min(start + b, len(text))
                    left, right = a == 0 and start > 0, b >= WINDOW and start + WINDOW < len(text)
                    while e > s and text[e - 1].isspace():
                        e -= 1
                    while s < e and text[s].isspace():
                        s += 1
                    if e > s:
                        got[r].append(((KINDS[label[k, a] - 1], s, e, float(sure[k, a:b].mean())), left, right))
    return [reconciled(joined_up(g)) for g in got]


_SAID = re.compile(r"\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b", re.I)
_AT = re.compile(r"(?:@|\bat\b).*(?:\.\w|\bdot\b)", re.I | re.S)
_DOT = re.compile(r"\.|\b(?:dot|point)\b", re.I)


def _plausible(kind: str, value: str) -> bool:
    """A span has as many digits, written or said, or the signs, as any of its kind has."""
    digits = sum(c in "0123456789" for c in value) + len(_SAID.findall(value))
    if kind == "email":
        return bool(_AT.search(value))
    if kind == "ip":
        return len(_DOT.findall(value)) == 3 and 4 <= digits <= 14
    return {"card": 12, "phone": 7}[kind] <= digits <= {"card": 19, "phone": 15}[kind]


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    out = []
    for text, spans in zip(texts, model_spans(texts, tagger)):
        base = base_spans(text)
        more = [(k, s, e) for k, s, e, score in spans if score >= SURE and _plausible(k, text[s:e]) and not any(s < b and a < e for _, a, b in base)]
        out.append((base, ordered(more, KINDS)))
    return out


def scan(docs: DataFrame, tagger: Tagger | None = None, spans: str = "pii_spans") -> DataFrame:
    """docs with a column of its spans: kind, start, end, and whether it is of the base patterns."""
    held = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    return found(docs, lambda texts: find(texts, held.value), spans)


def redacted(text: str | None, tagger: Tagger | None = None) -> str | None:
    """text with its personal data replaced by their kinds."""
    base, more = find([text or ""], tagger or default_tagger())[0]
    return redact(text, [*base, *more])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    return digest(scan(docs.select("doc_id", F.col("text")), spans="_spans"), KINDS, KINDS)
