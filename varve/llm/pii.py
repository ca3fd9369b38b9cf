"""Personal data in whole texts, also in disguise, with offsets into the text as it is.

The base detectors find e-mail addresses, IPv4 addresses, payment cards and
phone numbers. A chain of transducers then normalises homoglyphs, spelled
digits and at/dot disguises, keeping for each character of the normal form the
span of source characters that it stands for. The detectors run again on the
normal form, and what they find there is mapped back to the source; it is added
unless a base span of its kind covers it. Base spans stay beside added ones that
overlap them, as they may be fragments of a disguised identifier.

Offsets count code points; ends are exclusive. Every detector takes time in
proportion to the text, whatever the text.

Defined results. Null texts count as empty: no spans, the hash of the empty
string. Rows that repeat an id are scanned each. An empty table gives an empty
result; only the id and the text column are read. ``n_email`` to ``n_phone``
count base spans, ``n_added`` the added ones.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Leftmost addresses: from each at sign back over the local part, no further than the last address."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c not in " -"] if m.end() - m.start() <= 40 else []
        if 12 <= len(digits) <= 19:
            doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
            if (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0:
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detected(text: str) -> list[tuple[int, int, str]]:
    """Base spans ``(start, end, kind)`` by start, then kind as listed."""
    found = [(start, end, "email") for start, end in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(start, end, kind) for kind in KINDS[1:] for start, end in DETECTORS[kind](text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- transducers: normal form with the source span of each of its characters ---

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵɡıⅼ",
    "ABESIJKMHOPCTXYaesijopcxydhqwABEZHIKMNOPTYXovgil",
)
SIGNS = {"﹫": "@", "＠": "@", "․": ".", "。": ".", "．": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
HIDDEN = frozenset("​‌‍⁠﻿­")
# Digit names.
NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}

NAME = "(?:" + "|".join(NAMES) + ")"
#: At least three digits in a row, one of them spelled. No look-ahead: a failed end would have the run scanned again from each number.
SPELLED = re.compile(rf"(?i)(?<![a-z0-9])(?:plus[\s-]+)?(?:(?:double|triple)[\s-]+)?(?:{NAME}|[0-9]+)(?:[\s,.-]{{1,3}}(?:(?:double|triple)[\s-]+)?(?:{NAME}|[0-9]+))++")
TOKEN = re.compile(rf"(?i)plus|double|triple|{NAME}|[0-9]+")
BRACKET_AT = re.compile(r"(?i)[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(?:at|@)[\x20\t]{0,3}[\])}>][\x20\t]{0,3}")
BRACKET_DOT = re.compile(r"(?i)[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(?:dot|\.)[\x20\t]{0,3}[\])}>][\x20\t]{0,3}")
LOOSE_AT = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]{1,3}@[\x20\t]{1,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[\x20\t]{1,3}@(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[\x20\t]{1,3}(?=[A-Za-z0-9])")
WORD_DOT = re.compile(r"(?i)(?<=[a-z0-9])[\x20\t]{1,3}dot[\x20\t]{1,3}(?=[a-z0-9])")
#: A spelled "at" between a name and a domain; dots are plain by then.
WORD_AT = re.compile(r"(?i)(?<=[a-z0-9])[\x20\t]{1,3}at[\x20\t]{1,3}(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,12}(?![a-z0-9]))")
# Gates over lower-case text, each wider than the transducers it stands before.
BRACKET_GATE = re.compile(r"[\[({<][\x20\t]{0,3}(?:at|@|dot|\.)[\x20\t]{0,3}[\])}>]")
SPELLED_GATE = re.compile(rf"{NAME}[\s,.-]{{1,3}}(?:{NAME}|double|triple|[0-9])|[0-9][\s,.-]{{1,3}}(?:(?:double|triple)[\s-]+)?{NAME}")
DOT_GATE = re.compile(r"dot[\x20\t]{1,3}[a-z0-9]")
LOOSE_GATE = re.compile(r"@[\x20\t]|[\x20\t]@")
WORD_GATE = re.compile(r"at[\x20\t]{1,3}[a-z0-9-]+\.[a-z0-9-]")


@functools.cache
def plain(c: str) -> str:
    """What the first transducer makes of a character beyond ASCII; nothing of an invisible one."""
    if c in HIDDEN:
        return ""
    new = SIGNS.get(c) or c.translate(LOOKALIKES)
    if new != c:
        return new
    digit = unicodedata.decimal(c, None)
    form = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
    return form if form.isascii() and form else c


class Normal:
    """A text and, for each of its characters, the source characters behind it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def characters(self) -> None:
        """Homoglyphs, compatibility forms and digits of other scripts become ASCII; invisible characters go."""
        out, starts, ends = [], [], []
        for c, a, b in zip(self.text, self.starts, self.ends, strict=True):
            for x in c if c < "\x80" else plain(c):
                out.append(x)
                starts.append(a)
                ends.append(b)
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def replace(self, pattern: re.Pattern, made: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace matches; ``made`` gives characters with their span inside the match."""
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[at : m.start()])
            starts += self.starts[at : m.start()]
            ends += self.ends[at : m.start()]
            for c, a, b in made(m):
                out.append(c)
                starts.append(self.starts[m.start() + a])
                ends.append(self.ends[m.start() + b - 1])
            at = m.end()
        if at:
            self.text = "".join(out) + self.text[at:]
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def sign(character: str) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    return lambda m: [(character, 0, m.end() - m.start())]


def digits_of(m: re.Match) -> list[tuple[str, int, int]]:
    """The digits of a spelled run, or the run as it is if it spells fewer than three.

    A last number that goes on as a word is no part of the run.
    """
    out, times, begun, spelled, parts = [], 1, None, False, list(TOKEN.finditer(m[0]))
    end = len(m[0])
    if m.string[m.end() : m.end() + 1].isalnum() and m.string[m.end()].isascii():
        parts.pop()
        while parts and lower(parts[-1][0]) in TIMES:
            parts.pop()
        end = parts[-1].end() if parts else 0
    for t in parts:
        word = lower(t[0])
        if word == "plus":
            out.append(("+", *t.span()))
        elif word in TIMES:
            times, begun = TIMES[word], t.start()
        else:
            a = t.start() if begun is None else begun
            if word in NAMES:
                spelled = True
                out += [(NAMES[word], a, t.end())] * times
            else:
                out += [(c, t.start() + i, t.start() + i + 1) for i, c in enumerate(word)]
            times, begun = 1, None
    if not spelled or sum(c != "+" for c, _, _ in out) < 3:
        return [(c, i, i + 1) for i, c in enumerate(m[0])]
    return out + [(c, i, i + 1) for i, c in enumerate(m[0]) if i >= end]


def strange(text: str) -> bool:
    """Whether a text has characters that the first transducer changes."""
    return not text.isascii() and any(c > "\x7f" and plain(c) != c for c in set(text))


#: An IPv4 address may be spelled with dots between the numbers: dots first, digits in between them after.
TRANSDUCERS = [(BRACKET_DOT, sign(".")), (BRACKET_AT, sign("@")), (SPELLED, digits_of), (WORD_DOT, sign(".")), (LOOSE_AT, sign("@")), (WORD_AT, sign("@"))]


def lower(text: str) -> str:
    """Lower case as the patterns see it, with as many characters."""
    return text.lower() if text.isascii() else text.replace("\u0130", "i").lower()


def disguised(text: str) -> bool:
    """Whether a transducer may have a match in a text. The first that has one in the chain sees the text as it is."""
    low = lower(text)
    return bool(
        ("@" in low and LOOSE_GATE.search(low))
        or BRACKET_GATE.search(low)
        or WORD_GATE.search(low)
        or DOT_GATE.search(low)
        or SPELLED_GATE.search(low)
    )


def normalised(text: str, gate: bool = True) -> Normal | None:
    """The normal form, or None where no transducer has anything to do; the gate only saves time."""
    odd = strange(text)
    if gate and not odd and not disguised(text):
        return None
    normal = Normal(text)
    if odd:
        normal.characters()
    for pattern, made in TRANSDUCERS:
        normal.replace(pattern, made)
    return normal if normal.text != text else None


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that the normal form adds."""
    text = text or ""
    base = detected(text)
    normal = normalised(text)
    if normal is None:
        return base, []
    taken = {kind: [(a, b) for a, b, k in base if k == kind] for kind in KINDS}
    added = []
    for a, b, kind in detected(normal.text):
        start, end = normal.starts[a], normal.ends[b - 1]
        near = bisect.bisect_left(taken[kind], (start + 1, 0))  # the last base span that begins at the start or before
        if not near or taken[kind][near - 1][1] < end:
            added.append((start, end, kind))
    return base, added


def told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts and hash of the base spans, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FOUND.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, added = spans(text.as_py())
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, FOUND)
