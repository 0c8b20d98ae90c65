"""Personal data in texts, disguised or not, at its place in the source.

Detectors find e-mail addresses, IP addresses, card numbers and phone numbers
as they stand.  For the rest, transducers rewrite a text and keep where every
rewritten piece came from: character references become characters, look-alike
characters ASCII, spelled digits and letters among digits become digits, "at"
and "dot" in their disguises ``@`` and ``.``, signs between the groups of a
card number hyphens, and accented letters of an address plain ones.
The same detectors then run over the rewritten text, and what they find goes
back to source characters.  Finds that hold a rewritten piece are added if they
touch no other span, or hold a base span of their kind and more.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weir.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tried at the first digit of a run alone: where that fails, no later digit of the run can succeed.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters that look like ASCII ones: fixed values, from the Cyrillic, Greek and Armenian alphabets and the phonetic one.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
#: Digit words: fixed values, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Digit words in a row from which they are digits; fewer are beside a digit, a plus or a dot.
DIGITS_IN_A_ROW = 3

#: ASCII and the letters of western European prose: a text of these alone has no look-alike.
ORDINARY = re.compile("[^\x00-\x9f¡-©«-±´-¸»ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßà-ÿ‘’“”…€]")
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_DOT = "dot|punkt|punto|point"
SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]{{1,3}})?(?:(?:{_DIGIT})(?:[\s,-]{{1,3}}|(?!\w)))+", re.IGNORECASE)
BEFORE_FEW = re.compile(rf"(?:[0-9+][\s,-]{{0,3}}|(?<!\w)(?:{_DOT})\s{{0,3}}[\])}}>]?\s{{0,3}}|\.)\Z", re.IGNORECASE)
AFTER_FEW = re.compile(rf"[\s,-]{{0,3}}[0-9]|\s{{0,3}}[\[({{<]?\s{{0,3}}(?:{_DOT})(?!\w)|\.\w", re.IGNORECASE)
WORDS = re.compile(r"\w+")
BRACKETED_AT = re.compile(rf"{_OPEN}(?:at|ät|arroba|arobase|@){_CLOSE}", re.IGNORECASE)
BRACKETED_DOT = re.compile(rf"{_OPEN}(?:dot|punkt|punto|point|\.){_CLOSE}", re.IGNORECASE)
#: A bare "at" needs a bare or bracketed "dot" (or a plain one already there with a bracketed at) after it.
SPACED = re.compile(r"(?<![\w.@])[A-Za-z0-9._%+-]{1,64}(?P<at>\s{1,3}(?:at|arroba|arobase)\s{1,3})[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}(?:dot|punkt|punto|point)\s{1,3}|\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
SPACED_DOT = re.compile(r"\s{1,3}(?:dot|punkt|punto|point)\s{1,3}", re.IGNORECASE)
AFTER_AT = re.compile(r"@[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}(?:dot|punkt|punto|point)\s{1,3}|\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
NUMBER_DOTS = re.compile(r"[0-9]{1,3}(?:(?:\s{1,3}(?:dot|punkt|punto|point)\s{1,3}|\.)[0-9]{1,3}){3}", re.IGNORECASE)
REFERENCE = re.compile(r"&(?:#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})|commat|period|plus|lowbar|hyphen|nbsp);")
#: Words joined by underscores, of which one is "at" and a later one "dot".
UNDERSCORED = re.compile(r"(?<![\w.@])[A-Za-z0-9._%+-]{1,64}?(?P<at>_at_)[A-Za-z0-9-]{1,63}(?:_dot_[A-Za-z0-9-]{1,63})+(?!\w)", re.IGNORECASE)
UNDERSCORED_DOT = re.compile("_dot_", re.IGNORECASE)
#: Digits with letters among them that are typed for digits; at most one in four is a letter.
MIXED = re.compile(r"(?<![\w.])[0-9OoIl](?:[\x20.-]?[0-9OoIl]){3,30}(?!\w)")
LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1"}
#: Groups of a card number with one sign between them that the detector does not take.
GROUPS = re.compile(r"(?<![\w.])(?:[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([./_])[0-9]{6}\2[0-9]{5})(?!\w)")
GROUP_SIGN = re.compile("[./_]")
#: Characters of an address that are looked at on each side of its sign.
REACH = 64


# --- detectors ------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping: from each ``@``, the run before it and the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if domain and start < at:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[Span]:
    """Spans as the text stands, by start, then kind."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0]))


# --- transducers ------------------------------------------------------------------


class Rewritten:
    """A text after replacements, with the way back to source characters."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        """``edits``: start, end and replacement, sorted, not overlapping."""
        out, at, self.marks, length = [], 0, [], 0
        for a, b, new in edits:
            out += [source[at:a], new]
            length += a - at
            self.marks.append((length, length + len(new), a, b))
            length += len(new)
            at = b
        out.append(source[at:])
        self.text = "".join(out)
        self.keys = [m[0] for m in self.marks]

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the rewritten span ``[a, b)``: replaced pieces count whole."""
        return self._point(a, False), self._point(b - 1, True)

    def _point(self, i: int, end: bool) -> int:
        k = bisect_right(self.keys, i) - 1
        if k < 0:
            return i + end
        _, new_end, a, b = self.marks[k]
        if i < new_end:
            return b if end else a
        return b + i - new_end + end

    def touched(self, a: int, b: int) -> bool:
        """Whether a replaced piece stands in ``[a, b)``."""
        k = bisect_right(self.keys, b - 1) - 1
        return k >= 0 and self.marks[k][1] > a


def reference_edits(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), html.unescape(m[0])) for m in REFERENCE.finditer(text)]
    return [e for e in found if len(e[2]) == 1]


def lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in ORDINARY.finditer(text):
        c = m[0]
        if unicodedata.category(c) == "Cf":
            new = ""
        elif c in LOOKALIKES:
            new = LOOKALIKES[c]
        else:
            new = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            new = str(digit) if digit is not None else "".join(LOOKALIKES.get(x, x) for x in new)
            if not new.isascii():
                continue
        out.append((m.start(), m.end(), new))
    return out


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in SPELLED.finditer(text):
        words = WORDS.findall(m[0].lower())
        end = m.start() + len(m[0].rstrip().rstrip(",-").rstrip())
        if len(words) < DIGITS_IN_A_ROW and not BEFORE_FEW.search(text, max(0, m.start() - 16), m.start()) and not AFTER_FEW.match(text, end):
            continue
        out.append((m.start(), end, "".join("+" if w == "plus" else DIGIT_WORDS[w] for w in words)))
    return out


def mixed_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in MIXED.finditer(text):
        letters = [i for i in range(m.start(), m.end()) if text[i] in LETTER_DIGITS]
        if letters and 3 * len(letters) <= sum(c.isdigit() for c in m[0]):
            out += [(i, i + 1, LETTER_DIGITS[text[i]]) for i in letters]
    return out


def group_edits(text: str) -> list[tuple[int, int, str]]:
    return [(g.start(), g.end(), "-") for m in GROUPS.finditer(text) for g in GROUP_SIGN.finditer(text, m.start(), m.end())]


def letter_edits(text: str) -> list[tuple[int, int, str]]:
    """Letters beyond ASCII, of alphabets with spaces between words, in the runs on both sides of an ``@``."""
    plain = lambda i: text[i] in LOCAL
    other = lambda i: "\xaa" <= text[i] <= "\u058f" and text[i].isalpha()
    found, at = set(), text.find("@")
    while at >= 0:
        for side in (range(at - 1, max(-1, at - 1 - REACH), -1), range(at + 1, min(len(text), at + 1 + REACH))):
            for i in side:
                if other(i):
                    found.add(i)
                elif not plain(i):
                    break
        at = text.find("@", at + 1)
    return [(i, i + 1, "x") for i in sorted(found)]


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "@") for m in BRACKETED_AT.finditer(text)]
    found += [(m.start(), m.end(), ".") for m in BRACKETED_DOT.finditer(text)]
    return _apart(found)


def spaced_edits(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in SPACED.finditer(text):
        dots = [d for d in SPACED_DOT.finditer(text, m.end("at"), m.end())]
        if dots:  # a bare "at" before a plain domain is prose
            found.append((*m.span("at"), "@"))
            found += [(d.start(), d.end(), ".") for d in dots]
    for m in UNDERSCORED.finditer(text):
        found += [(*m.span("at"), "@"), *((d.start(), d.end(), ".") for d in UNDERSCORED_DOT.finditer(text, m.end("at"), m.end()))]
    for whole in (AFTER_AT, NUMBER_DOTS):
        for m in whole.finditer(text):
            found += [(d.start(), d.end(), ".") for d in SPACED_DOT.finditer(text, m.start(), m.end())]
    return _apart(found)


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, last = [], 0
    for e in sorted(set(edits)):
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


def transducers(text: str) -> Iterator:
    """The transducers that a text may need; cheap tests leave out the others."""
    low = text.lower()
    refers = "&" in low and REFERENCE.search(text) is not None
    if refers:
        yield reference_edits
    if refers or ORDINARY.search(text):
        yield lookalike_edits
        low = None  # what they make may need any of the rest
    if low is None or sum(w in low for w in DIGIT_WORDS) >= 1:
        yield spelled_edits
    if low is None or any(c in low for c in "[({<"):
        yield sign_edits
    if low is None or any(w in low for w in ("dot", "punkt", "punto", "point")):
        yield spaced_edits
    yield mixed_edits
    yield group_edits
    if refers or not text.isascii():
        yield letter_edits


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """``(base, all)`` spans of a text, each by start, then kind."""
    base = detect(text)
    now, chain = text, []
    for step in transducers(text):
        edits = step(now)
        if edits:
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    if not chain:
        return base, base
    starts = [x for _, x, _ in base]
    reach = list(accumulate((y for _, _, y in base), max))  # the furthest end up to each base span
    of_kind = [[(x, y) for k, x, y in base if k == kind] for kind in range(len(KINDS))]
    added: list[Span] = []
    last = 0  # the furthest end of those added, which start no later than the next one
    for kind, a, b in detect(now):
        touched = False
        for r in reversed(chain):
            touched = touched or r.touched(a, b)
            a, b = r.back(a, b)
        if not touched:
            continue
        k = bisect_left(starts, b)  # base spans that start before b
        apart = last <= a and (k == 0 or reach[k - 1] <= a)
        own = of_kind[kind]
        k = bisect_left(own, (a, a))
        wider = k < len(own) and own[k][1] <= b and own[k] != (a, b)
        if apart or wider:
            added.append((kind, a, b))
            last = max(last, b)
    return base, sorted(base + added, key=lambda s: (s[1], s[0]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the counts, digest and list of its spans.

    ``n_email`` and the other counts are those of the base detectors, as is
    ``base_sha256``; ``spans`` has the disguised ones too.  A null or empty
    text has none.  Repeated rows stay; other columns are not read.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for text in batch.column(1):
            base, whole = spans(text.as_py() or "")
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                out[name].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(whole))
        yield {"doc_id": batch.column(0)} | out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_texts(docs, ["doc_id", "text"], schema, per_batch)


def redact(text: str) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at, last = [], 0, 0
    for kind, a, b in spans(text)[1]:
        if a >= last:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        last = at = max(last, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data out of ``text``, and ``n_chars`` as it now is (a null text stays null)."""
    at, kinds = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if t is None else redact(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(run, kinds)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out
