"""Personal data in text, found also behind disguises, with offsets of the original characters.

Base identifiers are found in the text as it stands: e-mail addresses, IPv4 addresses, payment card
numbers that pass Luhn's test, and international phone numbers.

Then a chain of transducers rewrites disguises and keeps, for each character that it writes, the source
span that it came from: homoglyphs (full-width forms, Cyrillic and Greek look-alikes, digits of other
scripts) become ASCII and invisible characters go; ``[at]``, ``(dot)``, `` at `` ... `` dot `` become @
and . ; runs of spelled digits in English, French, German and Spanish become digits.  The same detectors
run on what comes out.  A match that covers a rewritten character is mapped back to source characters,
and is kept unless it overlaps a base span of its kind.  Texts without a disguise's trigger skip the chain.

Credentials (a run of 16 characters or more with a digit that is assigned to a name like token or api_key) are
no identifiers of a person, but go with them: they have a column of their own and are in no other.

Offsets count code points, end exclusive.  Defined cases: null text is empty; an empty text has no span
and the digest of the empty text; repeated rows give repeated rows; an empty table gives no rows;
further columns are not read."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import ship, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Takes each run of digits whole, with three more runs if they follow: one pass, however long the runs.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping; each must end its local part at an @, so only those are looked at."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if m[1] and all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


#: What is assigned, and the names that make it a credential; no name with its quote and blanks is longer.
_ASSIGNED = re.compile(r"[=:][ \t]*[\"']?([A-Za-z0-9+/_.~=-]{16,})")
_CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|(?:api|access|private|secret)[_ -]?key)[\"']?[ \t]{0,3}\Z")
_NAME_CHARS = 15


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in _ASSIGNED.finditer(text) if _CREDENTIAL.search(text, max(0, m.start() - _NAME_CHARS), m.start()) and any(map(str.isdigit, m[1]))]


DETECT = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Look-alike letters of other scripts.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhlABEKMHOPCTXIJS")) | dict(zip("αορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopviABEZHIKMNOPTYX"))
LOOKALIKES |= {"․": ".", "．": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "＠": "@", "﹫": "@"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_ODD = re.compile(r"[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "٠-٩۰-۹०-९！-～\U0001d7ce-\U0001d7ff₀-₉²³¹⁰⁴-⁹]")
# Digits spelled in English, French, German and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?i)\b(?:plus[ \-]+)?(?:(?:{_NUMBER})\b[ .,\-]*){{4,}}")
_SPELLED_WORD = re.compile(rf"(?i)\b(?:{_NUMBER}|plus)\b")
_SPELLED_TRIGGER = re.compile(rf"(?i)\b(?:{_NUMBER})[ .,\-]+(?:{_NUMBER})[ .,\-]+(?:{_NUMBER})[ .,\-]+(?:{_NUMBER})\b")
_BRACKET_AT = r"\s*[\[({<]\s*(?:at|@|arroba|arobase)\s*[\])}>]\s*"
_BRACKET_DOT = r"\s*[\[({<]\s*(?:dot|\.|punto|point|punkt)\s*[\])}>]\s*"
_BRACKETS = re.compile(rf"(?i)(?P<at>{_BRACKET_AT})|(?P<dot>{_BRACKET_DOT})")
_BRACKET_TRIGGER = re.compile(r"(?i)[\[({<]\s*(?:at|@|arroba|arobase|dot|\.|punto|point|punkt)\s*[\])}>]")
#: name at host dot tld, where either word may be a sign.
_WORDY = re.compile(r"(?i)(?<![\w.+%-])[a-z0-9._%+-]+(?:[ ]dot[ ][a-z0-9_%+-]+)*(?:\s+at\s+|@)[a-z0-9-]+(?:(?:[ ]+dot[ ]+|\.)[a-z0-9-]+)+")
_WORDY_SIGN = re.compile(r"(?i)\s+at\s+|\s+dot\s+")
#: Endings that tell "name at host.com" from "look at this.Then".
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv us uk ca au nz ie eu de at ch fr be nl es pt it se no dk fi pl cz ru ua tr br mx ar cl in jp cn kr".split())
_OPENING = re.compile(r"[\[({<]")


def _spelled_pair(low: str) -> bool:
    """Whether two spelled digits stand side by side; a run of four has two with separators around both."""
    words = low.replace(".", " ").replace(",", " ").replace("-", " ").split()
    if SPELLED.keys().isdisjoint(words):
        return False
    before = False
    for w in words:
        now = w in SPELLED
        if now and before:
            return True
        before = now
    return False


class Mapped:
    """A text with the source span of each piece that was rewritten; pieces between them are as they were."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]] = ()):
        self.text = text
        self.pieces = list(pieces)  # start and end here, start and end in the source; in order
        self.starts = [p[0] for p in self.pieces]

    def _back(self, at: int, is_end: bool) -> int:
        i = bisect_right(self.starts, at - is_end) - 1
        if i < 0:
            return at
        a, b, c, d = self.pieces[i]
        if at - is_end < b:
            return d if is_end else c
        return d + at - b

    def touched(self, start: int, end: int) -> bool:
        """Whether [start, end) holds something rewritten, if only a character that went."""
        i = max(0, bisect_right(self.starts, start) - 1)
        while i < len(self.pieces) and self.pieces[i][0] < end:
            a, b, *_ = self.pieces[i]
            if b > start if a < b else a > start:
                return True
            i += 1
        return False

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end)."""
        return self._back(start, False), self._back(end, True)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """edits: (start, end, new text), in order and apart from each other, in this text."""
        if not edits:
            return self
        out, made, at, shift = [], [], 0, 0
        left = self.pieces[::-1]
        for a, b, new in edits:
            # Older pieces before the edit move; what it covers of them goes, as it has their source.
            while left and (left[-1][0] < b or left[-1][1] <= b):
                c, d, *of = left.pop()
                if c < a or c == d < a:
                    made.append((c + shift, min(d, a) + shift, *of))
                if d > b:
                    left.append((max(c, b), d, *of))
                    break
            out += [self.text[at:a], new]
            made.append((a + shift, a + shift + len(new), *self.source(a, b)))
            shift += len(new) - (b - a)
            at = b
        made += [(c + shift, d + shift, *of) for c, d, *of in left[::-1]]
        return Mapped("".join([*out, self.text[at:]]), made)


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    return unicodedata.normalize("NFKC", c)


def disguised(text: str) -> Mapped | None:
    """The text with its disguises undone, or None if there are none."""
    m = Mapped(text)
    if not text.isascii() and _ODD.search(text):
        m = m.rewrite([(x.start(), x.end(), _plain(x[0])) for x in _ODD.finditer(text)])
    if _OPENING.search(m.text) and _BRACKET_TRIGGER.search(m.text):
        m = m.rewrite([(x.start(), x.end(), "@" if x.lastgroup == "at" else ".") for x in _BRACKETS.finditer(m.text)])
    low = m.text.lower()
    if " dot " in low or (" at " in low and "." in low) or m.pieces:
        edits = []
        for x in _WORDY.finditer(m.text):
            signs = [(x.start() + w.start(), x.start() + w.end(), "@" if "a" in w[0].lower() else ".") for w in _WORDY_SIGN.finditer(x[0])]
            dotted = any(new == "." for *_, new in signs) or m.touched(x.start(), x.end())
            if dotted or x[0].rsplit(".", 1)[-1].lower() in ENDINGS:
                edits += signs
        m = m.rewrite(edits)
    if _spelled_pair(low) and _SPELLED_TRIGGER.search(m.text):
        edits = []
        for x in _SPELLED_RUN.finditer(m.text):
            words = [*_SPELLED_WORD.finditer(x[0])]
            for i, w in enumerate(words):
                end = words[i + 1].start() if i + 1 < len(words) else w.end()
                edits.append((x.start() + w.start(), x.start() + end, "+" if w[0].lower() == "plus" else SPELLED[w[0].lower()]))
        m = m.rewrite(edits)
    return m if m.pieces else None


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans, by kind."""
    text = text or ""
    base = {k: f(text) for k, f in DETECT.items()}
    spans = base
    if (m := disguised(text)) is not None:
        spans = {}
        for k, f in DETECT.items():
            more = []
            for a, b in f(m.text):
                s, e = m.source(a, b)
                if m.touched(a, b) and not any(s < d and c < e for c, d in base[k]):
                    more.append((s, e))
            spans[k] = sorted({*base[k], *more})
    return base, spans


def digest(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


_LONG = pa.int64()
_ARROW = pa.schema([("doc_id", _LONG), *((f"n_{k}", _LONG) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("secrets", pa.string()), ("n_found", _LONG)])


def _batches(it):
    for b in it:
        rows = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            base, spans = find(t)
            keys = secrets(t or "")
            counts = {f"n_{k}": len(base[k]) for k in KINDS} | {"n_found": sum(map(len, spans.values())) + len(keys)}
            rows.append({"doc_id": d, **counts, "base_sha256": hashlib.sha256(digest(base).encode()).hexdigest(), "spans": digest(spans), "secrets": ",".join(f"secret:{a}:{b}" for a, b in keys)})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def identifiers(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of base spans, their digest, all spans as kind:start:end, credentials
    likewise, and how many spans and credentials there are."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, secrets string, n_found long")


def op10_pii_spans(spark, sf_dir):
    return identifiers(table(spark, sf_dir, "documents"))
