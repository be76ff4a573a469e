"""Text search: OR terms, "phrases" and -negations over all strings of a document."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import settings
from doclathe.functions import values
from doclathe.functions.paths import Scope
from doclathe.functions.values import Val
from doclathe.sources.shipping import ship

# Words that the stemming modes leave out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_MORE_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "Ae", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "œ": "oe", "Œ": "Oe", "ħ": "h", "Ħ": "H", "ı": "i"}
_VOWEL = "aeiou"


def deburr(text: str) -> str:
    """Latin letters without their marks."""
    if text.isascii():
        return text
    plain = "".join(_MORE_LETTERS.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))


class Stemmer:
    """The suffix stripper of Porter's 1980 paper, with the two rules of step 2 that its author revised later.  m counts vowel-consonant runs; v and d are the paper's
    *v* (holds a vowel) and *d (ends with a double consonant), o its cvc ending."""

    # The suffix rules of steps 2, 3 and 4.
    STEP2 = {
        "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
        "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
    }
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

    def _shape(self, w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in _VOWEL or (c == "y" and i and out[-1] == "c") else "c"
        return out

    def _m(self, w: str) -> int:
        return len(re.findall("v+c+", self._shape(w)))

    def _cvc(self, w: str) -> bool:
        return self._shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def _swap(self, w: str, rules: dict[str, str], least: int) -> str:
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                return stem + rules[end] if self._m(stem) > least else w
        return w

    def __call__(self, w: str) -> str:
        if len(w) < 3 or not w.isalpha():
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        trimmed = None
        if w.endswith("eed"):
            if self._m(w[:-3]) > 0:
                w = w[:-1]
        elif w.endswith("ed") and "v" in self._shape(w[:-2]):
            trimmed = w[:-2]
        elif w.endswith("ing") and "v" in self._shape(w[:-3]):
            trimmed = w[:-3]
        if trimmed is not None:
            w = trimmed
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and self._shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif self._m(w) == 1 and self._cvc(w):
                w += "e"
        if w.endswith("y") and "v" in self._shape(w[:-1]):
            w = w[:-1] + "i"
        w = self._swap(w, self.STEP2, 0)
        w = self._swap(w, self.STEP3, 0)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                if self._m(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = self._m(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and self._m(w) > 1:
            w = w[:-1]
        return w


stem = Stemmer()


def tokenize(text: str, mode: str) -> list[str]:
    if mode == "lightweight":
        return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
    words = [w for w in re.split(r"[^a-z0-9]+", deburr(text).lower()) if w]
    return [stem(w) for w in words if w not in STOP_WORDS]


def parse_search(search: str, mode: str) -> tuple[list[str], list[list[str]], list[str]]:
    """Terms, phrases and negations, as tokens."""
    phrases = [t for p in re.findall(r'"([^"]*)"', search) if (t := tokenize(p, mode))]
    terms, negations = [], []
    for word in re.sub(r'"[^"]*"', " ", search).split():
        if word.startswith("-") and len(word) > 1:
            negations += tokenize(word[1:], mode)
        else:
            terms += tokenize(word, mode)
    return terms, phrases, negations


def _strings(v: Val) -> list[Column]:
    if v.kind == "string":
        return [v.col]
    if isinstance(v.dtype, T.StructType):
        return [c for n in v.dtype.names for c in _strings(values.field(v, n))]
    if isinstance(v.dtype, T.ArrayType):
        inner = v.dtype.elementType
        if _strings(Val(F.lit(None).cast(inner), inner)):
            return [F.array_join(F.transform(v.col, lambda x: F.concat_ws(" ", *_strings(Val(x, inner)))), " ")]
    return []


def document_text(scope: Scope) -> Column:
    parts = [c for v in scope.fields.values() for c in _strings(v)]
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def _tokens(text: Column, mode: str) -> Column:
    if mode == "lightweight":
        return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("array<string>")
    def stemmed(s):
        known: dict[str, str] = {}

        def one(t):
            out = []
            for w in re.split(r"[^a-z0-9]+", deburr(t or "").lower()):
                if w and w not in STOP_WORDS:
                    if w not in known:
                        known[w] = stem(w)
                    out.append(known[w])
            return out

        return s.map(one)

    return stemmed(text)


def _one_of(words: list[str]):
    return lambda x: x.isin(*words)


def search(scope: Scope, spec) -> tuple[Column, Column]:
    """Whether a document matches, and its score."""
    wanted = spec["$search"] if isinstance(spec, dict) else spec
    mode = settings().text_search
    terms, phrases, negations = parse_search(wanted, mode)
    if not terms and not phrases:
        return F.lit(False), F.lit(0.0)
    words = list(dict.fromkeys([*terms, *negations]))
    times = {w: terms.count(w) for w in words}  # a term given twice counts twice

    def judge(tokens: Column) -> Column:
        """Whether a list of tokens matches, and its score."""
        there = {w: F.array_contains(tokens, w) for w in words}
        hits = reduce(lambda a, b: a + b, (F.when(there[w], times[w]).otherwise(0) for w in dict.fromkeys(terms)), F.lit(0))
        total = F.lit(0)
        for t in sorted(set(times.values()) - {0}):
            total = total + F.size(F.filter(tokens, _one_of([w for w in words if times[w] == t]))) * t
        ok = F.lit(True)
        for w in dict.fromkeys(negations):
            ok = ok & ~there[w]
        if phrases:
            line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
            for p in phrases:
                ok = ok & F.contains(line, F.lit(f" {' '.join(p)} "))
        if terms and not phrases:
            ok = ok & (hits > 0)
        if mode == "exact":
            n = F.size(tokens)
            base = F.when((total > 0) & (n > 0), (F.try_divide(0.5 * total, n.cast("double")) + 0.5) * hits).otherwise(0.0)
        else:
            base = total.cast("double")
        return F.struct(ok.alias("ok"), (base + (1 if phrases else 0)).cast("double").alias("score"))

    # A lambda over a list of one binds the tokens, so that they are made once a row.
    found = F.element_at(F.transform(F.array(_tokens(document_text(scope), mode)), judge), 1)
    ok = found["ok"]
    if mode == "lightweight":
        # Whatever holds a token holds its letters: most documents go before they are split.
        low = F.lower(document_text(scope))
        if phrases:
            first = [F.contains(low, F.lit(w)) for w in dict.fromkeys(w for p in phrases for w in p)]
            ok = reduce(lambda a, b: a & b, first) & ok
        else:
            first = [F.contains(low, F.lit(w)) for w in dict.fromkeys(terms)]
            ok = reduce(lambda a, b: a | b, first) & ok
    return values.sure(ok), found["score"]
