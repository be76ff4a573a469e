"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted over a bounded sample of
labelled texts; then the statistics are frozen.  The code length of a byte is that of its longest known
context; a byte that this context has not seen costs an escape (method C: as many escapes as different
bytes seen) and is coded by the next shorter context, whose bytes already ruled out are excluded, so
probabilities sum to one in every context.  At the end stands the uniform distribution over all 256 bytes.
The language with the shortest code for the whole text wins; the score is its posterior under equal priors.

Each language's tree is kept as it is, whatever the number of languages: sorted arrays of the byte strings
that it has seen.  As statistics are frozen, code lengths in all languages of strings met before are
remembered in a table of ``MEMO_BYTES`` in each worker, which changes no result.

Texts are lower-cased and coded as UTF-8; ASCII characters other than letters separate words and are
one space.

The sample takes rows with a language, outside the held-out ids, of at most ``TRAIN_BYTES`` bytes, and
about ``TRAIN_DOCS`` of each language; fewer where the languages are so many that the whole would pass
``SAMPLE_BYTES``.  A hash of the text chooses, and equal texts of a language count once, so neither a hot id nor
a hot text makes it larger.  More than ``LANGUAGES`` different labels are refused.

The pipeline's stage rejects what is ``und``, and text that no learned language explains: if ``NONE_BITS`` for
each byte make a code that is shorter than the best language's by more than ``NONE_PRIOR`` bits.

Defined cases: null text or text without a letter is ``und`` with score 0; without any labelled row
all texts are ``und``; a null id is never held out; repeated rows give repeated rows; an empty table
gives no rows; further columns are not read, and a stage keeps them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import held_out as is_held_out
from doclathe.llm.common import ship, table

TRAIN_DOCS = 400
SAMPLE_BYTES = 32 << 20
TRAIN_BYTES = 20_000
LANGUAGES = 5000
ORDER = 3
MEMO_BYTES = 32 << 20
#: Bits a byte of a code for text in no language, and what must speak for it: letters at random cost over 6
#: bits a byte in every language, text in a known one 2 to 4.
NONE_BITS = 5.5
NONE_PRIOR = 60.0
UND = "und"
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_START = b" " * ORDER


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted ones are in sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """Frozen contexts of one language.  A byte string of n + 1 bytes is a number: n bytes of context, and a byte."""

    def __init__(self, texts: list[bytes]):
        s = np.frombuffer(_START.join([b"", *texts, b""]), np.uint8).astype(np.int64)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        code = np.zeros(len(s), np.int64)
        for k in range(ORDER + 1):
            code = s if k == 0 else (s[: len(s) - k] << 8 * k) + code[1:]
            strings, times = np.unique(code, return_counts=True)
            contexts, which = np.unique(strings >> 8, return_inverse=True)
            n, d = np.bincount(which, times), np.bincount(which)
            # Of the shorter context's probability, what is left for bytes not seen in this one.
            left = 1 - np.bincount(which, np.exp2(-self._bits(strings, k - 1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(left > 0, d, 0)
                unseen = -np.log2(escape / (n + escape) / left)
            self.orders.append((strings, -np.log2(times / (n + escape)[which]), contexts, unseen))

    def _bits(self, codes: np.ndarray, order: int) -> np.ndarray:
        if order < 0:
            return np.full(len(codes), 8.0)
        codes = codes & (1 << 8 * (order + 1)) - 1
        strings, bits, contexts, unseen = self.orders[order]
        at, seen = _at(strings, codes)
        out = bits[at]
        if not seen.all():
            rest = codes[~seen]
            at, known = _at(contexts, rest >> 8)
            out[~seen] = np.where(known, unseen[at], 0) + self._bits(rest, order - 1)
        return out

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string of ORDER + 1 bytes, given the ones before."""
        return self._bits(codes, ORDER)


class Model:
    """Frozen statistics.  sample: language -> normal texts."""

    def __init__(self, sample: dict[str, list[bytes]]):
        self.langs = sorted(sample)
        self.trees = [Tree(sample[x]) for x in self.langs]
        self.memo: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {"langs": self.langs, "trees": self.trees, "memo": None}

    def _fresh(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(codes) for t in self.trees], axis=1).astype(np.float32)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """A row for each string, a column for each language."""
        if self.memo is None:
            slots = 1 << max(10, (MEMO_BYTES // (4 * len(self.langs) + 8)).bit_length() - 1)
            self.memo = np.full(slots, -1), np.zeros((slots, len(self.langs)), np.float32)
        keys, rows = self.memo
        slot = (codes * 0x9E3779B1 >> 7) & len(keys) - 1
        miss = keys[slot] != codes
        out = rows[slot]
        if miss.any():
            new, back = np.unique(codes[miss], return_inverse=True)
            found = self._fresh(new)
            out[miss] = found[back]
            # Of strings that share a slot one is remembered.
            where, one = np.unique((new * 0x9E3779B1 >> 7) & len(keys) - 1, return_index=True)
            keys[where], rows[where] = new[one], found[one]
        return out

    def code_lengths(self, texts: Iterable[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        texts = list(texts)
        total = np.zeros((len(texts), len(self.langs)))
        most = max(1 << 10, (8 << 20) // (4 * max(1, len(self.langs))))  # bytes handled at once
        run: list[tuple[int, bytes]] = []
        size = 0
        for i, data in enumerate(texts if self.langs else ()):
            for at in range(0, len(data), most):
                # What comes before the part is its first context.
                part = (_START + data[:most]) if at == 0 else data[at - ORDER : at + most]
                run.append((i, part))
                size += len(part)
                if size >= most:
                    self._add(run, total)
                    run, size = [], 0
        if run:
            self._add(run, total)
        return total

    def _add(self, run: list[tuple[int, bytes]], total: np.ndarray) -> None:
        s = np.frombuffer(b"".join(part for _, part in run), np.uint8).astype(np.int64)
        starts = np.cumsum([0, *(len(part) for _, part in run[:-1])])
        code = s.copy()
        for k in range(1, ORDER + 1):
            code[k:] += s[:-k] << 8 * k
        given = np.ones(len(s), bool)
        for k in range(ORDER):
            given[starts + k] = False
        bits = self.bits(code[given])
        firsts = starts - ORDER * np.arange(len(run))
        sums = np.add.reduceat(bits, firsts, axis=0, dtype=np.float64)
        np.add.at(total, [i for i, _ in run], sums)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, posterior, bits a byte, and whether the language explains the text, of each text."""
        out: list[tuple[str, float, float, bool]] = [(UND, 0.0, 0.0, False)] * len(texts)
        able = [(i, data) for i, t in enumerate(texts) if has_letter(t) and (data := normal(t))] if self.langs else []
        for (i, data), bits in zip(able, self.code_lengths(data for _, data in able)):
            best = int(np.argmin(bits))
            score = 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()
            out[i] = self.langs[best], float(min(1.0, score)), float(bits[best] / len(data)), bool(bits[best] <= NONE_BITS * len(data) + NONE_PRIOR)
        return out


def train(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS, held_out: tuple[int, int] = (4, 2)) -> Model:
    """Learn from text and language of rows whose crc32(doc_id) modulo held_out[0] isn't held_out[1]."""
    able = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    able = able.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id", *held_out) & (F.octet_length("text") <= TRAIN_BYTES))
    counts = able.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different languages")
    if not counts:
        return Model({})
    million = 1_000_000
    share = SAMPLE_BYTES // len(counts)
    each = {r["lang"]: max(1, min(docs_per_lang, share * r["n"] // max(1, r["size"]))) for r in counts}
    parts = [(r["lang"], min(million, -(-each[r["lang"]] * million // r["n"]))) for r in counts]
    # A row for each language: at most LANGUAGES.
    chances = docs.sparkSession.createDataFrame(parts, "lang string, chance int")
    draw = F.pmod(F.xxhash64("text", F.lit("language sample")), F.lit(million))
    picked = able.join(F.broadcast(chances), "lang").filter(draw < F.col("chance"))
    sample: dict[str, list[bytes]] = {}
    for r in picked.select("lang", "text").distinct().collect():
        sample.setdefault(r["lang"], []).append(normal(r["text"]))
    return Model({x: sorted(texts) for x, texts in sample.items()})


_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))

    def batches(it):
        m = shared.value
        for b in it:
            found = m.predict(b.column(2).to_pylist())
            cols = [pa.array(c, t) for c, t in zip(list(zip(*found))[:3] if found else ((), (), ()), (pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def known_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows, with all their columns, whose text is in one of the learned languages."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))
    at = docs.columns.index("text")

    def batches(it):
        m = shared.value
        for b in it:
            keep = [lang != UND and known for lang, _, _, known in m.predict(b.column(at).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op2_ppm_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
