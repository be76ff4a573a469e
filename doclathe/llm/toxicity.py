"""Toxic spans and scores by a linear-chain conditional random field.

A chain of two states (clean, toxic) runs over the tokens of a document.  Its features are words, their
beginnings and ends.  Labels mark documents, so the tokens' labels are hidden: all tokens of a clean document
are clean, and at least one token of a toxic one is toxic.  The likelihood of just that is raised by gradient
ascent: a clean document asks for P(all clean), a toxic one for 1 - P(all clean).  Forward-backward gives the
probability of each token of being toxic, and P(all clean) as a product of conditional probabilities along the
chain.  A document's score is a logistic regression, fitted on the labels, on the odds of P(all clean), the
sum and the density of the tokens' certainties, and the largest marginal.  Runs of tokens with a marginal of
1/2 or more are the offending spans.

Forward-backward runs over all tokens of a batch at once: the tokens are laid out as rows, the 2 x 2
transfer matrices of each row are multiplied up for all rows together, and the rows' messages are then
carried from one to the next; a document's first token forgets what came before.

Labels are learned from a bounded sample, about ``TRAIN_DOCS`` labelled documents of each class, chosen
by a hash of the id, outside the held-out ids, of at most ``TRAIN_BYTES`` bytes.  Of its features those in
at least ``LEAST_DOCS`` different texts count, the ``FEATURES`` most frequent ones of toxic documents at most.

Defined cases: null and empty texts have no tokens and the score of a document without marginals;
without labels of both classes all scores are 0; a null id is never held out; a document labelled twice
is toxic if any label says so; of several texts with one labelled id only the least is learned from;
repeated rows give repeated rows; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import held_out as is_held_out
from doclathe.llm.common import ship, table

TRAIN_DOCS = 800
TRAIN_BYTES = 12_000
FEATURES = 40_000
LEAST_DOCS = 8
ENDS = (4, 6)
#: Weights are held near zero by this much, and no toxic document pulls at its tokens more than so many clean ones
#: push: documents that are labelled toxic without a reason in their words must not make one up.
RIDGE, PULL = 0.3, 2.0
#: Emissions cached by word in each worker.
CACHE = 200_000
_TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in ENDS if len(word) > k), *("*" + word[-k:] for k in ENDS if len(word) > k)]


def text_key(words: list[str]) -> int:
    """Equal for copies, and for most near copies: the least hash of the runs of three words."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))), default=0)


def _scan(m00, m01, m10, m11, start0, start1):
    """Normalised row vectors (start · M_1 · ... · M_t) for all t, over arrays of 2 x 2 matrices."""
    n = len(m00)
    k = max(1, int(np.sqrt(n)))
    rows = -(-n // k)
    pad = rows * k - n
    grid = [np.concatenate([m, np.full(pad, d)]).reshape(rows, k).T.copy() for m, d in ((m00, 1.0), (m01, 0.0), (m10, 0.0), (m11, 1.0))]
    p00, p01, p10, p11 = (g[0].copy() for g in grid)
    for j in range(1, k):
        a, b, c, d = (g[j] for g in grid)
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        s = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * s, p01 * s, p10 * s, p11 * s
    v0, v1 = np.empty(rows), np.empty(rows)
    x, y = start0, start1
    for r, (a, b, c, d) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist())):
        v0[r], v1[r] = x, y
        x, y = x * a + y * c, x * b + y * d
        s = 1 / (x + y)
        x, y = x * s, y * s
    out0, out1 = np.empty((k, rows)), np.empty((k, rows))
    for j in range(k):
        a, b, c, d = (g[j] for g in grid)
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        s = 1 / (v0 + v1)
        v0, v1 = v0 * s, v1 * s
        out0[j], out1[j] = v0, v1
    return out0.T.ravel()[:n], out1.T.ravel()[:n]


class Chain:
    """Two states; start and transition weights; emissions are weights of state 1 against state 0."""

    def __init__(self, start: np.ndarray, step: np.ndarray):
        self.start, self.step = start, step

    def messages(self, emission: np.ndarray, first: np.ndarray):
        """Normalised forward and backward messages.  first: marks the first token of each document."""
        e = np.exp(np.clip(emission, -30, 30))
        t, s = np.exp(self.step), np.exp(self.start - self.start.max())
        s = s / s.sum()
        # Rows: from state 0, from state 1.  A first token takes the start weights whatever came before.
        m00, m01 = np.where(first, s[0], t[0, 0]), np.where(first, s[1], t[0, 1]) * e
        m10, m11 = np.where(first, s[0], t[1, 0]), np.where(first, s[1], t[1, 1]) * e
        f0, f1 = _scan(m00, m01, m10, m11, 0.5, 0.5)
        # Backward: beta_t = T (e_{t+1} beta_{t+1}), as a row vector times the transposed matrix, from the end.
        last = np.roll(first, -1)
        after = np.roll(e, -1)
        b00, b01 = np.where(last, 1.0, t[0, 0]), np.where(last, 1.0, t[1, 0])
        b10, b11 = np.where(last, 1.0, t[0, 1] * after), np.where(last, 1.0, t[1, 1] * after)
        r0, r1 = _scan(b00[::-1], b01[::-1], b10[::-1], b11[::-1], 0.5, 0.5)
        return f0, f1, r0[::-1], r1[::-1], e

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(emission):
            return np.zeros(0)
        f0, f1, b0, b1, _ = self.messages(emission, first)
        return f1 * b1 / (f0 * b0 + f1 * b1)

    def stay_clean(self, b0: np.ndarray, b1: np.ndarray, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each token of being clean, given that the one before is and the text.
        Their sum over a document is that of P(all clean)."""
        t, s = np.exp(self.step), np.exp(self.start - self.start.max())
        to0, to1 = np.where(first, s[0], t[0, 0]) * b0, np.where(first, s[1], t[0, 1]) * e * b1
        return -np.log1p(to1 / to0)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, chain: Chain, fit: np.ndarray):
        self.weights, self.bias, self.chain, self.fit = weights, bias, chain, fit
        self.cache: dict[str, float] = {}

    def emission(self, words: list[str]) -> np.ndarray:
        known, w, bias = self.cache, self.weights, self.bias
        if len(known) > CACHE:
            known.clear()
        out = np.empty(len(words))
        for i, x in enumerate(map(known.get, words)):
            if x is None:
                x = known[words[i]] = bias + sum(w.get(f, 0.0) for f in features(words[i]))
            out[i] = x
        return out

    def infer(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and stay_clean(), of all tokens."""
        if not len(emission):
            return np.zeros(0), np.zeros(0)
        f0, f1, b0, b1, e = self.chain.messages(emission, first)
        return f1 * b1 / (f0 * b0 + f1 * b1), self.chain.stay_clean(b0, b1, e, first)

    def score_batch(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Score and offending spans (code points) of each text."""
        lists = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        starts = np.cumsum(sizes) - sizes
        out: list[tuple[float, list[tuple[int, int]]]] = []
        emission = np.concatenate([self.emission(x) for x in lists]) if lists else np.zeros(0)
        first = np.zeros(len(emission), bool)
        first[starts[sizes > 0]] = True
        p, clean = self.infer(emission, first)
        for t, a, n in zip(texts, starts, sizes):
            own = p[a : a + n]
            z = float(document_features(own, float(clean[a : a + n].sum())) @ self.fit)
            spans: list[tuple[int, int]] = []
            if n and own.max() >= 0.5:
                low = t.lower()
                where = [m.span() for m in _TOKEN.finditer(low)] if len(low) == len(t) else _spans(t)
                if len(where) == n:
                    for i in np.flatnonzero(own >= 0.5):
                        s, e = where[i]
                        if spans and i and own[i - 1] >= 0.5:
                            spans[-1] = (spans[-1][0], e)
                        else:
                            spans.append((s, e))
            out.append((1 / (1 + np.exp(-np.clip(z, -500, 500))), spans))
        return out


def _spans(text: str) -> list[tuple[int, int]]:
    """Token spans where lower-casing changes the length: each lower-cased character keeps its source."""
    source = [i for i, c in enumerate(text) for _ in c.lower()]
    low = "".join(c.lower() for c in text)
    return [(source[m.start()], source[m.end() - 1] + 1) for m in _TOKEN.finditer(low)]


def document_features(p: np.ndarray, all_clean: float) -> np.ndarray:
    """all_clean: the logarithm of P(all clean)."""
    sure = float((p * p).sum())
    odds = np.log(max(-np.expm1(min(all_clean, 0.0)), 1e-12)) - max(all_clean, -30.0)
    return np.array([1.0, np.log1p(sure), np.log((sure + 0.05) / (len(p) + 10)), float(p.max(initial=0.0)), odds / 10])


def fit_model(texts: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = 60) -> Model:
    """weight: how many documents each stands for, so that scores follow the labels' own frequency."""
    words = [_TOKEN.findall(t.lower()) for t in texts]
    seen, groups = [Counter(), Counter()], set()
    for w, y in zip(words, toxic):
        if (key := (bool(y), text_key(w))) not in groups:  # copies of one text say one thing
            groups.add(key)
            seen[int(y)].update({f for x in set(w) for f in features(x)})
    able = [f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= LEAST_DOCS]
    chosen = sorted(able, key=lambda f: (-seen[1][f], -seen[0][f], f))[:FEATURES]
    d = len(chosen)
    number = {f: i for i, f in enumerate(chosen)}
    ids: dict[str, int] = {}
    for w in words:
        for x in w:
            ids.setdefault(x, len(ids))
    # Emissions are worked out by word: features of word i are feature[of == i].
    pairs = [(i, number[f]) for x, i in ids.items() for f in features(x) if f in number]
    of, feature = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    token = np.array([ids[x] for w in words for x in w], np.int64)
    sizes = np.array([len(w) for w in words])
    doc = np.repeat(np.arange(len(words)), sizes)
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    pair = ~first[1:]
    # Copies share one document's say.
    keys = [(bool(y), text_key(w)) for w, y in zip(words, toxic)]
    copies = Counter(keys)
    share = np.array([1 / copies[k] for k in keys])
    theta = np.zeros(d + 1 + 2 + 4)  # features, bias, start, transitions
    theta[d] = -6.0
    moment, square = np.zeros_like(theta), np.zeros_like(theta)

    def parts(x):
        return x[:d], x[d], Chain(np.array([0.0, x[d + 1]]), x[d + 3 :].reshape(2, 2) * np.array([[0, 1], [0, 1]]))

    def emissions(w, bias):
        return (bias + np.bincount(of, w[feature], minlength=len(ids)))[token]

    for r in range(rounds if len(token) else 0):
        w, bias, chain = parts(theta)
        f0, f1, b0, b1, e = chain.messages(emissions(w, bias), first)
        p = f1 * b1 / (f0 * b0 + f1 * b1)
        clean = np.bincount(doc, chain.stay_clean(b0, b1, e, first), minlength=len(words))
        # The gradient of either class is a multiple of the expected features, as the all-clean path has none.
        pull = np.where(toxic, np.exp(np.maximum(clean, -30)) / np.maximum(-np.expm1(clean), 1e-12), -1.0) * share
        pull = np.minimum(pull, PULL)
        each = pull[doc]
        t = np.exp(chain.step)
        x = [[f[:-1] * t[i, j] * (e[1:] if j else 1.0) * b[1:] for j, b in enumerate((b0, b1))] for i, f in enumerate((f0, f1))]
        z = x[0][0] + x[0][1] + x[1][0] + x[1][1]
        grad = np.zeros_like(theta)
        expected = each * p
        grad[:d] = np.bincount(feature, np.bincount(token, expected, minlength=len(ids))[of], minlength=d) - RIDGE * w
        grad[d] = expected.sum()
        grad[d + 1] = expected[first].sum() - 0.01 * theta[d + 1]
        step = np.array([[(x[i][j] / z * each[1:])[pair].sum() for j in (0, 1)] for i in (0, 1)])
        grad[d + 3 :] = (step * np.array([[0, 1], [0, 1]])).ravel() - 0.01 * theta[d + 3 :]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        rate = 0.15 * min(1.0, 2.0 * (1 - r / rounds))
        theta = theta + rate * (moment / (1 - 0.9 ** (r + 1))) / (np.sqrt(square / (1 - 0.99 ** (r + 1))) + 1e-8)
    w, bias, chain = parts(theta)
    model = Model({f: float(w[i]) for f, i in number.items() if w[i]}, float(bias), chain, np.zeros(5))
    p, clean = model.infer(emissions(w, bias), first)
    ends = np.cumsum(sizes)
    rows = np.array([document_features(p[e - s : e], float(clean[e - s : e].sum())) for s, e in zip(sizes, ends)])
    model.fit = logistic(rows, toxic.astype(float), weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty @ beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = TRAIN_DOCS, held_out: tuple[int, int] = (5, 0)) -> Model | None:
    """None if there are no labels of both classes."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_id is not null and _toxic is not null")
    marks = marks.filter(~is_held_out("_id", *held_out)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    million = 1_000_000
    chance = {c: min(million, -(-docs_per_class * million // n)) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit("toxicity sample")), F.lit(million))
    picked = marks.filter(draw < F.when(F.col("_toxic") == 1, chance[1]).otherwise(chance[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    # About 2 * docs_per_class ids: as bounded as that parameter.
    sample = texts.filter(F.col("_text").isNotNull() & (F.octet_length("_text") <= TRAIN_BYTES)).join(F.broadcast(picked), "_id")
    rows = sorted(tuple(r) for r in sample.groupBy("_id", "_toxic").agg(F.min("_text")).collect())
    toxic = np.array([bool(r[1]) for r in rows])
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    weight = np.where(toxic, million / chance[1], million / chance[0])
    return fit_model([r[2] for r in rows], toxic, weight / weight.mean())


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", _SPAN)])


def _pieces(texts: list[str | None], most: int = 1 << 21):
    """Runs of texts of about so many characters, so that the arrays of one run stay small."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start and end of offending spans in code points)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def batches(it):
        m = shared.value
        for b in it:
            texts = b.column(2).to_pylist()
            found = [r for run in _pieces(texts) for r in m.score_batch(run)] if m else [(0.0, [])] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([float(s) for s, _ in found], pa.float64()),
                    pa.array([int(s >= 0.5) for s, _ in found], pa.int32()),
                    pa.array([[{"start": x, "end": y} for x, y in spans] for _, spans in found], _SPAN),
                ],
                schema=_ARROW,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long>>")


def op8_crf_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
