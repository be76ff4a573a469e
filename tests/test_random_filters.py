"""Random filters against a small evaluator in plain Python, all in one job."""

import random

import doclathe as dl
from doclathe.functions.paths import Scope
from doclathe.functions.values import sure
from doclathe.operators.predicate import compile_filter

OPS = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def get(doc, path):
    for n in path.split("."):
        if not isinstance(doc, dict) or n not in doc:
            return None, False
        doc = doc[n]
    return doc, True


def same_class(a, b):
    return isinstance(a, str) == isinstance(b, str)


def equal(v, x):
    return any(equal(e, x) for e in v) or v == x if isinstance(v, list) else v == x and v is not None


def test_cond(v, there, cond):
    if not isinstance(cond, dict):
        return there and v is None if cond is None else equal(v, cond)
    return all(one(v, there, op, x) for op, x in cond.items())


test_cond.__test__ = False


def one(v, there, op, x):
    if op == "$eq":
        return test_cond(v, there, x)
    if op == "$ne":
        return True if isinstance(v, list) else not test_cond(v, there, x)
    if op in OPS:
        return any(OPS[op](e, x) for e in (v if isinstance(v, list) else [v]) if e is not None and same_class(e, x))
    if op == "$in":
        return any(test_cond(v, there, i) for i in x)
    if op == "$nin":
        return isinstance(v, list) or not any(test_cond(v, there, i) for i in x)
    if op == "$exists":
        return there == x
    if op == "$not":
        return not test_cond(v, there, x)
    if op == "$size":
        return isinstance(v, list) and len(v) == x
    if op == "$all":
        return isinstance(v, list) and all(i in v for i in x)
    if op == "$elemMatch":
        return isinstance(v, list) and any(test_cond(e, True, x) for e in v)
    if op == "$mod":
        return isinstance(v, int) and v is not None and abs(v) % x[0] * (1 if v >= 0 else -1) == x[1]
    raise AssertionError(op)


def evaluate(doc, query):
    for k, c in query.items():
        if k == "$and":
            ok = all(evaluate(doc, q) for q in c)
        elif k == "$or":
            ok = any(evaluate(doc, q) for q in c)
        elif k == "$nor":
            ok = not any(evaluate(doc, q) for q in c)
        else:
            ok = test_cond(*get(doc, k), c)
        if not ok:
            return False
    return True


def random_filter(rng, depth=2):
    if depth and rng.random() < 0.4:
        return {rng.choice(["$and", "$or", "$nor"]): [random_filter(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    path = rng.choice(["a", "b", "o.p", "o.q", "t", "w"])
    num, text = (lambda: rng.randint(-3, 6)), (lambda: rng.choice("uvxyz"))
    value = text if path in ("b", "o.q", "w") else num
    if rng.random() < 0.1:
        value = num if value is text else text
    kind = rng.choice(["", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not", "range", *(["$size", "$all", "$elemMatch"] if path in ("t", "w") else ["$mod"] if path in ("a", "o.p") else [])])
    if kind == "":
        return {path: value() if rng.random() < 0.85 or path in ("t", "w") else None}
    if kind == "range":
        return {path: {"$gte": value(), "$lt": value()}}
    operand = {
        "$in": lambda: [value() for _ in range(3)], "$nin": lambda: [value() for _ in range(3)], "$exists": lambda: rng.random() < 0.5, "$not": lambda: {"$gt": value()},
        "$size": lambda: rng.randint(0, 3), "$all": lambda: [value() for _ in range(rng.randint(0, 2))], "$elemMatch": lambda: {"$gte": value(), "$lt": value()}, "$mod": lambda: [3, rng.randint(-2, 2)],
    }.get(kind, value)
    return {path: {kind: operand()}}


def random_doc(rng, i):
    doc = {"_id": i}
    for k, f in (("a", lambda: rng.randint(-3, 6)), ("b", lambda: rng.choice("uvxyz"))):
        if rng.random() < 0.8:
            doc[k] = None if rng.random() < 0.2 else f()
    if rng.random() < 0.8:
        doc["o"] = {k: v for k, v in (("p", rng.randint(-3, 6)), ("q", rng.choice("uvxyz"))) if rng.random() < 0.8}
    for k, f in (("t", lambda: rng.randint(-3, 6)), ("w", lambda: rng.choice("uvxyz"))):
        if rng.random() < 0.8:
            doc[k] = [f() for _ in range(rng.randint(0, 3))]
    return doc


def test_random_filters(spark):
    rng = random.Random(11)
    docs = [random_doc(rng, i) for i in range(120)]
    filters = [random_filter(rng) for _ in range(250)]
    df = dl.from_dicts(spark, docs, presence=True).cache()
    scope = Scope.of(df)
    for at in range(0, len(filters), 50):
        part = filters[at : at + 50]
        rows = df.select("_id", *(sure(compile_filter(q, scope)).alias(f"f{i}") for i, q in enumerate(part))).collect()
        for i, q in enumerate(part):
            assert {r["_id"] for r in rows if r[f"f{i}"]} == {d["_id"] for d in docs if evaluate(d, q)}, q
