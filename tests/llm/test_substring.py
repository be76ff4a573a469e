import random
import re

import xxhash

from doclathe.llm import substring

SF = "/root/testdata/sf0.001"


def plain_cuts(words):
    h = [xxhash.xxh32_intdigest(w.encode(), 7) for w in words]
    pair = [((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1) >> 20 for a, b in zip(h, h[1:])]
    r = substring.REACH
    return {i + 1 for i in range(r, len(pair) - r) if all(pair[i] < pair[j] for j in range(i - r, i + r + 1) if j != i)}


def plain_units(text):
    """(first word, end word, number of the piece or -1, whole line) of each unit, and the words with their spans."""
    spans, lines, at = [], [], 0
    for line in re.split(r"[\n\r]", text or ""):
        found = [(at + m.start(), at + m.end()) for m in re.finditer(r"\S+", line)]
        if found:
            lines.append((len(spans), len(spans) + len(found)))
        spans += found
        at += len(line) + 1
    words = [text[a:b].lower() for a, b in spans]
    cut, out, n = plain_cuts(words), [], 0
    for a, b in lines:
        edges = [a, *sorted(c for c in cut if a < c < b), b]
        if len(edges) > 2:
            out.append((a, b, -1, True))
        for x, y in zip(edges, edges[1:]):
            out.append((x, y, n, len(edges) == 2))
            n += 1
    return words, spans, out


def plain_removals(docs):
    seen, out = {}, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words, spans, found = plain_units(text)
        again = []
        for a, b, n, whole in sorted(found):
            key, here = " ".join(words[a:b]), (spans[a][0], spans[b - 1][1])
            if key in seen:
                again.append((a, b, n, whole, here, seen[key]))
            else:
                seen[key] = (doc, here[0])
        runs, last = {}, None
        for a, b, n, *_ in sorted((x for x in again if x[2] >= 0), key=lambda x: x[2]):
            head = runs[last][0] if last is not None and n == last + 1 else n
            runs[n] = [head, 0]
            last = n
        size = {}
        for a, b, n, *_ in again:
            if n >= 0:
                size[runs[n][0]] = size.get(runs[n][0], 0) + b - a
        gone = [x for x in again if x[3]]
        for a, b, n, whole, here, kept in again:
            if whole or (size[runs[n][0]] >= substring.RUN_WORDS and not any(x[0] <= a and b <= x[1] for x in gone)):
                out.append((doc, *here, b - a, *kept))
    return sorted(out, key=str)


def removed(df):
    return sorted((tuple(r) for r in substring.removals(df).collect()), key=str)


def test_whole_table_against_plain_python(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = removed(df)
    assert got == plain_removals(docs) and got
    text = dict(docs)
    for r in substring.deduplicated(df).collect():
        want, at = "", 0
        for a, b in sorted({(x[1], x[2]) for x in got if x[0] == r.doc_id}):
            want += text[r.doc_id][at:a]
            at = b
        want += text[r.doc_id][at:]
        assert r.text == want
        for i in range(0, len(want), 97):
            assert text[r.doc_id][substring.source_offset([tuple(x) for x in r.removed], i)] == want[i]


def test_word_spans():
    for text in ("", " ", "a", " a bc　d \x1c e ", "é 漢字\n 😀x\r\n"):
        starts, ends, breaks = substring.word_spans(text)
        assert list(zip(starts, ends)) == [m.span() for m in re.finditer(r"\S+", text)]
        assert list(breaks) == [i for i, c in enumerate(text) if c in "\n\r"]


def test_covered_share_of_passages_inside_other_text(spark):
    """Passages at any place of a line, or over two lines: all are found, and most of their words removed."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    for n, share in ((51, 0.75), (60, 0.8), (200, 0.93)):
        docs, where = [], {}
        for i in range(120):
            passage = rng.choices(words, k=n)
            if i % 2:  # a line break inside
                passage.insert(rng.randrange(1, n), "\n")
            for d in (2 * i, 2 * i + 1):
                before = " ".join(rng.choices(words, k=rng.randint(0, 90)))
                body = " ".join(passage)
                docs.append((d, before + rng.choice("\n ") + body + rng.choice("\n ") + " ".join(rng.choices(words, k=rng.randint(0, 90)))))
                where[d] = (len(before) + 1, len(before) + 1 + len(body))
        got = {}
        for d, a, b, k, *_ in removed(spark.createDataFrame(docs, "doc_id long, text string")):
            assert where[d][0] <= a and b <= where[d][1]
            got[d] = got.get(d, 0) + k
        assert set(got) == {2 * i + 1 for i in range(120)}
        assert sum(got.values()) >= share * 120 * n


def test_short_lines_and_lines_with_a_word_more(spark):
    line = " ".join(f"v{i}" for i in range(40))
    docs = [(1, f"Les.\n{line}"), (2, f"les.\n{line} more"), (3, "other\nles.")]
    got = removed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert (2, 0, 4, 1, 1, 0) in got and (3, 6, 10, 1, 1, 0) in got
    assert sum(k for d, *_, k, _, _ in got if d == 2) >= 1 + 28


def test_cases(spark):
    line = "one two three four five six seven eight"
    docs = [(3, line, "x"), (2, f"  {line.upper()} \r\nother\n{line}", None), (4, None, "x"), (5, "", "x"), (6, "a b c\na b c", "x"), (None, line, "x"), (8, ("x" * 50 + " ") * 3000, "x"), (9, "no repeats in this rather short line", "x"), (9, "no repeats in this rather short line", "x"), (None, line, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string")
    got = removed(df)
    want = [(3, 0, 39, 8, None, 0), (2, 2, 41, 8, None, 0), (2, 50, 89, 8, None, 0), (6, 6, 11, 3, 6, 0), (9, 0, 36, 7, 9, 0), (None, 0, 39, 8, None, 0)]
    assert got == sorted(want, key=str)
    texts = sorted((r.doc_id, r.text) for r in substring.deduplicated(df).collect() if r.doc_id is not None and r.text is not None)
    assert [t for d, t in texts if d == 3] == [""] and [t for d, t in texts if d == 2] == ["   \r\nother\n"] and [t for d, t in texts if d == 9] == ["", docs[7][1]]
    assert sorted(r.text for r in substring.deduplicated(df).collect() if r.doc_id is None) == ["", line]
    assert substring.removals(df.limit(0)).collect() == []


def test_finished_shuffles_are_freed_and_repeats_dealt_once(spark):
    """No shuffle file of the grouping is left once its result is written, and the windows share one shuffle."""
    import time

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    docs = spark.createDataFrame([(i, f"the same line of all\nand one of document {i}") for i in range(200)], "doc_id long, text string").repartition(3)
    docs = substring.scratch(docs, free=True)
    before = files()
    found = substring.removals(docs)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(row#", plan)) == 1
    assert sorted(r.doc_id for r in found.collect()) == list(range(1, 200))
