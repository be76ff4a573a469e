import hashlib
import random
import re

import pytest

from doclathe.llm import licenses, pii

SF = "/root/testdata/sf0.001"
CASES = [(1, None, "x"), (2, "", None), (2, "", None), (3, "!!!", "x"), (None, "Apache LICENSE a@b.co " * 3000, "x")]


def plain_notices(text):
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    places = sorted((i, label) for p, label in licenses.BASE.items() for n in [len(p.split())] for i in range(len(words) - n + 1) if words[i : i + n] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [
        "Cc by cc BY, MIT--License\x00gnu/general\npublic_license é cc by", "xcc by cc byx mit licensé mit license", "a" * 5000, "\x7f\x7b cc\x2fby\x3a",
    ]


def test_base_places_against_plain_search(spark):
    for t in texts(spark):
        r = licenses.scan(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_notices(t), t[:80]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_near_notices_are_found_within_the_bound():
    rng = random.Random(3)
    for phrase, (label, k) in licenses.MORE.items():
        for _ in range(60):
            s = list(phrase)
            for _ in range(rng.randint(0, k)):
                i = rng.randrange(1, len(s) - 1)
                kind = rng.choice("ids")
                if kind == "d":
                    del s[i]
                elif kind == "i":
                    s.insert(i, rng.choice("abcxyz"))
                else:
                    s[i] = rng.choice("abcxyz")
            assert label in licenses.scan(f"Some words before {''.join(s)} and after.")["labels"].split(","), (phrase, "".join(s))
    r = licenses.scan("the Apachee Licence of")
    assert r["labels"] == "" and licenses.scan("the Apache Licence of")["labels"] == "apache"
    assert licenses.scan("the Apache Licence of")["spans"] == [(1, 3, "apache", 1)]
    assert licenses.scan("nothing to see, ordinary words licensed to none")["labels"] == ""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def slow_matches(edged, phrase, k):
    """Start -> edits, by the distance of the phrase to every run of whole words."""
    gaps = [i for i, c in enumerate(edged) if c == 0x20]
    out = {}
    for i, g in enumerate(gaps):
        ends = [b for b in gaps[i + 1 :] if abs(b - g - 1 - len(phrase)) <= k]
        d = min((distance(edged[g + 1 : b], phrase.encode()) for b in ends), default=k + 1)
        if d <= k:
            out[g + 1] = d
    return out


def edited(rng, phrase, n, letters):
    s = list(phrase)
    for _ in range(n):
        kind, i = rng.choice("ids"), rng.randrange(len(s) + 1)
        if kind == "i" or i == len(s):
            s.insert(i, rng.choice(letters))
        elif kind == "d":
            del s[i]
        else:
            s[i] = rng.choice(letters)
    return "".join(s)


def test_near_matches_against_every_run_of_words():
    rng = random.Random(11)
    for phrase, (_, k) in licenses.MORE.items():
        found = 0
        for _ in range(40):
            parts = [edited(rng, phrase, rng.randint(0, k + 1), "aeilnst ") for _ in range(rng.randint(1, 4))]
            parts += rng.choices(phrase.split(), k=rng.randint(0, 5))
            rng.shuffle(parts)
            edged = f" {' '.join(' '.join(parts).split())} ".encode()
            got = licenses.matches(edged, phrase, k)
            assert {a: e for e, a, _ in got} == slow_matches(edged, phrase, k), (phrase, edged)
            assert all(distance(edged[a:b], phrase.encode()) == e and edged[a - 1 : a] == edged[b : b + 1] == b" " for e, a, b in got)
            kept = licenses.apart(got, len(phrase) + k)
            want = []
            for e, a, b in got:
                if all(b <= c or d <= a for _, c, d in want):
                    want.append((e, a, b))
            assert kept == want
            found += len(got)
        assert found


def test_labels_score_and_spans_of_all_notices():
    assert licenses.scan("mit licence mit license")["spans"] == [(0, 2, "mit", 1), (2, 4, "mit", 0)]
    r = licenses.scan("x apache licence, gnu generel public license")
    assert r["labels"] == "apache,gpl" and r["n_base"] == 0 and r["score"] == max(1 - 1 / 14, 1 - 1 / 26)


def test_long_texts_of_near_misses_take_linear_time():
    import time

    took = []
    for n in (10_000, 100_000):
        at = time.perf_counter()
        assert len(licenses.scan("mit licence " * n)["spans"]) == n
        took.append(time.perf_counter() - at)
    assert took[1] < 40 * took[0] and took[1] < 60
    assert licenses.scan("a" * 1_000_000 + "mit licence " + "b" * 1_000_000)["labels"] == ""


def test_license_rows(spark):
    rows = licenses.notices(spark.createDataFrame(CASES, "doc_id long, text string, labels string")).collect()
    assert len(rows) == 5 and {r.n_base for r in rows} == {0, 3000}
    assert all(r.score == 0 and r.labels == "" and r.first_word is None for r in rows if not r.n_base)
    assert licenses.notices(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_pii(text):
    text = text or ""
    emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0]
    phones = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(4)
    noise = ["".join(rng.choice("a1.@+ -()%2") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    noise += ["".join(rng.choice("0123456789 -.") for _ in range(40)) for _ in range(3000)]
    for t in texts(spark) + noise:
        assert pii.find(t)[0] == plain_pii(t), t


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("é write to john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("x mail jane at example dot org.", "email", "jane at example dot org"),
        ("é jоhn@exаmple.com ", "email", "jоhn@exаmple.com"),
        ("call ＋１ (２０２) ５５５-０１４３ ok", "phone", "＋１ (２０２) ５５５-０１４３"),
        ("call plus one two oh two five five five oh one four three!", "phone", "plus one two oh two five five five oh one four three"),
        ("card four one one one 1111 1111 1111 x", "card", "four one one one 1111 1111 1111"),
        ("at 10[.]0[.]0[.]7 there", "ip", "10[.]0[.]0[.]7"),
        ("so jane at example.com wrote", "email", "jane at example.com"),
        ("so jane at example [dot] test wrote", "email", "jane at example [dot] test"),
        ("a @ b, me​@exam​ple.com", "email", "me​@exam​ple.com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    base, spans = pii.find(text)
    at = text.index(part)
    assert (at, at + len(part)) in spans[kind], (spans, (at, at + len(part)), [text[a:b] for a, b in spans[kind]])
    for k in pii.KINDS:
        assert set(base[k]) <= set(spans[k])


def test_rewrites_keep_every_character_s_source():
    """Chains of edits against one source span for each character."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(0, 30)
        m, slow = pii.Mapped("".join(rng.choice("ab ") for _ in range(n))), [(i, i + 1, False) for i in range(n)]
        for _ in range(rng.randint(1, 4)):
            edits, at = [], 0
            while at < len(m.text):
                a = at + rng.randint(0, 4)
                b = a + rng.randint(1, 3)
                if b > len(m.text):
                    break
                edits.append((a, b, rng.choice(["", "x", "yz"])))
                at = b + rng.randint(0, 2)
            new, last = [], 0
            for a, b, x in edits:
                new += slow[last:a] + [(slow[a][0], slow[b - 1][1], True)] * len(x)
                last = b
            if any(not x for *_, x in edits):  # what goes leaves no character; its neighbours are compared below
                new = None
            text = "".join(p for i, (a, b, x) in enumerate(edits) for p in (m.text[edits[i - 1][1] if i else 0 : a], x)) + m.text[edits[-1][1] if edits else 0 :]
            m = m.rewrite(edits)
            assert m.text == text
            if new is None:
                break
            slow = new + slow[last:]
            for i, (a, b, touched) in enumerate(slow):
                assert m.touched(i, i + 1) == touched
                assert m.source(i, i + 1) == (a, b)


def test_planted_disguises_and_nothing_else():
    """Random identifiers, plain or disguised, between ordinary words: exactly their spans come back."""
    rng = random.Random(10)
    names = {v: k for k, v in reversed(pii.SPELLED.items()) if k.isascii()}
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() and rng.random() < 0.5 else c for c in s)
    like = {v: k for k, v in pii.LOOKALIKES.items()}

    def email():
        user, host, top = rng.choice(["jane", "j.doe", "x_1"]), rng.choice(["example", "mail-host"]), rng.choice(["com", "org"])
        return rng.choice([f"{user}@{host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user}(at){host}.{top}", f"{user} at {host} dot {top}", f"{user} at {host}.{top}", f"{user}@{host} dot {top}", wide(f"{user}@{host}.{top}"), f"{user}@{host}.{top}".replace("e", like["e"]), f"{user}@{host[:3]}\u200b{host[3:]}.{top}"])

    def phone():
        digits = "".join(rng.choice("123456789") for _ in range(11))
        return rng.choice([f"+{digits}", f"+{digits[:1]} ({digits[1:4]}) {digits[4:]}", wide(f"+{digits}"), "plus " + " ".join(names[d] for d in digits)])

    def ip():
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".".join(parts), "[.]".join(parts), " (dot) ".join(parts), wide(".".join(parts))])

    fill = "river stone quiet garden walks toward morning light".split()
    for _ in range(1500):
        text, want = "", {k: [] for k in pii.KINDS}
        for _ in range(rng.randint(0, 4)):
            text += " ".join(rng.choices(fill, k=rng.randint(2, 6))) + rng.choice([", ", "; ", "\n", " é: "])
            kind, made = rng.choice([("email", email), ("phone", phone), ("ip", ip)])
            part = made()
            want[kind].append((len(text), len(text) + len(part)))
            text += part + rng.choice([", ", "; ", "! "])
        assert pii.find(text)[1] == want, text
    for text in ("look at this.Then go", "we met at noon", "one two three", "the dot at the end."):
        assert not any(pii.find(text)[1].values())


def test_many_disguises_in_one_text():
    text = "me [at] exam\u200bple [dot] com, " * 20000
    assert len(pii.find(text)[1]["email"]) == 20000


def test_credentials():
    key = "cb1a9fee807a0536-6fcb8b6c"
    for before in ('token = "', "my_api_key=", "API Key:  ", "'password': '", "x\nsecret_key = ", "private-key'   = "):
        for text in (before + key + '" and', "y " * 50 + before + key):
            at = text.index(key)
            assert pii.secrets(text) == [(at, at + len(key))], text
    for text in ("", key, f"taken = {key}", f"token {key}", "token = " + key[:15], "password: correcthorsebatterystaple", f"token     = {key}"):
        assert pii.secrets(text) == [], text
    many = "=" * 50000 + " : token = " + "\t" * 50000 + key
    assert pii.secrets(many) == [(len(many) - len(key), len(many))]


def test_pii_rows(spark):
    rows = pii.identifiers(spark.createDataFrame(CASES, "doc_id long, text string, n_ip string")).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 0, 0, 3000]
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows if not r.n_email)
    assert all(r.secrets == "" and r.n_found == (r.spans.count(",") + 1 if r.spans else 0) for r in rows)
    (r,) = pii.identifiers(spark.createDataFrame([(1, "a@b.cc, a [at] b.cc, token = 0123456789abcdef")], "doc_id long, text string")).collect()
    assert (r.n_email, r.n_found, r.secrets) == (1, 3, "secret:29:45")
    assert pii.identifiers(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edits_in_the_first_letter_are_found():
    for text, label, edits in (("nit license", "mit", 1), ("it license", "mit", 1), ("emit license", "mit", 1), ("qnu general public license", "gpl", 1), ("nu general public license", "gpl", 1), ("ppache license", "apache", 1)):
        n = len(text.split())
        for before in ("", "some words before a "):
            at = len(before.split())
            assert (at, at + n, label, edits) in licenses.scan(f"{before}{text} and after")["spans"], (before, text)
