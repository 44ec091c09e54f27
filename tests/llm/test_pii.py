import hashlib
import random
import re

from tesserax.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def slow(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(f, text or "", re.ASCII) if good(k, m[0])] for k, f in FORMS.items()}


def texts():
    rng = random.Random(8)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "a@b@c.d", "x@y..z@w.v", "@b.c", "a@b", "1.2.3.4", "256.1.1.1", "001.002.003.0004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "5500000000000004", "+1 (017) 555-7713", "+12", "+49 30 123456 78", "+1(((((2", "é", "ñ ", " ", "\n", ", ", "word ", "😀", "12", "0", "-", ".", "+", "%", "A1B2"]
    out = [None, "", "plain words only", "a@b.c.d+e@f.g", "+1 234 567 890 1.2.3.4@x.y"]
    out += ["".join(rng.choice(parts) for _ in range(rng.choice([3, 12, 60]))) for _ in range(250)]
    out += ["a" * 60_000 + "@", "1" * 60_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000, "x " * 50_000 + "a@b.c"]
    return out


def test_base_matches_slow_version(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.c"), (3, texts()[3])]
    df = spark.createDataFrame([(t, i, "z") for i, t in rows], "text string, doc_id long, email string")
    got = pii.digest(pii.entities(spark, df)).collect()
    want = []
    for i, t in rows:
        spans = slow(t)
        base = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in spans[k])
        want.append((str(i), *(len(spans[k]) for k in pii.KINDS), hashlib.sha256(base.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert pii.entities(spark, df.limit(0)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Please mail me at user{i}@example.com today") for i in range(8)]
    rows += [(20, "you can mail me at ID-7788-991x today"), (21, "Mail me at (000123456)!"), (22, "lot number of 7788991 and me at 55"), (23, "it was in 1234567 of them"), (24, "was in 7654321"), (25, "they saw it was in 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.added] for r in pii.entities(spark, df).collect()}
    assert {i for i, v in got.items() if v} == {20, 21}
    text = dict(rows)
    assert [text[20][s:e] for s, e in got[20]] == ["ID-7788-991x"] and [text[21][s:e] for s, e in got[21]] == ["000123456"]
