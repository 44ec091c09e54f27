import hashlib
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserax.llm import mixing

WEIGHTS = {"domain": {"d0": 2, "d1": 5}, "lang": {"en": 7, "de": 2}, "source": {"s1": 3}}


def share(budget, children, weights):
    """Whole tokens of each child: fill those below their share, again and again."""
    order = sorted(children, key=lambda c: (children[c] / weights[c], c))
    budget = min(budget, sum(children.values()))
    got, open_ = {}, list(order)
    while True:
        rate = Fraction(budget - sum(got.values()), sum(weights[c] for c in open_) or 1)
        full = [c for c in open_ if children[c] <= rate * weights[c]]
        if not full:
            break
        got |= {c: children[c] for c in full}
        open_ = [c for c in open_ if c not in full]
    left, total = budget - sum(got.values()), sum(weights[c] for c in open_)
    parts = {c: left * weights[c] // total for c in open_}
    rest = left - sum(parts.values())
    return got | {c: parts[c] + (i < rest) for i, c in enumerate(open_)}


def slow(rows, percent, epochs, weights, seed):
    words = lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
    name = lambda x: "(none)" if x is None else x
    dom = lambda s: (lambda m: f"d{int(m[1]) % 4}" if m else "(none)")(re.search(r"([0-9]{1,9})$", name(s)))
    leaves = {}
    for i, t, lang, s in rows:
        leaves.setdefault((dom(s), name(lang), name(s)), []).append((i, t, words(t)))
    cap = {k: epochs * sum(x[2] for x in v) for k, v in leaves.items()}
    budgets = {(): sum(cap.values()) // epochs * percent // 100}
    for depth, level in enumerate(mixing.LEVELS):
        nxt = {}
        for node, b in budgets.items():
            kids = {}
            for k, c in cap.items():
                if k[:depth] == node:
                    kids[k[depth]] = kids.get(k[depth], 0) + c
            nxt |= {(*node, c): v for c, v in share(b, kids, {c: weights[level].get(c, 1) for c in kids}).items()}
        budgets = nxt
    out = []
    for k, docs in leaves.items():
        total = sum(d[2] for d in docs)
        whole, part = divmod(budgets[k], total) if total else (0, 0)
        for e in range(whole):
            out += [(d[0], *k, e, d[2]) for d in docs]
        place = lambda d: (int(hashlib.md5(f"{seed}/{whole}/{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16), d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).hexdigest())  # noqa: E731, B023
        end = 0
        for d in sorted(docs, key=place):
            end += d[2]
            if end <= part and whole < epochs:
                out.append((d[0], *k, whole, d[2]))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 30, 200])), rng.choice(["en", "en", "de", "fr"]), rng.choice(["s0", "s0", "s0", "s1", "s2", "s13", "x"])) for i in range(400)]
    rows += [(None, "a b c", None, None), (5, None, "en", "s1"), (6, "", "en", None), (7, " \t\n\x0b\f", "de", "s2"), (8, "x " * 5000, "de", "s1"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("percent,epochs", [(50, 2), (100, 1), (160, 2), (7, 3), (0, 1)])
def test_matches_slow_version(spark, monkeypatch, percent, epochs):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = corpus()
    df = spark.createDataFrame([(t, s, i, lang, 1) for i, t, lang, s in rows], "text string, source string, doc_id long, lang string, domain int")
    got = mixing.mix(spark, df, percent, epochs, WEIGHTS, 3)
    assert sorted((tuple(r) for r in got.select("row.doc_id", "domain", "lang", "source", "epoch", "tokens").collect()), key=str) == slow(rows, percent, epochs, WEIGHTS, 3)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    sql = con.sql(mixing.oracle_sql(percent, epochs, WEIGHTS, 3)).fetchall()
    assert sorted(map(tuple, sql), key=str) == slow(rows, percent, epochs, WEIGHTS, 3)


def test_shortage_stays_among_siblings(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)], "domain string, lang string, source string, capacity long")
    got = {r.source: r.allotted for r in mixing.allot(leaves, F.lit(800).cast("long"), {}).collect()}
    assert got == {"1": 10, "2": 190, "3": 200, "4": 400}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(spark, df).count() == 0
