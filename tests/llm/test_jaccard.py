import random

import corpus_pipeline
import numpy as np
from tesserax.llm import jaccard

SF = "/root/testdata/sf0.01"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(rows):
    """Ids of the rows that stay, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if group[a] != group[b] and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def test_stage_keeps_one_of_planted_near_copies(spark):
    r = random.Random(5)
    rows = []
    for k in range(12):
        words = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(400)) for _ in range(120)]
        rows.append((10 * k, " ".join(words)))
        for n in range(1, 4):  # a chain: each is a near copy of the one before it
            words[r.randrange(5, 115)] = f"new{n}"
            words[0] = f"start{n}"
            rows.append((10 * k + n, " ".join(words)))
    rows += [(900, ""), (901, None), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, df, SF).collect())
    assert got == slow(rows) == [*range(0, 120, 10), 900, 903, 905]


def test_as_by_all_pairs_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert jaccard.keep_one(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_texts_that_are_not_near_enough(spark, monkeypatch):
    """Each pair shares about half, a few are near copies: rows that are compared exactly must not
    grow with all pairs, and no link may be lost."""
    r = random.Random(9)
    base = [f"w{r.randrange(20_000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(4 + i % 3):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words[:-1], "end"])))
    monkeypatch.setattr(jaccard, "MEMBERS", 32)
    compared = []
    real = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda s, g, pairs: compared.append(pairs.count()) or real(s, g, pairs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in jaccard.keep_one(spark, df).collect()) == slow(rows)
    assert compared[-1] * 5 < len(rows) * (len(rows) - 1) // 2


def test_links_pass_through_the_fingerprint_grid(spark, monkeypatch):
    """A long text with one changed word has a fingerprint within 2 bits: the grid finds it."""
    r = random.Random(2)
    words = [f"w{r.randrange(20_000)}" for _ in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, "another text of a few words only")]
    found = []
    real = jaccard._grid
    monkeypatch.setattr(jaccard, "_grid", lambda s, sets: found.append(real(s, sets).distinct().count()) or real(s, sets))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in jaccard.keep_one(spark, df).collect()) == [1, 3] and found == [1]


def test_only_pairs_that_may_be_near_copies_are_compared(spark, monkeypatch):
    """All pairs of a large group have about two thirds in common: neither rows nor whole sets grow with them."""
    r = random.Random(4)
    base = [f"w{r.randrange(20_000)}" for _ in range(150)]
    rows = [(2000 + i, " ".join(f"y{r.randrange(10**6)}" for _ in range(60))) for i in range(100)]
    for i in range(150):
        words = list(base)
        for at in r.sample(range(5, 145), 3):
            words[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words[:-1], "end"])))
    compared, whole = [], []
    verified, written = jaccard._verified, jaccard.materialize
    monkeypatch.setattr(jaccard, "_verified", lambda s, g, pairs: compared.append(pairs.count()) or verified(s, g, pairs))

    def note(s, df, name):
        made = written(s, df, name)
        if "grams" in made.columns:
            whole.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "materialize", note)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in jaccard.keep_one(spark, df).collect()) == slow(rows)
    assert 15 <= sum(compared) < len(rows) and 30 <= sum(whole) <= len(rows) - 90


def test_bit_maps_never_rule_out_what_sets_have_in_common():
    draw = np.random.default_rng(3)
    for m, n, k in [(1, 1, 1), (9, 11, 9), (500, 620, 480), (500, 520, 0), (63, 65, 60), (40_000, 36_000, 35_000), (0, 0, 0)]:
        values = draw.permutation(np.unique(draw.integers(0, 1 << 64, m + n, dtype=np.uint64)))
        x, y = values[:m], values[m - k : m - k + n]
        x_map, y_map = (np.frombuffer(jaccard.bit_map(v), np.uint8) for v in (x, y))
        top = jaccard.common(x_map, len(x), np.stack([y_map, y_map]), np.array([len(y)] * 2))
        assert len(np.intersect1d(x, y)) == k <= top[0] == top[1] and (m > 1000 or top[0] <= k + (m + n) // 10)


def test_among_is_false_only_for_what_the_values_lack(spark, monkeypatch):
    values = [-(1 << 63), (1 << 63) - 1, -1, 0, 7, 7, *range(10**6, 10**6 + 3000)]
    own = spark.createDataFrame([(v,) for v in values], "v long")
    for largest in (jaccard.LARGEST, jaccard.BUCKET):
        monkeypatch.setattr(jaccard, "LARGEST", largest)
        has = jaccard.among(own)
        assert own.where(has("v")).count() == len(values)
        assert spark.range(10**7, 10**7 + 9000).where(has("id")).count() <= 4500
    assert own.where(jaccard.among(own.limit(0))("v")).count() == 0
