import random
import zlib
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tesserax.llm import toxicity as tox


def slow_map(word):
    out = defaultdict(float)
    for at in combinations(range(len(word)), tox.LENGTH):
        key = "".join(word[i] for i in at)
        if all(c.isalnum() for c in key):
            out[key] += tox.DECAY ** (at[-1] - at[0] + 1)
    return out


def slow_kernel(a, b):
    fa, fb = slow_map(a), slow_map(b)
    dot = lambda x, y: sum(v * y[k] for k, v in x.items() if k in y)
    norm = (dot(fa, fa) * dot(fb, fb)) ** 0.5
    return dot(fa, fb) / norm if norm else 0.0


def test_kernel_matches_slow_version():
    words = ["idiot", "id1ot", "i.d.i.o.t", "aaaa", "abcabcabc", "ñandú", "!!!", "abc", "idiotic" * 2]
    got = tox.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(slow_kernel(a, b), abs=1e-5)
    assert got[0, 1] > 0.3 and got[0, 2] > 0.5 and got[0, 8] > 0.4


def test_strings():
    assert tox.strings("You, i d i o t! (Ab) (abc) x y") == ["you", "idiot", "abc"]
    assert tox.strings("") == []
    assert tox.strings("i . d * i - o ... t") == ["idiot"] and tox.strings("... a ? b") == []
    assert "".join(dict.fromkeys("".join(tox.strings("abcdefghij" * 5)))) == "abcdefghij"


def corpus(n=1200):
    rng = random.Random(3)
    syllables = ["re", "tion", "er", "the", "ing", "sh", "ou", "ble", "an", "ti", "es", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3])))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([8, 40, 200]))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "clown", "worthless"])
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus()
    odd = [(9001, None), (9002, ""), (9003, "!!! ..."), (None, "an idiot ran"), (9004, "the "  * 200_000 + "idiot"), (9005, "the i d i o t er"), (9006, "ti w.orthless es"), (9007, "er mo-ron nd")]
    docs = spark.createDataFrame([(t, i, 0.5) for i, t, _ in rows] + [(t, i, 0.5) for i, t in odd], "text string, doc_id long, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = tox.train(spark, docs, labels)
    got = {r.doc_id: r for r in tox.score(spark, docs, model).collect()}
    assert len(got) == len(rows) + len(odd)
    test = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert [got[i].predicted for i in (9001, 9002, 9003, None, 9004)] == [0, 0, 0, 1, 1]
    assert [got[i].predicted for i in (9005, 9006, 9007)] == [1, 1, 1]
    assert all(0 <= r.score <= 1 for r in got.values())
    held = docs.select("doc_id", tox.held_out(docs.doc_id).alias("h")).where("doc_id is not null").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_other_scripts_and_null_ids(spark):
    rows = [(t.replace("idiot", "\u0434\u0443\u0440\u0430\u043a\u0438").replace("moron", "\u03b7\u03bb\u03af\u03b8\u03b9\u03bf\u03c2"), i, y) for i, t, y in corpus()]
    docs = spark.createDataFrame([r[:2] for r in rows] + [("er \u0434\u0443.\u0440\u0430-\u043a\u0438 the", None)], "text string, doc_id long")
    model = tox.train(spark, docs, spark.createDataFrame([r[1:] for r in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in tox.score(spark, docs, model).collect()}
    test = [(got[i], y) for _, i, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in test) / len(test) > 0.95 and got[None] == 1
    assert docs.where("doc_id is null").select(tox.held_out(docs.doc_id).alias("h")).first().h is False


def test_one_sided_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a word here"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1), (2, 1)]):
        model = tox.train(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert tox.score(spark, docs, model).count() == 2
    assert tox.score(spark, docs.limit(0), model).count() == 0


def test_a_long_labelled_text_leaves_the_others_in_the_sample(spark):
    ids = [r.id for r in spark.range(100).where(~tox.held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(40).collect()]
    rows = [(i, f"you idiot {i}" if n % 2 else f"a calm day {i}", n % 2) for n, i in enumerate(ids)]
    rows[1] = (ids[1], "you idiot " * 300, 1)  # the first of its label

    def same(rows, want):
        got = tox.train(spark, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), max_chars=2000)
        want = tox.fit([t for _, t, _ in sorted(want)], [y for _, _, y in sorted(want)])
        return got.weights.tobytes() == want.weights.tobytes() and got.bias == want.bias

    assert same(rows, rows[:1] + rows[2:])
    alone = [r for r in rows if not r[2]] + [rows[1]]
    assert same(alone, alone[:-1] + [(ids[1], rows[1][1][:2000], 1)])
