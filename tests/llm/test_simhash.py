import random

import xxhash

from tesserax.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return fps, group


def slow_components(rows):
    fps, group = slow_groups(rows)
    ids = [min((rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return sorted(((r[0], f, c) for r, f, c in zip(rows, fps, ids)), key=str)


def corpus():
    rng = random.Random(5)
    words = [f"wörd{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (None, "a b"), (7, "Ünïcode stays ÀB one")]
    for i in range(10, 40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        rows.append((i, " ".join(base)))
        for k in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            rows.append((i * 100 + k, " ".join(near)))
    rows += [(7, "seven again is another text"), (39, rows[-1][1]), (39, rows[-1][1])]
    rows.append((99, " ".join(rng.choice(words) for _ in range(70_000))))
    return rows


def test_matches_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark, df).collect()), key=str)
    assert got == slow_components(rows)


def test_full_cells_and_wide_segments_lose_nothing(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(250):
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    points = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = {frozenset((x, y)) for x in fps for y in fps if x < y and bin(x ^ y).count("1") <= 2}
    for bits, limit in ((1, 64), (2, 64), (2, 3), (4, 64), (4, 5)):
        found = {frozenset((r.src % (1 << 64), r.dst % (1 << 64))) for r in simhash.links(points, bits=bits, cell_limit=limit).collect()}
        assert found == want, (bits, limit)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(spark, df).count() == 0
    assert simhash.keep_one(spark, df).count() == 0


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, n int")
    kept = simhash.keep_one(spark, df)
    assert kept.columns == ["text", "doc_id", "n"]
    fps, group = slow_groups(rows)
    first = {}
    for g, (i, _) in zip(group, rows):
        first[g] = min(first.get(g, 1 << 62), 1 << 62 if i is None else i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
