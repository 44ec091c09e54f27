import random
from collections import Counter

from pyspark.sql import functions as F

from tesserax.llm import packing


def slow(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(capacity - sum(p[0] for p in b) - size, i) for i, b in enumerate(bins) if sum(p[0] for p in b) + size <= capacity and all(p[1] != source and p[2] != cluster for p in b)]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([])
        out.append((i, sum(p[0] for p in bins[i])))
        bins[i].append((size, source, cluster))
    return out


def test_best_fit_matches_slow_version():
    rng = random.Random(1)
    for n, sources, clusters in ((200, 5, 30), (200, 1, 1), (300, 50, 1000), (0, 1, 1)):
        pieces = [(rng.randrange(0, 101), rng.randrange(sources) or None, rng.randrange(clusters)) for _ in range(n)]
        for p in (pieces, sorted(pieces, key=lambda x: -x[0])):
            assert packing.best_fit(p, 100) == slow(p, 100)


def test_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w%d" % rng.randrange(50)] * rng.choice([1, 5, 40, 90, 130])), rng.choice(["a", "a", "b", "c", None])) for i in range(500)]
    rows += [(None, "same text", "z"), (9001, "Same  TEXT", "y"), (9002, None, "q"), (9003, "", None), (9004, "x " * 50_000, "r"), ((1 << 62) + 1, "big id", "s"), rows[0], rows[0]]
    df = spark.createDataFrame([(s, t, i, 0) for i, t, s in rows], "source string, text string, doc_id long, bin int")
    got = packing.pack(spark, df, capacity=100, shard_rows=130).collect()
    source = {}
    for i, t, s in rows:
        source[i] = s
    want = Counter((i, p) for i, t, _ in rows for p in range(max(1, -(-len((t or "").split()) // 100))))
    assert Counter((r.doc_id, r.piece) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: (r["at"], r.tokens))
        assert sum(r.tokens for r in b) <= 100 and len({source[r.doc_id] for r in b}) == len(b)
        end = 0
        for r in b:
            assert r["at"] == end and r.start == r.piece * 100
            end += r.tokens
    assert len({n.split("-")[0] for n in bins}) == 4
    again = packing.pack(spark, df.orderBy(F.rand(3)).repartition(7), capacity=100, shard_rows=130).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert not any(packing.join_bins([(sum(r.tokens for r in b), [source[r.doc_id] for r in b], []) for b in bins.values()], 100)) or len(bins) > 130
    assert packing.pack(spark, df.limit(0)).count() == 0


def test_whole_operator_matches_slow_version(spark):
    rng = random.Random(12)
    texts = [" ".join(["w%d" % rng.randrange(9)] * rng.choice([0, 1, 3, 20, 60, 99, 100, 230])) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "a", "b", "c", "d", None])) for i in range(2000)]
    df = spark.createDataFrame([(s, t, i) for i, t, s in rows], "source string, text string, doc_id long")
    hashes = {r.doc_id: (r.c, r.th) for r in df.select("doc_id", packing.same_text(F.col("text")).alias("c"), F.xxhash64("text").alias("th")).collect()}
    pieces = []
    for i, t, s in rows:
        n = len(t.split())
        pieces += [(min(100, n - 100 * p), i, p, s, hashes[i][0]) for p in range(max(1, -(-n // 100)))]
    pieces.sort(key=lambda x: (-x[0], x[1], hashes[x[1]][1], x[2]))
    want = {(x[1], x[2]): place for x, place in zip(pieces, slow([(x[0], x[3], x[4]) for x in pieces], 100), strict=True)}
    got = packing.pack(spark, df, capacity=100).collect()
    assert {(r.doc_id, r.piece): (int(r.bin.split("-")[1]), r["at"]) for r in got} == want
    # Dealt over shards and joined again, it opens hardly more bins.
    dealt = packing.pack(spark, df, capacity=100, shard_rows=400)
    assert dealt.count() == len(pieces)
    assert dealt.select("bin").distinct().count() <= 1.01 * len({b for b, _ in want.values()})


def slow_join(bins, capacity):
    """Whole bins in decreasing use, each into the fullest one that has room and shares nothing."""
    sets = [(u, {("s", x) for x in s} | {("c", x) for x in c}) for u, s, c in bins]
    out, busy, gone = [None] * len(bins), set(), set()
    for i in sorted(range(len(bins)), key=lambda i: (-bins[i][0], i)):
        if i in busy or 2 * sets[i][0] > capacity:
            continue
        fits = [(capacity - u, j) for j, (u, held) in enumerate(sets) if j != i and j not in gone and u + sets[i][0] <= capacity and not held & sets[i][1]]
        if fits:
            j = min(fits)[1]
            out[i] = (j, sets[j][0])
            sets[j] = (sets[j][0] + sets[i][0], sets[j][1] | sets[i][1])
            busy |= {i, j}
            gone.add(i)
    return out


def test_joining_bins_matches_slow_version():
    rng = random.Random(4)
    for n, sources in ((0, 1), (1, 1), (150, 4), (150, 40)):
        bins = [(rng.randrange(0, 101), rng.sample(range(sources), min(sources, rng.randint(1, 3))), rng.sample(range(60), 2)) for _ in range(n)]
        assert packing.join_bins(bins, 100) == slow_join(bins, 100)
