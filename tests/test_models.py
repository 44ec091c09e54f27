"""Operators against small models in plain Python, with known scenarios."""

import random

from pyspark.sql import functions as F

from tesserax.functions import scalars
from tesserax.operators import cells, chains, freespace, journal, maps, membership, ordered, queues, runs, sequences, spatial, trees


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_order_statistics(spark):
    rng = random.Random(4)
    keys = rng.sample(range(10_000), 900)
    df = spark.createDataFrame([(k, rng.randrange(100)) for k in keys], "k long, v long")
    data = {r.k: r.v for r in df.collect()}
    end, want = 0, []
    for k in sorted(data):
        end += data[k]
        want.append((k, end))
    assert rows(ordered.prefix_sum(df, "k", F.col("v")).select("k", "end"), "k") == want
    order = sorted(data)
    assert rows(ordered.neighbour(df, "k", "k", 1, "n").select("k", "n"), "k") == list(zip(order, [*order[1:], None]))
    assert rows(ordered.neighbour(df, "k", "v", -1, "p").select("k", "p"), "k") == list(zip(order, [None, *(data[k] for k in order[:-1])]))
    probes = spark.createDataFrame([(p,) for p in (-5, 0, 4_999, 9_998, 20_000, *order[:5])], "p long")
    got = {r.p: (r.k, r.v) for r in ordered.asof_forward(probes, "p", df, "k", "v").collect()}
    for p, hit in got.items():
        first = min((k for k in order if k >= p), default=None)
        assert hit == (first, data.get(first))
    assert ordered.rank(df.limit(0), "k").count() == 0


def test_multimap_toggles(spark):
    rng, model, history = random.Random(1), {}, []
    for seq in range(300):
        k = rng.randrange(20)
        history.append((k, seq, seq * 10))
        model.setdefault(k, []).append(seq)
    df = spark.createDataFrame(history, "k long, seq long, v long")
    gone = spark.createDataFrame([(k,) for k in (3, 5, 5, 99)], "k long")
    left = {}
    for k, seq, _ in maps.mm_remove_latest(df, gone).collect():
        left.setdefault(k, []).append(seq)
    for k in (3, 5):
        model[k].pop()
    assert {k: sorted(v) for k, v in left.items()} == model
    assert {r.k: r.seq for r in maps.mm_find_latest(df, gone).collect()} == {k: max(s for a, s, _ in history if a == k) for k in (3, 5)}


def test_digits_and_levels(spark):
    df = spark.createDataFrame([(k,) for k in (0, 127, 128, 32_767, 32_768, (1 << 40) + 12345)], "k long")
    for r in df.select("k", maps.digits(F.col("k"), 128, 256, 6).alias("d"), maps.level_of(F.col("k"), 128, 256).alias("l")).collect():
        rest, level = r.k, 0
        for i, d in enumerate(r.d):
            base = 128 if i == 0 else 256
            assert (d.level, d.digit, d.quotient) == (i, rest % base, rest // base)
            rest //= base
            level = i + 1 if rest else level
        assert r.l == level


def test_sequence_edits(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdef"))], "doc long, b binary")
    c = F.col("b")
    got = df.select(sequences.replace(c, 2, 3, "XYZ"), sequences.erase(c, 1, 2), sequences.insert(c, 6, b"!"), sequences.truncate(c, 7), sequences.truncate(c, 2), sequences.truncate_by(c, 2), sequences.write_at(c, 5, "QQ"), sequences.write_at(c, 7, "Q"), sequences.resize(c, 8), sequences.resize(c, 3)).first()
    assert tuple(got) == (b"abXYZf", b"adef", b"abcdef!", None, b"ab", b"abcd", b"abcdeQQ", None, b"abcdef  ", b"abc")
    reads = df.select(sequences.read_next(c, sequences.seek(F.octet_length("b"), 4), 9).alias("r"), sequences.write_next(c, sequences.seek(F.octet_length("b"), 40), "gh").alias("w")).first()
    assert tuple(reads.r) == (b"ef", 6) and tuple(reads.w) == (b"abcdefgh", 8)
    rng = random.Random(42)
    texts = {i: "".join(rng.choice("abcdé😀\0ß") for _ in range(rng.randrange(1, 50))).encode() for i in range(40)}
    table = spark.createDataFrame([(i, bytearray(t)) for i, t in texts.items()] + [(99, bytearray()), (98, None)], "doc long, b binary")
    parts = sequences.chunks(table, "doc", "b", 5)
    back = lambda d: {r.doc: bytes(r.bytes) for r in sequences.whole(d).collect()}
    assert back(parts) == texts and all(len(r.chunk) <= 5 for r in parts.collect())
    for at in (0, 5, 13, 40):
        assert {k: v for k, v in back(sequences.insert_split(parts, at, "#é")).items() if len(texts[k]) >= at} == {k: t[:at] + "#é".encode() + t[at:] for k, t in texts.items() if len(t) >= at}
        for size in (None, 5):
            assert {r.doc: r.bytes for r in sequences.read_at(parts, at, 11, size).collect()} == {k: t[at : at + 11] for k, t in texts.items() if len(t) >= at}
        assert {r.doc: (r.seq, r.inner) for r in sequences.locate(parts, F.lit(at)).collect()} == {k: divmod(at, 5) for k, t in texts.items() if len(t) > at}
    assert back(sequences.append_chunk(parts, "!")) == {k: t + b"!" for k, t in texts.items()}
    assert back(sequences.drop_last(parts)) == {k: t[: (len(t) - 1) // 5 * 5] for k, t in texts.items() if len(t) > 5}


def test_merge_scenario(spark):
    table = [
        [("ant", "newer", 0, 5), ("cat", "", 1, 11), ("dog", "newest-tie", 0, 9), ("fox", "f", 0, 2)],
        [("ant", "highest-lsn", 0, 7), ("bat", "b", 0, 4), ("cat", "old-live", 0, 10), ("dog", "older-tie", 0, 9)],
        [("cat", "oldest", 0, 1), ("eel", "e", 0, 3)],
    ]
    df = spark.createDataFrame([(*r, i) for i, run in enumerate(table) for r in run], "k string, v string, flag int, lsn long, run int")
    assert rows(runs.merge(df).select("k", "v", "flag", "lsn"), "k") == [("ant", "highest-lsn", 0, 7), ("bat", "b", 0, 4), ("cat", "", 1, 11), ("dog", "newest-tie", 0, 9), ("eel", "e", 0, 3), ("fox", "f", 0, 2)]
    assert [r[0] for r in rows(runs.merge(df, True), "k")] == ["ant", "bat", "dog", "eel", "fox"]


def test_front_coding_round_trip(spark):
    rng = random.Random(9)
    keys = sorted({"".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(200)})
    df = runs.blocks(spark.createDataFrame([(k, 1) for k in keys], "k string, run int"), 16)
    coded = runs.front_coded(df)
    assert coded.where("pos % 16 = 0 and shared > 0").count() == 0
    assert [r[0] for r in rows(runs.front_decoded(coded).select("k", "pos"), "pos")] == keys


def test_log_replay(spark):
    log = lambda *r: spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "seq long, kind string, pid long, image string, cnt long, bad boolean")
    page = lambda p, image, bad=False: ("page", p, image, None, bad)
    commit = lambda n, bad=False: ("commit", None, None, n, bad)
    read = lambda df: {r.pid: r.image for r in journal.replay(df).collect()}
    assert read(log(page(5, "a"), page(9, "b"), commit(2))) == {5: "a", 9: "b"}
    assert read(log(page(1, "a"), commit(1), page(2, "b"))) == {1: "a"}
    assert read(log(page(1, "a"), commit(1), page(1, "b"), commit(2), page(2, "c"), commit(1))) == {1: "a"}
    assert read(log(page(1, "a"), commit(1), page(2, "x", True), page(3, "c"), commit(2))) == {1: "a"}
    assert read(log(page(1, "a"), page(1, "b"), commit(2), page(3, "c"), commit(1))) == {1: "b", 3: "c"}
    assert read(log(page(1, "a"))) == {}


def test_free_space(spark):
    pages = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "pid long, free long")
    asked = spark.createDataFrame([(1, 15), (2, 25), (3, 100)], "id long, size long")
    assert {r.size: r.pid for r in freespace.best_fit(pages, asked).collect()} == {15: 3, 25: 2, 100: None}
    sizes = spark.createDataFrame([(s,) for s in (0, 8, 9, 64, 65, 65_535)], "s long")
    assert [r.c for r in sizes.select(scalars.size_class(F.col("s"), 8, 8).alias("c")).collect()] == [0, 0, 1, 1, 2, 5]
    links = spark.createDataFrame([("a", 1, 2), ("a", 2, None), ("b", 1, 2), ("b", 2, 1), ("c", 1, 9), ("c", 2, 9), ("c", 9, None)], "list string, pid long, next long")
    assert {r.list: r.cyclic for r in freespace.list_faults(links, 100).collect()} == {"a": False, "b": True, "c": True}


def test_bloom(spark):
    assert membership.bits_for(0, 0.01) == 1 and membership.probes_for(9, 0) == 1
    m, k = membership.parameters(1000, 0.01)
    assert m % 64 == 0
    keys = spark.range(1000).withColumnRenamed("id", "k")
    bloom = membership.build(keys, "k", m, k)
    assert membership.might_contain(keys, "k", bloom, m, k).count() == 1000
    absent = spark.range(10_000, 12_000).withColumnRenamed("id", "k")
    assert membership.might_contain(absent, "k", bloom, m, k).count() < 100
    for limit in (membership.BROADCAST_BITS, 0):  # rows that repeat stay
        assert sorted(r.k for r in membership.might_contain(keys.limit(2).union(keys.limit(2)), "k", bloom, m, k, limit).collect()) == sorted([r.k for r in keys.limit(2).collect()] * 2)


def test_cells(spark):
    points = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.25,), (0.2500001,), (-3.0,), (9.0,)], "x double")
    assert [r.c for r in points.select(cells.index_of(F.col("x"), 0.0, 1.0, 1).alias("c")).collect()] == [0, 0, 1, 0, 0, 0, 1]
    boxes = spark.createDataFrame([(0.1, 0.2), (0.4, 0.6), (0.5, 0.6), (0.25, 0.5), (0.5, 0.5), (0.0, 1.0)], "a double, b double")
    got = [tuple(r.c) for r in boxes.select(cells.box_cell((F.col("a"),), (F.col("b"),), 0.0, 1.0, 3).alias("c")).collect()]
    assert got == [(2, 0), (0, 0), (3, 4), (2, 1), (3, 3), (0, 0)]
    child = spark.range(1).select(cells.child_index((F.lit(0),), (F.lit(5),), (F.lit(5),)), cells.child_index((F.lit(5),), (F.lit(6),), (F.lit(5),)), cells.child_index((F.lit(5),), (F.lit(5),), (F.lit(5),)), cells.child_index((F.lit(4),), (F.lit(6),), (F.lit(5),))).first()
    assert tuple(child) == (0, 1, 0, None)


def test_paths(spark):
    split = lambda p: spark.range(1).select(trees.split_path(F.lit(p)).alias("x")).first().x
    assert split("/") == [] and split("//a///b/") == ["a", "b"]


def test_compare(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan), (nan, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 1.0)], "a double, b double")
    assert [r.o for r in df.select(scalars.compare(F.col("a"), F.col("b")).alias("o")).collect()] == ["eq", "unordered", "lt", "gt", "eq"]
    pair = spark.createDataFrame([("hello world", "hello wide"), ("", "x"), ("é", "è")], "a string, b string")
    assert [tuple(r) for r in pair.select(runs.shared_prefix(F.col("a"), F.col("b")), scalars.common_bytes(F.col("a"), F.col("b"))).collect()] == [(7, 7), (0, 0), (0, 1)]


def test_queues(spark):
    q = spark.createDataFrame([(0, "first"), (1, "second"), (2, "third")], "seq long, v string").withColumn("g", F.lit(1))
    assert queues.front(q, "g", "v").first().v == "first" and queues.front(queues.dequeue(q, "g", 2), "g", "v").first().v == "third"
    assert queues.newest(q, "g", "v").first().v == "third" and queues.newest(queues.pop_newest(q, "g", 2), "g", "v").first().v == "first"
    assert [r.v for r in queues.scan(q, "g").orderBy("pos").collect()] == ["first", "second", "third"]
    more = queues.next_seq(q, spark.createDataFrame([("b",), ("a",)], "v string"), F.col("v"))
    assert rows(more.select("seq", "v"), "seq") == [(3, "a"), (4, "b")]
    assert rows(queues.next_seq(q.limit(0), more.select("v"), F.col("v")).select("seq"), "seq") == [(0,), (1,)]
    keys = spark.createDataFrame([("0001",), ("0001",), ("0001",), ("02",)], "k string")
    assert queues.size(queues.push(keys, keys)).first().n == 8 and queues.key_violations(keys, "k", 4).count() == 1
    assert queues.top(keys.limit(0), "k").count() == 0


def test_heap_model(spark):
    rng = random.Random(5)
    batch = [(f"{rng.randrange(10_000):04d}", i) for i in range(400)]
    q = spark.createDataFrame(batch, "k string, i long")
    for n in (1, 7, 100):
        assert rows(queues.pop(q, "i", "k", "i", n=n).select("k", "i"), "k", "i") == sorted(batch)[n:]
        assert rows(queues.top(q, "k", "i", n=n), "k", "i") == sorted(batch)[:n]


def test_chains_and_ids(spark):
    pages = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "page long, place long")
    near = lambda *r: spark.createDataFrame(list(r), "page long, near long")
    assert [r[0] for r in rows(chains.splice(pages, near((9, 2)), near((8, 3), (7, 2))), "pos")] == [1, 9, 2, 7, 3, 8]
    assert rows(chains.unlink(pages, pages.where("page = 2")), "page") == [(1, 0), (3, 2)]
    boxes = spark.createDataFrame([(4, 0, 1, 0, 1, "a"), (7, 2, 3, 2, 3, "b")], "id long, lo0 long, hi0 long, lo1 long, hi1 long, v string")
    fresh = spatial.with_ids(boxes, boxes.drop("id"))
    ids = [r.id for r in fresh.collect()]
    assert len(set(ids)) == 2 and min(ids) > 7
    assert rows(spatial.set_values(boxes, spark.createDataFrame([(7, "new"), (9, "none")], "id long, v string"), "id", "v").select("id", "lo0", "v"), "id") == [(4, 0, "a"), (7, 2, "new")]
    assert tuple(spatial.get(boxes, "id", 7, 2).select("id", "lo0", "hi1").first()) == (7, 0, 5)
    assert rows(maps.mm_insert(pages, pages.where("page = 1")).groupBy("page").count(), "page")[0] == (1, 2)


def test_levels_and_growth(spark):
    assert [maps.most_levels(b, 128, 256) for b in (7, 8, 15, 16, 32)] == [1, 2, 2, 3, 5]
    grow = lambda x, y: spark.range(1).select(cells.doublings((F.lit(x), F.lit(y)), (0.0, 0.0), (1.0, 1.0)).alias("n")).first().n
    assert [grow(0.5, 0.5), grow(1.5, 0.5), grow(-1.5, 0.0), grow(4.0, 0.0), grow(4.1, -1.0)] == [0, 1, 2, 2, 3]
    assert spark.range(1).select(cells.doublings((F.lit(1.0),), (0.0,), (0.0,)).alias("n")).first().n is None
    assert [r.x for r in spark.range(3).select(cells.can_split(F.col("id"), F.lit(4.0), 2.0, 2).alias("x")).collect()] == [True, True, False]


def test_many_logs(spark):
    log = spark.createDataFrame([("a", 0, "page", 1, "x", False), ("a", 1, "commit", None, None, False), ("a", 2, "page", 1, "y", False), ("b", 0, "page", 1, "z", True), ("b", 1, "commit", None, None, False)], "g string, seq long, kind string, pid long, image string, bad boolean")
    assert [tuple(r) for r in journal.by_commit(log, "g").collect()] == [("a", 1, "x")]
