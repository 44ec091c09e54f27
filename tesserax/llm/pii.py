"""Personal data: fixed forms first, then bootstrapped contextual extraction.

Entities of the fixed forms are seeds. The two words before an entity are its lexical
pattern; what else that looks like an identifier (a word with several digits) stands after
the same words is an instance of the pattern. Patterns and instances form a graph that is
scored in rounds: a pattern is worth the mean of its instances, an instance what its
patterns leave of doubt. Instances that reach the confidence support patterns as seeds do in
the next round. Unseen identifiers of high-confidence patterns are found. A pattern is read
from the last ``CONTEXT`` characters: a longer word counts by its end.

All of it is columns and joins. Offsets come from the lengths of matches and of what lies
between them; expressions that can't match more than one way are possessive, and a match
starts where its run of characters does, so that long texts take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize

KINDS = ("email", "ip", "card", "phone")
ADDED = "id"
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
MIN_DIGITS = 5
ROUNDS = 3
CONTEXT = 64

_LOCAL = "[A-Za-z0-9._%+-]"
#: Per kind: a cheap gate, and the form itself.
FORMS = {
    "email": ("@[A-Za-z0-9-]", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
_WORD = r"(?<!\S)(?=\S*?[0-9])\S++"
SPAN = "array<struct<s: bigint, e: bigint, m: string, c: string>>"
#: Running values over an array are built in blocks of this many, so that no long array grows.
SCAN = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even if ``body`` is a loop over it."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, first: Column, advance, emit, kind: str) -> Column:
    """``emit(state, item)`` of each item, as an array of ``kind``; ``advance`` gives the next state."""
    nothing = F.array().cast(kind)

    def run(p):
        blocks = F.when(F.size(p) > 0, F.sequence(F.lit(0), ((F.size(p) - 1) / SCAN).cast("int"))).otherwise(F.array().cast("array<int>"))
        part = lambda i: F.slice(p, i * SCAN + 1, SCAN)
        after = lambda s, i: F.aggregate(part(i), s, advance)
        start = F.struct(first.alias("s"), F.array(first).alias("out"))
        step = lambda acc, i: _let(after(acc["s"], i), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))
        states = F.aggregate(blocks, start, step)["out"]
        told = lambda acc, x: F.struct(advance(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))
        return _let(states, lambda s: F.flatten(F.transform(blocks, lambda i: F.aggregate(part(i), F.struct(F.get(s, i).alias("s"), nothing.alias("out")), told)["out"])))

    return _let(items, run)


def matches(text: Column, form: str) -> Column:
    """All leftmost non-overlapping matches as (s, e, m, c): offsets in code points, the match,
    and the last ``CONTEXT`` characters before it."""
    between = F.split(text, form, -1)
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).cast("long").alias("n"), F.right(b, F.lit(CONTEXT)).alias("b"), m.alias("m")))
    before = lambda s, x: F.right(F.concat(s["c"], x["b"]), F.lit(CONTEXT))
    end = lambda s, x: s["at"] + x["n"] + F.length(x["m"])
    advance = lambda s, x: F.struct(end(s, x).alias("at"), F.right(F.concat(s["c"], x["b"], x["m"]), F.lit(CONTEXT)).alias("c"))
    emit = lambda s, x: F.struct((s["at"] + x["n"]).alias("s"), end(s, x).alias("e"), x["m"].alias("m"), before(s, x).alias("c"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("c"))
    return F.when(F.size(found) > 0, scan(pairs, first, advance, emit, SPAN)).otherwise(F.array().cast(SPAN))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i + F.lit(1), F.lit(1)).cast("int")
    doubled = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, value(i)).otherwise(doubled(i))) % 10 == 0


def _valid(kind: str):
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255
        return lambda x: F.forall(F.split(x["m"], r"\."), lambda p: part(p) & small(p))
    if kind == "card":
        n = lambda x: F.length(_digits(x["m"]))
        return lambda x: F.when((n(x) >= 13) & (n(x) <= 19), _luhn(_digits(x["m"]))).otherwise(False)
    if kind == "phone":
        return lambda x: F.length(_digits(x["m"])).between(9, 15)
    return lambda x: F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    gate, form = FORMS[kind]
    return F.when(text.rlike(gate), F.filter(matches(text, form), _valid(kind))).otherwise(F.array().cast(SPAN))


def pattern(before: Column) -> Column:
    """The two words before the word that the text ``before`` an entity ends in, lower-case,
    digits masked; ``^`` for none."""
    last = F.regexp_extract(before, r"((?:\S+\s+)?\S+)\s+\S*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.when(last == "", "^").otherwise(last)), "[0-9]", "#"), r"\s+", " ")


def _identifiers(text: Column, taken: Column) -> Column:
    """Words with several digits, without outer punctuation, that touch no entity."""
    words = F.when(text.rlike(r"[0-9]"), matches(text, _WORD)).otherwise(F.array().cast(SPAN))
    head = lambda x: F.length(x["m"]) - F.length(F.regexp_replace(x["m"], r"^[^\p{L}\p{N}]+", ""))
    tail = lambda x: F.length(x["m"]) - F.length(F.regexp_replace(x["m"], r"[^\p{L}\p{N}]++$", ""))
    bare = F.transform(
        F.filter(words, lambda x: F.length(_digits(x["m"])) >= MIN_DIGITS),
        lambda x: F.struct((x["s"] + head(x)).alias("s"), (x["e"] - tail(x)).alias("e"), F.regexp_replace(F.regexp_replace(x["m"], r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]++$", "").alias("m"), x["c"].alias("c")),
    )
    return F.when(F.size(bare) > 0, F.when(F.size(taken) > 0, _apart(bare, taken)).otherwise(bare)).otherwise(F.array().cast(SPAN))


def _apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``: one pass looks back at their ends, one ahead."""
    known = lambda array, n: F.transform(array, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"), x["m"].alias("m"), x["c"].alias("c")))
    far = F.lit(1 << 62).cast("long")
    back = lambda s, x: F.greatest(s, F.when(x["n"] == 0, x["e"]).otherwise(s))
    ahead = lambda s, x: F.least(s, F.when(x["n"] == 0, x["s"]).otherwise(s))
    marked = "array<struct<s: bigint, n: int, e: bigint, m: string, c: string, hit: boolean>>"
    told = lambda x, hit: F.struct(x["s"].alias("s"), x["n"].alias("n"), x["e"].alias("e"), x["m"].alias("m"), x["c"].alias("c"), hit.alias("hit"))
    order = F.array_sort(F.concat(known(taken, 0), known(spans, 1)))
    once = scan(order, F.lit(0).cast("long"), back, lambda s, x: told(x, s > x["s"]), marked)
    twice = scan(F.reverse(once), far, ahead, lambda s, x: told(x, x["hit"] | (s < x["e"])), marked)
    free = F.filter(F.reverse(twice), lambda x: (x["n"] == 1) & ~x["hit"])
    return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["c"].alias("c")))


def _found(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: base spans of each kind, and what stands after which pattern."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    slim = slim.select("*", *(base_spans(F.col("t"), k).alias(k) for k in KINDS))
    seeds = F.concat(*KINDS)
    slim = slim.withColumn("ids", _identifiers(F.col("t"), seeds))
    placed = lambda spans, seed: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), pattern(x["c"]).alias("p"), F.lit(seed).alias("seed")))
    bare = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k)
    out = slim.select("doc_id", *(bare(k) for k in KINDS), F.concat(placed(seeds, True), placed("ids", False)).alias("seen"))
    return materialize(spark, out.select(F.monotonically_increasing_id().alias("row"), "*"), "entities")


def confident(spark: SparkSession, found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(m, p): unseen identifiers m and the high-confidence patterns p that found them."""
    edges = found.select(F.explode("seen").alias("x")).select("x.m", "x.p", "x.seed").groupBy("m", "p").agg(F.max("seed").alias("seed"))
    edges = materialize(spark, edges, "patterns")
    worth = edges.groupBy("m").agg(F.max(F.col("seed").cast("double")).alias("c"))
    for turn in range(rounds):
        scored = edges.join(worth, "m").groupBy("p").agg(F.avg("c").alias("pc"), F.sum((F.col("c") >= min_confidence).cast("int")).alias("support"))
        scored = scored.where((F.col("support") >= min_support) & (F.col("pc") >= min_confidence / 2)).select("p", "pc")
        doubt = edges.join(scored, "p").groupBy("m").agg((1 - F.exp(F.sum(F.log(1 - F.least("pc", F.lit(0.999)))))).alias("v"))
        seeds = edges.groupBy("m").agg(F.max(F.col("seed").cast("double")).alias("c"))
        worth = seeds.join(doubt, "m", "left").select("m", F.greatest("c", F.coalesce("v", F.lit(0.0))).alias("c"))
        worth = materialize(spark, worth, "confidence")
    good = scored.where(F.col("pc") >= min_confidence).select("p")
    return edges.where("not seed").join(worth.where(F.col("c") >= min_confidence).select("m"), "m").join(good, "p").select("m", "p")


def entities(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, email, ip, card, phone, added), one row per row of ``docs``: arrays of (s, e).

    A null text counts as empty; null ids are kept, repeated rows repeat, an empty table
    gives an empty result, and other columns are not read.
    """
    found = _found(spark, docs, id_col, text_col)
    more = confident(spark, found, rounds)
    seen = found.select("row", F.explode("seen").alias("x")).where("not x.seed").select("row", "x.s", "x.e", "x.m", "x.p")
    added = seen.join(more, ["m", "p"]).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("added"))
    return found.join(added, "row", "left").select("doc_id", *KINDS, F.coalesce("added", F.array().cast("array<struct<s: bigint, e: bigint>>")).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Entities as counts, a hash of the base spans and a list of all spans."""

    def listed(kind: str, name: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(name), x["s"], x["e"]))

    base = [listed(k, k) for k in KINDS]
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"), F.array_join(F.concat(*base, listed("added", ADDED)), ",").alias("spans"))
