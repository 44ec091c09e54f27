"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source has integer weights among siblings. A token budget
runs down it: siblings share by weight, one that can't use its share (its capacity is its
tokens times the epochs allowed) is filled, and its shortage goes to its siblings. As a
node's capacity is that of its leaves, a shortage reaches an ancestor's siblings only when
all siblings below are full. Each leaf then takes whole epochs, and of the next epoch, in
an order seeded for it, the longest prefix of whole documents within its tokens.

All of it is columns, windows over the few nodes, and joins. The prefix is found in two
steps, over sums of buckets of the order and inside the one bucket where it ends, so no
task orders a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialize

LEVELS = ("domain", "lang", "source")
#: Weights among siblings by name; others have DEFAULT_WEIGHT.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source": {}}
DEFAULT_WEIGHT = 1
SHARE_PERCENT = 50
EPOCHS = 2
SEED = 17
BUCKET_ROWS = 256
MAX_BUCKETS = 65_536
MAX_BROADCAST_LEAVES = 50_000
NONE = "(none)"


def domain_of(source: Column) -> Column:
    """The default domain of a source: its trailing number modulo 4, as d0 to d3."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits == "", NONE).otherwise(F.concat(F.lit("d"), (digits.cast("int") % 4).cast("string")))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def allot(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """Add ``allotted`` to leaves (the level columns and ``capacity``): whole tokens, none
    over its capacity, together the smaller of the budget and all capacity."""
    nodes = None
    for depth, level in enumerate(LEVELS, 1):
        names, above = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        own = leaves.groupBy(*names).agg(F.sum("capacity").alias("cap")).withColumn("w", _weight(level, weights))
        own = own.withColumn("b", F.least(budget, F.sum("cap").over(Window.partitionBy()))) if nodes is None else own.join(nodes, above)
        order = [F.col("cap") / F.col("w"), F.col(level)]
        whole = Window.partitionBy(*above)
        before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        wide = lambda c: c.cast("decimal(19,0)")
        own = own.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w1", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        own = own.withColumn("full", wide(F.col("cap")) * wide(F.col("w1")) <= wide(F.col("b") - F.col("c0")) * wide(F.col("w")))
        own = own.withColumn("left", F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).withColumn("wu", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
        own = own.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * w) div wu")))
        # What rounding left goes, one token each, to the first that are not full.
        rest = F.col("b") - F.sum("share").over(whole)
        place = F.row_number().over(whole.partitionBy(*above, "full").orderBy(*order)) if above else F.row_number().over(Window.partitionBy("full").orderBy(*order))
        own = own.withColumn("rest", rest).withColumn("place", place)
        nodes = own.select(*names, (F.col("share") + F.when(~F.col("full") & (F.col("place") <= F.col("rest")), 1).otherwise(0)).alias("b"))
    return leaves.join(nodes.withColumnRenamed("b", "allotted"), list(LEVELS))


def _order(epoch: Column, doc: Column, seed: int) -> Column:
    """Where a document stands in an epoch: 32 bits of a hash of seed, epoch and document."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _bucket() -> Column:
    return F.expr("(u * buckets) div 4294967296")


def _keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None) -> DataFrame:
    """Tree names, id, words and a hash of the text, beside the row itself as ``row``."""
    source, lang = F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)), F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE))
    return docs.select(
        F.coalesce(domain if domain is not None else domain_of(source), F.lit(NONE)).alias("domain"), lang.alias("lang"), source.alias("source"),
        F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("tokens"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.struct(*docs.columns).alias("row"),
    )


def plan(spark: SparkSession, keyed: DataFrame, share_percent: int, epochs: int, weights: dict[str, dict[str, int]], seed: int) -> DataFrame:
    """Per leaf: whole epochs, and the bucket and offset where the next epoch's prefix ends."""
    slim = materialize(spark, keyed.select(*LEVELS, "id", "tokens"), "words")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n")).withColumn("capacity", F.col("total") * epochs)
    total = slim.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shared = allot(leaves, F.lit(total * share_percent // 100).cast("long"), weights)
    shared = shared.withColumn("whole", F.when(F.col("total") > 0, F.expr("allotted div total")).otherwise(0)).withColumn("part", F.expr("allotted - whole * total"))
    shared = shared.withColumn("buckets", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long"))
    shared = materialize(spark, shared.select(*LEVELS, "allotted", "whole", "part", "buckets"), "shares")
    placed = slim.join(_small(shared), list(LEVELS)).withColumn("u", _order(F.col("whole"), F.col("id"), seed))
    sums = placed.groupBy(*LEVELS, "part", _bucket().alias("bucket")).agg(F.sum("tokens").alias("t"))
    ends = sums.withColumn("end", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    edge = ends.where("end > part").groupBy(*LEVELS).agg(F.min_by("bucket", "bucket").alias("edge"), F.min_by(F.col("end") - F.col("t"), "bucket").alias("offset"))
    return materialize(spark, shared.join(edge, list(LEVELS), "left"), "plan")


def _small(nodes: DataFrame) -> DataFrame:
    """Broadcast a table of leaves if it is small enough; joins split hot leaves otherwise."""
    return F.broadcast(nodes) if nodes.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES else nodes


def mix(spark: SparkSession, docs: DataFrame, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """(domain, lang, source, epoch, tokens, row): each selected row, once per epoch it is in.

    The budget is ``share_percent`` of all words of ``docs``. Nulls in the tree's columns are
    nodes of their own; a null text has no words; texts without words take no budget and are
    selected with the prefix they stand in. Rows that tie in the order stand by id, then by
    text; repeated rows count as often as they occur. An empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col, lang_col, source_col, domain)
    leaves = plan(spark, keyed, share_percent, epochs, weights, seed)
    placed = keyed.join(_small(leaves), list(LEVELS)).withColumn("u", _order(F.col("whole"), F.col("id"), seed)).withColumn("bucket", _bucket())
    out = (*LEVELS, "epoch", "tokens", "row")
    before = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True))
    # The next epoch is open only below the number allowed.
    last = F.when(before & (F.col("whole") < epochs), F.col("whole")).otherwise(F.col("whole") - 1)
    sure = placed.withColumn("last", last).where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select(*out)
    along = Window.partitionBy(*LEVELS).orderBy("u", "id", "th").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where((F.col("bucket") == F.col("edge")) & (F.col("whole") < epochs)).withColumn("end", F.col("offset") + F.sum("tokens").over(along))
    return sure.union(edge.where("end <= part").select(*LEVELS, F.col("whole").alias("epoch"), "tokens", "row"))


def oracle_sql(share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED) -> str:
    """DuckDB SQL for (doc_id, domain, lang, source, epoch, tokens) of ``mix`` over documents,
    with one window per leaf in place of buckets."""
    sql = f"""with k as (select coalesce(case when regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' then '{NONE}' else 'd' || (cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int) % 4) end, '{NONE}') as domain,
 coalesce(lang, '{NONE}') as lang, coalesce(source, '{NONE}') as source, doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) as bigint) as tokens, md5(coalesce(text, '')) as th from documents),
 leaves as (select domain, lang, source, cast(sum(tokens) as bigint) as total, cast(sum(tokens) * {epochs} as bigint) as capacity from k group by all),
 b0 as (select cast((select coalesce(sum(tokens), 0) from k) as bigint) * {share_percent} // 100 as b)"""
    for depth, level in enumerate(LEVELS, 1):
        names, above = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1])
        part = f"partition by {above}" if above else ""
        weight = "case " + " ".join(f"when {level} = '{n}' then {w}" for n, w in sorted(weights.get(level, {}).items())) + f" else {DEFAULT_WEIGHT} end" if weights.get(level) else str(DEFAULT_WEIGHT)
        source = f"join b{depth - 1} using ({above})" if above else "cross join b0"
        budget = "b" if above else "least(b, sum(cap) over ())"
        sql += f""",
 g{depth} as (select {names}, cast(sum(capacity) as bigint) as cap, cast({weight} as bigint) as w from leaves group by {names}),
 h{depth} as (select g{depth}.*, cast({budget} as hugeint) as b from g{depth} {source}),
 i{depth} as (select *, cast(coalesce(sum(cap) over ({part} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0) as hugeint) as c0,
  cast(sum(w) over ({part}) - coalesce(sum(w) over ({part} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0) as hugeint) as w1 from h{depth}),
 j{depth} as (select *, cap * w1 <= (b - c0) * w as filled from i{depth}),
 l{depth} as (select *, b - coalesce(sum(case when filled then cap end) over ({part}), 0) as remain, sum(case when not filled then w end) over ({part}) as wu from j{depth}),
 m{depth} as (select *, case when filled then cap else (remain * w) // wu end as share from l{depth}),
 n{depth} as (select *, b - sum(share) over ({part}) as rest, row_number() over (partition by {above + ", " if above else ""}filled order by cap / w, {level}) as place from m{depth}),
 b{depth} as (select {names}, cast(share + case when not filled and place <= rest then 1 else 0 end as bigint) as b from n{depth})"""
    return (
        sql
        + f""",
 plan as (select domain, lang, source, case when total > 0 then b // total else 0 end as whole, b - (case when total > 0 then b // total else 0 end) * total as part from leaves join b{len(LEVELS)} using (domain, lang, source)),
 placed as (select k.*, whole, part, cast('0x' || substr(md5('{seed}/' || whole || '/' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as u from k join plan using (domain, lang, source)),
 ends as (select *, sum(tokens) over (partition by domain, lang, source order by u, doc_id nulls first, th rows unbounded preceding) as e from placed)
 select doc_id, domain, lang, source, cast(x.epoch as bigint) as epoch, tokens from ends, unnest(range(0, {epochs})) as x(epoch) where x.epoch < whole or (x.epoch = whole and e <= part)"""
    )
