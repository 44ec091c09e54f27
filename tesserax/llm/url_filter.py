"""URL filters: listed rules first, then boosted trees on lexical features.

Everything is columns: features, the trees' training (one aggregation per level over a
bounded table of labelled URLs) and scoring, where the trees are one SQL expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict); a rule fits its host and all subdomains, the longest wins.
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TREES, DEPTH, RATE, BINS, LEAST = 6, 4, 0.6, 24, 8
MAX_LABELLED = 20_000
SEED_ROWS = 8000
#: Suffixes with fewer labelled URLs than this have no statistics.
MIN_SEEN = 3

#: Families of words of the default labelled URLs. What sites to block call
#: themselves, what sites to keep do, and what both put before it.
BAD_FAMILIES = {
    "gambling": "casino casinos gambling bet bets betting poker roulette slots jackpot lotto wager win bookmaker blackjack bingo spins",
    "adult": "porn sex xxx escort escorts nude nudes erotic adult fetish hentai strip cams x girls hookup",
    "pharma": "pills viagra cialis pharma meds steroids xanax tramadol opioids slimming dosage remedy",
    "piracy": "warez crack cracks keygen torrent torrents cracked serials nulled pirate leaked replica",
    "money": "payday loan loans credit profit profits millionaire earnings refund prize prizes winner bonus giveaway",
    "phishing": "login verify account secure signin update confirm wallet unlock password billing suspended",
    "spam": "spam ads adserver popunder track tracker clicks traffic farm linkfarm doorway bulkmail leads",
}
GOOD_FAMILIES = {
    "news": "news herald tribune gazette press journal times post observer chronicle courier review",
    "learning": "university college school library museum academy institute archive science history lectures atlas",
    "public": "city council health transport weather parliament court harbour water energy fire station",
    "craft": "garden kitchen bakery knitting pottery travel hiking music film books blog photo",
    "trade": "furniture shoes tools bikes carpets windows paper timber coffee tea clothing toys",
    "code": "docs api wiki forum code kernel data maps compiler packages review standards",
}
NEUTRAL = "my own free best the new big green blue north daily open little old city easy top first cheap great local our".split()
GOOD_ENDS = ".com .com .org .org .net .edu .gov .info .de .fr .es .co.uk .io".split()
BAD_ENDS = ".com .com .net .org .info .ru .biz .top .xyz .click .online .site .win".split()
BOTH_FILES = "html htm php aspx pdf jpg".split()
BAD_FILES = "exe scr zip apk msi bat".split()


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    name, verdict = None, None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host_col == domain) | host_col.endswith("." + domain)) & path_col.startswith("/" + rest)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def _labels(host_col: Column) -> Column:
    """The labels of a host without the last one, or the only one."""
    parts = F.split(host_col, r"\.")
    return F.when(F.size(parts) > 1, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)


def _suffixes(host_col: Column, path_col: Column) -> dict[str, Column]:
    """Arrays of the suffixes that have statistics: of labels, their words, the host and the path."""
    labels = _labels(host_col)
    return {
        "ending": F.transform(labels, lambda x: F.right(x, F.lit(3))),
        "word": F.flatten(F.transform(labels, lambda x: F.split(x, "-"))),
        "top": F.array(F.substring_index(host_col, ".", -1)),
        "file": F.array(F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]{1,5})$", 1))),
    }


def _entropy(text: Column) -> Column:
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    p = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.coalesce(F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - p(c) * F.log2(p(c))), F.lit(0.0))


def _looked_up(table: Column):
    return lambda x: F.coalesce(F.try_element_at(table, x), F.lit(0.0))


def features(url: Column, statistics: dict[str, dict[str, float]]) -> dict[str, Column]:
    """Lexical features of a URL, all doubles, none null."""
    u, h, p = F.coalesce(url, F.lit("")), host(url), path(url)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    out = {
        "length": F.length(u),
        "host_length": F.length(h),
        "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
        "entropy": _entropy(h),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "labels": F.size(F.split(h, r"\.")),
        "hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))),
    }
    for kind, column in _suffixes(h, p).items():
        known = statistics.get(kind) or {"": 0.0}
        table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
        out["suffix_" + kind] = F.coalesce(F.array_max(F.transform(column, _looked_up(table))), F.lit(0.0))
    return {k: v.cast("double") for k, v in out.items()}


def seed_urls(spark: SparkSession, rows: int = SEED_ROWS, without: tuple[str, ...] = ()) -> DataFrame:
    """The default labelled URLs (url, label, family), made by rule: hosts of the families above
    (except those in ``without``), of invented names and of random letters and digits, under
    paths of eight kinds that both labels use, if not equally often."""
    hashed = lambda salt: F.xxhash64("id", F.lit(salt))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(hashed(salt), F.lit(len(words))) + 1).cast("int"))
    dice = lambda n, salt: F.pmod(hashed(salt), F.lit(n))
    label = (F.col("id") % 2).cast("int")

    def family(families, extra):
        names = [n for n in families if n not in without] + extra
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(hashed(1), F.lit(len(names))) + 1).cast("int"))

    def word(salt):
        out = F.lit(None).cast("string")
        for name, words in (BAD_FAMILIES | GOOD_FAMILIES).items():
            out = F.when(F.col("family") == name, pick(words.split(), salt)).otherwise(out)
        return out

    # Invented names alternate consonants and vowels; machine names mix letters and digits.
    sounds = lambda salt: F.concat(*(pick(list(c), salt + i) for i, c in enumerate(("bcdfghklmnprstvwz", "aeiouy") * 2)))
    noise = F.substring(F.translate(F.conv(F.hex(hashed(40)), 16, 36), UPPER, LOWER), 1, 12)
    front, mark = F.concat(pick(NEUTRAL, 2), F.lit("-")), pick(["", "", "-"], 3)
    known = F.concat(F.when(dice(3, 4) == 0, front).otherwise(""), word(5), F.when(dice(3, 6) == 0, F.concat(F.lit("-"), word(7))).otherwise(F.when(dice(4, 8) == 0, F.concat(mark, dice(100, 9).cast("string"))).otherwise("")))
    known_good = F.concat(F.when(dice(2, 4) == 0, front).otherwise(""), F.when(dice(4, 10) == 0, F.concat(pick(NEUTRAL, 11), F.lit("-"))).otherwise(""), word(5), F.when(dice(4, 6) == 0, F.concat(F.lit("-"), sounds(50))).otherwise(""))
    name = F.when(F.col("family") == "machine", noise).when(F.col("family") == "names", F.concat(sounds(20), pick(["", "n", "r", "rk", "lt", "mp", "nt", "ck"], 33), F.when(dice(2, 12) == 0, sounds(30)).otherwise(""), pick(["", "", "m", "ft", "lk", "rn"], 34))).when(label == 1, known).otherwise(known_good)
    sub = F.when(label == 1, pick(["", "", "www.", "m.", "secure.", "go.", "cdn7."], 13)).otherwise(pick(["", "", "www.", "www.", "m.", "blog.", "docs."], 13))
    site = F.when(dice(5, 14) == 0, pick([".hosting.com", ".pages.org", ".sites.net"], 15)).when(label == 1, pick(BAD_ENDS, 16)).otherwise(pick(GOOD_ENDS, 16))
    number, slug = dice(1_000_000, 17).cast("string"), F.concat_ws("-", pick(NEUTRAL, 18), sounds(60), sounds(70))
    file = F.when((label == 1) & (dice(3, 19) > 0), pick(BAD_FILES, 21)).otherwise(pick(BOTH_FILES, 21))
    kinds = [
        F.lit("/"), F.concat(F.lit("/"), slug), F.concat(F.lit("/"), pick(["en", "it", "section", "articles"], 22), F.lit("/"), number, pick(["", "/", ".html"], 23)),
        F.concat(F.lit("/20"), F.lpad(dice(25, 24).cast("string"), 2, "0"), F.lit("/0"), (dice(9, 25) + 1).cast("string"), F.lit("/"), slug, F.lit("/")),
        F.concat(F.lit("/index.php?id="), number, F.lit("&lang="), pick(["en", "it"], 26)), F.concat(F.lit("/item/"), number, F.lit("?colour="), pick(["red", "blue"], 27), pick(["", "#reviews"], 28)),
        F.concat(F.lit("/go?session="), number, number, F.lit("&aff="), number, F.lit("&utm_campaign="), sounds(80)), F.concat(F.lit("/"), sounds(90), F.lit("/"), number, F.lit("/"), pick(["setup", "report", "view"], 29), F.lit("."), file),
    ]
    choice = lambda weights: F.element_at(F.array(*map(F.lit, weights)), (F.pmod(hashed(31), F.lit(len(weights))) + 1).cast("int"))
    shape = F.when(label == 1, choice([0, 1, 2, 3, 4, 5, 6, 6, 7, 7])).otherwise(choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 5, 6, 7]))
    base = spark.range(rows).select("id", F.when(label == 1, family(BAD_FAMILIES, ["machine"])).otherwise(family(GOOD_FAMILIES, ["names", "names"])).alias("family"))
    tail = F.element_at(F.array(*kinds), shape + 1)
    return base.select(F.concat(pick(["http://", "https://", "https://"], 32), sub, name, site, tail).alias("url"), label.alias("label"), "family")


@dataclass
class Model:
    """Suffix statistics, and trees as nested (feature, threshold, low, high) or leaf values."""

    statistics: dict[str, dict[str, float]]
    base: float
    trees: list

    def margin(self, columns: dict[str, Column]) -> Column:
        out = F.lit(self.base)
        for t in self.trees:
            out = out + _walked(t, columns)
        return out


def _walked(node, columns: dict[str, Column]) -> Column:
    """A tree's value as one expression."""
    return F.lit(node) if isinstance(node, float) else F.when(columns[node[0]] <= node[1], _walked(node[2], columns)).otherwise(_walked(node[3], columns))


def _statistics(known: DataFrame) -> dict[str, dict[str, float]]:
    """Smoothed log odds of suffixes seen ``MIN_SEEN`` times or more in the labelled URLs, which
    bound their number."""
    kinds = _suffixes(host(F.col("url")), path(F.col("url")))
    tagged = lambda kind: lambda s: F.struct(F.lit(kind).alias("k"), s.alias("s"))
    listed = F.flatten(F.array(*(F.transform(F.array_distinct(column), tagged(kind)) for kind, column in kinds.items())))
    odds = F.round(F.log((F.sum("label") + 1) / (F.sum(1 - F.col("label")) + 1)), 6)
    seen = known.select("label", F.explode(listed).alias("x")).groupBy("x.k", "x.s").agg(odds.alias("v"), F.count(F.lit(1)).alias("n"))
    out: dict[str, dict[str, float]] = {k: {} for k in kinds}
    for r in seen.where((F.col("n") >= MIN_SEEN) & (F.col("s") != "")).collect():
        out[r.k][r.s] = float(r.v)
    return out


#: Models of the default labelled URLs by their settings: they depend on nothing else.
_TRAINED: dict[tuple, Model] = {}


def train(spark: SparkSession, labelled: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST, max_labelled: int = MAX_LABELLED) -> Model:
    """Boosted trees of logistic loss from labelled URLs (url, label 0 or 1).

    At most ``max_labelled`` rows are used, first by a hash of the URL. A third of them are
    shown to the trees without the statistics of their words and endings, so that the trees
    also learn what to make of words never seen. Margins are a column that each tree adds to.
    Each level of a tree is one aggregation over feature bins; its histogram (nodes times
    features times bins, whatever the number of rows) comes to the driver, which picks the
    splits. Null URLs and labels are passed over; without both labels the model is the base
    rate. The model of the default URLs is kept for the process.
    """
    settings = (trees, depth, rate, bins, least, max_labelled)
    if labelled is not None:
        return _train(spark, labelled, *settings)
    if settings not in _TRAINED:
        _TRAINED[settings] = _train(spark, materialize(spark, seed_urls(spark), "seeds"), *settings)
    return _TRAINED[settings]


def _train(spark: SparkSession, labelled: DataFrame, trees: int, depth: int, rate: float, bins: int, least: int, max_labelled: int) -> Model:
    known = labelled.select("url", F.col("label").cast("int").alias("label")).where("url is not null and label in (0, 1)")
    known = materialize(spark, known.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled).coalesce(1), "labelled")
    n, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = math.log((bad + 0.5) / (n - bad + 0.5))
    statistics = _statistics(known)
    if not 0 < bad < n:
        return Model(statistics, base, [])
    values = features(F.col("url"), statistics)
    blind = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(3)) == 0
    values |= {k: F.when(blind, 0.0).otherwise(values[k]) for k in ("suffix_word", "suffix_ending")}
    names = list(values)
    table = materialize(spark, known.select("label", *(v.alias(k) for k, v in values.items())).coalesce(1), "features")
    cuts = table.agg(*(F.percentile_approx(k, [i / bins for i in range(1, bins)], 10_000).alias(k) for k in names)).first().asDict()
    cuts = {k: sorted(set(v)) for k, v in cuts.items()}
    bins_of = F.array(*(F.struct(F.lit(k).alias("f"), _exceeded(v, k).alias("b")) for k, v in cuts.items()))
    table = table.withColumn("_bins", bins_of).withColumn("_m", F.lit(base))
    columns = {k: F.col(k) for k in names}
    model = Model(statistics, base, [])
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("_m")))
        table = table.withColumn("_g", F.col("label") - p).withColumn("_h", p * (1 - p)).coalesce(1)
        table = materialize(spark, table, "margins")
        tree = _grow(table, columns, cuts, depth, rate, least)
        if tree is None:
            break
        model.trees.append(tree)
        table = table.withColumn("_m", F.col("_m") + _walked(tree, columns)).drop("_g", "_h")
    return model


def _exceeded(cuts: list[float], column: str) -> Column:
    """How many cuts a value exceeds: its bin."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column)))


def _best_splits(histogram: list, cuts: dict[str, list[float]], least: int) -> dict[int, tuple]:
    """Of each node, the (feature, bin, low sums, high sums) with the largest gain; ties go by name."""
    sides: dict[tuple[int, str], dict[int, tuple]] = {}
    for r in histogram:
        sides.setdefault((r._n, r.f), {})[r.b] = (r.g, r.h, r.c)
    best: dict[int, tuple] = {}
    for (n, f), bins in sorted(sides.items()):
        total = [sum(v[i] for v in bins.values()) for i in range(3)]
        low = [0.0, 0.0, 0]
        for b in range(len(cuts[f])):
            low = [a + v for a, v in zip(low, bins.get(b, (0.0, 0.0, 0)), strict=True)]
            high = [t - a for t, a in zip(total, low, strict=True)]
            if min(low[2], high[2]) >= least:
                gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1) - total[0] ** 2 / (total[1] + 1)
                if gain > 1e-6 and (n not in best or gain > best[n][0] + 1e-9):
                    best[n] = (gain, f, b, tuple(low[:2]), tuple(high[:2]))
    return {n: v[1:] for n, v in best.items()}


def _grow(rows: DataFrame, columns: dict[str, Column], cuts: dict[str, list[float]], depth: int, rate: float, least: int):
    """A tree on the gradients ``_g`` and ``_h`` of ``rows``."""
    nodes: dict[int, tuple] = {}

    def place(k: int, level: int) -> Column:
        """The node of ``level`` that a row is at; 0 if it rests above."""
        if k >> level:
            return F.lit(k)
        if k not in nodes:
            return F.lit(0)
        return F.when(columns[nodes[k][0]] <= nodes[k][1], place(2 * k, level)).otherwise(place(2 * k + 1, level))

    for level in range(depth):
        sums = rows.withColumn("_n", place(1, level)).where("_n > 0").select("_n", "_g", "_h", F.explode("_bins").alias("x"))
        # At most 2 ** level nodes times the features times the bins: a few thousand rows.
        found = sums.groupBy("_n", "x.f", "x.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("c")).collect()
        for n, split in _best_splits(found, cuts, least).items():
            f, b, (g, h), (gg, hh) = split
            nodes[n] = (f, cuts[f][b], rate * g / (h + 1), rate * gg / (hh + 1))
        if not any(k >> level == 1 for k in nodes):
            break

    def build(k):
        f, cut, low, high = nodes[k]
        return (f, float(cut), build(2 * k) if 2 * k in nodes else float(round(low, 9)), build(2 * k + 1) if 2 * k + 1 in nodes else float(round(high, 9)))

    return build(1) if 1 in nodes else None


def judge(pages: DataFrame, model: Model, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages``.

    The verdict is the longest fitting rule's, else the model's: block where the score, the
    probability that the URL is one to block, is 0.5 or more. A null URL and one without
    ``://`` have an empty host and path. Null ids stay, repeated rows repeat, an empty table
    gives an empty result, and other columns are not read.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_u"))
    slim = slim.select("page_id", "_u", host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"))
    values = features(F.col("_u"), model.statistics)
    scored = slim.select("*", *(v.alias("_" + k) for k, v in values.items()))
    name, says = rule(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-model.margin({k: F.col("_" + k) for k in values})))
    out = scored.select("page_id", "host", "path", name.alias("rule"), says.alias("_s"), F.round(score, 9).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_s", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
