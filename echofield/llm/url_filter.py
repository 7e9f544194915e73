"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame expressions. Features are counted with built-in string functions. Trees are trained
by histogram boosting: the bounded training table is binned once, each level of a tree is one aggregation of
gradients by (node, feature, bin), and the driver sees only these sums. The trained trees are one CASE expression.
Suffix statistics (share and smoothed block rate of a host's last label) come from the training URLs; suffixes
with fewer than ``MIN_SUFFIX`` of them share one entry, so at most MAX_TRAIN / MIN_SUFFIX suffixes are kept.

Labelled URLs are an input, rows of (url, label). The query has no table of them, so ``seed_labels`` stands in: it marks
hosts that spell a word of a general list of unwanted trades. The words are no feature; the trees see lexical shape
only. A quarter of the URLs, by hash, is held out of training.

Defined results
    null url, or one without ``://``: empty host and path, no rule, judged by the trees like any other.
    equal longest rules: allow before block. repeated rows, null page_ids: each is judged. very long URLs: read whole.
    a URL with several labels counts once, as its highest. empty table: empty result.
    no training URL, or one class only: the trees say that class (allow if there is none).
    extra columns pass through, whatever their names; columns of the result replace equal names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import workspace

#: At most this many different labelled URLs are used for training, those of the smallest hashes.
MAX_TRAIN, MIN_SUFFIX = 20_000, 50
#: Hash draws are whole numbers below this.
SCALE = 1 << 40
TREES, DEPTH, BINS, SHRINK, MIN_HESSIAN = 10, 3, 16, 0.4, 2.0
#: Up to this many rules become one expression; more are joined on host suffixes.
INLINE_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# --- rules


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(verdict: str, text: str) -> UrlRule:
    host, slash, path = text.partition("/")
    return UrlRule(host, slash + path, verdict)


def inline_rules(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest is tested first, so it is wrapped last
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For many rules (host, path, verdict): (host, path, rule, verdict) of each distinct fitting pair.

    Pairs are expanded to their few host suffixes and joined on equality; the hosts of a popular suffix are
    distinct rows, and the adaptive planner divides what is still skewed.
    """
    pairs = urls.select("host", "path").distinct()
    wide = pairs.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    table = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    text = F.concat("suffix", "rule_path")
    rank = F.struct(F.length(text), (F.col("rule_verdict") == "allow").alias("allowed"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))
    hit = wide.join(table, "suffix").filter(F.col("path").startswith(F.col("rule_path")))
    return hit.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")


# --- features

CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-._"


def features(url: Column, host: Column, path: Column, suffixes: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Lexical features, each linear in the length of the URL."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(host)

    def count(text: Column, c: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    def term(k: Column) -> Column:
        return F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(F.lit(0.0))

    known = [count(host, c) for c in CHARACTERS]
    entropy = sum((term(k) for k in known), F.lit(0.0)) + term(n - sum(known, F.lit(0)))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    last = F.substring_index(host, ".", -1)
    other = suffixes.get("", (0.0, 0.0))
    share, rate = F.lit(other[0]), F.lit(other[1])
    for s, (a, b) in sorted(suffixes.items()):
        if s:
            share, rate = F.when(last == s, F.lit(a)).otherwise(share), F.when(last == s, F.lit(b)).otherwise(rate)
    return {
        "length": F.length(u).cast("double"),
        "host_length": n.cast("double"),
        "depth": count(path, "/").cast("double"),
        "path_length": F.length(path).cast("double"),
        "digit_ratio": F.when(F.length(u) > 0, digits / F.length(u)).otherwise(F.lit(0.0)),
        "host_entropy": F.when(n > 0, entropy).otherwise(F.lit(0.0)),
        "params": F.when(query != "", count(query, "&") + 1).otherwise(F.lit(0)).cast("double"),
        "host_hyphens": count(host, "-").cast("double"),
        "labels": F.when(n > 0, count(host, ".") + 1).otherwise(F.lit(0)).cast("double"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        "suffix_share": share,
        "suffix_rate": rate,
    }


NAMES = ["length", "host_length", "depth", "path_length", "digit_ratio", "host_entropy", "params", "host_hyphens", "labels", "longest_label", "suffix_share", "suffix_rate"]


def with_features(rows: DataFrame, keep: list[str], suffixes: dict[str, tuple[float, float]]) -> DataFrame:
    """keep and the features of rows that have url, host and path."""
    made = features(F.col("url"), F.col("host"), F.col("path"), suffixes)
    return rows.select(*keep, *[made[n].alias(n) for n in NAMES])


# --- trees


@dataclass(frozen=True)
class Split:
    feature: str
    at: float
    low: object
    high: object


@dataclass(frozen=True)
class TreeModel:
    base: float
    trees: tuple
    suffixes: dict

    def column(self) -> Column:
        """The log-odds of ``block`` over feature columns."""
        return sum((_tree_column(t) for t in self.trees), F.lit(self.base))


def _tree_column(node) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    return F.when(F.col(node.feature) <= node.at, _tree_column(node.low)).otherwise(_tree_column(node.high))


def _leaf_of(node, number: int, leaves: dict[int, Column], test: Column) -> None:
    """Number the open leaves of a growing tree, with the condition that leads there."""
    if isinstance(node, Split):
        here = F.col(node.feature) <= node.at
        _leaf_of(node.low, 2 * number, leaves, test & here)
        _leaf_of(node.high, 2 * number + 1, leaves, test & ~here)
    else:
        leaves[number] = test


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> TreeModel:
    """Learn from rows of (url, label), label 1 being block."""
    usable = labelled.filter(F.col("label").isNotNull()).select(F.coalesce("url", F.lit("")).alias("url"), "label")
    draw = F.pmod(F.xxhash64("url"), F.lit(SCALE))
    # a hash threshold leaves about the wanted number of URLs, whatever the input's size; only these few are ranked
    different = usable.agg(F.approx_count_distinct("url")).first()[0]
    drawn = usable.filter(draw <= int(min(1.0, 1.3 * max_rows / max(different, 1)) * SCALE))
    once = drawn.groupBy("url").agg(F.max(F.col("label").cast("double")).alias("y"))
    rows = once.orderBy(draw, "url").limit(max_rows)
    rows = workspace.written(rows.select("url", "y", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "url-train")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or positive in (0, n):
        return TreeModel(6.0 if n and positive else -6.0, (), {})
    prior = positive / n
    last = F.substring_index("host", ".", -1).alias("suffix")
    counted = rows.groupBy(last).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    kept = counted.filter((F.col("n") >= MIN_SUFFIX) & (F.col("suffix") != "")).collect()  # at most max_rows / MIN_SUFFIX
    suffixes = {r.suffix: (r.n / n, (r.y + 10 * prior) / (r.n + 10)) for r in kept}
    suffixes[""] = (0.0, prior)
    table = workspace.written(with_features(rows, ["y"], suffixes), "url-features")
    cuts = {}
    quantiles = table.agg(*[F.percentile(c, F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias(c) for c in NAMES]).first()
    for name in NAMES:
        cuts[name] = sorted(set(quantiles[name]))
    bins = F.array(*[
        F.struct(F.lit(i).alias("f"), sum(((F.col(c) > at).cast("int") for at in cuts[c]), F.lit(0)).alias("bin"))
        for i, c in enumerate(NAMES)
    ])
    table = workspace.written(table.withColumn("bins", bins), "url-bins")
    base = math.log(prior / (1 - prior))
    trees: list = []
    for _ in range(TREES):
        tree = _grow(table, TreeModel(base, tuple(trees), suffixes), cuts)
        if isinstance(tree, float):
            break
        trees.append(tree)
    return TreeModel(base, tuple(trees), suffixes)


def _grow(table: DataFrame, model: TreeModel, cuts: dict[str, list[float]]):
    """One tree, level by level; each level is one aggregation over the training table."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.column()))
    rows = table.select(*NAMES, "bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
    tree: object = None
    values: dict[int, float] = {}
    open_leaves = {1}
    for _ in range(DEPTH):
        leaves: dict[int, Column] = {}
        _leaf_of(tree, 1, leaves, F.lit(True))
        node = F.lit(0)
        for number, test in leaves.items():
            if number in open_leaves:
                node = F.when(test, F.lit(number)).otherwise(node)
        sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        binned = rows.select(node.alias("node"), "g", "h", F.explode("bins").alias("b")).filter(F.col("node") > 0)
        for r in binned.groupBy("node", "b.f", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r.node, {}).setdefault(r.f, {})[r.bin] = (r.g, r.h)
        following = set()
        for number, by_feature in sorted(sums.items()):
            best = _best_split(by_feature, cuts)
            if best is None:
                continue
            f, at, low, high = best
            values[2 * number], values[2 * number + 1] = low, high
            tree = _replace(tree, number, Split(NAMES[f], at, None, None))
            following |= {2 * number, 2 * number + 1}
        open_leaves = following
        if not following:
            break
    return 0.0 if tree is None else _filled(tree, 1, values)


def _best_split(by_feature, cuts):
    best, best_gain = None, 1e-3
    for f in sorted(by_feature):
        bins = by_feature[f]
        g, h = sum(v[0] for v in bins.values()), sum(v[1] for v in bins.values())
        gl = hl = 0.0
        for b in sorted(bins)[:-1]:
            gl, hl = gl + bins[b][0], hl + bins[b][1]
            if hl < MIN_HESSIAN or h - hl < MIN_HESSIAN:
                continue
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best_gain + 1e-9:
                best_gain = gain
                best = (f, cuts[NAMES[f]][b], -SHRINK * gl / (hl + 1), -SHRINK * (g - gl) / (h - hl + 1))
    return best


def _replace(node, number: int, new):
    """``node`` with its descendant ``number`` (children of k are 2k and 2k + 1) replaced."""
    turns = bin(number)[3:]
    if not turns:
        return new
    rest = int("1" + turns[1:], 2)
    if turns[0] == "0":
        return Split(node.feature, node.at, _replace(node.low, rest, new), node.high)
    return Split(node.feature, node.at, node.low, _replace(node.high, rest, new))


def _filled(node, number: int, values: dict[int, float]):
    if isinstance(node, Split):
        return Split(node.feature, node.at, _filled(node.low, 2 * number, values), _filled(node.high, 2 * number + 1, values))
    return float(values[number])


# --- verdicts


def judge(urls: DataFrame, model: TreeModel, rules: list[UrlRule] | DataFrame) -> DataFrame:
    """``urls`` plus host, path, rule, verdict and block_score. ``rules`` is a short list or a table."""
    packed = urls.select(F.struct("*").alias("__row"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        packed = packed.withColumn("__hit", inline_rules(rules, F.col("host"), F.col("path")))
    else:
        if isinstance(rules, list):
            rules = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
        hits = joined_rules(packed, rules).select("host", "path", F.struct("rule", "verdict").alias("__hit"))
        packed = packed.join(hits, ["host", "path"], "left")
    scored = with_features(packed, ["__row", "host", "path", "__hit"], model.suffixes).withColumn("__z", model.column())
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__z")))
    judged = scored.select(
        "__row",
        F.struct(
            "host",
            "path",
            F.col("__hit.rule").alias("rule"),
            F.coalesce(F.col("__hit.verdict"), F.when(F.col("__z") > 0, "block").otherwise("allow")).alias("verdict"),
            score.alias("block_score"),
        ).alias("__new"),
    )
    names = ["host", "path", "rule", "verdict", "block_score"]
    return judged.select(*[F.col("__row")[c].alias(c) for c in urls.columns if c not in names], *[F.col("__new")[c].alias(c) for c in names])


#: Words of unwanted trades, as filter lists name them; a part of a host label between hyphens that is one labels its URL.
SEED_WORDS = [
    "adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cams", "crack", "dating", "escort", "gambling", "hookup", "jackpot",
    "keygen", "loans", "lottery", "payday", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
]

RULES = [
    rule_of("block", "com/en/"),
    rule_of("allow", "example.com/en/7"),
    rule_of("allow", "net/de/"),
    rule_of("block", "example.net/de/8"),
    rule_of("block", "org/es/"),
]


def seed_labels(url: Column) -> Column:
    """1 where the host spells a seed word, else 0."""
    return F.arrays_overlap(F.split(host_of(url), r"[.\-]"), F.array(*[F.lit(x) for x in SEED_WORDS])).cast("int")


def held_out(url: Column) -> Column:
    """URLs that nothing may be learned from."""
    return F.pmod(F.xxhash64(F.lit(3), url), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: a verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    url = F.col("url")
    model = train(pages.filter(~held_out(url)).select("url", seed_labels(url).alias("label")))
    return judge(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")
