"""URL filters: rules first, then gradient-boosted trees on lexical features, with DataFrame functions only.

A url that a rule fits is judged by the longest one, and labels the url for training.  The trees learn from a bounded sample
of such urls: each level of each tree is one aggregation (gradient and hessian sums by leaf, feature and bin), of which the
driver sees at most leaves * features * BINS sums, and the fitted trees are one column of CASE expressions.

Two of the features are statistics of the labels: the share of blocks, and the count, among labelled urls with the same host
suffix (last two labels), and among those with the same first part of the path.  In training they are *out of fold*: hosts are
dealt to FOLDS folds by hash, and a url's statistics come from the other folds, so that no host names its own verdict.  Both are
drawn towards the share of the whole, which is all there is for a suffix that no label names; a third of the training urls are shown so,
that the trees learn to judge by what else there is.  One fold of urls is kept from the trees and sets the cut between allow and block.

The tables of statistics have no more rows than the sample has urls, so judging all urls is a projection with two broadcast joins.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, hash_share

#: Rules as (verdict, host, path): fixed values of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Distinct urls to train from, about (picked by hash; all, if there are fewer).
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 16, 0.4, 1.0
#: Folds; labels that a statistic's prior weighs.
FOLDS, PRIOR = 5, 2
#: One in so many training urls is shown without a statistic, so that the trees learn to judge suffixes that no label names.
UNSEEN = 3


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ok = url.isNotNull() & (at > 0)
    return F.when(ok, ascii_lower(host)).otherwise(""), F.when(ok, path).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (like ``net/es/``) and verdict of the longest rule that fits a host and its subdomains; else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Doubles that do not look anything up."""
    n = F.length(url)
    chars = F.split(url, "")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = n - F.length(F.translate(url, "0123456789", ""))
    last = F.element_at(F.split(host, r"\."), -1)
    out = {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "hyphens": n - F.length(F.translate(url, "-", "")),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "suffix_length": F.length(last),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


#: What label statistics are taken by.
KEYS = {"suffix": lambda: F.substring_index("host", ".", -2), "part": lambda: F.regexp_extract("path", "^/([^/]*)", 1)}


def host_fold(folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(folds))


class Trees:
    """A margin (log odds of block) over features, the label statistics that two of them are, and the cut."""

    def __init__(self, base: float, share: float, statistics: dict[str, DataFrame]):
        self.base, self.share, self.statistics = base, share, statistics
        self.trees: list = []
        self.cut = 0.0

    def smoothed(self, blocks: Column, count: Column) -> Column:
        return (blocks + PRIOR * self.share) / (count + PRIOR)

    def described(self, rows: DataFrame, own: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
        """``rows`` (url, host, path, ...) with a column f_<name> for each feature, and the names.  own: statistics of each fold, to leave
        the row's own fold out."""
        lexicals = lexical(F.col("url"), F.col("host"), F.col("path"))
        names = [*lexicals]
        rows = rows.select("*", *[c.alias(f"f_{k}") for k, c in lexicals.items()])
        zero = F.lit(0).cast("long")
        for key, column in KEYS.items():
            rows = rows.withColumn("key__", column()).join(F.broadcast(self.statistics[key].select(F.col(key).alias("key__"), "s", "c")), "key__", "left")
            s, c = F.coalesce("s", zero), F.coalesce("c", zero)
            if own:
                mine = own[key].select(F.col(key).alias("key__"), "fold", F.col("s").alias("s_own"), F.col("c").alias("c_own"))
                rows = rows.join(F.broadcast(mine), ["key__", "fold"], "left")
                shown = F.pmod(F.xxhash64("url", F.lit(key)), F.lit(UNSEEN)) != 0
                s, c = (F.when(shown, x - F.coalesce(y, zero)).otherwise(zero) for x, y in ((s, F.col("s_own")), (c, F.col("c_own"))))
            rows = rows.withColumns({f"f_{key}_share": self.smoothed(s, c), f"f_{key}_count": F.log1p(c)}).drop("key__", "s", "c", "s_own", "c_own")
            names += [f"{key}_share", f"{key}_count"]
        return rows, names

    def margin(self) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, low, high = node
            return F.when(F.col(f"f_{name}") <= F.lit(cut), walk(low)).otherwise(walk(high))

        return reduce(lambda a, t: a + walk(t), self.trees, F.lit(self.base))

    def score(self) -> Column:
        """Probability of block, a half at the cut."""
        return 1 / (1 + F.exp(self.cut - self.margin()))


def train(labelled: DataFrame, scratch: Scratch) -> Trees:
    """labelled: (url, host, path, y), y 1 for block.  Without both labels the margin is constant."""
    labelled = scratch.cut(labelled.withColumn("fold", host_fold()))
    own = {key: scratch.cut(labelled.groupBy(column().alias(key), "fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("c"))) for key, column in KEYS.items()}
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (blocked + 1) / (n + 2)
    out = Trees(math.log(share / (1 - share)), share, {key: scratch.cut(t.groupBy(key).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))) for key, t in own.items()})
    if not 0 < blocked < n:
        out.base = 6.0 if blocked else -6.0
        return out
    data, names = out.described(labelled, own)
    kept = F.pmod(F.xxhash64(F.lit("cut"), "url"), F.lit(FOLDS)) == 0
    data = scratch.cut(data.select("y", kept.alias("kept"), *[f"f_{k}" for k in names]))
    seen = data.filter("NOT kept")
    edges = seen.agg(*[F.percentile_approx(f"f_{k}", [i / BINS for i in range(1, BINS)], 1000).alias(k) for k in names]).first()
    cuts = {k: sorted(set(edges[k] or [])) for k in names}
    bins = F.array(*[F.struct(F.lit(i).alias("f"), sum((F.when(F.col(f"f_{k}") > c, 1).otherwise(0) for c in cuts[k]), F.lit(0)).alias("bin")) for i, k in enumerate(names)])
    seen = scratch.cut(seen.withColumn("bins", bins))
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-out.margin()))
        state = scratch.cut(seen.withColumn("g", F.col("y") - p).withColumn("h", p * (1 - p)))
        out.trees.append(grow(state, names, cuts))
        scratch.drop(state)
    out.cut = best_cut(data.filter("kept").select("y", F.round(out.margin(), 6).alias("margin")))
    return out


def best_cut(held: DataFrame) -> float:
    """The cut with most right verdicts over (y, margin), the nearest to 0 of equally good ones; 0 without both labels."""
    rows = sorted((r.margin, r.n, r.b) for r in held.groupBy("margin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).collect())  # rows: one a leaf combination
    if not 0 < sum(b for _, _, b in rows) < sum(n for _, n, _ in rows):
        return 0.0
    right = sum(b for _, _, b in rows)  # all blocked
    found = [(-right, 1e9, rows[0][0] - 1e-3)]
    for k, (m, n, b) in enumerate(rows):
        right += n - 2 * b
        cut = (m + rows[k + 1][0]) / 2 if k + 1 < len(rows) else m + 1e-3
        found.append((-right, abs(cut), cut))
    if (at_zero := sum(b if m >= 0 else n - b for m, n, b in rows)) == -min(found)[0]:
        return 0.0
    assert at_zero <= -min(found)[0]
    return min(found)[2]


def grow(state: DataFrame, names: list[str], cuts: dict[str, list[float]]):
    """One tree on gradients g and hessians h, level by level."""
    tree: dict[int, tuple] = {}  # node number -> (feature, cut); children 2k and 2k + 1
    values: dict[int, float] = {}
    for level in range(DEPTH + 1):
        leaf = F.lit(1)
        for k, (i, cut) in sorted(tree.items()):
            leaf = F.when(leaf == k, F.when(F.col(f"f_{names[i]}") <= F.lit(cut), 2 * k).otherwise(2 * k + 1)).otherwise(leaf)
        sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        cells = state.select(leaf.alias("leaf"), "g", "h", F.explode("bins").alias("b")).groupBy("leaf", "b.f", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        for r in cells.collect():
            sums.setdefault(r.leaf, {}).setdefault(r.f, {})[r.bin] = (r.g, r.h)
        for k, by_feature in sorted(sums.items()):
            if k.bit_length() - 1 != level:
                continue
            total_g, total_h = (sum(v[j] for v in by_feature[0].values()) for j in (0, 1))
            values[k] = RATE * total_g / (total_h + RIDGE)
            best = (1e-6, None)
            for i, by_bin in sorted(by_feature.items()):
                g = h = 0.0
                for b in range(len(cuts[names[i]])):
                    x = by_bin.get(b, (0.0, 0.0))
                    g, h = g + x[0], h + x[1]
                    gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                    if h > 1e-3 and total_h - h > 1e-3 and gain > best[0] + 1e-9:
                        best = (gain, (i, float(cuts[names[i]][b])))
            if level < DEPTH and best[1]:
                tree[k] = best[1]

    def build(k: int):
        if k not in tree or (2 * k not in values and 2 * k + 1 not in values):
            return float(values.get(k, 0.0))
        i, cut = tree[k]
        return (names[i], cut, build(2 * k), build(2 * k + 1))

    return build(1)


def ruled(pages: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, host, path, rule, ruled): url is empty for null; rule and its verdict are null where none fits."""
    u = F.col("url")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    host, path = split_url(u)
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": verdict, "url": F.coalesce(u, F.lit(""))})


def fit(rows: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Trees:
    """Trees from about 1.2 * ``sample`` distinct urls at most of ``ruled`` rows that a rule fits, picked by hash."""
    labelled = rows.filter(F.col("ruled").isNotNull())
    n = labelled.agg(F.approx_count_distinct("url", 0.01)).first()[0]
    picked = labelled.filter(hash_share(n, sample, "url")).select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("y")).distinct()
    return train(picked, scratch)


def judge(pages: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row; score is the trees' probability of block.

    Trained from about 1.2 * ``sample`` distinct urls at most that a rule fits, picked by hash.  Null urls and urls
    without ``://`` have an empty host and path and no rule, and are judged by the trees like others (a null url
    as an empty one).  With labels of one kind only the verdict is that kind; without any, allow.  Repeated rows and null
    ids stay; an empty table gives no rows; no other column is read.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    rows = ruled(pages, rules, url, page_id)
    trees = fit(rows, scratch, sample)
    scored = trees.described(rows)[0].withColumn("score", trees.score())
    said = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("page_id").alias(page_id), "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "score")


def held_out(pages: DataFrame, rules=RULES, url: str = "url", fold: int = 0) -> tuple[int, int, int]:
    """Of urls that a rule fits, on the hosts of one fold, from which nothing is learnt: how many there are, how many the trees judge as the
    rule does, and how many the commoner verdict of the other hosts is right on."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    rows = ruled(pages, rules, url, url).filter(F.col("ruled").isNotNull()).withColumn("y", (F.col("ruled") == "block").cast("int"))
    test = host_fold() == fold
    trees = fit(rows.filter(~test), scratch)
    usual = int(trees.share >= 0.5)
    said = trees.described(rows.filter(test))[0].withColumn("said", (trees.score() >= 0.5).cast("int"))
    return tuple(said.agg(F.count(F.lit(1)), F.count_if(F.col("said") == F.col("y")), F.count_if(F.col("y") == usual)).first())


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
