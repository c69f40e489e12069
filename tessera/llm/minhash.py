"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts makes, for each document, the sorted set of its word shingles, and from it the
   set's size and 128-bit digest, ``BINS`` MinHash values (a hash of its own each, so that they are independent
   in small sets too) and the keys of ``bands`` bands of ``ROWS`` values each.
2. Documents with the same set (the digest says so) are one class; only its smallest id goes on.
3. Star round: in each bucket of a band every class meets the bucket's smallest one.
4. Pairs are verified in batches of signature values: after n of them with m equal, the similarity has a
   Beta(m + 1, n - m + 1) posterior, and the pair is pruned when P(similarity >= threshold) < ``miss``.
   Survivors are verified exactly on their full shingle sets.
5. Connected components of the links.  In a large group of near copies the star round has found nearly all.
6. Rest round: in buckets whose classes are still in several components, all pairs across components; in
   buckets of over ``LARGE`` classes such pairs come from an exact filter on what sets them apart from the
   group's common core (``by_difference``), in place of enumeration.  No pair is dropped.
7. Components again, and from class to documents.

Nothing of the corpus goes to the driver but counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import stars
from ..ship import ensure
from .common import Scratch, WordHashes, id_type, map_text, mix, shingles

ROWS = 5
BINS = 256
BATCH = 32
#: Below so many shingles a pair goes to the exact check at once, which is cheap there.
SMALL = 64
LARGE = 16
#: Chosen miss probabilities: of a pair at the threshold in all bands together, and of one pruning step.
BAND_MISS = 1e-6
STEP_MISS = 1e-9
_PROBES = 16
#: Bins of the excess e between 0 and the core's share of it; see by_difference.
_BINS_TO_CORE = 6


def bands_for(percent: int, rows: int = ROWS, miss: float = BAND_MISS) -> int:
    """Bands that miss a pair at the threshold with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def least_equal(percent: int, miss: float = STEP_MISS) -> list[int]:
    """For 1, 2, ... batches: pairs with fewer equal values are pruned.  P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)."""
    out, t = [], percent / 100
    for n in range(BATCH, BINS + 1, BATCH):
        below, m = 0.0, -1
        while True:
            below += math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if below >= miss:
                break
            m += 1
        out.append(m + 1)
    return out


_FACTORS = np.random.default_rng(20240229).integers(0, 2**63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Elements that are hashed together, in the processor's cache.
_SPAN = 64


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set, value j the least of its elements times factor j; elements are mixed hashes."""
    low = np.zeros((len(sets), BINS), np.uint64)
    products = np.empty((_SPAN, BINS), np.uint64)
    for i, s in enumerate(sets):
        for at in range(0, len(s), _SPAN):
            part = s[at : at + _SPAN]
            least = np.multiply(part[:, None], _FACTORS, out=products[: len(part)]).min(axis=0)
            low[i] = np.minimum(low[i], least) if at else least
    return mix(low + np.uint64(1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One permutation: a row of BINS values for each set; sets are sorted, so a bin's smallest is the first at or after its edge.

    Empty bins copy full ones, so in sets of few elements the values are not independent.
    """
    edges = np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)
    sig = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            first = s[np.minimum(at, len(s) - 1)]
            full[i] = (at < len(s)) & (first >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
            sig[i] = np.where(full[i], first, 0)
    rng = np.random.default_rng(20240229)
    source = full.copy()
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    for turn in range(_PROBES):
        if not len(d):
            break
        to = rng.integers(0, BINS, BINS)[b]
        hit = source[d, to]
        sig[d[hit], b[hit]] = mix(sig[d[hit], to[hit]] + np.uint64(turn + 1))
        full[d[hit], b[hit]] = True
        d, b = d[~hit], b[~hit]
    if len(d):  # the next bin that was full from the start
        rows, inverse = np.unique(d, return_inverse=True)
        place = np.where(source[rows], np.arange(BINS), 2 * BINS)
        after = np.minimum.accumulate(np.concatenate([place, place + BINS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
        to = after[inverse, b]
        sig[d, b] = mix(sig[d, to] + np.uint64(_PROBES + 1))
    return mix(sig + np.uint64(1))


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band, from ROWS bins of a fixed shuffle; the band's number is part of it."""
    order = np.random.default_rng(7).permutation(BINS)
    at = np.concatenate([order, order[::-1]])[: bands * ROWS].reshape(bands, ROWS)
    weights = np.random.default_rng(11).integers(1, 2**63, (bands, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mix((sig[:, at] * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def describe(docs: DataFrame, bands: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, n, hi, lo, bands, sig of each row."""

    def work(part, texts):
        import xxhash

        table = WordHashes()
        sets = [shingles(t, table) for t in texts]
        sig = minhashes(sets)
        keys = band_keys(sig, bands).view(np.int64)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        short = (sig & np.uint64(0xFFFF)).astype("<u2")
        return {
            "id": part.column(0),
            "n": np.array([len(s) for s in sets], np.int64),
            "hi": halves[:, 0],
            "lo": halves[:, 1],
            "bands": pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1)),
            "sig": pa.array([r.tobytes() for r in short], pa.binary()),
        }

    return map_text(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")), work, "id long, n long, hi long, lo long, bands array<long>, sig binary")


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, siga, sigb): those that no batch prunes."""
    least = least_equal(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in (4, 5))
            small = np.minimum(*(batch.column(k).to_numpy() for k in (2, 3))) < SMALL
            live, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, m in enumerate(least):
                span = slice(i * BATCH, (i + 1) * BATCH)
                equal[live] += (x[live, span] == y[live, span]).sum(axis=1)
                live = live[(equal[live] >= m) | small[live]]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(live)) for k in range(4)], names=["a", "b", "na", "nb"])

    return pairs.mapInArrow(run, "a long, b long, na long, nb long")


def sized(percent: int, x: str = "na", y: str = "nb"):
    """What sizes alone allow."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


class NearDedup:
    """The steps above over one table.  ``components`` gives id, n_shingles, component_id for each row."""

    def __init__(self, docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id"):
        self.spark: SparkSession = docs.sparkSession
        ensure(self.spark)
        if (kind := id_type(docs, doc_id)) not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{doc_id} is {kind}; number the documents first")
        self.percent, self.text, self.doc_id = percent, text, doc_id
        self.docs = docs
        self.scratch = Scratch(self.spark, "near-dedup")

    # -- verification

    def exact(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose full sets are similar enough.  Only texts that survivors name are read into sets."""
        table = self.scratch.cut(pairs)
        if table.isEmpty():
            return table.select("a", "b")
        named = table.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.scratch.cut(self._sets(named, "binary"))
        left = table.join(sets.toDF("a", "sa"), "a")
        both = left.join(sets.toDF("b", "sb"), "b")
        percent = self.percent

        def check(batches):
            for batch in batches:
                keep = []
                for sa, sb in zip(batch.column(2), batch.column(3)):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (sa, sb))
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

        return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct()

    def verified(self, candidates: DataFrame, sig: DataFrame) -> DataFrame:
        """candidates (a, b, na, nb), each once."""
        pairs = candidates.join(sig.toDF("a", "siga"), "a").join(sig.toDF("b", "sigb"), "b").select("a", "b", "na", "nb", "siga", "sigb")
        return self.exact(plausible(pairs, self.percent))

    # -- components

    def labels(self, links: DataFrame) -> DataFrame:
        """(id, comp) of every id in ``links`` (a, b)."""
        return self.scratch.cut(stars(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "comp"))

    # -- the whole

    def components(self) -> DataFrame:
        bands = bands_for(self.percent)
        base = self.scratch.cut(describe(self.docs, bands, self.text, self.doc_id))
        rows = self.scratch.cut(base.select("id", "n", "hi", "lo"))
        there = rows.filter("n > 0 AND id IS NOT NULL")
        # A class is known by its smallest id.  Where rows repeat ids, one id may have several sets: there a class is known by a hash.
        self.repeats = there.select("id").distinct().count() < there.count()
        sets = there.groupBy("hi", "lo").agg(F.min("id").alias("top"))
        sets = self.classes = self.scratch.cut(sets.withColumn("node", F.xxhash64("hi", "lo") if self.repeats else F.col("top")))
        firsts = base.join(sets.withColumnRenamed("top", "id"), ["id", "hi", "lo"]).drop("id").withColumnRenamed("node", "id")
        firsts = self.scratch.cut((firsts.dropDuplicates(["id"]) if self.repeats else firsts).select("id", "n", "bands", "sig"))
        self.scratch.drop(base)
        sig = firsts.select("id", "sig")
        members = firsts.select("id", "n", F.explode("bands").alias("bucket"))
        met = self.scratch.cut(members.join(members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket"))
        star = met.filter("id <> first.id").select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.n").alias("na"), F.col("n").alias("nb")).filter(sized(self.percent)).distinct()
        links = self.scratch.cut(self.verified(star, sig))
        comp = self.labels(links)
        placed = met.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
        rest = self.scratch.cut(placed.join(mixed, "bucket", "left_semi").select("bucket", "id", "n", "comp", "size", F.col("first.id").alias("first")))
        more = self.across(rest).filter(sized(self.percent))
        found = self.scratch.cut(self.verified(more, sig))
        if not found.isEmpty():
            comp = self.labels(links.union(found))
        comp = comp.withColumnRenamed("id", "node")
        if self.repeats:
            comp = self.labels(links.union(found).union(self._same_id(there)))
            comp = comp.withColumnRenamed("id", "node")
        # The smallest id of each component, then of each set, then of each row.
        placed = sets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        low = placed.groupBy("comp").agg(F.min("top").alias("component_id"))
        out = rows.join(placed.join(low, "comp").select("hi", "lo", "component_id"), ["hi", "lo"], "left")
        linked = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id"))
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce(linked, "id").alias("component_id"))

    def _same_id(self, there: DataFrame) -> DataFrame:
        """(a, b): sets of one id, each with the first of them."""
        of = there.join(self.classes, ["hi", "lo"]).select("id", "node").distinct()
        first = of.groupBy("id").agg(F.min("node").alias("a"))
        return of.join(first, "id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    def across(self, rest: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) across components, of the same bucket; in large buckets by ``by_difference``."""
        x = rest.filter(F.col("size") <= LARGE)
        y = x.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("other"))
        pairs = x.select("bucket", F.col("id").alias("a"), F.col("n").alias("na"), "comp", "first").join(y, "bucket").filter("a < b AND comp <> other AND a <> first").select("a", "b", "na", "nb")
        pairs = pairs.distinct()
        crowd = self.scratch.cut(rest.filter(F.col("size") > LARGE).select("bucket", "id", "n", "comp", "first"))
        if crowd.isEmpty():
            return pairs
        return pairs.union(self.by_difference(crowd)).distinct()

    def _sets(self, ids: DataFrame, kind: str) -> DataFrame:
        """(id, s): the shingle sets of the classes ``ids``, read from the texts again; one row a class."""

        def work(part, texts):
            import xxhash

            table = WordHashes()
            sets = [shingles(t, table) for t in texts]
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            if kind == "binary":
                column = pa.array([s.tobytes() for s in sets], pa.binary())
            else:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                column = pa.ListArray.from_arrays(ends, np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
            return {"id": part.column(0), "s": column, "hi": halves[:, 0], "lo": halves[:, 1]}

        named = self.classes.join(ids.withColumnRenamed("id", "node"), "node").select(F.col("top").alias("id"), "hi", "lo", "node")
        docs = self.docs.select(F.col(f"`{self.doc_id}`").cast("long").alias("id"), F.col(f"`{self.text}`").cast("string").alias("text"))
        sets = map_text(docs.join(named.select("id"), "id", "left_semi"), work, f"id long, s {kind}, hi long, lo long")
        sets = sets.join(named, ["id", "hi", "lo"]).select(F.col("node").alias("id"), "s")
        return sets.dropDuplicates(["id"]) if self.repeats else sets

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Evenly over as many tasks as shuffles have: a small table of long arrays is read by few tasks, and explodes in them."""
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def by_difference(self, crowd: DataFrame) -> DataFrame:
        """Candidates across components of ``crowd`` (bucket, id, n, comp, first), none missed.

        Buckets that share members are one group.  A group's core is the shingles that most of its members have, and a
        member x is told by D(x), its symmetric difference to the core.  The difference of two members is that of
        D(x) and D(y), so with d = |D| and e = d - k n, where k = (1 - t) / (1 + t):
        x and y are similar enough if and only if e(x) + e(y) <= 2 |D(x) and D(y) shared|.
        If e(x) + e(y) <= 0 they are so whatever they share, and so is each with the member of smallest e: a star says it all.
        Otherwise they share c = (e(x) + e(y)) / 2 or more, and so one of the d - c + 1 rarest elements of each.
        Edits that no other member has come first in that order and meet nothing, which is what keeps
        large groups of edited copies from meeting in pairs.  Which bins of e the group has tells which elements anyone can meet.
        """
        k = (100 - self.percent) / (100 + self.percent)
        groups = self.labels(crowd.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))).withColumnRenamed("comp", "grp")
        members = self.scratch.cut(crowd.select("id", "n", "comp").distinct().join(groups, "id"))

        sets = self.scratch.cut(self._sets(members.select("id"), "array<long>").join(members, "id"))
        # Tables of a row a group are written, so that they meet members in plain joins: broadcast if small, else with hot groups split.
        size = self.scratch.cut(sets.groupBy("grp").agg(F.count(F.lit(1)).alias("members")))
        held = self._dealt(sets.select("grp", "s")).select("grp", F.explode("s").alias("token")).groupBy("grp", "token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        held = self.scratch.cut(self.scratch.cut(held).join(size, "grp").withColumn("common", F.col("df") * 2 > F.col("members")))
        core = self.scratch.cut(held.filter("common").groupBy("grp").agg(F.collect_list("token").alias("core")))
        told = sets.join(core, "grp", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
        told = told.withColumn("width", F.greatest(F.lit(1.0), F.size("core") * (k / _BINS_TO_CORE))).withColumn("diff", F.concat(F.array_except("s", "core"), F.array_except("core", "s")))
        told = told.withColumn("d", F.size("diff")).withColumn("e", F.col("d") - F.col("n") * k).withColumn("bin", F.least(F.lit(2 * _BINS_TO_CORE), F.floor(F.col("e") / F.col("width"))).cast("int"))
        told = self.scratch.cut(told.select("id", "grp", "n", "comp", "d", "e", "width", "bin", "diff"))
        nearest = self.scratch.cut(told.groupBy("grp").agg(F.min(F.struct("e", "id", "n", "comp")).alias("m"), F.collect_set("bin").alias("bins")))
        star = told.join(nearest.select("grp", "m"), "grp").filter((F.col("e") + F.col("m.e") <= 1e-6) & (F.col("comp") != F.col("m.comp")))
        star = star.select(F.least("id", "m.id").alias("a"), F.greatest("id", "m.id").alias("b"), F.when(F.col("id") < F.col("m.id"), F.col("n")).otherwise(F.col("m.n")).alias("na"), F.when(F.col("id") < F.col("m.id"), F.col("m.n")).otherwise(F.col("n")).alias("nb"))
        elements = self._dealt(told.select("id", "grp", "diff")).select("id", "grp", F.explode("diff").alias("token"))
        # A common shingle is an element of those that lack it, another one of those that have it.
        shared = held.withColumn("df", F.when(F.col("common"), F.col("members") - F.col("df")).otherwise(F.col("df"))).filter("df > 1").select("grp", "token", "df")
        ranked = elements.join(shared, ["grp", "token"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
        # Element r of the common ones is among the first d - c + 1 for partners whose bin is at most ``top``; a pair whose first shared
        # element this is shares no more than what is left of either.  Partners below ``low`` are the star's.
        heads = ranked.join(told.drop("diff"), "id").join(nearest.select("grp", "bins"), "grp")
        top = lambda r: F.floor((2 * (F.size("common") - r) - F.col("e")) / F.col("width") + 1e-6)
        low, last = F.floor(-F.col("e") / F.col("width") - 1e-6) - 1, 2 * _BINS_TO_CORE
        met = lambda x: F.exists("bins", lambda b: (b <= x["top"]) & ((b >= low) | (b == last)))
        element = lambda x, r: F.struct(x["token"].alias("token"), (F.size("common") - r).alias("left"), top(r).alias("top"))
        heads = heads.select("grp", "id", "n", "comp", "e", F.explode(F.filter(F.transform("common", element), met)).alias("x"))
        heads = self.scratch.cut(heads.select("grp", "id", "n", "comp", "e", "x.token", "x.left"))
        # Holders of an element that are all of one component need not meet, and of others each pair has one that is not of the largest.
        held_by = heads.groupBy("grp", "token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("grp", "token").agg(F.max(F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
        several = self.scratch.cut(held_by.filter("comps > 1").select("grp", "token", F.col("most.comp").alias("largest")))
        few = self.scratch.cut(heads.join(several, ["grp", "token"]).filter("comp <> largest").drop("largest"))
        y = heads.select("grp", "token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("comp_b"), F.col("e").alias("e_b"), F.col("left").alias("left_b"))
        pairs = few.withColumnsRenamed({"id": "a", "n": "na"}).join(y, ["grp", "token"]).filter("comp <> comp_b AND e + e_b > -1e-6 AND 2 * least(left, left_b) + 1e-6 >= e + e_b").filter(sized(self.percent))
        swap = F.col("a") > F.col("b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        return pairs.union(star.filter(sized(self.percent))).distinct()


def near_dedup(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable), kept (it is that id).

    Texts are linked when 100 * shared >= percent * united shingles.  Null or empty texts have no shingles and
    are linked with nothing.  Ids are whole numbers (of other types: TypeError).  A null doc_id has a null component, links with nothing and is kept.  Rows that
    repeat an id are one document, linked by any of its texts; each keeps its own n_shingles.  An empty table gives an empty result; other columns are not read.
    """
    out = NearDedup(docs, percent, text, doc_id).components()
    return out.select(F.col("id").alias(doc_id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that are not their component's smallest id.

    Rows of a null id, null or empty texts stay; rows that repeat an id stay or go together; an empty table stays one.  All columns are kept as they are.
    """
    gone = near_dedup(docs, percent, doc_id=doc_id).filter(~F.col("kept")).select(doc_id).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.node),
m AS (SELECT id, min(node) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m ON m.id = doc_id LEFT JOIN n USING (doc_id)
"""
