"""Graphs as (src, dst) tables: components, bounded reach, topological order, degrees, lineage, haplotype blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Rounds
from ..ship import ensure


#: Edges that one task contracts together; what is left of all edges is finished by one task, if it is no more.
TOGETHER = 1 << 22
#: Ids whose edges are contracted in one task, if they are not too many.
NEAR = 1 << 14


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges as stars around their smallest ids."""
    ids = np.concatenate([u, v])
    least, most = (int(ids.min()), int(ids.max())) if len(ids) else (0, -1)
    if most - least < 2 * len(ids):  # dense: each id is its own place, without a sort
        ids, u, v = np.arange(least, most + 1), u - least, v - least
    else:
        ids, at = np.unique(ids, return_inverse=True)
        u, v = at[: len(u)], at[len(u) :]
    top = np.arange(len(ids))
    while (apart := top[u] != top[v]).any():
        x, y = top[u[apart]], top[v[apart]]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    inner = np.flatnonzero(top != np.arange(len(ids)))
    return ids[inner], ids[top[inner]]


def contracted(batches):
    """A task's edges (u, v) as stars, of TOGETHER edges or more at a time: they are put together as often as they have doubled."""
    held, waiting, n = (np.empty(0, np.int64),) * 2, [], 0

    def together():
        return forest(*(np.concatenate([held[k], *(w[k] for w in waiting)]) for k in (0, 1)))

    for b in batches:
        waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= max(1 << 16, len(held[0])):
            held, waiting, n = together(), [], 0
            if len(held[0]) >= TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["u", "v"])
                held = (np.empty(0, np.int64),) * 2
    held = together()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["u", "v"])


def stars(edges: DataFrame, near: bool = False) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (src, dst) reaches over them, undirected; an id that has only an edge to itself is left out.

    Where near ids are linked (``near``), edges are first dealt by ranges of ids.  Each task puts a spanning star in place of each component of its
    edges, which leaves fewer edges than nodes a task.  If no more than
    TOGETHER are left, one task does the same with them, and that is all; else large-star and small-star rounds follow until nothing changes.
    Each step is written, so lineage stays short.
    """
    rounds = Rounds(edges.sparkSession, "components")
    ensure(edges.sparkSession)
    pairs = edges.filter("src <> dst").select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    if near:
        pairs = pairs.withColumn("near", F.floor(F.col("u") / NEAR)).hint("rebalance", "near").select("u", "v")
    now = rounds.cut(pairs.mapInArrow(contracted, "u long, v long").distinct())
    if now.count() <= TOGETHER:
        return labelled(rounds.cut(now.coalesce(1).mapInArrow(contracted, "u long, v long")))
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # As a table of its own it meets the edges in a plain join of two exchanges, where Spark can split those of a hub.
        low = rounds.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = rounds.cut(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        pairs = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = rounds.cut(pairs.select("u", F.col("m").alias("v")).union(pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rounds.drop(now, low, large)
        now = after
        if state == seen:
            break
        seen = state
    return labelled(now)


def labelled(found: DataFrame) -> DataFrame:
    """(id, component) of stars (u, v)."""
    return found.select(F.col("u").alias("id"), F.col("v").alias("component")).union(found.select("v", "v").distinct())


def components(nodes: DataFrame, edges: DataFrame, near: bool = False) -> DataFrame:
    """(id, component): the smallest id that each of ``nodes`` (id) reaches over undirected ``edges`` (src, dst).

    Every node has a component, one without edges its own.
    """
    return nodes.select("id").join(stars(edges, near), "id", "left").withColumn("component", F.coalesce("component", "id"))


def haplotype_blocks(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block_id, first_snp, n_snps, mean_r_squared, start_position, end_position): components of linked variants.

    Singletons are blocks.  Blocks are numbered by their smallest member; the mean is over links that exist (null without).
    Links are written once, if they are not yet: they are read for the components and for the means.
    """
    if not hasattr(pairs, "_round_path"):
        pairs = Rounds(pairs.sparkSession, "links").cut(pairs.select("snp1_idx", "snp2_idx", "r_squared"))
    found = components(genotypes.select(F.col("snp_idx").alias("id")), pairs.select(F.col("snp1_idx").alias("src"), F.col("snp2_idx").alias("dst")), near=True)
    placed = genotypes.select("chr", F.col("snp_idx").alias("id"), "position").join(found, "id")
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n_snps"), F.min("position").alias("start_position"), F.max("position").alias("end_position"))
    each = pairs.groupBy(F.col("snp1_idx").alias("id")).agg(F.sum("r_squared").alias("total"), F.count("r_squared").alias("links"))  # before the join: fewer rows
    r2 = each.join(found, "id").groupBy("component").agg((F.sum("total") / F.sum("links")).alias("mean_r_squared"))
    # Numbered without one task for all: ranks within ranges of the first member, offset by the ranges' counts.
    return numbered(size.join(r2, "component", "left").withColumnRenamed("component", "first_snp"), "first_snp", "block_id")


def numbered(df: DataFrame, key: str, name: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with gapless numbers from 0 in order of the integer ``key``; ranges of ``width`` keys are numbered apart."""
    df = df.withColumn("range__", F.floor(F.col(key) / width))
    per = df.groupBy("range__").agg(F.count(F.lit(1)).alias("n__"))
    per = per.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    rank = F.row_number().over(Window.partitionBy("range__").orderBy(key))
    return df.withColumn("rank__", rank).join(per, "range__").withColumn(name, (F.col("before__") + F.col("rank__") - 1).cast("long")).drop("range__", "rank__", "before__")


def block_statistics(blocks: DataFrame) -> DataFrame:
    """One row: blocks, mean, median (of integers, halves cut), smallest and largest size, mean r^2, mean span."""
    return blocks.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.avg("n_snps").alias("mean_size"),
        F.floor(F.percentile("n_snps", 0.5)).cast("long").alias("median_size"),
        F.min("n_snps").alias("min_size"),
        F.max("n_snps").alias("max_size"),
        F.avg("mean_r_squared").alias("mean_r_squared"),
        F.avg(F.col("end_position") - F.col("start_position")).alias("mean_span"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(start, id, depth) of all nodes within ``depth`` undirected steps of each of ``starts`` (id), itself at 0."""
    rounds = Rounds(edges.sparkSession, "reach")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, front["id"] == both["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = rounds.cut(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def within(edges: DataFrame, starts: DataFrame, depth: int = 5, most: int = 3) -> DataFrame:
    """(id) of all nodes within ``depth`` undirected steps of any of ``starts`` (id) that reaches more than ``most`` nodes, itself included.

    Each step that is not the last reaches a node more, so with ``depth`` of ``most`` or more a start reaches more than ``most`` if its
    component has them.  The nodes around all such starts are found together, without a row for each start and node.
    """
    if depth < most:
        raise ValueError(f"depth {depth} under {most}")
    rounds = Rounds(edges.sparkSession, "within")
    component = stars(edges, near=True)
    large = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    in_large = component.join(large, "component", "left_semi").select("id")
    chosen = starts.select("id").distinct()
    seen = front = rounds.cut(chosen.join(in_large, "id", "left_semi") if most else chosen)
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    for _ in range(depth):
        step = both.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = rounds.cut(step.join(seen, "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, place) by Kahn's rule, smallest id first; one task a graph, as order within a graph is sequential.

    nodes: (graph_id, id); edges: (graph_id, src, dst).  A cycle gives null places for what it holds back.
    """
    rows = nodes.select("graph_id", "id", F.lit(None).cast("long").alias("dst")).union(edges.select("graph_id", "src", "dst"))

    def order(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links = pdf[pdf["dst"].notna()]
        ids = sorted(set(pdf["id"]) | set(links["dst"].astype("int64")))
        after = {i: [] for i in ids}
        waits = dict.fromkeys(ids, 0)
        for s, d in zip(links["id"], links["dst"].astype("int64")):
            after[s].append(d)
            waits[d] += 1
        ready = [i for i in ids if not waits[i]]
        heapq.heapify(ready)
        place = {}
        while ready:
            i = heapq.heappop(ready)
            place[i] = len(place)
            for d in after[i]:
                waits[d] -= 1
                if not waits[d]:
                    heapq.heappush(ready, d)
        return pd.DataFrame({"graph_id": key[0], "id": ids, "place": pd.array([place.get(i) for i in ids], dtype="Int64")})

    ensure(nodes.sparkSession)
    return rows.groupBy("graph_id").applyInPandas(order, "graph_id long, id long, place long")


def fingerprint(ordered: DataFrame) -> DataFrame:
    """(graph_id, fingerprint): SHA-256 over (place, id, label) in order."""
    line = F.concat_ws(":", F.col("place").cast("string"), F.col("id").cast("string"))
    return ordered.groupBy("graph_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "|"), 256).alias("fingerprint"))


def paths(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Nodes (prefix, label, parent, depth) and edges (src, dst) of the tree that slash-separated paths make."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    each = df.select(F.posexplode(parts).alias("depth", "label"), parts.alias("parts"))
    prefix = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    nodes = each.select(prefix(F.col("depth") + 1).alias("prefix"), "label", F.when(F.col("depth") > 0, prefix(F.col("depth"))).alias("parent"), "depth").distinct()
    return nodes, nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("src"), F.col("prefix").alias("dst"))


def lineage(slots: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, slot_id, step) up the parent pointers of ``slots`` (slot_id, parent_id null at the root) from each start to its root.

    Slots are known by slot_id.  Pointers are doubled until none is left, in as many rounds as the longest walk has binary
    digits, and the walks then from the longest pointers down.  Pointers that are left after more steps than there are slots
    are a cycle, which is an error.
    """
    rounds = Rounds(slots.sparkSession, "lineage")
    jump = rounds.cut(slots.filter(F.col("slot_id").isNotNull() & F.col("parent_id").isNotNull()).select("slot_id", F.col("parent_id").alias("up")))
    count, jumps = jump.count(), []
    while not jump.isEmpty():
        if 1 << len(jumps) > count:
            raise ValueError("parent pointers make a cycle")
        jumps.append(jump)
        jump = rounds.cut(jump.join(jump.select(F.col("slot_id").alias("up"), F.col("up").alias("next")), "up").select("slot_id", F.col("next").alias("up")))
    out = starts.select(F.col("slot_id").alias("start"), "slot_id", F.lit(0).cast("long").alias("step"))
    for k in reversed(range(len(jumps))):
        far = out.join(jumps[k], "slot_id").select("start", F.col("up").alias("slot_id"), (F.col("step") + (1 << k)).alias("step"))
        out = rounds.cut(out.union(far))
    return out.select("start", "slot_id", F.col("step").cast("int").alias("step"))


def ranked(df: DataFrame, group: str, order: list[str], rank: str, count: str) -> DataFrame:
    """``df`` with each row's rank from 1 in its group by ``order``, and the group's count.

    Rows are dealt by ranges of (group, order), so no group is one task; a row's rank is its place in its range after the counts of
    the group's ranges before.  Rows that agree in all of ``order`` have any of their ranks.
    """
    ranged = df.repartitionByRange(group, *order).withColumn("range__", F.spark_partition_id())
    ranged = Rounds(df.sparkSession, "ranked").cut(ranged)
    held = ranged.groupBy(group, "range__").agg(F.count(F.lit(1)).alias("held__"))
    per = Window.partitionBy(group)
    before = F.sum("held__").over(per.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(group, "range__", F.coalesce(before, F.lit(0)).alias("before__"), F.sum("held__").over(per).alias(count))  # a row a range
    place = F.row_number().over(Window.partitionBy(group, "range__").orderBy(*order))
    return ranged.withColumn("place__", place).join(held, [group, "range__"]).withColumn(rank, F.col("before__") + F.col("place__")).drop("range__", "place__", "before__")


def drop_weakest(edges: DataFrame, share: float, group: str = "chr", weight: str = "weight", key: str = "id") -> DataFrame:
    """Without the floor(n * share) lightest edges of each group; share up to a half, groups of under four edges stay whole.

    The cut is a count over a rank; ties go by ``key``.
    """
    share = min(share, 0.5)
    out = ranked(edges, group, [weight, key], "rank__", "n__")
    return out.filter((F.col("n__") < 4) | (F.col("rank__") > F.floor(F.col("n__") * share))).select(*edges.columns)
