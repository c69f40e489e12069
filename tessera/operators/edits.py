"""Edits of graphs held as tables, lazily read leaves, paths, audits of what executes, and a retrieval index over chunks.

Nodes are (id, kind, label), edges (src, dst).  A rule is applied as a plan; nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import ledger_entry, over_groups

#: Dimensions of the hashed embedding of a chunk.
DIMENSIONS = 256


@dataclass(frozen=True)
class Rule:
    """add_node (label), remove_node (node), add_edge and remove_edge (src, dst), rewire (src, dst to new)."""

    kind: str
    label: str = ""
    node: int = -1
    src: int = -1
    dst: int = -1
    new: int = -1


def require(nodes: DataFrame, ids: list[int]) -> None:
    there = {r.id for r in nodes.filter(F.col("id").isin(ids)).select("id").distinct().collect()}  # of the few that a rule names
    if missing := [i for i in ids if i not in there]:
        raise ValueError(f"no node {missing[0]}")


def without_edge(edges: DataFrame, src: int, dst: int) -> DataFrame:
    found = (F.col("src") == src) & (F.col("dst") == dst)
    if edges.filter(found).isEmpty():
        raise ValueError(f"no edge from {src} to {dst}")
    return edges.filter(~found)


def apply_rule(nodes: DataFrame, edges: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after one rule.  A removed node takes its edges along; its id is not used again.  Nodes and edges that are not there are an error."""
    spark = nodes.sparkSession
    edge = lambda a, b: spark.createDataFrame([(a, b)], "src long, dst long")
    if rule.kind == "add_node":
        last = nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
        return nodes.unionByName(last.select((F.col("last") + 1).alias("id"), F.lit("Content").alias("kind"), F.lit(rule.label).alias("label"))), edges
    if rule.kind == "remove_node":
        require(nodes, [rule.node])
        return nodes.filter(F.col("id") != rule.node), edges.filter((F.col("src") != rule.node) & (F.col("dst") != rule.node))
    require(nodes, [rule.src, rule.dst] + ([rule.new] if rule.kind == "rewire" else []))
    if rule.kind == "add_edge":
        return nodes, edges.union(edge(rule.src, rule.dst))
    if rule.kind == "remove_edge":
        return nodes, without_edge(edges, rule.src, rule.dst)
    if rule.kind == "rewire":
        return nodes, without_edge(edges, rule.src, rule.dst).union(edge(rule.src, rule.new))
    raise ValueError(f"rule {rule.kind}")


def find_paths(asked: DataFrame, nodes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """``asked`` with ``found``: whether all parts of the path (slashes of either kind, empty ones skipped) are nodes already."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != "")
    key = asked.withColumn("key__", F.array_join(parts, "/"))
    known = nodes.select(F.col(prefix).alias("key__")).distinct().withColumn("hit__", F.lit(True))
    return key.join(known, "key__", "left").withColumn("found", (F.col("key__") == "") | F.col("hit__").isNotNull()).drop("key__", "hit__")


def resolved(leaves: DataFrame, bodies: DataFrame, key: str = "id") -> DataFrame:
    """``leaves`` (key, identity) with effective text, classes of its characters, and whether the body (key, body) is there; identity stands for what is not."""
    t = leaves.join(bodies.select(key, "body"), key, "left")
    text = F.coalesce("body", "identity")
    return t.select(key, "identity", F.col("body").isNotNull().alias("resolved"), text.alias("text"), T.char_classes(text).alias("signal"))


def execution_log(ordered: DataFrame, timestamp: int = 0) -> DataFrame:
    """(place, entry) for each Execution node of ``ordered`` (place, id, kind, label, text, glyph): the ledger's line, stamped in order.

    Numbered within the graph, which is a document.
    """
    n = F.row_number().over(Window.orderBy("place")) - 1
    ran = ordered.filter("kind = 'Execution'").withColumn("n__", n)
    description = F.concat(F.lit("execute_node id="), F.col("id").cast("string"), F.lit(" label_len="), F.octet_length("label").cast("string"), F.lit(" body_len="), F.octet_length("text").cast("string"), F.lit(" glyph="), F.col("glyph"))
    return ran.select("place", ledger_entry(F.col("n__"), description, memory_bytes=F.octet_length("text"), timestamp=F.col("n__") + timestamp).alias("entry"))


def token_hits(label: Column, query: str) -> Column:
    """How many words of the query, of three letters or more, the label has in it; case does not count, and a word counts as often as it is asked."""
    import re

    words = [w for w in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if len(w.encode()) > 2]
    low = T.ascii_lower(label)
    return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def active_nodes(nodes: DataFrame, query: str, budget: int, score: Column | None = None, key: str = "id") -> DataFrame:
    """The first ``budget`` nodes (one at least) by the size of ``score``, or by token hits; nodes without a label or score are out."""
    value = token_hits(F.col("label"), query) if score is None else F.abs(score)
    scored = nodes.filter(F.col("label") != "").withColumn("score", value).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(max(1, budget))


# --------------------------------------------------------------------------- retrieval


def embedded(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, dim, weight): the index of chunks, words hashed to DIMENSIONS, weights of length 1.  Rows are as many as a chunk has distinct words at most."""
    words = F.filter(F.split(T.ascii_lower(F.col(text)), r"[^0-9a-z\u0080-￿]+"), lambda w: w != "")
    dim = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"), F.lit(DIMENSIONS)).cast("int")
    counts = chunks.select(key, F.explode(words).alias("word")).groupBy(key, dim.alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("size"))
    return counts.join(size, key).select(key, "dim", (F.col("n") / F.col("size")).alias("weight"))


def retrieve(questions: DataFrame, index: DataFrame, most: int, question: str = "question", key: str = "key") -> DataFrame:
    """(question, key, score, place): for each question (question, dim, weight) the ``most`` chunks of highest cosine, of equal ones the smaller key.

    Questions are a stated set and broadcast; scores are summed a dimension at a time, so a chunk that shares no word costs nothing.
    """
    q = questions.select(question, "dim", F.col("weight").alias("w__"))
    scores = index.join(F.broadcast(q), "dim").groupBy(question, key).agg(F.sum(F.col("weight") * F.col("w__")).alias("score"))
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc(F.round("score", 9)), key))
    return scores.withColumn("place", place).filter(F.col("place") <= most)


# --------------------------------------------------------------------------- file events


class Tree:
    """Labelled nodes below a root, node 0, as file events leave them.  Removing a node leaves what is below it as it is, out of reach."""

    def __init__(self):
        self.label: dict[int, str] = {0: ""}
        self.up: dict[int, int | None] = {0: None}
        self.below: dict[int, list[int]] = {0: []}
        self.last = 0

    def child(self, node: int, label: str) -> int | None:
        return next((c for c in self.below[node] if self.label[c] == label), None)

    @staticmethod
    def parts(path: str) -> list[str]:
        return [p for p in path.replace("\\", "/").split("/") if p]

    def find(self, path: str) -> int | None:
        node: int | None = 0
        for part in self.parts(path):
            node = None if node is None else self.child(node, part)
        return node

    def create(self, path: str) -> int:
        node = 0
        for part in self.parts(path):
            found = self.child(node, part)
            if found is None:
                self.last = found = self.last + 1
                self.label[found], self.up[found], self.below[found] = part, node, []
                self.below[node].append(found)
            node = found
        return node

    def remove(self, path: str) -> None:
        node = self.find(path)
        if not node:  # nothing there, or the root, which stays
            return
        self.below[self.up[node]].remove(node) if self.up[node] is not None else None
        for c in self.below[node]:
            self.up[c] = None
        del self.label[node], self.up[node], self.below[node]


def apply_events(events: DataFrame, root: str = "root", order: str = "seq") -> DataFrame:
    """(root, id, label, parent) of each root's nodes after its ``events`` (root, seq, kind, path, to) in order: created, removed, renamed.

    What exists is not created again; what does not exist is not removed; renaming removes one path and creates the other.  Nodes that
    a removal left out of reach have no parent.  The tree of a root is its task's state; its events come batch by batch.
    """
    kind = dict(events.dtypes)[root]

    def start():
        tree = Tree()
        shown: dict[int, tuple] = {}

        def step(rows):
            for what, path, to in zip(rows["kind"].tolist(), rows["path"].tolist(), rows["to"].tolist()):
                if what in ("removed", "renamed"):
                    tree.remove(path)
                if what in ("created", "renamed"):
                    tree.create(to if what == "renamed" else path)
            # What has changed since the last batch: the last state of a node is the one that holds.
            now = {i: (tree.label[i], tree.up[i]) for i in tree.label}
            changed = [(i, *now.get(i, (None, None))) for i in {*now, *shown} if now.get(i) != shown.get(i)]
            shown.clear()
            shown.update(now)
            seen = int(rows[order].iloc[-1])
            return pd.DataFrame({root: [rows[root].iloc[0]] * len(changed), "at": [seen] * len(changed), "id": [c[0] for c in changed], "label": pd.Series([c[1] for c in changed], dtype=object), "parent": pd.array([c[2] for c in changed], dtype="Int64")})

        return step

    source = events.select(root, order, "kind", "path", F.coalesce("to", F.lit("")).alias("to"))
    out = over_groups(source, [root], [order], f"{root} {kind}, at long, id long, label string, parent long", start)
    return out.groupBy(root, "id").agg(F.max_by(F.struct("label", "parent"), "at").alias("n")).filter(F.col("n.label").isNotNull()).select(root, "id", "n.label", "n.parent")
