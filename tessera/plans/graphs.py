"""Queries of graph edits, paths, leaves, execution logs, activation and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import documents, edits, folds, graph
from .domain import TICKS_SQL, read, ticks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def atlas(spark, sf_dir):
    """Nations below regions, as a graph."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    top, below = (100 + F.col("r_regionkey")).cast("long"), F.col("n_nationkey").cast("long")
    nodes = n.select(below.alias("id"), F.lit("Content").alias("kind"), F.col("n_name").alias("label")).union(r.select(top, F.lit("Content"), "r_name"))
    return nodes, n.select((100 + F.col("n_regionkey")).cast("long").alias("src"), below.alias("dst"))


#: A mutation in six rules.
RULES = (edits.Rule("add_node", label="new"), edits.Rule("add_edge", src=100, dst=105), edits.Rule("remove_node", node=3), edits.Rule("rewire", src=100, dst=0, new=1), edits.Rule("add_edge", src=0, dst=1), edits.Rule("remove_edge", src=0, dst=1))


@query(
    "graph_edits",
    "WITH e AS (SELECT 100 + n_regionkey::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation WHERE n_nationkey <> 3 AND NOT (n_regionkey = 0 AND n_nationkey = 0) UNION ALL SELECT 100, 105 UNION ALL SELECT 100, 1) SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2",
)
def graph_edits(spark, sf_dir):
    """Edges after nodes and edges were added, removed and rewired."""
    nodes, edges = atlas(spark, sf_dir)
    for rule in RULES:
        nodes, edges = edits.apply_rule(nodes, edges, rule)
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


_PATHS_SQL = r"""f AS (SELECT list_filter(string_split(regexp_replace(url, '^[^:]*://', ''), '/'), lambda x: x <> '') AS parts FROM pages WHERE page_id % 2 = 0), n AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS prefix FROM f, unnest(range(1, len(parts) + 1)) AS t(i)),
a AS (SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[^:]*://', ''), '/'), lambda x: x <> '')[1:2], '/') AS path FROM pages)"""


@query("find_paths", f"WITH {_PATHS_SQL} SELECT page_id, path IN (SELECT prefix FROM n) AS found FROM a")
def find_paths(spark, sf_dir):
    """Whether host and first part of each page are in the tree of every second page."""
    p = read(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", "^[^:]*://", ""))
    nodes, _ = graph.paths(p.filter("page_id % 2 = 0"))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    asked = p.select("page_id", F.array_join(F.slice(parts, 1, 2), "/").alias("path"))
    return edits.find_paths(asked, nodes).select("page_id", "found")


@query("lazy_leaves", r"WITH t AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html END AS body, url FROM pages), x AS (SELECT page_id, body IS NOT NULL AS resolved, coalesce(body, url) AS t FROM t) SELECT page_id, resolved, length(t) AS n, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper FROM x")
def lazy_leaves(spark, sf_dir):
    """Pages by their urls until their bodies are read."""
    p = read(spark, sf_dir, "pages")
    t = edits.resolved(p.select("page_id", F.col("url").alias("identity")), p.filter("page_id % 2 = 0").select("page_id", F.col("html").alias("body")), "page_id")
    return t.select("page_id", "resolved", F.length("text").cast("long").alias("n"), F.col("signal.upper").alias("upper"))


@query("execution_log", "WITH o AS (SELECT p_partkey - 1 AS place, p_partkey AS id, p_name AS label, p_name || ' ' || p_brand AS text, p_partkey % 5 = 0 AS runs FROM part), r AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS n FROM o WHERE runs) SELECT place, sha256('{\"mutation_id\":' || n || ',\"description\":\"execute_node id=' || id || ' label_len=' || length(label) || ' body_len=' || length(text) || ' glyph=' || id % 16 || '\",\"pre_fingerprint\":0,\"post_fingerprint\":0,\"latency_us\":0,\"memory_bytes\":' || length(text) || ',\"outcome\":\"Accepted\",\"budget_ns\":0,\"timestamp\":' || (n + 7) || '}') AS entry_hash FROM r")
def execution_log(spark, sf_dir):
    """Ledger lines of the nodes that execute, in order."""
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 5 == 0, "Execution").otherwise("Content")
    o = p.select((F.col("p_partkey") - 1).alias("place"), F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("label"), F.concat("p_name", F.lit(" "), "p_brand").alias("text"), (F.col("p_partkey") % 16).cast("string").alias("glyph"))
    return edits.execution_log(o, 7).select("place", F.sha2("entry", 256).alias("entry_hash"))


_ASKED = "Which blue steel Part, of the part!"


@query("active_nodes", "WITH s AS (SELECT p_partkey AS id, (contains(lower(p_name), 'which')::INTEGER + contains(lower(p_name), 'blue')::INTEGER + contains(lower(p_name), 'steel')::INTEGER + 2 * contains(lower(p_name), 'part')::INTEGER + contains(lower(p_name), 'the')::INTEGER) AS score FROM part) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 12")
def active_nodes(spark, sf_dir):
    """The twelve labels that have most words of a question."""
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return edits.active_nodes(nodes, _ASKED, 12).select("id", "score")


_INDEX_SQL = r"""w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{ffff}]+'), lambda x: x <> '')) AS word FROM {source}),
h AS (SELECT item_id, substr(md5(word), 7, 2) AS hx FROM w), c AS (SELECT item_id, (instr('0123456789abcdef', hx[1]) - 1) * 16 + instr('0123456789abcdef', hx[2]) - 1 AS dim, count(*) AS n FROM h GROUP BY 1, 2), z AS (SELECT item_id, sqrt(sum(n * n)::DOUBLE) AS size FROM c GROUP BY 1),
e AS (SELECT c.item_id, dim, n / size AS weight FROM c JOIN z USING (item_id))"""


@query("chunk_retrieval", "WITH " + _INDEX_SQL.replace("{source}", "benchmark") + ", s AS (SELECT q.item_id AS question, e.item_id AS key, sum(q.weight * e.weight) AS score FROM e q JOIN e ON e.dim = q.dim WHERE q.item_id % 20 = 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, key)::INTEGER AS place FROM s) SELECT question, key, round(score, 6) AS score, place FROM r WHERE place <= 3")
def chunk_retrieval(spark, sf_dir):
    """The three nearest passages of every twentieth, which is first itself."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    index = edits.embedded(b, "key")
    asked = index.filter("key % 20 = 0").withColumnRenamed("key", "question")
    return edits.retrieve(asked, index, 3).select("question", "key", F.round("score", 6).alias("score"), "place")


@query("chunk_index")
def chunk_index(spark, sf_dir):
    """The retrieval index over all chunks of all documents, by chunk and dimension; no SQL, as the chunks have none."""
    c = documents.chunks(read(spark, sf_dir, "documents")).withColumn("key", F.struct("doc_id", "chunk"))
    return edits.embedded(c, "key").groupBy("dim").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.sum("weight"), 4).alias("total"))


@query("ledger_safety", f"WITH {TICKS_SQL} SELECT batch_id, CASE WHEN batch_id % 3 = 0 AND max(tick) >= 5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety FROM t GROUP BY batch_id")
def ledger_safety(spark, sf_dir):
    """1 for a ledger that verifies, else 0; every third one is tampered with at its fifth tick."""
    e = ticks(spark, sf_dir).select("batch_id", "tick", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("content"))
    stored = folds.chain(e, "batch_id", "tick", "content").join(e, ["batch_id", "tick"])
    stored = stored.withColumn("content", F.when((F.col("batch_id") % 3 == 0) & (F.col("tick") == 5), F.lit("tampered")).otherwise(F.col("content")))
    broken = folds.verify_chain(stored, "batch_id", "tick", "content").select("batch_id").distinct().withColumn("bad", F.lit(True))
    return e.select("batch_id").distinct().join(broken, "batch_id", "left").select("batch_id", F.when(F.col("bad"), 0.0).otherwise(1.0).alias("safety"))


@query("task_scores", "SELECT p_partkey, round(least(1, greatest(0, CASE WHEN p_size % 4 = 0 THEN g ELSE 0.55::DOUBLE * c + 0.45::DOUBLE * g END)), 6) AS task FROM (SELECT p_partkey, p_size, (p_size % 11) / 10.0::DOUBLE AS c, (p_partkey % 13) / 12.0::DOUBLE AS g FROM part)")
def task_scores(spark, sf_dir):
    """Classifier and genome blended; the genome's alone where there is no classifier."""
    c = F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 11) / 10.0)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(S.task_score(c, (F.col("p_partkey") % 13) / 12.0), 6).alias("task"))
