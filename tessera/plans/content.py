"""Queries of text, vectors and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import classifier, documents, graph, ternary
from .domain import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --------------------------------------------------------------------------- text


@query(
    "char_classes",
    r"""WITH c AS (SELECT doc_id, text, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '\p{Ll}', '', 'g')) AS lower,
    length(text) - length(regexp_replace(text, '[\s\x0b]', '', 'g')) AS space, length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS punct FROM documents)
    SELECT doc_id, upper, lower, space, punct, length(text) - upper - lower - space - punct AS other FROM c""",
)
def char_classes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.char_classes(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("char_classes_by_lang", r"""SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) AS BIGINT) AS upper FROM documents GROUP BY lang""")
def char_classes_by_lang(spark, sf_dir):
    """Signals of leaves, combined field by field."""
    d = read(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.sum(T.char_classes(F.col("text"))["upper"]).alias("upper"))


#: Bytes of each text as hex pairs, and their entropy, for DuckDB.
_ENTROPY_SQL = "hx AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), hc AS (SELECT doc_id, b, count(*) AS c FROM hx GROUP BY 1, 2), he AS (SELECT doc_id, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 8 AS entropy FROM hc GROUP BY 1)"


@query("byte_entropy", f"WITH {_ENTROPY_SQL} SELECT doc_id, round(CASE WHEN text = '' THEN 0 ELSE entropy END, 6) AS entropy FROM documents LEFT JOIN he USING (doc_id)")
def byte_entropy(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.byte_entropy(F.col("text")), 6).alias("entropy"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("n"))


@query("url_fnv", "WITH b AS (SELECT page_id, list_transform(regexp_extract_all(hex(encode(url)), '..'), lambda p: (instr('0123456789ABCDEF', p[1]) - 1) * 16 + instr('0123456789ABCDEF', p[2]) - 1) AS bytes FROM pages) SELECT page_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(bytes, lambda x: x::HUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS fnv FROM b")
def url_fnv(spark, sf_dir):
    """64-bit FNV-1a of each url, as a decimal."""
    return read(spark, sf_dir, "pages").select("page_id", T.fnv1a(F.col("url")).cast("string").alias("fnv"))


#: Texts without controls, white space as one blank, and of each run of a letter the first two, for DuckDB.
_SQUASH_SQL = r"""sq AS (SELECT doc_id, length(text) AS n, regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g'), '[\s\x0b\p{Z}]+', ' ', 'g') AS t FROM documents),
ch AS (SELECT doc_id, i, substr(t, i, 1) AS c FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM sq)), ru AS (SELECT doc_id, c, lag(c, 1) OVER w AS a, lag(c, 2) OVER w AS b FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE NOT (regexp_matches(c, '^\p{L}$') AND c = coalesce(a, '') AND c = coalesce(b, ''))) AS n_kept FROM ru GROUP BY doc_id)"""


@query("squash", f"WITH {_SQUASH_SQL} SELECT doc_id, coalesce(n_kept, 0) AS n_kept, n FROM sq LEFT JOIN kept USING (doc_id)")
def squash(spark, sf_dir):
    """Characters once controls are gone, white space is one blank and runs of a letter are two."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(T.squash(F.col("text"))).cast("long").alias("n_kept"), F.length("text").cast("long").alias("n"))


@query("reduction", f"WITH {_SQUASH_SQL} SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE 1 - coalesce(n_kept, 0)::DOUBLE / n END, 6) AS reduction FROM sq LEFT JOIN kept USING (doc_id)")
def reduction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.reduction(F.col("text")), 6).alias("reduction"))


_CODE_TEXT = r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || '  x = {' || p_size || '};' || chr(10) || '  y;' WHEN 1 THEN 'a = b;' || chr(10) || '    c = ' || p_size ELSE CASE p_partkey % 4 WHEN 0 THEN 'def ' || p_name WHEN 1 THEN p_name || ' return ' || p_size WHEN 2 THEN 'return x; ' || p_name ELSE p_name END END AS t FROM part"""


@query(
    "code_shape",
    rf"""WITH s AS ({_CODE_TEXT}), n AS (SELECT p_partkey, t, length(t) - length(regexp_replace(t, '[{{}}]', '', 'g')) AS braces, length(t) - length(replace(t, ';', '')) AS semis, length(t) - length(replace(t, '=', '')) AS assigns, contains(t, chr(10)) AS several FROM s)
    SELECT p_partkey, braces >= 2 OR semis >= 2 OR (assigns >= 2 AND several) OR contains(t, 'def ') OR (contains(t, 'return ') AND (braces >= 1 OR semis >= 1 OR several)) AS code, len(regexp_extract_all(t, '(?m)^[ \t]')) >= 2 AS indented FROM n""",
)
def code_shape(spark, sf_dir):
    """By braces, semicolons, assignments and code words, of which a weak one counts beside others only."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("\n  x = {"), size, F.lit("};\n  y;"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a = b;\n    c = "), size))
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    t = t.otherwise(F.when(k == 0, F.concat(F.lit("def "), name)).when(k == 1, F.concat(name, F.lit(" return "), size)).when(k == 2, F.concat(F.lit("return x; "), name)).otherwise(name))
    p = p.select("p_partkey", t.alias("t"))
    return p.select("p_partkey", T.looks_like_code(F.col("t")).alias("code"), T.indented_code(F.col("t")).alias("indented"))


@query("line_shapes", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT length(regexp_extract(line, '^(#+) ', 1)) AS level, regexp_matches(line, '^\d+\. ') AS numbered, count(*) AS n FROM l GROUP BY 1, 2""")
def line_shapes(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy(T.heading_level(F.col("line")).cast("long").alias("level"), T.numbered_item(F.col("line")).isNotNull().alias("numbered")).agg(F.count(F.lit(1)).alias("n"))


@query("markdown_graph", None)
def markdown_graph(spark, sf_dir):
    """Nodes of each document's graph; tested on fixtures with fences and nested headings."""
    return documents.parse_markdown(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("markdown_chunks", None)
def markdown_chunks(spark, sf_dir):
    return documents.chunks(read(spark, sf_dir, "documents")).select("doc_id", "chunk", F.length("text").alias("n"))


@query("glyphs", r"""SELECT page_id, length(url)::INTEGER AS length, (regexp_matches(url, '[\s\x0b]')::INTEGER + regexp_matches(url, '[0-9]')::INTEGER + regexp_matches(url, '[!-/:-@\[-`{-~]')::INTEGER + (regexp_matches(url, '[A-Za-z]') OR regexp_matches(replace(url, '', ''), '[\x{00aa}-\x{024f}]'))::INTEGER) AS diversity FROM pages""")
def glyphs(spark, sf_dir):
    """Distinct classes of characters of each url, and its length; urls are Latin text.  The fingerprint's hash is this engine's own."""
    m = T.glyph_fingerprint(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", m["diversity"].alias("diversity"), m["length"].alias("length"))


@query("url_paths", r"""WITH p AS (SELECT string_split(regexp_replace(url, '^[^:]*://', ''), '/') AS raw FROM pages), f AS (SELECT list_filter(raw, lambda x: x <> '') AS parts FROM p),
    n AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS prefix, i - 1 AS depth FROM f, unnest(range(1, len(parts) + 1)) AS t(i)) SELECT depth::INTEGER AS depth, count(*) AS n_nodes FROM n GROUP BY 1""")
def url_paths(spark, sf_dir):
    """The tree of path prefixes, by depth."""
    nodes, _ = graph.paths(read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[^:]*://", "").alias("path")))
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("path_kinds", r"""SELECT CASE WHEN regexp_extract(url, '\.([^./]+)$', 1) IN ('rs', 'py', 'sh', 'js', 'ts') THEN 'Execution' ELSE 'Content' END AS kind, regexp_extract(url, '\.([^./]+)$', 1) AS extension, count(*) AS n FROM pages GROUP BY 1, 2""")
def path_kinds(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(T.path_kind(F.col("url")).alias("kind"), F.regexp_extract("url", r"\.([^./]+)$", 1).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


@query("text_features", None)
def text_features(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", "text", documents.features(F.col("text")).alias("features"))
    return b.select("item_id", "features", F.transform(documents.signature(F.col("features"), F.col("text")), lambda x: F.round(x, 6)).alias("signature"))


@query("fixed_ternary", "WITH b AS (SELECT n_nationkey, ord(c) AS code FROM (SELECT n_nationkey, unnest(string_split(n_name, '')) AS c FROM nation)) SELECT n_nationkey, CAST(sum(CASE WHEN (code - 109.5::DOUBLE) / 13 > 0.33 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN (code - 109.5::DOUBLE) / 13 < -0.33 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM b GROUP BY 1")
def fixed_ternary(spark, sf_dir):
    t = read(spark, sf_dir, "nation").select("n_nationkey", A.ternary_bytes(F.col("n_name")).alias("v"))
    n = lambda k: F.size(F.filter("v", lambda x: x == k)).cast("long")
    return t.select("n_nationkey", n(1).alias("n_pos"), n(-1).alias("n_neg"))


@query("edge_interaction", "WITH b AS (SELECT n_nationkey, n_regionkey, pos, CASE WHEN (ord(c) - 109.5::DOUBLE) / 13 > 0.33 THEN 1 WHEN (ord(c) - 109.5::DOUBLE) / 13 < -0.33 THEN -1 ELSE 0 END AS v FROM (SELECT n_nationkey, n_regionkey, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) AS pos FROM nation)), r AS (SELECT r_regionkey, pos, CASE WHEN (ord(c) - 109.5::DOUBLE) / 13 > 0.33 THEN 1 WHEN (ord(c) - 109.5::DOUBLE) / 13 < -0.33 THEN -1 ELSE 0 END AS v FROM (SELECT r_regionkey, unnest(string_split(r_name, '')) AS c, generate_subscripts(string_split(r_name, ''), 1) AS pos FROM region)) SELECT n_nationkey, CAST(sum(b.v * coalesce(r.v, 0)) AS DOUBLE) AS score FROM b LEFT JOIN r ON r.r_regionkey = b.n_regionkey AND r.pos = b.pos GROUP BY 1")
def edge_interaction(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    t = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return t.select("n_nationkey", A.dot(A.ternary_bytes(F.col("n_name")), A.ternary_bytes(F.col("r_name"))).alias("score"))


# --------------------------------------------------------------------------- vectors

_EMB = "e AS (SELECT vec_id, label, embedding FROM embeddings)"
_TERN = f"""{_EMB}, x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM e), cut AS (SELECT vec_id, 0.5 * sum(abs(v)) / count(*) AS c FROM x GROUP BY vec_id),
t AS (SELECT x.vec_id, label, idx, CASE WHEN v > c THEN 1 WHEN v < -c THEN -1 ELSE 0 END AS s FROM x JOIN cut USING (vec_id))"""


def _ternary(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", A.ternary(F.col("embedding")).alias("v"))


@query("ternary_density", f"WITH {_TERN} SELECT vec_id, CAST(sum(s) AS BIGINT) AS total, round(sum(abs(s))::DOUBLE / count(*), 6) AS density, round(sum(abs(s))::DOUBLE / count(*) / 2, 6) AS bit_occupancy, round(1 - sum(abs(s))::DOUBLE / count(*), 6) AS fitness FROM t GROUP BY vec_id")
def ternary_density(spark, sf_dir):
    v = F.col("v")
    return _ternary(spark, sf_dir).select("vec_id", A.total_long(v).alias("total"), F.round(A.density(v), 6).alias("density"), F.round(A.bit_occupancy(v), 6).alias("bit_occupancy"), F.round(1 - A.density(v), 6).alias("fitness"))


_DOT = f"{_TERN}, l AS (SELECT label, min(vec_id) AS head FROM e GROUP BY label)"


@query("ternary_dot", f"WITH {_DOT} SELECT a.vec_id, CAST(sum(a.s * b.s) AS BIGINT) AS dot FROM t a JOIN l ON l.label = a.label JOIN t b ON b.vec_id = l.head AND b.idx = a.idx GROUP BY a.vec_id")
def ternary_dot(spark, sf_dir):
    """Popcounts of bit planes: each vector with the first of its label."""
    t = _ternary(spark, sf_dir).select("vec_id", "label", A.plane(F.col("v"), 1).alias("p"), A.plane(F.col("v"), -1).alias("n"))
    head = t.groupBy("label").agg(F.min_by(F.struct("p", "n"), "vec_id").alias("h"))
    return t.join(head, "label").select("vec_id", A.plane_dot(F.col("p"), F.col("n"), F.col("h.p"), F.col("h.n")).alias("dot"))


def sparse(t):
    """Vectors as rows of non-empty 32-bit chunks: (vec_id, chunk, pos, neg)."""
    planes = F.arrays_zip(A.plane(F.col("v"), 1).alias("pos"), A.plane(F.col("v"), -1).alias("neg"))
    return t.select("vec_id", "label", F.posexplode(planes).alias("chunk", "c")).select("vec_id", "label", "chunk", "c.pos", "c.neg").filter("pos <> 0 OR neg <> 0")


@query("sparse_dot", f"WITH {_DOT} SELECT a.vec_id, CAST(sum(a.s * b.s) AS BIGINT) AS dot FROM t a JOIN l ON l.label = a.label JOIN t b ON b.vec_id = l.head AND b.idx = a.idx GROUP BY a.vec_id")
def sparse_dot(spark, sf_dir):
    """The same by an equi-join on chunks."""
    t = sparse(_ternary(spark, sf_dir))
    heads = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    h = t.join(heads, ["label", "vec_id"]).select("label", "chunk", F.col("pos").alias("hp"), F.col("neg").alias("hn"))
    n = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.col(y)))
    d = t.join(h, ["label", "chunk"]).groupBy("vec_id").agg(F.sum(n("pos", "hp") + n("neg", "hn") - n("pos", "hn") - n("neg", "hp")).alias("dot"))
    return read(spark, sf_dir, "embeddings").select("vec_id").join(d, "vec_id", "left").select("vec_id", F.coalesce("dot", F.lit(0)).cast("long").alias("dot"))


def _with_heads(spark, sf_dir):
    """Sparse rows of each vector, and those of the first of its label under the vector's id."""
    t = _ternary(spark, sf_dir)
    rows = ternary.sparse(t)
    heads = t.groupBy("label").agg(F.min("vec_id").alias("head"))
    members = t.select("vec_id", "label").join(heads, "label").select("vec_id", "head")
    return rows, members.join(rows.withColumnRenamed("vec_id", "head"), "head").select("vec_id", "chunk", "pos", "neg")


@query("sparse_union", f"WITH {_DOT}, c AS (SELECT a.vec_id, a.idx // 64 AS chunk, count(*) FILTER (WHERE a.s = 1 OR b.s = 1) AS n_pos, count(*) FILTER (WHERE a.s = -1 OR b.s = -1) AS n_neg FROM t a JOIN l ON l.label = a.label JOIN t b ON b.vec_id = l.head AND b.idx = a.idx GROUP BY 1, 2) SELECT vec_id, chunk::INTEGER AS chunk, n_pos, n_neg FROM c WHERE n_pos + n_neg > 0")
def sparse_union(spark, sf_dir):
    """Full outer join on chunks, planes ORed: a place can be in both planes."""
    out = ternary.sparse_add(*_with_heads(spark, sf_dir))
    return out.select("vec_id", "chunk", F.bit_count("pos").cast("long").alias("n_pos"), F.bit_count("neg").cast("long").alias("n_neg"))


_HEAD = f"{_TERN}, f AS (SELECT idx, s FROM t WHERE vec_id = (SELECT min(vec_id) FROM e)), sc AS (SELECT t.vec_id, t.idx // 64 AS chunk, sum(t.s * f.s) AS score FROM t JOIN f USING (idx) GROUP BY 1, 2)"


def _gates(spark, sf_dir):
    rows = ternary.sparse(_ternary(spark, sf_dir))
    first = rows.join(rows.agg(F.min("vec_id").alias("vec_id")), "vec_id").select("chunk", "pos", "neg")
    return rows, first


@query("sparse_gate", f"WITH {_HEAD} SELECT vec_id, chunk::INTEGER AS chunk, sign(score)::INTEGER AS sign FROM sc WHERE abs(score) >= 3")
def sparse_gate(spark, sf_dir):
    """One sign a chunk, of each vector with the first one, where the score reaches three."""
    return ternary.gated(*_gates(spark, sf_dir), 3).select("vec_id", "chunk", "sign")


@query("layer_output", f"WITH {_HEAD}, o AS (SELECT vec_id, chunk, sign(score)::INTEGER AS sign FROM sc WHERE score <> 0) SELECT vec_id, arg_min(sign, chunk) AS sign FROM o GROUP BY vec_id")
def layer_output(spark, sf_dir):
    """Each node keeps its first output chunk."""
    return ternary.layer(*_gates(spark, sf_dir)).select("vec_id", "sign")


@query("sparse_text", f"WITH {_TERN}, c AS (SELECT vec_id, idx // 64 AS chunk, sum(CASE WHEN s = 1 THEN 1::HUGEINT << (idx % 64)::INTEGER ELSE 0 END) AS pos, sum(CASE WHEN s = -1 THEN 1::HUGEINT << (idx % 64)::INTEGER ELSE 0 END) AS neg, sum(abs(s)) AS n FROM t GROUP BY 1, 2), b AS (SELECT * FROM c WHERE n > 0), z AS (SELECT vec_id, count(*) AS len FROM t GROUP BY 1) SELECT z.vec_id, 'SPARSE_V1 len=' || any_value(len) || ' density=' || printf('%.6f', coalesce(sum(n), 0) / any_value(len)::DOUBLE) || ' blocks=' || count(b.chunk) || chr(10) || coalesce(string_agg('chunk=' || chunk || ' pos=0x' || lpad(lower(to_hex(pos::UBIGINT)), 16, '0') || ' neg=0x' || lpad(lower(to_hex(neg::UBIGINT)), 16, '0') || chr(10), '' ORDER BY chunk), '') AS text FROM z LEFT JOIN b USING (vec_id) GROUP BY z.vec_id")
def sparse_text(spark, sf_dir):
    """Sparse vectors as text, a line a chunk."""
    t = _ternary(spark, sf_dir)
    return ternary.sparse_text(ternary.sparse(t), t.select("vec_id", F.size("v").alias("len")))


_EDITED = f"{_TERN}, x2 AS (SELECT vec_id, idx, s, CASE WHEN vec_id % 3 = 0 AND idx = vec_id % 64 THEN vec_id % 2 WHEN vec_id % 3 = 0 AND idx = 5 THEN -1 ELSE s END AS n FROM t)"


@query("vector_edits", f"WITH {_EDITED} SELECT vec_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(abs(n)) AS BIGINT) AS n_set, sha256(string_agg(s::VARCHAR, ',' ORDER BY idx)) AS parent, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS generation FROM x2 GROUP BY vec_id")
def vector_edits(spark, sf_dir):
    """Values set in a third of the vectors, each with its parent's hash."""
    t = _ternary(spark, sf_dir).select("vec_id", "v")
    third = t.filter("vec_id % 3 = 0").select("vec_id")
    edits = third.select("vec_id", F.lit(5).cast("long").alias("idx"), F.lit(-1).cast("long").alias("val"), F.lit(0).alias("seq")).union(third.select("vec_id", F.col("vec_id") % 64, F.col("vec_id") % 2, F.lit(1)))
    out = ternary.edited(t, edits)
    return out.select("vec_id", A.total_long(F.col("v")).alias("total"), A.total_long(F.col("v"), F.abs).alias("n_set"), "parent", "generation")


_INT8 = f"WITH {_EMB}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM e), m AS (SELECT vec_id, greatest(max(abs(v)), 1e-5) AS top FROM x GROUP BY vec_id), q AS (SELECT x.vec_id, idx, top, least(127, greatest(-128, round_even(v * (127 / top), 0)))::BIGINT AS a FROM x JOIN m USING (vec_id)), k AS (SELECT unnest(range(8)) AS k)"
_TERNARY_WEIGHTS = [[(i * 7 + k * 5) % 3 - 1 for i in range(64)] for k in range(8)]
_INT8_WEIGHTS = [[(i * 31 + k * 17) % 255 - 127 for i in range(64)] for k in range(8)]


@query("ternary_int8", f"{_INT8} SELECT vec_id, k::INTEGER AS k, CAST(sum(a * ((idx * 7 + k * 5) % 3 - 1)) AS BIGINT) AS y FROM q CROSS JOIN k GROUP BY 1, 2")
def ternary_int8(spark, sf_dir):
    """Ternary weights times int8 activations, exact."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(ternary.product(A.int8_activation(F.col("embedding")), _TERNARY_WEIGHTS)).alias("k", "y"))


@query("int8_dense", f"{_INT8} SELECT vec_id, k::INTEGER AS k, CAST(sum(a * ((idx * 31 + k * 17) % 255 - 127)) AS BIGINT) AS y FROM q CROSS JOIN k GROUP BY 1, 2")
def int8_dense(spark, sf_dir):
    """Int8 weights times int8 activations, exact."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(ternary.product(A.int8_activation(F.col("embedding")), _INT8_WEIGHTS)).alias("k", "y"))


@query("ternary_forward", f"{_INT8} SELECT vec_id, k::INTEGER AS k, round(sum(a * ((idx * 7 + k * 5) % 3 - 1)) * (any_value(top) / 127) * 0.25::DOUBLE, 5) AS y FROM q CROSS JOIN k GROUP BY 1, 2")
def ternary_forward(spark, sf_dir):
    """Layer output: quantised, multiplied, and scaled back with a weight scale of a quarter."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(ternary.forward(F.col("embedding"), _TERNARY_WEIGHTS, 0.25)).alias("k", "y")).select("vec_id", "k", F.round("y", 5).alias("y"))


@query("packed_weights", f"WITH {_TERN}, b AS (SELECT vec_id, idx % 64 AS byte, sum((s + 1) * 4 ** (idx // 64)) AS code, count(*) AS n FROM t GROUP BY 1, 2) SELECT vec_id, count(*) AS n_bytes, CAST(sum(code + 84) AS BIGINT) AS total FROM b GROUP BY vec_id")
def packed_weights(spark, sf_dir):
    """Two bits a weight in a group of 256; three quarters of these rows are padding."""
    p = _ternary(spark, sf_dir).select("vec_id", ternary.pack(F.col("v")).alias("p"))
    return p.select("vec_id", F.size("p").cast("long").alias("n_bytes"), A.total_long(F.col("p")).alias("total"))


@query("ternary_matmul", f"WITH {_TERN} SELECT a.vec_id, b.k, CAST(sum(a.s * b.w) AS BIGINT) AS y FROM t a JOIN (SELECT idx, k, (idx * 7 + k * 5) % 3 - 1 AS w FROM (SELECT unnest(range(64)) AS idx), (SELECT unnest(range(8)) AS k)) b ON b.idx = a.idx GROUP BY 1, 2")
def ternary_matmul(spark, sf_dir):
    """Vectors times a fixed 64 x 8 matrix: the matrix is literals, so the product is a projection."""
    t = _ternary(spark, sf_dir)
    columns = [F.array(*[F.lit((i * 7 + k * 5) % 3 - 1) for i in range(64)]) for k in range(8)]
    out = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), A.total_long(F.zip_with(F.col("v"), c, lambda x, y: x * y)).alias("y")) for k, c in enumerate(columns)])
    return t.select("vec_id", F.inline(out))


@query("int8_quantize", f"WITH {_EMB}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM e), m AS (SELECT vec_id, max(abs(v)) AS top FROM x GROUP BY vec_id), q AS (SELECT x.vec_id, sign(v) * floor(abs(v / (top / 127)) + 0.5) AS q, least(127, greatest(-128, round_even(v * (127 / greatest(top, 1e-5)), 0))) AS a FROM x JOIN m USING (vec_id)) SELECT vec_id, CAST(sum(q) AS BIGINT) AS total, CAST(sum(abs(q)) AS BIGINT) AS size, CAST(sum(a) AS BIGINT) AS act FROM q GROUP BY vec_id")
def int8_quantize(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q, a = A.int8(F.col("embedding")), A.int8_activation(F.col("embedding"))
    return e.select("vec_id", A.total_long(q).alias("total"), A.total_long(q, F.abs).alias("size"), A.total_long(a).alias("act"))


@query("cosine_top_k", f"""WITH {_EMB}, q AS (SELECT label, min(vec_id) AS head FROM e GROUP BY label), h AS (SELECT q.label AS query, e.embedding AS w FROM q JOIN e ON e.vec_id = q.head),
    s AS (SELECT query, vec_id, round(list_dot_product(e.embedding::DOUBLE[], h.w::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(h.w::DOUBLE[], h.w::DOUBLE[]))), 6) AS cosine FROM e CROSS JOIN h),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM s) SELECT query, vec_id, cosine, place FROM k WHERE place <= 8""")
def cosine_top_k(spark, sf_dir):
    """Eight nearest of a stated set of queries (one a label): scored in the scan, cut to eight a query in each task before the exchange."""
    e = read(spark, sf_dir, "embeddings")
    heads = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("w")).collect()  # one row a label
    scored = F.array(*[F.struct(F.lit(r["label"]).alias("query"), F.round(A.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in r["w"]])), 6).alias("cosine")) for r in heads])
    t = e.select("vec_id", F.inline(scored))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))
    return t.withColumn("place", place).filter("place <= 8").select("query", "vec_id", "cosine", "place")


@query("hamming", "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INTEGER AS distance, 1 - bit_count(xor(o_orderkey, o_custkey)) / 64.0::DOUBLE AS alignment FROM orders")
def hamming(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", A.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("distance"), A.alignment(F.col("o_orderkey"), F.col("o_custkey")).alias("alignment"))


@query("cluster_means", f"WITH {_EMB}, x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM e) SELECT label, idx::INTEGER AS idx, round(avg(v), 5) AS mean, round(var_pop(v), 5) AS variance FROM x GROUP BY 1, 2")
def cluster_means(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("idx", "v")).withColumn("v", F.col("v").cast("double"))
    return x.groupBy("label", "idx").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.var_pop("v"), 5).alias("variance"))


@query("relu_embedding", f"WITH {_EMB}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM e) SELECT vec_id, round(greatest(0, sum(v * ((idx * 3) % 7 - 3))), 4) AS y FROM x GROUP BY vec_id")
def relu_embedding(spark, sf_dir):
    w = F.array(*[F.lit(float(i * 3 % 7 - 3)) for i in range(64)])
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.greatest(F.lit(0.0), A.dot(F.col("embedding"), w)), 4).alias("y"))


# --------------------------------------------------------------------------- classifier


def _rule(spark, sf_dir):
    """A simple rule's verdict beside the label."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") > 1500).cast("int").alias("predicted"))
    return read(spark, sf_dir, "labels").join(d, "doc_id")


@query("confusion", """WITH r AS (SELECT lang, quality AS y, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn FROM r GROUP BY lang)
    SELECT lang, tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fn = 0 THEN tn::DOUBLE / (tn + fp) WHEN tn + fp = 0 THEN tp::DOUBLE / (tp + fn) ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END, 6) AS balanced_accuracy,
    round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1 FROM c""")
def confusion(spark, sf_dir):
    t = classifier.confusion(_rule(spark, sf_dir), "quality", "predicted", "lang")
    return t.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


@query("threshold_sweep", """WITH s AS (SELECT quality AS y, least(40, greatest(-41, length(text) // 100 - 20)) AS s FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest(range(-40, 41))::INTEGER AS threshold)
    SELECT threshold, count(*) FILTER (WHERE y = 1 AND s >= threshold) AS tp, count(*) FILTER (WHERE y <> 1 AND s >= threshold) AS fp FROM g CROSS JOIN s GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.floor(F.length("text") / 100) - 20).cast("int").alias("s"))
    t = classifier.sweep(read(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "s")
    return t.select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


@query("perceptron")
def perceptron(spark, sf_dir):
    """Split, train, sweep and score on benchmark passages against page titles; tested against a plain loop and for accuracy on fixtures."""
    a = read(spark, sf_dir, "benchmark").select(F.col("text").alias("label"), F.lit(0).alias("y"))
    b = read(spark, sf_dir, "pages").select(F.col("url").alias("label"), F.lit(1).alias("y"))
    return classifier.calibrated(a.union(b).withColumn("x", documents.features(F.col("label"))), "y", "x", "label")


@query("baseline", "SELECT round(avg(CASE WHEN quality = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS baseline FROM labels")
def baseline(spark, sf_dir):
    return classifier.baseline(read(spark, sf_dir, "labels"), "quality").select(F.round("baseline", 6).alias("baseline"))


_M = "count(*) FILTER (WHERE y = 1 AND {p}) AS tp, count(*) FILTER (WHERE y <> 1 AND {p}) AS fp, count(*) FILTER (WHERE y <> 1 AND NOT {p}) AS tn, count(*) FILTER (WHERE y = 1 AND NOT {p}) AS fn"
_RATES = "(tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 AS balanced_accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1"


@query("compare_models", f"WITH r AS (SELECT quality AS y, length(text) AS n FROM labels JOIN documents USING (doc_id)), a AS (SELECT {_RATES} FROM (SELECT {_M.format(p='n > 1500')} FROM r)), b AS (SELECT {_RATES} FROM (SELECT {_M.format(p='n > 600')} FROM r)) SELECT " + ", ".join(f"round(b.{n} - a.{n}, 6) AS {n}" for n in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")) + " FROM a, b")
def compare_models(spark, sf_dir):
    """What a lower cut of the length has over a higher one."""
    n = F.length("text")
    d = read(spark, sf_dir, "documents").select("doc_id", (n > 1500).cast("int").alias("high"), (n > 600).cast("int").alias("low"))
    t = classifier.compare(read(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "high", "low")
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query("malware_risk", f"WITH {_ENTROPY_SQL}, kn AS (SELECT DISTINCT sha256(text) AS h FROM benchmark) SELECT doc_id, round(CASE WHEN kn.h IS NOT NULL THEN 0.45::DOUBLE WHEN coalesce(entropy, 0) > 0.8 THEN entropy ELSE 0 END, 6) AS risk FROM documents LEFT JOIN he USING (doc_id) LEFT JOIN kn ON kn.h = sha256(text)")
def malware_risk(spark, sf_dir):
    """Half the confidence of a known content, else risk from entropy over 0.8; known contents are benchmark passages by hash."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", T.content_hash(F.col("text")).alias("h"))
    known = read(spark, sf_dir, "benchmark").select(T.content_hash(F.col("text")).alias("h"), F.lit(0.9).alias("confidence")).distinct()
    t = d.join(known, "h", "left").withColumn("entropy", T.byte_entropy(F.col("text")))
    risk = F.when(F.col("confidence").isNotNull(), 0.5 * F.col("confidence")).when(F.col("entropy") > 0.8, F.col("entropy")).otherwise(0.0)
    return t.select("doc_id", F.round(risk, 6).alias("risk"))


@query("duplicate_keys", "SELECT c_mktsegment AS k, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Keys that a unique insert would refuse."""
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("nations")).filter("n > 1")
