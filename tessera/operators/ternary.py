"""Products of ternary and int8 matrices, sparse ternary rows, and edits of both.

A sparse vector is rows (vec_id, chunk, pos, neg): two planes of 64 bits a chunk, in which a place is plus, minus or neither.  Dense weights
are a stated matrix in the plan; rows are vectors, so a product is a projection and only sparse products join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

#: Places of a packed group, and bytes of it.
GROUP, GROUP_BYTES = 256, 64


def product(x: Column, weights: list[list[int]]) -> Column:
    """Array of the exact sums of x times each row of weights; shapes must agree."""
    rows = [A.total_long(F.zip_with(x, F.array(*[F.lit(int(w)) for w in row]), lambda a, b: a.cast("long") * b)) for row in weights]
    fits = F.size(x) == len(weights[0])
    return F.when(fits, F.array(*rows)).otherwise(F.raise_error(F.concat(F.lit(f"{len(weights[0])} places expected, got "), F.size(x).cast("string"))).cast("array<bigint>"))


def activation_scale(x: Column) -> Column:
    """What an int8 activation is multiplied by to get the value back."""
    return F.greatest(F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), F.lit(0.0)), F.lit(1e-5)) / 127


def forward(x: Column, weights: list[list[int]], scale: float = 1.0) -> Column:
    """Layer output: int8 activations of x times weights, times both scales."""
    return F.transform(product(A.int8_activation(x), weights), lambda acc: acc.cast("double") * activation_scale(x) * F.lit(scale))


def pack(values: Column) -> Column:
    """Two bits a weight, code w + 1, in groups of GROUP: place k of a group is bits 2 (k / 64) of its byte k % 64; padding has the code of 0.
    Null where a value is not -1, 0 or 1."""
    groups = F.greatest(F.ceil(F.size(values) / GROUP).cast("int"), F.lit(0))
    code = lambda g, byte, part: F.coalesce(F.get(values, g * GROUP + byte + part * GROUP_BYTES).cast("int"), F.lit(0)) + 1
    of = lambda at: sum((code(F.floor(at / GROUP_BYTES).cast("int"), at % GROUP_BYTES, part) * 4**part for part in range(1, 4)), code(F.floor(at / GROUP_BYTES).cast("int"), at % GROUP_BYTES, 0))
    out = F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups * GROUP_BYTES - 1), of)).otherwise(F.array().cast("array<int>"))
    return F.when(F.forall(values, lambda v: v.between(-1, 1)), out)


def sparse(vectors: DataFrame, vector: str = "v", key: str = "vec_id") -> DataFrame:
    """(key, chunk, pos, neg) of ternary arrays, chunks of 64 without a plus or minus left out."""
    planes = F.arrays_zip(A.plane(F.col(vector), 1, 64).alias("pos"), A.plane(F.col(vector), -1, 64).alias("neg"))
    return vectors.select(key, F.posexplode(planes).alias("chunk", "c")).select(key, "chunk", "c.pos", "c.neg").filter("pos <> 0 OR neg <> 0")


def sparse_add(a: DataFrame, b: DataFrame, key: str = "vec_id") -> DataFrame:
    """Union of two sparse tables: a full outer join on chunks, planes ORed.  A place can be in both planes; there is no carry."""
    zero = F.lit(0).cast("long")
    both = a.join(b.select(key, "chunk", F.col("pos").alias("pos_b"), F.col("neg").alias("neg_b")), [key, "chunk"], "full")
    either = lambda n: F.coalesce(n, zero).bitwiseOR(F.coalesce(f"{n}_b", zero))
    return both.select(key, "chunk", either("pos").alias("pos"), either("neg").alias("neg")).filter("pos <> 0 OR neg <> 0")


def chunk_score(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    n = lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")
    return n(p1, p2) + n(n1, n2) - n(p1, n2) - n(n1, p2)


def gated(weights: DataFrame, inputs: DataFrame, threshold: int = 0, key: str = "vec_id") -> DataFrame:
    """(key, chunk, sign): for each chunk that a row of ``weights`` and ``inputs`` (chunk, pos, neg) both have, the sign of its score where that reaches
    the threshold; any score but 0, if the threshold is 0."""
    both = weights.join(inputs.select("chunk", F.col("pos").alias("p__"), F.col("neg").alias("n__")), "chunk")
    score = chunk_score(F.col("pos"), F.col("neg"), F.col("p__"), F.col("n__"))
    least = max(1, threshold)
    return both.select(key, "chunk", F.when(score >= least, 1).when(score <= -least, -1).otherwise(0).alias("sign")).filter("sign <> 0")


def layer(nodes: DataFrame, inputs: DataFrame, threshold: int = 0, key: str = "vec_id") -> DataFrame:
    """(key, sign) of each node's first output chunk; nodes without one are left out."""
    return gated(nodes, inputs, threshold, key).groupBy(key).agg(F.min_by("sign", "chunk").alias("sign"))


def sparse_text(rows: DataFrame, sizes: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, text): a header with length, density and chunks, and a line a chunk with its planes in hex.  sizes: (key, len).

    A vector's chunks are as many as its length has.
    """
    line = F.concat(F.lit("chunk="), F.col("chunk").cast("string"), F.lit(" pos=0x"), F.lower(F.lpad(F.hex("pos"), 16, "0")), F.lit(" neg=0x"), F.lower(F.lpad(F.hex("neg"), 16, "0")))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", line.alias("line")))).alias("lines"), F.sum(F.bit_count("pos") + F.bit_count("neg")).alias("set"), F.count(F.lit(1)).alias("blocks"))
    t = sizes.join(held, key, "left")
    share = F.coalesce(F.try_divide(F.col("set").cast("double"), F.col("len").cast("double")), F.lit(0.0))
    header = F.concat(F.lit("SPARSE_V1 len="), F.col("len").cast("string"), F.lit(" density="), F.format_string("%.6f", share), F.lit(" blocks="), F.coalesce("blocks", F.lit(0)).cast("string"), F.lit("\n"))
    return t.select(key, F.concat(header, F.coalesce(F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""), F.lit(""))).alias("text"))


def edited(vectors: DataFrame, edits: DataFrame, vector: str = "v", key: str = "vec_id") -> DataFrame:
    """``vectors`` with the values of ``edits`` (key, idx, val) set, those of one place in turn of ``seq`` if there is one; and parent, the hash
    of the vector before, and generation, 1 where it was edited.  Places out of range, and values that are not ternary, are an error."""
    order = "seq" if "seq" in edits.columns else "idx"
    last = edits.groupBy(key, "idx").agg(F.max_by("val", order).alias("val")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), F.col("val").cast("tinyint")))).alias("set__"))
    t = vectors.join(last, key, "left")
    bad = F.exists(F.map_entries("set__"), lambda e: (e["key"] < 0) | (e["key"] >= F.size(vector)) | ~e["value"].between(-1, 1))
    changed = F.transform(F.col(vector), lambda x, i: F.coalesce(F.try_element_at(F.col("set__"), i), x))
    checked = F.when(F.col("set__").isNull(), F.col(vector)).when(bad, F.raise_error(F.lit("an edit does not fit")).cast("array<tinyint>")).otherwise(changed)
    parent = F.sha2(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), 256)
    return t.select(*[c for c in vectors.columns if c != vector], checked.alias(vector), parent.alias("parent"), F.col("set__").isNotNull().cast("int").alias("generation"))
