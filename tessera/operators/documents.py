"""Markdown documents: graphs, chunks, feature vectors, signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..ship import ensure

#: Bytes of a chunk at most, and places of each part of the feature vector.
CHUNK_BYTES = 1200
FEATURES, BYTE_FEATURES = 64, 48
# Shares of a character class that count as much and as little, cuts of a hash byte.
MUCH, LITTLE = 0.33, 0.05
BYTE_HIGH, BYTE_LOW = 170, 85
# Words that lift places of a text signature, as (words, place, by).
LIFTS = ((("snp", "ld", "haplotype"), 0, 2.0), (("snp", "ld", "haplotype"), 6, 1.5), (("fn ", "```", "pub "), 7, 2.0))
CHROMOSOMES, CHROMOSOME_PLACE = 22, 3
LEVELS = 12


def parse_markdown(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, node_id, parent_id, kind, label): node 0 is the document; headings nest by level, fenced blocks are Execution nodes,
    list items and other lines are Content below the last heading.  Lines are numbered and related by windows; no Python.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("key").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    trimmed = F.regexp_replace("line", f"^{T.SPACE}+", "")
    t = lines.withColumn("trimmed", trimmed).withColumn("fence", F.col("trimmed").startswith("```"))
    t = t.withColumn("fences", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(upto)).withColumn("all_fences", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(Window.partitionBy("key")))
    t = t.withColumn("inside", (F.col("fences") % 2 == 1) & ~F.col("fence"))
    # A fence that is never closed, and what is in it, makes no node.
    opening = F.col("fence") & (F.col("fences") % 2 == 1) & (F.col("fences") < F.col("all_fences"))
    body = F.sort_array(F.collect_list(F.when(F.col("inside"), F.struct("line_no", "line"))).over(Window.partitionBy("key", "fences")))
    t = t.withColumn("body", F.when(opening, F.array_join(F.transform(body, lambda x: x["line"]), "\n")))
    level = F.when(~F.col("inside") & ~F.col("fence"), T.heading_level(F.col("trimmed"))).otherwise(0)
    t = t.withColumn("level", level)
    item = F.regexp_extract("trimmed", r"^[-*] (.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace("trimmed", "^#+", ""), f"^{T.SPACE}+|{T.SPACE}+$", "")
    label = (
        F.when(opening, F.col("body"))
        .when(F.col("fence") | F.col("inside") | (F.col("trimmed") == ""), F.lit(None))
        .when(F.col("level") > 0, bare)
        .when(F.col("trimmed").rlike("^[-*] "), item)
        .otherwise(F.coalesce(T.numbered_item(F.col("trimmed")), F.col("trimmed")))
    )
    t = t.withColumn("label", label).filter(F.col("label").isNotNull()).withColumn("kind", F.when(F.col("fence"), "Execution").otherwise("Content"))
    t = t.withColumn("node_id", F.row_number().over(w))
    # The parent of a heading is the last heading before of a smaller level; of other lines the last heading.
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.col("node_id")), True).over(before) for n in range(1, LEVELS)]
    mine = F.when(F.col("level") > 0, F.col("level")).otherwise(LEVELS)
    parent = F.greatest(F.lit(0), *[F.when(mine > n, F.coalesce(c, F.lit(0))).otherwise(0) for n, c in enumerate(last, 1)])
    t = t.withColumn("parent_id", parent)
    root = docs.select(F.col(key).alias("key")).distinct().select("key", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit("Content").alias("kind"), F.lit("").alias("label"))
    return t.select("key", "node_id", "parent_id", "kind", "label").union(root).withColumnRenamed("key", key)


def chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = CHUNK_BYTES) -> DataFrame:
    """(key, chunk, text): paragraphs packed in order into chunks of about ``most`` bytes (a longer paragraph is not cut); a blank last chunk goes."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = dict(source.dtypes)["key"]

    def packed(t: str) -> list[str]:
        out: list[str] = []
        size = 0  # of the last chunk, 0 for none open
        for p in t.split("\n\n"):
            n = len(p.encode())
            if not size or size + n > most:
                out.append(p) if size or not out else out.__setitem__(-1, p)
                size = n
            else:
                out[-1] += "\n\n" + p
                size += 2 + n
        return out if out and out[-1].strip() else out[:-1]

    def pack(batches):
        for pdf in batches:
            rows = [(k, n, x) for k, t in zip(pdf["key"], pdf["text"]) for n, x in enumerate(packed(t))]
            yield pd.DataFrame({"key": [r[0] for r in rows], "chunk": [r[1] for r in rows], "text": pd.Series([r[2] for r in rows], dtype=object)})

    ensure(docs.sparkSession)
    return source.mapInPandas(pack, f"key {key_type}, chunk int, text string").withColumnRenamed("key", key)


def _sign(x: Column, low, high) -> Column:
    return F.when(x > high, 1).when(x < low, -1).otherwise(0).cast("tinyint")


def features(label: Column) -> Column:
    """64 ternary features of a label: its first 48 bytes, shares of five character classes, eight bytes of a hash of the glyph
    classes (this engine's own hash), diversity, code, and shape of lines."""
    from ..functions.arrays import ternary_bytes

    first = F.slice(F.concat(ternary_bytes(label), F.array_repeat(F.lit(0).cast("tinyint"), BYTE_FEATURES)), 1, BYTE_FEATURES)
    c = T.char_classes(label)
    size = F.greatest(F.length(label), F.lit(1))
    classes = F.array(*[_sign(c[k] / size, LITTLE, MUCH) for k in ("upper", "lower", "punct", "space", "other")])
    mark = T.glyph_fingerprint(label)
    hashed = F.array(*[_sign(F.shiftright(mark["hash"], 8 * i).bitwiseAND(F.lit(255)), BYTE_LOW, BYTE_HIGH) for i in range(8)])
    yes = lambda x: F.when(x, 1).otherwise(-1).cast("tinyint")
    brief = (F.octet_length(label) < 8) | (~F.contains(label, F.lit("\n")) & (F.octet_length(label) < 48))
    shape = F.when(T.indented_code(label) | T.code_line_shape(label), 1).when(brief, -1).otherwise(0).cast("tinyint")
    return F.concat(first, classes, hashed, F.array(yes(mark["diversity"] >= 3), yes(T.looks_like_code(label)), shape))


def signature(f: Column, text: Column) -> Column:
    """Eight numbers of unit length: features ``f`` (a column of its own, not an expression) folded by place, lifted by known words;
    the highest chromosome whose name the text holds, over 22, is one of them."""
    low = T.ascii_lower(text)
    v = [F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(FEATURES // 8 - 1)), lambda k, i=i: F.get(f, k * 8 + i)), F.lit(0.0), lambda a, x: a + x) for i in range(8)]
    for words, place, by in LIFTS:
        v[place] = v[place] + F.when(T.has_any(low, words), by).otherwise(0.0)
    # "chr12" holds "chr1" too: of the digits after each name both readings count.
    named = F.concat(F.regexp_extract_all(low, F.lit(r"chr(\d)"), 1), F.regexp_extract_all(low, F.lit(r"chr(\d\d)"), 1))
    numbers = F.filter(F.transform(named, lambda x: x.cast("int")), lambda n: n.between(1, CHROMOSOMES))
    v[CHROMOSOME_PLACE] = F.when(F.size(numbers) > 0, F.array_max(numbers) / CHROMOSOMES).otherwise(v[CHROMOSOME_PLACE])
    v = F.array(*v)
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-6))
    return F.transform(v, lambda x: x / norm)
