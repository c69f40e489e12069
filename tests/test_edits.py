import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import edits
from tessera.sources import api


def graph_of(spark):
    nodes = spark.createDataFrame([(i, "Content", f"n{i}") for i in range(4)], "id long, kind string, label string")
    return nodes, spark.createDataFrame([(0, 1), (1, 2), (0, 3)], "src long, dst long")


def test_rules(spark):
    nodes, edges = graph_of(spark)
    for rule in (edits.Rule("add_node", label="x"), edits.Rule("add_edge", src=4, dst=0), edits.Rule("rewire", src=1, dst=2, new=4), edits.Rule("remove_node", node=3), edits.Rule("remove_edge", src=0, dst=1)):
        nodes, edges = edits.apply_rule(nodes, edges, rule)
    assert sorted(r.id for r in nodes.collect()) == [0, 1, 2, 4] and nodes.filter("id = 4").first().label == "x"
    assert sorted(map(tuple, edges.collect())) == [(1, 4), (4, 0)]
    for rule in (edits.Rule("remove_node", node=9), edits.Rule("add_edge", src=0, dst=9), edits.Rule("remove_edge", src=2, dst=0), edits.Rule("rewire", src=1, dst=4, new=9), edits.Rule("melt")):
        with pytest.raises(ValueError):
            edits.apply_rule(nodes, edges, rule)


def test_paths_and_leaves(spark):
    nodes = spark.createDataFrame([("a",), ("a/b",)], "prefix string")
    asked = spark.createDataFrame([("a\\b/",), ("/a",), ("b",), ("",), ("a/b/c",)], "path string")
    assert {r.path: r.found for r in edits.find_paths(asked, nodes).collect()} == {"a\\b/": True, "/a": True, "b": False, "": True, "a/b/c": False}
    leaves = spark.createDataFrame([(1, "One"), (2, "two")], "id long, identity string")
    out = {r.id: r for r in edits.resolved(leaves, spark.createDataFrame([(1, "BODY!")], "id long, body string")).collect()}
    assert (out[1].resolved, out[1].signal.upper, out[1].signal.punct) == (True, 4, 1) and (out[2].resolved, out[2].text) == (False, "two")


def test_active_nodes(spark):
    nodes = spark.createDataFrame([(1, "The Gate"), (2, "gate"), (3, ""), (4, "of")], "id long, label string")
    assert [(r.id, r.score) for r in edits.active_nodes(nodes, "the GATE, of", 5).collect()] == [(1, 2), (2, 1)]
    assert [r.id for r in edits.active_nodes(nodes, "", 0, F.lit(-3)).collect()] == [1]


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "red green blue"), (2, "Red red"), (3, "sky, and sea"), (4, "")], "key long, text string")
    index = edits.embedded(chunks, "key")
    sizes = {r.key: r.n for r in index.groupBy("key").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert sizes == pytest.approx({1: 1.0, 2: 1.0, 3: 1.0})
    asked = edits.embedded(spark.createDataFrame([(7, "RED")], "question long, text string"), "question")
    got = [(r.key, r.place) for r in edits.retrieve(asked, index, 2).orderBy("place").collect()]
    assert got == [(2, 1), (1, 2)]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 70])
def test_plane_files(n):
    codes = np.random.default_rng(n).integers(0, 4, n).astype(np.uint8)
    data = api.to_file(codes)
    assert struct.unpack("<I", data[:4])[0] == n and len(data) == 4 + 2 * 8 * -(-n // 32)
    if n:
        word = struct.unpack("<Q", data[4:12])[0]
        assert [word >> k & 1 for k in range(min(n, 32))] == [int(c & 1) for c in codes[:32]] and word < 2**32
    assert (api.from_file(data) == codes).all()


def test_plane_files_in_spark(spark, tmp_path):
    rows = [("1", 0, 10, [0, 1, 2, 3]), ("1", 1, 20, [2, None, 0])]
    t = spark.createDataFrame(rows, "chr string, snp_idx long, position long, g array<int>")
    files = api.encode_planes(t)
    assert {r.snp_idx: r.g for r in api.decode_planes(files).collect()} == {0: [0, 1, 2, 3], 1: [2, 3, 0]}
    (tmp_path / "a.bin").write_bytes(api.to_file(np.array([1, 2, 0])))
    assert [r.g for r in api.read_planes(spark, str(tmp_path)).collect()] == [[1, 2, 0]]
    with pytest.raises(ValueError):
        api.from_file(b"\x05\x00\x00\x00")
    with pytest.raises(ValueError):
        api.from_file(b"")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("rs1,100,0,1,2\nrs2,200,2,2,0\n")
    source = api.FileSource(str(tmp_path / "in.csv"), "csv")
    assert source.record_count(spark) == 2 and "in.csv" in source.description()
    sink = api.FileSink(str(tmp_path / "out"), "csv", ["a", "b", "c"])
    sink.write(source.records(spark))
    assert api.FileSource(str(tmp_path / "out"), "csv", header=True).records(spark).select("id", "g").collect() in ([("rs1", [0, 1, 2]), ("rs2", [2, 2, 0])], [("rs2", [2, 2, 0]), ("rs1", [0, 1, 2])])
    with pytest.raises(NotImplementedError):
        api.FileSink("x", "bed")


def events_by_hand(rows):
    """Nodes as (label, parent) lists, edges as pairs."""
    nodes, edges = [("", True)], []

    def walk(path, make):
        at = 0
        for part in [p for p in path.replace("\\", "/").split("/") if p]:
            found = next((b for a, b in edges if a == at and nodes[b][0] == part), None)
            if found is None:
                if not make:
                    return None
                nodes.append((part, True))
                found = len(nodes) - 1
                edges.append((at, found))
            at = found
        return at

    for kind, path, to in rows:
        if kind != "created" and (gone := walk(path, False)):
            nodes[gone] = (nodes[gone][0], False)
            edges[:] = [e for e in edges if gone not in e]
        if kind != "removed":
            walk(to if kind == "renamed" else path, True)
    up = {b: a for a, b in edges}
    return {(i, label, up.get(i)) for i, (label, there) in enumerate(nodes) if there}


def test_file_events(spark):
    import random

    rng = random.Random(5)
    pick = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    logs = {r: [(rng.choice(["created", "created", "removed", "renamed"]), pick(), pick()) for _ in range(60)] for r in range(3)}
    logs[3] = [("created", "a\\b//", None), ("removed", "", None), ("removed", "x", None)]
    df = spark.createDataFrame([(r, k, *e) for r, log in logs.items() for k, e in enumerate(log)], "root long, seq long, kind string, path string, to string").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    for n in ("1000", "7"):
        spark.conf.set(size, n)
        got = {}
        for r in edits.apply_events(df).collect():
            got.setdefault(r.root, set()).add((r.id, r.label, r.parent))
        assert got == {r: events_by_hand(log) for r, log in logs.items()}
    spark.conf.set(size, before)
