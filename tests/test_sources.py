import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, variants
from tessera.streaming import telemetry

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
ROWS = "chr1\t100\trs1\tA\tG\t50\tPASS\t.\tGT\t0|1\t1|0\n1\t200\t.\tC\tT\t.\tPASS\t.\tGT:DP\t1|1:35\t0|0:3\nX\t7\trs3\tC\tT\t9\tPASS\t.\tGT\t./.\t1\nshort\trow\n1\t300\trs4\tC\tT,G\tbad\tPASS\t.\tGT\t1/2\t.|1\n"


@pytest.fixture(params=["plain", "gzip", "members"])
def vcf(request, tmp_path):
    if request.param == "plain":
        path = tmp_path / "a.vcf"
        path.write_text(HEAD + ROWS)
    else:
        path = tmp_path / "a.vcf.gz"
        cut = len(HEAD) + 40 if request.param == "members" else 0
        text = (HEAD + ROWS).encode()
        path.write_bytes(gzip.compress(text[:cut]) + gzip.compress(text[cut:]) if cut else gzip.compress(text))
    return str(path)


def test_vcf(spark, vcf):
    rows = variants.read_vcf(spark, vcf, phased=True).orderBy("snp_idx").collect()
    assert [(r.chr, r.snp_idx, r.id, r.position, r.qual, r.g) for r in rows] == [("1", 0, "rs1", 100, 50.0, [1, 1]), ("1", 1, ".", 200, 0.0, [2, 0]), ("X", 2, "rs3", 7, 9.0, [3, 3]), ("1", 3, "rs4", 300, 0.0, [2, 3])]
    assert (rows[0].hap_a, rows[0].hap_b, rows[3].hap_a) == ([0, 1], [1, 0], [1, 3])
    assert variants.sample_names(spark, vcf) == ["S1", "S2"]
    one = variants.read_vcf(spark, vcf, chrom="1", limit=2).orderBy("snp_idx").collect()
    assert [r.position for r in one] == [100, 200]
    assert variants.validate(variants.read_vcf(spark, vcf, chrom="1"), 2).count() == 0


def test_places_do_not_depend_on_splits(spark, tmp_path):
    path = tmp_path / "big.vcf"
    path.write_text(HEAD + "".join(f"1\t{i}\trs{i}\tA\tC\t1\t.\t.\tGT\t0/1\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        t = variants.read_vcf(spark, str(path))
        assert t.filter("snp_idx <> position").count() == 0 and t.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_validation_reports(spark):
    bad = spark.createDataFrame([("1", 0, 9, [0, 1]), ("1", 1, 5, [0])], "chr string, snp_idx long, position long, g array<int>")
    assert {r.problem: r.n for r in variants.validate(bad).collect()} == {"sample count": 1, "position order": 1}
    assert variants.validate(bad.limit(0)).first().problem == "empty"


def test_csv_and_json(spark, tmp_path, vcf):
    t = variants.read_vcf(spark, vcf)
    variants.write_genotype_csv(t.coalesce(1), str(tmp_path / "csv"), ["S1", "S2", "S3"])
    back = variants.load(spark, str(tmp_path / "csv"), "csv", header=True).orderBy("position").collect()
    assert [(r.id, r.g) for r in back] == [("rs3", [3, 3, 3]), ("rs1", [1, 1, 3]), ("chr1_200", [2, 0, 3]), ("rs4", [2, 3, 3])]
    (tmp_path / "loose.csv").write_text("a,x,0,bad,2\nb,2\nc,3,1,1,1\n")
    loose = variants.read_genotype_csv(spark, str(tmp_path / "loose.csv"), strict=False).orderBy("snp_idx").collect()
    assert [(r.id, r.position, r.g) for r in loose] == [("a", 0, [0, 3, 2]), ("c", 3, [1, 1, 1])]
    with pytest.raises(Exception, match="CAST|cast"):
        variants.read_genotype_csv(spark, str(tmp_path / "loose.csv")).collect()
    (tmp_path / "b.json").write_text(json.dumps({"num_individuals": 2, "num_snps": 1, "records": [{"snp_id": "z", "position": 4, "genotypes": [0, 2]}]}))
    assert variants.load(spark, str(tmp_path / "b.json"), "json").first().g == [0, 2]
    with pytest.raises(NotImplementedError):
        variants.load(spark, "x", "plink")


def test_merge(spark):
    a = spark.createDataFrame([("1", 0, "a", 1, [0, 1])], "chr string, snp_idx long, id string, position long, g array<tinyint>")
    assert [(r.snp_idx, r.id) for r in variants.merge(a, a.withColumn("id", F.lit("b"))).orderBy("snp_idx").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="sample counts differ"):
        variants.merge(a, a.withColumn("g", F.array(F.lit(0).cast("tinyint")))).collect()


def test_files(spark, tmp_path):
    root = tmp_path / "corpus"
    for p in ("a.md", "x/b.md", "schooling/c.md", "1/2/3/d.md", "1/2/3/4/e.md", "n.txt"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(f"# {p}")
    assert {r.path for r in files.read_markdown(spark, str(root)).collect()} == {"a.md", "x/b.md", "1/2/3/d.md"}
    lines = spark.createDataFrame([('{"request_id": "r", "local_policy_score": 0.9}',), ("  ",), ("{bad",)], "value string")
    got = files.read_requests(lines).collect()
    assert [(r.request_id, r.error is None) for r in got] == [("r", True), (None, False)]
    files.write_model(spark, str(tmp_path / "model"), [1, -1], 3, {"k": "v"})
    assert files.read_model(spark, str(tmp_path / "model")) == ([1, -1], 3, 1, {"k": "v"})
    files.save_snapshot({"t": lines}, str(tmp_path / "snap"))
    assert files.load_snapshot(spark, str(tmp_path / "snap"), ["t"])["t"].count() == 3
    files.append_jsonl(lines, str(tmp_path / "log"))
    files.append_jsonl(lines, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


# --------------------------------------------------------------------------- streams


def report(tick, utility=0.9, alarm=False):
    return {"tick": tick, "timestamp_ms": tick, "mean_utility": utility, "min_safety": 1.0, "quarantine_fraction": 0.0, "bus_drop_rate": 0.0, "awareness_coverage": 1.0, "phage_events_this_tick": 0, "phage_events_total": 0, "deterministic_alarm": alarm, "health_score": 0.0, "needs_healing": False}


def test_stream_hourly_and_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    hour = 3_600_000
    for i, at in enumerate((0, 10, hour, hour + 5)):
        (folder / f"{i}.json").write_text(json.dumps({"sent_at_ms": at, "reports": [report(i, 0.5 + i / 10), report(i + 10, alarm=i == 3)]}))
    events = telemetry.scored(telemetry.read_batches(spark, str(folder)))
    q = telemetry.hourly(events).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("hourly").orderBy("hour").collect()
    assert [(r.batch_count, r.event_count, r.alarm_events) for r in rows] == [(2, 4, 0), (2, 4, 1)]
    assert abs(rows[0].min_utility - 0.5) < 1e-12 and abs(rows[0].avg_health - (0.8 + 0.84 + 0.96 + 0.96) / 4) < 1e-9
    telemetry.ingest(events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    telemetry.ingest(events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_stream_state(spark, tmp_path):
    folder = tmp_path / "ticks"
    folder.mkdir()
    labels = "AABABBBBBA"
    for part in (0, 1):
        (folder / f"{part}.json").write_text("\n".join(json.dumps({"k": 1, "tick": t, "seen": labels[t]}) for t in range(part * 5, part * 5 + 5)))
        os.utime(folder / f"{part}.json", (1_000_000 + part, 1_000_000 + part))
    t = spark.readStream.schema("k LONG, tick LONG, seen STRING").option("maxFilesPerTrigger", 1).json(str(folder))
    for name, stream in (("limits", telemetry.rate_limited(t, "k", window=4, most=2)), ("held", telemetry.held_regimes(t, "k", "seen", 3, "A"))):
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    assert [r.tick for r in spark.table("limits").filter("allowed").orderBy("tick").collect()] == [0, 1, 5, 6]
    assert "".join(r.held for r in spark.table("held").orderBy("tick").collect()) == "AAAAAABBBB"


def test_stream_forgets_idle_keys_and_keeps_the_latest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.json").write_text("\n".join(json.dumps({"k": 1, "tick": t}) for t in range(part * 5, part * 5 + 5)))
        os.utime(folder / f"{part}.json", (1_000_000 + part, 1_000_000 + part))
    t = spark.readStream.schema("k LONG, tick LONG").option("maxFilesPerTrigger", 1).json(str(folder))
    query = telemetry.rate_limited(t, "k", window=4, most=2, idle_ms=3_600_000)
    running = query.writeStream.format("memory").queryName("idle").outputMode("append").start()  # timeouts want a query that goes on
    for _ in range(60):
        if spark.table("idle").count() == 15:
            break
        time.sleep(1)
    running.stop()
    assert spark.table("idle").count() == 15 and [r.tick for r in spark.table("idle").filter("allowed").orderBy("tick").collect()][:4] == [0, 1, 5, 6]
    telemetry.latest(t, 4).trigger(availableNow=True).start().awaitTermination(180)
    assert [r.tick for r in spark.table("latest_reports").collect()] == [14, 13, 12, 11]


def test_bounded_queue(spark):
    df = spark.createDataFrame([(1, "s", 0), (2, "s", 0), (3, "s", 0), (4, "u", 0)], "event_id long, stream string, tick long")
    assert {r.event_id for r in telemetry.bounded(df, 2).filter("dropped").collect()} == {3}
