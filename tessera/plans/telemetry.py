"""Queries of tick streams: health, regimes, rolling windows, gates, ledgers, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import folds, graph
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


ORDER = ["tick"]
_HEALTH = "least(1, greatest(0, 0.4::DOUBLE * utility + 0.4::DOUBLE * safety + 0.2::DOUBLE * coverage - (CASE WHEN alarm THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * quarantine)))"
HEALTH_SQL = f"{TICKS_SQL.strip()}, h AS (SELECT *, {_HEALTH} AS health, alarm OR quarantine > 0.5 OR safety <= 0 OR drop_rate > 0.3 AS needs_healing FROM t)"


def health(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir)
    c = {k: F.col(k) for k in ("utility", "safety", "coverage", "alarm", "quarantine", "drop_rate")}
    return t.withColumn("health", S.health_score(c["utility"], c["safety"], c["coverage"], c["alarm"], c["quarantine"])).withColumn("needs_healing", S.needs_healing(c["alarm"], c["quarantine"], c["safety"], c["drop_rate"]))


@query("telemetry_health", f"WITH {HEALTH_SQL} SELECT event_id, round(health, 6) AS health, needs_healing FROM h")
def telemetry_health(spark, sf_dir):
    return health(spark, sf_dir).select("event_id", F.round("health", 6).alias("health"), "needs_healing")


@query(
    "telemetry_hourly",
    f"""WITH {HEALTH_SQL} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(DISTINCT batch_id) AS batch_count, count(*) AS event_count, round(avg(utility), 6) AS avg_utility, min(utility) AS min_utility, max(utility) AS max_utility,
    round(avg(health), 6) AS avg_health, count(*) FILTER (WHERE needs_healing) AS healing_events, count(*) FILTER (WHERE alarm) AS alarm_events FROM h GROUP BY 1""",
)
def telemetry_hourly(spark, sf_dir):
    return hourly(health(spark, sf_dir), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))


def hourly(t: DataFrame, hour) -> DataFrame:
    return t.groupBy(hour).agg(
        F.countDistinct("batch_id").alias("batch_count"),
        F.count(F.lit(1)).alias("event_count"),
        F.round(F.avg("utility"), 6).alias("avg_utility"),
        F.min("utility").alias("min_utility"),
        F.max("utility").alias("max_utility"),
        F.round(F.avg("health"), 6).alias("avg_health"),
        F.count_if("needs_healing").alias("healing_events"),
        F.count_if("alarm").alias("alarm_events"),
    )


REGIME_SQL = f"{HEALTH_SQL}, r AS (SELECT *, CASE WHEN utility > 0.75 AND health > 0.8 THEN 'Thriving' WHEN utility < 0.4 OR quarantine > 0.6 THEN 'Recovering' WHEN utility < 0.2 AND health < 0.4 THEN 'Catastrophic' ELSE 'Stressed' END AS regime FROM h)"


def regimes(spark, sf_dir):
    return health(spark, sf_dir).withColumn("regime", S.view_regime(F.col("utility"), F.col("health"), F.col("quarantine")))


@query("regime_transitions", f"WITH {REGIME_SQL}, l AS (SELECT *, lag(regime) OVER (PARTITION BY batch_id ORDER BY tick) AS prev_regime FROM r) SELECT batch_id, tick, regime, prev_regime FROM l WHERE prev_regime IS NULL OR prev_regime <> regime")
def regime_transitions(spark, sf_dir):
    return folds.transitions(regimes(spark, sf_dir), "batch_id", ORDER, "regime").select("batch_id", "tick", "regime", "prev_regime")


# Folds as recursions over ticks, for DuckDB.
_SEEN = "CASE WHEN utility < 0.2 AND {stress} > 0.7 THEN 'Catastrophic' WHEN utility < 0.4 OR drop_rate > 0.5 OR quarantine > 0.6 THEN 'Recovering' WHEN utility > 0.75 AND {stress} < 0.3 THEN 'Thriving' ELSE 'Stressed' END"


def _held_sql(name: str, source: str) -> str:
    """A recursion ``name`` (batch_id, tick, held, n) over ``source`` (batch_id, tick, seen)."""
    keep = "CASE WHEN s.seen = {h} THEN {h} WHEN {n} > 0 THEN {h} ELSE s.seen END, CASE WHEN s.seen = {h} THEN {n} + 1 WHEN {n} > 0 THEN {n} - 1 ELSE 5 END"
    return f"""{name}(batch_id, tick, held, n) AS (SELECT s.batch_id, s.tick, {keep.format(h="'Thriving'", n="0")} FROM {source} s WHERE s.tick = 1
    UNION ALL SELECT s.batch_id, s.tick, {keep.format(h="r.held", n="r.n")} FROM {name} r JOIN {source} s ON s.batch_id = r.batch_id AND s.tick = r.tick + 1)"""


def _hormones_sql() -> str:
    """A recursion ``hl`` over t with the eight levels and the smoothed fitness e."""
    c = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"

    def row(p: dict[str, str]) -> str:
        e = f"(0.85::DOUBLE * {p['e']} + 0.15::DOUBLE * utility)"
        co = c(f"0.6::DOUBLE * 0.92::DOUBLE * {p['cortisol']} + 0.4::DOUBLE * quarantine")
        ad = c(f"CASE WHEN drop_rate > 0.1 THEN least(drop_rate, 1.0::DOUBLE) ELSE 0.4::DOUBLE * {p['adrenaline']} END")
        do = c(f"0.3::DOUBLE * {p['dopamine']} + 0.7::DOUBLE * {c(f'0.8::DOUBLE * {e} - 0.3::DOUBLE * drop_rate')}")
        se = c(f"0.6::DOUBLE * {p['serotonin']} + 0.4::DOUBLE * {c(f'0.6::DOUBLE * {e} + 0.4::DOUBLE * (1 - quarantine)')}")
        ac = c(f"0.4::DOUBLE * 0.9::DOUBLE * {p['acetylcholine']} + 0.6::DOUBLE * (drop_rate + quarantine)")
        st = c(f"0.4::DOUBLE * {co} + 0.4::DOUBLE * {ad} + 0.2::DOUBLE * (1 - {se})")
        ga = c(f"0.6::DOUBLE * {p['gaba']} + 0.4::DOUBLE * (0.5::DOUBLE + {st} * (1 - {e}))")
        ox = c(f"CASE WHEN {e} > 0.7 THEN 0.7::DOUBLE * 0.9::DOUBLE WHEN {e} < 0.3 THEN 0.7::DOUBLE * 0.4::DOUBLE ELSE 0.7::DOUBLE * {p['oxytocin']} END + 0.3::DOUBLE * 0.6::DOUBLE")
        gr = c(f"0.2::DOUBLE * exp(-t.tick / 500000.0::DOUBLE) + 0.8::DOUBLE * greatest({e}, 0.3::DOUBLE)")
        return f"SELECT t.batch_id, t.tick, {e}, {gr}, {co}, {ad}, {do}, {se}, {ac}, {ga}, {ox}"

    first = {"e": "0.5::DOUBLE"} | {k: f"{v}::DOUBLE" for k, v in folds.HORMONES.items()}
    names = ", ".join(["batch_id", "tick", "e", *folds.HORMONES])
    return f"hl({names}) AS ({row(first)} FROM t WHERE t.tick = 1 UNION ALL {row({k: f'r.{k}' for k in first})} FROM hl r JOIN t ON t.batch_id = r.batch_id AND t.tick = r.tick + 1)"


def _cut(x: str) -> str:
    """To six places, with the boundary beside the halves that short decimals hit, where engines round apart."""
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.4999::DOUBLE) / 1000000.0::DOUBLE"


def cut(c: str):
    return (F.floor(F.col(c) * 1000000.0 + 0.4999) / 1000000.0).alias(c)


_STRESS = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * cortisol + 0.4::DOUBLE * adrenaline + 0.2::DOUBLE * (1 - serotonin)))"
_HORMONES_SQL = f"WITH RECURSIVE {TICKS_SQL.strip()}, {_hormones_sql()}, hs AS (SELECT *, {_STRESS} AS stress FROM hl)"


def _moods_sql() -> str:
    c = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
    confidence = "CASE regime " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in folds.CONFIDENCE.items()) + " END"
    target = {
        "valence": "0.4::DOUBLE * dopamine + 0.4::DOUBLE * serotonin + 0.2::DOUBLE * utility - 0.3::DOUBLE * cortisol",
        "arousal": "0.3::DOUBLE * adrenaline + 0.3::DOUBLE * acetylcholine - 0.2::DOUBLE * gaba - 0.15::DOUBLE * growth",
        "confidence": confidence,
        "curiosity": "0.4::DOUBLE * growth + 0.35::DOUBLE * utility + 0.25::DOUBLE * (1 - gaba)",
    }
    row = lambda p: ", ".join(c(f"0.85::DOUBLE * {p[k]} + 0.15::DOUBLE * {c(x)}") for k, x in target.items())
    first, names = row({k: f"{v}::DOUBLE" for k, v in folds.MOOD.items()}), ", ".join(target)
    return f"""{_HORMONES_SQL}, sn AS (SELECT hs.*, t.utility, {_SEEN.format(stress="stress")} AS seen FROM hs JOIN t USING (batch_id, tick)), {_held_sql("hd", "sn")}, x AS (SELECT sn.*, hd.held AS regime FROM sn JOIN hd USING (batch_id, tick)),
    m(batch_id, tick, {names}) AS (SELECT x.batch_id, x.tick, {first} FROM x WHERE x.tick = 1 UNION ALL SELECT x.batch_id, x.tick, {row({k: f"r.{k}" for k in target})} FROM m r JOIN x ON x.batch_id = r.batch_id AND x.tick = r.tick + 1)"""


@query("regime_hysteresis", f"WITH RECURSIVE {TICKS_SQL.strip()}, sn AS (SELECT batch_id, tick, {_SEEN.format(stress='(1 - safety)')} AS seen FROM t), {_held_sql('hd', 'sn')} SELECT batch_id, tick, held FROM hd")
def regime_hysteresis(spark, sf_dir):
    """Held labels of the detector."""
    t = ticks(spark, sf_dir).withColumn("seen", S.detector_regime(F.col("utility"), 1 - F.col("safety"), F.col("drop_rate"), F.col("quarantine")))
    return folds.hysteresis(t.select("batch_id", "tick", "seen"), "batch_id", ORDER, "seen")


@query("detector_regimes", f"WITH {TICKS_SQL} SELECT CASE WHEN utility < 0.2 AND 1 - safety > 0.7 THEN 'Catastrophic' WHEN utility < 0.4 OR drop_rate > 0.5 OR quarantine > 0.6 THEN 'Recovering' WHEN utility > 0.75 AND 1 - safety < 0.3 THEN 'Thriving' ELSE 'Stressed' END AS regime, count(*) AS n FROM t GROUP BY 1")
def detector_regimes(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.groupBy(S.detector_regime(F.col("utility"), 1 - F.col("safety"), F.col("drop_rate"), F.col("quarantine")).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("hormones", f"{_HORMONES_SQL} SELECT batch_id, tick, {', '.join(f'{_cut(h)} AS {h}' for h in folds.HORMONES)}, {_cut('stress')} AS stress, {_cut('least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * stress + 0.4::DOUBLE * (1 - dopamine)))')} AS urgency FROM hs")
def hormones_query(spark, sf_dir):
    h = hormones(spark, sf_dir)
    return h.select("batch_id", "tick", *[cut(c) for c in (*folds.HORMONES, "stress", "urgency")])


def hormones(spark, sf_dir) -> DataFrame:
    """Hormone levels and what follows from them."""
    t = ticks(spark, sf_dir).select("batch_id", "tick", "utility", "drop_rate", "quarantine")
    h = folds.hormones(t, "batch_id", ORDER)
    return h.withColumn("stress", S.stress_level(F.col("cortisol"), F.col("adrenaline"), F.col("serotonin"))).withColumn("urgency", S.recovery_urgency(F.col("stress"), F.col("dopamine")))


@query("moods", f"{_moods_sql()} SELECT batch_id, tick, {', '.join(f'{_cut(m)} AS {m}' for m in folds.MOOD)}, CASE WHEN valence > 0.7 THEN 'optimistic' WHEN valence > 0.5 THEN 'content' WHEN valence > 0.3 THEN 'worried' ELSE 'distressed' END || ' yet ' || CASE WHEN arousal > 0.7 THEN 'alert' WHEN arousal > 0.4 THEN 'active' ELSE 'calm' END AS mood FROM m")
def moods(spark, sf_dir):
    """Emotional state under the regime that the detector holds, stress taken from the hormones."""
    t = ticks(spark, sf_dir).select("batch_id", "tick", "utility", "drop_rate", "quarantine")
    h = hormones(spark, sf_dir).join(t, ["batch_id", "tick"])
    seen = h.withColumn("seen", S.detector_regime(F.col("utility"), F.col("stress"), F.col("drop_rate"), F.col("quarantine")))
    held = folds.hysteresis(seen.select("batch_id", "tick", "seen"), "batch_id", ORDER, "seen").withColumnRenamed("held", "regime")
    m = folds.moods(h.join(held, ["batch_id", "tick"]), "batch_id", ORDER)
    m = m.withColumn("mood", S.mood(F.col("valence"), F.col("arousal")))
    return m.select("batch_id", "tick", *[cut(c) for c in folds.MOOD], "mood")


@query("rolling_health", f"WITH {HEALTH_SQL} SELECT event_id, round(avg(health) OVER (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling, count(*) OVER w5 = 5 AND max(health) OVER w5 < 0.5 AS degraded FROM h WINDOW w5 AS (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_health(spark, sf_dir):
    h = health(spark, sf_dir)
    return h.select("event_id", F.round(folds.rolling_mean("health", "batch_id", ORDER, 10), 6).alias("rolling"), folds.sustained_below("health", "batch_id", ORDER, 5, 0.5).alias("degraded"))


@query(
    "low_utility_streaks",
    f"""WITH {TICKS_SQL}, i AS (SELECT *, sum(CASE WHEN utility < 0.3 AND safety > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY batch_id ORDER BY tick) AS island FROM t),
    s AS (SELECT event_id, safety, CAST(sum(CASE WHEN utility < 0.3 AND safety > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id, island ORDER BY tick) AS BIGINT) AS streak FROM i)
    SELECT event_id, streak, CASE WHEN safety <= 0 THEN 'deterministic' WHEN streak > 0 AND streak % 2 = 0 THEN 'load' END AS alarm FROM s""",
)
def low_utility_streaks(spark, sf_dir):
    """Load fires on every second tick of a streak; no safety fires at once, and ends the streak."""
    s = folds.streaks(ticks(spark, sf_dir), "batch_id", ORDER, (F.col("utility") < 0.3) & (F.col("safety") > 0))
    return s.select("event_id", "streak", F.when(F.col("safety") <= 0, "deterministic").when((F.col("streak") > 0) & (F.col("streak") % 2 == 0), "load").alias("alarm"))


@query(
    "drift",
    f"""WITH {TICKS_SQL}, b AS (SELECT batch_id, avg(utility) AS base FROM t WHERE tick <= 5 GROUP BY batch_id),
    w AS (SELECT event_id, batch_id, avg(utility) OVER (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS now FROM t)
    SELECT event_id, round(abs(now - base) / (base + 0.001::DOUBLE), 6) AS ratio, abs(now - base) / (base + 0.001::DOUBLE) > 0.4 AS drifted FROM w JOIN b USING (batch_id)""",
)
def drift(spark, sf_dir):
    """Mean of the last ten ticks against the warm-up of five."""
    t = ticks(spark, sf_dir)
    base = t.filter("tick <= 5").groupBy("batch_id").agg(F.avg("utility").alias("base"))
    now = t.withColumn("now", folds.rolling_mean("utility", "batch_id", ORDER, 10)).join(base, "batch_id")
    ratio = F.abs(F.col("now") - F.col("base")) / (F.col("base") + 0.001)
    return now.select("event_id", F.round(ratio, 6).alias("ratio"), (ratio > 0.4).alias("drifted"))


@query(
    "load_trend",
    f"""WITH {TICKS_SQL}, w AS (SELECT event_id, tick, value, sum(value) OVER (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS now,
    coalesce(sum(value) OVER (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0) / 3 AS before, avg(value) OVER (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean10 FROM t)
    SELECT event_id, round(CASE WHEN tick < 2 THEN value ELSE greatest(0, now + (now - before)) END, 4) AS predicted, trunc(mean10)::BIGINT >= 50 AS bottleneck FROM w""",
)
def load_trend(spark, sf_dir):
    """The last three against the three before, the divisor three even where there are fewer; a first value stands for itself."""
    t = ticks(spark, sf_dir)
    w = Window.partitionBy("batch_id").orderBy(*ORDER)
    now = F.sum("value").over(w.rowsBetween(-2, 0)) / 3
    before = F.coalesce(F.sum("value").over(w.rowsBetween(-5, -3)), F.lit(0.0)) / 3
    return t.select("event_id", F.round(F.when(F.col("tick") < 2, F.col("value")).otherwise(F.greatest(F.lit(0.0), now + (now - before))), 4).alias("predicted"), (folds.rolling_mean("value", "batch_id", ORDER, 10).cast("long") >= 50).alias("bottleneck"))


@query(
    "forecast",
    f"""WITH {TICKS_SQL}, w AS (SELECT batch_id, tick, value, row_number() OVER (PARTITION BY batch_id ORDER BY tick DESC) AS back FROM t)
    SELECT batch_id, count(*) AS n, round(arg_max(value, tick) + (arg_max(value, tick) - arg_min(value, tick)) / count(*) * 10, 4) AS ahead, round(regr_intercept(value, tick) + regr_slope(value, tick) * (max(tick) + 1), 4) AS line FROM w WHERE back <= 20 GROUP BY batch_id HAVING count(*) > 1""",
)
def forecast(spark, sf_dir):
    """Ten steps by the trend of the last twenty values, and one step by least squares."""
    t = folds.last_rows(ticks(spark, sf_dir), "batch_id", ["tick"], 20)
    last, first = F.max_by("value", "tick"), F.min_by("value", "tick")
    line = F.regr_intercept("value", "tick") + F.regr_slope("value", "tick") * (F.max("tick") + 1)
    return t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(last + (last - first) / F.count(F.lit(1)) * 10, 4).alias("ahead"), F.round(line, 4).alias("line")).filter("n > 1")


SHARPE_SQL = f"""{TICKS_SQL.strip()}, w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM t),
s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM w WHERE back <= 20 GROUP BY event_type)"""


def sharpe(spark, sf_dir):
    """Mean over deviation of the last twenty; the mean where they hardly vary."""
    t = folds.last_rows(ticks(spark, sf_dir), "event_type", ["ts", "event_id"], 20)
    s = t.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return s.select("event_type", F.round(F.when(F.col("sd") < 0.001, F.col("m")).otherwise(F.col("m") / F.col("sd")), 6).alias("sharpe"))


@query("portfolio", f"WITH {SHARPE_SQL}, q AS (SELECT event_type, round(CASE WHEN sd < 0.001 THEN m ELSE m / sd END, 6) AS sharpe FROM s), k AS (SELECT *, row_number() OVER (ORDER BY sharpe DESC, event_type) AS rk FROM q) SELECT event_type, sharpe, CASE rk WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END AS weight FROM k")
def portfolio(spark, sf_dir):
    rank = F.row_number().over(Window.orderBy(F.desc("sharpe"), "event_type"))  # one row an event type
    return sharpe(spark, sf_dir).withColumn("rk", rank).select("event_type", "sharpe", F.when(F.col("rk") == 1, 0.4).when(F.col("rk") == 2, 0.3).when(F.col("rk") == 3, 0.2).otherwise(0.05).alias("weight"))


@query(
    "sla_coverage",
    f"""WITH {TICKS_SQL}, c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT DISTINCT event_type FROM t)
    SELECT d.day, round(count(*) FILTER (WHERE coalesce(c.n, 0) > 60)::DOUBLE / count(*), 6) AS coverage FROM (SELECT DISTINCT day FROM c) d CROSS JOIN r LEFT JOIN c ON c.day = d.day AND c.event_type = r.event_type GROUP BY d.day""",
)
def sla_coverage(spark, sf_dir):
    """Share of registered streams with more than 60 events a day; registered ones without any count."""
    t = ticks(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    registered = t.select("event_type").distinct().agg(F.count(F.lit(1)).alias("streams"))
    met = t.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.count_if(F.col("n") > 60).alias("met"))
    return met.join(F.broadcast(registered), how="cross").select("day", F.round(F.col("met") / F.col("streams"), 6).alias("coverage"))


@query("batch_ingest", f"WITH {HEALTH_SQL} SELECT batch_id, count(*) AS record_count, min(tick) AS tick_min, max(tick) AS tick_max, round(avg(utility), 6) AS utility_avg, round(min(health), 6) AS health_min, round(max(health), 6) AS health_max, round(avg(quarantine), 6) AS quarantine_avg, round(arg_max(health, tick), 6) AS last_health FROM h GROUP BY batch_id")
def batch_ingest(spark, sf_dir):
    h = health(spark, sf_dir)
    r = lambda c: F.round(c, 6)
    return h.groupBy("batch_id").agg(F.count(F.lit(1)).alias("record_count"), F.min("tick").alias("tick_min"), F.max("tick").alias("tick_max"), r(F.avg("utility")).alias("utility_avg"), r(F.min("health")).alias("health_min"), r(F.max("health")).alias("health_max"), r(F.avg("quarantine")).alias("quarantine_avg"), r(F.max_by("health", "tick")).alias("last_health"))


@query(
    "federation",
    f"WITH {HEALTH_SQL} SELECT event_type, round(avg(utility), 6) AS mean_utility, min(safety) AS min_safety, round(avg(1 - safety), 6) AS stress, count(*) FILTER (WHERE safety <= 0.05) > 0 AS vetoed, min(event_id) FILTER (WHERE safety <= 0.05) AS vetoed_by FROM h GROUP BY event_type",
)
def federation(spark, sf_dir):
    h = health(spark, sf_dir)
    low = F.col("safety") <= 0.05
    return h.groupBy("event_type").agg(F.round(F.avg("utility"), 6).alias("mean_utility"), F.min("safety").alias("min_safety"), F.round(F.avg(1 - F.col("safety")), 6).alias("stress"), (F.count_if(low) > 0).alias("vetoed"), F.min(F.when(low, F.col("event_id"))).alias("vetoed_by"))


@query(
    "gates",
    f"""WITH {HEALTH_SQL}, b AS (SELECT batch_id, avg(coverage) AS c, avg(safety) AS s, count(*) * 20 AS beats, avg(utility) AS u FROM h GROUP BY batch_id)
    SELECT batch_id, concat_ws(',', CASE WHEN NOT c >= 0.95 THEN 'tests' END, CASE WHEN NOT s >= 0.75 THEN 'safety' END, CASE WHEN NOT beats >= 1000 THEN 'heartbeats' END, CASE WHEN NOT u >= 0.70 THEN 'utility' END) AS failed,
    round(0.35::DOUBLE * c + 0.35::DOUBLE * s + 0.2::DOUBLE * least(1, beats / 10000.0::DOUBLE) + 0.1::DOUBLE * u, 6) AS readiness FROM b""",
)
def gates(spark, sf_dir):
    """Adulthood: coverage stands for the share of tests passed, twenty heartbeats for a tick."""
    b = health(spark, sf_dir).groupBy("batch_id").agg(F.avg("coverage").alias("c"), F.avg("safety").alias("s"), (F.count(F.lit(1)) * 20).alias("beats"), F.avg("utility").alias("u"))
    c = [F.col(x) for x in ("c", "s", "beats", "u")]
    return b.select("batch_id", F.array_join(S.adulthood_gates(*c), ",").alias("failed"), F.round(S.readiness(*c), 6).alias("readiness"))


@query("route_decisions", f"WITH {TICKS_SQL}, s AS (SELECT *, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY batch_id ORDER BY tick) AS ms FROM t) SELECT CASE WHEN utility >= 0.7 AND coalesce(ms, 0) < 30000 THEN 'local' WHEN utility >= 0.4 THEN 'local_fallback' ELSE 'external' END AS route, count(*) AS n, round(avg(least(1, greatest(0, 0.5::DOUBLE + 0.5::DOUBLE * (utility - 0.6::DOUBLE)))), 6) AS confidence FROM s GROUP BY 1")
def route_decisions(spark, sf_dir):
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    t = ticks(spark, sf_dir).withColumn("at", F.floor(ms))
    t = t.withColumn("ms", F.coalesce(F.col("at") - F.lag("at").over(Window.partitionBy("batch_id").orderBy(*ORDER)), F.lit(0)))
    return t.groupBy(S.route(F.col("utility"), F.col("ms")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.normalized_confidence(F.col("utility"), F.lit(0.6))), 6).alias("confidence"))


_ASK = "greatest(0, t.tick - {last}) >= 10", "({fresh}) OR {used} < 3"


def _limited_sql() -> str:
    def row(last: str, used: str) -> str:
        fresh = _ASK[0].format(last=last)
        ok = _ASK[1].format(fresh=fresh, used=used)
        return f"SELECT t.batch_id, t.tick, {ok}, CASE WHEN {ok} THEN t.tick ELSE {last} END, CASE WHEN {fresh} THEN 1 WHEN {used} < 3 THEN {used} + 1 ELSE {used} END"

    return f"rl(batch_id, tick, allowed, last, used) AS ({row('0', '0')} FROM t WHERE t.tick = 1 UNION ALL {row('r.last', 'r.used')} FROM rl r JOIN t ON t.batch_id = r.batch_id AND t.tick = r.tick + 1)"


@query("rate_limited", f"WITH RECURSIVE {TICKS_SQL.strip()}, {_limited_sql()} SELECT batch_id, tick, allowed FROM rl")
def rate_limited(spark, sf_dir):
    """Ticks on which a change is allowed."""
    return folds.rate_limit(ticks(spark, sf_dir).select("batch_id", "tick"), "batch_id", "tick", 10, 3)


def _learnt_sql() -> str:
    def row(w: str, l: str, m: str, c: str) -> str:  # noqa: E741
        ok = "t.utility > 0.3"
        return f"""SELECT t.batch_id, t.tick, {w} + CASE WHEN {ok} THEN 1 ELSE 0 END, {l} + CASE WHEN NOT {ok} AND {w} > 0 THEN 1 ELSE 0 END, CASE WHEN {ok} THEN CASE WHEN {w} = 0 THEN t.utility ELSE ({m} + t.utility) / 2 END ELSE {m} END,
        CASE WHEN {ok} THEN CASE WHEN {w} = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, {c} + 0.05::DOUBLE) END WHEN {w} > 0 THEN greatest(0.0::DOUBLE, {c} - 0.05::DOUBLE) ELSE {c} END"""

    return f"pl(batch_id, tick, wins, losses, mean, confidence) AS ({row('0::BIGINT', '0::BIGINT', '0.0::DOUBLE', '0.5::DOUBLE')} FROM t WHERE t.tick = 1 UNION ALL {row('r.wins', 'r.losses', 'r.mean', 'r.confidence')} FROM pl r JOIN t ON t.batch_id = r.batch_id AND t.tick = r.tick + 1)"


@query("pattern_learning", f"WITH RECURSIVE {TICKS_SQL.strip()}, {_learnt_sql()}, z AS (SELECT batch_id, max(tick) AS tick FROM t GROUP BY batch_id) SELECT batch_id, wins AS successes, losses AS failures, round(mean, 6) AS mean_gain, round(confidence, 6) AS confidence FROM pl JOIN z USING (batch_id, tick) WHERE wins > 0")
def pattern_learning(spark, sf_dir):
    t = ticks(spark, sf_dir).select("batch_id", "tick", (F.col("utility") > 0.3).alias("ok"), F.col("utility").alias("gain"))
    out = folds.pattern_learning(t, "batch_id", "tick", "ok", "gain")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_gain", "confidence")})


# --------------------------------------------------------------------------- ledger


@query("hash_chain", f"""WITH RECURSIVE {TICKS_SQL}, e AS (SELECT batch_id, tick, event_id || ':' || event_type AS content FROM t),
    c AS (SELECT batch_id, tick, sha256(content) AS content_hash, sha256(content) AS chain_hash FROM e WHERE tick = 1 UNION ALL SELECT e.batch_id, e.tick, sha256(e.content), sha256(c.chain_hash || e.content) FROM c JOIN e ON e.batch_id = c.batch_id AND e.tick = c.tick + 1)
    SELECT batch_id, tick, content_hash, chain_hash FROM c""")
def hash_chain(spark, sf_dir):
    return folds.chain(_entries(spark, sf_dir), "batch_id", "tick", "content")


def _entries(spark, sf_dir):
    return ticks(spark, sf_dir).select("batch_id", "tick", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("content"))


@query("verify_chain", f"WITH {TICKS_SQL} SELECT batch_id, count(*) FILTER (WHERE tick % 13 = 5) AS broken FROM t GROUP BY batch_id")
def verify_chain(spark, sf_dir):
    """Broken links of each ledger, whose contents are tampered with at every thirteenth tick."""
    e = _entries(spark, sf_dir)
    stored = folds.chain(e, "batch_id", "tick", "content").join(e, ["batch_id", "tick"])
    stored = stored.withColumn("content", F.when(F.col("tick") % 13 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    broken = folds.verify_chain(stored, "batch_id", "tick", "content").groupBy("batch_id").agg(F.count(F.lit(1)).alias("broken"))
    return e.select("batch_id").distinct().join(broken, "batch_id", "left").select("batch_id", F.coalesce("broken", F.lit(0).cast("long")).alias("broken"))


@query("audit_summary", "SELECT event_type AS outcome, count(*) AS n, count(DISTINCT sha256(props)) AS contents FROM events GROUP BY 1")
def audit_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(T.content_hash(F.col("props"))).alias("contents"))


@query("outcome_extract", "SELECT coalesce(props->>'$.k', '') AS k, count(*) AS n FROM events GROUP BY 1")
def outcome_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("state_slots", f"WITH {TICKS_SQL} SELECT event_id AS slot_id, batch_id AS agent_id, coalesce(lag(event_id) OVER (PARTITION BY batch_id ORDER BY tick) + 1, 0) AS parent_offset, (tick - 1)::BIGINT AS generation FROM t")
def state_slots(spark, sf_dir):
    """Each slot points one past the agent's slot before; 0 for none."""
    w = Window.partitionBy("batch_id").orderBy(*ORDER)
    return ticks(spark, sf_dir).select(F.col("event_id").alias("slot_id"), F.col("batch_id").alias("agent_id"), F.coalesce(F.lag("event_id").over(w) + 1, F.lit(0)).cast("long").alias("parent_offset"), (F.col("tick") - 1).alias("generation"))


@query("lineage", f"WITH RECURSIVE {TICKS_SQL}, p AS (SELECT event_id AS slot_id, lag(event_id) OVER (PARTITION BY batch_id ORDER BY tick) AS parent_id, tick FROM t), s AS (SELECT slot_id FROM p WHERE tick = 8), r(start, slot_id, step) AS (SELECT slot_id, slot_id, 0 FROM s UNION ALL SELECT r.start, p.parent_id, r.step + 1 FROM r JOIN p ON p.slot_id = r.slot_id WHERE p.parent_id IS NOT NULL) SELECT start, slot_id, step FROM r")
def lineage(spark, sf_dir):
    """The way to the root from each agent's eighth slot."""
    w = Window.partitionBy("batch_id").orderBy(*ORDER)
    p = ticks(spark, sf_dir).select(F.col("event_id").alias("slot_id"), F.lag("event_id").over(w).alias("parent_id"), "tick")
    return graph.lineage(p.select("slot_id", "parent_id"), p.filter("tick = 8").select("slot_id"))


@query("agent_lineage", f"WITH RECURSIVE {TICKS_SQL}, p AS (SELECT event_id AS slot_id, batch_id, lag(event_id) OVER (PARTITION BY batch_id ORDER BY tick) AS parent_id, tick FROM t), s AS (SELECT arg_max(slot_id, tick) AS slot_id FROM p GROUP BY batch_id), r(start, slot_id, step) AS (SELECT slot_id, slot_id, 0 FROM s UNION ALL SELECT r.start, p.parent_id, r.step + 1 FROM r JOIN p ON p.slot_id = r.slot_id WHERE p.parent_id IS NOT NULL) SELECT start, slot_id, step FROM r")
def agent_lineage(spark, sf_dir):
    """The way to the root from each agent's latest slot: its whole lineage."""
    w = Window.partitionBy("batch_id").orderBy(*ORDER)
    p = ticks(spark, sf_dir).select("batch_id", F.col("event_id").alias("slot_id"), F.lag("event_id").over(w).alias("parent_id"), "tick")
    return graph.lineage(p.select("slot_id", "parent_id"), p.groupBy("batch_id").agg(F.max_by("slot_id", "tick").alias("slot_id")).select("slot_id"))


@query("replay_order", f"WITH {TICKS_SQL}, l AS (SELECT batch_id, ts < lag(ts) OVER (PARTITION BY batch_id ORDER BY tick) AS bad FROM t) SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE bad) AS out_of_order FROM l GROUP BY batch_id")
def replay_order(spark, sf_dir):
    w = Window.partitionBy("batch_id").orderBy(*ORDER)
    t = ticks(spark, sf_dir).withColumn("bad", F.coalesce(F.col("ts") < F.lag("ts").over(w), F.lit(False)))
    return t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("out_of_order"))


@query("tier_counts", f"WITH {TICKS_SQL}, x AS (SELECT CASE WHEN event_id = 0 THEN 'super' WHEN event_id < 50 THEN 'sub' WHEN event_id < 1050 THEN 'micro' ELSE 'nano' END AS tier, event_id FROM t) SELECT tier, count(*) AS n, min(event_id + CASE tier WHEN 'super' THEN 0 WHEN 'sub' THEN 1 WHEN 'micro' THEN 51 ELSE 1051 END) AS first_index, max('/super/0' || CASE WHEN tier IN ('sub', 'micro', 'nano') THEN '/sub/' || event_id % 50 ELSE '' END || CASE WHEN tier IN ('micro', 'nano') THEN '/micro/' || event_id % 1000 ELSE '' END || CASE WHEN tier = 'nano' THEN '/nano/' || event_id ELSE '' END) AS last_path FROM x GROUP BY tier")
def tier_counts(spark, sf_dir):
    t = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") == 0, "super").when(F.col("event_id") < 50, "sub").when(F.col("event_id") < 1050, "micro").otherwise("nano").alias("tier"))
    path = S.agent_path(F.col("tier"), F.col("event_id") % 50, F.col("event_id") % 1000, F.col("event_id"))
    return t.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min(S.global_index(F.col("tier"), F.col("event_id"))).alias("first_index"), F.max(path).alias("last_path"))


@query("pareto_front", "WITH c AS (SELECT p_brand, p_partkey, p_size % 7 AS task, p_partkey % 11 AS bio, p_partkey % 5 AS safety, p_size % 13 AS cost FROM part) SELECT p_brand, p_partkey FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.p_brand = a.p_brand AND b.task >= a.task AND b.bio >= a.bio AND b.safety >= a.safety AND b.cost <= a.cost AND (b.task > a.task OR b.bio > a.bio OR b.safety > a.safety OR b.cost < a.cost))")
def pareto_front(spark, sf_dir):
    """Candidates that none of the same brand dominates; distinct points compete, so a crowd of equals is one."""
    c = read(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 7).alias("task"), (F.col("p_partkey") % 11).alias("bio"), (F.col("p_partkey") % 5).alias("safety"), (F.col("p_size") % 13).alias("cost"))
    points = c.select("p_brand", "task", "bio", "safety", "cost").distinct()
    a, b = points.alias("a"), points.alias("b")
    axes = ("task", "bio", "safety", "cost")
    beaten = S.dominates({k: F.col(f"b.{k}") for k in axes}, {k: F.col(f"a.{k}") for k in axes})
    front = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & beaten, "left_anti")
    return c.join(front, ["p_brand", *axes], "left_semi").select("p_brand", "p_partkey")
