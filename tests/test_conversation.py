"""Carried state: batch and stream against a plain loop."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isotherm.functions.questions import with_routes
from isotherm.operators import linking
from isotherm.operators.conversation import carried_answers, history_text, recent_turns, route_turns, routed_texts
from isotherm.session import _file_system, _work_root, new_work_path
from isotherm.streaming import conversation
from isotherm.streaming.conversation import PARTS, route_conversations

TALKS = {
    1: ["why is that?", "explain it", "weather in Oslo today", "why?", "hello there", "tell me more"],
    2: ["weather and climate please", "elaborate", "more info", "climate trends", "why"],
    3: ["hello there", "why is that?", "more info", "rain now", "details"],
    4: ["why did the climate change", "why", "is it raining now", "what about it"],
    5: ["temperature in Rome in 2001", "reason?", "past 3 years", "elaborate"],
    6: ["Saudi Arabbia please", "why?", "weather in Paris today", "why?", "rain now"],
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, t, x) for c, texts in TALKS.items() for t, x in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)


@pytest.fixture(scope="module")
def names(spark):
    return linking.dictionary((spark.createDataFrame([("Saudi Arabia",), ("Peru",)], "n string"), "n", "Country"))


def as_of():
    return F.lit(dt.date(2024, 6, 30))


def route_all(turns, names):
    keyed = turns.withColumn("key", F.struct("conv_id", "turn"))
    return routed_texts(keyed, "key", "text", names, as_of()).drop("key")


@pytest.fixture(scope="module")
def expected(turns):
    """``route, last source, last place`` of each turn by a plain loop."""
    flagged = turns.withColumn("names_place", F.col("text").contains("Saudi Arabbia"))
    rows = {(r["conv_id"], r["turn"]): r for r in with_routes(flagged, "text", as_of()).collect()}
    out = {}
    for conv, texts in TALKS.items():
        source = place = None
        for turn in range(len(texts)):
            row = rows[conv, turn]
            route = row["fixed"]
            if route is None and row["follow"] and source:
                route = "climate" if source == "hybrid" else source
            route = route or row["keyword"]
            out[conv, turn] = (route, source, place)
            if route != "out_of_scope":
                source = "weather" if route == "historical_weather" else route
                place = None if route == "climate" else row["place"] or (place if route == "weather" else None)
    return out


def test_batch(turns, names, expected):
    routed = route_all(turns, names)
    got = {(r["conv_id"], r["turn"]): r["route"] for r in route_turns(routed).collect()}
    assert got == {k: v[0] for k, v in expected.items()}
    assert {"weather", "climate", "hybrid", "historical_weather", "out_of_scope"} <= set(got.values())
    assert got[6, 0] == "climate"  # by a misspelt name alone
    whole = {(r["conv_id"], r["turn"]): (r["route"], r["last_source"], r["last_place"]) for r in carried_answers(routed).collect()}
    assert whole == expected


def test_stream(spark, turns, names, expected):
    folder, out = new_work_path(spark, "turns"), new_work_path(spark, "routes")
    for low in (0, 2, 4):  # later turns arrive in later files
        turns.where(F.col("turn").between(low, low + 1)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    log = new_work_path(spark, "log")
    route_conversations(stream, names, as_of(), out, log).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert {(r["conv_id"], r["turn"]): (r["route"], r["last_source"], r["last_place"]) for r in got} == expected
    assert {r["batch"] for r in got} == {0, 1, 2}
    state = spark.read.format("statestore").option("path", f"{log}/state").option("stateVarName", "left").load()
    assert state.count() == state.select("key.conv_id").distinct().count() == len(TALKS)


@pytest.fixture
def keywords_only(monkeypatch):
    """Texts are routed without looking for names, so that a micro-batch takes little time."""
    def routed(texts, key, text, names, as_of, measure):
        return with_routes(texts.withColumn("names_place", F.lit(False)), text, as_of).drop(text)

    monkeypatch.setattr(conversation, "routed_texts", routed)


def stream_of(spark):
    """Runs the files that ``add`` puts into a folder, each call of ``run`` from where the last one stopped."""
    schema = "conv_id long, turn long, text string, ts timestamp"
    folder, out, log = (new_work_path(spark, n) for n in ("turns", "routes", "log"))

    def run(rows, names):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        route_conversations(stream, names, as_of(), out, log, ts="ts").awaitTermination()
        return {(r["conv_id"], r["turn"]): (r["route"], r["last_source"], r["last_place"]) for r in spark.read.parquet(out).collect()}

    return run, out, log


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_stream_state(spark, names, keywords_only):
    """State goes when the stream's clock is 30 days past a conversation, whatever the clock on the wall says.

    A batch of parts that is written again, as after a failure between writing and committing, is carried once. Turns
    and parts of answered rounds go, and what a micro-batch stages goes with it.
    """
    run, out, log = stream_of(spark)
    system, root = _file_system(spark, _work_root(spark))
    run([(1, 0, "weather in Oslo today", day(0)), (2, 0, "weather in Oslo today", day(0))], names)
    before = {s.getPath().getName() for s in system.listStatus(root)}
    got = run([(1, 1, "why?", day(20)), (3, 0, "climate trends", day(29))], names)
    assert got[1, 1] == ("weather", "weather", "Oslo")
    parts = f"{out}-work/parts/batch=1"
    again = spark.read.schema(PARTS).parquet(parts).collect()
    spark.createDataFrame(again, PARTS).coalesce(1).write.mode("append").parquet(parts)
    got = run([(2, 1, "why?", day(31)), (1, 2, "why?", day(31))], names)
    assert got[1, 2] == ("weather", "weather", "Oslo")
    assert got[2, 1][1:] == (None, None)
    run([(4, 0, "climate trends", day(80))], names)  # takes the watermark 30 days past all others
    state = spark.read.format("statestore").option("path", f"{log}/state").option("stateVarName", "left").load()
    assert [r[0] for r in state.select("key.conv_id").collect()] == [4]
    assert spark.read.parquet(out).count() == 7
    assert {s.getPath().getName() for s in system.listStatus(root)} == before
    for kind in ("turns", "parts"):
        _, folder = _file_system(spark, f"{out}-work/{kind}")
        assert [s.getPath().getName() for s in system.listStatus(folder)] == ["batch=3"]


def test_history(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f" line {t}\n") for t in range(12)] + [(2, 0, "user", "  ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert recent_turns(df, 10).where("conv_id = 1").agg(F.min("turn")).first()[0] == 2
    got = {r["conv_id"]: r["history"] for r in history_text(df, 3).collect()}
    assert got == {1: "USER: line 9\nASSISTANT: line 10\nUSER: line 11", 2: "No previous conversation."}
