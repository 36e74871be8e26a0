import datetime as dt
import random

from pyspark.sql import functions as F

from evidentia.operators import correlate
from evidentia.streaming import live

T0 = dt.datetime(2024, 1, 1)


def _run(spark, tmp_path, make, mode="append"):
    data = [(f"f{i % 4}", "o", T0 + dt.timedelta(seconds=i * 7)) for i in range(40)]
    spark.createDataFrame(data, "id string, origin string, ts timestamp").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, origin string, ts timestamp").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    return spark.table("out").collect(), spark.read.parquet(str(tmp_path / "in"))


def test_dedupe_equals_batch(spark, tmp_path):
    found, batch = _run(spark, tmp_path, live.stream_dedupe)
    assert sorted(r.id for r in found) == sorted(r.id for r in batch.select("id").distinct().collect())


def test_rate_equals_batch(spark, tmp_path):
    found, batch = _run(spark, tmp_path, lambda s: live.stream_rate(s, "1 minute"), "complete")
    assert sum(r.n for r in found) == batch.count()
    assert sorted((r.start, r.n) for r in found) == sorted((r.start, r.n) for r in live.stream_rate(batch, "1 minute").collect())


def test_sink_is_idempotent(spark, tmp_path):
    spark.range(5).selectExpr("cast(id % 3 as string) id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string").parquet(str(tmp_path / "in"))
    live.sink_findings(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def _stream(spark, path, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def _table(query, name, tmp_path):
    q = query.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.awaitTermination(180)
    return query.sparkSession.table(name).collect()


def test_sessions_end_by_themselves_or_by_time(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "session_id long, ts timestamp, hit boolean, last boolean"
    rows = [(1, at(0), True, False), (1, at(5), False, True), (2, at(1), False, True), (3, at(2), True, False), (4, at(3), True, False), (4, at(4), False, False), (4, at(6), False, True)]
    _stream(spark, tmp_path / "in", rows, schema)
    stream = live.stream_sessions(_stream(spark, tmp_path / "in", [(9, at(100_000), False, True)], schema), 2, 60_000, "1 second")
    got = {r.session_id: (r.events, r.hits, r.verdict) for r in _table(stream, "sessions", tmp_path)}
    assert got[1] == (2, 1, "confirmed") and got[2] == (1, 0, "refuted") and got[4] == (3, 1, "inconclusive") and got[9][2] == "refuted"
    assert got.get(3, (1, 1, "inconclusive")) == (1, 1, "inconclusive")


def test_spans_join_their_stops(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    a = _stream(spark, tmp_path / "a", [("x", at(0)), ("y", at(1)), ("z", at(90_000))], "context string, ts timestamp")
    b = _stream(spark, tmp_path / "b", [("x", at(2), "stop"), ("w", at(3), "stop"), ("q", at(90_000), "exception")], "context string, ts timestamp, outcome string")
    got = {r.context: (r.micros, r.outcome) for r in _table(live.stream_spans(a, b, "1 minute", "1 second"), "spans", tmp_path)}
    assert got["x"] == (2_000_000, "stop") and got.get("y", (None, "incomplete")) == (None, "incomplete") and "w" not in got


def test_pairs_and_windows_equal_batch(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    s = _stream(spark, tmp_path / "s", [(1, at(0)), (2, at(1))], "id long, ts timestamp")
    r = _stream(spark, tmp_path / "r", [(1, at(3)), (2, at(500))], "id long, ts timestamp")
    got = {x.id: x.state for x in _table(live.stream_pairs(s, r, "1 minute", "1 second"), "pairs", tmp_path)}
    assert got[1] == "joined" and got.get(2, "incomplete") == "incomplete"
    e = _stream(spark, tmp_path / "e", [("k", at(0)), ("k", at(4)), ("k", at(30)), ("k", at(9_000))], "session_id string, ts timestamp")
    windows = sorted(x.n for x in _table(live.stream_session_window(e, "10 seconds", "1 second"), "windows", tmp_path))
    assert windows in ([1, 2], [1, 1, 2])


def test_streamed_findings_equal_batch(spark, tmp_path):
    import json

    from evidentia.operators.findings import findings_from_matches
    from evidentia.sources.readers import http_matches

    record = {"input": {"A": "YQ=="}, "position": 1, "status": 200, "length": 4, "words": 1, "lines": 1, "duration": 1, "content-type": "", "redirectlocation": "", "url": "http://two.test/", "resultfile": "", "host": ""}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps(record) + "\nnonsense\n" + json.dumps(record | {"status": 404}) + "\n")
    jobs = spark.createDataFrame([(1, "GET", ["A"])], "job_id long, method string, keywords array<string>")
    points = spark.createDataFrame([(1, 0, "A", "query", "q")], "job_id long, place long, keyword string, location string, name string")
    found = _table(live.stream_findings(spark.readStream.text(str(tmp_path / "in")), 1, jobs, points), "found", tmp_path)
    batch = http_matches(spark.read.text(str(tmp_path / "in")))[0].selectExpr("1L AS job_id", "url", "status", "length", "map('A', 'a') AS input")
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, findings_from_matches(batch, jobs, points).collect()), key=repr) and len(found) == 2


def test_late_events_are_kept_apart(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "id long, ts timestamp"
    run = lambda: live.late_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), 60_000_000).awaitTermination(120)
    _stream(spark, tmp_path / "in", [(1, at(0)), (2, at(1000))], schema)
    run()
    _stream(spark, tmp_path / "in", [(3, at(10)), (4, at(990)), (5, at(2000))], schema)
    run()
    ids = lambda kind: sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / kind)).collect())
    assert ids("late") == [3] and ids("on_time") == [1, 2, 4, 5]


def test_sink_delivers_an_id_once_over_batches(spark, tmp_path):
    for ids in ("ab", "bc"):
        stream = _stream(spark, tmp_path / "in", [(x,) for x in ids], "id string")
        live.sink_findings(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


SESSIONS = "session_id string, event_id long, ts timestamp, hit boolean, positions array<int>, failure string, last boolean"


def _sessions(seed=6, n=40):
    """Sessions with events in order, some without an end, some beyond the limit, some with a failure."""
    rng, rows = random.Random(seed), []
    for s in range(n):
        size = rng.randrange(1, 12)
        for i in range(size):
            hit = rng.random() < 0.2
            rows.append((f"s{s}", 100 * s + i, T0 + dt.timedelta(seconds=10 * i + s % 3), hit, [rng.randrange(3), 1] if hit else None, "argument_limit" if rng.random() < 0.03 else None, i == size - 1 and s % 5 > 0))
    return rows


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    rows = sorted(_sessions(), key=lambda r: r[2])
    # three files in the order of time, so that batches come as the events did, and one that lets all timers run out
    for i in range(3):
        _stream(spark, tmp_path / f"in/{i}", rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], SESSIONS)
    batch = spark.createDataFrame(rows, SESSIONS).withColumn("at", F.unix_micros("ts"))
    want = {tuple(map(str, r)) for r in correlate.trace_sessions(batch, 7).collect()}
    got = []
    for i in range(4):
        if i == 3:
            _stream(spark, tmp_path / "in/3", [("end", 1, T0 + dt.timedelta(days=9), False, None, None, True)], SESSIONS)
        (tmp_path / "all").mkdir(exist_ok=True)
        for f in (tmp_path / f"in/{i}").glob("part-*"):
            f.rename(tmp_path / "all" / f"{i}-{f.name}")
        stream = live.stream_sessions(spark.readStream.schema(SESSIONS).parquet(str(tmp_path / "all")), 7, 60_000, "5 seconds")

        def keep(df, _n):
            got.extend(df.collect())

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)  # each turn is a restart
    told = [r for r in got if r.session_id != "end"]
    assert len(told) == len({r.session_id for r in told}) and {tuple(map(str, r)) for r in told} == want
    assert {r.verdict for r in told} == {"confirmed", "refuted", "inconclusive"} and {tuple(r.failures) for r in told} == {(), ("event_limit",), ("argument_limit",)}


def test_the_state_of_a_session_does_not_grow_with_its_events(spark, tmp_path):
    def rows(first, n):
        return [("hot", first + i, T0 + dt.timedelta(seconds=first + i), True, [0, 1], None, False) for i in range(n)]

    sizes = []
    for turn in range(3):
        _stream(spark, tmp_path / "in", rows(turn * 400, 400), SESSIONS)
        q = live.stream_sessions(spark.readStream.schema(SESSIONS).parquet(str(tmp_path / "in")), 10_000, 60_000_000).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]][-1])
    assert sizes[0] == sizes[1] == sizes[2]


def test_late_rows_are_marked_over_a_restart_and_lose_their_sessions(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "session_id string, ts timestamp"
    kept = []

    def turn(rows):
        _stream(spark, tmp_path / "in", rows, schema)
        stream = live.mark_late(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "60 seconds")
        q = stream.writeStream.foreachBatch(lambda df, _n: kept.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    turn([("a", at(0)), ("b", at(1000)), ("n", None)])
    turn([("c", at(939)), ("d", at(940)), ("e", at(500))])
    turn([("f", at(400)), ("g", at(2000)), ("h", at(941))])
    assert {r.session_id for r in kept if r.late} == {"c", "e", "f"} and len(kept) == 9
    verdicts = spark.createDataFrame([("a", "intact", "confirmed", 1), ("c", "intact", "refuted", 2), ("e", "incomplete", "inconclusive", 3)], "session_id string, envelope string, verdict string, x int")
    late = spark.createDataFrame([r for r in kept if r.late])
    assert sorted(map(tuple, live.mark_losses(verdicts, late).collect())) == [("a", "intact", "confirmed", 1), ("c", "incomplete", "inconclusive", 2), ("e", "incomplete", "inconclusive", 3)]


def test_sink_costs_its_batch_and_repeats_it_alike(spark, tmp_path):
    read = []
    for turn in range(5):
        _stream(spark, tmp_path / "in", [(f"{turn}-{i}",) for i in range(30)] + [("again",), ("again",)], "id string")
        q = live.sink_findings(spark.readStream.schema("id string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
        q.awaitTermination(180)
        read += [(p["numInputRows"], p["stateOperators"][0]["numRowsUpdated"]) for p in q.recentProgress if p["numInputRows"]]
    # a batch reads its own rows and asks for its own ids, whatever was delivered before
    assert read == [(32, 31)] + [(32, 30)] * 4
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("id").distinct().count() == 151
    # the last batch is not known to be done: it is repeated and gives the same folder again
    before = {r.id for r in out.where("batch = 4").collect()}
    for f in (tmp_path / "c/commits").glob("*4*"):
        f.unlink()
    live.sink_findings(spark.readStream.schema("id string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(180)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id for r in again.where("batch = 4").collect()} == before and again.count() == 151
    assert len(list((tmp_path / "out/_delivered").iterdir())) == 5
