"""Exact correlation of event pairs, lineage, versions and sessions. Equal values alone never pair events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import numbered, scanned


def _once(events: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """How often each key occurs, and the columns of one occurrence."""
    return events.groupBy(key).agg(F.count("*").alias(f"{prefix}n"), F.min(F.struct(*columns)).alias(prefix)).select(key, f"{prefix}n", *(F.col(f"{prefix}.{c}").alias(f"{prefix}{c}") for c in columns))


def pair_messages(expected: DataFrame, sends: DataFrame, receives: DataFrame, timed: bool = True) -> DataFrame:
    """Each expected id: how often it was sent and received, and whether it joins: once each, of one marker, received by the recipient, sent before received.

    With timed=False clocks are not compared, as events of two nodes need.
    """
    s, r = _once(sends, "id", ["marker", "recipient", "at"], "s_"), _once(receives, "id", ["marker", "receiver", "at"], "r_")
    both = expected.select("id").distinct().join(s, "id", "left").join(r, "id", "left").na.fill(0, ["s_n", "r_n"])
    fits = (F.col("s_n") == 1) & (F.col("r_n") == 1) & F.col("s_marker").eqNullSafe(F.col("r_marker")) & (F.col("s_recipient") == F.col("r_receiver"))
    fits = fits & (F.col("s_at") <= F.col("r_at")) if timed else fits
    return both.select("id", F.col("s_n").alias("sends"), F.col("r_n").alias("receives"), F.coalesce(fits, F.lit(False)).alias("joined"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Expected, joined, and the joins that would be false: what did not join, and once more each id that did not occur once on both sides."""
    bad = F.count_if((F.col("sends") != 1) | (F.col("receives") != 1))
    return pairs.agg(F.count("*").alias("expected"), F.count_if("joined").alias("joined"), (F.count("*") - F.count_if("joined") + bad).alias("false_join_count"))


def pair_calls(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Both sides by id without a list of what is expected: state joined, send_only, receive_only, mismatch or ambiguous.

    Once on each side joins only with one marker, received by the recipient, not before it was
    sent; else it is a mismatch. Equal ids alone never join.
    """
    s, r = _once(sends, "id", ["marker", "recipient", "at"], "s_"), _once(receives, "id", ["marker", "receiver", "at"], "r_")
    both = s.join(r, "id", "full_outer").na.fill(0, ["s_n", "r_n"])
    fits = F.coalesce(F.col("s_marker").eqNullSafe(F.col("r_marker")) & (F.col("s_recipient") == F.col("r_receiver")) & (F.col("s_at") <= F.col("r_at")), F.lit(False))
    once = (F.col("s_n") == 1) & (F.col("r_n") == 1)
    state = F.when(once & fits, "joined").when(once, "mismatch").when(F.col("r_n") == 0, "send_only").when(F.col("s_n") == 0, "receive_only").otherwise("ambiguous")
    return both.select("id", F.col("s_n").alias("sends"), F.col("r_n").alias("receives"), state.alias("state"))


def value_only_candidates(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """How many pairs equal markers alone would offer: counts are multiplied, no pair is formed."""
    s, r = sends.groupBy("marker").agg(F.count("*").alias("sends")), receives.groupBy("marker").agg(F.count("*").alias("receives"))
    return s.join(r, "marker").select("marker", (F.col("sends") * F.col("receives")).alias("candidates"), ((F.col("sends") == 1) & (F.col("receives") == 1)).alias("unique"))


def supportable_edges(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Ids that are left on both sides."""
    return sends.select("id").intersect(receives.select("id"))


def task_lineage(events: DataFrame, stages: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """Per reference: joined if each stage occurs once, in order, and all of them name the same value in each column of `same` (owner, child); one shuffle of all stages instead of a join for each."""
    known = events.where(F.col("stage").isin(*stages))
    counts = [F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in stages]
    times = [F.min(F.when(F.col("stage") == s, F.col("at"))).alias(f"t_{s}") for s in stages]
    ends = [f(c).alias(f"{n}_{c}") for c in same for n, f in (("least", F.min), ("most", F.max), ("count", F.count))]
    ok = F.lit(True)
    for s in stages:
        ok = ok & (F.col(f"n_{s}") == 1)
    for a, b in zip(stages, stages[1:], strict=False):
        ok = ok & (F.col(f"t_{a}") <= F.col(f"t_{b}"))
    for c in same:
        ok = ok & (F.col(f"least_{c}") == F.col(f"most_{c}")) & (F.col(f"count_{c}") == len(stages))
    found = events.select("reference").distinct().join(known.groupBy("reference").agg(*counts, *times, *ends), "reference", "left").na.fill(0, [f"n_{s}" for s in stages])
    return found.select("reference", *(f"n_{s}" for s in stages), F.coalesce(ok, F.lit(False)).alias("joined"))


def version_intervals(writes: DataFrame) -> DataFrame:
    """Each write's validity (key, version, since, until): until the next write or deletion of its key."""
    following = scanned(writes, ["key"], ["at", "version"], until=("next", F.col("at")))
    return following.where("kind = 'write'").select("key", "version", F.col("at").alias("since"), "until")


def store_versions(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """reads (read_id, key, version): joined with the write of their version; without one, joined only if the key was written once, else ambiguous or missing.

    With the time of a read (at), only what was written at or before it counts, and a
    delete of the key in between ends a write: what it would have joined is deleted.
    """
    if "at" not in reads.columns:
        totals = writes.where("kind = 'write'").groupBy("key").agg(F.count("*").alias("n"))
        exact = writes.where("kind = 'write'").select("key", "version").distinct().withColumn("hit", F.lit(True))
        out = reads.join(totals, "key", "left").join(exact, ["key", "version"], "left")
        state = F.when(F.col("hit"), "joined").when(F.col("n").isNull() | F.col("version").isNotNull(), "missing").when(F.col("n") == 1, "joined").otherwise("ambiguous")
        return out.select("read_id", state.alias("state"))
    gone = F.when(F.col("kind") == "delete", F.col("at"))
    ended = scanned(writes.select("key", "version", "at", "kind"), ["key"], [F.desc("at"), F.desc("kind"), F.desc("version")], ended=("last", gone)).where("kind = 'write'")
    exact = ended.groupBy("key", "version").agg(F.min("at").alias("written"), F.max("ended").alias("ended"), F.max(F.col("ended").isNull()).alias("lasts"))
    # along a key's events: the writes so far, and the last delete before the read
    both = writes.select("key", "at", F.lit(0).alias("turn"), F.when(F.col("kind") == "write", 1).otherwise(0).cast("long").alias("wrote"), gone.alias("gone")).unionByName(reads.select("key", "at", F.lit(1).alias("turn"), "read_id", F.col("version").alias("asked")), allowMissingColumns=True)
    written = F.when(F.col("wrote") == 1, F.col("at"))
    told = scanned(both, ["key"], ["at", "turn", F.desc("wrote")], n=("sum", F.col("wrote")), last_gone=("last", F.col("gone")), last_written=("last", written)).where("turn = 1")
    out = told.join(exact.withColumnRenamed("version", "asked"), ["key", "asked"], "left")
    held = F.col("written").isNotNull() & (F.col("written") <= F.col("at"))
    alive = F.col("lasts") | (F.col("ended") > F.col("at"))
    named = F.when(~F.coalesce(held, F.lit(False)), "missing").when(alive, "joined").otherwise("deleted")
    n = F.coalesce("n", F.lit(0))
    free = F.when(n == 0, "missing").when(F.coalesce(F.col("last_gone") >= F.col("last_written"), F.lit(False)), "deleted").when(n == 1, "joined").otherwise("ambiguous")
    return out.select("read_id", F.when(F.col("asked").isNotNull(), named).otherwise(free).alias("state"))


def session_event_limit(events: DataFrame, most: int) -> DataFrame:
    """events with their place in their session, those beyond the limit left out, and whether the session is cut."""
    w = Window.partitionBy("session_id")
    placed = events.withColumn("place", F.row_number().over(w.orderBy("at", "event_id"))).withColumn("limited", F.count("*").over(w) > most)
    return placed.where(F.col("place") <= most)


def marker_match(events: DataFrame, sinks: DataFrame, marker: str, most: int) -> DataFrame:
    """events (event_id, kind, args) at sinks (kind, positions): the positions whose argument holds the marker; arguments over the byte limit make a failure, not a miss."""
    joined = events.join(sinks, "kind")
    arg = lambda i: F.get("args", i - 1)
    over = F.exists("positions", lambda i: F.octet_length(arg(i)) > most)
    hits = F.filter("positions", lambda i: F.coalesce(F.contains(arg(i), F.lit(marker)), F.lit(False)))
    return joined.select("event_id", F.when(over, F.lit("argument_limit")).alias("failure"), F.when(~F.coalesce(over, F.lit(False)), F.array_join(hits, ",")).alias("matched"))


def session_verdict(events: DataFrame, most: int, sessions: DataFrame | None = None) -> DataFrame:
    """Per session: events, hits and the verdict. Only a session with an intact envelope is decided: one beyond its limit is inconclusive, hit or not, and so is one that sessions (session_id, complete) does not call complete."""
    counts = events.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if("hit").alias("hits"))
    intact = F.col("events") <= most
    if sessions is not None:
        counts = sessions.groupBy("session_id").agg(F.min("complete").alias("complete")).join(counts, "session_id", "left").na.fill(0, ["events", "hits"])
        intact = intact & F.coalesce("complete", F.lit(False))
    return counts.select("session_id", "events", "hits", F.when(~intact, "inconclusive").when(F.col("hits") > 0, "confirmed").otherwise("refuted").alias("verdict"))


def with_all(events: DataFrame) -> DataFrame:
    """events of sessions with the columns that may be missing: event_id, positions, failure; null flags are false."""
    missing = {n: F.lit(None).cast(kind) for n, kind in (("event_id", "long"), ("positions", "array<int>"), ("failure", "string")) if n not in events.columns}
    return events.withColumns(missing | {n: F.coalesce(n, F.lit(False)) for n in ("hit", "last")})


def trace_sessions(events: DataFrame, most: int) -> DataFrame:
    """(session_id, events, hits, positions, failures, envelope, verdict) of events (session_id, at, hit, last and, if given, event_id, positions, failure).

    positions are the argument positions that a hit matched, failure names a limit that an event
    broke, last marks the event that ends a session. A session is looked at up to its first
    failure, or its event `most` + 1, whose failure is event_limit; events counts that one, hits
    and positions those before it. The envelope is intact if the session ended and nothing
    failed; only then is it confirmed (there was a hit) or refuted. Events are numbered by a
    scan, so a session with most rows is no one task. A null session is left out.
    """
    known = with_all(events.where(F.col("session_id").isNotNull()))
    placed = numbered(known.select("session_id", "event_id", "at", "hit", "last", "positions", "failure"), ["session_id"], ["at", "event_id"])
    cuts = placed.groupBy("session_id").agg(F.max("last").alias("ended"), F.count("*").alias("n"), F.min(F.when(F.col("failure").isNotNull() & (F.col("place") <= most), F.struct("place", "failure"))).alias("first"))
    cuts = cuts.withColumn("stop", F.coalesce("first.place", F.when(F.col("n") > most, F.lit(most + 1).cast("long"))))
    looked = placed.join(cuts.select("session_id", "stop"), "session_id").where("hit AND (stop IS NULL OR place < stop)")
    found = looked.groupBy("session_id").agg(F.count("*").alias("hits"))
    none = F.array().cast("array<int>")
    places = looked.select("session_id", F.explode("positions").alias("p")).groupBy("session_id").agg(F.array_sort(F.collect_set("p")).alias("positions"))
    out = cuts.join(found, "session_id", "left").join(places, "session_id", "left").na.fill(0, ["hits"])
    failures = F.when(F.col("stop").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.coalesce("first.failure", F.lit("event_limit"))))
    intact = F.col("ended") & F.col("stop").isNull()
    verdict = F.when(~intact, "inconclusive").when(F.col("hits") > 0, "confirmed").otherwise("refuted")
    return out.select("session_id", F.coalesce("stop", "n").alias("events"), "hits", F.coalesce("positions", none).alias("positions"), failures.alias("failures"), F.when(intact, "intact").otherwise("incomplete").alias("envelope"), verdict.alias("verdict"))
