"""Event journals: walks along back links, checks, windows, and the lifecycle machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that a head window keeps.
WINDOW = 16
# Fixed values, which every cell of the table must have: verbs on states, as (state, verb, outcome, next state).
STATES = ("live", "stopped", "released", "readonly", "importing")
TRANSITIONS = [
    ("live", "stop", "proceed", "stopped"),
    ("live", "release", "proceed", "released"),
    ("live", "start", "idempotent", "live"),
    ("live", "claim", "refuse", "live"),
    ("live", "force_claim", "proceed", "live"),
    ("stopped", "stop", "idempotent", "stopped"),
    ("stopped", "release", "proceed", "released"),
    ("stopped", "start", "proceed", "live"),
    ("stopped", "claim", "refuse", "stopped"),
    ("stopped", "force_claim", "proceed", "live"),
    ("released", "stop", "refuse", "released"),
    ("released", "release", "idempotent", "released"),
    ("released", "start", "reroute", "released"),
    ("released", "claim", "proceed", "live"),
    ("released", "force_claim", "reroute", "released"),
    ("readonly", "stop", "refuse", "readonly"),
    ("readonly", "release", "refuse", "readonly"),
    ("readonly", "start", "refuse", "readonly"),
    ("readonly", "claim", "refuse", "readonly"),
    ("readonly", "force_claim", "refuse", "readonly"),
    ("importing", "stop", "refuse", "importing"),
    ("importing", "release", "refuse", "importing"),
    ("importing", "start", "refuse", "importing"),
    ("importing", "claim", "refuse", "importing"),
    ("importing", "force_claim", "refuse", "importing"),
]


def transitions(session) -> DataFrame:
    return session.createDataFrame(TRANSITIONS, "state string, verb string, outcome string, next_state string")


def newest(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each name, newest first (``place`` from 1); none for 0."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("event_id")))
    return events.withColumn("place", place).where(F.col("place") <= n)


def recent_walk(events: DataFrame, limit: int, window: int = WINDOW) -> DataFrame:
    """``name, event_id, place``: from the newest event along back links, at most ``limit``.

    The head window serves the first ``window`` events; links are followed past
    it only if it was full, and the walk stops at a missing event.
    """
    head = newest(events, min(window, limit)).select("name", "event_id", "prev_id", F.col("place").cast("long").alias("place"))
    head.createOrReplaceTempView("varve_head")
    events.select("name", "event_id", "prev_id").createOrReplaceTempView("varve_events")
    return events.sparkSession.sql(f"""
        WITH RECURSIVE walk(name, event_id, prev_id, place) AS (
            SELECT name, event_id, prev_id, place FROM varve_head WHERE place = {window}
            UNION ALL
            SELECT e.name, e.event_id, e.prev_id, w.place + 1 FROM walk w JOIN varve_events e ON e.name = w.name AND e.event_id = w.prev_id WHERE w.place < {limit})
        SELECT name, event_id, place FROM varve_head UNION SELECT name, event_id, place FROM walk""")


def verified(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Oldest first with a status: the key that should sign an event may be unknown, and its mark may not agree."""
    met = events.join(keys, events["name"] == keys["key_name"], "left")
    status = F.when(F.col("payload").isNull(), "unparseable").when(F.col("key_name").isNull(), "key_unavailable").when((F.col("payload") + F.col("event_id")) % 11 == F.col("mark"), "invalid").otherwise("valid")
    return met.select("name", "event_id", status.alias("status"))


def head_windows(events: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each name's head window: ids of its last ``n`` events, newest first."""
    rows = newest(events, n)
    return rows.groupBy("name").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda r: r["event_id"].cast("string"))).alias("window"), F.count("*").alias("n"))


def skips(events: DataFrame) -> DataFrame:
    """Events whose back link is not the event before them on record."""
    before = F.lag("event_id").over(Window.partitionBy("name").orderBy("event_id"))
    rows = events.withColumn("before", before)
    return rows.where(~F.col("prev_id").eqNullSafe(F.col("before"))).select("name", "event_id", F.coalesce("prev_id", F.lit(-1)).alias("prev_id"), F.coalesce("before", F.lit(-1)).alias("before"))


def consistent_times(events: DataFrame, expected: Column) -> DataFrame:
    return events.select("name", "event_id", (F.col("stamp") == expected).alias("consistent"))


def latest(events: DataFrame) -> DataFrame:
    """The current record of each name."""
    return events.groupBy("name").agg(F.max(F.struct("event_id", "kind", "stamp")).alias("e")).select("name", "e.event_id", "e.kind", "e.stamp")


def conditional(ops: DataFrame) -> DataFrame:
    """``name, event_id, verb, outcome, version``: puts under a name, each only if the name is as it expects.

    ``ops (name, event_id, verb, expected)`` in id order. ``create`` needs the
    name to be free, ``update`` its current version to be ``expected``, and
    ``delete`` is unconditional; a successful put's version is its event id, and
    -1 stands for a free name. Whether a put succeeds hangs on all before it, so
    each name's puts are folded in order.
    """
    rows = ops.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("event_id", "verb", "expected"))).alias("ops"))
    start = F.struct(F.lit(-1).cast("long").alias("version"), F.array().cast("array<struct<event_id:bigint,verb:string,outcome:string,version:bigint>>").alias("out"))

    def step(s: Column, op: Column) -> Column:
        good = F.when(op["verb"] == "create", s["version"] == -1).when(op["verb"] == "update", (s["version"] != -1) & (s["version"] == op["expected"])).otherwise(F.lit(True))
        version = F.when(~good, s["version"]).when(op["verb"] == "delete", F.lit(-1).cast("long")).otherwise(op["event_id"])
        told = F.struct(op["event_id"].alias("event_id"), op["verb"].alias("verb"), F.when(good, "ok").otherwise("precondition_failed").alias("outcome"), version.alias("version"))
        return F.struct(version.alias("version"), F.concat(s["out"], F.array(told)).alias("out"))

    return rows.select("name", F.explode(F.aggregate("ops", start, step, lambda s: s["out"])).alias("o")).select("name", "o.*")


def lifecycle(events: DataFrame, machine: DataFrame, start: str = "live") -> DataFrame:
    """The machine run over each name's events: final state and the number of events by outcome.

    The machine is a map of 25 cells, so the fold is a built-in aggregate over
    the name's ordered verbs.
    """
    table = {(r["state"], r["verb"]): r["next_state"] for r in machine.collect()}  # 25 cells
    outcome = {(r["state"], r["verb"]): r["outcome"] for r in machine.collect()}
    cells = F.create_map(*[F.lit(x) for (s, v), n in table.items() for x in (f"{s}/{v}", n)])
    results = F.create_map(*[F.lit(x) for (s, v), n in outcome.items() for x in (f"{s}/{v}", n)])
    verbs = events.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "kind"))), lambda r: r["kind"]).alias("verbs"))
    first = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("proceeded"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, verb: Column) -> Column:
        cell = F.concat_ws("/", s["state"], verb)
        result = F.element_at(results, cell)
        return F.struct(F.coalesce(F.element_at(cells, cell), s["state"]).alias("state"), (s["proceeded"] + (result == "proceed").cast("long")).alias("proceeded"), (s["refused"] + (result == "refuse").cast("long")).alias("refused"))

    out = verbs.select("name", F.aggregate("verbs", first, step).alias("s"), F.size("verbs").cast("long").alias("events"))
    return out.select("name", F.col("s.state").alias("state"), F.col("s.proceeded").alias("proceeded"), F.col("s.refused").alias("refused"), "events")
