"""The write log as a stream: incremental overlay, no-op skipping, windowed counts.

Epochs follow the micro-batch. A batch's block winners are written under its
id, so a batch that is run again after a failure replaces its own output, and
the current map is one aggregate over the epochs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from varve.operators import intervals as iv


def winners(records: DataFrame) -> DataFrame:
    """Each block's last write: ``lba, claimant, seq, hash, start_lba``."""
    named = records.select("start_lba", "lba_length", "hash", F.col("wal_id").alias("claimant"), "seq")
    return iv.settled(named, [F.col("claimant"), F.col("seq")], ["hash", "claimant", "seq"])


def overlay_stream(records: DataFrame, folder: str, available_now: bool = True):
    """Start a query that keeps the winners of each epoch under ``folder``."""

    def keep(batch: DataFrame, epoch: int) -> None:
        winners(batch).write.mode("overwrite").parquet(f"{folder}/winners/epoch={epoch}")

    query = records.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    return (query.trigger(availableNow=True) if available_now else query).start()


def current_map(spark: SparkSession, folder: str) -> DataFrame:
    """The map that the epochs so far make."""
    kept = spark.read.parquet(f"{folder}/winners")
    best = kept.groupBy("lba").agg(F.max(F.struct("claimant", "seq", "start_lba", "hash")).alias("w"))
    best = best.select("lba", "w.start_lba", "w.hash", "w.claimant", "w.seq")
    return iv.runs(best, ["hash", "claimant", "seq"])


def skip_noops(records: DataFrame) -> DataFrame:
    """Writes of single blocks that change their block's content, by keyed state: ``lba, seq, hash``.

    ``records (lba, seq, hash)``. A block's state is the last sequence number
    and hash applied; a write equal to it is skipped and counted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, skipped = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        fresh = rows["hash"] != rows["hash"].shift(fill_value=held)
        state.update((rows["hash"].iloc[-1], skipped + int((~fresh).sum())))
        yield pd.DataFrame({"lba": key[0], "seq": rows["seq"][fresh], "hash": rows["hash"][fresh]})

    return records.groupBy("lba").applyInPandasWithState(step, "lba long, seq long, hash string", "held string, skipped long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and type; windows close when the watermark passes them."""
    named = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = named.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "event_type", "n")


def run_to_folder(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what there is now into files of the shared folder; each epoch overwrites its own output.

    With ``complete`` an epoch holds the whole result, and the last one counts.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{folder}/rows")
    if mode == "complete":
        kept = kept.join(kept.agg(F.max("epoch").alias("epoch")), "epoch", "left_semi")
    return kept.drop("epoch")


def epochs(wal: DataFrame, cap_bytes: int, cap_entries: int) -> DataFrame:
    """``wal_id, epoch, first_seq, last_seq, entries, bytes``: a log cut where its open epoch has so many bytes or entries.

    The entry that reaches a cap is the epoch's last. Where a cut falls depends
    on the one before it, so each log is folded in order; a log is bounded, as
    it is rotated at the same caps.
    """
    start = F.struct(F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<bigint>").alias("cuts"))

    def step(s: Column, r: Column) -> Column:
        full = (s["n"] >= cap_entries) | (s["bytes"] >= cap_bytes)
        return F.struct(
            (s["epoch"] + full.cast("long")).alias("epoch"),
            F.when(full, F.lit(1).cast("long")).otherwise(s["n"] + 1).alias("n"),
            F.when(full, r["data_length"]).otherwise(s["bytes"] + r["data_length"]).alias("bytes"),
            F.when(full, F.concat(s["cuts"], F.array(r["seq"]))).otherwise(s["cuts"]).alias("cuts"),
        )

    logs = wal.groupBy("wal_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data_length"))).alias("rows"))
    cuts = logs.select("wal_id", F.aggregate("rows", start, step, lambda s: s["cuts"]).alias("cuts"))
    rows = wal.join(cuts, "wal_id").withColumn("epoch", F.size(F.filter("cuts", lambda c: c <= F.col("seq"))).cast("long"))
    return rows.groupBy("wal_id", "epoch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("entries"), F.sum("data_length").alias("bytes"))


def coalesced(wal: DataFrame) -> DataFrame:
    """Neighbouring writes of one kind in a log as one: ``wal_id, first_seq, kind, start_lba, lba_length, writes, data_length``."""
    order = Window.partitionBy("wal_id").orderBy("seq")
    joins = (F.lag("kind").over(order) == F.col("kind")) & (F.lag(iv.end()).over(order) == F.col("start_lba"))
    rows = wal.withColumn("fresh", (~F.coalesce(joins, F.lit(False))).cast("long")).withColumn("run", F.sum("fresh").over(order))
    return rows.groupBy("wal_id", "run", "kind").agg(F.min("seq").alias("first_seq"), F.min("start_lba").alias("start_lba"), F.sum("lba_length").alias("lba_length"), F.count("*").alias("writes"), F.sum("data_length").alias("data_length")).drop("run")


#: Neighbouring ids that share a key of the retention's state.
STRETCH = 1024


def retained(edges: DataFrame, days: int) -> DataFrame:
    """Superseded inputs as a stream, kept in state for their retention: ``input, output, since`` when it is over.

    ``edges (input, output, since)``. The timeout is event time: an input goes
    once the watermark has passed its ``since`` by ``days``; a later output that
    names it again begins its time anew. ``STRETCH`` neighbouring inputs share a
    key, and its timeout is that of the first of them that is due.
    """
    names, kept_as = ["input", "output", "since"], ["input", "output", "since", "due"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(kept_as, state.get, strict=True)) if state.exists else {c: [] for c in kept_as}).astype("int64")
        if not state.hasTimedOut:
            rows = pd.concat([f[names] for f in frames])
            rows = rows.assign(since=rows["since"].astype("datetime64[ms]").astype("int64"), due=0)
            named = rows["input"].unique()
            # what is held comes first and stays unless an output is later
            held = pd.concat([held, rows]).sort_values(["input", "output"], ascending=[True, False], kind="stable").drop_duplicates("input").reset_index(drop=True)
            again = held["input"].isin(named)
            held.loc[again, "due"] = (held.loc[again, "since"] + days * 86_400_000).clip(lower=now + 1)
        over = held["due"] < now
        left = held[~over]
        if len(left):
            state.update(tuple(left[c].tolist() for c in kept_as))
            state.setTimeoutTimestamp(int(left["due"].min()))
        elif state.exists:
            state.remove()
        yield held.loc[over, names].assign(since=pd.to_datetime(held.loc[over, "since"], unit="ms"))

    named = edges.withWatermark("since", "0 seconds").withColumn("stretch", F.floor(F.col("input") / STRETCH)).groupBy("stretch")
    return named.applyInPandasWithState(step, "input long, output long, since timestamp", "input array<long>, output array<long>, since array<long>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def ticking(records: DataFrame, folder: str, tick, every: str = "2 minutes"):
    """Start the overlay with a tick after each epoch (compact, collect, drain): ``tick(spark, folder, epoch)`` at most once every ``every``."""

    def keep(batch: DataFrame, epoch: int) -> None:
        winners(batch).write.mode("overwrite").parquet(f"{folder}/winners/epoch={epoch}")
        tick(batch.sparkSession, folder, epoch)

    return records.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
