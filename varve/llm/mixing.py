"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, gone round up to
``EPOCHS`` times. A document's copy has the virtual finish time (words of its
source up to its end) / (its source's target). All copies are range-sorted by
that time, a running sum of words gives their place in the mix, and the mix is
cut at the total budget. The queues are served side by side, so the document in
service at each source is cut where its source's target is reached, which is
the virtual time at which the budget is spent.

Only DataFrame operations. Running sums are two-level, so no source and no
stretch of the mix needs one task: sums by (source, hash bucket), their prefix
sums, then a window inside each bucket; the same over bins of virtual time.

Defined results. Null and empty texts have size 0 and take no words. A null
source is a source of its own, the last one. Rows that repeat an id are
documents of their own; which of two equal rows comes first is no difference. An empty table gives an empty result; other columns,
whatever their names, travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import WORD_RE, checkpoint, small

#: No document is taken more often, so no target is above this many times its source's size.
EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Hex digits of the shuffle key that deal a source's rows into buckets: 4096 of them.
KEY_DIGITS = 3
#: Bins of virtual time, each near an equal share of the words.
BINS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)).cast("long"), F.lit(0).cast("long"))


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, payload: Column) -> DataFrame:
    rows = docs.select(payload.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    return keyed(rows)


def keyed(rows: DataFrame) -> DataFrame:
    """With the shuffle key, its bucket, and the source as two columns that are never null."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("bucket", F.substring(key, 1, KEY_DIGITS))
    return rows.withColumn("no_source", F.col("source").isNull()).withColumn("source_name", F.coalesce("source", F.lit("")))


def targets(buckets: DataFrame) -> DataFrame:
    """``source_name, no_source, source_size, target, budget`` by weight, the excess over the limit reshared.

    A source is held at its limit if the share that its weight gives it, once
    the sources with smaller limits for their weight are held, is above it.
    """
    by_source = buckets.groupBy("source_name", "no_source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy("no_source", "source_name")
    by_source = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    by_source = by_source.withColumn("most", EPOCHS * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most").cast("double") / F.col("weight"), "no_source", "source_name")
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by_source = by_source.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    by_source = by_source.withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    share = F.col("left").cast("double") * F.col("weight") / F.col("heft")
    by_source = by_source.withColumn("held", F.col("most") < share)
    # the first source that is not held has what all held ones leave
    rest = lambda c: F.min(F.when(~F.col("held"), F.struct("at", c))).over(everything)[c]
    by_source = by_source.withColumn("at", F.row_number().over(by_limit))
    free = rest("left").cast("double") * F.col("weight") / rest("heft")
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(free)
    return by_source.select("source_name", "no_source", "source_size", target.alias("target"), F.sum("source_size").over(everything).alias("budget"))


def schedule(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target, taken, pieces``: the words that each epoch takes of each row.

    ``slim`` holds the same rows without payload, for the sums by bucket.
    """
    buckets = checkpoint(slim.groupBy("source_name", "no_source", "bucket").agg(F.sum("size").alias("size")))
    by_source = Window.partitionBy("source_name", "no_source").orderBy("bucket")
    starts = buckets.withColumn("bucket_start", F.sum("size").over(by_source) - F.col("size")).drop("size")
    starts = starts.join(small(targets(buckets)), ["source_name", "no_source"])
    rows = rows.join(starts, ["source_name", "no_source", "bucket"])
    inside = Window.partitionBy("source_name", "no_source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.col("bucket_start") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target")
    piece = lambda epoch: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - (epoch * F.col("source_size") + F.col("start"))))
    pieces = [piece(F.lit(e).cast("long")) for e in range(EPOCHS)]
    return rows.withColumn("taken", sum(pieces[1:], pieces[0])).withColumn("pieces", F.array(*pieces))


def mixed(rows: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with its place: ``epoch, piece, mix_start``.

    Range-sorted by virtual finish time, and cut at the total budget. The bins of
    virtual time are the ranges, so the windows that add up words inside a bin
    find their rows together and leave them in order.
    """
    copies = rows.select("*", F.posexplode("pieces").alias("epoch", "piece")).where("piece > 0")
    finish = (F.col("epoch") * F.col("source_size") + F.col("start") + F.col("piece")).cast("double") / F.col("target")
    copies = copies.withColumn("finish", finish).withColumn("bin", F.least(F.floor(F.col("finish") * BINS), F.lit(BINS - 1)))
    bins = copies.groupBy("bin").agg(F.sum("piece").alias("piece"))
    bins = bins.select("bin", (F.sum("piece").over(Window.orderBy("bin")) - F.col("piece")).alias("bin_start"))
    copies = copies.join(F.broadcast(bins), "bin").repartitionByRange("bin")  # BINS rows at most
    inside = Window.partitionBy("bin").orderBy("finish", "no_source", "source_name", "key", "doc_id", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("mix_start", F.col("bin_start") + F.sum("piece").over(inside) - F.col("piece"))
    return copies.where(F.col("mix_start") + F.col("piece") <= F.col("budget"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: its size, its source's size and target, the words taken, and the place of its first copy (-1: none)."""
    slim = keyed(checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))))
    planned = schedule(slim, slim)
    kept = mixed(planned).where("epoch = 0")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    none = planned.where("taken = 0").select(*columns, F.lit(-1).cast("long").alias("mix_start"))
    return kept.select(*columns, "mix_start").unionByName(none)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs`` in its order: whole documents, repeated as often as they are taken.

    The document that a source's target cuts enters if the target takes at
    least half of it.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = prepared(docs, id_col, text_col, source_col, row)
    planned = schedule(rows, rows.drop("row"))
    return mixed(planned).where("2 * piece >= size").select("row.*")
