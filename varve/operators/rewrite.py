"""Rewriting segments by a plan, as a transition of the map and of the owners.

A plan is materialised first: each record becomes an output entry, bodies are
verified, and what is cut from one is hashed again. An input whose records can't
all be made is refused as a whole. The accepted outputs are then applied to the
map and to the owners as they are by then, which may be newer than those that
the plan was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators import content_index as ci
from varve.operators import intervals as iv
from varve.operators import snapshots as sn
from varve.sources.shared import Scratch, keep_together, part_of, stored_parts

#: Output ids lie above all inputs: an input's own id and this.
FRESH = 1_000_000_000
#: Characters of a block of a body that is text.
BLOCK = 64
#: Kinds whose hash an output carries.
CARRIED = ("data", "inline", "delta", "canonical_data", "canonical_inline", "canonical_delta")


def materialised(plan: DataFrame, entries: DataFrame, bodies: DataFrame, zero_hash: str, block: int = BLOCK) -> DataFrame:
    """``segment_id, entry_idx, op, output_id, kind, hash, start_lba, lba_length, state`` for each record but drops.

    ``bodies (segment_id, entry_idx, body, sound)``: what the resolver reads for
    an entry, and whether it is what its hash says. ``state`` is ``ok``,
    ``io_error`` for a body that is there and damaged, and ``cancelled`` for one
    that is gone; keeping a delta or a reference needs no body.
    """
    source = entries.select("segment_id", "entry_idx", "kind", "hash", F.col("start_lba").alias("own_start"), F.col("lba_length").alias("own_length"))
    read = bodies.select("segment_id", "entry_idx", "body", "sound", F.lit(True).alias("there"))
    rows = plan.where("op <> 'drop'").join(source, ["segment_id", "entry_idx"]).join(read, ["segment_id", "entry_idx"], "left")
    op, kind = F.col("op"), F.col("kind")
    bodied = kind.isin("data", "inline", "canonical_data", "canonical_inline")
    needs = ((op == "keep") & bodied) | ((op == "canonical") & bodied) | (op == "run")
    state = F.when(~needs, "ok").when(F.col("there").isNull(), "cancelled").when(F.col("sound"), "ok").otherwise("io_error")
    piece = F.substring("body", (F.col("payload_block_offset") * block + 1).cast("int"), (F.col("lba_length") * block).cast("int"))
    claims = op.isin("run", "zero_split")
    bare = op == "canonical"
    return rows.select(
        "segment_id",
        "entry_idx",
        "op",
        (F.col("segment_id") + FRESH).alias("output_id"),
        F.when(op == "run", "data").when(op == "zero_split", "zero").when(bare & ~kind.startswith("canonical_"), F.concat(F.lit("canonical_"), kind)).otherwise(kind).alias("kind"),
        F.when(op == "run", F.sha2(piece, 256)).when(op == "zero_split", F.lit(zero_hash)).otherwise(F.col("hash")).alias("hash"),
        F.when(claims, F.col("start_lba")).when(bare, F.lit(0).cast("long")).otherwise(F.col("own_start")).alias("start_lba"),
        F.when(claims, F.col("lba_length")).when(bare, F.lit(0).cast("long")).otherwise(F.col("own_length")).alias("lba_length"),
        state.alias("state"),
    )


def accepted(outputs: DataFrame) -> DataFrame:
    """Outputs of inputs all of whose records could be made."""
    refused = outputs.where("state <> 'ok'").select("segment_id").distinct()
    return outputs.join(refused, "segment_id", "left_anti")


def applied_blocks(blocks: DataFrame, outputs: DataFrame, volume_of: DataFrame) -> DataFrame:
    """The map after the outputs: ``volume_id, lba, start_lba, source, claimant, hash, moved``.

    ``blocks (volume_id, lba, start_lba, source, claimant, hash)`` is the map as
    it is. An output takes a block only from the input that it was made from, so
    writes that came since stay.
    """
    claims = outputs.where("lba_length > 0").join(volume_of.select("segment_id", "volume_id"), "segment_id")
    new = iv.blocks(claims).select("volume_id", "lba", F.col("segment_id").alias("claimant"), F.lit("segment").alias("source"), F.col("start_lba").alias("new_start"), F.col("hash").alias("new_hash"), "output_id")
    met = blocks.join(new, ["volume_id", "lba", "source", "claimant"], "left")
    moved = F.col("output_id").isNotNull()
    pick = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old))
    return met.select("volume_id", "lba", pick("new_start", "start_lba").alias("start_lba"), "source", pick("output_id", "claimant").alias("claimant"), pick("new_hash", "hash").alias("hash"), moved.alias("moved"))


def applied_owners(owners: DataFrame, outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """``hash, owner, change``: every hash's owner after the outputs.

    ``inputs (segment_id)`` are the accepted ones, with or without an output
    entry. A carried hash goes to its lowest output if it is free or one of that
    output's own input holds it; a hash that an input owns and no output carries
    is removed (its owner is -1).
    """
    carried = outputs.where(F.col("kind").isin(*CARRIED)).groupBy("hash").agg(F.collect_set("segment_id").alias("by"), F.min("output_id").alias("least"))
    met = owners.select("hash", F.col("segment_id").alias("old")).join(carried, "hash", "full")
    met = met.join(inputs.select(F.col("segment_id").alias("old"), F.lit(True).alias("consumed")), "old", "left")
    own_output = F.col("old") + FRESH
    taken: Column = F.array_contains("by", F.col("old"))
    change = F.when(F.col("old").isNull(), "new").when(F.coalesce(taken, F.lit(False)), "rekeyed").when(F.col("consumed") & F.col("by").isNull(), "removed").when(F.col("consumed"), "taken").otherwise("kept")
    owner = F.when(change == "rekeyed", own_output).when(change.isin("new", "taken"), F.col("least")).when(change == "removed", F.lit(-1).cast("long")).otherwise(F.col("old"))
    return met.select("hash", owner.alias("owner"), change.alias("change"))


def accepted_in_place(outputs: DataFrame) -> DataFrame:
    """:func:`accepted` where the outputs of an input lie together: they are made once."""
    bad = F.max(F.col("state") != "ok").over(Window.partitionBy("segment_id"))
    return outputs.withColumn("bad", bad).where("not bad").drop("bad")


def whole(rows: DataFrame) -> DataFrame:
    """``rows`` with a segment and a volume, which all that meets by them has; said of every use, so that one dealing out serves all."""
    return rows.where("segment_id is not null and volume_id is not null")


def live_after(entries: DataFrame, segments: DataFrame, wal: DataFrame, plan: DataFrame, bodies: DataFrame, zero_hash: str, parts: int = 1) -> DataFrame:
    """:func:`applied_blocks` of the live volumes and the accepted outputs of ``plan``, without ``start_lba``.

    Outputs meet the map's pieces by segment, in ``parts`` parts of the volumes
    (``plan`` and ``bodies`` have ``volume_id``). What is stored of a part is a
    row for each piece and hash, with the hash as bytes and the blocks as places
    in an address bucket; blocks come apart when the result is read.
    """
    spark = entries.sparkSession
    keep_together(spark)
    log = wal.withColumnRenamed("wal_id", "segment_id").withColumnRenamed("seq", "entry_idx")
    record = ["segment_id", "volume_id", "entry_idx", "anchor"]
    scratch = Scratch(spark, "live")
    stop = F.col("at") + F.col("n")

    def told(k: int) -> DataFrame:
        own, lines = whole(part_of(entries, k, parts)), part_of(log, k, parts)
        pieces = scratch.store(iv.held_pieces(own, part_of(segments, k, parts), lines))
        outputs = accepted_in_place(materialised(part_of(plan, k, parts).drop("volume_id"), own, whole(part_of(bodies, k, parts)), zero_hash)).where("lba_length > 0")
        first, last = F.floor(F.col("start_lba") / iv.BUCKET), F.floor((iv.end() - 1) / iv.BUCKET)
        claims = outputs.select("segment_id", F.explode(F.sequence(first, last)).alias("bucket"), F.col("start_lba").alias("a"), iv.end().alias("b"), "output_id", F.col("hash").alias("new_hash"))
        below = own.where("kind not like 'canonical%'").select("segment_id", "volume_id", "entry_idx", F.col("start_lba").alias("anchor"), "hash")
        held = pieces.where("not above").join(below, record).withColumn("bucket", F.floor(F.col("at") / iv.BUCKET))
        # a piece lies in one bucket, so that it meets an output's claim once
        p, c = held.alias("p"), claims.alias("c")
        met = p.join(c, (F.col("p.segment_id") == F.col("c.segment_id")) & (F.col("p.bucket") == F.col("c.bucket")) & (F.col("a") < stop) & (F.col("at") < F.col("b")), "left")
        places = lambda low, high: F.transform(F.sequence(low, high - 1), lambda x: (x % iv.BUCKET).cast("tinyint"))
        new = F.struct(F.col("output_id").alias("claimant"), F.col("new_hash").alias("hash"), F.lit(True).alias("moved"), places(F.greatest("at", "a"), F.least(stop, F.col("b"))).alias("places"))
        met = met.groupBy(*(F.col(f"p.{x}") for x in (*record, "at", "n", "bucket"))).agg(F.first("p.hash").alias("hash"), F.collect_list(F.when(F.col("output_id").isNotNull(), new)).alias("moves"))
        rest = F.array_except(places(F.col("at"), stop), F.flatten(F.col("moves.places")))
        old = F.struct(F.col("segment_id").alias("claimant"), "hash", F.lit(False).alias("moved"), rest.alias("places"))
        ours = met.select("volume_id", "bucket", F.lit("segment").alias("source"), F.inline(F.concat("moves", F.array(old)))).where("size(places) > 0")
        above = lines.groupBy("segment_id", "volume_id", "entry_idx", F.col("start_lba").alias("anchor")).agg(F.max("hash").alias("hash"))
        over = pieces.where("above").join(above, record)
        over = over.select("volume_id", F.floor(F.col("at") / iv.BUCKET).alias("bucket"), F.lit("wal").alias("source"), F.col("segment_id").alias("claimant"), "hash", F.lit(False).alias("moved"), places(F.col("at"), stop).alias("places"))
        both = ours.unionByName(over)
        return both.select("volume_id", "bucket", "source", "claimant", *sn.packed("hash"), "moved", "places")

    found = stored_parts(told, parts, "applied")
    scratch.clear()
    blocks = found.select("volume_id", "bucket", "source", "claimant", sn.unpacked().alias("hash"), "moved", F.explode("places").alias("place"))
    return blocks.select("volume_id", (F.col("bucket") * iv.BUCKET + F.col("place")).alias("lba"), "source", "claimant", "hash", "moved")


def owners_after(entries: DataFrame, known: DataFrame, plan: DataFrame, bodies: DataFrame, zero_hash: str, parts: int = 1) -> DataFrame:
    """:func:`applied_owners` of all hashes and the accepted outputs of ``plan``.

    ``known`` are the hashes of :func:`varve.operators.compaction.known`. A segment's
    owned and carried hashes are told where its entries lie, in ``parts`` parts
    of the volumes (``plan`` and ``bodies`` have ``volume_id``); each part is
    stored as one row for each hash, with the hash as bytes.
    """
    spark = entries.sparkSession
    keep_together(spark)
    keys = ["short", "long"]
    owner = known.where("owner is not null").select(F.col("owner").alias("segment_id"), "m1", "m2", F.lit(True).alias("own"))
    scratch = Scratch(spark, "carried")

    def least_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max("old").alias("old"), F.max("consumed").alias("consumed"), F.min("least").alias("least"), F.max("taken").alias("taken"))

    def told(k: int) -> DataFrame:
        own, records = whole(part_of(entries, k, parts)), part_of(plan, k, parts).drop("volume_id")
        outputs = accepted_in_place(materialised(records, own, whole(part_of(bodies, k, parts)), zero_hash))
        outputs = scratch.store(outputs.select("segment_id", "output_id", F.col("kind").isin(*CARRIED).alias("carries"), *iv.marked("hash", "m1", "m2"), *sn.packed("hash")))
        inputs = outputs.select("segment_id").union(records.where("op = 'drop'").select("segment_id")).distinct().withColumn("consumed", F.lit(True))
        named = own.where(F.col("kind").isin(*ci.BODIES) & ~F.col("journal")).select("segment_id", *sn.packed("hash"), *iv.marked("hash", "m1", "m2"))
        named = named.join(owner, ["segment_id", "m1", "m2"]).join(inputs, "segment_id", "left")
        none = lambda kind: F.lit(None).cast(kind)
        named = named.select(*keys, F.col("segment_id").alias("old"), F.coalesce("consumed", F.lit(False)).alias("consumed"), none("long").alias("least"), none("boolean").alias("taken"))
        carried = outputs.where("carries").join(owner, ["segment_id", "m1", "m2"], "left")
        carried = carried.select(*keys, none("long").alias("old"), none("boolean").alias("consumed"), F.col("output_id").alias("least"), F.coalesce("own", F.lit(False)).alias("taken"))
        return least_of(named.unionByName(carried))

    met = stored_parts(told, parts, "owners")
    scratch.clear()
    met = met if parts == 1 else least_of(met)
    change = F.when(F.col("old").isNull(), "new").when(F.col("taken"), "rekeyed").when(F.col("consumed") & F.col("least").isNull(), "removed").when(F.col("consumed"), "taken").otherwise("kept")
    owner_now = F.when(F.col("change") == "rekeyed", F.col("old") + FRESH).when(F.col("change").isin("new", "taken"), F.col("least")).when(F.col("change") == "removed", F.lit(-1).cast("long")).otherwise(F.col("old"))
    return met.withColumn("change", change).select(sn.unpacked().alias("hash"), owner_now.alias("owner"), "change")
