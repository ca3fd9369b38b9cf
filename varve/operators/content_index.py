"""Content index: who owns a hash, who names it as a delta source, and dedup over it.

Owners are first writer wins: committed tiers in id order, then pending ones,
and within a segment by entry. Every rule is one aggregate by hash (``min`` of
an order struct, combined on the map side), never a window over a hot hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BODIES = ("data", "inline", "canonical_data")


def tier_rank() -> Column:
    return F.when(F.col("tier") == "pending", 1).otherwise(0)


def first_writer(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each key the entry that registers first."""
    top = rows.groupBy(*keys).agg(F.min(F.struct(tier_rank().alias("rank"), "segment_id", "entry_idx", *columns)).alias("o"))
    return top.select(*keys, "o.segment_id", "o.entry_idx", *(f"o.{c}" for c in columns))


def with_tier(entries: DataFrame, segments: DataFrame) -> DataFrame:
    return entries.join(segments.select("segment_id", "tier"), "segment_id")


def data_owners(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """``hash, segment_id, entry_idx, kind, stored_length, tier`` of entries with a body outside the journal."""
    rows = with_tier(entries, segments).where(F.col("kind").isin(*BODIES) & ~F.col("journal"))
    return first_writer(rows, ["hash"], ["kind", "stored_length", "tier"])


def delta_owners(entries: DataFrame, segments: DataFrame, owners: DataFrame) -> DataFrame:
    """Recipes of hashes that have no body."""
    rows = with_tier(entries, segments).where("kind = 'delta' and not journal")
    return first_writer(rows.join(owners.select("hash"), "hash", "left_anti"), ["hash"], ["delta_source", "delta_length"])


#: The least segments of a hash: with a body, committed and pending, and with a recipe.
LEAST = ("b0", "b1", "r0", "r1")


def told_hashes(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``m1, m2``, :data:`LEAST` and ``live`` (1 or 0) of each hash that ``rows`` hold or name as a delta's source, by its marks.

    ``rows``: entries with their marks and ``live_blocks``, of which some may be elsewhere.
    """
    from varve.operators.intervals import marked

    pending = tier_rank() == 1
    body, recipe = (c & ~F.col("journal") for c in (F.col("kind").isin(*BODIES), F.col("kind") == "delta"))
    none = F.lit(None).cast("long")
    pick = lambda what, tier: F.when(what & tier, F.col("segment_id"))
    mine = F.struct("m1", "m2", pick(body, ~pending).alias("b0"), pick(body, pending).alias("b1"), pick(recipe, ~pending).alias("r0"), pick(recipe, pending).alias("r1"), (F.col("live_blocks") > 0).alias("live"))
    source = F.struct(*marked("delta_source", "m1", "m2"), *(none.alias(c) for c in LEAST), F.lit(True).alias("live"))
    parts = F.when(F.col("delta_source").isNull(), F.array(mine)).otherwise(F.array(mine, source))
    told = with_tier(rows, segments).select(F.explode(parts).alias("p")).select("p.*")
    return least_of(told.withColumn("live", F.col("live").cast("int")))


def least_of(told: DataFrame) -> DataFrame:
    return told.groupBy("m1", "m2").agg(*(F.min(c).alias(c) for c in LEAST), F.max("live").alias("live"))


def known_hashes(t: DataFrame) -> DataFrame:
    """``m1, m2, owner, recipe, is_live`` of each hash of :func:`told_hashes` over all entries.

    ``owner`` is the segment of :func:`data_owners`, ``recipe`` that of
    :func:`delta_owners`. The least committed and the least pending segment are
    minima of plain numbers.
    """
    owner = F.coalesce("b0", "b1")
    return t.select("m1", "m2", owner.alias("owner"), F.when(owner.isNull(), F.coalesce("r0", "r1")).alias("recipe"), (F.col("live") == 1).alias("is_live"))


def journal_owners(entries: DataFrame) -> DataFrame:
    """Journal bodies are keyed by segment and hash, apart from all others."""
    rows = entries.where(F.col("journal") & F.col("kind").isin(*BODIES))
    return rows.groupBy("segment_id", "hash").agg(F.min("entry_idx").alias("entry_idx"))


def resolved(entries: DataFrame, owners: DataFrame, deltas: DataFrame) -> DataFrame:
    """Where each entry's content is found: journal, data, delta or nowhere, in that order."""
    j = journal_owners(entries).select("segment_id", "hash", F.lit(True).alias("in_journal"))
    rows = entries.select("segment_id", "entry_idx", "hash", "kind").where("kind not in ('zero')")
    rows = rows.join(j, ["segment_id", "hash"], "left").join(owners.select("hash", F.col("segment_id").alias("data_segment")), "hash", "left")
    rows = rows.join(deltas.select("hash", F.col("segment_id").alias("delta_segment")), "hash", "left")
    found = F.when(F.col("in_journal"), "journal").when(F.col("data_segment").isNotNull(), "data").when(F.col("delta_segment").isNotNull(), "delta").otherwise("missing")
    at = F.when(F.col("in_journal"), F.col("segment_id")).otherwise(F.coalesce("data_segment", "delta_segment", F.lit(-1)))
    return rows.select("segment_id", "entry_idx", "hash", found.alias("found_in"), at.alias("found_at"))


def taken_over(owners: DataFrame, output: DataFrame) -> DataFrame:
    """Owners after an output ``(hash, segment_id, inputs)`` registers: it takes a hash only from one of its inputs, or a free one."""
    new = output.select("hash", F.col("segment_id").alias("new_segment"), "inputs")
    met = owners.select("hash", "segment_id").join(new, "hash", "full")
    take = F.col("new_segment").isNotNull() & (F.col("segment_id").isNull() | F.array_contains("inputs", F.col("segment_id")))
    return met.select("hash", F.when(take, F.col("new_segment")).otherwise(F.col("segment_id")).alias("segment_id"), F.coalesce(take, F.lit(False)).alias("taken"))


def replaced_if_matching(owners: DataFrame, moves: DataFrame) -> DataFrame:
    """``hash, segment_id, replaced``: owners moved where they are still the segment and entry that the move expects."""
    met = owners.join(moves, "hash", "left")
    same = F.coalesce((F.col("segment_id") == F.col("expected_segment")) & (F.col("entry_idx") == F.col("expected_entry")), F.lit(False))
    return met.select("hash", F.when(same, F.col("new_segment")).otherwise(F.col("segment_id")).alias("segment_id"), same.alias("replaced"))


def rekeyed_journal(journal: DataFrame, consumed: DataFrame) -> DataFrame:
    """Journal bodies under the output that consumed their segment, the last one: ``segment_id, hash, was_in, entry_idx``.

    Of bodies that come together under one key the one of the newest segment stays.
    """
    last = consumed.groupBy("segment_id").agg(F.max("output").alias("output"))
    rows = journal.join(last, "segment_id", "left").select(F.coalesce("output", "segment_id").alias("key"), "hash", F.struct("segment_id", "entry_idx").alias("at"))
    return rows.groupBy("key", "hash").agg(F.max("at").alias("at")).select(F.col("key").alias("segment_id"), "hash", F.col("at.segment_id").alias("was_in"), "at.entry_idx")


def lineage_owners(entries: DataFrame, segments: DataFrame, sources: DataFrame) -> DataFrame:
    """Owners as each volume sees them: its own first, then committed segments of its sources up to their cutoffs.

    ``volume_id, hash, segment_id, foreign_body, deduplicable``: whether the body is
    only a source's, and whether both have it.
    """
    rows = entries.where(F.col("kind").isin(*BODIES) & ~F.col("journal")).select("segment_id", "entry_idx", "hash").join(segments.select("volume_id", "segment_id", "tier"), "segment_id")
    own = first_writer(rows, ["volume_id", "hash"], [])
    seen = rows.where("tier <> 'pending'").withColumnRenamed("volume_id", "source").join(sources, "source").where(F.col("segment_id") <= F.col("cutoff"))
    seen = first_writer(seen, ["volume_id", "hash"], []).select("volume_id", "hash", F.col("segment_id").alias("theirs"))
    met = own.select("volume_id", "hash", F.col("segment_id").alias("mine")).join(seen, ["volume_id", "hash"], "full")
    return met.select("volume_id", "hash", F.coalesce("mine", "theirs").alias("segment_id"), F.col("mine").isNull().alias("foreign_body"), (F.col("mine").isNotNull() & F.col("theirs").isNotNull()).alias("deduplicable"))


def removed_uncarried(owners: DataFrame, inputs: DataFrame, carried: DataFrame) -> DataFrame:
    """Hashes that input segments own and the output does not carry, by segment."""
    gone = owners.join(inputs.select("segment_id"), "segment_id", "left_semi").join(carried.select("hash").distinct(), "hash", "left_anti")
    return gone.groupBy("segment_id").agg(F.count("*").alias("removed"))


def named_sources(entries: DataFrame) -> DataFrame:
    """Each hash that a delta names, dead ones too, with the encodings that name it."""
    return entries.where("delta_source is not null").groupBy(F.col("delta_source").alias("hash")).agg(F.count("*").alias("encodings"), F.countDistinct("segment_id").alias("segments"))


def formation_dedup(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Pending entries whose hash another entry holds become references: kinds, and bytes saved, by segment."""
    rows = with_tier(entries, segments)
    first = first_writer(rows.where(F.col("kind").isin("data", "inline", "canonical_data") & ~F.col("journal")), ["hash"], [])
    first = first.select("hash", F.col("segment_id").alias("own_segment"), F.col("entry_idx").alias("own_entry"))
    pending = rows.where("tier = 'pending'").join(first, "hash", "left")
    other = F.col("own_segment").isNotNull() & ~((F.col("own_segment") == F.col("segment_id")) & (F.col("own_entry") == F.col("entry_idx")))
    dup = F.col("kind").isin("data", "inline") & ~F.col("journal") & other
    return pending.groupBy("segment_id").agg(F.sum(dup.cast("long")).alias("deduped"), F.sum(F.when(dup, F.col("stored_length")).otherwise(0)).alias("bytes_saved"), F.count("*").alias("entries"))


def noop_writes(wal: DataFrame) -> DataFrame:
    """``seq, skipped``: writes that equal the state they meet on every block.

    A block's last write before this one must hold the same hash at the same
    offset in its extent.
    """
    from varve.operators.intervals import blocks

    at = blocks(wal.select("seq", "start_lba", "lba_length", "hash")).withColumn("offset", F.col("lba") - F.col("start_lba"))
    prior = Window.partitionBy("lba").orderBy("seq")
    same = (F.lag("hash").over(prior) == F.col("hash")) & (F.lag("offset").over(prior) == F.col("offset"))
    met = at.select("seq", F.coalesce(same, F.lit(False)).alias("same"))
    return met.groupBy("seq").agg(F.bool_and("same").alias("skipped"))


def presence_words(entries: DataFrame) -> DataFrame:
    """One bit for each entry, least significant first, in words of 32 entries: ``segment_id, word, bits, set_bits``."""
    at = F.col("entry_idx") - 1
    bit = F.when(F.col("present"), F.expr("shiftleft(1L, cast((entry_idx - 1) % 32 as int))")).otherwise(0)
    return entries.groupBy("segment_id", F.floor(at / 32).alias("word")).agg(F.sum(bit).alias("bits"), F.sum(F.col("present").cast("long")).alias("set_bits"))


def evicted(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """``entries`` after the cached bodies of committed ``segments`` are dropped: ``present`` as it is then, and ``dropped``."""
    rows = entries.join(segments.select("segment_id", F.lit(True).alias("goes")), "segment_id", "left")
    dropped = F.coalesce("goes", F.lit(False)) & F.col("present") & F.col("kind").isin("data", "canonical_data")
    return rows.withColumn("dropped", dropped).withColumn("present", F.col("present") & ~F.col("dropped")).drop("goes")


def dedup_stats(items: DataFrame, key: str = "hash", size: str = "bytes") -> DataFrame:
    """``count, unique, ratio, bytes``; the ratio is 1 where there is nothing."""
    a = items.agg(F.count("*").alias("n_items"), F.countDistinct(key).alias("n_unique"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
    return a.withColumn("ratio", F.when(F.col("n_unique") == 0, 1.0).otherwise(F.col("n_items") / F.col("n_unique")))
