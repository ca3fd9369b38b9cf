"""Analytics: histograms, snapshot differences, rewrite chains, inspection totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the age buckets in seconds, exclusive; the last has none.
AGES = ((60, "1m"), (300, "5m"), (900, "15m"), (3600, "1h"), (21_600, "6h"), (86_400, "24h"))
#: Upper edges of the wait histogram in milliseconds, exclusive.
WAITS = (1, 10, 100, 1000, 10_000)
BLOCK = 4096


def age_bucket(seconds: Column) -> Column:
    out = F.when(seconds < AGES[0][0], AGES[0][1])
    for edge, name in AGES[1:]:
        out = out.when(seconds < edge, name)
    return out.otherwise("older")


def density_census(stats: DataFrame) -> DataFrame:
    """By pool and age: segments, dead ones, bytes, mean and least density; and by pool alone (age ``all``)."""
    out = stats.rollup("pool", "age").agg(F.count("*").alias("segments"), F.sum((F.col("density") == 0).cast("long")).alias("fully_dead"), F.sum("total_bytes").alias("bytes"), F.round(F.avg("density"), 6).alias("mean_density"), F.min("density").alias("least_density"))
    return out.where("pool is not null").withColumn("age", F.coalesce("age", F.lit("all")))


def power_bucket(n: Column) -> Column:
    """The least power of two that is not below ``n`` (1 for 0)."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))


def funnel(entries: DataFrame, least: int) -> DataFrame:
    """Size histogram of stored bodies: entries, bytes, and the share at or above ``least`` and canonical."""
    rows = entries.where("stored_length > 0").withColumn("bucket", power_bucket(F.col("stored_length")))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("stored_length").alias("bytes"), F.sum((F.col("stored_length") >= least).cast("long")).alias("eligible"), F.sum(F.col("kind").like("canonical%").cast("long")).alias("canonical"))


def capped_load(entries: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order until the sizes before them reach ``budget``, the crossing row included.

    Sums by stretch of segments come first, so the global window is over few rows.
    """
    stretch = F.floor(F.col(order[0]) / 1024)
    sums = entries.groupBy(stretch.alias("stretch")).agg(F.sum(size).alias("total"))
    ahead = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("total").over(ahead), F.lit(0))).where(F.col("before") < budget)
    inside = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumn("stretch", stretch).join(sums.select("stretch", "before"), "stretch")
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.where(F.col("before") < budget).drop("stretch")


def rewrite_chains(entries: DataFrame, least: int) -> DataFrame:
    """Versions of each address in segment order without neighbouring repeats: ``volume_id, start_lba, length``, two versions at least."""
    order = Window.partitionBy("volume_id", "start_lba").orderBy("segment_id", "entry_idx")
    rows = entries.where("lba_length > 0").withColumn("prior", F.lag("hash").over(order)).where("prior is null or prior <> hash")
    first = F.min(F.struct("segment_id", "entry_idx", "stored_length")).alias("first")
    chains = rows.groupBy("volume_id", "start_lba").agg(F.count("*").alias("length"), first)
    return chains.where((F.col("length") >= 2) & (F.col("first.stored_length") >= least)).select("volume_id", "start_lba", "length")


def chain_histogram(chains: DataFrame, cap: int = 16) -> DataFrame:
    return chains.groupBy(F.least("length", F.lit(cap)).alias("length")).agg(F.count("*").alias("chains"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Unique hashes of both images, those in common, their share of each, and their bytes in the first."""
    x, y = a.groupBy("hash").agg(F.max("bytes").alias("bytes")), b.select("hash").distinct().withColumn("in_b", F.lit(True))
    met = x.withColumn("in_a", F.lit(True)).join(y, "hash", "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    out = met.agg(F.count("in_a").alias("unique_a"), F.count("in_b").alias("unique_b"), F.sum(both.cast("long")).alias("common"), F.coalesce(F.sum(F.when(both, F.col("bytes"))), F.lit(0)).alias("common_bytes"))
    return out.withColumn("share_a", F.when(F.col("unique_a") == 0, 0.0).otherwise(F.col("common") / F.col("unique_a"))).withColumn("share_b", F.when(F.col("unique_b") == 0, 0.0).otherwise(F.col("common") / F.col("unique_b")))


def file_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files by path: exact, changed, new or removed, with the size that counts."""
    met = a.select("path", F.col("hash").alias("old"), F.col("bytes").alias("old_bytes")).join(b.select("path", F.col("hash").alias("new"), F.col("bytes").alias("new_bytes")), "path", "full")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "exact").otherwise("changed")
    return met.select("path", kind.alias("class"), F.coalesce("new_bytes", "old_bytes").alias("bytes"))


def class_totals(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def renames(a: DataFrame, b: DataFrame) -> DataFrame:
    """New paths: renamed from a removed path with the same content (the first by name), same-size candidates, or new; and what was removed."""
    gone = a.join(b.select("path"), "path", "left_anti")
    fresh = b.join(a.select("path"), "path", "left_anti")
    by_hash = a.groupBy("hash").agg(F.min("path").alias("from_path"))
    by_size = gone.where("bytes > 0").groupBy("bytes").agg(F.min("path").alias("near_path"))
    met = fresh.join(by_hash, "hash", "left").join(by_size, "bytes", "left")
    kind = F.when(F.col("from_path").isNotNull(), "renamed").when(F.col("near_path").isNotNull(), "same_size").otherwise("new")
    found = met.select("path", kind.alias("class"), F.coalesce("from_path", "near_path", F.lit("")).alias("source"), "bytes")
    used = found.where("class = 'renamed'").select(F.col("source").alias("path"))
    lost = gone.join(used, "path", "left_anti").select("path", F.lit("removed").alias("class"), F.lit("").alias("source"), "bytes")
    return found.unionByName(lost)


def sparse_buckets(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Changed files by the share of their blocks that changed, in fifths; blocks past the old end count as changed."""
    cut = lambda t, name: t.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("body") / block).cast("int") - 1, F.lit(0)))).alias("nth"), "body").select("path", "nth", F.sha2(F.substring("body", F.col("nth") * block + 1, F.lit(block)), 256).alias(name))
    changed = a.select("path", F.col("hash").alias("h")).join(b, "path").where("h <> hash").select("path")
    met = cut(b.join(changed, "path", "left_semi"), "new").join(cut(a, "old"), ["path", "nth"], "left")
    share = met.groupBy("path").agg(F.count("*").alias("blocks"), F.sum((~F.col("new").eqNullSafe(F.col("old"))).cast("long")).alias("changed"))
    bucket = F.least(F.floor(F.col("changed") * 5 / F.col("blocks")), F.lit(4))
    return share.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("changed").alias("changed_blocks"), F.sum("blocks").alias("blocks"))


def directory_rollup(path: Column, levels: int = 3) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, levels), "/"))


def top_directories(files: DataFrame, n: int = 8) -> DataFrame:
    rows = files.groupBy(F.coalesce(directory_rollup(F.col("path")), F.lit("(unattributed)")).alias("dir")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    return rows.orderBy(F.desc("bytes"), "dir").limit(n)


def totals(entries: DataFrame) -> DataFrame:
    """Entries, blocks and bytes by kind, by tier, and in all."""
    out = entries.groupingSets([[F.col("kind")], [F.col("tier")], []], F.col("kind"), F.col("tier")).agg(F.count("*").alias("n"), F.sum("lba_length").alias("blocks"), F.sum("stored_length").alias("bytes"), F.round(100 * F.avg(F.col("present").cast("int")), 4).alias("present_pct"))
    return out.fillna("all", ["kind", "tier"])


def wait_histogram(waits: DataFrame) -> DataFrame:
    """Waits by site and bucket, and each site's peak."""
    bucket = sum((F.col("millis") >= w).cast("long") for w in WAITS)
    return waits.groupBy("site", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("millis").alias("peak"))


def wait_windows(waits: DataFrame, width: int) -> DataFrame:
    """By window and site: waits, their time and the worst, what changed since the window before, and whether the site is the worst there.

    ``waits (site, millis, at)``; windows are ``width`` of ``at``.
    """
    rows = waits.groupBy(F.floor(F.col("at") / width).alias("window"), "site").agg(F.count("*").alias("n"), F.sum("millis").alias("millis"), F.max("millis").alias("peak"))
    order = Window.partitionBy("site").orderBy("window")
    since = lambda c: F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))
    top = F.max(F.struct("millis", "site")).over(Window.partitionBy("window"))["site"]
    return rows.withColumns({"n_since": since("n"), "millis_since": since("millis"), "top": top == F.col("site")})


def upper_median(values: DataFrame, by: str, value: str) -> DataFrame:
    """The middle value of each group, the upper one of two, from counts by value."""
    counts = values.groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    whole = F.sum("n").over(Window.partitionBy(by))
    rows = counts.select(by, value, upto.alias("upto"), whole.alias("whole"))
    return rows.where(F.col("upto") > F.floor(F.col("whole") / 2)).groupBy(by).agg(F.min(value).alias("median"))


def commitment(ids: DataFrame, by: str, member: str) -> DataFrame:
    """A fingerprint of each group's set of members."""
    return ids.groupBy(by).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(member)).cast("array<string>")), 256).alias("commitment"), F.countDistinct(member).alias("members"))
