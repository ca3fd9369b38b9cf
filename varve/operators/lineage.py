"""Fork lineage: ancestor walks, reachability, and the forest of volumes.

Walks are recursive queries for one volume, and a closure by doubling for all of
them: a step joins the closure with itself, so a chain of length n takes log n
joins and each cut of lineage stays small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.sources.shared import cut

#: Links after which a walk is taken to go round.
MOST_LINKS = 100_000


def closure(edges: DataFrame) -> DataFrame:
    """``id, ancestor, depth`` over ``edges (id, parent)``, one parent each; depth 1 is the parent.

    What is reached so far is kept, so each doubling reads it instead of
    computing it again.
    """
    paths = cut(edges.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")))
    reach = 1
    while True:
        far = paths.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("mid"))
        if far.isEmpty():
            return paths
        step = paths.select(F.col("id").alias("mid"), "ancestor", F.col("depth").alias("more"))
        paths = cut(paths.unionByName(far.join(step, "mid").select("id", "ancestor", (F.col("more") + reach).alias("depth"))))
        reach *= 2


def ancestor_walk(lineage: DataFrame, volume: int) -> DataFrame:
    """Layers of one volume, oldest first, each with the snapshot that its child branched at."""
    session = lineage.sparkSession
    lineage.select("volume_id", "parent_id", "branch_snapshot").createOrReplaceTempView("varve_lineage")
    return session.sql(f"""
        WITH RECURSIVE walk(volume_id, parent_id, branch_snapshot, cutoff, depth) AS (
            SELECT volume_id, parent_id, branch_snapshot, CAST(NULL AS BIGINT), 0 FROM varve_lineage WHERE volume_id = {int(volume)}
            UNION ALL
            SELECT l.volume_id, l.parent_id, l.branch_snapshot, w.branch_snapshot, w.depth + 1 FROM walk w JOIN varve_lineage l ON l.volume_id = w.parent_id)
        SELECT volume_id, coalesce(cutoff, -1) AS cutoff, CAST(max(depth) OVER () - depth AS BIGINT) AS layer FROM walk""")


def walked(lineage: DataFrame) -> DataFrame:
    """``id, ancestor, depth`` of all volumes, link by link: what a single walk finds, for all at once.

    Each step is cut, as recursive SQL stops at a million rows in all.
    """
    links = lineage.where("parent_id is not null").select(F.col("volume_id").alias("ancestor"), F.col("parent_id").alias("next"))
    steps = [cut(links.select(F.col("ancestor").alias("id"), F.col("next").alias("ancestor"), F.lit(1).cast("long").alias("depth")))]
    while not steps[-1].isEmpty():
        if len(steps) > MOST_LINKS:
            raise ValueError(f"a chain of more than {MOST_LINKS} links")
        steps.append(cut(steps[-1].join(links, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth"))))
    return reduce(DataFrame.union, steps)


def walks_agree(lineage: DataFrame) -> DataFrame:
    """``volume_id, ancestors, agree``: whether the closure and the walk link by link give the same chain."""
    a = closure(lineage.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent"))).withColumn("here", F.lit(True))
    b = walked(lineage).withColumn("there", F.lit(True))
    met = a.join(b, ["id", "ancestor", "depth"], "full")
    found = met.groupBy(F.col("id").alias("volume_id")).agg(F.count("*").alias("ancestors"), F.bool_and(F.col("here").isNotNull() & F.col("there").isNotNull()).alias("agree"))
    return lineage.select("volume_id").join(found, "volume_id", "left").fillna(0, ["ancestors"]).fillna(True, ["agree"])


def listing(volumes: DataFrame) -> DataFrame:
    """``filter, place, name, volume_id``: what each filter lists: named volumes by name, then unnamed read-only ancestors by id.

    ``volumes (volume_id, name, readonly)``; an ancestor that was pulled has no name.
    """
    filters = F.explode(F.array(*map(F.lit, ("all", "readonly", "writable")))).alias("filter")
    rows = volumes.select("volume_id", "name", "readonly", filters)
    kept = F.when(F.col("filter") == "all", F.lit(True)).when(F.col("filter") == "readonly", F.col("readonly")).otherwise(~F.col("readonly"))
    named = F.col("name").isNotNull()
    rows = rows.where(F.when(named, kept).otherwise(F.col("readonly") & (F.col("filter") != "writable")))
    order = Window.partitionBy("filter").orderBy(F.col("name").isNull(), "name", "volume_id")
    return rows.select("filter", F.row_number().over(order).cast("long").alias("place"), F.coalesce("name", F.lit("-")).alias("name"), "volume_id")


def source_cutoffs(lineage: DataFrame) -> DataFrame:
    """For each volume the extent sources of its parent chain, with the greatest snapshot of each."""
    chain = closure(lineage.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent")))
    own = lineage.select("volume_id", F.explode("sources").alias("source"), F.coalesce("branch_snapshot", F.lit(-1)).alias("cutoff"))
    up = chain.join(own.withColumnRenamed("volume_id", "ancestor"), "ancestor").select(F.col("id").alias("volume_id"), "source", "cutoff")
    return own.unionByName(up).groupBy("volume_id", "source").agg(F.max("cutoff").alias("cutoff"))


def lineage_set(lineage: DataFrame) -> DataFrame:
    """For each volume its ancestors, nearest first, then the sources that are not among them: ``volume_id, member, place``."""
    chain = closure(lineage.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent")))
    near = chain.select(F.col("id").alias("volume_id"), F.col("ancestor").alias("member"), F.col("depth").alias("place"))
    sources = lineage.select("volume_id", F.posexplode("sources").alias("nth", "member")).select("volume_id", "member", (F.col("nth") + 1000).cast("long").alias("place"))
    return near.unionByName(sources).groupBy("volume_id", "member").agg(F.min("place").alias("place"))


def chain_check(lineage: DataFrame, present: Column) -> DataFrame:
    """``volume_id, depth, missing``: ancestors of each chain that are absent or fail ``present``."""
    ids = lineage.select("volume_id", "parent_id", present.alias("ok"))
    chain = closure(ids.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent")))
    met = chain.join(ids.select(F.col("volume_id").alias("ancestor"), "ok"), "ancestor", "left")
    return met.groupBy(F.col("id").alias("volume_id")).agg(F.max("depth").alias("depth"), F.sum((~F.coalesce("ok", F.lit(False))).cast("long")).alias("missing"))


def forest(lineage: DataFrame) -> DataFrame:
    """Each node with its class and whether it is live; parents without a row are ``missing`` nodes.

    A node is live if it is an anchor or an anchor descends from it.
    """
    known = lineage.select("volume_id", "parent_id", "role")
    absent = known.where("parent_id is not null").select(F.col("parent_id").alias("volume_id")).distinct().join(known.select("volume_id"), "volume_id", "left_anti")
    nodes = known.unionByName(absent.select("volume_id", F.lit(None).cast("long").alias("parent_id"), F.lit("missing").alias("role")))
    anchors = known.where("role = 'anchor'").select(F.col("volume_id").alias("id"))
    reached = closure(known.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent"))).join(anchors, "id", "left_semi")
    live = reached.select(F.col("ancestor").alias("volume_id")).union(anchors.select("id")).distinct().withColumn("live", F.lit(True))
    return nodes.join(live, "volume_id", "left").select("volume_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "role", F.coalesce("live", F.lit(False)).alias("live"))


def referencing_anchors(lineage: DataFrame) -> DataFrame:
    """For each node the anchors below it, itself aside."""
    anchors = lineage.where("role = 'anchor'").select(F.col("volume_id").alias("id"))
    chain = closure(lineage.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent")))
    return chain.join(anchors, "id", "left_semi").groupBy(F.col("ancestor").alias("volume_id")).agg(F.count("*").alias("anchors"), F.min("id").alias("first_anchor"))


def liveness_pass(nodes: DataFrame, condemned: DataFrame, blocked: bool) -> DataFrame:
    """Dead nodes: swept now if already condemned, otherwise condemned for the next pass; nothing is swept while ``blocked``."""
    dead = nodes.where("not live").select("volume_id")
    if blocked:
        return dead.select("volume_id", F.lit("kept").alias("action"))
    met = dead.join(condemned.select("volume_id", F.lit(True).alias("before")), "volume_id", "left")
    return met.select("volume_id", F.when(F.col("before"), "swept").otherwise("condemned").alias("action"))


def tree(lineage: DataFrame) -> DataFrame:
    """Indented names in depth-first order: ``path`` sorts as the tree is drawn."""
    chain = closure(lineage.select(F.col("volume_id").alias("id"), F.col("parent_id").alias("parent")))
    up = chain.groupBy(F.col("id").alias("volume_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))).alias("a"), F.max("depth").alias("depth"))
    rows = lineage.select("volume_id").join(up, "volume_id", "left")
    name = lambda c: F.lpad(c.cast("string"), 8, "0")
    path = F.concat_ws("/", F.transform(F.coalesce("a", F.array().cast("array<struct<d:bigint,ancestor:bigint>>")), lambda x: name(x["ancestor"])), name(F.col("volume_id")))
    depth = F.coalesce("depth", F.lit(0))
    return rows.select("volume_id", path.alias("path"), F.concat(F.repeat(F.lit("  "), depth.cast("int")), F.col("volume_id").cast("string")).alias("line"))
