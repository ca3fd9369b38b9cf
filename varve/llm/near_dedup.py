"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

1. Every text becomes its set of word shingles, a fingerprint of the set, and a
   fast similarity sketch cut into bands (:mod:`varve.llm.sketching`). Texts
   with the same set are one class, represented by one row with its smallest id.
2. Representatives that agree in a band share a bucket. Each is verified on its
   whole set against the bucket's hub, its smallest id: links grow with the
   number of rows, not with the square of a bucket.
3. Large buckets whose members the links have not joined are verified against
   ``HUBS`` more hubs, drawn by hash, which joins nearly all of a large group.
4. Buckets that are still apart are searched whole. Small ones yield their
   pairs across components. In large ones every member outside the bucket's
   largest component meets all others in blocks of bounded size, whose exact
   intersections are one matrix product, and only links come out: a member is
   copied once for each block of outsiders, not once for each block of the
   bucket. No pair that shares a band goes unchecked.
5. Components of the links (:mod:`varve.llm.components`).

Bands and rows follow from the threshold: the most rows for which a pair at the
threshold misses all bands with a probability of at most ``MISS``, with at most
``BINS`` bins.

Defined results. Null texts and texts without words have an empty set: they are
linked with nothing. Rows that repeat an id are one vertex with the links of
all their texts; each row tells the size of its own set. Null ids are left out
of links and get the component null. A text of any length is one sorted array
of shingle hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import checkpoint, kept, small
from varve.llm.components import components
from varve.llm.sketching import Shingler, band_keys, sketch

#: Chance that a pair at the threshold shares no band.
MISS = 1e-8
#: Bins of a sketch at most.
BINS = 256
#: Shingles that are sketched at a time.
AT_ONCE = 300_000
#: Buckets of more members are searched in blocks of so many members and shingles.
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 48, 512, 500_000
#: Further hubs of large buckets, and members from which a bucket gets them.
HUBS, MANY = 8, 2048

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
SETS = "doc_id long, set_a long, set_b long, shingles array<long>"


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands for a threshold in hundredths."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if rows * bands <= BINS:
            return rows, bands
    return 1, BINS


def fingerprints(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """128 bits for each whole set, as two columns."""
    found = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
    return pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles``, the fingerprint of the set, and the keys of the sketch's bands."""
    rows, bands = banding(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(f"shingles {width}", lambda: Shingler(width))

        def batch_of(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys = band_keys(sketch(full, rows * bands), rows) if full else np.empty((0, bands), np.int64)
            each = np.array([len(s) for s in sets])
            ends = np.concatenate([[0], np.cumsum(np.where(each > 0, bands, 0))]).astype(np.int32)
            columns = [pa.array(ids, pa.int64()), pa.array(each, pa.int64()), *fingerprints(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text.as_py()))
                held += len(sets[-1])
                if held >= AT_ONCE:
                    yield batch_of(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield batch_of(ids, sets)

    return docs.mapInArrow(sign, SIGNED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, the fingerprint, ``shingles``: the whole sets, sorted."""

    def batch_of(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *fingerprints(sets), lists], ["doc_id", "set_a", "set_b", "shingles"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(f"shingles {width}", lambda: Shingler(width))
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text.as_py()))
                held += len(sets[-1])
                if held >= AT_ONCE:
                    yield batch_of(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield batch_of(ids, sets)

    return docs.mapInArrow(sets_of, SETS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets have the similarity asked for.

    The intersection is taken row by row where the join meets, so a pair of long
    texts needs the memory of two sets and no batch of them.
    """
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    second = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    both, x, y = (F.size(c).cast("long") for c in (F.array_intersect("set_a", "set_b"), "set_a", "set_b"))
    close = (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (both * (100 + percent) >= (x + y) * percent)
    return second.where(close).select("a", "b")


def block_links(percent: int):
    """A function of one block's rows (two sides of members): links across components that join them."""

    def find(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("component").to_numpy()
        sides = table.column("side").to_numpy()
        sets = table.column("shingles").combine_chunks()
        flat = sets.flatten().to_numpy()
        sizes = np.diff(sets.offsets.to_numpy())
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        del order
        fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
        column = np.cumsum(fresh) - 1
        shared = np.bincount(column)[column] > 1 if len(flat) else fresh  # a shingle of one member is in no intersection
        owner, column = owner[shared], column[shared]
        column = np.cumsum(np.concatenate([[0], (np.diff(column) > 0).astype(np.int64)])) if len(column) else column
        common = np.zeros((len(ids), len(ids)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, b = np.searchsorted(column, [low, low + 2048])
            part = np.zeros((len(ids), 2048), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        size = sizes.astype(np.float64)
        common = common.astype(np.float64)  # whole numbers below 2**24 until here
        close = 100.0 * common >= percent * (size[:, None] + size[None, :] - common)
        close &= comps[:, None] != comps[None, :]
        if sides.min() != sides.max():
            close &= sides[:, None] != sides[None, :]
        root = {c: c for c in comps.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i in range(len(ids)):
            for j in np.flatnonzero(close[i, i + 1 :]) + i + 1:
                x, y = top(comps[i]), top(comps[j])
                if x != y:
                    root[x] = y
                    out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return find


def near_links(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes of equal sets that connect all that are similar enough.

    ``signed``: the signatures of ``docs (doc_id, text)``, each with its class
    ``cls``, and ``chosen`` for the one row that represents it.
    """
    reps = signed.where("chosen")
    members = reps.select(F.col("cls").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = checkpoint(members.join(hubs, "bucket"))
    wanted = reps.join(members.select(F.col("id").alias("cls")).distinct(), "cls", "left_semi")
    wanted = checkpoint(wanted.select("doc_id", "set_a", "set_b", F.col("cls").alias("id")))
    texts = docs.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = shingle_sets(texts, width).join(small(wanted), ["doc_id", "set_a", "set_b"]).select("id", "shingles")
    if signed.where("repeated").limit(1).count():
        sets = sets.dropDuplicates(["id"])  # rows that repeat an id and a set
    sets = checkpoint(sets)
    links = checkpoint(verified(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets, percent))
    rest = apart(members, links)
    hot = rest.where(F.col("m") > MANY)
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(h)).alias("at"), "id", "component")) for h in range(HUBS)]
    more_hubs = hot.groupBy("bucket").agg(F.array(*drawn).alias("hubs"))
    again = hot.join(more_hubs, "bucket").select("id", "component", F.explode("hubs").alias("hub")).where(F.col("component") != F.col("hub.component"))
    if hot.limit(1).count():
        links = checkpoint(links.unionByName(verified(again.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), sets, percent)))
        rest = apart(members, links)
    few = rest.where(F.col("m") <= SMALL).select("bucket", "id", "component", "n")
    other = few.select("bucket", F.col("id").alias("b"), F.col("component").alias("other"), F.col("n").alias("k"))
    near_sizes = F.least("n", "k") * 100 >= F.greatest("n", "k") * percent
    pairs = few.withColumnRenamed("id", "a").join(other, "bucket").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & near_sizes)
    more = verified(pairs.select("a", "b").distinct(), sets, percent)
    wide = in_blocks(rest.where(F.col("m") > SMALL), sets).groupBy("bucket", "i", "j").applyInArrow(block_links(percent), "a long, b long")
    return links.unionByName(checkpoint(more.unionByName(wide)))


def apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The ``members`` of buckets that the links leave in several components, with ``component``."""
    members = members.drop("hub").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return checkpoint(members.join(several.select("bucket"), "bucket"))


def in_blocks(many: DataFrame, sets: DataFrame) -> DataFrame:
    """``bucket, i, j, side, id, component, shingles``: blocks in which each member outside the largest component meets all others.

    Block numbers from 0 are outsiders, those from -1 down the largest
    component; two blocks of the latter never meet.
    """
    parts = many.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sums = parts.groupBy("bucket").agg(F.max(F.struct("rows", "shingles", "component")).alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    number = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("long")
    sums = sums.select(
        "bucket",
        F.col("main.component").alias("main"),
        number(F.col("main.rows"), F.col("main.shingles")).alias("inner"),
        number(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("outer"),
    )
    rows = many.join(sums, "bucket")
    inside = F.col("component") == F.col("main")
    spot = F.xxhash64("id")
    rows = rows.withColumn("side", F.when(inside, -1 - F.pmod(spot, F.col("inner"))).otherwise(F.pmod(spot, F.col("outer"))))
    # an outsider meets all blocks, a member of the largest component those of outsiders
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inside, F.lit(0).cast("long")).otherwise(-F.col("inner")), F.col("outer") - 1)))
    rows = rows.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "component")
    return rows.join(sets, "id")


def classed(signed: DataFrame) -> DataFrame:
    """Signatures with their class ``cls``: the number of the row that represents the equal sets, one with their ``least_id``.

    ``repeated`` marks the rows that have the id and the set of the representative without being it.
    """
    signed = checkpoint(signed.withColumn("row", F.monotonically_increasing_id()))
    usable = F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull()
    least = signed.where(usable).groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    signed = signed.join(least, ["set_a", "set_b"], "left")
    chosen = F.coalesce(F.col("row") == F.col("rep.row"), F.lit(False))
    repeated = F.coalesce((F.col("doc_id") == F.col("rep.doc_id")) & ~chosen, F.lit(False))
    return checkpoint(signed.withColumns({"chosen": chosen, "repeated": repeated, "cls": F.col("rep.row"), "least_id": F.col("rep.doc_id"), "bands": F.when(chosen, F.col("bands"))}).drop("rep", "row"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = classed(signatures(slim, width, percent))
    links = near_links(slim, signed, width, percent)
    linked = signed.where("cls is not null")
    # an id with several sets links their classes
    several = linked.where("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("high")).where("a <> high")
    links = links.unionByName(linked.join(several, "doc_id").select("a", F.col("cls").alias("b")).where("a <> b").distinct())
    found = components(links).select(F.col("id").alias("cls"), "component")
    told = linked.where("chosen").select("cls", "doc_id").join(found, "cls")
    least = told.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = told.join(least, "component").select("cls", "component_id")
    full = linked.select("doc_id", "n_shingles", "cls", "least_id").join(of_class, "cls", "left")
    full = full.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "least_id")).alias("component_id"))
    rest = signed.where("cls is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    return full.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest id, and all null ids."""
    gone = digest(docs, id_col, text_col, width, percent).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    gone = small(checkpoint(gone))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
