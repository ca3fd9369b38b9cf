"""Exact top-k inner products by best-first search of a paged M-tree.

Inner products become distances: with M the greatest norm, a vector x gets one
more component sqrt(M^2 - |x|^2) and a query q the component 0; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors have the greatest inner
products, and the metric's triangle inequality bounds scores.

The upper nodes have routing objects (a bounded sample, ``NODES`` at most).
Every vector lies in its nearest node, and a node is stored in pages of about
``PAGE`` entries by their distance to the routing object, so a page has a
covering radius, and an inner radius that all its entries are beyond: the more
vectors a node has, the thinner its pages. A query first searches its own page,
which bounds its k-th distance, then every page that the triangle inequality
does not rule out by these two radii and the query's own distance to the
routing object. Queries travel in blocks, so a page meets a block at a time. Inside
a page is a small M-tree of its own: nodes by lower bound from a heap, and for
their entries the stored distance to the parent rules most out before any
distance is computed.

Scores are exact integers; bounds are compared with slack, so rounding never
prunes a tie. Defined results: null vectors and vectors with null or non-finite
components take no part; shorter vectors are continued with zeros; rows that
repeat an id are candidates each, and queries each whose pairs are ranked
together, but never of their own id; null ids take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import checkpoint

K = 10
#: Routing objects of the upper level at most, and vectors for each of them at least.
NODES, PER_NODE = 1024, 2048
#: Entries of a page, routing objects inside it, and queries of a block and of one visit.
PAGE, INNER, BLOCK, VISIT = 4096, 32, 128, 8192

#: Steps in which distances to routing objects are counted, to cut nodes into pages.
STEPS = 256

PAGED = "vec_id long, vec binary, page long"
HITS = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, vec array<long>`` of the vectors that take part."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & vec.isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, continued with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


def unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


class Space:
    """The metric that turns inner products into distances."""

    def __init__(self, width: int, top: float) -> None:
        self.width, self.top = width, top
        self.slack = 1e-6 * (1 + np.sqrt(top))
        self.exact = top < 2.0**51  # products and sums are whole numbers below 2**53

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their extra component."""
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.top - np.einsum("ij,ij->i", x, x)))[:, None]])

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])

    def bound(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances at which vectors with these scores lie from the queries."""
        q = q.astype(np.float64)
        return np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q) + self.top - 2.0 * scores))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


class Pages:
    """Nodes cut into pages along the distance to the routing object.

    Neighbouring steps of a node share a page up to ``PAGE`` entries; a step
    with more is dealt to several pages by a hash.
    """

    def __init__(self, cells: list) -> None:
        self.rows: list[tuple[int, int, float, float]] = []  # page, node, inner radius, covering radius
        self.cells, self.first, self.count = np.array([c["cell"] for c in cells], np.int64), [], []
        held = 0
        for c in cells:
            node = c["cell"] // STEPS
            several = -(-c["n"] // PAGE)
            if several == 1 and self.rows and self.rows[-1][1] == node and held + c["n"] <= PAGE:
                page, _, low, high = self.rows[-1]
                self.rows[-1] = (page, node, min(low, c["low"]), max(high, c["high"]))
                held += c["n"]
            else:
                self.rows += [(len(self.rows) + i, node, c["low"], c["high"]) for i in range(several)]
                held = c["n"] if several == 1 else PAGE
            self.first.append(self.rows[-1][0] - several + 1)
            self.count.append(several)
        self.first, self.count = np.array(self.first, np.int64), np.array(self.count, np.int64)

    def of(self, cell: np.ndarray, spread: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cells, cell)
        return self.first[at] + spread % self.count[at] if len(at) else np.empty(0, np.int64)


class Page:
    """An M-tree over one page: routing objects, covering radii, and entries by parent with their distance to it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, vectors, self.space = ids[order], vectors[order], space
        raised = space.raised(vectors)
        self.dots = raised[:, :-1] if space.exact else vectors
        step = max(1, len(ids) // INNER)
        self.routes = raised[::step][:INNER]
        to_route = distances(raised, self.routes)
        parent = to_route.argmin(axis=1)
        near = to_route[np.arange(len(ids)), parent]
        self.nodes = []
        for n in range(len(self.routes)):
            entries = np.flatnonzero(parent == n)
            entries = entries[np.argsort(near[entries], kind="stable")]
            self.nodes.append((entries, near[entries]))
        self.radius = np.array([d[-1] if len(d) else 0.0 for _, d in self.nodes])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """``(query id, vector id, score)``: of each query at most k, all that may be in its k best."""
        space, out = self.space, []
        to_route = distances(space.query(queries), self.routes)
        lower = np.maximum(0, to_route - self.radius[None, :])
        for i, (own, reach) in enumerate(zip(query_ids.tolist(), bounds.tolist(), strict=True)):
            q = queries[i].astype(np.float64) if space.exact else queries[i]
            limit = space.bound(queries[i : i + 1], np.zeros(1))[0] ** 2  # |q|^2 + M^2
            heap = [(low, n) for n, low in enumerate(lower[i].tolist()) if low <= reach + space.slack]
            heapq.heapify(heap)
            best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
            while heap:
                low, n = heapq.heappop(heap)
                if low > reach + space.slack:
                    break
                entries, near = self.nodes[n]
                a, b = np.searchsorted(near, [to_route[i, n] - reach - space.slack, to_route[i, n] + reach + space.slack])
                entries = entries[a:b]
                if not len(entries):
                    continue
                scores = self.dots[entries] @ q
                if len(best) == k:
                    good = np.flatnonzero(scores >= best[0][0])
                    entries, scores = entries[good], scores[good]
                if len(entries) > 2 * k:
                    edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]  # one more, as the query's own id may be there
                    good = np.flatnonzero(scores >= edge)
                    entries, scores = entries[good], scores[good]
                for score, vec_id in zip(scores.tolist(), self.ids[entries].tolist(), strict=True):
                    if vec_id == own:
                        continue
                    hit = (int(score), -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                if len(best) == k:
                    reach = min(reach, float(np.sqrt(max(0.0, limit - 2.0 * best[0][0]))))
            out += [(own, -minus, score) for score, minus in best]
        return out


def top_k(table: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = K, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best among all other vectors.

    ``is_query`` is over ``vec_id``.
    """
    session = table.sparkSession
    vectors = integer_vectors(table, id_col, vec_col, scale)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.max(square).alias("top")).first()
    n, space = size["n"], Space(max(1, size["width"] or 1), float(size["top"] or 0.0))
    if not n:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    routes = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(NODES, n // PER_NODE))).select("vec").toArrow()  # NODES rows at most
    routes = space.raised(matrix(routes.column("vec"), space.width))

    widest = 2 * np.sqrt(space.top) + 1  # no distance is greater

    def assigned(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, the step of the distance to each one's node, and that distance."""
        found = matrix(column, space.width)
        far = distances(space.raised(found), routes) if len(found) else np.zeros((0, 1))
        node = far.argmin(axis=1)
        near = far[np.arange(len(node)), node]
        return found, node * STEPS + np.minimum(near / widest * STEPS, STEPS - 1).astype(np.int64), near

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(routes) * STEPS
        n, low, high = np.zeros(cells, np.int64), np.full(cells, np.inf), np.full(cells, -np.inf)
        for batch in batches:
            _, cell, near = assigned(batch.column(0))
            np.add.at(n, cell, 1)
            np.minimum.at(low, cell, near)
            np.maximum.at(high, cell, near)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(low[held]), pa.array(high[held])], ["cell", "n", "low", "high"])

    cells = vectors.select("vec").mapInArrow(count, "cell long, n long, low double, high double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell").collect()
    pages = Pages(cells)  # NODES * STEPS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cell, _ = assigned(batch.column(1))
            page = pages.of(cell, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in found], pa.binary()), pa.array(page)], ["vec_id", "vec", "page"])

    entries = checkpoint(vectors.select("vec_id", "vec", F.xxhash64("vec_id").alias("spread")).mapInArrow(place, PAGED))
    queries = entries.where(is_query).select("vec_id", "vec", "page")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            hits = []
        else:
            page = Page(left.column("vec_id").to_numpy(), unpacked(left.column("vec"), space.width), space)
            hits = []
            for row in right.select(["ids", "vecs", "bounds"]).to_pylist():
                ids, bounds = np.array(row["ids"], np.int64), np.array(row["bounds"])
                hits += page.search(ids, np.frombuffer(row["vecs"], np.int64).reshape(-1, space.width), bounds, k)
        columns = list(zip(*hits, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    def blocks(group: pa.Table) -> pa.Table:
        """One row for each page that a block of queries has to visit."""
        rows = group.sort_by("vec_id")
        ids, found, bounds, own = rows.column("vec_id").to_numpy(), unpacked(rows.column("vec"), space.width), rows.column("bound").to_numpy(), rows.column("page").to_numpy()
        visit = rows.column("visit").to_numpy()
        to_route = distances(space.query(found), routes)
        out = {"page": [], "visit": [], "ids": [], "vecs": [], "bounds": []}
        for page, node, low, high in pages.rows:
            lower = np.maximum(to_route[:, node] - high, low - to_route[:, node])
            go = np.flatnonzero((lower <= bounds + space.slack) & (own != page))
            if len(go):
                out["page"].append(page)
                out["visit"].append(visit[0])
                out["ids"].append(ids[go].tolist())
                out["vecs"].append(found[go].tobytes())
                out["bounds"].append(bounds[go].tolist())
        return pa.table({"page": pa.array(out["page"], pa.int64()), "visit": pa.array(out["visit"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int64())), "vecs": pa.array(out["vecs"], pa.binary()), "bounds": pa.array(out["bounds"], pa.list_(pa.float64()))})

    visits = "page long, visit long, ids array<long>, vecs binary, bounds array<double>"
    asked = queries.count()
    n_visits, n_blocks = max(1, -(-asked // VISIT)), max(1, -(-asked // BLOCK))
    spot = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks))
    ahead = queries.select("page", F.pmod(spot, F.lit(n_visits)).cast("long").alias("visit"), F.array("vec_id").alias("ids"), F.col("vec").alias("vecs"), F.array(F.lit(float("inf"))).alias("bounds"))

    def meet(asked: DataFrame) -> DataFrame:
        """Pages and the queries that visit them, one visit at a time."""
        wanted = asked.select(F.col("page").alias("to_page"), F.col("visit").alias("to_visit")).distinct()
        meeting = entries.join(wanted, F.col("page") == F.col("to_page")).select("vec_id", "vec", F.col("to_page").alias("page"), F.col("to_visit").alias("visit"))
        return meeting.groupBy("page", "visit").cogroup(asked.groupBy("page", "visit")).applyInArrow(search, HITS)

    first = checkpoint(meet(ahead))
    own = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("m")).where(F.col("m") >= k)
    waiting = queries.join(own.withColumnRenamed("query_id", "vec_id").select("vec_id", "worst"), "vec_id", "left")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = batch.column(3).to_numpy(zero_copy_only=False)
            q = unpacked(batch.column(1), space.width)
            bound = np.where(np.isnan(worst), np.inf, space.bound(q, np.nan_to_num(worst))) if len(q) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bound, pa.float64())], ["vec_id", "vec", "page", "bound"])

    waiting = waiting.select("vec_id", "vec", "page", F.col("worst").cast("double").alias("worst")).mapInArrow(bounded, "vec_id long, vec binary, page long, bound double")
    waiting = waiting.withColumn("block", spot).withColumn("visit", F.pmod("block", F.lit(n_visits)).cast("long"))
    sent = checkpoint(waiting.groupBy("block").applyInArrow(blocks, visits))
    hits = first.unionByName(meet(sent))  # a row of a query meets each page once, so no pair of rows is there twice
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
