"""Operator 3: embedding near-dedup with an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook of its own (k-means on a bounded
sample), and the product of the two is a grid of cells. Every vector lies in its nearest cell and visits cells in
the order of the multi-sequence algorithm (growing sum of squared distances of the two halves) until the excess
over its own cell passes a radius. The radius is calibrated on the sample for a target recall: for neighbours at
exactly the threshold, the share whose cell has been visited is at least the target. Candidates are verified by
cosine in double precision, so no pair below the threshold is linked.

A pair that both visits find is counted once: in the cell with the lower number.

Copies (equal components) are one entry with a count. Members and visitors of a cell with many of either are dealt
over blocks (cell, i, j), from counts per cell, so that no task holds a whole hot cell; a task returns counts of links
and a spanning forest, never pairs. Codebooks grow with the root of the number of vectors (up to max_book entries
each, from at most sample_rows vectors), so that cells keep their size up to max_book**2 * per_cell vectors.

Vectors of each length have an index of their own and link among themselves. Vectors that are null, zero, or hold null
or non-finite components link with nothing. Rows with a null vec_id have a row of their own without links. Rows that repeat a
vec_id are vectors of their own, and share the component of that id. Labels and other columns are never read.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm.common import cut, quoted, table
from verity.llm.components import Forest, components


#: Most rows (of two numbers and a cell) of a table that is broadcast.
BROADCAST_CELLS = 200_000


class Grid:
    """Two codebooks and the radius of a visit."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [_kmeans(sample[:, : self.half], size, rng), _kmeans(sample[:, self.half :], size, rng)]
        self.size = (len(self.books[0]), len(self.books[1]))
        # Neighbours at the threshold, in random directions: how far beyond its own cell is a neighbour's cell?
        x = sample[rng.integers(0, len(sample), 4000)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * away
        need = float(np.quantile(self.excess(x, self.cells(y)), recall))
        # And real neighbours, whose differences may lie in few directions: pairs of the sample above the threshold.
        found = []
        for k in range(0, min(len(sample), 8192), 512):
            near = sample[k : k + 512] @ sample[:8192].T
            i, j = np.nonzero((near >= threshold) & (near < 1 - 1e-12))
            if len(i):
                pick = rng.permutation(len(i))[:20_000]
                found.append(self.excess(sample[k + i[pick]], self.cells(sample[j[pick]])))
        if found:
            need = max(need, float(np.quantile(np.concatenate(found), recall)))
        self.radius = need + 1e-9

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its codebook."""
        return tuple(((h * h).sum(1)[:, None] - 2 * h @ b.T + (b * b).sum(1)) for h, b in ((x[:, : self.half], self.books[0]), (x[:, self.half :], self.books[1])))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.size[1] + b.argmin(1)

    def excess(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Squared distance to given cells beyond that to the nearest one."""
        a, b = self.distances(x)
        i, j = np.divmod(cells, self.size[1])
        rows = np.arange(len(x))
        return a[rows, i] - a.min(1) + b[rows, j] - b.min(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits: for each row the multi-sequence traversal up to the radius, nearest cell first.

        All rows go together: of each row the centres of the first half within the radius, and for each of them as
        many of the second half's as the rest of the radius allows; sorted by their sum, that is the order in which
        multi_sequence takes them off its queue.
        """
        a, b = self.distances(x)
        a, b = a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)
        ob = b.argsort(1)
        sb = np.take_along_axis(b, ob, 1)
        row, first = np.nonzero(a <= self.radius)
        rest = self.radius - a[row, first]
        most = int((sb <= self.radius).sum(1).max(initial=0))
        many = (sb[:, :most][row] <= rest[:, None]).sum(1) if most else np.zeros(len(row), np.int64)
        at = np.repeat(np.arange(len(row)), many)
        j = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        row, first = row[at], first[at]
        order = np.lexsort((a[row, first] + sb[row, j], row))
        return row[order], (first * self.size[1] + ob[row, j])[order]


def multi_sequence(first: list[float], second: list[float], radius: float):
    """Pairs of places in two ascending lists in the order of their sums, until a sum passes the radius: the traversal
    of one vector, which Grid.visits does for many at once and is tested against."""
    heap, seen = [(first[0] + second[0], 0, 0)] if first and second else [], set()
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > radius:
            return
        yield i, j
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(first) and q < len(second) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[p] + second[q], p, q))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centre = np.unique(x, axis=0)
    centre = centre[rng.permutation(len(centre))[:k]].copy()
    for _ in range(rounds):
        near = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    x = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.999, sample_rows: int = 32768, per_cell: int = 48, max_book: int = 2048, block: int = 4096) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    rows = vectors.select(quoted(vectors, id_col).cast("long").alias("vec_id"), quoted(vectors, vector_col).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & finite, F.lit(False)))
    rest = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    lengths = [r["d"] for r in rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    if not lengths:
        return rest.select("*", F.lit(True).alias("kept"))
    parts = [_same_length(rows.where(F.col("ok") & (F.size("v") == d)).select("vec_id", "v"), threshold, recall, sample_rows, per_cell, max_book, block) for d in lengths]
    entry, links = (functools.reduce(DataFrame.unionByName, p) for p in zip(*parts, strict=True))
    entry = entry.join(components(links).withColumnRenamed("id", "rep"), "rep", "left").select(F.col("v").alias("vec"), "links", F.coalesce("component", "rep").alias("component"))
    out = rows.where("ok").join(entry, rows["v"] == entry["vec"], "left").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_length(rows: DataFrame, threshold: float, recall: float, sample_rows: int, per_cell: int, max_book: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Of usable vectors (vec_id, v) of one length, from an index of their own: distinct vectors (v, rep, links), and
    links of a spanning forest (u, v)."""
    # Copies are one entry. Positive multiples are not merged: they meet in the same cell and link there.
    entry = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    entry = cut(entry)
    n = entry.count()
    sample = np.array([r["v"] for r in entry.orderBy(F.xxhash64("rep"), "rep").limit(min(sample_rows, n)).select("v").collect()])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    book = int(np.clip(np.sqrt(n / per_cell), 1, max_book))
    if sample.shape[1] < 2:
        sample = np.hstack([sample, np.zeros_like(sample)])
    shared = rows.sparkSession.sparkContext.broadcast(Grid(sample, book, threshold, recall))

    def place(batches):
        grid = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                x = _two(_unit(part))
                home = grid.cells(x)
                row, cell = grid.visits(x)
                own = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(home[row]), pa.array(cell)], ["v", "rep", "copies", "home", "cell"])

    placed = entry.mapInArrow(place, "v array<double>, rep long, copies long, home long, cell long")
    # Blocks of members and of visitors, from counts per cell: only cells that are large in either have a row.
    member, width = F.col("home") == F.col("cell"), F.lit(block)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if(member) / width).cast("int").alias("m"), F.ceil(F.count(F.lit(1)) / width / 2).cast("int").alias("q"))
    sizes = cut(sizes.where("m > 1 OR q > 1"))
    small = sizes.count() <= BROADCAST_CELLS
    split = placed.join(F.broadcast(sizes) if small else sizes, "cell", "left")
    split = split.withColumn("m", F.greatest(F.coalesce("m", F.lit(1)), F.lit(1))).withColumn("q", F.greatest(F.coalesce("q", F.lit(1)), F.lit(1)))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visitors = split.withColumn("i", part("q")).withColumn("j", every("m")).withColumn("member", F.lit(False))
    members = split.where("home = cell").withColumn("j", part("m")).withColumn("i", every("q")).withColumn("member", F.lit(True))
    keys = ["cell", "i", "j"]

    def verify(batches):
        """All blocks of a partition: rows come sorted by block, members before visitors."""
        grid, held = shared.value, []
        for batch in batches:
            held.append(batch)
        if not held:
            return
        data = pa.Table.from_batches(held)
        key = np.stack([data.column(k).to_numpy() for k in keys])
        edges = np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), data.num_rows], strict=True):
            if b > a:
                yield from _block(grid, data.slice(a, b - a), int(key[0, a]), threshold)

    found = (
        members.unionByName(visitors).select("v", "rep", "copies", "home", *keys, "member")
        .repartition(max(8, -(-n // 3000)), *keys).sortWithinPartitions(*keys, F.desc("member"))
        .mapInArrow(verify, "u long, w long, n long")
    )
    found = cut(found)
    counts = found.where("w IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    entry = entry.join(counts, "rep", "left").select("v", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return entry, found.where("w IS NOT NULL").select("u", F.col("w").alias("v"))


def _two(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros_like(x)]) if x.shape[1] < 2 else x


def _block(grid: Grid, data: pa.Table, cell: int, threshold: float):
    data = data.combine_chunks()
    batch = data.to_batches()[0]
    x = _unit(batch)
    rep, copies, home, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "copies", "home", "member"))
    m, q = np.flatnonzero(member), np.flatnonzero(~member)
    if not len(m) or not len(q):
        return
    back: dict[int, np.ndarray] = {}
    links = np.zeros(len(rep), np.int64)
    forest = Forest(len(rep))
    for a in range(0, len(q), 512):
        qa = q[a : a + 512]
        i, j = np.nonzero(x[qa] @ x[m].T >= threshold - 1e-9)
        i, j = qa[i], m[j]
        keep = rep[i] != rep[j]
        i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
        # The other end may visit this visitor's home as well: then the lower cell counts the pair.
        both = (home[i] > cell) | (home[i] == cell)
        for h in np.unique(home[i[~both]]).tolist():
            if h not in back:
                back[h] = grid.excess(_two(x), np.full(len(x), h)) <= grid.radius
            at = ~both & (home[i] == h)
            both[at] = ~back[h][j[at]]
        same = home[i] == cell
        forest.union(i, j)
        i, j, same = i[both], j[both], same[both]
        np.add.at(links, i, copies[j])
        other = ~same  # a pair of one cell comes twice, once from each end
        np.add.at(links, j[other], copies[i[other]])
    hit = np.flatnonzero(links)
    if len(hit):
        yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.nulls(len(hit), pa.int64()), pa.array(links[hit])], ["u", "w", "n"])
    up = forest.roots()
    e = np.flatnonzero(up != np.arange(len(up)))
    if len(e):
        yield pa.RecordBatch.from_arrays([pa.array(rep[e]), pa.array(rep[up[e]]), pa.array(np.zeros(len(e), np.int64))], ["u", "w", "n"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
