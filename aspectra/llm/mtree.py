"""Exact top-k inner products by best-first search over M-trees.

Largest inner product becomes smallest distance: every vector x gains one
component sqrt(M - |x|^2), M the largest squared norm, and a query gains 0.
Vectors are dealt to the nearest of a bounded number of pivots; a pivot with
many vectors (equal ones, say) is split by id.  Each share becomes pages of an
M-tree: a routing object, a covering radius and each member's distance to the
routing object.  Nodes of pages, and of nodes, up to one root have radii and
parent distances of their own.

A search takes nodes in the order of the least distance that their radius
allows and stops when none can beat the k-th score; stored distances to the
parent rule out children and members without computing theirs.  Scores of what
is left are whole numbers, compared exactly; equal scores go to the smaller id.

Shards hold a bounded number of vectors; queries are read in blocks from a
written table, so neither side is ever held whole.  Vectors that are null or
hold null or non-finite components take no part; a shorter vector counts as
filled up with zeros; a row is no candidate for a query with its own id.
Repeated rows of a vector are a candidate each.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import about, materialize, shared_dir, shuffle_width

PAGE = 128
PIVOTS = 1024
SHARD = 32_768
FANOUT = 16
QUERIES = 512
HIT_SCHEMA = "query_id long, vec_id long, score long"


def whole(embedding: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of a column as rows, filled up with zeros."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    size = np.diff(at)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = flat[at[0] : at[-1]]
    return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


class Node:
    """A page of members or a routing node of children, each with its distance to the node's own routing object."""

    def __init__(self, points: np.ndarray, radii: np.ndarray, children: list[Node] | None = None, ids: np.ndarray | None = None, x: np.ndarray | None = None) -> None:
        """``points``: the members, or the children's routing objects; ``radii``: the children's, 0 of members."""
        self.router = points[np.argmin(((points - points.mean(0)) ** 2).sum(1))]
        far = _distances(points, self.router[None])[:, 0]
        near = np.argsort(far, kind="stable")
        self.far, self.radii, self.points = far[near], radii[near], points[near] if children else None  # members are not lifted again
        self.children = [children[k] for k in near] if children else None
        self.ids, self.x = (ids[near], x[near]) if children is None else (None, None)
        self.radius = float((far + radii).max())


class Tree:
    """One shard: pages of at most ``PAGE`` members, and ``FANOUT`` nodes to a node above, up to one root."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, group: np.ndarray, most: float) -> None:
        """``group``: members of one group share pages where they can."""
        order = np.lexsort((ids, group))
        self.most, self.counted, self.root = most, 0, None
        points = lifted(x, most)
        level = []
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            for k in range(0, len(own), PAGE):
                rows = own[k : k + PAGE]
                level.append(Node(points[rows], np.zeros(len(rows)), ids=ids[rows], x=x[rows]))
        while len(level) > 1:
            level = _gathered(level)
        self.root = level[0] if level else None

    def search(self, query_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of those that reach ``least``, equal scores by the smaller id.

        Nodes come in the order of the least distance that their radius allows;
        stored distances rule out children and members before theirs are computed.
        """
        if self.root is None:
            return []
        point = np.append(q, 0.0)
        square = float(q @ q) + self.most
        slack = 1e-9 * (square + 1)
        whole = q @ q * self.most < 2.0**104  # then every sum of products is exact in doubles
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its least is the one to beat
        d = float(np.sqrt(((point - self.root.router) ** 2).sum()))
        ahead = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        number = 0

        def reach() -> float:
            """The largest distance at which a vector still reaches the score to beat."""
            beat = max(least, best[0][0]) if len(best) == k else least
            return np.inf if beat == -np.inf else float(np.sqrt(max(0.0, square - 2 * beat + 2 * slack))) * (1 + 1e-9) + 1e-6

        while ahead:
            low, _, d, node = heapq.heappop(ahead)
            far = reach()
            if low > far:
                break
            if node.children is not None:
                live = np.flatnonzero(np.abs(d - node.far) - node.radii <= far)  # |d - far| bounds the child's distance from below
                if len(live):
                    own = np.sqrt(((node.points[live] - point) ** 2).sum(1))
                    for j, one in zip(live.tolist(), own.tolist(), strict=True):
                        bound = max(low, one - float(node.radii[j]))
                        if bound <= far:
                            number += 1
                            heapq.heappush(ahead, (bound, number, one, node.children[j]))
                continue
            a, b = np.searchsorted(node.far, d - far), np.searchsorted(node.far, d + far, "right")
            self.counted += b - a
            if whole:
                scores = node.x[a:b] @ q
                beat = max(least, best[0][0]) if len(best) == k else least
                hopeful = np.flatnonzero(scores >= beat)
            else:
                asked = [int(v) for v in q]
                scores = [sum(int(v) * w for v, w in zip(row, asked, strict=True)) for row in node.x[a:b]]
                hopeful = [j for j, s in enumerate(scores) if s >= least]
            for j in hopeful:
                vec = int(node.ids[a + j])
                if vec == query_id:
                    continue
                one = (int(scores[j]), -vec)
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return [(s, -v) for s, v in best]


def _gathered(level: list[Node]) -> list[Node]:
    """The nodes above: each starts at the first node left and takes those nearest to it."""
    routers, left, out = np.array([n.router for n in level]), np.arange(len(level)), []
    while len(left):
        far = ((routers[left] - routers[left[0]]) ** 2).sum(1)
        own = left[np.argsort(far, kind="stable")[:FANOUT]]
        out.append(Node(routers[own], np.array([level[k].radius for k in own]), children=[level[k] for k in own]))
        left = np.setdiff1d(left, own, assume_unique=True)
    return out


def _read(folder: str, width: int, away: int | None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(ids, vectors, scores to reach) of the queries in a folder, block by block; those at home in the shard ``away`` are left out."""
    store, at = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
    for f in sorted(store.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(QUERIES):
                    if away is not None:
                        batch = batch.filter(pc.not_equal(batch.column("home"), away))
                    x = _matrix(batch.column("x"), max(width, max((len(v) for v in batch.column("x")), default=0)))[:, :width]
                    yield batch.column("vec_id").to_pylist(), x, batch.column("least").to_numpy(zero_copy_only=False)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries(vec_id, x)`` over ``vectors(vec_id, x)``, x arrays of whole numbers.

    Rows of ``queries`` that share an id are one query, the least of their vectors.
    A query is first answered by the shard of its own neighbourhood; its k-th
    score there goes along to all other shards, which only answer with what
    reaches it, and most of which its distance to their pivots rules out at once.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x"), "vectors")
    ends = vectors.agg(
        F.count("*").alias("n"),
        F.max(F.size("x")).alias("width"),
        F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)).alias("most"),
    ).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not ends["n"]:
        return empty
    width, most = max(1, ends["width"]), float(ends["most"])
    wanted = min(PIVOTS, -(-ends["n"] // PAGE))
    key = F.xxhash64("vec_id")
    chosen = about(vectors, key, wanted).orderBy(key, "vec_id").limit(wanted).select("x").toArrow()
    pivots = lifted(_matrix(chosen.column("x").combine_chunks(), width), most)
    wanted = len(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a query has no length of its own in the added component, so it is lifted by 0
            x = _matrix(batch.column("x"), max(width, max((len(v) for v in batch.column("x")), default=0)))[:, :width]
            points = lifted(x, most)
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            points[asked, -1] = 0.0
            far = _distances(points, pivots)
            near = far.argmin(1)
            columns = [*batch.columns[:2], pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "pivot", "far"])

    def placed(df: DataFrame, asked: bool, name: str) -> DataFrame:
        own = df.select("vec_id", "x", F.lit(asked).alias("asked"))
        return materialize(own.mapInArrow(dealt, "vec_id long, x array<long>, pivot int, far double"), name)

    members = placed(vectors, False, "placed")
    found = {r["pivot"]: r for r in members.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # PIVOTS rows at most
    share = min(SHARD, max(1, -(-ends["n"] // shuffle_width(spark))))
    shard, pieces, room, first = {}, {}, 0, 0
    for p in _chain(pivots, sorted(found)):  # neighbouring pivots fill shards in turn; one beyond a shard is dealt to several by id
        if room + found[p]["n"] > share and room:
            first, room = first + 1, 0
        pieces[p] = -(-found[p]["n"] // share)
        shard[p] = first
        if pieces[p] > 1:
            first, room = first + pieces[p], 0
        else:
            room += found[p]["n"]
    balls: dict[int, list[int]] = {}  # the pivots of each shard
    for p in shard:
        for k_ in range(pieces[p]):
            balls.setdefault(shard[p] + k_, []).append(p)
    radius = np.array([found[p]["far"] if p in found else 0.0 for p in range(wanted)])

    lookup = spark.createDataFrame([(p, shard[p], pieces[p]) for p in shard], "pivot int, first int, pieces int")
    at = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).cast("int")
    sharded = members.join(F.broadcast(lookup), "pivot").select("vec_id", "x", "pivot", at.alias("shard"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "x").groupBy("vec_id").agg(F.min("x").alias("x"))
    homes = placed(asked, True, "asked").join(F.broadcast(lookup), "pivot", "left").select("vec_id", "x", F.coalesce(at, F.lit(0)).alias("home"))
    folder = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    homes.withColumn("least", F.lit(float("-inf"))).repartition("home", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("home").parquet(f"{folder}/home")

    def searched(where: Callable[[int], str], home: bool) -> DataFrame:
        def run(key: tuple, group: pa.Table) -> pa.Table:
            own = int(key[0].as_py())
            tree = Tree(group.column("vec_id").to_numpy(), _matrix(group.column("x").combine_chunks(), width), group.column("pivot").to_numpy(), most)
            hits: list[tuple[int, int, int]] = []
            for ids, x, least in _read(where(own), width, None if home else own):
                live = range(len(ids))
                if not home:  # no ball around a pivot of this shard comes near enough
                    points = np.column_stack([x, np.zeros(len(x))])
                    low = np.maximum(0.0, _distances(points, pivots[balls[own]]) - radius[balls[own]]).min(1)
                    square = (x * x).sum(1) + most
                    live = np.flatnonzero((square - low * low) / 2 + 1e-9 * (square + 1) + 1e-3 >= least)
                for j in live:
                    hits += [(ids[j], v, s) for s, v in tree.search(ids[j], x[j], k, least[j])]
            columns = list(zip(*hits, strict=True)) if hits else [[], [], []]
            return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        return sharded.groupBy("shard").applyInArrow(run, HIT_SCHEMA)

    near = materialize(searched(lambda own: f"{folder}/home/home={own}", True), "near-hits")
    bound = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))  # beyond 2^53 rounded, hence a little less below
    least = F.when(F.col("n") >= k, F.col("low") - F.abs("low") * 4.5e-16).otherwise(float("-inf"))
    homes.join(bound, "vec_id", "left").select("vec_id", "x", "home", F.coalesce(least, F.lit(float("-inf"))).alias("least")).write.parquet(f"{folder}/all")
    hits = near.unionByName(searched(lambda own: f"{folder}/all", False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chain(points: np.ndarray, own: list[int]) -> list[int]:
    """``own`` in an order in which each is followed by the nearest one that is left."""
    left, out = list(own), []
    while left:
        if out:
            far = ((points[left] - points[out[-1]]) ** 2).sum(1)
            out.append(left.pop(int(far.argmin())))
        else:
            out.append(left.pop(0))
    return out
