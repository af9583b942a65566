"""Operator 10: exact top-k inner products by a dual-tree search over cover trees.

Queries and data are indexed together: pivots, a net over a bounded sample, split both into cells, and
each cell's rows into blocks with a cover tree of their own (nested nets whose covering radius halves
from level to level). The search first takes each group of queries to the likeliest blocks of its own
cell. That gives every query a k-th score; the worst of a group, with the covering radii, prunes pairs of
cells, then pairs of group and block in the cells that are left, before any vector is sent, and pairs of
inner nodes within a task: <q, r> <= <q0, r0> + |q0| R + |r0| Q + Q R for any q within Q of q0 and r within
R of r0. A block is sent once to each of its tasks, and the groups to be held against it come to it.

Scores are exact integers. The pivots' sample only shapes the cells: every row is indexed and any pivots
give the same result. Defined results: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows with a null vec_id; vectors of another length than the query's are no
candidates; an empty table gives no rows; other columns are left out. Rows are told apart even where they
are equal: each row with a query's vec_id is a query of its own, and every row but that very one is a
candidate, so that repeated rows are returned as often as they stand in the table. No value is clipped: a
score beyond 2^63 - 2 either way has its exact rank, and is returned as null, as no long holds it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parallelism

K, EVERY, FACTOR = 20, 20, 64
#: Rows of a block, queries of a group, rows that the pivots are chosen from, pivots at most.
BLOCK, GROUP, SAMPLE, PIVOTS = 4096, 1024, 4096, 1024
LEAF = 256
#: Children of a node at most; where so many do not reach half its radius, they cover as closely as they can.
FANOUT = 16
#: Rows of a block's leaves that are multiplied at once.
TOGETHER = 1024
#: Tasks that the groups which meet one block are dealt to.
SHARES = 8
#: Blocks of its own cell that a group is taken to first.
FIRST = 2
NO_SCORE = -np.iinfo(np.int64).max


#: The same by comparing everything with everything; for scores that a double holds exactly.
ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({FACTOR} * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, q.r, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r AND len(q.e) = len(v.e) WHERE q.vec_id % {EVERY} = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {K}
"""


def quantized(rows: DataFrame, vec_id: str = "vec_id", column: str = "embedding", factor: int = FACTOR) -> DataFrame:
    """vec_id, dim and v: floor(factor * x) of each component, as little-endian doubles, which hold it exactly.

    Where a component's product is beyond all doubles, v has the row's integers in decimal digits instead; its length
    is then no multiple of 8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(factor * x)
                ids.append(i)
                dims.append(len(x))
                if np.isfinite(whole).all():
                    out.append(whole.astype("<f8").tobytes())
                else:  # a product that no double holds
                    digits = b",".join(b"%d" % math.floor(factor * Fraction(c)) for c in x.tolist())
                    out.append(digits + b" " * ((1 - len(digits)) % 8))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), column).mapInArrow(run, "vec_id long, dim int, v binary")


def integers(v: bytes) -> list[int]:
    """The components of a v in digits."""
    return [int(c) for c in v.split(b",")]


def components(v: bytes) -> np.ndarray:
    """v as doubles; what they do not hold is infinite."""
    if len(v) % 8 == 0:
        return np.frombuffer(v, "<f8")
    most = int(np.finfo(np.float64).max)
    return np.array([float(c) if abs(c) <= most else math.inf if c > 0 else -math.inf for c in integers(v)])


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of rows; beyond what a double holds infinite or NaN, which prune nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((x - to) ** 2).sum(axis=1))


def farthest_first(x: np.ndarray, most: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(net, nearest net point of each row, distance to it): rows are taken far from all others, until all are covered."""
    net, near = [0], np.zeros(len(x), np.int64)
    dist = distances(x, x[0])
    while len(net) < most and dist.max() > within:
        at = int(dist.argmax())
        d = distances(x, x[at])
        near[d < dist] = len(net)
        dist = np.minimum(dist, d)
        net.append(at)
    return np.array(net), near, dist


class CoverTree:
    """Nested nets: a node's children are a net of its rows that covers them within half its radius.

    Rows are reordered so that a node's rows are rows start to end; radius is what covers all of them.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.children: list[list[int]] = []
        self._grow(x, np.arange(len(x)), 0, leaf)
        self.centers, self.radii = np.array(self.center), np.array(self.radius)

    def _grow(self, x: np.ndarray, rows: np.ndarray, first: int, leaf: int) -> int:
        me = len(self.center)
        own = x[rows]
        dist = distances(own, own[0])
        self.center.append(own[0])
        self.radius.append(float(dist.max()))
        self.start.append(first)
        self.end.append(first + len(rows))
        self.children.append([])
        self.order[first : first + len(rows)] = rows
        if len(rows) <= leaf or dist.max() == 0 or not math.isfinite(dist.max()):
            return me
        net, near, _ = farthest_first(own, min(FANOUT, len(rows) // 4), dist.max() / 2)
        for c in range(len(net)):
            mine = np.flatnonzero(near == c)
            mine = np.r_[net[c], mine[mine != net[c]]]  # the child keeps its net point as its center
            self.children[me].append(self._grow(x, rows[mine], first, leaf))
            first += len(mine)
        return me


class Best:
    """The k best (score, vec_id) of each of some queries; scores below a query's floor cannot count."""

    def __init__(self, n: int, k: int = K, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, NO_SCORE) if floor is None else floor
        self.score = np.full((n, k), NO_SCORE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.over: dict[int, list[tuple[int, int]]] = {}  # scores that no long holds, and their ids

    def least(self, rows: slice) -> np.ndarray:
        """What a score must reach to count, row by row; NO_SCORE where anything counts."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def exceed(self, row: int, score: int, vec_id: int) -> None:
        """A candidate whose score no long holds; the k best of either sign stay."""
        held = self.over.setdefault(row, [])
        held.append((score, vec_id))
        if len(held) > 8 * self.k:
            held.sort(key=lambda x: (-x[0], x[1]))
            high = sum(x[0] > 0 for x in held)
            held[:] = held[: min(high, self.k)] + held[high : high + self.k]

    def add(self, first: int, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (rows ascending, counted from first on); ties go to the smaller id."""
        if not len(row):
            return
        own, place, count = np.unique(row, return_index=True, return_counts=True)
        s = np.full((len(own), int(count.max())), NO_SCORE)
        i = np.full(s.shape, np.iinfo(np.int64).max)
        r, c = np.repeat(np.arange(len(own)), count), np.arange(len(row)) - np.repeat(place, count)
        s[r, c], i[r, c] = scores, ids
        at = first + own
        s, i = np.concatenate([self.score[at], s], axis=1), np.concatenate([self.id[at], i], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point multiplication where that is exact, Python's integers where no long holds them."""
    most = 2**63 if object in (q.dtype, r.dtype) else int(np.abs(q).max()) * int(np.abs(r).max()) * q.shape[1]
    if most < 2**52:
        return q.astype(np.float64) @ r.astype(np.float64).T
    if most < 2**63 - 1:
        return q.astype(np.int64) @ r.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object)
    return whole(q) @ whole(r).T


def reach_of(floor: np.ndarray | int) -> np.ndarray:
    """What a bound must reach, as doubles."""
    return np.where(np.asarray(floor) == NO_SCORE, -np.inf, floor)


def order_key(score: int) -> bytes:
    """Bytes that rise with scores of one sign."""
    n = (abs(score).bit_length() + 7) // 8
    raw = n.to_bytes(4, "big") + abs(score).to_bytes(n, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


def bound(qc: np.ndarray, qr: np.ndarray, rc: np.ndarray, rr: np.ndarray) -> np.ndarray:
    """What no inner product exceeds, of pairs of balls (row by row), with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        qn, rn = np.sqrt((qc**2).sum(axis=1)), np.sqrt((rc**2).sum(axis=1))
        b = (qc * rc).sum(axis=1) + qn * rr + rn * qr + qr * rr
        b = b + 1e-9 * (qn + qr) * (rn + rr) + 1e-6
    return np.where(np.isnan(b), np.inf, b)


def search(qt: CoverTree, q: np.ndarray, q_rows: np.ndarray, rt: CoverTree, r: np.ndarray, r_rows: np.ndarray, r_ids: np.ndarray, best: Best) -> None:
    """Dual-tree traversal; q and r are in their trees' orders, best is by the rows of q. Equal numbers of rows mean the same row."""
    stack = [(0, 0)]
    jobs: dict[int, list[int]] = {}
    while stack:  # pairs of nodes down to leaves, without scores: jobs gathers what is left
        a, b = stack.pop()
        worst = reach_of(best.least(slice(qt.start[a], qt.end[a])).min())
        qa, rb = qt.children[a], rt.children[b]
        if not qa and not rb:
            jobs.setdefault(a, []).append(b)
        elif rb and (not qa or rt.radii[b] >= qt.radii[a]):
            kids = np.array(rb)
            ok = bound(qt.centers[a : a + 1], qt.radii[a : a + 1], rt.centers[kids], rt.radii[kids]) >= worst
            stack += [(a, int(c)) for c in kids[ok]]
        else:
            kids = np.array(qa)
            ok = bound(qt.centers[kids], qt.radii[kids], rt.centers[b : b + 1], rt.radii[b : b + 1]) >= worst
            stack += [(int(c), b) for c in kids[ok]]
    for a, leaves in jobs.items():
        first, last = qt.start[a], qt.end[a]
        near = bound(qt.centers[a : a + 1], qt.radii[a : a + 1], rt.centers[leaves], rt.radii[leaves])
        turn = np.argsort(-near)
        upto = np.cumsum([rt.end[leaves[x]] - rt.start[leaves[x]] for x in turn])
        done = 0
        while done < len(turn):  # the most promising leaves first, so that the rest are pruned
            least = best.least(slice(first, last))
            z = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + TOGETHER)) + 1
            some = [leaves[x] for x in turn[done:z][near[turn[done:z]] >= reach_of(least.min())]]
            done = z
            if not some:
                break
            at = np.concatenate([np.arange(rt.start[b], rt.end[b]) for b in some])
            own = q_rows[first:last, None] == r_rows[at]
            s = products(q[first:last], r[at])
            if s.dtype == object:
                far = (np.abs(s) > -NO_SCORE - 1).astype(bool)
                for i, j in zip(*np.nonzero(far & ~own), strict=True):
                    best.exceed(first + int(i), s[i, j], int(r_ids[at[j]]))
                own = own | far
                s = np.where(own, NO_SCORE, s).astype(np.int64)
            k = best.k + 1  # one may be the query itself
            if s.shape[1] > k and least.min() == NO_SCORE:
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            row, col = np.nonzero((s >= least[:, None]) & ~own)
            best.add(first, row, s[row, col].astype(np.int64), r_ids[at][col])


def packed(pdf: pd.DataFrame) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    """The tree over some rows, and their vectors, numbers and ids in the tree's order."""
    pdf = pdf.sort_values("row", kind="stable")
    v = np.stack([components(b) for b in pdf.v])
    tree = CoverTree(v)
    if not np.isfinite(v).all():
        v = np.array([integers(b) if len(b) % 8 else [int(c) for c in np.frombuffer(b, "<f8").tolist()] for b in pdf.v], object)
    return tree, v[tree.order], pdf.row.to_numpy()[tree.order], pdf.vec_id.to_numpy()[tree.order]


def smallest(v: np.ndarray) -> np.ndarray:
    """v in the smallest integers that hold it, or as it is where none do."""
    if v.dtype == object:
        return v
    most = np.abs(v).max()
    return v.astype(np.min_scalar_type(-1 - int(most))) if most < 2**53 else v


def search_top(rows: DataFrame, k: int = K, every: int = EVERY, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose vec_id is divisible by every."""
    spark = rows.sparkSession
    n_parts = parallelism(spark)
    vecs = cut(quantized(rows, factor=factor).withColumn("row", F.monotonically_increasing_id()))
    total = vecs.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not total:
        return spark.createDataFrame([], schema)
    # pivots: a net over a sample of fixed size, one for about BLOCK rows
    sample = vecs.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sample}:
        x = np.stack([components(r.v) for r in sample if r.dim == dim])
        x = x[np.isfinite(x).all(axis=1)] if np.isfinite(x).all(axis=1).any() else np.zeros((1, dim))
        pivots[dim] = x[farthest_first(x, min(PIVOTS, max(1, total // BLOCK)))[0]]
    sent = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int32)
            raw = batch.column(2).to_pylist()
            for dim, p in sent.value.items():
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 1000):
                    x = np.stack([components(raw[j]) for j in at[i : i + 1000]])
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[at[i : i + 1000]] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "dim", "v", "row", "cell"])

    placed = vecs.mapInArrow(assign, "vec_id long, dim int, v binary, row long, cell int").withColumn("query", F.col("vec_id") % every == 0)
    # a cell's rows in blocks of bounded size, dealt by a hash, so that no cell is one task
    counts = placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"), F.count_if("query").alias("queries"))
    sized = placed.join(counts, ["dim", "cell"])
    h = F.xxhash64("row")
    data = sized.withColumn("part", F.pmod(h, F.ceil(F.col("rows") / BLOCK)).cast("int"))
    asked = sized.where("query").withColumn("part", F.pmod(h, F.ceil(F.col("queries") / GROUP)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cell, part = (int(pdf[c].iloc[0]) for c in ("dim", "cell", "part"))
        tree, v, row, ids = packed(pdf)
        reach = distances(v.astype(np.float64) if v.dtype != object else np.stack([components(b) for b in pdf.v]), sent.value[dim][cell]).max() if dim in sent.value else math.inf
        return pd.DataFrame({"dim": [dim], "cell": [cell], "part": [part], "center": [tree.centers[0].tolist()], "radius": [tree.radii[0]], "reach": [float(reach)], "rows": [row.tolist()], "image": [pickle.dumps((tree, smallest(v), row, ids))]})

    kind = "dim int, cell int, part int, center array<double>, radius double, reach double, rows array<long>, image binary"
    key, gkey = ["dim", "cell", "part"], ["dim", "gcell", "gpart"]
    blocks = cut(data.groupBy(*key).applyInPandas(build, kind).drop("rows"))
    groups = cut(asked.groupBy(*key).applyInPandas(build, kind).withColumnsRenamed({c: f"g{c}" for c in ("cell", "part", "center", "radius", "reach", "image")}))
    heads, gheads = blocks.drop("image"), groups.drop("gimage", "rows")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("center", "gcenter", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    most = dot + norm("center") * F.col("gradius") + norm("gcenter") * F.col("radius") + F.col("radius") * F.col("gradius")
    most = most + F.lit(1e-9) * (norm("center") + F.col("radius")) * (norm("gcenter") + F.col("gradius")) + F.lit(1e-6)  # NaN is above all

    # beyond: 1 and -1 for scores above and below any long, whose order is that of key
    found = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32()), ("key", pa.binary())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (image, floors): a block, without floors, and the groups that meet it behind it."""
        block = None
        for batch in batches:
            for image, floors in zip(batch.column(0), batch.column(1), strict=True):
                if not floors.is_valid:
                    block = pickle.loads(image.as_py())
                    continue
                tree, q, q_rows, q_ids = pickle.loads(image.as_py())
                best = Best(len(q), k, np.fromiter(floors.as_py(), np.int64, len(q)))
                search(tree, q, q_rows, *block, best)
                at, nth = np.nonzero(best.score != NO_SCORE)
                made = [q_rows[at], q_ids[at], best.id[at, nth], best.score[at, nth], np.zeros(len(at), np.int32), np.full(len(at), None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, found.types, strict=True)], names=found.names)
                if odd := [(q_rows[i], q_ids[i], j, None, 1 if s > 0 else -1, order_key(s)) for i, held in best.over.items() for s, j in held]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*odd, strict=True), found.types, strict=True)], names=found.names)

    def searched(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        """The best of each query over the pairs of group and block."""
        pairs = pairs.select(*gkey, "cell", "part").withColumn("share", F.pmod(F.xxhash64("gcell", "gpart"), F.lit(SHARES)).cast("int"))
        at = [*key, "share"]
        held = blocks.join(pairs.select(*at).distinct(), key).select(*at, F.lit(0).alias("turn"), "image", F.lit(None).cast("array<long>").alias("floors"))
        asks = pairs.join(floors, gkey).join(groups.select(*gkey, "gimage"), gkey).select(*at, F.lit(1).alias("turn"), F.col("gimage").alias("image"), "floors")
        met = held.unionByName(asks).repartition(n_parts, *at).sortWithinPartitions(*at, "turn")
        return met.select("image", "floors").mapInArrow(solve, "query long, query_id long, vec_id long, score long, beyond int, key binary")

    nearest = Window.partitionBy(*gkey).orderBy(F.desc("most"), "part")
    own = gheads.join(heads, (gheads.dim == heads.dim) & (gheads.gcell == heads.cell)).drop(heads.dim).withColumn("most", most)
    own = cut(own.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= FIRST).select(*gkey, "cell", "part"))
    none = groups.select(*gkey, F.transform("rows", lambda _: F.lit(NO_SCORE)).alias("floors"))
    first = cut(searched(own, none))
    # each query's k-th score so far, and the worst of a group: what a block must be able to reach
    ranked = Window.partitionBy("query").orderBy(F.desc("beyond"), F.desc("key"), F.desc("score"), "vec_id")
    so_far = cut(first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).drop("r"))
    kth = so_far.groupBy("query").agg(F.coalesce(F.when((F.count("*") >= k) & (F.min("beyond") >= 0), F.min("score")), F.lit(NO_SCORE)).alias("kth"))
    members = groups.select(*gkey, F.posexplode("rows").alias("pos", "query")).join(kth, "query", "left").withColumn("kth", F.coalesce("kth", F.lit(NO_SCORE)))
    floors = members.groupBy(*gkey).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kth"))), lambda x: x["kth"]).alias("floors"), F.min("kth").alias("floor"))
    floors = cut(floors)  # GROUP numbers a row
    # pairs of cells first: PIVOTS a length, and lengths that the sample lacks have one cell each
    reach = {(r.dim, r.cell): r.reach for r in heads.where(F.col("dim").isin(list(pivots))).groupBy("dim", "cell").agg(F.max("reach").alias("reach")).collect()}
    held = spark.sparkContext.broadcast({dim: (cells := sorted(c for d, c in reach if d == dim), np.array([reach[dim, c] for c in cells])) for dim in pivots})

    def near_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, g, r, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dim not in held.value:
                    out.append((dim, g, g))
                    continue
                cells, reaches = held.value[dim]
                p = sent.value[dim]
                ok = bound(p[g : g + 1], np.array([r]), p[cells], reaches) >= reach_of(floor)
                out += [(dim, g, c) for c, near in zip(cells, ok.tolist(), strict=True) if near]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int32()) for i in range(3)], names=["dim", "gcell", "cell"])

    cells = gheads.join(floors, gkey).groupBy("dim", "gcell").agg(F.max("greach").alias("reach"), F.min("floor").alias("floor"))
    cells = cells.mapInArrow(near_cells, "dim int, gcell int, cell int")
    left = gheads.join(floors.select(*gkey, "floor"), gkey).join(cells, ["dim", "gcell"]).join(heads, ["dim", "cell"]).where((F.col("floor") == NO_SCORE) | (most >= F.col("floor")))
    left = cut(left.select(*gkey, "cell", "part").join(own, [*gkey, "cell", "part"], "left_anti"))
    every_one = so_far.unionByName(searched(left, floors))
    return every_one.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
