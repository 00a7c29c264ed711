"""Exact top-k inner-product search: ball trees per shard, branch and bound with a shared kth score.

1. Rows go to the nearest of at most ``PIVOTS`` pivots (rows chosen by hash), and the rows of a pivot are split by hash
   into shards of bounded size, so a vector that many rows repeat fills many shards instead of one.
2. The tree of a shard is built once and stored. A node is a ball: of centre c and radius r no row scores more than
   q.c + |q| r. The same bound holds for all rows of a pivot.
3. Queries visit shards in rounds, in falling order of the pivots' bounds: the best one, the next ``ROUND``, then the
   rest. After each round a query's kth score over all shards so far is known, and only shards, nodes and leaves whose
   bound reaches it are opened in the next. Shard and queries meet in blocks, in pairs that a bound leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm.common import join_groups, table

SCALE, LEAF = 256, 128
PIVOTS, ROUND = 1024, 8
SHARD_BYTES, QUERY_BYTES = 32 << 20, 32 << 20
LARGEST = 9.2e18  # components beyond it count as it
NONE = np.iinfo(np.int64).min


class BallTree:
    """Level arrays: node j of level l covers rows ``bounds[l][j]`` to ``bounds[l][j + 1]`` of ``x`` and ``ids``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        wide, order = x.astype(np.float64), np.arange(len(x))
        cuts = [0, len(x)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > LEAF:
            new = [0]
            for a, b in zip(cuts, cuts[1:]):
                half = (b - a) // 2
                if half:
                    rows = wide[order[a:b]]
                    far = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
                    other = rows[np.argmax(((rows - far) ** 2).sum(axis=1))]
                    order[a:b] = order[a:b][np.argpartition(rows @ (other - far), half)]
                new += [a + half, b]
            cuts = new
        self._set(ids[order], x[order], np.array(cuts))
        wide = self.x.astype(np.float64)
        self.centres, self.radii = [], []
        for cut in self.bounds:
            c = np.stack([wide[a:b].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in zip(cut, cut[1:])])
            self.centres.append(c)
            self.radii.append(np.array([np.sqrt(((wide[a:b] - c[j]) ** 2).sum(axis=1).max()) if b > a else -np.inf for j, (a, b) in enumerate(zip(cut, cut[1:]))]))

    def _set(self, ids: np.ndarray, x: np.ndarray, leaves: np.ndarray) -> None:
        self.ids, self.x = ids, x
        depth = (len(leaves) - 1).bit_length() - 1
        self.bounds = [leaves[:: 1 << (depth - level)] for level in range(depth + 1)]

    def to_row(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "x": self.x.tobytes(), "leaves": self.bounds[-1].astype(np.int64).tobytes(), "centres": np.concatenate(self.centres).tobytes(), "radii": np.concatenate(self.radii).tobytes()}

    @staticmethod
    def from_row(row: dict[str, bytes], dim: int) -> BallTree:
        tree = BallTree.__new__(BallTree)
        tree._set(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.int64).reshape(-1, dim), np.frombuffer(row["leaves"], np.int64))
        ends = np.cumsum([len(b) - 1 for b in tree.bounds])[:-1]
        tree.centres, tree.radii = np.split(np.frombuffer(row["centres"]).reshape(-1, dim), ends), np.split(np.frombuffer(row["radii"]), ends)
        return tree


def reach(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x balls) of inner products, with room for rounding; -inf for empty balls."""
    norm = np.sqrt((q**2).sum(axis=1))[:, None]
    room = np.sqrt((centres**2).sum(axis=1)) + np.maximum(radii, 0)
    return q @ centres.T + norm * radii + 1e-9 * norm * room + 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond 64 bits stay at the end of their range."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), NONE + 1, -(NONE + 1)).astype(np.int64)


def _merge(best: np.ndarray, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k of rows, score falling, then id rising."""
    s, i = np.concatenate((best, scores), axis=1), np.concatenate((who, np.broadcast_to(ids, scores.shape)), axis=1)
    order = np.lexsort((i, ~s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(tree: BallTree, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x k; ``NONE`` where fewer) of rows that reach the kth score; a row is no answer to its own id."""
    wide = q.astype(np.float64)
    best, who = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    floor = kth.copy()
    open_ = np.ones((len(q), 1), bool)
    for level, (c, r) in enumerate(zip(tree.centres, tree.radii)):
        if level:
            open_ = np.repeat(open_, 2, axis=1)
        live = np.flatnonzero(open_.any(axis=0))  # below a closed node nothing is computed
        if not len(live):
            return best, who
        bound = np.full(open_.shape, -np.inf)
        bound[:, live] = reach(wide, c[live], r[live])
        open_ &= bound >= floor[:, None]
    bound[~open_] = -np.inf
    cut = tree.bounds[-1]

    def visit(leaf: int, rows: np.ndarray) -> None:
        a, b = cut[leaf], cut[leaf + 1]
        s = products(q[rows], tree.x[a:b])
        s[(tree.ids[a:b][None, :] == q_ids[rows][:, None]) | (s < floor[rows][:, None])] = NONE
        best[rows], who[rows] = _merge(best[rows], who[rows], s, tree.ids[a:b], k)
        floor[rows] = np.maximum(floor[rows], best[rows, k - 1])

    for _ in range(min(3, bound.shape[1])):  # each query's most promising leaves first: they raise its kth score
        first = bound.argmax(axis=1)
        top = bound[np.arange(len(q)), first]
        live = np.isfinite(top) & (top >= floor)
        for leaf in np.unique(first[live]):
            visit(int(leaf), np.flatnonzero(live & (first == leaf)))
        bound[np.arange(len(q)), first] = -np.inf
    for leaf in np.argsort(-bound.max(axis=0), kind="stable"):
        rows = np.flatnonzero(np.isfinite(bound[:, leaf]) & (bound[:, leaf] >= floor))
        if len(rows):
            visit(int(leaf), rows)
    return best, who


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, dim, v`` with v = floor(256 x) per component; vectors null or holding null or non-finite parts are left out."""
    wide = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    bad = F.exists(wide, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = rows.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~bad & (F.size(vec_col) > 0))
    whole = lambda e: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), e * SCALE)))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.transform(wide, whole).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Pivots:
    """Pivot rows by vector length; a length without one has the origin, number -1. Small, and the same for every task."""

    def __init__(self, rows: list) -> None:
        self.centres: dict[int, np.ndarray] = {}
        self.numbers: dict[int, np.ndarray] = {}
        for dim in {r["dim"] for r in rows}:
            own = [i for i, r in enumerate(rows) if r["dim"] == dim]
            self.numbers[dim], self.centres[dim] = np.array(own, np.int32), np.array([rows[i]["v"] for i in own], np.float64)

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return self.numbers.get(dim, np.array([-1], np.int32)), self.centres.get(dim, np.zeros((1, dim)))

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``id, dim, v`` with the nearest pivot and the distance to it."""
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                numbers, centres = self.of(int(dim))
                for lo in range(0, part.num_rows, 2048):
                    piece = part.slice(lo, 2048)
                    x = _matrix(piece.column(2)).astype(np.float64)
                    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
                    near = d.argmin(axis=1)
                    far = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(numbers[near]), pa.array(far)], ["id", "dim", "v", "pivot", "far"])


def _route(pivots: Pivots, known: dict[int, dict[int, tuple[float, int]]], lo: int, hi: float):
    """Queries to the shards at places ``lo`` to ``hi`` of their order, if the pivot's bound reaches the kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in known:
                    continue
                part = b.filter(pa.array(dims == dim))
                numbers, centres = pivots.of(int(dim))
                has = np.array([i for i, p in enumerate(numbers) if int(p) in known[dim]])
                numbers, radii, splits = numbers[has], *map(np.array, zip(*(known[dim][int(numbers[i])] for i in has)))
                ids, kth = part.column("id").to_numpy(), part.column("kth").fill_null(NONE).to_numpy()
                for at in range(0, part.num_rows, 1024):
                    piece = part.slice(at, 1024)
                    bound = reach(_matrix(piece.column("v")).astype(np.float64), centres[has], radii)
                    to: list[list[np.ndarray]] = [[], [], []]
                    for i, row in enumerate(np.argsort(-bound, axis=1, kind="stable")):
                        row = row[bound[i, row] >= kth[at + i]]
                        ends = np.cumsum(splits[row])
                        place = np.arange(lo, min(hi, ends[-1] if len(ends) else 0))
                        which = np.searchsorted(ends, place, side="right")
                        m = splits[row[which]]
                        to[0].append(np.full(len(place), i))
                        to[1].append(numbers[row[which]])
                        to[2].append((place - ends[which] + m + ids[at + i] % m) % m)  # queries begin at different splits
                    who, pivot, split = map(np.concatenate, to)
                    for start in range(0, len(who), 4096):
                        cut = slice(start, start + 4096)
                        rows = piece.take(pa.array(who[cut]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pivot[cut].astype(np.int32)), pa.array(split[cut].astype(np.int32))], [*rows.schema.names, "pivot", "split"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows other than itself, ties to the smaller id.

    Scores are exact for components of any size; a score beyond 64 bits stays at the end of their range. Vectors of
    other lengths than the query's are no candidates. Null ids take no part. Rows that repeat an id each count, apart
    from the query's own id. Empty tables give an empty result. Other columns are not read.

    Bounds of memory: ``shard_bytes`` a shard, ``query_bytes`` a block of queries; ``PIVOTS`` pivot rows and one number
    pair per pivot and vector length are known to every task.
    """
    spark = rows.sparkSession
    own, asked = table(integer_vectors(rows, id_col, vec_col), "vectors"), table(integer_vectors(queries, id_col, vec_col).dropDuplicates(["id", "v"]), "queries")
    n, n_q = own.count(), asked.count()
    room = F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / (8 * F.col("dim"))))
    spread = max(4096, -(-n // (2 * spark.sparkContext.defaultParallelism)))  # small tables still use all cores
    wanted = own.agg(F.coalesce(F.sum(1.0 / F.least(room, F.lit(spread))), F.lit(0.0))).first()[0]
    pivots = Pivots(own.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(int(min(PIVOTS, max(1, wanted)))).select("dim", "v").collect())
    near = table(own.mapInArrow(pivots.assign, "id long, dim int, v array<long>, pivot int, far double"), "near")
    shards = near.groupBy("dim", "pivot").agg(F.count("*").alias("c"), F.max("far").alias("radius"))
    shards = table(shards.withColumn("splits", F.ceil(F.col("c") / F.least(room, F.lit(spread))).cast("int")), "shards")
    known: dict[int, dict[int, tuple[float, int]]] = {}
    for r in shards.collect():  # a row per pivot and vector length
        known.setdefault(r["dim"], {})[r["pivot"]] = (r["radius"], r["splits"])

    def build(group: pa.Table) -> pa.Table:
        row = BallTree(group.column("id").to_numpy(), _matrix(group.column("v"))).to_row()
        return pa.table({**{c: group.column(c).slice(0, 1) for c in ("dim", "pivot", "split")}, **{c: pa.array([v], pa.binary()) for c, v in row.items()}})

    key = ["dim", "pivot", "split"]
    dealt = join_groups(near.drop("far"), shards.select("dim", "pivot", "c", "splits"), ["dim", "pivot"], "c", n)
    dealt = dealt.withColumn("split", F.pmod(F.xxhash64("id", F.lit(2)), F.col("splits").cast("long")).cast("int")).select("id", "v", *key)
    trees = table(dealt.groupBy(*key).applyInArrow(build, "dim int, pivot int, split int, ids binary, x binary, leaves binary, centres binary, radii binary"), "trees")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        tree = BallTree.from_row({c: left.column(c)[0].as_py() for c in ("ids", "x", "leaves", "centres", "radii")}, left.column("dim")[0].as_py())
        q_ids, kth = right.column("id").to_numpy(), right.column("kth").fill_null(NONE).to_numpy()
        q, out = _matrix(right.column("v")), []
        for lo in range(0, len(q), 1024):
            s, i = search(tree, q_ids[lo : lo + 1024], q[lo : lo + 1024], kth[lo : lo + 1024], k)
            has = s > NONE
            out.append((np.repeat(q_ids[lo : lo + 1024], k)[has.ravel()], i[has], s[has]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    wide = asked.agg(F.max("dim")).first()[0] or 1
    blocks = max(1, -(-n_q * 8 * wide // query_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    ready = asked.withColumn("kth", F.lit(None).cast("long"))
    most = max((sum(m for _, m in own_.values()) for own_ in known.values()), default=0)
    for lo, hi in ((0, 1), (1, 1 + ROUND), (1 + ROUND, np.inf)):
        if lo >= most:
            break
        routed = ready.select("id", "dim", "v", "block", "kth").mapInArrow(_route(pivots, known, lo, hi), "id long, dim int, v array<long>, block int, kth long, pivot int, split int")
        routed = table(routed, "routed")
        pairs = routed.select(*key, F.col("block").alias("asked_by")).distinct().toDF("d", "p", "s", "asked_by").hint("merge")
        met = pairs.join(trees, (F.col("d") == F.col("dim")) & (F.col("p") == F.col("pivot")) & (F.col("s") == F.col("split"))).drop("d", "p", "s")
        found = met.groupBy(*key, "asked_by").cogroup(routed.groupBy(*key, "block")).applyInArrow(look, "query_id long, vec_id long, score long")
        best = table(best.unionByName(found).withColumn("rank", place).where(F.col("rank") <= k).drop("rank"), "best")
        kth = best.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("kth")).where(F.col("c") == k).select(F.col("query_id").alias("id"), "kth")
        ready = asked.join(kth, "id", "left")
    return best.withColumn("rank", place.cast("int")).select("query_id", "rank", "vec_id", "score")
