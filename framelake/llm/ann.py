"""Approximate nearest neighbours by learned partitions, for the largest inner product.

Fitting, on a bounded sample: the sample's neighbour graph is cut into balanced parts (median bisection along principal
directions, then moves that keep more neighbours together while no part exceeds its capacity), and a small classifier
(one hidden layer) learns, for a vector, the share of its neighbours in each part. Parts grow with the root of the table.
Beyond FAN parts there are two levels: each part of the first is a table of its own, sampled and fitted by one task.
Indexing puts every row in its most probable part. A query goes to its most probable parts, until their predicted shares
add up to what gives the wanted recall on sample vectors that the classifier hasn't seen and they hold more ids than it wants, and all their rows are scored
exactly.

A part's rows are dealt to blocks of bounded size, and so are the queries that visit it, so a part with a third of all
rows (many equal vectors) is many tasks. Vectors that are null, zero, of another dimension than most of the sample, or
that hold null or non-finite components take no part, as query or candidate. Ties go to the smaller id; rows with a
query's own id aren't its candidates, and a repeated id counts once, with its best score: equal rows are made one before
the index, and a block takes the best score of each id before it takes the k best ids. Rows without id take no part. Only
id and vector are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Vectors of the fitting sample for each part, neighbours in the graph.
SAMPLE_PER_PART, NEIGHBOURS = 64, 20
#: Distinct vectors under which a sample is one part: neighbours would be a large share of all rows.
LEAST_SAMPLE = 12 * NEIGHBOURS
#: Parts of one fitted level at most; a table has about half the root of its rows, FAN * FAN at most.
FAN = 256
#: Share of the neighbours of held-out sample vectors that the probed parts must hold.
WANTED = 0.93
#: One sample vector of so many is kept from the network and calibrates it.
HELD_OUT = 5
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048


@dataclass(frozen=True)
class Model:
    """One level: parts of vectors, and the predicted share of neighbours that a query's parts must add up to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float

    @property
    def dim(self) -> int:
        return self.w1.shape[0]

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The predicted share of each part, a row for each vector."""
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


@dataclass(frozen=True)
class Router:
    """One level, or two: a leaf is a part of the first and a part of its own level, numbered by `first`."""

    top: Model
    below: dict[int, Model]

    @property
    def first(self) -> np.ndarray:
        """The number of the first leaf of each part, and the number of leaves."""
        return np.cumsum([0, *(self.below[p].parts if p in self.below else 1 for p in range(self.top.parts))])

    def homes(self, x: np.ndarray) -> np.ndarray:
        part = self.top.shares(x).argmax(1)
        leaf = self.first[part]
        for p in np.unique(part).tolist():
            if p in self.below:
                leaf[part == p] += self.below[p].shares(x[part == p]).argmax(1)
        return leaf

    def visits(self, x: np.ndarray, ids: np.ndarray, k: int, filled: np.ndarray | None = None) -> list[np.ndarray]:
        """The leaves that each query goes to; ids: how many ids are counted in each leaf, an id in one alone; filled: the leaves with rows."""
        filled = ids > 0 if filled is None else filled
        shares, first = self.top.shares(x), self.first
        if self.below:
            shares = np.concatenate([shares[:, p : p + 1] * (self.below[p].shares(x) if p in self.below else 1) for p in range(self.top.parts)], axis=1)
        order = np.argsort(-shares, axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(shares, order, 1), axis=1)
        enough = (upto >= self.top.mass - 1e-12) & (np.cumsum(ids[order], axis=1) > k)
        last = np.where(enough.any(1), enough.argmax(1), int(first[-1]) - 1)
        return [np.sort(o[: n + 1][filled[o[: n + 1]]]) for o, n in zip(order, last)]


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k rows of largest inner product, itself apart, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        out[i : i + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, sweeps: int = 6) -> np.ndarray:
    """A part for each row of the sample: bisected, then refined over the graph without passing the capacity."""
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                centred = x[rows] - x[rows].mean(0)
                direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
                order = np.argsort(centred @ direction, kind="stable")
                part[rows[order[len(rows) // 2 :]]] = p + made
        made *= 2
    most = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    both = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        both[i] += row
        for j in row:
            both[j].append(i)
    for sweep in range(sweeps):
        moved = 0
        for i in np.random.default_rng(sweep).permutation(len(x)):
            votes = Counter(part[both[i]].tolist())
            best = max(votes, key=lambda p: (votes[p], -p), default=part[i])
            if votes[best] > votes[part[i]] and size[best] < most:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, goal: np.ndarray, hidden: int = 96, epochs: int = 60, rate: float = 0.01) -> list[np.ndarray]:
    """A one-layer network whose softmax approaches goal (rows of shares): Adam over fixed random batches."""
    rng = np.random.default_rng(7)
    held = [rng.normal(0, 1 / np.sqrt(max(1, x.shape[1])), (x.shape[1], hidden)) * 4, np.zeros(hidden), rng.normal(0, 0.1, (hidden, goal.shape[1])), np.zeros(goal.shape[1])]
    m, v, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.tanh(x[rows] @ held[0] + held[1])
            z = h @ held[2] + held[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - goal[rows]) / len(rows)
            back = d @ held[2].T * (1 - h**2)
            step += 1
            for k, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                held[k] = held[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return held


def fit_sample(x: np.ndarray, parts: int) -> Model:
    x = np.unique(x, axis=0)
    while parts > 1 and len(x) < 24 * parts:
        parts //= 2
    if parts == 1 or len(x) < LEAST_SAMPLE:
        return Model(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    graph = neighbours(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    held = np.random.default_rng(11).permutation(len(x)) % HELD_OUT == 0
    net = Model(*learn(x[~held], goal[~held]), 1.0)
    shares = net.shares(x)
    home = shares.argmax(1)
    # the mass of the parts that come before a neighbour's home, and its own: a query that goes on to it finds the neighbour
    order = np.argsort(-shares, axis=1, kind="stable")
    upto = np.empty_like(shares)
    np.put_along_axis(upto, order, np.cumsum(np.take_along_axis(shares, order, 1), axis=1) - np.take_along_axis(shares, order, 1), 1)
    before = np.sort(upto[np.flatnonzero(held)[:, None], home[graph[held]]].ravel())
    return Model(net.w1, net.b1, net.w2, net.b2, float(before[min(len(before) - 1, int(np.ceil(WANTED * len(before))))]) + 1e-9)


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _power(parts: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, parts)))))


def _sampled(rows: DataFrame, n: int, want: int) -> DataFrame:
    """About `want` of n rows, by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < min(1.0, 1.2 * want / max(1, n)) * (1 << 30)).select("v")


def _array(vectors: list) -> np.ndarray:
    dim = Counter(map(len, vectors)).most_common(1)[0][0]
    return np.array([x for x in vectors if len(x) == dim], np.float64)


def fit(rows: DataFrame, n: int) -> Router | None:
    """Fit on samples of rows(vec_id, v), whose size depends on the number of parts alone: SAMPLE_PER_PART * FAN a level."""
    parts = min(_power(n**0.5 / 2), FAN * FAN)
    want = SAMPLE_PER_PART * min(parts, FAN)
    some = _sampled(rows, n, want).limit(2 * want).toPandas()["v"].tolist()
    if not some:
        return None
    top = fit_sample(_array(some), min(parts, FAN))
    if parts <= FAN:
        return Router(top, {})
    shared = rows.sparkSession.sparkContext.broadcast(Router(top, {}))

    def placed(batches):
        for b in batches:
            x = np.array(b.column("v").flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.homes(x).astype(np.int32)), b.column("v")], names=["part", "v"])

    fan = parts // FAN
    sample = _sampled(rows.where(F.size("v") == top.dim), n, SAMPLE_PER_PART * fan * top.parts).mapInArrow(placed, "part int, v array<double>")
    by_hash = Window.partitionBy("part").orderBy(F.xxhash64("v"))  # a part that holds a large share of the sample is cut to its own
    sample = sample.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= 4 * SAMPLE_PER_PART * fan).drop("n")

    def below(own: pa.Table) -> pa.Table:
        model = fit_sample(np.array(own["v"].combine_chunks().flatten()).reshape(own.num_rows, -1), fan)
        return pa.table({"part": pa.array([own["part"][0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    models = sample.groupBy("part").applyInArrow(below, "part int, model binary").collect()  # FAN rows at most
    return Router(top, {r.part: pickle.loads(r.model) for r in models})


def nearest(table: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of table where is_query holds, against all its rows."""
    spark = table.sparkSession
    small_batches(spark, 4096)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable("v") & F.col("vec_id").isNotNull())
    rows = staged(rows.groupBy("vec_id", "v").agg(F.max("asks").alias("asks")), "ann-rows")
    model = fit(rows, rows.count())
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(model)

    def place(batches):
        for b in batches:
            x = np.array(b.column("v").flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.homes(x).astype(np.int32))], names=["vec_id", "v", "asks", "part"])

    index = staged(rows.where(F.size("v") == model.top.dim).mapInArrow(place, "vec_id long, v array<double>, asks boolean, part int"), "ann-index")
    # one row a part: how many blocks its rows make, and how many ids it holds, each id counted in its first part alone
    counted = index.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("ids"))
    held = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    sizes = staged(held.join(counted, "part", "left").select("part", F.coalesce("ids", F.lit(0)).alias("ids"), "row_blocks"), "ann-parts")
    ids, filled = np.zeros(int(model.first[-1]), np.int64), np.zeros(int(model.first[-1]), bool)
    for r in sizes.collect():
        ids[r.part], filled[r.part] = r.ids, True

    def route(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                tried = shared.value.visits(np.array(some.column("v").flatten()).reshape(some.num_rows, -1), ids, k, filled)
                which = np.repeat(np.arange(some.num_rows), list(map(len, tried)))
                yield pa.RecordBatch.from_arrays([some.column("vec_id").take(pa.array(which)), some.column("v").take(pa.array(which)), pa.array(np.concatenate(tried).astype(np.int32))], names=["query_id", "q", "part"])

    asked = staged(index.where("asks").select("vec_id", "v").mapInArrow(route, "query_id long, q array<double>, part int"), "ann-asked")
    visits = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    plan = F.broadcast(sizes.drop("ids").join(visits, "part"))  # a row a part

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(key: str, v: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key, v), F.col(n)).cast("int")  # one id may have many vectors

    left = asked.join(plan, "part").select("part", spread("row_blocks").alias("rb"), own("query_id", "q", "query_blocks").alias("qb"), "query_id", "q")
    right = index.select("part", "vec_id", "v").join(plan, "part").select("part", own("vec_id", "v", "row_blocks").alias("rb"), spread("query_blocks").alias("qb"), "vec_id", "v")

    def score(ask: pa.Table, have: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if ask.num_rows and have.num_rows:
            dim = shared.value.top.dim
            q_id, ids = ask["query_id"].to_numpy(), have["vec_id"].to_numpy()
            q = ask["q"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            by_id = np.argsort(ids, kind="stable")
            v = have["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[by_id]
            ids, first = np.unique(ids[by_id], return_index=True)
            for i in range(0, len(q), 64):
                s = np.einsum("qd,cd->qc", q[i : i + 64], v)  # every pair is summed in one order, so equal vectors tie
                if len(ids) < len(v):
                    s = np.maximum.reduceat(s, first, axis=1)
                s[q_id[i : i + 64, None] == ids[None, :]] = -np.inf
                floor = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(s), -np.inf)
                r, c = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                order = np.lexsort((ids[c], -s[r, c], r))
                r, c = r[order], c[order]
                top = np.arange(len(r)) - np.searchsorted(r, r) < k
                found.append((q_id[i + r[top]], ids[c[top]], s[r[top], c[top]]))
        parts = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    by = ["part", "rb", "qb"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
