"""Near-duplicates by SetSketch: exponentially spaced, truncated minima in bands, joint likelihood, then full sets.

A document's set is its distinct k-word shingles (64-bit hashes of lower-cased words). Each of REGISTERS registers holds
floor(1 - log_b h) of the least exponential h over the set, truncated to 16 bits; registers of a union are the maxima of
registers. Documents with equal sets are one class from then on. Classes that agree in one band of BAND_ROWS registers
are candidates; the Jaccard similarity is estimated from how many registers are less, equal and greater, given both set
sizes, by maximum likelihood; what the estimate doesn't rule out is checked on the full sets, and links are components.

A band's bucket of up to ALL_PAIRS classes gives all pairs, a larger one only pairs with its centre, the class with the
least hash. Pairs inside a component need no check, so the most likely pair of every class is checked first. Large
buckets that still hold several components are joined to clusters where they share classes; in a cluster, classes outside
its main component are compared with all others in blocks: by sizes and registers first, and those that are still possible
by products of 0/1 matrices of full sets, of which only true links are put out. So no link between components is lost, a group of near copies of any size costs pairs in proportion to
it, and only classes that stay unlinked inside such a group meet all its members.

At a similarity of 0.8 two sets share no band with probability (1 - 0.8**4)**32 = 5e-8, and the estimate (standard error
0.035) rules a true link out with about 1e-6.

Null and empty texts and those without words have an empty set and are linked with nothing; texts of fewer than k words
are one shingle; repeated rows and copies share a class; very long texts are hashed whole; an empty table gives an
empty result. Rows of one id that have different texts are different members that answer to the same id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import heavy_values, join_dealt, join_heavy, small_batches, staged
from .components import components

REGISTERS, BAND_ROWS = 128, 4
BANDS = REGISTERS // BAND_ROWS
BASE_B, SCALE = 1.001, 32.0
ALL_PAIRS = 16
#: Classes in a block of those outside a cluster's main component, and of all of its classes.
ACROSS, ALONG = 256, 1024
#: Standard errors under the threshold at which an estimate still counts as possible.
MARGIN = 4.7

_RNG = np.random.default_rng(20201231)
_MUL = (_RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    word, begin, _ = spans.words(spans.LOWER[raw], at)
    base = np.uint64(spans.BASE)
    n = len(word)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        if n >= k:
            rolled = rolled * base + word[i : n - k + 1 + i]
    rolled = spans.mix(rolled)
    sets = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= k:
            x = np.sort(rolled[a : b - k + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            short = 0
            for w in word[a:b].tolist():
                short = (short * spans.BASE + w) & 0xFFFFFFFFFFFFFFFF
            sets.append(spans.mix(np.array([short ^ (b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(x: np.ndarray) -> np.ndarray:
    """SetSketch registers of a nonempty set of hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (x >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(low, (short[None, i : i + 2048] * _MUL + _ADD).min(axis=1), out=low)
    h = -np.log1p(-(low + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h / SCALE) / np.log(BASE_B)), 0, 65535).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers (rows) and set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x):  # the chance that one register is the greater, given the share x that only its set has
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE_B - 1) / BASE_B) / np.log(BASE_B), 1e-12, 1)

    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    found = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return grid[np.arange(len(grid)), found.argmax(1)]


def sketched(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, registers): set_id is a 128-bit digest of the set; both null for an empty set."""
    small_batches(docs.sparkSession)
    ready = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            n, ids, regs = [], [], []
            raw, at = spans.utf8(batch.column("text"))
            for _, _, block, offsets in spans.blocks(raw, at):
                for x in shingle_sets(block, offsets, k):
                    n.append(len(x))
                    ids.append(np.array([x.sum(), np.bitwise_xor.reduce(spans.mix(x + np.uint64(1)))], "<u8").tobytes() if len(x) else None)
                    regs.append(registers(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])

    return ready.mapInArrow(run, ready.select("doc_id").schema.add("n_shingles", "long").add("set_id", "binary").add("registers", "binary"))


def _candidates(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of a bucket: all of a small one, members with the centre of a large one."""
    small = members.where(F.col("size") <= ALL_PAIRS).select("band", "value", "node")
    pairs = small.alias("x").join(small.alias("y"), ["band", "value"]).where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    stars = members.where(F.col("size") > ALL_PAIRS).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def _two_sided(pairs: DataFrame, side, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """pairs(a, b, ...) joined with side("a") and side("b"); centres of very many pairs are dealt by their pairs."""
    return join_dealt(join_dealt(pairs, side("a"), "a", heavy, ["b"], how), side("b"), "b", heavy, ["a"], how)


def _estimated(pairs: DataFrame, classes: DataFrame, heavy: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b) whose sizes and estimate allow the threshold, with the estimate."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    both = _two_sided(pairs, side, heavy).where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(100 * threshold))

    def run(batches):
        for t in batches:
            if t.num_rows:
                r = [np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
                j = estimate(r[0], r[1], t.column("n_a").to_numpy(), t.column("n_b").to_numpy())
                keep = pa.array(j >= least)
                yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep), pa.array(j[j >= least])], names=["a", "b", "likely"])

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long, likely double")


def _confirmed(pairs: DataFrame, sets: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """Those pairs(a, b) whose full sets have 100 * intersection >= percent * union."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s_{s}"))
    both = _two_sided(pairs.select("a", "b"), side, heavy)

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("s_a"), t.column("s_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                z = np.sort(np.concatenate([x, y]))
                shared = int((z[1:] == z[:-1]).sum())
                keep.append(100 * shared >= percent * (len(z) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, names: DataFrame, heavy: DataFrame) -> DataFrame:
    """Those pairs(a, b, ...) that names(node, root) doesn't already hold together."""
    side = lambda s: names.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    named = _two_sided(pairs, side, heavy, "left")
    return named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the smallest id that links reach."""
    threshold = percent / 100
    sketches = staged(sketched(docs, k, key), "sketches")
    filled = sketches.where(F.col("set_id").isNotNull())
    of_set = [F.min("doc_id").cast("long").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")]
    sets_found = staged(filled.groupBy("set_id").agg(*of_set), "classes")
    classes = sets_found.where(F.col("node").isNotNull())

    width = 2 * BAND_ROWS
    rows = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "registers").select("node", "band", F.expr(f"substring(registers, band * {width} + 1, {width})").alias("value"))
    buckets = rows.groupBy("band", "value").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("c")).where("size > 1").select("band", "value", "size", F.col("c.node").alias("centre"))
    members = staged(join_heavy(rows, staged(buckets, "buckets"), ["band", "value"], "size", ["node"]), "members")

    candidates = staged(_candidates(members), "candidates")
    heavy = heavy_values(candidates, ["a", "b"])
    pairs = staged(_estimated(candidates, classes, heavy, threshold), "pairs")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.where(F.col("size") > ALL_PAIRS).select("node")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("node"), "text").join(involved, "node", "left_semi")
    sets = staged(_sets(texts, k).groupBy("node", "shingles").count().drop("count"), "sets")

    likeliest = F.max(F.struct("likely", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("p")
    best = staged(pairs.select("a", "b", "likely", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(likeliest).select("p.a", "p.b").distinct(), "best")
    links = staged(_confirmed(best, sets, heavy, percent), "links")
    names = components(links)
    rest = _apart(pairs.join(best, ["a", "b"], "left_anti"), names, heavy)
    links = links.unionByName(staged(_confirmed(rest, sets, heavy, percent), "links"))
    names = components(links)

    more = staged(_across(members, names, classes, sets, percent), "links")
    if not more.isEmpty():
        names = components(links.unionByName(more))

    roots = staged(names.groupBy("root").agg(F.min("node").alias("component_id"), F.count("*").alias("n")), "roots")
    smallest = join_heavy(names, roots, ["root"], "n", ["node"]).select("node", "component_id")
    of_class = staged(sets_found.select("set_id", "node", "copies").join(smallest, "node", "left").select("set_id", F.coalesce("component_id", "node").alias("component"), "copies"), "of-class")
    named = join_heavy(filled.select("doc_id", "n_shingles", "set_id"), of_class, ["set_id"], "copies", ["doc_id"]).select("doc_id", "n_shingles", "component")
    out = named.unionByName(sketches.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", F.col("doc_id").cast("long"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(members: DataFrame, names: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of large buckets: the exact way for what the centres left open."""
    large = members.where(F.col("size") > ALL_PAIRS).join(names, "node", "left").select("band", "value", "centre", "node", F.coalesce("root", "node").alias("root"))
    ends = large.groupBy("band", "value").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"))
    open_buckets = staged(ends.where("r0 != r1").select("band", "value", "n"), "open-buckets")
    mixed = staged(join_heavy(large, open_buckets, ["band", "value"], "n", ["node"]).select("node", "root", "centre").distinct(), "open")
    clusters = components(mixed.select(F.col("node").alias("a"), F.col("centre").alias("b"))).withColumnRenamed("root", "cluster")
    rooted = staged(mixed.select("node", "root").distinct().join(clusters, "node"), "open")
    count = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    plan = staged(count.select("cluster", F.col("main.root").alias("main"), "n", F.ceil((F.col("n") - F.col("main.n")) / ACROSS).alias("xs"), F.ceil(F.col("n") / ALONG).alias("ys")), "plan")
    every = join_heavy(rooted, plan, ["cluster"], "n", ["node"]).join(classes, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seen = ["node", "root", "n_shingles", "registers"]
    x = every.where("root != main").select("cluster", own("xs").alias("i"), spread("ys").alias("j"), *seen)
    y = every.select(F.col("cluster").alias("cluster"), spread("xs").alias("i"), own("ys").alias("j"), *[F.col(c).alias(c) for c in seen])
    threshold = percent / 100
    least = int(np.floor(REGISTERS * (threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5)))

    def screen(left: pa.Table, right: pa.Table) -> pa.Table:
        """The classes of a block with a partner that sizes and equal registers allow."""
        (a, root_a, n_a, x), (b, root_b, n_b, y) = [
            (t["node"].to_numpy(), t["root"].to_numpy(), t["n_shingles"].to_numpy(), np.frombuffer(b"".join(t["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS)) for t in (left, right)
        ]
        possible = (root_a[:, None] != root_b[None, :]) & (100 * np.minimum(n_a[:, None], n_b[None, :]) >= percent * np.maximum(n_a[:, None], n_b[None, :]))
        for i in range(0, len(a), 16):
            possible[i : i + 16] &= (x[i : i + 16, None, :] == y[None, :, :]).sum(axis=2) >= least
        in_a, in_b = possible.any(axis=1), possible.any(axis=0)
        node, root = np.concatenate([a[in_a], b[in_b]]), np.concatenate([root_a[in_a], root_b[in_b]])
        block = [pa.array(np.full(len(node), (left if len(a) else right)[c][0].as_py() if len(node) else 0, np.int64)) for c in by]
        return pa.table([*block, pa.array(node), pa.array(root), pa.array(np.arange(len(node)) < in_a.sum())], names=[*by, "node", "root", "first"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [(t["node"].to_numpy(), t["root"].to_numpy(), [np.frombuffer(s.as_buffer(), "<u8") for c in t["shingles"].chunks for s in c]) for t in (left, right)]
        (a, root_a, x), (b, root_b, y) = sides
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        known = np.unique(np.concatenate(x))
        shared = np.zeros((len(x), len(y)), np.float32)
        places = []
        for rows in (x, y):
            flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat
            order = np.argsort(at[hit], kind="stable")
            places.append((at[hit][order], owner[hit][order]))
        for first in range(0, len(known), 4096):
            tables = []
            for (at, owner), rows in zip(places, (x, y)):
                i, j = np.searchsorted(at, [first, first + 4096])
                table = np.zeros((len(rows), 4096), np.float32)
                table[owner[i:j], at[i:j] - first] = 1
                tables.append(table)
            shared += tables[0] @ tables[1].T
        union = np.array([len(r) for r in x])[:, None] + np.array([len(r) for r in y])[None, :] - shared
        i, j = np.nonzero((100 * shared >= percent * union) & (root_a[:, None] != root_b[None, :]))
        return pa.table({"a": pa.array(a[i]), "b": pa.array(b[j])})

    by = ["cluster", "i", "j"]
    screened = x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(screen, "cluster long, i long, j long, node long, root long, first boolean")
    full = staged(screened, "screened").join(sets, "node")
    x, y = full.where("first"), full.where("NOT first").select(*[F.col(c).alias(c) for c in full.columns])
    return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(compare, "a long, b long")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, at = spans.utf8(batch.column("text"))
            found = [x.astype("<u8").tobytes() for _, _, block, offsets in spans.blocks(raw, at) for x in shingle_sets(block, offsets, k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")
