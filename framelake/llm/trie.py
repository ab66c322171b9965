"""The prefix trie of conversations: balanced parentheses in shards of sorted conversations, shared spines merged.

A node is a distinct sequence of first turns, known by two 64-bit xors of a hash of each turn's SHA-256 digest and place.
Equal conversations are one class. Only nodes that several classes share need a tree: each class brings its path as far
as it is shared and one node more; below that it is a chain whose values follow from running sums, so a conversation of
any length is rows, never one value. Paths are sorted and cut into shards. A shard writes its trie as parentheses, in
preorder; blocks with their least excess (a tree of minima above them) find the closing of a node, leaf pairs counted
before a place give the leaves of a subtree, cumulative arrays its members and savings. The first and the last path of a
shard may go on in its neighbours: these spines go, with what hangs from them, to one more trie (two paths a shard).

Turns are in order of their number, null first; turns of one number by the digest of role and text. Null roles and texts
are empty; rows without a conversation id belong to no conversation and are left out; repeated rows are turns of their
own; a very long text counts by its digest and size; an empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running
from .common import join_heavy, staged

#: Nodes of a shard, about.
SHARD_NODES = 50_000
#: Conversation ids that one piece of a member list covers.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A sequence of parentheses (1 opens, 0 closes) with the least excess of blocks, of pairs of blocks, and so on."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        n = 1 << max(0, int(np.ceil(np.log2(max(1, -(-len(bits) // self.BLOCK))))))
        padded = np.full(n * self.BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(n, self.BLOCK)
        self.least = [self.blocks.min(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place after `after` in each block with an excess of target at most; -1 if there is none."""
        found = np.full(len(block), -1)
        for k in range(0, len(block), 1 << 16):
            s = slice(k, k + (1 << 16))
            at = block[s, None] * self.BLOCK + np.arange(self.BLOCK)
            low = (self.blocks[block[s]] <= target[s, None]) & (at > after[s, None])
            found[s] = np.where(low.any(1), at[:, 0] + low.argmax(1), -1)
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first place after it whose excess is one less."""
        target = self.excess[at] - 1
        found = self._in_block(at // self.BLOCK, at, target)
        far = np.flatnonzero(found < 0)
        node, want = at[far] // self.BLOCK, target[far]
        level = np.full(len(far), -1)
        for up, least in enumerate(self.least[:-1]):  # up, until a right neighbour goes low enough
            right = np.minimum(node + 1, len(least) - 1)
            hit = (level < 0) & (node % 2 == 0) & (least[right] <= want)
            node, level = np.where(hit, right, node), np.where(hit, up, level)
            node = np.where(level < 0, node // 2, node)
        for down in range(len(self.least) - 2, 0, -1):  # and down to its first block that does
            left = self.least[down - 1][np.minimum(2 * node, len(self.least[down - 1]) - 1)] <= want
            node = np.where(level == down, 2 * node + ~left, node)
            level = np.where(level == down, down - 1, level)
        found[far] = self._in_block(node, at[far], want)
        return found


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[start:end], by minima over powers of two."""
    tables, span = [values], end - start
    while 2 << len(tables) - 1 <= len(values):
        t, half = tables[-1], 1 << len(tables) - 1
        tables.append(np.minimum(t[:-half], t[half:]))
    out, level = np.empty(len(start), values.dtype), np.log2(span).astype(int)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(tables[k][start[own]], tables[k][end[own] - (1 << k)])
    return out


HANG = ["convs", "children", "leaves", "saved"]


class Shard:
    """Tries of sorted, different paths that all begin at the root.

    size: nodes of each path; p1, p2, bytes: of all nodes, path after path; hang: what hangs from each besides the
    paths (members, children, leaves, savings), first: its least member.
    """

    def __init__(self, size: np.ndarray, p1: np.ndarray, p2: np.ndarray, weight: np.ndarray, hang: dict[str, np.ndarray], first: np.ndarray):
        start = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        depth = np.arange(len(row)) - start[row]
        before = np.where((row > 0) & (depth < size[row - 1]), start[row - 1] + depth, -1)
        new = (before < 0) | (p1 != p1[before]) | (p2 != p2[before])
        # every element's node: the last new one of its depth
        by_depth = np.lexsort((row, depth))
        place = np.cumsum(new) - 1
        latest = np.maximum.accumulate(np.where(new[by_depth], np.arange(len(row)), 0))
        self.node = np.empty(len(row), np.int64)
        self.node[by_depth] = place[by_depth[latest]]
        self.row, self.depth, self.p1, self.p2, self.bytes = row[new], depth[new], p1[new], p2[new], weight[new]
        n = len(self.depth)
        self.hang = {c: np.zeros(n, np.int64) for c in HANG}
        for c in HANG:
            np.add.at(self.hang[c], self.node, hang[c])
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, self.node, first)

        shared = np.bincount(row[~new], minlength=len(size))
        closes = np.append(np.concatenate([[0], size[:-1]]) - shared, size[-1])
        moves = np.stack([closes[:-1], size - shared], 1).ravel()
        bits = np.repeat(np.append(np.tile([0, 1], len(size)), 0), np.append(moves, closes[-1])).astype(np.uint8)
        tree = Parentheses(bits)
        opens = tree.opens()
        close = tree.find_close(opens)
        here, end = np.arange(n), np.arange(n) + (close - opens + 1) // 2

        def summed(x: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(x)])
            return upto[end] - upto[here]

        order = np.lexsort((here, self.depth))
        ranked = self.depth[order] * n + here[order]
        self.parent = order[np.maximum(np.searchsorted(ranked, (self.depth - 1) * n + here) - 1, 0)]
        self.parent[0] = -1
        self.children = np.bincount(self.parent[1:], minlength=n) + self.hang["children"]
        leaf = (bits[np.minimum(opens + 1, len(bits) - 1)] == 0) & (self.hang["children"] == 0)  # a pair: nothing between
        self.convs = summed(self.hang["convs"])
        self.leaves = summed(leaf + self.hang["leaves"])
        self.saved = summed((self.convs - 1) * self.bytes + self.hang["saved"])
        self.first = _least(least, here, end)
        self.least = least


NODE = "p1 long, p2 long, conv_id long, depth long, parent1 long, parent2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
SPINE = "shard int, side int, bytes long, h_convs long, h_children long, h_leaves long, h_saved long"


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _nodes(s: Shard, own: np.ndarray) -> dict[str, np.ndarray]:
    up = s.parent[own]
    return {
        "p1": s.p1[own], "p2": s.p2[own], "conv_id": s.first[own], "depth": s.depth[own], "parent1": s.p1[up], "parent2": s.p2[up],
        "n_convs": s.convs[own], "n_children": s.children[own], "n_leaves": s.leaves[own], "saved_tokens": s.saved[own],
    }


def _shard(batches):
    """Sorted classes of a shard -> its nodes; spines (side 0 or 1) carry what hangs from them beside the spines."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables).combine_chunks()
    paths = rows.column("path").combine_chunks()
    flat = paths.flatten()
    size = np.diff(np.asarray(paths.offsets)) + 1  # and the root
    n, ends = int(size.sum()), np.cumsum(size) - 1
    inner = np.ones(n, bool)
    inner[np.cumsum(size) - size] = False
    at = {c: np.zeros(n, np.int64) for c in ("p1", "p2", "bytes")}
    for c in at:
        at[c][inner] = np.asarray(flat.field(c))
    m, conv, length, total = (rows.column(c).to_numpy() for c in ("m", "conv_id", "length", "total"))
    goes_on = (length > size - 1).astype(np.int64)
    upto = np.cumsum(at["bytes"])
    above = upto[ends] - upto[np.cumsum(size) - size]
    hang = {c: np.zeros(n, np.int64) for c in HANG}
    first = np.full(n, np.iinfo(np.int64).max)
    for c, v in zip(HANG, (m, goes_on, goes_on, (m - 1) * (total - above))):
        hang[c][ends] = v
    first[ends] = conv
    s = Shard(size, at["p1"], at["p2"], at["bytes"], hang, first)

    spine = np.full(len(s.depth), -1)
    spine[s.node[n - size[-1] :]] = 1
    spine[s.node[: size[0]]] = 0
    own = np.flatnonzero(spine < 0)
    # what hangs from spines
    edge = own[spine[s.parent[own]] >= 0] if len(own) else own
    for c, v in zip(HANG, (s.convs[edge], 1, s.leaves[edge], s.saved[edge])):
        np.add.at(s.hang[c], s.parent[edge], v)
    np.minimum.at(s.least, s.parent[edge], s.first[edge])
    inside = _nodes(s, own)
    # parents inside the shard are known; others are looked up
    known = spine[s.parent[own]] < 0 if len(own) else np.zeros(0, bool)
    shard = int(rows.column("shard")[0].as_py())
    none = pa.nulls(len(own), pa.int64())
    yield _table(
        **{**inside, "parent_conv_id": pa.array(s.first[s.parent[own]], mask=~known)},
        shard=pa.nulls(len(own), pa.int32()), side=pa.nulls(len(own), pa.int32()), bytes=none, h_convs=none, h_children=none, h_leaves=none, h_saved=none,
    ).select(ROW)
    # both paths whole, so that they are paths again; a node of both counts in the first
    for side, path in enumerate((s.node[: size[0]], s.node[n - size[-1] :])):
        counts = spine[path] == side
        none = pa.nulls(len(path), pa.int64())
        far = np.iinfo(np.int64).max
        yield _table(
            p1=s.p1[path], p2=s.p2[path], conv_id=np.where(counts, s.least[path], far), depth=s.depth[path], parent1=none, parent2=none, parent_conv_id=none, n_convs=none, n_children=none, n_leaves=none, saved_tokens=none,
            shard=np.full(len(path), shard, np.int32), side=np.full(len(path), side, np.int32), bytes=s.bytes[path], **{f"h_{c}": np.where(counts, s.hang[c][path], 0) for c in HANG},
        ).select(ROW)


ROW = [f.split()[0] for f in f"{NODE}, {SPINE}".split(", ")]


def _merged(batches):
    """All spines, in order of shard, side and depth -> their nodes."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    col = {c: rows.column(c).to_numpy() for c in ("p1", "p2", "conv_id", "depth", "bytes", *[f"h_{c}" for c in HANG])}
    begin = np.flatnonzero(col["depth"] == 0)
    size = np.diff(np.append(begin, len(col["depth"])))
    s = Shard(size, col["p1"], col["p2"], col["bytes"], {c: col[f"h_{c}"] for c in HANG}, col["conv_id"])
    own = np.arange(len(s.depth))
    found = _nodes(s, own)
    top = own == 0
    for c in ("parent1", "parent2"):
        found[c] = pa.array(found[c], mask=top)
    found["parent_conv_id"] = pa.array(s.first[s.parent], mask=top)
    yield _table(**found).select([f.split()[0] for f in NODE.split(", ")])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes), without texts: the digest tells (role, text) apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    known = conversations.where(F.col("conv_id").isNotNull())
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(numbered: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, digest, bytes, length) of the rebuilt conversations, (conv_id, length) of them all).

    Conversation c starts with the first h turns of conversation c - c % group, h = crc32 of its id modulo `most`, and goes
    on with its own turns from the h-th on. numbered(conv_id, i, digest, bytes): a written table.
    """
    sizes = staged(numbered.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-sizes")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = sizes.withColumn("h", h).withColumn("donor", F.col("conv_id") - F.col("conv_id") % group)
    given = own.join(sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("there")), "donor", "left").withColumn("take", F.least("h", F.coalesce("there", F.lit(0))).cast("long"))
    convs = staged(given.select("conv_id", "donor", "n", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    # a donor has fewer than `most` such turns and at most `group` takers
    lent = numbered.where(F.col("i") < most - 1).withColumnRenamed("conv_id", "donor")
    heads = convs.where("take > 0").select("conv_id", "donor", "take", "length").join(lent, "donor").where("i < take").select("conv_id", F.col("i").alias("pos"), "digest", "bytes", "length")
    kept = join_heavy(numbered, convs.select("conv_id", "h", "take", "n", "length"), ["conv_id"], "n", ["i"]).where("i >= h")
    tails = kept.select("conv_id", (F.col("take") + F.col("i") - F.col("h")).alias("pos"), "digest", "bytes", "length")
    return heads.unionByName(tails), convs.select("conv_id", "length")


def _members(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): digest of each class's ids in order. Pieces of at most PIECE ids are joined first, so that a class that
    holds most conversations sends few rows to the task that digests it, which keeps none of them."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("p1", "p2", F.floor(F.col("conv_id") / F.lit(PIECE)).alias("at")).agg(piece.alias("ids"))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            found = []
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids"))):
                if (p1, p2) != key:
                    if key:
                        found.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if found:
                yield _table(**dict(zip(("p1", "p2", "ends_sha256"), zip(*found))))
        if key:
            yield _table(p1=[key[0]], p2=[key[1]], ends_sha256=[state.hexdigest()])

    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "at").select("p1", "p2", "ids").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def _paths(steps: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of each class's path with how far it is shared, the classes, and the digests of their members."""
    hashed = steps.withColumns({"p1": F.xxhash64("pos", "digest"), "p2": F.xxhash64("digest", "pos"), "upto": F.col("bytes")}).drop("digest")
    path = running(hashed, ["conv_id"], ["pos"], sums=["upto"], xors=["p1", "p2"])
    last = path.where(F.col("pos") + 1 == F.col("length")).select("conv_id", "p1", "p2", "length", F.col("upto").alias("total"))
    turnless = convs.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "length", "total")])
    ends = staged(last.unionByName(turnless), "trie-ends")
    classes = staged(ends.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("m"), F.min("length").alias("length"), F.min("total").alias("total")), "trie-classes").drop("p1", "p2")
    own = staged(join_heavy(path.drop("length"), classes, ["conv_id"], "length", ["pos"]), "trie-paths")
    shared = staged(own.groupBy("p1", "p2").agg(F.count("*").alias("k")).where("k > 1"), "trie-shared")
    far = join_heavy(own.select("conv_id", "pos", "p1", "p2"), shared, ["p1", "p2"], "k", ["conv_id"]).groupBy("conv_id").agg((F.max("pos") + 1).alias("far"))
    reach = staged(classes.join(far, "conv_id", "left").select("conv_id", "length", F.coalesce("far", F.lit(0)).alias("shared")), "trie-reach")
    nodes = staged(join_heavy(own.drop("length"), reach, ["conv_id"], "length", ["pos"]), "trie-nodes")
    return nodes, classes, _members(ends.select("conv_id", "p1", "p2"))


def trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    steps(conv_id, pos, digest, bytes, length): turns from place 0 on; convs(conv_id, length): every conversation, those
    without turns too. Each distinct sequence of first turns is a node, from the root on. conv_id is the least member,
    n_convs the members, saved_tokens the sum of (members - 1) * bytes over the subtree.
    """
    nodes, classes, members = _paths(steps, convs)
    element = F.struct("pos", "p1", "p2", "bytes")
    tops = nodes.where(F.col("pos") <= F.col("shared")).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(element)), lambda e: F.struct(e["p1"].alias("p1"), e["p2"].alias("p2"), e["bytes"].alias("bytes"))).alias("path"))
    empty = F.from_json(F.lit("[]"), "array<struct<p1: bigint, p2: bigint, bytes: bigint>>")
    rows = staged(classes.join(tops, "conv_id", "left").withColumn("path", F.coalesce("path", empty)), "trie-tops")
    shards = 1 + int(rows.agg(F.sum(F.size("path") + 1)).first()[0] or 0) // SHARD_NODES
    dealt = rows.repartitionByRange(shards, "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id())
    made = staged(dealt.mapInArrow(_shard, f"{NODE}, {SPINE}"), "trie-shards")
    names = [f.split()[0] for f in NODE.split(", ")]
    # two paths a shard
    spines = staged(made.where("side IS NOT NULL").coalesce(1).sortWithinPartitions("shard", "side", "depth").mapInArrow(_merged, NODE), "trie-spines")
    inner = made.where("side IS NULL").select(*names)
    told = inner.where("parent_conv_id IS NOT NULL")
    parents = spines.select(F.col("p1").alias("parent1"), F.col("p2").alias("parent2"), F.col("conv_id").alias("of"), "n_children")
    found = join_heavy(inner.where("parent_conv_id IS NULL").drop("parent_conv_id"), parents.withColumnRenamed("n_children", "__k"), ["parent1", "parent2"], "__k", ["p1"])
    branched = told.unionByName(found.withColumn("parent_conv_id", F.col("of")).drop("of", "__k")).unionByName(spines)
    one = F.lit(1).cast("long")
    chains = nodes.where(F.col("pos") > F.col("shared")).select(
        "p1", "p2", "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("pos") + 1 < F.col("length")).cast("long").alias("n_children"),
        one.alias("n_leaves"), ((F.col("m") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
    )
    every = branched.drop("parent1", "parent2").unionByName(chains)
    out = every.join(members, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations."""
    numbered = running(turns(conversations), ["conv_id"], ["turn", "digest"], number="i").drop("turn")
    return trie(*rebuilt(numbered, group, most))


#: CRC-32 by its table; a node's key is the digests of its turns, so subtrees are keys with its key as prefix.
ORACLE_SQL = r"""
WITH b AS (SELECT unnest(range(256)) AS b),
k AS (SELECT list(list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS tab FROM b),
t AS (SELECT conv_id, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS d, octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, d, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) AS BIGINT) % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), k),
r AS (SELECT c.conv_id, 0 AS part, o.i, d, bytes FROM c JOIN o ON o.conv_id = c.donor AND o.i < c.h
  UNION ALL SELECT c.conv_id, 1, o.i, d, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h),
s AS (SELECT conv_id, d, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM r),
p AS (SELECT conv_id, depth, bytes, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (SELECT key, depth, any_value(bytes) AS bytes, min(p.conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE depth = last), '') AS ends
  FROM p JOIN e ON p.conv_id = e.conv_id GROUP BY key, depth),
q AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND left(m.key, length(m.key) - 64) = n.key) AS n_children FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = left(n.key, greatest(length(n.key) - 64, 0)))
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM q a JOIN q b ON b.depth >= a.depth AND starts_with(b.key, a.key) GROUP BY a.key, a.depth, a.conv_id, a.parent_conv_id, a.n_convs, a.n_children, a.ends
"""
