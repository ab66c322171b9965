"""Exact dedup with an index of cuckoo filters: texts are equal if they are the same once runs of whitespace are one space.

The index deals SHA-256 digests of normalised texts to buckets. A bucket has a cuckoo filter (16-bit fingerprints, four
slots a place) of its live digests. A batch of documents is first made one row a digest inside each reading task, then
over all tasks, and its digests meet the filters: a miss is certainly new; a hit is looked up in the stored keys and its
text is compared with the stored text, which lies in a table that Spark buckets by digest, so stored texts are never
shuffled. Live digests only add to their group; new ones enter the filter. Where a filter overflows, a larger one is made
from the bucket's stored keys. Deleted digests leave filter and keys; the same text may come again later as a new one.

Every update writes new tables of keys and filters and adds to the content, so a lost executor costs a task and a failed
update leaves the version before it as it is. Null texts are empty texts; very long texts are taken whole; null ids are
greater than all others; of equal rows one stays; an empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_heavy, scratch, staged, text_of
from .spans import mix

SLOTS = 4
#: Moves of fingerprints before a filter counts as full.
KICKS = 500
#: Share of slots that a new filter fills at most.
LOAD = 0.85
#: Digests of a bucket, about, once there are more than LEAST_BUCKETS times as many.
BUCKET_KEYS, LEAST_BUCKETS = 200_000, 32


class CuckooFilter:
    """Places of four fingerprints; a key has two, either found from the other and the fingerprint. Keys are random 64-bit words."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))), SLOTS), np.uint16))

    @classmethod
    def built(cls, keys: np.ndarray, least: int = 0) -> CuckooFilter:
        """A filter of the keys, doubled until they fit."""
        made = cls.of_size(max(len(keys), least))
        while not made.insert(keys):
            made = cls(np.zeros((2 * len(made.table), SLOTS), np.uint16))
        return made

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return prints, (keys & self.mask).astype(np.int64)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return place ^ (mix(prints.astype(np.uint64)) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, place = self._places(keys)
        near, far = self.table[place], self.table[self._other(place, prints)]
        return (near == prints[:, None]).any(1) | (far == prints[:, None]).any(1)

    def _settle(self, prints: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots of its place; returns the numbers of the rest."""
        order = np.argsort(place, kind="stable")
        p = place[order]
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        free = self.table[p] == 0
        fits = rank < free.sum(1)
        slot = (np.cumsum(free, 1) == rank[:, None] + 1).argmax(1)
        self.table[p[fits], slot[fits]] = prints[order[fits]]
        return order[~fits]

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; False if the filter overflows, which leaves it incomplete."""
        prints, place = self._places(keys)
        chance = np.random.default_rng(len(keys))
        left = self._settle(prints, place)
        prints, place = prints[left], self._other(place[left], prints[left])
        for _ in range(KICKS):
            left = self._settle(prints, place)
            prints, place = prints[left], place[left]
            if not len(prints):
                return True
            # one of each full place takes a random slot, whose fingerprint goes to its other place; the rest wait
            _, first = np.unique(place, return_index=True)
            slot = chance.integers(0, SLOTS, len(first))
            at = place[first]
            out = self.table[at, slot]
            self.table[at, slot] = prints[first]
            prints[first], place[first] = out, self._other(at, out)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes one fingerprint of each key; the keys have to be in the filter."""
        for p, a, b in zip(*(x.tolist() for x in (*self._places(keys), self._other(*self._places(keys)[::-1])))):
            for place in (a, b):
                own = np.flatnonzero(self.table[place] == p)
                if len(own):
                    self.table[place, own[0]] = 0
                    break


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The filter's 64-bit words of SHA-256 digests."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)[:, 1].copy()


def _stored(filters: pa.Table) -> CuckooFilter | None:
    if not filters.num_rows:
        return None
    return CuckooFilter(np.frombuffer(filters.column("table")[0].as_py(), np.uint16).reshape(-1, SLOTS).copy())


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: An id as a value whose least is the smallest id; null is greater than all.
REF = "struct<none: boolean, id: {}>"


def ref_of(key: str) -> Column:
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"))


def _order(ref: dict) -> tuple:
    return (True,) if ref["none"] else (False, ref["id"])


def _one_a_digest(batches):
    """Rows of a task, one a digest: the first goes on with its text; what later ones add follows at the end, without text.

    A task holds the digests of its split.
    """
    seen: dict[bytes, list] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        first = []
        for i, (digest, ref) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("ref").to_pylist())):
            if digest not in seen:
                seen[digest] = [0, None]
                first.append(i)
            else:
                own = seen[digest]
                own[0] += 1
                own[1] = ref if own[1] is None else min(own[1], ref, key=_order)
        yield batch.take(pa.array(first, pa.int64()))
    more = [(d, n, ref) for d, (n, ref) in seen.items() if n]
    for k in range(0, len(more), 10_000):
        digest, n, ref = zip(*more[k : k + 10_000])
        columns = {"digest": digest, "n": n, "ref": ref, "text": [None] * len(n)}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class CuckooIndex:
    """An index in the folder `path` of the shared storage; `version` is the last whole update (-1: none yet)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, key_type: str = "bigint", version: int = -1):
        self.spark, self.path, self.buckets, self.version = spark, path, buckets, version
        self.key_type = key_type
        self.table = f"cuckoo_content_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, ref {REF.format(key_type)}, n BIGINT, text STRING, step INT) "
            f"USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/content'"
        )
        # an update that failed may have left content of its step
        self.step = version if version < 0 else self.content().agg(F.max("step")).first()[0]

    def _bucket(self) -> Column:
        return F.pmod(F.hash("digest"), F.lit(self.buckets)).alias("bucket")

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={self.version}")

    def keys(self) -> DataFrame:
        """(digest, ref, n, step) of the live digests: least id, rows, and the update whose content holds the text."""
        return self._read("keys", f"digest binary, ref {REF.format(self.key_type)}, n long, step int")

    def filters(self) -> DataFrame:
        return self._read("filters", "bucket int, table binary")

    def content(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def _added(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """The batch as content of the next step: (digest, ref, n, text, step), a row a digest."""
        self.step += 1
        rows = docs.select(ref_of(key).alias("ref"), F.lit(1).cast("long").alias("n"), normalised(text).alias("text")).withColumn("digest", digest_of(F.col("text")))
        fewer = rows.mapInArrow(_one_a_digest, f"ref {REF.format(self.key_type)}, n long, text string, digest binary")
        # as many partitions as buckets, by the function of both: a task writes one bucket's file
        groups = fewer.repartition(self.buckets, "digest").groupBy("digest").agg(F.min("ref").alias("ref"), F.sum("n").alias("n"), F.first("text", ignorenulls=True).alias("text"))
        groups.select("digest", "ref", "n", "text", F.lit(self.step).alias("step")).write.insertInto(self.table)
        return self.content().where(F.col("step") == self.step)

    def _hits(self, digests: DataFrame) -> DataFrame:
        """digests that their bucket's filter may hold."""

        def test(_, rows: pa.Table, filters: pa.Table) -> pa.Table:
            found = _stored(filters)
            rows = rows.select(["digest"])
            return rows.filter(pa.array(found.contains(_keys(rows.column("digest"))))) if found and rows.num_rows else rows.slice(0, 0)

        own = digests.select("digest", self._bucket())
        return own.groupBy("bucket").cogroup(self.filters().groupBy("bucket")).applyInArrow(test, "digest binary")

    def _live(self, batch: DataFrame) -> DataFrame:
        """(digest) of the batch's content that the index holds: filter hits whose stored text is the same text."""
        if self.version < 0:
            return self.spark.createDataFrame([], "digest binary")
        known = staged(self._hits(batch).join(self.keys().select("digest", F.col("step").alias("held")), "digest"), "cuckoo-hits")
        few = known.hint("shuffle_hash")  # the small side; texts stay where their buckets are
        # the difference instead of an equality: the join stays one on the digest, by which both sides are bucketed
        old = self.content().where(F.col("step") < self.step).join(few, "digest").where("step - held = 0").select("digest", F.col("text").alias("old"))
        new = batch.join(few, "digest", "left_semi").select("digest", "text")
        differ = F.raise_error("two texts have one SHA-256 digest")
        return staged(new.join(old, "digest").select("digest", F.when(F.col("text") == F.col("old"), F.lit(True)).otherwise(differ).alias("same")), "cuckoo-live").where("same").select("digest")

    def _replaced(self, keys: DataFrame, came: DataFrame, went: DataFrame) -> None:
        """The next version: its keys, and filters with the digests that came and without those that went."""
        at = self.step
        keys.write.option("compression", "zstd").parquet(f"{self.path}/keys/version={at}")
        keys = self.spark.read.schema(keys.schema).parquet(f"{self.path}/keys/version={at}")
        change = came.select("digest", F.lit(True).alias("came")).unionByName(went.select("digest", F.lit(False).alias("came")))

        def update(group: tuple, rows: pa.Table, filters: pa.Table) -> pa.Table:
            entered = np.asarray(rows.column("came").to_pylist(), bool)
            new, gone = (_keys(rows.filter(pa.array(own)).column("digest")) for own in (entered, ~entered))
            found = _stored(filters)
            if found is None:
                found = CuckooFilter.built(new)
            else:
                found.delete(gone)
                found = found if found.insert(new) else None
            return pa.table({"bucket": pa.array([group[0].as_py()], pa.int32()), "table": pa.array([found.table.tobytes() if found else None], pa.binary())})

        def resized(group: tuple, rows: pa.Table) -> pa.Table:
            made = CuckooFilter.built(_keys(rows.column("digest")), 2 * rows.num_rows)
            return pa.table({"bucket": pa.array([group[0].as_py()], pa.int32()), "table": pa.array([made.table.tobytes()], pa.binary())})

        kind = "bucket int, table binary"
        made = staged(change.select("digest", "came", self._bucket()).groupBy("bucket").cogroup(self.filters().groupBy("bucket")).applyInArrow(update, kind), "cuckoo-filters")
        full = made.where(F.col("table").isNull()).select("bucket")  # at most a row a bucket
        again = keys.select("digest", self._bucket()).join(full, "bucket", "left_semi").groupBy("bucket").applyInArrow(resized, kind)
        made.where(F.col("table").isNotNull()).unionByName(again).write.parquet(f"{self.path}/filters/version={at}")
        self.version = at

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds a batch of documents: known texts to their group, new ones as new digests."""
        batch = self._added(docs, key, text)
        live = self._live(batch).withColumn("live", F.lit(True))
        marked = batch.select("digest", "ref", "n").join(live, "digest", "left")
        new = staged(marked.where(F.col("live").isNull()).select("digest", "ref", "n", F.lit(self.step).alias("step")), "cuckoo-new")
        more = marked.where("live").select("digest", F.col("ref").alias("ref2"), F.col("n").alias("n2"))
        grown = self.keys().join(more, "digest", "left").select("digest", F.least("ref", "ref2").alias("ref"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), "step")
        self._replaced(grown.unionByName(new), new, new.where("false"))

    def delete(self, docs: DataFrame, text: str = "text") -> None:
        """Takes the texts of docs out of the index, with all their copies; texts that it doesn't hold are passed over."""
        gone = self._live(self._added(docs.withColumn("__none", F.lit(None).cast(self.key_type)), "__none", text))
        self._replaced(self.keys().join(gone, "digest", "left_anti"), gone.where("false"), gone)


def groups(docs: DataFrame, batches: int = 2, key: str = "doc_id", text: str = "text") -> CuckooIndex:
    """A new index of all docs, taken in batches by a hash of the id."""
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    index = CuckooIndex(spark, scratch(spark, "cuckoo"), LEAST_BUCKETS + docs.count() // BUCKET_KEYS, kind)
    for k in range(batches):
        index.insert(docs.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k), key, text)
    return index


def deduplicated(docs: DataFrame, batches: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; of rows that repeat the least id of their text one stays."""
    index = groups(docs.select(key, text), batches, key, text)
    rows = staged(docs.select(F.col(key).alias("doc_id"), digest_of(normalised(text)).alias("digest")).withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")
    keys = index.keys().select("digest", F.col("ref.id").alias("keep_id"), F.col("n").alias("group_size"))
    out = join_heavy(rows, keys, ["digest"], "group_size", ["__row"])
    least = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = staged(out.withColumn("least", least), "dedup-groups")
    # the rows of a digest's least id are nearly always one; a repeated one is settled by the row number
    first = staged(out.where("least").groupBy("digest").agg(F.min("__row").alias("first"), F.count("*").alias("times")), "dedup-first")
    settled = join_heavy(out.where("least"), first, ["digest"], "times", ["__row"]).select("doc_id", "keep_id", "group_size", (F.col("__row") == F.col("first")).alias("kept"), "digest")
    rest = out.where("NOT least").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    return settled.unionByName(rest).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
