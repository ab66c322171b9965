"""Removal of repeated byte strings with a logarithmic family of suffix arrays, sharded by content.

A suffix of a document, cut to `length` bytes, is a window. Each window names an anchor: the rightmost least hash among
its GRAM-byte grams, so equal windows name equal anchors at equal places in them. Consecutive windows with one anchor are
a run; a document has about one run per 35 bytes, and windows can only be equal if their runs have the same key (the hash
of the anchor's gram). Hence

1. runs whose key occurs once are dropped (one aggregation of keys, one join);
2. of runs that are equal as a whole, by a 128-bit digest of all bytes they cover, all but the first are repeated as a
   whole (aggregated by digest, joined back);
3. the first runs of keys with several different ones go, as short texts, to the shard of their key. A shard takes them in
   order of document and start, batch by batch: a batch gets a suffix array (offsets into the shard's text, sorted), which
   is merge-scanned against the arrays of the levels that exist, and becomes a level of its own; levels of like size
   merge, so there are logarithmically many. A window found in a level, or earlier in its batch, is repeated.

There are as many shards as the windows counted need, SHARD_WINDOWS each. Keys with very many different runs (the borders
of a passage that a large share of all documents has) would fill a shard with copies of few windows: the digests of their
windows are taken instead, in the same kind of family. A task that reads documents in order finds what it saw before, and
only the first windows of each task are dealt to the shards, by digest. Keys and runs that meet a large share of all rows
are split in every join (join_heavy), and aggregations start before the shuffle.

Null texts are empty; texts shorter than `length` keep everything; matches never cross documents; an earlier start in the
same document counts. Ids are meant to be unique: rows of one id with one text are treated alike and do not repeat each
other, and spans carry a checksum, so another text of the same id is never cut by mistake; rows without id keep
everything. An empty table gives an empty result. Very long texts are hashed in overlapping chunks. Other columns pass,
whatever their names; a column named `repeats` is replaced.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import join_heavy, small_batches, staged

GRAM = 32
#: Different runs of a key beyond which its windows are dealt one by one.
HOT_RUNS = 512
#: Windows of a shard, about.
SHARD_WINDOWS = 500_000
CHUNK = 1 << 22
_BITS = np.uint64(23)
_MASK = np.uint64((1 << 23) - 1)
_BLOCK = 1 << 18
#: Windows of a suffix array that are compared at once.
SCAN = 8192
#: Windows that are sorted at once in a shard.
BATCH_WINDOWS = 50_000


def _check(total: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """One of the two 64-bit halves of the digest of spans; total: prefix sums of that kind."""
    return spans.span_hash(total, start, end, kind).view(np.int64)


def _chunks(raw: np.ndarray, at: np.ndarray, length: int):
    """Blocks of whole texts; a longer text in chunks that overlap by length - 1: texts' index, shift, bytes, offsets."""
    for i, _, block, offsets in spans.blocks(raw, at, _BLOCK):
        if len(block) <= CHUNK:
            yield i, 0, block, offsets
        else:
            for a in range(0, len(block) - length + 1, CHUNK - length + 1):
                part = block[a : a + CHUNK]
                yield i, a, part, np.array([0, len(part)])


def runs(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, start, n (windows), key, check and more (the digest of all bytes that the windows cover) of every run."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none, none
    gram, step, base = spans.TABLE[raw], 1, spans.BASE
    while step < GRAM:
        gram = gram[:-step] * np.uint64(base) + gram[step:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        step *= 2
    gram = spans.mix(gram)
    least = (gram & ~_MASK) | (_MASK - np.arange(len(gram), dtype=np.uint64))
    width, w = 1, length - GRAM + 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: width - w], least[w - width :])
    anchor = (_MASK - (least & _MASK)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    valid = text[: len(anchor)] == text[length - 1 :]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1 : len(anchor)] != text[: len(anchor) - 1]) | ~valid[:-1]
    ends = np.append(new[1:] | ~valid[1:], True)
    start, last = np.flatnonzero(new & valid), np.flatnonzero(ends & valid)
    check, more = (_check(spans.prefix(raw, kind), start, last + length, kind) for kind in (0, 1))
    return text[start], start - at[text[start]], last - start + 1, gram[anchor[start]].view(np.int64), check, more


class SuffixLevels:
    """The family: suffix arrays (offsets of distinct windows in sorted order), each more than twice as large as the next."""

    def __init__(self, length: int):
        self.length, self.levels = length, []
        self.text, self.used = np.zeros(1 << 16, np.uint8), 0

    def add(self, body: np.ndarray) -> int:
        """Where body begins in the shard's text."""
        begin, self.used = self.used, self.used + len(body)
        if self.used > len(self.text):
            self.text = np.concatenate([self.text[:begin], np.zeros(self.used, np.uint8)])
        self.text[begin : self.used] = body
        return begin

    def windows(self, at: np.ndarray) -> np.ndarray:
        every = np.lib.stride_tricks.sliding_window_view(self.text[: self.used], self.length)
        return every[at].view(f"S{self.length}").ravel()

    def merge_scan(self, level: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of new, its place in level and whether that place holds an equal window.

        Both arrays are in sorted order and are passed through once, side by side, a block of windows of each at a time;
        blocks of level that end before the next suffix of new are skipped by their last windows.
        """
        place, equal = np.empty(len(new), np.int64), np.zeros(len(new), bool)
        fences = self.windows(level[np.minimum(np.arange(SCAN, len(level) + SCAN, SCAN), len(level)) - 1])
        for j in range(0, len(new), SCAN):
            want = self.windows(new[j : j + SCAN])
            i = 0
            while i < len(want):
                block = int(np.searchsorted(fences, want[i]))
                if block == len(fences):
                    place[j + i : j + len(want)] = len(level)
                    break
                upto = int(np.searchsorted(want, fences[block], "right"))
                have = self.windows(level[block * SCAN : (block + 1) * SCAN])
                found = np.searchsorted(have, want[i:upto])
                place[j + i : j + upto] = block * SCAN + found
                equal[j + i : j + upto] = have[found] == want[i:upto]
                i = upto
        return place, equal

    def scan(self, at: np.ndarray) -> np.ndarray:
        """Which windows (offsets, in order of document and start) were seen before; then adds them as a level."""
        windows = self.windows(at)
        order = np.argsort(windows, kind="stable")
        first = np.ones(len(at), bool)
        first[1:] = windows[order[1:]] != windows[order[:-1]]
        new = at[order[first]]
        known = np.zeros(len(new), bool)
        for level in self.levels:
            known |= self.merge_scan(level, new)[1]
        seen = np.ones(len(at), bool)
        seen[order[first]] = known
        if not known.all():
            self.levels.append(new[~known])
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            small, large = sorted([self.levels.pop(), self.levels.pop()], key=len)
            self.levels.append(np.insert(large, self.merge_scan(large, small)[0], small))
        return seen


def _run_table(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, at = spans.utf8(batch.column("text"))
            found = [(i + t, a + s, *rest) for i, a, block, offsets in _chunks(raw, at, length) for t, s, *rest in [runs(block, offsets, length)]]
            if found:
                t, s, n, key, check, more = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").take(pa.array(t)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(check), pa.array(more)], names=["key", "doc_id", "start", "n", "check", "more"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "key long, doc_id long, start int, n int, check long, more long")


#: What a row for the shards holds: the text of a run, the digest of a window, or a span that is found (n and check).
TEXT, DIGEST, FOUND = 0, 1, 2


def _segments(joined: DataFrame, length: int) -> DataFrame:
    """What is listed with each document, for the shards; documents come in order of their ids."""

    def run(batches):
        own_id, texts_of, digests = None, set(), SuffixLevels(16)
        for batch in batches:
            rows, hot_docs = [], []
            listed = batch.column("listed")
            for i in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = np.frombuffer((batch.column("text")[i].as_py() or "").encode(), np.uint8)
                doc, digest = batch.column("doc_id")[i].as_py(), hashlib.sha256(raw).digest()
                if doc != own_id:
                    own_id, texts_of = doc, set()
                if digest in texts_of:  # the rows of an id come together; the scan drops what is left
                    continue
                texts_of.add(digest)
                start, n, check, key, hot = (listed[i].values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "check", "key", "hot"))
                own = start + n + length - 1 <= len(raw)
                own[own] = _check(spans.prefix(raw), start[own], start[own] + n[own] + length - 1) == check[own]
                whole, single = own & (hot == 0), own & (hot == 1)
                begin, end, body = start[whole], (start + n)[whole] + length - 1, raw.tobytes()
                rows.append((key[whole], doc, begin, [body[a:b] for a, b in zip(begin.tolist(), end.tolist())], TEXT))
                if single.any():
                    one = np.sort(np.repeat(start[single], n[single]) + _places(n[single]))
                    halves = np.stack([_check(spans.prefix(raw, kind), one, one + length, kind) for kind in (0, 1)], axis=1)
                    hot_docs.append((doc, raw, one, halves))
            if hot_docs:
                every = np.concatenate([halves for *_, halves in hot_docs])
                all_seen = digests.scan(digests.add(every.view(np.uint8).ravel()) + 16 * np.arange(len(every)))
                for (doc, raw, one, halves), seen in zip(hot_docs, np.split(all_seen, np.cumsum([len(one) for _, _, one, _ in hot_docs])[:-1])):
                    rows.append((halves[~seen, 0], doc, one[~seen], _pairs(halves[~seen]), DIGEST))
                    first, last = _spans(seen, one)
                    if len(first):
                        checks = _check(spans.prefix(raw), one[first], one[last] + length)
                        rows.append((checks, doc, one[first], _pairs(np.stack([last - first + 1, checks], axis=1)), FOUND))
            yield from _dealt(rows)

    return joined.sortWithinPartitions("doc_id").mapInArrow(run, "deal long, doc_id long, start int, bytes binary, kind int")


def _pairs(rows: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(rows).tobytes()
    return [flat[k : k + 16] for k in range(0, len(flat), 16)]


def _spans(seen: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each maximal run of seen windows at consecutive places."""
    new, last = seen.copy(), seen.copy()
    next_to = seen[1:] & seen[:-1] & (place[1:] == place[:-1] + 1)
    new[1:] &= ~next_to
    last[:-1] &= ~next_to
    return np.flatnonzero(new), np.flatnonzero(last)


def _places(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _dealt(rows: list[tuple], most: int = 20_000):
    """Record batches of rows of deals, document, starts, bytes and kind."""
    if rows:
        deal, doc, start, body, kind = zip(*rows)
        n = list(map(len, deal))
        columns = [
            pa.array(np.concatenate(deal)), pa.array(np.repeat(np.array(doc, np.int64), n)), pa.array(np.concatenate(start).astype(np.int32)),
            pa.array(list(chain.from_iterable(body)), pa.binary()), pa.array(np.repeat(np.array(kind, np.int32), n)),
        ]
        whole = pa.RecordBatch.from_arrays(columns, names=["deal", "doc_id", "start", "bytes", "kind"])
        for i in range(0, whole.num_rows, most):
            yield whole.slice(i, most)


def _once(batches):
    """Sorted batches without rows that equal the row before: rows of one id and one text give the same segments."""
    last = None
    for batch in batches:
        if batch.num_rows:
            whole = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks().to_batches()[0]
            new = np.ones(whole.num_rows, bool)
            same = [pc.equal(whole.column(c)[1:], whole.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "bytes")]
            new[1:] = ~np.logical_and.reduce(same)
            new[0] = last is None
            last = batch.slice(batch.num_rows - 1)
            yield whole.filter(pa.array(new))


def _scanned(segments: DataFrame, length: int, shards: int) -> DataFrame:
    """(doc_id, start, n, check) of the repeated windows, from each shard's family of suffix arrays."""

    def found(doc, start, n, check):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(check)], names=["doc_id", "start", "n", "check"])

    def run(batches):
        texts, digests = SuffixLevels(length), SuffixLevels(16)
        for batch in _once(batches):
            kind = batch.column("kind").to_numpy()
            of_kind = [batch.filter(pa.array(kind == k)) for k in (TEXT, DIGEST, FOUND)]
            for k in (DIGEST, FOUND):
                body, _ = spans.utf8(of_kind[k].column("bytes"))
                halves = np.frombuffer(body.tobytes(), np.int64).reshape(-1, 2)
                doc, start = of_kind[k].column("doc_id").to_numpy(), of_kind[k].column("start").to_numpy()
                if k == FOUND:
                    yield found(doc, start, halves[:, 0], halves[:, 1])
                elif len(doc):
                    seen = digests.scan(digests.add(body) + np.arange(0, len(body), 16))
                    yield found(doc[seen], start[seen], np.ones(seen.sum(), np.int64), halves[seen, 0])
            batch = of_kind[TEXT]
            body, at = spans.utf8(batch.column("bytes"))
            doc, origin = batch.column("doc_id").to_numpy(), batch.column("start").to_numpy().astype(np.int64)
            counts = np.diff(at) - length + 1
            upto = np.cumsum(counts)
            i = 0
            while i < len(counts):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BATCH_WINDOWS, "right")))
                own = counts[i:j]
                inner = _places(own)
                place = np.repeat(at[i:j], own) + inner
                seen = texts.scan(texts.add(body[at[i] : at[j]]) - at[i] + place)
                seg = np.repeat(np.arange(i, j), own)
                a, b = _spans(seen, place)  # the windows of two texts are never next to each other
                if len(a):
                    yield found(doc[seg[a]], origin[seg[a]] + inner[a], b - a + 1, _check(spans.prefix(body), place[a], place[b] + length))
                i = j

    dealt = segments.repartition(shards, "deal").sortWithinPartitions("doc_id", "start", "bytes")
    return dealt.mapInArrow(run, "doc_id long, start int, n int, check long")


def with_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with repeats: the list of (start, n, check) of windows that occur earlier, null if none."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("repeats").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    base = docs.select("doc_id", "text")
    place = F.struct("doc_id", "start")
    every = _run_table(base, length)
    keys = staged(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "suffix-keys")
    shared = staged(join_heavy(every, keys, ["key"], "c", ["doc_id", "start"]).drop("c"), "suffix-runs")

    digest = ["check", "more"]
    firsts = staged(shared.groupBy(*digest).agg(F.min(place).alias("first"), F.count("*").alias("c"), F.first("key").alias("key"), F.first("n").alias("n")), "suffix-firsts")
    again = firsts.where("c > 1").select(*digest, "first", "c")
    whole = join_heavy(shared.drop("key"), again, digest, "c", ["doc_id", "start"]).where(place > F.col("first")).select("doc_id", "start", "n", "check")

    several = staged(firsts.groupBy("key").agg(F.count("*").alias("runs"), F.sum("n").alias("windows")).where("runs > 1"), "suffix-several")
    windows = several.agg(F.sum("windows")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows // SHARD_WINDOWS))
    listed = join_heavy(firsts.select("key", "first", "n", "check"), several.select("key", "runs"), ["key"], "runs", ["first"])
    listed = listed.select(F.col("first.doc_id").alias("doc_id"), F.struct(F.col("first.start").alias("start"), "n", "check", "key", (F.col("runs") > HOT_RUNS).alias("hot")).alias("r"))
    listed = listed.groupBy("doc_id").agg(F.collect_list("r").alias("listed"))
    parts = _scanned(_segments(base.join(listed, "doc_id", "left"), length), length, shards)

    # a document's own spans: as many as its windows at most
    spans_of = whole.unionByName(parts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "check")).alias("repeats"))
    return docs.join(spans_of, "doc_id", "left")


def keep_mask(raw: np.ndarray, repeats: pa.Array | None, length: int) -> np.ndarray:
    """Which bytes of a text stay."""
    if repeats is None or not len(repeats):
        return np.ones(len(raw), bool)
    start, n, check = (repeats.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "check"))
    end = start + n + length - 1
    own = end <= len(raw)
    own[own] = _check(spans.prefix(raw), start[own], end[own]) == check[own]
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, start[own], 1)
    np.add.at(edge, end[own], -1)
    return np.cumsum(edge[:-1]) == 0


def _kept(batch: pa.RecordBatch, length: int):
    raw, at = spans.utf8(batch.column("text"))
    repeats = batch.column("repeats")
    for i in range(batch.num_rows):
        own = raw[at[i] : at[i + 1]]
        yield own, keep_mask(own, repeats[i].values if repeats[i].is_valid else None, length)


def measured(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for own, keep in _kept(batch, length):
                cut = ~keep
                spans_cut = int(cut[:1].sum() + (cut[1:] & keep[:-1]).sum())
                rows.append((len(own), int(cut.sum()), spans_cut, hashlib.sha256(own[keep].tobytes()).hexdigest()))
            columns = [pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_repeats(docs.select("doc_id", "text"), length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with repeated strings removed from text; what is left of a cut character goes too, and a null text stays null."""
    marked = with_repeats(docs, length)

    def run(batches):
        for batch in batches:
            whole = batch.column("text").is_valid().to_pylist()
            texts = pa.array([own[keep].tobytes().decode("utf-8", "ignore") if ok else None for ok, (own, keep) in zip(whole, _kept(batch, length))], pa.string())
            names = [c for c in batch.schema.names if c != "repeats"]
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names=names)

    return marked.mapInArrow(run, marked.drop("repeats").schema).select(*docs.drop("repeats").columns)
