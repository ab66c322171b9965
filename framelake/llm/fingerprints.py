"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed bottom up. At each level runs of one name become one phrase; between neighbours that differ,
deterministic coin tossing (place and value of the lowest differing bit, three times over) gives small labels whose
local maxima open phrases; a phrase's name is the hash of its names. Where to cut depends on a few neighbours only, so
equal substrings get equal interior names wherever they stand. A fingerprint holds the KEPT least name hashes of
levels 2 and 3 (phrases of about 10 and 30 bytes); likeness is their estimated resemblance, averaged over the levels.

Null and empty texts have the fingerprint ":" and are like each other only; very short texts are one phrase; equal texts
have equal fingerprints. Equal ids are ordered by a digest of the text, repeated rows follow each other, a single
document is its own successor, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import small_batches, text_of

LEVELS = (2, 3)
KEPT = 32
_BLOCK = 1 << 17
wrap = re.compile(".{8}").findall


_PLACE = np.array([8] + [(v & -v).bit_length() - 1 for v in range(1, 256)], np.uint8)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels (uint8) from the lowest bit in which a name differs from the one before; neighbours keep different labels."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]  # a text's first name is compared with its opposite: bit 0
    differ = x ^ before
    if x.dtype == np.uint8:
        place = _PLACE[differ]
        return place * np.uint8(2) + ((x >> place) & np.uint8(1))
    low = differ & (~differ + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1)) * np.uint8(2) + ((x & low) != 0)


def _names(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the names from each start to the next."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * spans.powers(spans.BASE, len(x)), out=total[1:])
    return spans.span_hash(total, start, np.append(start[1:], len(x)))


def _level(x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names, with their texts; x: bytes at the first level, names above."""
    first = np.empty(len(x), bool)
    first[0] = True
    np.not_equal(text[1:], text[:-1], out=first[1:])
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    sign, name = x, spans.TABLE[x] if x.dtype == np.uint8 else x
    if len(start) < len(x):  # what is tossed are the single names; the length of a run is part of what is hashed
        run = np.diff(np.append(start, len(x)))
        long = np.flatnonzero(run > 1)
        sign, name, text, first = sign[start], name[start], text[start], first[start]
        name[long] = spans.mix(name[long] + run[long].astype(np.uint64) * np.uint64(spans.BASE))
    label = _toss(_toss(_toss(sign, first), first), first)
    opens = first.copy()  # a text's last name opens nothing: what follows it is another text
    opens[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    start = np.flatnonzero(opens)
    return _names(name, start), text[start]


def signatures(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each level of LEVELS the sorted distinct keys text << 32 | name hash (32 bits), KEPT least of each text."""
    x, text = raw, np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    found = []
    for level in range(1, max(LEVELS) + 1):
        if len(x):
            x, text = _level(x, text)
        if level in LEVELS:
            key = np.sort((text.astype(np.uint64) << np.uint64(32)) | (spans.mix(x) >> np.uint64(32)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            begin = np.searchsorted(key, np.arange(len(at) - 1, dtype=np.uint64) << np.uint64(32))
            found.append(key[np.arange(len(key)) - begin[(key >> np.uint64(32)).astype(np.int64)] < KEPT])
    return found


def fingerprint(raw: np.ndarray, at: np.ndarray) -> list[str]:
    n = len(at) - 1
    parts = []
    for key in signatures(raw, at):
        begin = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        hexed = key.astype(np.uint32).astype(">u4").tobytes().hex()
        parts.append([hexed[8 * begin[i] : 8 * begin[i + 1]] for i in range(n)])
    return [":".join(x) for x in zip(*parts)]


def likeness(a: str, b: str) -> float:
    """Mean over levels of the bottom-k estimate of the resemblance of the phrase sets."""
    if a == b:
        return 1.0
    each = []
    for x, y in zip(a.split(":"), b.split(":")):
        p, q = set(wrap(x)), set(wrap(y))
        if p or q:
            union = p | q
            if max(len(p), len(q)) == KEPT < len(union):
                union = set(sorted(union)[:KEPT])
            each.append(len(p & q & union) / len(union))
    return sum(each) / len(each) if each else 0.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str]) -> list[list]:
    """The result rows for all texts but the last, which only follows."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    marks = []
    for group in (texts, new):
        made: list[str] = []
        raw, at = spans.utf8(pa.array(group, pa.large_string()))
        for _, _, block, offsets in spans.blocks(raw, at, _BLOCK):
            made += fingerprint(block, offsets)
        marks.append(made)
    own, changed = marks
    return [
        ids, [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in new], own[:-1], changed,
        [likeness(a, b) for a, b in zip(own, changed)], [likeness(a, b) for a, b in zip(own, own[1:])],
    ]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Documents are dealt to buckets of consecutive ids, those of an id on many rows (or of none) by ranges of their digests;
    each bucket also gets the first document of the next one, so texts are shuffled once and no task sees more than a
    bucket. Rows that repeat id and text lie in one bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.md5("text"))
    share = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", share, 10_000).alias("cuts")).head()["cuts"] or []
    times = Counter(cuts)  # an id that is a cut several times holds about as many buckets' rows
    cuts = sorted(times, reverse=True)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: F.col("doc_id") < c)))
    heavy = [c for c in cuts if times[c] > 1]
    ways = F.when(F.col("doc_id").isNull(), F.lit(4 * parts))
    if heavy:
        ways = ways.otherwise(F.element_at(F.create_map(*(F.lit(x) for c in heavy for x in (c, times[c]))), F.col("doc_id")))
    # a heavy id is the last of its bucket, and no id comes after all ids, so their ranges follow at 1, 2, ...
    within = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ways / F.lit(1 << 32)) + 1
    ready = ready.withColumn("bucket", bucket.cast("long") * F.lit(1 << 32) + F.coalesce(within, F.lit(0)))
    # one row a bucket: its first document in falling order of ids
    heads = sorted(ready.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).isNull().alias("last"), (-F.col("doc_id")).alias("minus"), "digest")).alias("h")).collect(), key=lambda r: r.bucket)
    follow = [(r.bucket, nxt.h.minus, nxt.h.digest) for r, nxt in zip(heads, heads[1:] + heads[:1])]
    ahead = spark.createDataFrame(follow, "goes_to long, minus long, first_digest string")
    extra = ready.join(F.broadcast(ahead), F.expr("digest = first_digest and -doc_id <=> minus")).select("doc_id", "text", "digest", F.col("goes_to").alias("bucket"), F.lit(1).alias("ahead"))
    dealt = ready.withColumn("ahead", F.lit(0)).unionByName(extra).repartition(parts, "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "digest").drop("digest")
    out = ready.select("doc_id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        out = out.add(name, kind)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        ids, texts, held, now, over = [], [], 0, None, False

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_rows(ids, texts), kinds)], names=out.names)

        for batch in batches:
            for i, t, b, extra_row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "ahead"))):
                if b != now:
                    ids, texts, held, now, over = [], [], 0, b, False
                if over:
                    continue
                texts.append(t)
                held += len(t)
                if extra_row or held >= 1 << 20 and len(texts) > 1:
                    yield flush()
                    ids, texts, held = [], [t], len(t)
                    over = bool(extra_row)
                ids.append(i)

    return ordered.mapInArrow(run, out)
