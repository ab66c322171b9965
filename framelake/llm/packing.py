"""Best-fit packing of tokenised documents into sequences under three capacities: tokens, documents, attention cost.

Pieces are dealt evenly to shards of about SHARD_ITEMS. In a shard, pieces go in falling order of length, each into
the open bin that fits under every capacity and is best by the rule: `norm` (least weighted norm of what stays free)
or `dot` (greatest weighted product of need and free room). What lies in bins that stay under FULL of the token
capacity is packed once more, many shards' worth together, so the loss does not add up over shards.

Null and empty texts are one piece of the end token; only documents longer than a sequence are cut; ties go by id and
piece; repeated rows and rows without id are packed once each; an empty table gives an empty result. Every piece is
packed. Only id and text are read, so other columns may have any name; a very long text is one row of a batch.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, text_of

SHARD_ITEMS = 8192
FULL = 0.98
#: Words and parts of words that a worker remembers; it starts anew beyond.
KNOWN = 600_000

# The split pattern of the tokenizer file's pre-tokenizer, whose alternatives this module applies to words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PART = regex.compile(SPLIT)


#: Printable ASCII and Latin-1: lower case, normal form and byte names of these signs are simple.
PLAIN = regex.compile(r"[!-~\xa1-\xac\xae-\xff]+").fullmatch


def _byte_names() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, from the library, each distinct word looked up once.

    White space is dropped by this kind of tokenizer and nothing reaches across it, so a text's ids are those of its
    words. A word of plain Latin-1 signs is split by PART and each part given to the library's model; any other word
    goes through the whole library. So do the whole texts of a tokenizer file whose normaliser or splitter is another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        steps = (self.whole.normalizer, self.whole.pre_tokenizer)
        normalizer, splitter = (json.loads(step.__getstate__()) if step is not None else None for step in steps)
        first, *rest = (splitter or {}).get("pretokenizers") or [{}]
        split = (first.get("type"), first.get("pattern"), first.get("invert"), [r.get("type") for r in rest])
        self.by_word = normalizer == NORMALIZER and split == ("Split", {"Regex": SPLIT}, True, ["ByteLevel"])
        self.bytes = _byte_names()
        self.parts: dict[str, list[int]] = {}
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.flat, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = [t.id for t in self.whole.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes))]
            if len(self.parts) >= KNOWN:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def word(self, word: str) -> list[int]:
        if PLAIN(word) and "<|" not in word:
            parts = PART.findall(word.lower())
            return self.part(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.part(p)]
        return self.whole.encode(word, add_special_tokens=False).ids

    def slots(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in begin and length; new words are added."""
        known = self.words
        new = [w for w in words if w not in known]
        found = [self.word(w) for w in new]
        n = len(known)
        known.update(zip(new, range(n, n + len(new))))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.flat = np.append(self.flat, ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and where each text's begin (one more than texts)."""
        if not self.by_word:
            every = [e.ids for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in every for i in ids], np.uint32), np.cumsum([0, *map(len, every)])
        if len(self.words) >= KNOWN:
            self.clear()
        split = pc.ascii_split_whitespace(texts)
        every = split.flatten().dictionary_encode()
        slots = self.slots(every.dictionary.to_numpy(zero_copy_only=False).tolist())
        slots = slots[every.indices.to_numpy()] if len(every) else np.zeros(0, np.int64)
        lengths = self.length[slots]
        after = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.begin[slots] - after + lengths, lengths) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.concatenate([[0], after])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, bounds


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end: int = 1, key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut only if longer than most."""
    small_batches(docs.sparkSession)
    ready = docs.select(F.col(key).alias("doc_id"), text_of().alias("text"))

    def run(batches):
        pa.default_memory_pool().release_unused()  # a worker keeps what the arrays of an earlier stage took
        encode = word_ids(tokenizer)
        for batch in batches:
            ids, bounds = encode.batch(batch.column("text"))
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], end).astype("<u4")
                for k, at in enumerate(range(0, len(own), most)):
                    part = own[at : at + most]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return ready.mapInArrow(run, ready.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long"))


def best_fit(need: np.ndarray, room: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item: need has a row for each item (already in order) and a column for each capacity in room."""
    bins = np.empty(len(need), np.int64)
    free = np.empty((0, need.shape[1]))
    name = np.empty(0, np.int64)
    made, used = 0, 0
    least = np.minimum.accumulate(need[::-1], axis=0)[::-1] if len(need) else need
    for i, want in enumerate(need):
        best = -1
        if used:
            left = free[:used] - want
            fits = (left >= 0).all(axis=1)
            if fits.any():
                score = -(weights * (left / room) ** 2).sum(axis=1) if rule == "norm" else (weights * (want / room) * (free[:used] / room)).sum(axis=1)
                best = int(np.where(fits, score, -np.inf).argmax())
        if best < 0:
            if used == len(free):
                free = np.concatenate([free, np.zeros((max(64, used), need.shape[1]))])
                name = np.concatenate([name, np.zeros(max(64, used), np.int64)])
            best, free[used], name[used] = used, room, made
            made, used = made + 1, used + 1
        free[best] -= want
        bins[i] = name[best]
        if i + 1 < len(need) and (free[best] < least[i + 1]).any():  # no later item fits: closed
            used -= 1
            free[best], name[best] = free[used], name[used]
    return bins


def packed(items: DataFrame, tokens: int = 4096, most_docs: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    most_docs: pieces in a sequence; most_cost: sum of squared lengths in it. By default they are what a sequence of
    `tokens` tokens can hold at most, so they forbid nothing but weigh in the choice of a bin.
    """
    room = np.array([tokens, most_docs or tokens, most_cost or float(tokens) ** 2])
    shared = np.array(weights, float)
    placed = items.sparkSession.createDataFrame([], items.select("*").schema.add("sequence_id", "long").add("offset", "long").add("fill", "double"))
    schema = placed.schema

    def pack(shard: pa.Table) -> pa.Table:
        base = shard["shard"][0].as_py() << 24
        order = pc.sort_indices(shard, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        shard = shard.take(order).drop_columns(["shard"])
        length = shard["length"].to_numpy().astype(float)
        need = np.stack([length, np.ones(len(length)), length**2], axis=1)
        own = (need > room).any(axis=1)
        if own.any():
            raise ValueError("a piece exceeds a capacity by itself")
        bins = best_fit(need, room, shared, rule)
        by_bin = np.argsort(bins, kind="stable")
        total = np.bincount(bins, length)
        before = np.cumsum(length[by_bin]) - length[by_bin]
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = before - (np.cumsum(total) - total)[bins[by_bin]]
        return shard.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(total[bins] / tokens))

    def level(rows: DataFrame, shards: int, first: int, name: str) -> DataFrame:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)) + first)
        return staged(dealt.groupBy("shard").applyInArrow(pack, schema), name)

    items = staged(items, "pack-items")
    n = items.count()
    shards = max(1, -(-n // SHARD_ITEMS))
    once = level(items, shards, 0, "pack-first")
    if shards == 1:
        return once.drop("fill")
    loose = once.where(F.col("fill") < FULL).drop("sequence_id", "offset", "fill")
    again = level(loose, max(1, -(-loose.count() // SHARD_ITEMS)), shards, "pack-again")
    return once.where(F.col("fill") >= FULL).unionByName(again).drop("fill")
