"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import ann, common, components, fingerprints, langid, mixing, neardup, packing, quality, sharding, spans, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old stone tower by the sea "
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeghilmnorstu"), rng.integers(2, 8))) for _ in range(400)]
    made = [" ".join(rng.choice(vocabulary, n)) for n in (3, 40, 90, 90, 200, 500)]
    near = made[4].split()
    near[17] = "changed"
    return [None, "", "   ", "one", "ONE", *made, made[4], " ".join(near), made[5].upper(), BASE * 3, "x" * 350, "ab" * 200, "é" * 120, made[1] + " " + BASE + made[2], "naïve CAFÉ ß don't I'LL <|endoftext|> 日本 x y", "w " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts())]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"score": F.lit("mine"), "size": F.lit(1), "key": F.lit(2), "label": F.lit("x")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_span_hashes_do_not_depend_on_place():
    raw, at = spans.utf8(pa.array(["ab cd ab", None, "ab"]))
    word, begin, _ = spans.words(raw, at)
    assert begin.tolist() == [0, 3, 3, 4] and word[0] == word[2] == word[3] != word[1]


def test_quality_learns_and_scores(spark, docs, none):
    rows = [(i, ("good words flow on calmly " if i % 2 else "BAD!! ### $$$ words words ") * (1 + i % 5), i % 2) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weights = quality.fit(labelled.where("doc_id < 150"), rows=150)
    held = quality.scored(labelled.where("doc_id >= 150"), weights).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    scored = quality.scored(docs, weights).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.scored(none, weights).count() == 0
    empty = quality.fit(labelled.where("false"))
    assert {r.score for r in quality.scored(docs, empty).collect()} == {0.5}


def test_mixing_meets_targets(spark, docs, none):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d"], 3000, p=[0.7, 0.1, 0.1, 0.1]).tolist())]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mixed(table).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3
    total = sum(r.size for r in out)
    assert math.isclose(sum(v[0].target for v in by.values()), total, rel_tol=1e-9)
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.copies * r.size for r in v) - v[0].target) <= 60
    again = {r.doc_id: r.copies for r in mixing.mixed(table.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in out}
    weighed = mixing.mixed(table, doc_weight=F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c")).orderBy("odd").collect()
    assert weighed[0].c > 1.3 * weighed[1].c
    # a capped source takes all of its documents three times, whatever their weights
    two = spark.createDataFrame([(i, "w " * 10, "a" if i < 40 else "b") for i in range(400)], "doc_id long, text string, source string")
    full = mixing.mixed(two, doc_weight=F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).where("source = 'a'").collect()
    assert {(r.target, r.source_size) for r in full} == {(1200.0, 400)} and {r.copies for r in full} == {3}
    # a target of 2.4 times the source: the heavy half is at its cap, the light half takes what it leaves
    lifted = mixing.mixed(spark.createDataFrame([(i, "w " * 10, "a" if i < 100 else "b") for i in range(384)], "doc_id long, text string, source string"), weights=(5, 3), doc_weight=F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).where("source = 'a'").collect()
    assert sum(r.copies * r.size for r in lifted) == lifted[0].target == 2400.0 and {r.copies for r in lifted if r.doc_id % 2 == 0} == {3}
    names = ["u", "below", "rate", "upto", "key", "certain", "expected", "doc_weight", "s", "need"]
    named = mixing.mixed(table.withColumns({n: F.col("doc_id") + i for i, n in enumerate(names)})).collect()
    assert {r.doc_id: r.copies for r in named} == again and all(r[n] == r.doc_id + i for r in named for i, n in enumerate(names))
    small = mixing.mixed(docs).collect()
    assert len(small) == docs.count() and {r.size for r in small if r.text in (None, "", "   ")} == {0}
    assert mixing.mixed(none).count() == 0


def brute_repeats(rows, length):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (doc, p)) < (doc, p):
                cut[p : p + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        runs = sum(1 for p, c in enumerate(cut) if c and not (p and cut[p - 1]))
        out[doc] = (len(raw), sum(cut), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [512, 0])
def test_suffix_dedup_equals_brute_force(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 70)
    found = suffix_dedup.measured(docs).collect()
    expected = brute_repeats(pairs_of(docs), 100)
    assert len(found) == docs.count() and all(tuple(r)[1:] == expected[r.doc_id] for r in found)
    assert suffix_dedup.measured(none).count() == 0
    cut = {r.doc_id: r for r in suffix_dedup.cut(docs).collect()}
    assert cut[0].text is None and cut[42].text.startswith("the quick") and cut[42].score == "mine"


@pytest.mark.parametrize("hot", [512, 0])
def test_suffix_dedup_of_repeated_near_copies(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 70)
    made = texts()
    rows = [(i, made[k]) for i, k in enumerate((9, 12, 5, 10, 18)) for _ in range(3)]  # 12 is a near copy of 9
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.measured(table).collect()
    expected = brute_repeats(rows, 100)
    assert len(found) == 15 and all(tuple(r)[1:] == expected[r.doc_id] for r in found)


def test_suffix_dedup_tells_runs_with_half_a_hash_in_common(spark):
    rng = np.random.default_rng(1)
    grams = rng.integers(97, 123, (2000, 32)).astype(np.uint8)
    keys = [suffix_dedup.runs(g, np.array([0, 32]), 32)[3].view(np.uint64)[0] for g in grams]
    body = rng.integers(97, 123, (300_000, 100)).astype(np.uint8)
    body[:, 34:66] = grams[int(np.argmin(keys))]  # the anchor of almost every text
    at = np.arange(0, body.size + 1, 100)
    half = spans.span_hash(spans.prefix(body.ravel()), at[:-1], at[1:]) >> np.uint64(32)
    key = suffix_dedup.runs(body.ravel(), at, 100)[3]  # one run a text
    order = np.lexsort((half, key))
    i = np.flatnonzero((half[order][1:] == half[order][:-1]) & (key[order][1:] == key[order][:-1]))[0]
    rows = [(k, body[order[i + k]].tobytes().decode()) for k in (0, 1)]
    assert rows[0][1] != rows[1][1]
    assert [r.n_removed for r in suffix_dedup.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]


def test_suffix_dedup_leaves_unique_texts_with_one_phrase(spark):
    # equal anchors and sizes, and 32 equal bits of a hash
    rows = [
        (1, "ftxihh osbwhi umybpbvtik gnq cquodnxvfc pybvjzmmpmgccuhdfbn ivgjtbqzlkqsqvvqbw muhlqzwu lz lzptnp ms"),
        (2, "cc vnhza qamumccbdyszxfuy esbcygfwnxvfc pybvjzmmpmgccuhdfbn ivgjtbgnatb qcc f o qfkojljaoagdveojuxgm"),
    ]
    found = suffix_dedup.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_removed, r.n_spans) for r in found] == [(0, 0), (0, 0)]


def test_suffix_dedup_of_very_many_texts_with_one_phrase(spark):
    """100,000 distinct texts of 100 bytes around one phrase of 60: nothing repeats, but for the texts that are put in twice."""
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, (100_000, 100)).astype(np.uint8)
    body[:, 20:80] = rng.integers(97, 123, 60)
    body[::1000] = body[7]
    names = [r.tobytes().decode() for r in body]
    table = spark.createDataFrame(pa.table({"doc_id": pa.array(np.arange(100_000)), "text": names}))
    found = suffix_dedup.measured(table).toPandas().sort_values("doc_id")
    first, expected = {}, []
    for i, name in enumerate(names):
        expected.append(100 if first.setdefault(name, i) != i else 0)
    assert found["n_removed"].tolist() == expected and sum(expected) > 0


def test_suffix_dedup_of_a_passage_in_many_texts(spark):
    """A passage of 160 bytes in each of 700 texts: its borders have 700 different runs, beyond HOT_RUNS."""
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 160).astype(np.uint8)
    rows = [(i, np.concatenate([rng.integers(97, 123, 150), passage, rng.integers(97, 123, 150)]).astype(np.uint8).tobytes().decode()) for i in range(700)]
    found = suffix_dedup.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_repeats(rows, 100)
    assert all(tuple(r)[1:] == expected[r.doc_id] for r in found)


@pytest.mark.parametrize("heavy", [1024, 2])
def test_join_heavy(spark, heavy, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = spark.createDataFrame([(k, i) for i in range(300) for k in ([1, 1 + i % 7] if i % 3 else [9])], "k long, i long")
    keys = rows.where("k < 9").groupBy("k").agg(F.count("*").alias("c"))
    found = sorted(map(tuple, common.join_heavy(rows, keys, ["k"], "c", ["i"]).collect()))
    counts = dict(map(tuple, keys.collect()))
    assert found == sorted((r.k, r.i, counts[r.k]) for r in rows.collect() if r.k in counts)


def test_sorted_segments_are_taken_once():
    names = ["deal", "doc_id", "start", "bytes"]
    rows = [(1, 5, 0, b"a"), (1, 5, 0, b"a"), (1, 5, 0, b"b"), (1, 5, 1, b"b"), (1, 6, 1, b"b"), (1, 6, 1, b"b"), (1, 6, 1, b"b")]
    for n in (1, 2, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + n])], names=names) for i in range(0, 7, n)]
        assert [tuple(r.values()) for b in suffix_dedup._once(batches) for r in b.to_pylist()] == list(dict.fromkeys(rows))


@pytest.mark.parametrize("block", [8192, 3])
def test_suffix_levels_stay_logarithmic(block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SCAN", block)
    family, rng, seen = suffix_dedup.SuffixLevels(4), np.random.default_rng(0), set()
    for _ in range(40):
        batch = rng.integers(0, 4, (50, 4)).astype(np.uint8)
        begin = family.add(batch.ravel())
        for known, row in zip(family.scan(begin + np.arange(0, 200, 4)), batch):
            assert known == (row.tobytes() in seen)
            seen.add(row.tobytes())
    sizes = [len(level) for level in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
    assert all((np.diff(np.unique(family.windows(level), return_inverse=True)[1]) > 0).all() for level in family.levels)


TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    library = Tokenizer.from_file(path)
    items = packing.pieces(docs, path, most=64)
    assert packing.packed(packing.pieces(none, path)).count() == 0
    out = packing.packed(items, tokens=64).collect()
    expected = Counter()
    for doc, text in pairs_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            expected[(doc, k // 64, k, len(part), __import__("zlib").crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    limited = packing.packed(items, tokens=64, most_docs=2, most_cost=64**2).groupBy("sequence_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
    assert limited <= 2


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(2)
    need = np.sort(rng.integers(1, 50, 300))[::-1].astype(float)
    need = np.stack([need, np.ones(300), need**2], 1)
    room = np.array([100.0, 4.0, 4000.0])
    for rule in ("norm", "dot"):
        bins = packing.best_fit(need, room, np.ones(3), rule)
        total = np.stack([np.bincount(bins, need[:, c]) for c in range(3)], 1)
        assert (total <= room).all()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_weighs_every_capacity(rule):
    rng = np.random.default_rng(3)
    length = np.sort(rng.integers(1, 60, 2000))[::-1].astype(float)
    need, room = np.stack([length, np.ones(2000), length**2], 1), np.array([100.0, 100.0, 10000.0])
    made = {w: packing.best_fit(need, room, np.array(w, float), rule).tolist() for w in ((1, 1, 1), (0, 1, 1), (1, 0, 1), (1, 1, 0), (1, 0, 0))}
    assert len({tuple(b) for b in made.values()}) == 5
    least = math.ceil(length.sum() / 100)
    assert max(made[1, 1, 1]) + 1 <= 1.02 * least + 1


def test_packing_of_many_pieces_is_near_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 1000)
    length = np.random.default_rng(9).lognormal(5, 1.2, 6000).clip(1, 4096).astype(int).tolist()
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(length)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.packed(items).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sum(r.n for r in rows) == sum(length) and all(r.n == r.end <= 4096 for r in rows)
    assert len(rows) <= 1.01 * sum(length) / 4096 + 1


def test_other_tokenizer_files_go_through_the_library(docs):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    library = Tokenizer.from_file(path)
    found = {(r.doc_id, r.start): r.length for r in packing.pieces(docs, path, most=10**9).collect()}
    assert found == {(doc, 0): len(library.encode(text or "", add_special_tokens=False).ids) + 1 for doc, text in pairs_of(docs)}


def test_fingerprints(docs, none):
    out = fingerprints.fingerprinted(docs).collect()
    rows = sorted(pairs_of(docs), key=lambda r: -r[0])
    assert len(out) == len(rows) and fingerprints.fingerprinted(none).count() == 0
    by_text = defaultdict(set)
    text_of = dict(rows)
    for r in out:
        by_text[text_of[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and r.n_chars == len(text_of[r.doc_id] or "")
    assert all(len(v) == 1 for v in by_text.values())
    expected = Counter()
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        expected[(doc, hashlib.sha256(fingerprints.edited(text or "", following or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == expected


def test_fingerprints_do_not_depend_on_neighbours():
    rng = np.random.default_rng(11)
    made = ["".join(rng.choice(list("abcde ."), n)) for n in rng.integers(0, 60, 400)]
    many = fingerprints.fingerprint(*spans.utf8(pa.array(made)))
    assert many == [fingerprints.fingerprint(*spans.utf8(pa.array([t])))[0] for t in made]


def test_equal_substrings_share_phrases():
    body = " ".join(t for t in texts()[5:11])
    mark = fingerprints.fingerprint(*spans.utf8(pa.array([body, "some other start: " + body, body[::-1]])))
    assert fingerprints.likeness(mark[0], mark[1]) > 0.8 and fingerprints.likeness(mark[0], mark[2]) < 0.2


def test_sharding(docs, none):
    out = sharding.sharded(docs, 5).collect()
    assert len(out) == docs.count() and sharding.sharded(none).count() == 0
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in out)
    text_of = dict(pairs_of(docs))
    assert all(r.size == len((text_of[r.doc_id] or "").encode()) + 16 and r.text_crc32 == __import__("zlib").crc32((text_of[r.doc_id] or "").encode()) for r in out)


def test_shards_are_even(spark):
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 101).cast("int")).alias("text"))
    sizes = [r.s for r in sharding.sharded(table, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * 117


def brute_groups(rows, k, percent):
    sets = {}
    for doc, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if a != b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {d: (len(sets[d]), root[d]) for d in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, none, k):
    found = neardup.grouped(docs, k=k).collect()
    expected = brute_groups(pairs_of(docs), k, 80)
    assert len(found) == docs.count()
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in found)
    assert neardup.grouped(none).count() == 0


def test_large_near_copy_group_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ACROSS", 8)
    monkeypatch.setattr(neardup, "ALONG", 16)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(90):
        words = list(base)
        for p in rng.choice(150, rng.integers(0, 16), replace=False):
            words[p] = f"e{d}_{p}"
        rows.append((d, " ".join(words)))
    found = {r.doc_id: r.component_id for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert found == {d: c for d, (_, c) in brute_groups(rows, 2, 80).items()}


def test_estimate_is_near():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[100:])
    ra, rb = neardup.registers(a)[None], neardup.registers(b)[None]
    assert abs(neardup.estimate(ra, rb, np.array([800]), np.array([800]))[0] - 700 / 900) < 0.12
    assert np.array_equal(np.maximum(ra, rb)[0], neardup.registers(np.unique(x)))  # a union's registers are the greater ones


@pytest.mark.parametrize("links", [100_000, 20])
def test_components_of_a_chain(spark, links, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", links)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    roots = defaultdict(set)
    for r in components.components(links).collect():
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [2, 61]


@pytest.mark.parametrize("heavy", [4, 1024])
def test_components_of_hubs(spark, heavy, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(components, "TASK_LINKS", 10)
    stars = [(0, i) for i in range(1, 80)] + [(i, 500) for i in range(400, 460)] + [(i, i + 1) for i in range(200, 212)]
    found = components.components(spark.createDataFrame(stars + stars[:9], "a long, b long")).collect()
    roots = defaultdict(set)
    for r in found:
        roots[r.root].add(r.node)
    assert len(found) == len({x for link in stars for x in link}) and sorted(map(len, roots.values())) == [13, 61, 80]


@pytest.mark.parametrize("heavy", [4, 1024])
def test_near_duplicates_with_a_third_of_copies(spark, heavy, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(neardup, "ALL_PAIRS", 3)
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)] * 60 + [""] * 30 + [None] * 10
    for i in range(40):
        texts.append(" ".join(w if p != i else f"e{i}" for p, w in enumerate(base)))
    texts += [" ".join(f"x{v}" for v in rng.integers(0, 1 << 30, 40)) for _ in range(40)]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)), texts)]
    found = neardup.grouped(spark.createDataFrame([*rows, (None, texts[0]), (None, "lone words here")], "doc_id long, text string"), k=2).collect()
    expected = brute_groups(rows, 2, 80)
    assert len(found) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    lost = {r.n_shingles: (r.component_id, r.kept) for r in found if r.doc_id is None}
    assert lost == {99: (expected[rows[0][0]][1], True), 2: (None, True)}


def test_token_counts_use_the_cache(docs, none, tmp_path, monkeypatch):
    import sentencepiece

    path, cache = f"{TOKENIZERS}/piece_bpe_32k.model", str(tmp_path / "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text_of = dict(pairs_of(docs))
    for _ in range(2):
        out = token_counts.counted(docs, path, cache).collect()
        assert len(out) == docs.count() and all(r.n_tokens == len(library.encode(text_of[r.doc_id] or "")) for r in out)
        assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for t in text_of.values()})
    assert token_counts.counted(none, path, cache).count() == 0


def test_language_id(spark, docs, none):
    words = {"en": "the and tion ing with that", "de": "der die und schaft ung nicht", "fr": "les des eau tion que pour"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[l].split(), 30)), l) for i in range(120) for l in words]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id < 90"))
    held = langid.predicted(table.where("doc_id >= 90"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    out = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    assert {out[i].lang_pred for i in (0, 3, 6)} == {"und"} and all(0 <= r.score <= 1 for r in out.values())
    assert langid.predicted(none, model).count() == 0
    assert {r.lang_pred for r in langid.predicted(docs, langid.fit(none)).collect()} == {"und"}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    x[1000:1400] = x[1000]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = ann.nearest(table, F.col("vec_id") % 200 == 0, 10).collect()
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append(r)
    assert sorted(by) == list(range(0, 6000, 200))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11)) and q not in [r.vec_id for r in found]
        assert [(r.score, -r.vec_id) for r in found] == sorted(((r.score, -r.vec_id) for r in found), reverse=True)
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(range(6000), key=lambda i: (-round(s[i], 9), i))[:10]
        hits += len({r.vec_id for r in found} & set(best))
        assert all(math.isclose(r.score, float(x[q] @ x[r.vec_id]), rel_tol=1e-9, abs_tol=1e-9) for r in found)
    assert hits / (10 * len(by)) >= 0.9
    assert ann.nearest(table.where("false"), F.lit(True)).count() == 0
    three = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    few = ann.nearest(three, F.col("vec_id") == 1, 10).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 2), (2, 3)]


@pytest.mark.parametrize("fan", [256, 4])
def test_nearest_neighbours_prune(spark, fan, monkeypatch):
    """Vectors in 40 groups: nine of ten neighbours are found by scoring few of the pairs, with one level and with two."""
    monkeypatch.setattr(ann, "FAN", fan)
    monkeypatch.setattr(ann, "SAMPLE_PER_PART", 64 if fan == 256 else 256)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + 0.35 * rng.normal(size=(4000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, [float("inf")] * 24), (10_001, [None] * 24), (None, [1.0] * 24)], "vec_id long, embedding array<double>")
    model = ann.fit(table.where("vec_id < 4000").select("vec_id", F.col("embedding").alias("v")), 4000)
    assert bool(model.below) == (fan == 4)
    held = np.bincount(model.homes(x), minlength=model.first[-1])
    ask = np.arange(0, 4000, 20)
    share = np.mean([held[leaves].sum() for leaves in model.visits(x[ask], held, 20)]) / 4000
    found = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        found[r.query_id].add(r.vec_id)
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    recall = np.mean([len(found[q] & set(b)) / 20 for q, b in zip(ask.tolist(), best.tolist())])
    assert sorted(found) == ask.tolist() and all(len(v) == 20 for v in found.values())
    assert recall >= 0.9 and share < (0.35 if fan == 256 else 0.7), (recall, share)


@pytest.mark.parametrize("times", [1, 2])
def test_nearest_neighbours_of_an_id_on_many_rows(spark, times):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(100, 8))
    x[60:] = 3 * x[0] + 0.1 * rng.normal(size=(40, 8))  # one id on more than k rows, all nearest to the query
    ids = [*range(60), *[500] * 40]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] * times, "vec_id long, embedding array<double>")
    for asks in (F.col("vec_id") < 3, F.col("vec_id") == 500):
        by = defaultdict(list)
        for r in ann.nearest(table, asks, 20).orderBy("query_id", "rank").collect():
            by[r.query_id].append((r.vec_id, round(r.score, 9)))
        for q in set(by):
            best = {}
            for a in (v for i, v in zip(ids, x) if i == q):
                for i, v in zip(ids, x):
                    if i != q:
                        best[i] = max(best.get(i, -np.inf), round(float(a @ v), 9))
            assert by[q] == sorted(best.items(), key=lambda e: (-e[1], e[0]))[:20]
        assert sorted(by) in ([0, 1, 2], [500])


def test_pipeline_stages_equal_brute_force(spark, docs, none):
    import corpus_pipeline

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    frame, empty = docs.select(*names), none.select(*names)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "suffix_dedup", "mixing", "packing"]

    groups = brute_groups(pairs_of(frame), 5, 80)
    kept = stages["near_duplicates"](spark, frame, "")
    assert kept.columns == names
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in pairs_of(frame) if groups[d][1] == d)

    expected = brute_repeats(pairs_of(frame), 100)
    cut = stages["suffix_dedup"](spark, frame, "").collect()
    assert len(cut) == frame.count()
    for r in cut:
        if r.text is not None and r.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id][3] and r.n_chars == len(r.text)

    copies = Counter()
    for r in mixing.mixed(frame).collect():
        copies[(r.doc_id, r.text)] += r.copies
    assert Counter((r.doc_id, r.text) for r in stages["mixing"](spark, frame, "").collect()) == +copies
    for name in ("suffix_dedup", "mixing", "packing"):
        assert stages[name](spark, empty, "").count() == 0
