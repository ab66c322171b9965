"""Vector codes, the exact-dedup index and the conversation trie against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import codes, exact_dedup, trie
from framelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table"), [("op11_vector_codes", "embeddings"), ("op12_exact_dedup", "documents"), ("op13_conversation_trie", "conversations")])
def test_query_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    expected = con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))


# --- vector codes


@pytest.mark.parametrize("bits", [None, 3, 7, 11])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 26), 1 << 26, (40, 16)), rng.integers(-(1 << 26), 1 << 26, (30, 16))
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()])
    assert (codes.dots(a, b, bits) == exact).all()
    assert all((np.abs(x) < 1 << 11).all() for x in codes.limbs(a, 11)) and len(codes.limbs(a, 11)) == 3
    assert 2 * codes.limb_bits(16) + 4 < 53  # 16 products of limbs stay below 2**53
    assert codes.dots(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).shape == (2, 3)


def test_nearest_takes_the_first_of_equal_entries():
    book = np.array([[5, 5], [0, 0], [0, 0], [2, 0]])
    at, far = codes.nearest(np.array([[0, 0], [1, 0]]), book)
    assert at.tolist() == [1, 1] and far.tolist() == [0, 1]


def brute_codes(rows, entries, rounds, scale=1024):
    """rows (id, vector, label), ids unique."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    n = len(kept[0][1]) // 4
    part = lambda v, p: v[p * n : (p + 1) * n]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book))[::-1]
    for _ in range(rounds):
        for p in range(4):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(part(v, p), books[p])[0]].append(part(v, p))
            for k, vs in own.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out, errors = [], defaultdict(int)
    for i, v, label in kept:
        at = [near(part(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for k, _ in at), sum(e for _, e in at), label))
        errors[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label], sha) for i, c, e, label in out), key=str)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in range(120)]
    rows += [(200 + i, rows[5][1], 1) for i in range(60)]  # one vector on a third of all rows
    rows += [(300, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 2), (303, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS code", "1 AS v", "2 AS error")
    found, _ = codes.compressed(table.repartition(3), entries=16, rounds=3)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()), key=str) == brute_codes(rows, 16, 3)
    few, books = codes.compressed(table.where("vec_id < 3"), entries=16, rounds=2)
    assert books.shape == (4, 3, 2) and sorted(r.code for r in few.collect()) == ["00000000", "01010101", "02020202"]
    assert codes.compressed(table.where("false"))[0].count() == 0
    again, books = codes.compressed(table.where("vec_id < 3").unionByName(table.where("vec_id = 1")), entries=16, rounds=0)
    assert again.count() == 4 and books.shape == (4, 3, 2)  # a repeated row: one entry, two codes


def test_codes_refuse_what_they_cannot_hold(spark):
    ragged = spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="same number"):
        codes.compressed(ragged)
    with pytest.raises(ValueError, match="too large"):
        codes.compressed(spark.createDataFrame([(1, [2e6] * 8)], "vec_id long, embedding array<float>"))


# --- exact dedup


def test_cuckoo_filter_inserts_deletes_and_overflows():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64)
    made = exact_dedup.CuckooFilter.of_size(20_000)
    assert made.insert(keys[:10_000]) and made.insert(keys[10_000:]) and made.contains(keys).all()
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert made.contains(other).mean() < 0.001
    made.delete(keys[:15_000])
    assert made.contains(keys[15_000:]).all() and made.contains(keys[:15_000]).mean() < 0.002
    assert np.count_nonzero(made.table) == 5_000
    small = exact_dedup.CuckooFilter.of_size(100)
    assert not small.insert(keys[:1000])
    assert exact_dedup.CuckooFilter.built(keys[:1000], 10).contains(keys[:1000]).all()


def brute_dedup(rows):
    by = defaultdict(list)
    for doc, text in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    out = []
    for text, ids in by.items():
        ids.sort(key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, d in enumerate(ids)]
    return sorted(out, key=str)


TEXTS = [None, "", " ", "\t\n", "a b", "a  b", "a\tb ", "a b ", "A b", "a b", "x" * 50_000, "x" * 50_000 + " ", "日本 語", "日本  語"]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_equals_brute_force(spark, batches):
    rows = [(i * 7 % 97, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(500 + i, "hot  copy") for i in range(40)] + [(3, "hot copy")] * 9 + [(None, "a b"), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS digest", "2 AS ref", "3 AS step", "4 AS kept")
    found = exact_dedup.deduplicated(docs.repartition(5), batches)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_dedup(rows)
    assert exact_dedup.deduplicated(docs.where("false"), batches).count() == 0


def test_index_inserts_deletes_and_grows(spark, tmp_path):
    def docs(pairs):
        return spark.createDataFrame(pairs, "doc_id long, text string")

    def held(index):
        return sorted((r.ref.id, r.n) for r in index.keys().collect())

    index = exact_dedup.CuckooIndex(spark, str(tmp_path / "index"), 3)
    index.insert(docs([(10 + i, f"text {i}") for i in range(5)]))
    index.insert(docs([(1, "text  2"), (2, "text 9"), (3, "text\n9")]))
    assert held(index) == [(1, 2), (2, 2), (10, 1), (11, 1), (13, 1), (14, 1)]
    index.delete(docs([(0, "text 2"), (0, "never seen"), (0, "text 2")]))
    assert held(index) == [(2, 2), (10, 1), (11, 1), (13, 1), (14, 1)]
    assert index._live(index._added(docs([(5, "text 2"), (6, "text 3")]), "doc_id", "text")).count() == 1
    index.insert(docs([(77, "text 2")]))  # comes again as a new text
    assert (77, 1) in held(index)
    before = sum(len(r.table) for r in index.filters().collect())
    index.insert(docs([(1000 + i, f"more {i}") for i in range(3000)]))  # filters overflow
    assert sum(len(r.table) for r in index.filters().collect()) > 50 * before
    again = exact_dedup.CuckooIndex(spark, index.path, 3, version=index.version)
    again.insert(docs([(2000 + i, f"more  {i}") for i in range(3000)] + [(4, "text 2")]))
    assert held(again) == sorted([(2, 2), (4, 2), (10, 1), (11, 1), (13, 1), (14, 1), *[(1000 + i, 2) for i in range(3000)]])


def test_a_filter_hit_without_its_text_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup.CuckooFilter, "contains", lambda self, keys: np.ones(len(keys), bool))
    index = exact_dedup.CuckooIndex(spark, str(tmp_path / "index"), 2)
    for k in range(3):
        index.insert(spark.createDataFrame([(i, f"{max(i, k)}") for i in range(k, 6)], "doc_id long, text string"))
    assert sorted((r.ref.id, r.n) for r in index.keys().collect()) == [(0, 1), (1, 2), *[(i, 3) for i in range(2, 6)]]


# --- conversation trie


def brute_trie(rows, group=5, most=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - int(np.fmod(c, group))
        path = tuple(turns.get(donor, [])[:h] + ts[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        children[p[:-1]] += bool(p)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children or not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, own in members.items()
    )


def conversations():
    rng = np.random.default_rng(8)
    rows = []
    for c in [*range(-12, 60), 100, 101, 1003]:
        for k in range(int(rng.integers(1, 14))):
            rows.append((c, k, "user" if k % 2 else "assistant", ["hi", "yes", "no", "é" * 40, ""][int(rng.integers(0, 5 if k > 2 else 2))]))
    rows += [(200 + c, k, "user", f"same {k}") for c in range(40) for k in range(11)]  # a group of copies
    rows += [(300, k, "user", f"long {k % 50}") for k in range(900)]  # one long conversation
    rows += [(c, None, None, None) for c in (7, 301, 302)] + [(303, 5, "user", "x"), (303, 5, "user", "x"), (303, 5, "user", "a"), (303, None, "user", "z"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("nodes", [50_000, 40, 3])
def test_trie_equals_brute_force(spark, nodes, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_NODES", nodes)
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie.Parentheses, "BLOCK", 4)
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "'x' AS digest", "2 AS path", "3 AS length")
    found = trie.conversation_trie(table.repartition(4))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(brute_trie(rows), key=str)
    assert trie.conversation_trie(table.where("false")).count() == 0
    only = trie.conversation_trie(table.where("conv_id = 302"))
    assert sorted(tuple(r) for r in only.collect()) == sorted(brute_trie([r for r in rows if r[0] == 302]))


def test_parentheses_find_their_partners(monkeypatch):
    rng = np.random.default_rng(3)
    for block in (2, 4, 64):
        monkeypatch.setattr(trie.Parentheses, "BLOCK", block)
        for n in (1, 2, 7, 300):
            bits, depth, left = [1], 1, n - 1
            while left or depth:
                if left and (depth == 1 or rng.random() < 0.55):
                    bits, depth, left = bits + [1], depth + 1, left - 1
                else:
                    bits, depth = bits + [0], depth - 1
            stack, close = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            tree = trie.Parentheses(np.array(bits, np.uint8))
            assert tree.find_close(tree.opens()).tolist() == [close[i] for i in tree.opens().tolist()]


def test_turnless_conversations_end_at_the_root(spark):
    """A conversation whose own turns all fall to an absent donor is a member of the root alone."""
    rows = [(c, 0, "user", "gone") for c in (1, 2, 3, 4) if zlib.crc32(str(c).encode()) % 9]
    found = trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in found] == brute_trie(rows) and found[0].n_convs == len(rows) > 1
