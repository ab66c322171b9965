"""The registered queries of the pipeline operators on the smallest test tables: columns, folds, thresholds, whole tables."""

import hashlib
import os
import zlib
from collections import defaultdict

import pytest

from framelake.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, columns):
    out = QUERIES[name](spark, SF)
    assert out.columns[: len(columns)] == columns
    return out.collect()


def crc(doc):
    return zlib.crc32(str(doc).encode())


def test_op1(spark, texts):
    found = rows(spark, "op1_quality_classifier", ["doc_id", "held_out", "score", "predicted"])
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in found if r.held_out and r.doc_id in marked]
    assert sum(r.predicted == marked[r.doc_id] for r in held) >= 0.8 * len(held)


def test_op2(spark, texts):
    found = rows(spark, "op2_mixing", ["doc_id", "size", "source_size", "target", "taken"])
    sizes = {d: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    assert {r.doc_id: r.size for r in found} == sizes and len(found) == len(texts)
    assert all(r.taken in [k * r.size for k in range(4)] for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.target, r.source_size].append(r)
    for (target, _), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)


def test_op3(spark, texts):
    found = {r.doc_id: tuple(r)[1:] for r in rows(spark, "op3_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])}
    from .test_operators import brute_repeats

    assert found == brute_repeats(texts.items(), 100)


def test_op4(spark, texts):
    found = rows(spark, "op4_best_fit_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    import public_tokenizers
    from tokenizers import Tokenizer

    library, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected.add((doc, k // 4096, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert {tuple(r)[:5] for r in found} == expected and len(found) == len(expected)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(r.length for r in found) / 4096 + 1


def test_op5(spark, texts):
    found = rows(spark, "op5_fingerprints", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    order = sorted(texts, reverse=True)
    for r in found:
        own, other = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert own != edited or (r.fingerprint == r.edited_fingerprint and r.near_edited == 1)
    by = defaultdict(set)
    for r in found:
        by[texts[r.doc_id]].add(r.fingerprint)
    assert {len(v) for v in by.values()} == {1} and len(found) == len(texts)


def test_op6(spark, texts):
    found = rows(spark, "op6_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert set(by) <= set(range(40)) and {r.law for r in found} == {"bytes"}
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())


def test_op7(spark, texts):
    found = rows(spark, "op7_near_duplicates", ["doc_id", "n_shingles", "component_id", "kept"])
    from .test_operators import WORD

    sets = {}
    for doc, text in texts.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[doc] = {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())
    ids, head = sorted(sets), {d: d for d in sets}

    def root(d):
        while head[d] != d:
            d = head[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {(d, len(sets[d]), root(d), root(d) == d) for d in ids}


def test_op8(spark, texts):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = rows(spark, "op8_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    expected = {(d, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts.items()}
    assert {tuple(r)[:4] for r in found} == expected and len(found) == len(texts)


def test_op9(spark, texts):
    found = rows(spark, "op9_language_id", ["doc_id", "held_out", "lang_pred", "score"])
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
        assert r.lang_pred in {*lang.values(), "und"}
    held = [r for r in found if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op10(spark):
    import numpy as np

    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    found, hits = defaultdict(list), 0
    for r in rows(spark, "op10_nearest_neighbours", ["query_id", "rank", "vec_id", "score"]):
        found[r.query_id].append(r)
    assert sorted(found) == sorted(ids[ids % 20 == 0].tolist())
    place = {int(i): n for n, i in enumerate(ids)}
    for q, own in found.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - float(x[place[q]] @ x[place[r.vec_id]])) < 1e-12 for r in own)
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        hits += len({r.vec_id for r in own} & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_pipeline(spark, texts):
    """run() is its stages one after another; the first keeps what the classifier scores 0.3 or more."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_quality_classifier"](spark, SF).collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, good in scores.items() if good)
    assert corpus_pipeline.keep_quality(spark, docs.where("false"), SF).count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= {d for d, good in scores.items() if good} and len(out) > 0.5 * sum(scores.values())
    bins = defaultdict(int)
    for r in out:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096
