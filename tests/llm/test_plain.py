"""Scores, predictions and fingerprints against literal loops over one text; one id on very many rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import ann, fingerprints, langid, quality, spans

ALL = (1 << 64) - 1
TEXTS = ["", "a", "aa", "the cat sat on the mat", "Don't -- stop!! stop!!", "naïve 日本 é", "zzzzzzzz yyyy", " \t x  y\n", "good good words flow", "BAD ### $$$ words"]


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


def hashed(names):
    return mix((sum(n * pow(spans.BASE, i, 1 << 64) for i, n in enumerate(names)) + len(names)) & ALL)


def value(byte):
    return int(spans.TABLE[byte])


def some_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    return TEXTS + ["".join(rng.choice(list("abcdeé .,#AB\n"), k)) for k in rng.integers(1, 200, n)]


def test_quality_score_is_the_sparse_dot_product(spark):
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((1 << quality.BITS) + 1) < 0.5, rng.normal(size=(1 << quality.BITS) + 1), 0.0)
    texts = some_texts(1)
    got = {r.n: r for r in quality.scored(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), weights, 0.3).collect()}
    for n, text in enumerate(texts):
        words = [hashed([value(b) for b in w]) for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", text.encode())]
        found = words + [mix((a * 31 + b) & ALL) for a, b in zip(words, words[1:])] + [int(quality.SAME)] * sum(a == b for a, b in zip(words, words[1:]))
        logit = weights[-1] + sum(weights[f >> (64 - quality.BITS)] for f in found) / math.sqrt(max(1, len(found)))
        assert got[n].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
        assert got[n].predicted == (got[n].score >= 0.3)


def test_language_is_the_nearest_centroid(spark):
    learnt = [(i, t, "xyz"[i % 3]) for i, t in enumerate(some_texts(2)) if t]
    model = langid.fit(spark.createDataFrame(learnt, "doc_id long, text string, lang string"), k=2)

    def counted(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        return Counter(mix(((value(a) * spans.BASE + value(b)) * spans.BASE + value(c)) & ALL) >> (64 - langid.BITS) for a, b, c in zip(raw, raw[1:], raw[2:]))

    seen = Counter(p for _, t, _ in learnt for p in counted(t))
    texts = some_texts(3)
    got = {r.n: r for r in langid.predicted(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), model).collect()}
    for n, text in enumerate(texts):
        v = {p: math.log1p(c) * (math.log((1 + len(learnt)) / (1 + seen[p])) + 1) for p, c in counted(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        near = [sum(x / norm * float(c[p]) for p, x in v.items()) for c in model.centres]
        if not any(c.isalpha() for c in text):
            assert (got[n].lang_pred, got[n].score, got[n].rejected) == ("und", 0, True)
        else:
            assert got[n].score == pytest.approx(max(near), abs=1e-4)
            assert got[n].lang_pred in {model.langs[i] for i, s in enumerate(near) if s > max(near) - 1e-4}


def plain_fingerprint(text):
    def lowest(x, y):
        return ((x ^ y) & -(x ^ y)).bit_length() - 1

    def toss(x):
        places = [0, *map(lowest, x[1:], x)]  # the first is compared with its opposite
        return [2 * p + (v >> p & 1) for p, v in zip(places, x)]

    level, parts = [(b, value(b)) for b in text.encode()], []
    for depth in (1, 2, 3):
        single = [(sign, name, len(list(rest)) + 1) for (sign, name), rest in ((next(g), g) for _, g in groupby(level))]
        names = [name if n == 1 else mix((name + n * spans.BASE) & ALL) for _, name, n in single]
        label = toss(toss(toss([sign for sign, _, _ in single])))
        opens = [i for i in range(len(names)) if i == 0 or 0 < i < len(names) - 1 and label[i] > max(label[i - 1], label[i + 1])]
        level = [(h, h) for h in (hashed(names[a:b]) for a, b in zip(opens, [*opens[1:], len(names)]))]
        if depth in fingerprints.LEVELS:
            parts.append("".join(f"{h:08x}" for h in sorted({mix(h) >> 32 for h, _ in level})[: fingerprints.KEPT]))
    return ":".join(parts)


def test_fingerprints_equal_literal_parsing():
    texts = some_texts(4) + ["abc " * 900, "é" * 50]
    assert fingerprints.fingerprint(*spans.utf8(pa.array(texts))) == [plain_fingerprint(t) for t in texts]


def test_likeness_follows_shared_phrases():
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh "), 4000))
    near, half = base[:1990] + "XYZ" + base[2000:], fingerprints.edited(base, "".join(rng.choice(list("ijklmnop "), 4000)))
    own, a, b, c = (plain_fingerprint(t) for t in (base, near, half, "".join(rng.choice(list("abcdefgh "), 4000))))
    assert fingerprints.likeness(own, own) == 1 and fingerprints.likeness(own, a) > 0.8
    assert 0.15 < fingerprints.likeness(own, b) < 0.6 and fingerprints.likeness(own, c) < 0.05


def test_fingerprints_of_an_id_on_many_rows(spark):
    rng = np.random.default_rng(12)
    ids = [*range(0, 600, 3), *[7] * 200, *[None] * 100]
    rows = [(i, "".join(rng.choice(list("abcdef "), rng.integers(0, 30)))) for i in ids] + [(7, "again"), (7, "again"), (None, None)]
    out = fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    expected = Counter((i, hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest()) for (i, t), (_, following) in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == expected


def test_training_rows_are_bounded_with_an_id_on_many_rows(spark, monkeypatch):
    rows = [(1 if i % 2 else i, f"text {i} of many", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    read = []
    monkeypatch.setattr(quality, "fit", lambda df, rows: read.append((df.count(), rows)) or np.zeros(3))
    quality.trained(docs, labels, 5000)
    quality.trained(docs.unionByName(docs), labels, 5000)
    assert read == [(2000, 2000), (2000, 4000)]  # equal rows are read once
    quality.trained(docs, labels.where("doc_id < 40"), 200)
    assert 80 < read[-1][0] < 400


def test_language_fit_is_bounded(spark, monkeypatch):
    rows = [(1, "many equal rows here", "a")] * 500 + [(i, f"text {i} of another kind", "b") for i in range(50)] + [(900, "ein dritter Satz", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(langid.fit(table).langs) == {"a": 1, "b": 4, "c": 1}  # equal rows are fitted once
    monkeypatch.setattr(langid, "MOST_CENTROIDS", 3)
    assert langid.fit(table).langs == ["a", "b", "c"]
    monkeypatch.setattr(langid, "MOST_CENTROIDS", 2)
    with pytest.raises(ValueError, match="3 languages"):
        langid.fit(table)


def test_ids_in_several_parts_fill_every_query(spark, monkeypatch):
    monkeypatch.setattr(ann, "WANTED", 0.0)  # the number of ids alone decides how far a query goes
    rng = np.random.default_rng(13)
    centres = 3 * rng.normal(size=(32, 16))
    x = centres[np.arange(4000) % 32] + 0.3 * rng.normal(size=(4000, 16))
    ids = rng.permutation(4000) % 200  # an id has vectors in many parts
    ids[:5] = range(1000, 1005)  # the queries have one each
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") >= 1000, 190).collect():
        found[r.query_id].add(r.vec_id)
    assert {q: len(v) for q, v in found.items()} == {q: 190 for q in range(1000, 1005)}
