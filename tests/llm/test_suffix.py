import hashlib
import random

import numpy as np
import pytest

from heristat.llm import suffix as S


def slow(docs, least):
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for k in range(len(t) - least + 1):
            first.setdefault(t[k : k + least], i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if i is not None and first[t[k : k + least]] < i:
                gone[k : k + least] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_query(documents, no_documents, real):
    for df in (documents, real):
        docs = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, S.query(df).collect()), key=repr) == slow(docs, 50)
    assert S.query(no_documents).collect() == []


@pytest.mark.parametrize("hot", [1, 10**6])
def test_common_lines(spark, hot):
    """A line that all documents have, at random places, splits its grams where hot is small."""
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    junk = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    docs = [(rng.randrange(10**6), junk(rng.randrange(60)) + line[rng.randrange(20) :] + junk(rng.randrange(60)) + "zq" * rng.randrange(40)) for _ in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.dedup(df, hot=hot).collect()
    want = slow([(i, t.encode()) for i, t in docs], 50)
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == want


@pytest.mark.parametrize("hot", [3, 10**6])
def test_many_buckets(spark, hot):
    """Far more buckets than tasks and than a batch may send to: rows go by groups of buckets, results are the same."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    docs = [(rng.choice([None, *range(200)]), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for _ in range(200)]
    got = S.dedup(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot, bucket_bytes=200, fan=5, tasks=3)
    want = slow([(i, t.encode()) for i, t in docs], 50)
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got.collect()), key=repr) == want


def test_repeated_and_null_ids(spark):
    """A thousand rows of one id, as many without, and ids at both ends of long."""
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdef ") for _ in range(80)) for _ in range(6)]
    text = lambda: "".join(rng.choice("ghijklm") for _ in range(rng.randrange(30))) + rng.choice(shared) + "x" * rng.randrange(9)
    docs = [(7, text()) for _ in range(500)] + [(7, shared[0])] * 500 + [(None, text()) for _ in range(500)] + [(None, shared[1])] * 500
    docs += [(i, text()) for i in (-(1 << 63), -1, 0, 6, 8, (1 << 63) - 1)] + [(9, None), (None, None), (10, "short")]
    got = S.query(spark.createDataFrame(docs, "doc_id long, text string").withColumn("a.b", S.F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=repr) == slow([(i, (t or "").encode()) for i, t in docs], 50)


def test_most_frequent():
    lists = [[np.arange(k * 10, k * 10 + 10), np.arange(10) * 100 + k] for k in range(7)]
    assert S._most_frequent(iter(lists), 14).tolist() == sorted(k * 10 + i for k in range(7) for i in (8, 9))
    assert S._most_frequent(iter(lists)).tolist() == list(range(70)) and S._most_frequent(iter([])).tolist() == []


@pytest.mark.parametrize("batch", [1, 10**6])
def test_chance_grams_are_not_asked_for(monkeypatch, batch):
    """Two documents have 60 bytes in common; all have 24, which hold whole grams but no gram with what is beside it."""
    monkeypatch.setattr(S, "BATCH_BYTES", batch)
    monkeypatch.setattr(S, "SLICE_BYTES", 1)
    rng = random.Random(2)
    junk = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    common, passage = junk(24), junk(60)
    texts = [b"".join(junk(60) + common for _ in range(2)) + junk(60) + (passage if i in (3, 7) else b"") for i in range(1, 9)]
    docs = S.pa.table({"doc_id": range(1, 9), "tag": [0] * 8, "deal": S.pa.array(range(8), S.pa.int32()), "text": texts}).to_batches()
    sent = sorted((r for b in S._find_anchors(3, 50, 0)(iter(docs)) for r in zip(*b.to_pydict().values())), key=lambda r: r[:2])
    asked = [S.unpack(blob) for b in S._want(3, 10**6, 0)(iter([S._rows(sent)])) for kind, _, blob in zip(*b.to_pydict().values()) if kind == 1]
    at = {(int(i), int(p)) for ids, _, q in asked for i, p in zip(np.cumsum(ids), np.cumsum(q))}
    assert {i for i, _ in at} == {3, 7} and all(p > 200 for _, p in at)


def test_texts_are_packed():
    """What is shuffled of the texts is well below them, and they come back whole."""
    rng = random.Random(3)
    docs = [(i % 2, i, 1 << 31, " ".join(rng.choice(("the", "of", "und", "heit", "keit")) for _ in range(rng.randrange(900))).encode()) for i in range(-9, 9)]
    table = S.pa.table([S.pa.array(x, t) for x, t in zip(zip(*docs), (S.pa.int32(), S.pa.int64(), S.pa.int64(), S.pa.binary()))], ["deal", "doc_id", "tag", "text"])
    found = sorted((r for b in S._pack_docs(iter(table.to_batches())) for r in zip(*b.to_pydict().values())), key=lambda r: r[0])
    assert sum(len(blob) for *_, blob in found) < 0.5 * sum(len(d[3]) for d in docs)
    batch = S.pa.RecordBatch.from_pylist([dict(zip(("deal", "docs", "blob"), r)) for r in found])
    assert sorted((deal, *doc) for deal, _, own in S._by_deal(iter([batch])) for doc in own) == sorted(docs)


def test_gram_shared_by_an_id_in_two_batches(spark):
    """Document 7 shares a gram alone with the first row of id 5, in its batch, and a passage with the second, in another."""
    rng = random.Random(9)
    junk = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for _ in range(3):
        passage = junk(50)
        (at,), _ = S.anchors(passage.encode(), np.array([0]), np.array([50]))
        gram = passage[at : at + S.GRAM]
        other = next(t for t in (junk(40) + gram + junk(40) for _ in range(999)) if 40 in S.anchors(t.encode(), np.array([0]), np.array([96]))[0])
        docs = [(5, other), (7, passage), (5, passage), (8, junk(70))]
        got = S.query(spark.createDataFrame(spark.sparkContext.parallelize(docs, 2), "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=repr) == slow([(i, t.encode()) for i, t in docs], 50)


def test_windows_are_sorted_as_contexts_are():
    rng = np.random.default_rng(3)
    window = rng.integers(97, 99, (300, 50)).astype(np.uint8)
    window[:, :44] = window[rng.integers(5, size=300), :44]
    ids = rng.integers(0, 40, 300)
    least = {}
    for w, i in zip(map(bytes, window), ids):
        least[w] = min(i, least.get(w, i))
    for block in (7, 10**6):
        assert S.repeated_windows(window, ids, block).tolist() == [bool(i > least[bytes(w)]) for w, i in zip(window, ids)]


@pytest.mark.parametrize("least", [24, 37, 128])
def test_other_lengths(spark, least):
    rng = random.Random(least)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(9)]
    docs = [(i % 50, "".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(70)]
    got = S.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == slow([(i, t.encode()) for i, t in docs], least)
    with pytest.raises(ValueError):
        S.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 10)


def test_cover_ranks_sort_suffixes():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, (40, 84)).astype(np.uint8)
    text[20:] = text[:20]
    ranks = S.cover_ranks(text, 84)
    cols = [c for c in range(84) if c % S.COVER in S.RESIDUES]
    every = [(bytes(text[r, c:]) + b"\0" * c, ranks[r, c]) for r in range(40) for c in cols]
    every.sort()
    assert all((a[0] == b[0]) == (a[1] == b[1]) and a[1] <= b[1] for a, b in zip(every, every[1:]))
    assert {(a - b) % S.COVER for a in S.RESIDUES for b in S.RESIDUES} == set(range(S.COVER))
