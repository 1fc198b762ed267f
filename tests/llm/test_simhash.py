import random
import re

import xxhash
from pyspark.sql import functions as F

from heristat.llm import simhash as S
from heristat.llm.common import components


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{f:016x}", least.get(top(i))) for i, (d, f) in enumerate(rows)), key=repr)


def test_query(documents, no_documents, real):
    for df in (documents, real):
        rows = [(r.doc_id, slow(r.text or "")) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, S.query(df).collect()), key=repr) == slow_groups(rows)
    assert S.query(no_documents).collect() == [] and S.deduplicate(no_documents).collect() == []


def test_no_link_is_lost(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(60)}
    fps = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame(fps, "fp long, rep long")
    want = {d: c for d, _, c in slow_groups([(i, v) for i, v in enumerate(sorted(values))])}
    for chunk in (3, 7, 100, 100_000):  # a small chunk cuts shards finer and deals them among several tasks
        got = {r.node: r.component for r in components(S.links(df, chunk=chunk)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for r in range(4):
        assert {tree.values[i] for i in tree.search(5, r)} == {v for v in values if (v ^ 5).bit_count() <= r}


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 7), (2000, 2000), (3000, 3001), (3001, 3000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(401), 1000]} | {3000: 3000, 3001: 3000}


def test_deduplicate(documents):
    got = S.deduplicate(documents)
    assert got.columns == documents.columns
    kept = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    groups = {r.doc_id: r.component_id for r in S.query(documents).collect() if r.doc_id is not None}
    assert kept == sorted(set(groups.values())) and got.filter("doc_id IS NULL").count() == 2


def test_rows_that_share_an_id_alone(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "three"))
    rows = [(1, a), (5, a.upper()), (5, b), (7, b), (7, c), (7, c), (7, c.upper()), (8, a), (8, b), (9, "x y z"), (9, "p q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.query(df).collect()), key=repr) == slow_groups([(d, slow(t)) for d, t in rows])
    assert sorted(map(tuple, S.deduplicate(df).collect())) == sorted([(1, a), (5, b), (7, min(c, c.upper())), (9, "x y z"), (9, "p q r")])


def test_ids_of_any_size(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    texts = [" ".join(f"{w}{i}" for i in range(80)) for w in ("one", "two", "three", "four")]
    ids = [7, 5 * 10**18, 5 * 10**18 + 1, 5 * 10**18 + 2, least, least + 1, most, most - 1, None, -1, 0]
    rows = [(d, texts[i % 4].upper() if i > 5 else texts[i % 4]) for i, d in enumerate(ids)] + [(None, None), (most, ""), (None, "alone by itself")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_groups([(d, slow(t or "")) for d, t in rows])
    assert sorted(map(tuple, S.query(df).collect()), key=repr) == want
    kept = [r.doc_id for r in S.deduplicate(df).collect()]
    assert sorted(d for d in kept if d is not None) == sorted({c for _, _, c in want if c is not None}) and kept.count(None) == 3


def test_dotted_names(documents):
    df = documents.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    got = S.deduplicate(df)
    assert got.columns == df.columns and got.count() == S.deduplicate(documents).count()


def test_masks_keep_links():
    rng = random.Random(5)
    plan = S.masks(3, 5)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        near = [more for mask, more in plan if not flips & mask]
        assert near and all(any(not flips & m for m in more) for more in near)
