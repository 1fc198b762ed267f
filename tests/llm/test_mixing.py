import re

import pytest
from pyspark.sql import functions as F

from heristat.llm import mixing as M
from tests.conftest import rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, weights, ceiling=3):
    """Targets by sharing again and again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = sum(sizes.values())
    while open_:
        each = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if each * weights[s] > ceiling * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = min(ceiling * sizes[s], each * weights[s])
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(df):
    """Holds sizes, targets, the words taken and the shards of every source's documents against df."""
    got = M.query(df)
    source = {}
    for r in df.collect():
        source.setdefault((r.doc_id, words(r.text)), []).append(r.source)
    sizes, taken, largest = {}, {}, {}
    found = got.collect()
    assert len(found) == df.count()
    for d, n in source:
        for s in source[d, n]:
            sizes[s], largest[s] = sizes.get(s, 0) + n, max(largest.get(s, 0), n)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = water(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    for r in found:
        (s,) = set(source[r.doc_id, r["size"]])
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * len([x for x in r.shards.split(",") if x])
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return got


def test_query(documents, no_documents, real):
    check(documents)
    got = check(real)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.query(real.repartition(3)).collect()))
    assert M.query(no_documents).collect() == [] and M.resample(no_documents).collect() == []


def test_sql(spark, duck):
    from tests.conftest import DATA

    assert rows(M.query(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()) == rows(duck.sql(M.SQL).df())


def test_ceiling_and_empty_sources(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b " * 100, "q"), (3, "", "r"), (4, "c " * 50, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in check(df).collect()}
    assert got[1].taken == 3 and got[3].target == 0 and got[3].taken == 0
    empty = spark.createDataFrame([(1, None, "p")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in M.query(empty).collect()] == [(0, 0.0, 0)]


def test_resample(documents):
    taken = sorted((r.doc_id or 0, r.taken) for r in M.query(documents).collect() if r.taken)
    got = M.resample(documents)
    assert got.columns == documents.columns
    per = {}
    for r in got.collect():
        per[r.doc_id or 0] = per.get(r.doc_id or 0, 0) + words(r.text)
    want = {}
    for d, n in taken:
        want[d] = want.get(d, 0) + n
    assert {k: v for k, v in per.items() if v} == want


def test_tree_meets_quotas(spark):
    q = spark.createDataFrame([(1, 5), (2, 1000), (3, 0), (4, 333)], "bundle long, quota long")
    rows_of = lambda: {(r.bundle, r.shard): r.quota for r in M.split(q, 3).collect()}
    got = rows_of()
    assert {k: sum(n for (b, _), n in got.items() if b == k) for k in (1, 2, 3, 4)} == {1: 5, 2: 1000, 3: 0, 4: 333}
    totals = [sum(n for (_, s), n in got.items() if s == i) for i in range(8)]
    assert max(totals) - min(totals) <= 3 and sum(totals) == 1338 and min(n for (b, _), n in got.items() if b == 2) > 90
    assert got == rows_of()


def test_draws_follow_the_distribution(spark):
    """Means of many one-level draws of 10 of 20 blocks, 8 of them of source a."""
    import math

    q = spark.createDataFrame([(1, 8), (2, 12)], "bundle long, quota long")
    draws = [sum(r.quota for r in M.split(q, 1, seed).filter("bundle = 1 AND shard = 0").collect()) for seed in range(40)]
    assert abs(sum(draws) / 40 - 4) < 4 * math.sqrt(8 * 12 * 10 * 10 / (400 * 19) / 40)


def test_draw_inverts_the_distribution(spark):
    """Every outcome's share of the uniform numbers is its probability."""
    from math import comb

    for q, n, total in ((8, 10, 20), (1, 1, 2), (5, 3, 6), (0, 4, 9), (4, 0, 9), (9, 4, 9)):
        u = f"((id + 0.5D) / {steps}D)" if (steps := 4000) else ""
        got = spark.range(steps).select(F.expr(M._draw(f"{q}D", f"{n}D", f"{total}D", u)).alias("k")).groupBy("k").count().collect()
        want = {k: comb(q, k) * comb(total - q, n - k) / comb(total, n) for k in range(max(0, n + q - total), min(q, n) + 1)}
        assert {r.k for r in got} <= set(want)
        for r in got:
            assert abs(r["count"] / steps - want[r.k]) <= 2 / steps


def test_repeated_rows_and_null_ids(spark, duck):
    word = "w " * 5
    for repeated in ([(1, word, "p")] * 100, [(None, word, "p")] * 100, [(None, word + str(i), "p") for i in range(100)], [(i % 3, word, "p") for i in range(100)]):
        df = spark.createDataFrame(repeated + [(1000 + i, word, "q") for i in range(100)], "doc_id long, text string, source string")
        got = check(df)
        documents = got.sparkSession.createDataFrame(df.collect(), df.schema).toPandas()  # noqa: F841
        con = duck.cursor()
        con.register("documents", documents.astype({"doc_id": "Int64"}))
        assert rows(got.toPandas()) == rows(con.sql(M.SQL).df())
        want = sorted(n for r in got.collect() for n in [r["size"]] * (r.taken // max(1, r["size"])))
        assert sorted(words(r.text) for r in M.resample(df).collect()) == want


def test_many_sources_share_bundles(spark):
    n = 600
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % n:04d}") for i in range(4 * n)], "doc_id long, text string, source string")
    check(df)


def test_numbering_spans_partitions(spark):
    df = spark.createDataFrame([(i * 7919 % 5003, i % 4) for i in range(5000)], "k long, w long")
    got = sorted(M.numbered(df, ["k"], "at", ("w",)).collect())
    before = 0
    for i, r in enumerate(got):
        assert (r.at, r._before_w) == (i, before)
        before += r.w


def test_shards(real):
    for shards in (None, 8):
        m = M.Mix(real, shards=shards)
        n = shards or M.SHARDS
        each = m.rows()
        assert each.rdd.getNumPartitions() == n
        got = each.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
        assert all(r.shard == r.p for r in got) and len(got) <= n
        tickets = [s for r in m.tickets.collect() for s in r.shards]
        per = [tickets.count(s) for s in range(n)]
        assert max(per) - min(per) <= 6
        # documents by shard: what rows() deals is what the digest says
        said = [int(s) for r in m.digest().collect() for s in r.shards.split(",") if s]
        dealt = [r.shard for r in m.rows().select("shard").collect()]
        assert sorted(said) == sorted(dealt)


def test_dotted_names(documents):
    df = documents.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(None).cast("map<string,int>"))
    assert M.resample(df).columns == df.columns and M.resample(df).count() == M.resample(documents).count()
