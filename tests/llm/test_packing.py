import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heristat.llm import packing as P


def check(df):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = P.query(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert not at or max(at.values()) <= 1024
    return got, at


def test_query(spark, documents, no_documents, real):
    check(documents)
    got, at = check(real)
    assert len(at) <= 1.02 * sum(r.length for r in got) / 1024 + 1
    assert P.query(no_documents).count() == 0
    special = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, "  \n\n x"), (4, "don't 12345 ~~~"), (5, "word " * 1023), (6, "word " * 1024), (7, " \x00퟿😀")]
    check(spark.createDataFrame(special, "doc_id long, text string"))


def test_long_runs(spark):
    n, end = 2_000_000, "<|endoftext|>"
    texts = [" " * n, "\n" * n, "ab" * (n // 2), "12" * (n // 2), "!." * (n // 2), "a" + " " * n + "b c", "x  y" + " \n" * n + end + "\t" * n + "'s", "\x85\x1c" + "\u3000" * n + "\x1c"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_stretches_keep_the_ids():
    encode, rng = P.load_encoder(), np.random.default_rng(0)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["a", " ", "  ", "b c", "'s d", "\n", "é x", "1 2", "don't go", "<|endoftext|>", "! ?", "x\u00a0y z", " \u2003", "\x1c ", " \x1d", "\x85 ", "\ufeff ", "\u180e q", "½ ²", "😀 ", "\x00 \x00", " 's", " <|endoftext|> "]
    texts = ["".join(rng.choice(parts, 40)) for _ in range(2000)] + ["", " ", "a", " a"]
    for text in texts:
        cut = list(P.stretches(text, 5))
        assert "".join(cut) == text
        want = tok.encode(text, add_special_tokens=False).ids
        assert [i for x in cut for i in tok.encode(x, add_special_tokens=False).ids] == want == encode(text).tolist()
        assert [i for x in cut for i in encode(x).tolist()] == want
    assert list(P.stretches("")) == [""] and list(P.stretches("ab cd ef", 3)) == ["ab cd", " ef"]


def test_repeated_and_null_ids_are_dealt(spark):
    df = spark.createDataFrame([(None, "word")] * 500 + [(7, "word " * 3000)] * 20, "doc_id long, text string").withColumn("a.b", F.lit(1))
    check(df)
    from heristat.llm.common import partitions

    kept = P.pack(P.pieces(df.repartition(4)).withColumn("a.b", F.lit(1)))
    assert kept.columns[-3:] == ["a.b", "sequence_id", "offset"] and kept.groupBy(F.spark_partition_id()).count().count() == partitions(spark)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 400), max_size=60))
def test_plan_uses_each_piece_once(histogram):
    bins = P.plan(histogram)
    used = Counter()
    for lengths, n in bins:
        assert sum(lengths) <= 1024 and n > 0
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)
    least = -(-sum(k * v for k, v in histogram.items()) // 1024)
    assert sum(n for _, n in bins) <= max(2 * least + 1, sum(v for k, v in histogram.items() if k > 512) + least + 1)


def test_groups_have_equal_cardinality():
    got = P.group_sizes({10: 5, 20: 5, 30: 10}, 4)
    assert got == [(10, 5), (20, 5), (30, 10)]
    assert P.group_sizes({7: 3, 9: 3}, 2) == [(7, 3), (9, 3)] and P.group_sizes({1: 1, 2: 1, 3: 1, 4: 1}, 2) == [(2, 2), (4, 2)]


def test_configurations_are_near_the_optimum():
    got = P.configurations([300, 400, 500], [3000, 2000, 1000], 1024)
    used = np.sum([np.array(c) * n for c, n in got], axis=0)
    assert (used <= [3000, 2000, 1000]).all() and (np.array([3000, 2000, 1000]) - used).sum() <= 10
    assert sum(n for _, n in got) == pytest.approx((3000 * 300 + 2000 * 400 + 1000 * 500) / 1024, rel=0.06)
