import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from heristat.llm import secrets, simhash, toxicity
from heristat.llm.common import materialize

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, labels = [n for n, _ in C.STAGES], spark.read.parquet(f"{DIR}/labels.parquet")
    assert len(names) == 5
    clean = materialize(C.drop_toxic(spark, docs, DIR), "t")
    toxic = {r.doc_id for r in toxicity.query(docs, labels).filter("toxic = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    single = materialize(C.drop_near_copies(spark, clean, DIR), "t")
    groups = [r.component_id for r in simhash.query(clean).collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups))
    blank = materialize(C.redact_secrets(spark, single, DIR), "t")
    assert blank.count() == single.count() and secrets.query(blank).filter("n_assign + n_access + n_hex > 0").count() == 0
    mixed = materialize(C.mix_sources(spark, blank, DIR), "t")
    for df in (clean, single, blank, mixed):
        assert df.schema == docs.schema
    packed = C.pack_sequences(spark, mixed, DIR)
    assert packed.filter("piece = 0").count() == mixed.count()
    assert sorted(map(tuple, C.run(spark, DIR).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_anything(spark, documents, no_documents, k):
    stage = C.STAGES[k][1]
    got = stage(spark, documents, DIR)
    assert got.count() and stage(spark, no_documents, DIR).count() == 0
    if k < 4:
        assert got.columns == documents.columns
        named = documents.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(None).cast("string"))
        assert stage(spark, named, DIR).columns == named.columns


def slow_pipeline(docs, model):
    """The stages up to the mix in plain Python: the documents left, and their words."""
    import re

    from tests.llm.test_secrets import slow as spans_of
    from tests.llm.test_simhash import slow, slow_groups

    kept = [d for d in docs if model.at_least((d["text"] or "").encode())[0] < toxicity.THRESHOLD]
    named = slow_groups([(d["doc_id"], slow(d["text"] or "")) for d in kept])
    kept = [d for d in kept if d["doc_id"] in {c for _, _, c in named}]
    held = {}
    for d in kept:
        for *_, v in secrets.scan_text(d["text"] or ""):
            held.setdefault(v, set()).add((d["source"], d["doc_id"]))
    out = []
    for d in kept:
        text = d["text"] or ""
        spans = [(s, e) for s, _, e in spans_of(text)] + [(s, e) for k, s, e, v in secrets.scan_text(text) if k == 3 and len({o for o, _ in held[v]}) <= 1 and len(held[v]) <= 20]
        at, parts = 0, []
        for s, e in sorted(spans):
            if s >= at:
                parts += [text[at:s], "[secret]"]
            at = max(at, e)
        out.append(d | {"text": "".join(parts) + text[at:]})
    words = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in out}
    return out, words


def test_run_against_plain_python(spark):
    """run()'s rows against brute-force groups, redaction, water filling and tokenizers' cuts."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_mixing import water

    docs = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    model = toxicity.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    left, words = slow_pipeline(docs, model)
    got = C.run(spark, DIR).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for d in left:
        ids = np.array([*tok.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        pieces[d["doc_id"]] = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    taken, rows = {}, {}
    for r in got:
        rows.setdefault((r.doc_id, r.piece), []).append((r.piece, r.start, r.length, r.ids_crc32))
        taken[r.doc_id] = taken.get(r.doc_id, 0) + (r.piece == 0)
    for d, n in taken.items():  # whole documents, each as often as it is taken
        assert n <= 3 and all(rows[d, p[0]] == [p] * n for p in pieces[d]) and len([k for k in rows if k[0] == d]) == len(pieces[d])
    sizes, given, largest = {}, {}, {}
    for d in left:
        s, n = d["source"], words[d["doc_id"]]
        sizes[s], given[s], largest[s] = sizes.get(s, 0) + n, given.get(s, 0) + n * taken.get(d["doc_id"], 0), max(largest.get(s, 0), n)
    target = water(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    for s in sizes:
        assert abs(given[s] - target[s]) <= largest[s] / 2 + 1e-6
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024


def test_nothing_is_left_behind(spark):
    """After a run only what its result reads is stored; clean() deletes that too."""
    import os

    from heristat.llm.common import clean, own_dir

    clean(spark)
    assert C.run(spark, DIR).count()
    folder = own_dir(spark).removeprefix("file://")
    assert sorted({x.rsplit("-", 1)[0] for x in os.listdir(folder)} - {"hot"}) == ["counts", "pieces", "source_mixing"]
    clean(spark)
    assert not os.path.exists(folder)


def test_ids_at_both_ends_pass(spark, tmp_path):
    ends = [-(1 << 63), -1, 0, 5 * 10**18, 5 * 10**18 + 1, (1 << 63) - 1]
    docs = spark.createDataFrame([(d, " ".join(f"w{i}x{k}" for k in range(50)), "en", "s", 1) for i, d in enumerate(ends)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == set(ends)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
