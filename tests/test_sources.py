import numpy as np
import pytest

from heristat import cli
from heristat.operators import genotype as G, tables as T
from heristat.sources import bed, files
from heristat.streaming import incremental


def write(path, text):
    path.write_text(text)
    return str(path)


def test_bed_ranges(spark, tmp_path):
    geno = spark.createDataFrame([(i, m, None if (i + m) % 5 == 0 else (i * m) % 3) for i in range(7) for m in range(9)], "i long, m long, d int")
    path = str(tmp_path / "x.bed")
    assert bed.write(geno, path) == 7
    want = {r.m: r.dosage for r in G.snp_major(geno).collect()}
    assert {r.m: r.dosage for r in bed.read(spark, path, 7, 9, size=2).collect()} == want
    part = bed.read(spark, f"file://{path}", 7, 6, start=3, flip=True)
    assert {r.m: r.dosage for r in part.collect()} == {m: [None if x is None else 2 - x for x in want[m]] for m in (3, 4, 5)}
    assert part.rdd.getNumPartitions() == 1
    pruned = bed.read(spark, path, 7, 9, size=1).filter("m >= 2 AND m < 6 AND m <> 4 AND size(dosage) = 7")
    assert {r.m: r.dosage for r in pruned.collect()} == {m: want[m] for m in (2, 3, 5)} and pruned.rdd.getNumPartitions() == 4
    assert [r.m for r in bed.read(spark, path, 7, 9, size=1).filter("m = 8").collect()] == [8] and bed.read(spark, path, 7, 9).filter("m > 8").count() == 0
    with pytest.raises(Exception, match="ends before"):
        bed.read(spark, path, 7, 20).collect()


def test_bed_parts(spark, tmp_path):
    geno = spark.createDataFrame([(i, m, None if (i + m) % 5 == 0 else (i * m) % 3) for i in range(7) for m in range(9)], "i long, m long, d int")
    want = {r.m: r.dosage for r in G.snp_major(geno).collect()}
    path = str(tmp_path / "x")
    assert bed.write_parts(geno, path, 1) == 7 and bed.write_parts(geno, path, 4) == 7  # what was there is replaced
    assert sorted(p.name for p in (tmp_path / "x").iterdir() if p.suffix == ".bed" and p.name[0] != ".") == [f"part-{a:012}-{b:012}.bed" for a, b in ((0, 4), (4, 8), (8, 9))]
    assert {r.m: r.dosage for r in bed.read(spark, path, 7, 9).collect()} == want
    part = bed.read(spark, f"file://{path}", 7, 9, start=2).filter("m < 6")
    assert {r.m: r.dosage for r in part.collect()} == {m: want[m] for m in (2, 3, 4, 5)} and part.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="lacks SNPs"):
        bed.read(spark, path, 7, 10).collect()
    with pytest.raises(Exception, match="out of order|gaps"):
        bed.write(geno.filter("m <> 5"), str(tmp_path / "gap.bed"))


def test_lines_of_many_splits(spark, tmp_path):
    """Lines are numbered by place, whatever the splits, with blank lines, comments and carriage returns between them."""
    text = "".join("\r\n" if k % 7 == 3 else f"# {k}\n" if k % 11 == 5 else f"{k} {'x' * (k % 50)}\r\n" for k in range(3000))
    path = write(tmp_path / "a.txt", text)
    want = [(k, f"{k} {'x' * (k % 50)}") for k in range(3000) if k % 7 != 3 and k % 11 != 5]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7777", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.lines(spark, path, comments=True)
            assert size == before or got.rdd.getNumPartitions() > 5
            assert sorted((r.n, r.line) for r in got.collect()) == [(n, line) for n, (_, line) in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "part-0", "a\nb\n"), write(tmp_path / "d" / "part-1", ""), write(tmp_path / "d" / "part-2", "c\n")
    assert sorted(map(tuple, files.lines(spark, str(tmp_path / "d")).collect())) == [(0, "a"), (1, "b"), (2, "c")]


def test_text_readers(spark, tmp_path):
    assert files.read_fam(spark, write(tmp_path / "a.fam", "f1 1 0 0 1 -9\nf2  1 0 0 2 x\n")).collect()[1][:] == (1, "f2", "1", "0", "0", 2, None)
    b = write(tmp_path / "a.bim", "# note\n1\trs0\t0.5\t10\tA\tC\n")
    assert files.count_bim(spark, b) == 2 and files.read_bim(spark, b).filter("snp = 'rs0'").first().pos == 10
    a = files.read_annot(spark, write(tmp_path / "a.annot", "# note\n1 0\n1 1\n0 0\n"))
    assert sorted(map(tuple, a.collect())) == [(0, 0), (1, 0), (1, 1)]
    t = files.read_table(spark, write(tmp_path / "a.pheno", "FID IID p q\n1 1 0.5 NA\n1 1 -9 2\n"))
    assert sorted(map(tuple, t.collect())) == [(0, 0.5, None), (1, None, 2.0)]
    assert sorted(r.i for r in T.missing_rows(t, ["p", "q"]).collect()) == [0, 1]
    assert files.read_ids(spark, str(tmp_path / "a.pheno")).count() == 2


def test_config(tmp_path):
    c = write(tmp_path / "c.ini", "[settings]\nnum_vec = 7\nstreaming = yes\ncovariate = None\nrate = 0.5\nother = x\n")
    assert files.read_config(c, {"num_vec": 1, "streaming": False, "covariate": "a", "rate": 1.0}) == {"num_vec": 7, "streaming": True, "covariate": None, "rate": 0.5}


def test_reports_round_trip(spark):
    parts = {"sigma": [("g:0", 0.25, 0.5), ("e", 0.5, 0.1)], "h2": [("g:0", -1e-05, 0.125), ("total", 0.5, 0.25)], "enrichment": [("g:0", 1.5, 0.0)]}
    want = sorted((m, files.bracketed(c), x, e) for m, rows in parts.items() for c, x, e in rows) + [("runtime", "", 2.5, None)]
    over = parts | {"h2_overlapping": [("g:0", 9.0, 9.0), ("total", 9.0, 9.0)], "enrichment_overlapping": [("g:0", 9.0, 9.0)]}
    for form, classes in ((parts, False), (parts, True), (over, False)):
        text = files.report(form, classes, (0.3, 0.1, 0.01), 2.5)
        got = files.parse_reports(spark.createDataFrame([("p", text)], "path string, value string")).drop("path")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    text = files.report(parts | {"h2": [("g:0", 0.1, 0.2), ("gxe:0", 0.2, 0.3), ("g:total", 0.1, 0.2), ("gxe:total", 0.2, 0.3), ("total", 0.3, 0.4)]}, True)
    assert "h2_gxe[0] : 0.2 SE : 0.3\nTotal h2 : 0.3 SE: 0.4\nTotal h2_g : 0.1 SE: 0.2\nTotal h2_gxe : 0.2 SE: 0.3" in text


def test_reports_of_the_other_grammar(spark):
    text = "Sigma^2_0: 0.25 SE: 0.5\nh^2 of bin 0 : 0.5 SE: 0.1\nh^2_i/h^2_t of bin 0 : 0.9 SE: 0.9\nEnrichment of bin 0 : 1.5 SE: 0.2\nruntime: 3.5 seconds\n"
    got = files.parse_reports(spark.createDataFrame([("p", text)], "path string, value string")).drop("path")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("sigma", "0", 0.25, 0.5), ("h2", "0", 0.5, 0.1), ("enrichment", "0", 1.5, 0.2), ("runtime", "", 3.5, None)], key=repr)


def test_json_of_a_folder(spark, tmp_path):
    import json

    (tmp_path / "in" / "deep").mkdir(parents=True)
    write(tmp_path / "in" / "a.json", json.dumps({"sigma_ests_total": [0.1, 0.2, 0.7], "h2_total": [0.3, 0.4, 0.7], "enrichment_total": [1.0, 2.0], "runtime": 1.5}, indent=4))
    write(tmp_path / "in" / "deep" / "b.json", json.dumps({"sigma_ests_total": [0.5, 0.6], "h2_total": [0.7, 0.8], "runtime": 2.5}, indent=4))
    got = files.read_values_by_bin(spark, str(tmp_path / "in"), 2)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 0.1, 0.3, 1.0, 1.5), (0, 0.5, 0.7, 0.0, 2.5), (1, 0.2, 0.4, 2.0, 1.5), (1, 0.6, 0.8, 0.0, 2.5)]
    write(tmp_path / "in" / "x.txt", "Sigma^2_g[0] : 0.5  SE : 0.1\nRuntime: 2 seconds\n")
    write(tmp_path / "in" / "deep" / 'y".txt', "Total h2 : 0.5 SE: 0.25\n")
    missing = files.write_summary(spark, str(tmp_path / "in"), str(tmp_path / "summary.json"))
    assert len(missing) == 1 and missing[0].endswith("y%22.txt")
    found = json.loads(spark.read.text(str(tmp_path / "summary.json")).first().value)
    assert [v["runtime"] if "runtime" in v else None for _, v in sorted(found.items(), key=lambda x: "deep" in x[0])] == [2.0, None]
    assert [v["h2"] for v in found.values() if v["h2"]] == [[{"name": "total", "value": 0.5, "SE": 0.25}]]


def test_sinks(spark, tmp_path):
    annot = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (2, 1)], "m long, bin long")
    files.write_annot(annot, 2, str(tmp_path / "annot"))
    assert [r.value for r in spark.read.text(str(tmp_path / "annot")).collect()] == ["1 0", "0 1", "1 1"]
    hot = T.one_hot(spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, c double"), "c")
    files.write_one_hot(hot, str(tmp_path / "hot"))
    assert [r.value for r in spark.read.text(str(tmp_path / "hot")).collect()] == ["1 0", "0 1"]
    assert T.one_hot(spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, c double"), "c", 1).count() == 0
    files.write_pheno(spark.createDataFrame([(0, 1.5)], "i long, y double"), str(tmp_path / "pheno"))
    t = files.trace_rows(spark, np.ones((2, 2, 2)) * 5, np.array([[3, 4], [5, 6]]), 4)
    files.write_trace(t, {"NSAMPLE": 4, "NSNPS": 11, "NBLKS": 1, "NBINS": 2, "K": 3}, str(tmp_path / "t"))
    got = spark.read.csv(str(tmp_path / "t.tr"), header=True, inferSchema=True)
    ld = lambda a, b: a * b / 16
    assert got.columns == ["LD_SUM_0", "LD_SUM_1", "NSNPS_JACKKNIFE"]
    assert [tuple(r) for r in got.collect()] == [tuple(round(x, 3) for x in r) for r in ((ld(3, 3), ld(3, 4), 3), (ld(4, 3), ld(4, 4), 4), (ld(5, 5), ld(5, 6), 5), (ld(6, 5), ld(6, 6), 6))]
    assert files.duplicate_last(spark.createDataFrame([(0, 1.5)], "i long, y double")).columns == ["i", "y", "y_dup"]


def test_z_score_and_impute(spark):
    t = spark.createDataFrame([(0, 1.0, 5.0), (1, -9.0, 5.0), (2, 3.0, 5.0)], "i long, a double, b double")
    assert [r.a for r in T.mean_impute(t, ["a"]).orderBy("i").collect()] == [1.0, 2.0, 3.0]
    assert [r.b for r in T.z_score(t, ["b"]).collect()] == [None] * 3


def test_stream_totals(spark, tmp_path):
    source, sums = tmp_path / "in", tmp_path / "sums"
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.parquet(str(source / "1"))
    spark.createDataFrame([("a", 5)], "k string, v long").write.parquet(str(source / "2"))
    stat = lambda b: b.groupBy("k").sum("v").withColumnRenamed("sum(v)", "v")
    stream = spark.readStream.schema("k string, v long").parquet(f"{source}/*")
    q = stream.writeStream.foreachBatch(incremental.add_batches(str(sums), stat)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.v for r in incremental.totals(spark, str(sums), ["k"], "v").collect()} == {"a": 6, "b": 2}


def test_stream_of_snps(spark, tmp_path):
    """SNPs that arrive in two batches, one of them twice, give the equations of all SNPs at once."""
    from heristat.plans import kernel as K

    rng = np.random.default_rng(5)
    d = rng.binomial(2, 0.4, size=(30, 12))
    rows = lambda ms: spark.createDataFrame([(0, m, d[:, m].tolist(), [m % 2]) for m in ms], K.ROW)
    study = K.Study(rng.normal(size=30), K.components("G+GxE+NxE", 2, 1), 1, 4, env=rng.normal(size=30), segment=13)
    add = incremental.add_snps(str(tmp_path / "s"), study)
    for number, ms in ((0, range(7)), (1, range(7, 12)), (1, range(7, 12))):
        add(rows(ms), number)
    t, q, _ = K.run(spark, rows(range(12)), study)
    got = incremental.equations(spark, str(tmp_path / "s"), study)
    assert np.allclose(got[0], t[-1]) and np.allclose(got[1], q[-1])


def test_command_line(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    d = rng.binomial(2, 0.4, size=(20, 12))
    bed.write(spark.createDataFrame([(i, m, int(d[i, m])) for i in range(20) for m in range(12)], "i long, m long, d int"), str(tmp_path / "g.bed"))
    write(tmp_path / "g.fam", "".join("f 1 0 0 1 -9\n" for _ in range(20)))
    write(tmp_path / "g.bim", "".join(f"1\trs{m}\t0\t{m}\tA\tC\n" for m in range(12)))
    write(tmp_path / "p", "FID IID y\n" + "".join(f"1 {i} {rng.normal()}\n" for i in range(20)))
    out = str(tmp_path / "out")
    cli.main(["-g", str(tmp_path / "g"), "-p", str(tmp_path / "p"), "-o", out, "-b", "2", "-jn", "3", "-k", "2", "-s", "5", "--trace", "--trace_dir", str(tmp_path), "--suppress", "--streaming"])
    kept = {(r.metric, r.component): r.estimate for r in files.read_results(spark, f"{out}.json").collect()}
    assert {m for m, _ in kept} == {"sigma", "h2", "enrichment", "h2_overlapping", "enrichment_overlapping"}
    logged = {(r.metric, r.component): r.value for r in files.read_reports(spark, out + "/*").collect()}
    assert logged.pop(("runtime", "")) > 0
    assert logged == {(m, files.bracketed(c)): x for (m, c), x in kept.items() if not m.endswith("overlapping")}
    assert spark.read.csv(str(tmp_path / "run_p.tr"), header=True).count() == 4 * 2
    assert spark.read.csv(str(tmp_path / "run_p.MN"), header=True).first()[:] == ("20", "12", "3", "2", "2")


def test_benchmark_and_binary_traits(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    d = rng.binomial(2, 0.4, size=(20, 12))
    bed.write(spark.createDataFrame([(i, m, int(d[i, m])) for i in range(20) for m in range(12)], "i long, m long, d int"), str(tmp_path / "g.bed"))
    write(tmp_path / "g.fam", "".join("f 1 0 0 1 -9\n" for _ in range(20)))
    write(tmp_path / "g.bim", "".join(f"1\trs{m}\t0\t{m}\tA\tC\n" for m in range(12)))
    (tmp_path / "pheno" / "bin_2").mkdir(parents=True)
    for n in range(3):
        write(tmp_path / "pheno" / "bin_2" / f"{n}.phen", "FID IID y z\n" + "".join(f"1 {i} {rng.normal()} {i % 2 + 1}\n" for i in range(20)))
    same = ["-g", str(tmp_path / "g"), "-b", "2", "-jn", "3", "-k", "2"]
    cli.main([*same, "-p", str(tmp_path), "--benchmark_runtime"])
    assert "runtime: " in capsys.readouterr().out
    cli.main([*same, "-p", str(tmp_path / "pheno" / "bin_2" / "0.phen"), "-o", str(tmp_path / "out"), "--samp_prev", "0.5", "--pop_prev", "0.1", "--debug"])
    out = capsys.readouterr().out
    assert out.count("Liability-scale") == 1 and out.count("Variance components") == 2 and "num_vec: 2" in out  # only z is binary
