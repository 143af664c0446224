import numpy as np

from genonet import cli
from genonet.operators.overlap import KEY
from genonet.sources.catalog import Catalog


def test_build_map_and_score(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((4, 24))
    names = [f"G{i:02d}" for i in range(24)]
    values = np.exp(np.array([base[i % 4] + 0.5 * rng.standard_normal(24) for i in range(24)]))
    (tmp_path / "g.gff").write_text("".join(f"{i % 3}\tx\tgene\t{i * 1000 + 1}\t{i * 1000 + 400}\t.\t+\t.\tID={n}\n" for i, n in enumerate(names)))
    (tmp_path / "m.tsv").write_text("\t".join(f"A{k}" for k in range(24)) + "\n" + "".join(n + "\t" + "\t".join(map(str, v)) + "\n" for n, v in zip(names, values.tolist(), strict=True)))
    (tmp_path / "s.tsv").write_text("Trait\tCHR\tPOS\tpval\n" + "".join(f"t\t{i % 3}\t{i * 1000 + 200}\t0.0{i % 9 + 1}\n" for i in range(0, 24, 4)) + "skip\t1\t5\t0.5\n")
    root = str(tmp_path / "data")
    run = lambda *a: cli.main(["--catalog", root, *a], spark)
    run("build-refgen", str(tmp_path / "g.gff"), "ref", "genome")
    run("build-cob", str(tmp_path / "m.tsv"), "net", "network", "ref", "--zscore-cutoff", "1.5", "--skip-quantile")
    run("build-gwas", str(tmp_path / "s.tsv"), "gwas", "snps", "ref", "--skip-traits", "skip", "--query", "pval < 0.5")
    run("snp2gene", "gwas", "net", "--candidate-window-size", "1500", "--candidate-flank-limit", "1", "--out", str(tmp_path / "genes"))
    run("overlap", "net", "density", "--gwas", "gwas", "--terms", "t", "--candidate-window-size", "1500", "--candidate-flank-limit", "1", "--num-bootstraps", "10", "--out", str(tmp_path / "out"))
    run("overlap", "net", "locality", "--gwas", "gwas", "--candidate-window-size", "1500", "--candidate-flank-limit", "1", "--num-bootstraps", "5", "--snp2gene", "strongest", "--strongest-attr", "pval", "--out", str(tmp_path / "out2"))
    run("overlap", "net", "density", "--genes", "g00,g04 g08", "g12", "nosuch", "--num-bootstraps", "auto", "--out", str(tmp_path / "out3"))
    run("overlap", "net", "density", "--gwas", "gwas", "--candidate-window-size", "1500", "--candidate-flank-limit", "1", "--dry-run", "--out", str(tmp_path / "none"))
    run("neighbors", "net", "g00", "--out", str(tmp_path / "near"))
    run("health", "net", "--out", str(tmp_path / "health"))
    run("list")
    catalog = Catalog(spark, root)
    assert {(r.type, r.name) for r in catalog.datasets().collect()} == {("RefGen", "ref"), ("COB", "net"), ("GWAS", "gwas"), ("Overlap", "gwas"), ("Overlap", "GeneList")}
    kept = catalog.load("Overlap", "gwas", "results")
    assert {(r.method, r.snp2gene, r.num_bootstraps) for r in kept.select("method", "snp2gene", "num_bootstraps").distinct().collect()} == {("density", "effective", 10), ("locality", "strongest", 5)}
    assert kept.count() == kept.select(*KEY).distinct().count() and not (tmp_path / "none").exists()
    own = catalog.load("Overlap", "GeneList", "results")
    assert own.count() == 4 and own.first().num_bootstraps in (50, 100, 200, 400, 800, 1000) and own.first().term_pvalue < 0.2
    assert catalog.load("COB", "net", "edges").count() == 24 * 23 // 2
    assert {r.term for r in catalog.load("GWAS", "gwas", "snps").collect()} == {"t"}
    read = lambda p: spark.read.csv(str(tmp_path / p), sep="\t", header=True)
    assert read("genes").count() > 0 and read("near").select("gene").distinct().count() <= 1
    assert read("out").where("term = 't'").count() > 0
    assert read("health_qc_gene").where("chrom = 'TOTAL'").count() == 1
    merges, leaves = catalog.load("COB", "net", "merges"), catalog.load("COB", "net", "leaves")
    assert merges.count() == 23 and merges.agg({"size": "max"}).first()[0] == 24 and sorted(r.place for r in leaves.collect()) == list(range(24))
    summary = {r._c0: r._c1 for r in spark.read.csv(str(tmp_path / "health_summary"), sep="\t").collect()}
    assert {f"{a} to {b} {w}" for a, b in (("truncated_power_law", "power_law"), ("truncated_power_law", "exponential"), ("power_law", "exponential")) for w in ("ratio", "p")} <= set(summary)
    assert read("health_heat_map").count() == 24 * 24 and read("health_scores").where("kind = 'r'").count() > 3
    run("cistrans", "net", "--cis-distance", "5000", "--points", "50", "--out", str(tmp_path / "cis"))
    assert read("cis").count() == 50 and {r._c0 for r in spark.read.csv(str(tmp_path / "cis_summary"), sep="\t").collect()} == {"n_cis", "n_trans", "u", "p"}
    run("locality", "net", "--genes", "g00,g04,g08", "--num-bootstraps", "5", "--out", str(tmp_path / "loc"))
    assert read("loc").count() == 3 and set(read("loc").columns) >= {"local", "global", "fitted"}
    run("layout", "net", "--iterations", "2", "--out", str(tmp_path / "places"))
    assert read("places").count() == catalog.load("Coordinates", "net", "coordinates").count() > 3
    run("filter-refgen", "ref", "some", "three genes", "--genes", "g00", "G05", "nosuch")
    assert catalog.load("RefGen", "some", "genes").count() == 2 and catalog.load("RefGen", "some", "chromosomes").count() == 3
    run("build-cob", str(tmp_path / "m.tsv"), "dry", "network", "ref", "--dry-run")
    assert not catalog.exists("COB", "dry")
    (tmp_path / "go.obo").write_text("[Term]\nid: T1\nname: one\n\n[Term]\nid: T2\nname: two\nis_a: T1 ! one\n")
    (tmp_path / "go.tsv").write_text("".join(f"{n}\tT{1 + i % 2}\n" for i, n in enumerate(names)))
    run("build-go", str(tmp_path / "go.tsv"), "go", "terms", str(tmp_path / "go.obo"), "ref")
    run("overlap", "net", "density", "--go", "go", "--num-bootstraps", "5", "--out", str(tmp_path / "out4"))
    assert {r.term for r in read("out4").select("term").distinct().collect()} == {"T1", "T2"}
    run("simulate-gwas", "go", "ref", "--missing-rate", "50", "--out", str(tmp_path / "sim"))
    assert read("sim").where("term = 'T2'").count() == 6
    run("health", "net", "--go", "go", "--num-bootstraps", "3", "--min-term-size", "2", "--out", str(tmp_path / "health2"))
    assert read("health2_GO").count() == 2
    run("rm", "COB", "net")
    assert not catalog.exists("COB", "net")
