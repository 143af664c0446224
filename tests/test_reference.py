import math
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from genonet import queries
from genonet.functions import stats
from genonet.operators import coexpression as cx
from genonet.operators import expression as ex
from genonet.operators import graph, loci, ontology, overlap, ranges
from genonet.plans import jobs
from genonet.sources import readers, records, writers
from genonet.sources.catalog import Catalog, DatasetExistsError, GeneAbsentError

LOCI = [("1", 100, 500, 0, 0), ("1", 400, 700, 0, 5), ("2", 100, 200, 100, 0), ("2", 300, 500, 100, 5), ("3", 100, 100, 50, 5), ("3", 200, 200, 50, 0), ("4", 100, 100, 80, 1), ("4", 200, 200, 80, 2), ("4", 300, 300, 80, 3), ("4", 400, 400, 10, 4)]


@pytest.fixture(scope="module")
def term(spark):
    return spark.createDataFrame([("t", f"l{i}", *r[:4], float(r[4])) for i, r in enumerate(LOCI)], "term string, id string, chrom string, start long, end long, window long, score double")


def test_effective_loci(term):
    rows = loci.effective_loci(term).orderBy("chrom", "start").collect()
    assert [r.end - r.start + 1 for r in rows] == [601, 401, 101, 201, 1]
    assert loci.effective_loci(term, 150).count() == 4
    assert loci.effective_loci(term, 150, bin_size=150).count() == 4


def test_strongest_and_flanking(term):
    rows = loci.strongest_loci(term, F.col("score"), lowest=False).orderBy("chrom", "island_start").collect()
    assert [r.start for r in rows] == [400, 300, 100, 300, 400]
    assert loci.flanking_loci(term, "4", 250, 100).count() == 2
    assert loci.flanking_loci(term, "4", 250, 400).count() == 4


def test_locus_distance(spark):
    row = spark.range(1).select(*[loci.locus_distance(*[F.lit(x) for x in c]).alias(n) for n, c in (("a", ("1", 100, 200, "1", 300, 400)), ("b", ("1", 1, 2, "2", 1, 2)), ("c", ("1", 5, 9, "1", 5, 9)))]).first()
    assert (row.a, row.b, row.c) == (99.0, math.inf, 0.0)


def test_zero_window(spark, term):
    genes = term.select("id", "chrom", "start", "end")
    with pytest.raises(ranges.ZeroWindowError):
        ranges.upstream_genes(term, genes, 0)


def test_hypergeometric(spark):
    lf = stats.log_factorials(spark, 200)
    got = lf.select(*[stats.hypergeom_sf(F.lit(k), F.lit(100), F.lit(5), F.lit(10), F.col("lf")).alias(f"k{k}") for k in (3, 4, 6)]).first()
    assert got.k3 == pytest.approx(0.0066379129, abs=1e-9) and got.k4 == pytest.approx(0.00025438479, abs=1e-9) and got.k6 == 0
    assert [stats.condensed_index(i, j, 4) for i in range(4) for j in range(i + 1, 4)] == list(range(6))


def test_running_total_and_ranks(spark):
    rows = spark.createDataFrame([(int(i * 37 % 101), 1) for i in range(101)], "v int, n int")
    assert {r.v: r.t for r in stats.running_total(rows, "v", "n", "t", 7).collect()} == {i: i + 1 for i in range(101)}
    ties = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double").select(stats.average_rank(F.col("v")).alias("r")).collect()
    assert sorted(r.r for r in ties) == [1, 2.5, 2.5, 4]


def test_correlation_with_missing_values():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((5, 30)), rng.standard_normal((4, 30))
    a[0, :21] = np.nan
    b[1, 3:9] = np.nan
    b[2] = 7.0
    r = cx.correlate(a, b)
    for i in range(5):
        for j in range(4):
            both = ~(np.isnan(a[i]) | np.isnan(b[j]))
            x, y = a[i][both], b[j][both]
            if both.sum() < 10 or not y.std():
                assert np.isnan(r[i, j])
            else:
                assert r[i, j] == pytest.approx(np.corrcoef(x, y)[0, 1])


@pytest.fixture(scope="module")
def network(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 25))
    rows = [(f"G{i:02d}", [float(x) for x in base[i % 6] + 0.6 * rng.standard_normal(25)]) for i in range(48)]
    vectors = spark.createDataFrame(rows, "gene string, values array<double>")
    genes = spark.createDataFrame([(f"G{i:02d}", str(i % 3), i * 1000, i * 1000 + 400) for i in range(48)], "id string, chrom string, start long, end long")
    pairs = cx.pair_correlation(vectors, block=10)
    edges = cx.with_distance(cx.score_edges(pairs, 1.5), genes).cache()
    return vectors, genes, edges


def test_network_invariants(network):
    vectors, genes, edges = network
    assert edges.count() == 48 * 47 // 2 and edges.where("gene_a >= gene_b").count() == 0
    v = {r.gene: r["values"] for r in vectors.collect()}
    for r in edges.limit(50).collect():
        assert r.r == pytest.approx(np.corrcoef(v[r.gene_a], v[r.gene_b])[0, 1])
    stats_row = edges.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    assert stats_row.m == pytest.approx(0, abs=1e-9) and stats_row.s == pytest.approx(1)
    total = cx.degree(edges, genes.select(F.col("id").alias("gene"))).agg(F.sum("degree")).first()[0]
    assert total == 2 * edges.where("significant").count()
    assert edges.where("distance = double('Infinity')").count() == 3 * 16 * 16


def test_density_matches_brute_force(spark, network):
    _, _, edges = network
    genes = spark.createDataFrame([(f"G{i:02d}",) for i in (0, 6, 12, 18, 18)], "gene string")
    pick = {"G00", "G06", "G12", "G18"}
    scores = [r.score for r in edges.collect() if r.gene_a in pick and r.gene_b in pick]
    row = cx.density(edges, genes).first()
    assert row.num_edges == 6 and row.density == pytest.approx(np.mean(scores) * math.sqrt(6))


def test_locality_goes_through_the_origin(spark):
    rows = spark.createDataFrame([("a", 9, 242), ("b", 10, 449), ("c", 10, 675), ("d", 10, 776), ("e", 0, 2)], "gene string, local long, global long")
    b = sum(x * y for x, y in ((9, 242), (10, 449), (10, 675), (10, 776), (0, 2))) / sum(y * y for y in (242, 449, 675, 776, 2))
    for r in cx.regressed(rows).collect():
        assert r.fitted == pytest.approx(b * r["global"]) and r.resid == pytest.approx(r.local - r.fitted)


def test_clusters_and_tree(network):
    _, _, edges = network
    found = {r.gene: r.cluster for r in graph.markov_clusters(edges).collect()}
    groups = {}
    for g, c in found.items():
        groups.setdefault(c, set()).add(int(g[1:]) % 6)
    assert len(found) > 40 and all(len(x) == 1 for x in groups.values())
    tree = graph.spanning_tree(edges).collect()
    assert len(tree) == 47
    order, top, total = sorted(((r.score, r.gene_a, r.gene_b) for r in edges.collect()), reverse=True), {}, 0.0
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for s, a, b in order:
        if find(a) != find(b):
            top[find(a)] = find(b)
            total += s
    assert sum(r.w for r in tree) == pytest.approx(total)


def test_quality_control_bounds(spark):
    rows = [(g, f"A{k}", v) for g, values in {"OK": [6, 1, 1, 1, 1], "GAP": [6, 0.001, 1, 1, 1], "LOW": [1, 1, 1, 1, 1]}.items() for k, v in enumerate(values)]
    expr = spark.createDataFrame([(g, a, float(v)) for g, a, v in rows], "gene string, accession string, value double")
    kept, gene, accession = ex.quality_control(expr)
    assert {r.gene: r.pass_all for r in gene.collect()} == {"OK": True, "GAP": False, "LOW": False}  # a fifth missing is not under a fifth
    assert {r.gene for r in kept.collect()} == {"OK"} and all(r.pass_all for r in accession.collect())
    with pytest.raises(TypeError):
        ex.normalize(spark.createDataFrame([("g", "a", 5.0), ("g", "b", 5000.0)], "gene string, accession string, value double"))


def test_fdr_grid_matches_the_loop(spark):
    rng = np.random.default_rng(3)
    real, boots = rng.normal(0.5, 1, 30), rng.normal(0, 1, (8, 30))
    r = spark.createDataFrame([(f"g{i}", float(z)) for i, z in enumerate(real)], "gene string, zscore double")
    b = spark.createDataFrame([(k, float(z)) for k in range(8) for z in boots[k]], "iter int, zscore double")
    got = {x.gene: (x.fdr, x.num_real) for x in overlap.fdr_grid(r, b, 8).collect()}
    want = {f"g{i}": (None, None) for i in range(30)}
    for t in np.arange(0, int(real.max()) + 1, 0.25):
        n, m = int((real >= t).sum()), float((boots >= t).sum(1).mean())
        for i in np.flatnonzero(real >= t):
            want[f"g{i}"] = (m / n, n)
    assert {g: (None if f is None else pytest.approx(f), n) for g, (f, n) in want.items()} == got


OBO = """format-version: 1.2

[Term]
id: GO:1
name: root
namespace: biological_process
def: "all" [x]

[Term]
id: GO:2
name: two
alt_id: GO:9
is_a: GO:1 ! root
is_obsolete: true

[Term]
id: GO:3
name: three
is_a: GO:2 ! two
is_a: GO:1

[Typedef]
id: part_of
name: part of
"""


def test_files(spark, tmp_path):
    (tmp_path / "go.obo").write_text(OBO)
    (tmp_path / "go.tsv").write_text("!Protein_id\tGO_id\na_1\tGO:3\nb\tGO:9\n# c\tGO:1\nc\tGO:2\n")
    (tmp_path / "g.gff").write_text("##gff\n1\tx\tchromosome\t1\t900\t.\t.\t.\tID=1\n1\tx\tgene\t5\t95\t.\t+\t.\tID=a;Note=k=v\n2\tx\tgene\t5\t50\t.\t-\t.\tID=\"b\";Name=B\n")
    (tmp_path / "m.tsv").write_text("A1\tA2\na\t1\t2.5\nb\t\t4\n")
    terms, rels, alts = readers.read_obo(spark, str(tmp_path / "go.obo"))
    assert {r.id: r.is_obsolete for r in terms.collect()} == {"GO:1": False, "GO:2": True, "GO:3": False}
    own = ontology.resolve_alts(readers.read_gene_terms(spark, str(tmp_path / "go.tsv")), alts)
    assert {tuple(r) for r in ontology.propagate(own, rels).collect()} == {("GO:3", "A"), ("GO:2", "A"), ("GO:1", "A"), ("GO:2", "B"), ("GO:1", "B"), ("GO:2", "C"), ("GO:1", "C")}
    genes, attrs, chroms = readers.genome_from_gff(readers.read_gff(spark, str(tmp_path / "g.gff")))
    assert {tuple(r) for r in genes.collect()} == {("A", "1", 5, 95), ("B", "2", 5, 50)}
    assert {tuple(r) for r in chroms.collect()} == {("1", 900), ("2", 50)}
    assert ("A", "Note", "k=v") in {tuple(r) for r in attrs.collect()}
    assert {tuple(r) for r in readers.read_matrix(spark, str(tmp_path / "m.tsv")).collect()} == {("A", "A1", 1.0), ("A", "A2", 2.5), ("B", "A1", None), ("B", "A2", 4.0)}
    gwas = spark.createDataFrame([("a", "chr1", 100, "snp1", 0.05), ("b", "chr3", 300, "snp3", 0.01)], "Trait string, CHR string, POS int, id string, pval double")
    snps = readers.gwas_from_dataframe(gwas, "Trait", "CHR", "POS", id_col="id")
    assert {(r.term, r.attr["pval"], r.start) for r in snps.collect()} == {("a", "0.05", 100), ("b", "0.01", 300)}


def test_catalog(spark, tmp_path):
    catalog, df = Catalog(spark, str(tmp_path / "c")), spark.range(3)
    catalog.save("Expr", "one", "first", {"t": df})
    with pytest.raises(DatasetExistsError):
        catalog.save("Expr", "one", "again", {"t": df})
    catalog.redescribe("Expr", "one", "better")
    catalog.move("Expr", "one", "two")
    assert [(r.name, r.description) for r in catalog.datasets("Expr", "t%").collect()] == [("two", "better")]
    assert catalog.load("Expr", "two", "t").count() == 3
    catalog.remove("Expr", "two")
    assert not catalog.exists("Expr", "two")


def test_jobs(spark, network, tmp_path):
    vectors, genes, edges = network
    raw = vectors.select("gene", F.posexplode("values").alias("a", "value")).select("gene", F.format_string("A%02d", "a").alias("accession"), F.exp("value").alias("value"))
    net = jobs.build_network(raw, genes, zscore_cutoff=1.5, min_expr=0.0, min_single_sample=0.0, quantile=True)
    assert net.log == ["raw", "quality_control", "normalize", "quantile"] and net.edges.count() == 48 * 47 // 2
    assert jobs.qc_report(net).where("chrom = 'TOTAL'").first().pass_all == 48
    snps = spark.createDataFrame([("t", f"s{i}", str(i % 3), i * 1000 + 200, i * 1000 + 200) for i in (0, 6, 12, 18, 24, 30)], "term string, id string, chrom string, start long, end long")
    rows = jobs.run_overlap(net, snps, window=1500, flank=1, iterations=20).collect()
    assert rows and all(0 <= r.term_pvalue <= 1 for r in rows)
    assert jobs.run_overlap(net, snps, "locality", 1500, 1, 10).count() > 0
    terms = genes.select(F.concat(F.lit("T"), (F.substring("id", 2, 2).cast("int") % 6).cast("string")).alias("term"), F.col("id").alias("gene"))
    health = jobs.go_health(net, terms, 5, 20, 20).collect()
    assert len(health) == 6 and all(r.pvalue == 0 and r.significant for r in health)
    kept = edges.where("significant").limit(5).withColumn("gene_b", F.concat(F.col("gene_b"), F.lit("<&\"")))
    writers.write_graphml(kept, str(tmp_path / "n.graphml"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "n.graphml").glob("part-*.txt")))
    root = ElementTree.fromstring(text.encode())
    assert [x.tag.split("}")[1] for x in root[1]] == ["node"] * len({x for r in kept.collect() for x in (r.gene_a, r.gene_b)}) + ["edge"] * 5
    nodes, links = writers.network_json(edges.where("significant"), genes.select(F.col("id").alias("gene")), max_edges=20, remove_orphans=True)
    assert links.count() == 20 and nodes.count() <= 40


def test_streaming_merge(spark, tmp_path):
    from genonet.streaming import latest, merge_stream

    rows = lambda v: spark.createDataFrame([("k", v)], "k string, v int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for v in (1, 2, 3):
        rows(v)
        merge_stream(spark.readStream.schema("k string, v int").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    assert [r.v for r in latest(spark, str(tmp_path / "out")).collect()] == [3]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v=1", "v=2"]


def test_large_terms_stay(spark, tmp_path):
    """Terms of more than 300 genes, which only enrichment leaves out."""
    n = 4030
    spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 10).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = {(r.source_term, r.target_term): r.num_common for r in queries.adjacency(spark, str(tmp_path)).collect()}
    assert pairs == {(f"L{a}", f"M{b}"): n // 130 for a in range(10) for b in range(13)}
    assert {(r.term, r.size) for r in queries.terms_containing(spark, str(tmp_path)).collect()} == {(f"M{b}", n // 13) for b in range(13)}


def test_names(spark):
    name = "A" * 89 + "middle of a long name" + "0123456789"
    rows = spark.createDataFrame([(name,), ("1 day-old*",), ("_x.y_",), ("ok_1",)], "n string").select("n", ex.clean_accession(F.col("n")).alias("c"), ex.clean_accession(F.col("n"), False).alias("raw")).collect()
    assert [r.c for r in rows] == ["A" * 89 + "___" + "012345678", "Exp_1_day_old", "x_y", "ok_1"] and len(rows[0].raw) == len(name)
    expr = lambda rows: spark.createDataFrame(rows, "gene string, accession string, value double")
    assert {(r.gene, r.accession) for r in ex.cleaned(expr([("g/1", "a b", 1.0), ("g/1", "2", 1.0)])).collect()} == {("G1", "a_b"), ("G1", "Exp_2")}
    with pytest.raises(ex.GeneNameError):
        ex.cleaned(expr([("g1", "a", 1.0), ("G1", "a", 2.0)]))
    with pytest.raises(ex.GeneNameError):
        ex.cleaned(expr([("g1", "a", 1.0), ("g1", "a", 2.0)]))
    with pytest.raises(ex.AccessionNameError):
        ex.cleaned(expr([("g1", "a b", 1.0), ("g1", "a.b", 2.0)]))
    assert ex.without_missing_accessions(expr([("g", "a", 1.0), ("h", "a", None), ("g", "b", 1.0)])).count() == 1


def test_matrix_index_and_repeated_accessions(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("A1\tid\tA2\n1\tg\t2\n")
    assert {tuple(r) for r in readers.read_matrix(spark, str(tmp_path / "m.tsv"), index_col="id").collect()} == {("G", "A1", 1.0), ("G", "A2", 2.0)}
    (tmp_path / "n.tsv").write_text("id\tA1\tA1\ng\t1\t2\n")
    with pytest.raises(ex.AccessionNameError):
        readers.read_matrix(spark, str(tmp_path / "n.tsv"))


def test_records(spark):
    genes = spark.createDataFrame([("A", "1", 1, 5), ("B", "1", 7, 9)], "id string, chrom string, start long, end long")
    attrs = spark.createDataFrame([("A", "k", "v"), ("B", "k", "w")], "id string, key string, val string")
    aliases = spark.createDataFrame([("al", "A")], "alias string, id string")
    new = spark.createDataFrame([("b", "2", 1, 2), ("c", "1", 3, 4)], "id string, chrom string, start long, end long")
    other = spark.createDataFrame([("al", "C"), ("be", "B"), ("no", "A")], "alias string, id string")
    g, a, al = records.add_genes(genes, attrs, new, spark.createDataFrame([("b", "k", "x")], "id string, key string, val string"), aliases, other)
    assert {tuple(r) for r in g.collect()} == {("A", "1", 1, 5), ("B", "2", 1, 2), ("C", "1", 3, 4)}
    assert {tuple(r) for r in a.collect()} == {("A", "k", "v"), ("B", "k", "x")} and {tuple(r) for r in al.collect()} == {("al", "A"), ("be", "B")}
    assert {tuple(r) for r in records.add_chromosomes(spark.createDataFrame([("1", 5)], "id string, length long"), spark.createDataFrame([("1", 9), ("2", 3)], "id string, length long")).collect()} == {("1", 9), ("2", 3)}
    terms, own = spark.createDataFrame([("t", "old")], "id string, desc string"), spark.createDataFrame([("t", "A")], "term string, gene string")
    more, more_loci = spark.createDataFrame([("t", "new")], "id string, desc string"), spark.createDataFrame([("t", "B"), ("t", "B")], "term string, gene string")
    with pytest.raises(records.RecordExistsError):
        records.add_terms(terms, own, more, more_loci)
    t, l = records.add_terms(terms, own, more, more_loci, overwrite=True)
    assert [tuple(r) for r in t.collect()] == [("t", "new")] and [tuple(r) for r in l.collect()] == [("t", "B")]
    t, l = records.del_terms(t, l, terms)
    assert t.count() == l.count() == 0
    names = spark.createDataFrame([("a",), ("AL",), ("zz",)], "name string")
    assert {(r.name, r.gene) for r in records.from_ids(names, genes, aliases).collect()} == {("a", "A"), ("AL", "A")}
    with pytest.raises(GeneAbsentError):
        records.from_ids(names, genes, aliases, check_shape=True)
    both = spark.createDataFrame([("a",), ("b",)], "gene string")
    assert [tuple(r) for r in records.aliases_of(both, aliases).collect()] == [("A", ["al"])]
    assert {(r.gene, *r.desc) for r in records.annotations_of(both, spark.createDataFrame([("A", "y"), ("A", "x"), ("C", "z")], "id string, desc string")).collect()} == {("A", "x", "y")}
    assert records.random_terms(terms, 3).count() == 1


def test_components_and_trees_of_odd_graphs(spark, monkeypatch):
    """A path in order of names, a hub, a cycle, loops and lone nodes."""
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 380)] + [(400, 401), (401, 402), (402, 400), (500, 500)] + [tuple(map(int, rng.integers(600, 700, 2))) for _ in range(60)]
    df = spark.createDataFrame([(a, b, float((a * 7 + b * 13) % 11)) for a, b in edges], "gene_a long, gene_b long, score double")
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    want = {x: find(x) for x in list(top)} | {999: 999}
    assert {r.node: r.component for r in graph.components(df, spark.createDataFrame([(999,), (5,)], "node long")).collect()} == want
    monkeypatch.setattr(graph, "LOCAL", 5)  # the way of large graphs
    assert {r.node: r.component for r in graph.components(df, spark.createDataFrame([(999,), (5,)], "node long")).collect()} == want
    shrunk = {tuple(r) for r in graph.spanning_tree(df).collect()}
    monkeypatch.undo()
    tree = graph.spanning_tree(df).collect()
    assert shrunk == {tuple(r) for r in tree}
    top.clear()
    weight = count = 0
    for w, a, b in sorted((((a * 7 + b * 13) % 11, a, b) for a, b in edges if a != b), reverse=True):
        if find(a) != find(b):
            top[find(a)] = find(b)
            weight, count = weight + w, count + 1
    assert len(tree) == count and sum(r.w for r in tree) == weight
    assert graph.components(df.limit(0)).count() == graph.spanning_tree(df.limit(0)).count() == 0


def test_markov_clusters_against_dense_matrices(spark):
    rng = np.random.default_rng(11)
    n = 30
    pairs = {(i, j): float(rng.uniform(1, 3)) for i in range(n) for j in range(i + 1, n) if (i % 3 == j % 3 and rng.random() < 0.7) or rng.random() < 0.05}
    df = spark.createDataFrame([(f"g{i:02d}", f"g{j:02d}", w, True) for (i, j), w in pairs.items()], "gene_a string, gene_b string, score double, significant boolean")
    m = np.eye(n)
    for (i, j), w in pairs.items():
        m[i, j] = m[j, i] = w
    m /= m.sum(0)
    for _ in range(60):
        m = (m @ m) ** 2
        m[m < 1e-4] = 0
        m /= m.sum(0)
    want = {frozenset(f"g{k:02d}" for k in range(n) if find == tuple(np.flatnonzero(m[:, k] > 1e-6))) for find in {tuple(np.flatnonzero(m[:, k] > 1e-6)) for k in range(n)}}
    found = {}
    for r in graph.markov_clusters(df).collect():
        found.setdefault(r.cluster, set()).add(r.gene)
    assert {frozenset(x) for x in found.values()} == want


def test_random_sets(spark):
    """Sets of one size without repeats; blocks stand side by side on a chromosome, are as many as asked for, and share no gene."""
    genes = spark.createDataFrame([(f"g{i:03d}", str(i % 4), i * 10, i * 10 + 5) for i in range(400)], "id string, chrom string, start long, end long")
    own = genes.select(F.col("id").alias("gene"))
    sets = overlap.random_genes(own, 15, 6).collect()
    assert all(len({r.gene for r in sets if r.iter == k}) == 15 for k in range(6)) and len(sets) == 90 and len({frozenset(r.gene for r in sets if r.iter == k) for k in range(6)}) == 6
    sizes = spark.createDataFrame([("t", f"l{i:02d}", 1 + i % 5) for i in range(25)] + [("u", "l00", 30), ("u", "none", 0)], "term string, locus string, n int")
    rows = overlap.bootstrap_candidates(sizes, genes, 4, by=("term",)).collect()
    wanted = {(r.term, r.locus): r.n for r in sizes.collect() if r.n}
    blocks = {}
    for r in rows:
        blocks.setdefault((r.term, r.iter, r.parent_locus), []).append(int(r.gene[1:]))
    assert {k: len(v) for k, v in blocks.items()} == {(t, i, x): n for (t, x), n in wanted.items() for i in range(4)}
    assert all(sorted(b) == list(range(min(b), min(b) + 4 * len(b), 4)) for b in blocks.values())
    for t in "tu":
        for i in range(4):
            inside = [g for (a, b, _), v in blocks.items() if (a, b) == (t, i) for g in v]
            assert len(inside) == len(set(inside))
    loci_ = overlap.random_loci(spark.createDataFrame([("1", 1000), ("2", 50)], "id string, length long"), 40, 100).collect()
    assert len(loci_) == 40 and {r.chrom for r in loci_} == {"1", "2"} and all(r.end - r.start == 100 and r.start >= 0 for r in loci_)
    terms = overlap.simulated_terms(spark.createDataFrame([("t", f"g{i:03d}") for i in range(20)], "term string, gene string"), genes, 50, 25)
    got = {r.gene for r in terms.collect()}
    assert 10 <= len(got) <= 15 and len(got & {f"g{i:03d}" for i in range(20)}) >= 10


def test_breakdown_total_and_wide_tables(spark):
    results = spark.createDataFrame([("a", "g1", 10, 1, 2, 2), ("a", "g2", 10, 1, 2, 2), ("b", "g1", 10, 1, 1, 1)], "term string, gene string, window_size int, flank_limit int, term_loci int, term_collapsed_loci int")
    snps = spark.createDataFrame([("a", "s1", "1", 5, 5), ("a", "s2", "1", 100, 100), ("b", "s3", "1", 12, 12)], "term string, id string, chrom string, start long, end long")
    rows = {r.term: (r.term_loci, r.collapsed_loci, r.candidate_genes) for r in overlap.breakdown(results, snps).collect()}
    assert rows == {"a": (2.0, 2.0, 2), "b": (1.0, 1.0, 1), "Total": (3.0, 2.0, 2)}
    counts = spark.createDataFrame([("a", "density", "x", 2), ("b", "density", "y", 1)], "term string, method string, cob string, n long")
    assert [tuple(r) for r in overlap.wide(counts, ["term"], ["method", "cob"]).collect()] == [("a", 2, 0), ("b", 0, 1)]


def test_parent_attributes(spark):
    snps = spark.createDataFrame([("t", "s1", "1", 100, 100, 2.0), ("t", "s2", "1", 110, 110, 5.0), ("t", "s3", "1", 900, 900, 1.0)], "term string, id string, chrom string, start long, end long, score double")
    genes = spark.createDataFrame([("A", "1", 105, 108), ("B", "1", 905, 950)], "id string, chrom string, start long, end long")
    islands = loci.effective_loci(snps, 20)
    found = ranges.with_parent_attrs(ranges.candidate_genes(islands, genes, 20, 1, ("term",)), islands, snps, ["score"], ("term",))
    assert {r.gene: r.parent_score for r in found.collect()} == {"A": 5.0, "B": 1.0}


def test_hierarchy_and_cluster_terms(spark):
    """Merges nearest first, leaves of a merge side by side."""
    tree = spark.createDataFrame([("a", "b", 2.0), ("c", "d", 1.0), ("b", "c", 0.5), ("e", "f", 3.0)], "gene_a string, gene_b string, w double")
    merges, leaves = graph.dendrogram(tree, 0.1, 0.5)
    rows = merges.orderBy("step").collect()
    assert [(r.a, r.b, r.size) for r in rows] == [("e", "f", 2), ("a", "b", 2), ("c", "d", 2), ("b", "c", 4)]
    assert [r.height for r in rows] == pytest.approx([1 - math.tanh(w * 0.5 + 0.1) for w in (3, 2, 1, 0.5)])
    order = "".join(r.gene for r in leaves.orderBy("place").collect())
    assert sorted(order) == list("abcdef") and all(any(p in order for p in (x, x[::-1])) for x in ("ab", "cd", "ef"))
    terms, own = jobs.cluster_ontology(spark.createDataFrame([("g", 0), ("h", 0), ("i", 1)], "gene string, cluster int"), "net")
    assert {tuple(r) for r in terms.collect()} == {("MCL0", "net MCL Cluster 0"), ("MCL1", "net MCL Cluster 1")} and own.count() == 3


def test_small_helpers(spark, tmp_path):
    row = spark.range(1).select(
        loci.center(F.lit(1), F.lit(4)).alias("c"), loci.upstream(F.lit(9), F.lit(4)).alias("u"), loci.overlaps((F.lit(1), F.lit(5)), (F.lit(5), F.lit(9))).alias("o"), loci.within((F.lit(2), F.lit(3)), (F.lit(1), F.lit(3))).alias("w"),
        stats.bp_to_kb(F.lit(50_000)).alias("kb"), cx.inverse_score(F.lit(2.0), 0.1, 0.5).alias("i"),
    ).first()
    assert (row.c, row.u, row.o, row.w, row.kb) == (2.5, 5, True, True, "50KB") and row.i == pytest.approx(math.tanh(1.1))
    places = spark.createDataFrame([("t", "1", 5, 9), ("t", "1", 1, 3), ("t", "2", 4, 4)], "term string, chrom string, start long, end long")
    assert {(r.chrom, r.start, r.end, r.n_sub) for r in loci.merged_locus(places).collect()} == {("1", 1, 9, 2), ("2", 4, 4, 1)}
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, component string")
    assert {r.node for r in graph.largest_component(labels).collect()} == {"a", "b"}
    wide = spark.createDataFrame([("g", 1.0, float("nan"))], "id string, A double, B double")
    assert {(r.gene, r.accession, r.value) for r in ex.long_form(wide, "id").collect()} == {("g", "A", 1.0), ("g", "B", None)}
    table = spark.createDataFrame([("g1", 1, 5, 9, "x"), ("g2", 2, 6, 8, None)], "gene string, chr int, s int, e int, note string")
    genes, attrs = readers.genome_from_dataframe(table, "chr", "s", "e", "gene")
    assert {tuple(r) for r in genes.collect()} == {("G1", "1", 5, 9), ("G2", "2", 6, 8)} and ("G1", "note", "x") in {tuple(r) for r in attrs.collect()}
    (tmp_path / "al.csv").write_text("id,alias\ng1,one\nzz,no\n")
    assert [tuple(r) for r in readers.read_aliases(spark, str(tmp_path / "al.csv"), genes).select("alias", "id").collect()] == [("one", "G1")]
    (tmp_path / "func.tsv").write_text("g1\tfirst\tsecond\ng9\tx\ty\n")
    assert {tuple(r) for r in readers.read_annotations(spark, str(tmp_path / "func.tsv"), genes).collect()} == {("G1", "first"), ("G1", "second")}
    (tmp_path / "n.cyjs").write_text('{"elements": {"nodes": [{"data": {"id": "g1"}, "position": {"x": 1.5, "y": 2.0}}]}}')
    assert [tuple(r) for r in readers.read_coordinates(spark, str(tmp_path / "n.cyjs")).collect()] == [("g1", 1.5, -2.0)]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.overlap.tsv").write_text("Term\tfdr\nLogZn\t0.1\nZn\t0.2\n")
    assert {r.Term: r.trait_type for r in readers.with_trait_type(readers.read_overlaps(spark, str(tmp_path / "o"))).collect()} == {"LogZn": "Log", "Zn": "Element"}
    edges = spark.createDataFrame([("a", "b", 3.0, 5.0, True), ("a", "c", 1.0, 5.0, False)], "gene_a string, gene_b string, score double, distance double, significant boolean")
    writers.write_dat(edges, str(tmp_path / "dat"), sig_only=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "dat")).collect()] == ["a\tb\t3.0"]
    rels = spark.createDataFrame([("c", "p"), ("p", "r")], "child string, parent string")
    terms = spark.createDataFrame([(x, x.upper()) for x in "cprz"], "id string, name string")
    nodes, links = writers.ontology_json(terms, ontology.ancestors(rels), rels, spark.createDataFrame([("c",)], "term string"))
    assert nodes.count() == 3 and links.count() == 2
    place = graph.spring_layout([("a", "b"), ("b", "c"), ("c", "a")])
    assert set(place) == set("abc") and all(math.isfinite(v) for p in place.values() for v in p)
    health = spark.createDataFrame([(0.01,), (0.5,)], "pvalue double")
    assert jobs.fold_enrichment(health).first()[0] == pytest.approx(10)
    assert overlap.upsert(overlap.empty_results(spark), overlap.empty_results(spark)).count() == 0
