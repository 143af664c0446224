"""Hierarchies, layouts, triangles, fits, densities and ordered lookups against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genonet.functions import fits, ordered, stats
from genonet.operators import coexpression, density, expression, graph, hierarchy, layout, ontology
from genonet.operators import overlap as ov
from genonet.plans import jobs
from genonet.sources import readers, records, writers
from genonet.sources.catalog import SCHEMAS, Catalog, GeneAbsentError


def merged(edges):
    """a, b, height and the genes below, for each edge of a tree, nearest first."""
    top, below, out = {}, {}, []
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for h, a, b in sorted((1 - math.tanh(w * 0.5 + 0.1), a, b) for a, b, w in edges):
        x, y = find(a), find(b)
        genes = below.pop(x, {x}) | below.pop(y, {y})
        top[y], below[x] = x, genes
        out.append((a, b, h, genes))
    return out


def some_trees():
    rng = random.Random(2)
    chain = [(i, i + 1, i / 40) for i in range(50)]  # one gene joins after the other
    star = [(1000, 1000 + i, -i / 40) for i in range(1, 40)]
    mixed = [(2000 + rng.randrange(max(0, i - rng.choice([1, 3, 80])), i), 2000 + i, round(rng.gauss(0, 1), 1)) for i in range(1, 70)]
    halves = [(3000 + (i & (i - 1)), 3000 + i, 3.0 - bin(i).count("1")) for i in range(1, 32)]
    return chain + star + mixed + halves + [(5000, 5001, 0.5)]


def test_hierarchy_of_a_forest(spark):
    edges = some_trees()
    merges, leaves = hierarchy.dendrogram(spark.createDataFrame(edges, "gene_a long, gene_b long, w double").repartition(3), 0.1, 0.5)
    want, place = merged(edges), {r.gene: r.place for r in leaves.collect()}
    got = [tuple(r) for r in merges.select("a", "b", "height", "size", "step").orderBy("step").collect()]
    assert [(a, b, n, k) for a, b, _, n, k in got] == [(a, b, len(g), k) for k, (a, b, _, g) in enumerate(want)]
    assert [h for _, _, h, _, _ in got] == pytest.approx([h for _, _, h, _ in want])
    assert sorted(place.values()) == list(range(len({g for a, b, _ in edges for g in (a, b)})))
    for _, _, _, genes in want:
        at = [place[g] for g in genes]
        assert max(at) - min(at) == len(at) - 1
    empty = hierarchy.dendrogram(spark.createDataFrame([], "gene_a long, gene_b long, w double"))
    assert [x.count() for x in empty] == [0, 0]


def test_pointers_are_followed(spark):
    """A long chain into a pair, a star, a lone pair."""
    points = {i: i + 1 for i in range(100)} | {100: 99} | {i: 500 for i in range(501, 540)} | {500: 501} | {700: 701, 701: 700}
    got = {r.node: r.part for r in hierarchy.followed(spark.createDataFrame(list(points.items()), "node long, next long")).collect()}
    assert got == {i: 99 for i in range(101)} | {i: 500 for i in range(500, 540)} | {700: 700, 701: 700}


def test_triangles_of_hubs_and_cliques(spark):
    rng = np.random.default_rng(5)
    pairs = {(0, i) for i in range(1, 60)} | {(i, i + 1) for i in range(1, 20)} | {tuple(sorted(map(int, rng.choice(30, 2, replace=False) + 60))) for _ in range(150)} | {(200, 201)}
    w = {p: float(1 + (p[0] * 7 + p[1]) % 5) for p in pairs}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "gene_a long, gene_b long, score double")
    near = {}
    for (a, b), x in w.items():
        near.setdefault(a, {})[b] = x
        near.setdefault(b, {})[a] = x
    joined = lambda a, b: b in near[a]
    for r in graph.clustering_coefficients(df).collect():
        own = near[r.gene]
        both = [(a, b) for a in own for b in own if a < b and joined(a, b)]
        k, s = len(own), sum(own.values())
        assert (r.degree, r.strength, r.triangles) == (k, pytest.approx(s), len(both))
        if k < 2:
            assert r.coefficient is None and r.weighted is None
        else:
            assert r.coefficient == pytest.approx(2 * len(both) / (k * (k - 1)))
            assert r.weighted == pytest.approx(sum(own[a] + own[b] for a, b in both) / (s * (k - 1)))
    assert graph.clustering_coefficients(df.limit(0)).count() == 0


def all_pairs(edges, places, iterations):
    """The same layout with every pair of nodes."""
    names = sorted(places)
    at = {x: i for i, x in enumerate(names)}
    p, k = np.array([places[x] for x in names]), 1 / math.sqrt(len(names))
    step = 0.1 * max(np.ptp(p, axis=0))
    for t in [step * (1 - i / (iterations + 1)) for i in range(iterations)]:
        d = p[:, None] - p[None]
        move = (d * (k * k / np.maximum((d**2).sum(-1), layout.NEAREST**2))[..., None]).sum(1)
        for a, b, w in edges:
            pull = p[at[b]] - p[at[a]]
            pull = pull * (w * max(math.sqrt((pull**2).sum()), layout.NEAREST) / k)
            move[at[a]] += pull
            move[at[b]] -= pull
        size = np.maximum(np.sqrt((move**2).sum(1)), layout.NEAREST)
        p = p + move * (t / size)[:, None]
    return {x: p[at[x]] for x in names}


def test_layout_is_near_the_one_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{i:02d}", f"n{j:02d}", 1.0) for i in range(60) for j in range(i + 1, 60) if i % 3 == j % 3 and rng.random() < 0.3 or j == i + 1 and i % 20 == 0] + [("x", "y", 1.0)]
    df = spark.createDataFrame(edges, "gene_a string, gene_b string, score double")
    start = {r.gene: (r.x, r.y) for r in layout.layout(df, 0).collect()}
    assert set(start) == {x for a, b, _ in edges for x in (a, b)} - {"x", "y"}
    one = {r.gene: np.array((r.x, r.y)) for r in layout.layout(df, 1).collect()}
    want = all_pairs(edges[:-1], start, 1)
    moves = [(one[x] - start[x], want[x] - np.array(start[x])) for x in start]
    assert np.mean([a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in moves]) > 0.98
    got, want = ({x: np.array(v) for x, v in r.items()} for r in ({r.gene: (r.x, r.y) for r in layout.layout(df, 15).collect()}, all_pairs(edges[:-1], start, 15)))
    far = lambda p: [np.linalg.norm(p[a] - p[b]) for a in sorted(p) for b in sorted(p) if a < b]
    assert np.corrcoef(far(got), far(want))[0, 1] > 0.9
    assert layout.layout(df, 2, largest_only=False).count() == 62 and layout.layout(df.limit(0), 2).count() == 0


def test_cells_repel_as_their_nodes_do():
    """A node alone in far cells: the sum over cells is the sum over nodes; it is close where many share a cell."""
    rng = np.random.default_rng(1)
    x, y = rng.random(400), rng.random(400)
    levels = 7
    i, j = (np.minimum((v * (1 << levels)).astype(int), (1 << levels) - 1) for v in (x, y))
    cells = {}
    for a, b, u, v in zip(i.tolist(), j.tolist(), x, y, strict=True):
        n, sx, sy = cells.get((a, b), (0, 0.0, 0.0))
        cells[a, b] = (n + 1, sx + u, sy + v)
    got = layout.repulsion(x, y, layout.pyramid([(*k, *v) for k, v in cells.items()], levels), (0.0, 0.0), 1.0)
    d = np.stack([x[:, None] - x, y[:, None] - y])
    want = (d / np.maximum((d**2).sum(0), layout.NEAREST**2)).sum(2)
    assert np.linalg.norm(got - want) / np.linalg.norm(want) < 0.05


def brute_laws(values):
    """log pmf of the three laws at given parameters, by long sums."""
    x = np.arange(1, 400_001, dtype=float)
    z = lambda a, b: math.log(np.exp(-a * np.log(x) - b * x).sum())
    v = np.array(values, float)
    return lambda a, b: -a * np.log(v) - b * v - z(a, b)


def test_fits_and_comparisons(spark):
    rng = np.random.default_rng(6)
    values = [int(v) for v in np.minimum(np.floor(rng.pareto(1.2, 300) + 1), 60)] + list(range(1, 12)) * 4
    found, pairs = fits.comparison(spark.createDataFrame([(v,) for v in [*values, 0, None]], "degree long"), "degree")
    law = brute_laws(values)
    score = lambda a, b: law(a, b).sum()
    a, b = found["truncated_alpha"], found["truncated_lambda"]
    assert found["truncated_power_law"] == pytest.approx(score(a, b), abs=1e-6)
    assert all(score(a + s, b + t) <= found["truncated_power_law"] + 1e-9 for s, t in ((0.01, 0), (-0.01, 0), (0, 0.001), (0, -0.001), (0.01, -0.001)))
    grid = max(score(s, 0) for s in np.arange(found["alpha"] - 0.02, found["alpha"] + 0.02, 0.001))
    assert found["power_law"] >= grid - 0.05  # the long sum leaves out a tail
    mean = np.mean(values)
    assert found["lambda"] == pytest.approx(math.log(mean / (mean - 1)))
    logs = {"truncated_power_law": law(a, b), "exponential": math.log(math.expm1(found["lambda"])) - found["lambda"] * np.array(values, float)}
    ratio = dict(((x, y), (r, p)) for x, y, r, p in pairs)
    d = logs["truncated_power_law"] - logs["exponential"]
    r, p = ratio["truncated_power_law", "exponential"]
    assert r == pytest.approx(d.sum(), abs=1e-4) and p == pytest.approx(math.erfc(abs(d.sum()) / math.sqrt(2 * len(values) * d.var())), abs=1e-6)
    r, p = ratio["truncated_power_law", "power_law"]
    assert r >= 0 and p == pytest.approx(math.erfc(math.sqrt(r)))


def test_fits_by_hand(spark):
    """1, 1, 1, 2: mean 5/4, so the exponential has e^-b = 1/5; its log likelihood is 4 log(4/5) + log(1/5)."""
    found, pairs = fits.comparison(spark.createDataFrame([(1,), (1,), (1,), (2,)], "degree int"), "degree")
    assert found["lambda"] == pytest.approx(math.log(5)) and found["exponential"] == pytest.approx(4 * math.log(0.8) + math.log(0.2))
    # truncated: it can give 1 and 2 any odds, but must leave the rest something; at best 3/4 and 1/4
    assert found["exponential"] <= found["truncated_power_law"] < 3 * math.log(0.75) + math.log(0.25)
    assert len(pairs) == 3
    assert fits.comparison(spark.createDataFrame([(1,), (1,)], "degree int"), "degree") == ({}, [])
    assert fits.moments(2.0, 0.0)[0] == pytest.approx(math.log(math.pi**2 / 6), abs=1e-10)
    assert fits.moments(0.0, 0.01)[0] == pytest.approx(-math.log(math.expm1(0.01)), abs=1e-9)


def test_kernel_density_against_every_value(spark):
    rng = np.random.default_rng(9)
    rows = [(bool(k % 3), float(v)) for k, v in enumerate(rng.normal(0, 2, 600))] + [(True, None), (True, 30.0)]
    got = density.kernel_density(spark.createDataFrame(rows, "cis boolean, score double"), ["cis"], "score", points=101).collect()
    assert len(got) == 202
    for r in got:
        own = np.array([round(v / 0.01) * 0.01 for c, v in rows if c == r.cis and v is not None])
        assert r.density == pytest.approx(np.exp(-(((r.x - own) / 0.2) ** 2) / 2).sum() / (len(own) * 0.2 * math.sqrt(2 * math.pi)), abs=1e-8)
    empty = spark.createDataFrame([], "cis boolean, score double")
    assert density.kernel_density(empty, ["cis"], "score").count() == 0


def test_nearest_and_previous(spark):
    rng = random.Random(4)
    known = sorted({rng.randrange(4000) for _ in range(60)})
    rows = [(rng.randrange(-50, 4100), k) for k in range(500)] + [(known[3], -1), (None, -2)]
    left = spark.createDataFrame(rows, "at long, k long")
    right = spark.createDataFrame([(x,) for x in [*known, known[0]]] + [(None,)], "at long")
    got = {r.k: r.nearest for r in ordered.nearest(left, right, "at").collect()}
    assert got == {k: None if v is None else min(known, key=lambda x: (abs(x - v), x)) for v, k in rows}
    assert {r.nearest for r in ordered.nearest(left, right.limit(0), "at").collect()} == {None}
    words = [(rng.randrange(30), k) for k in range(300)]
    got = {r.k: r.previous_k for r in ordered.with_previous(spark.createDataFrame(words, "w long, k long"), ["w", "k"], ["k"]).collect()}
    order = [k for _, k in sorted(words)]
    assert got == dict(zip(order, [None, *order[:-1]], strict=True))
    totals = {r.k: r.t for r in stats.cumulative(spark.createDataFrame(words, "w long, k long"), ["w", "k"], "k", "t").collect()}
    assert totals == dict(zip(order, np.cumsum(order).tolist(), strict=True))


def test_set_locality_leaves_out_edges_inside_a_locus(spark):
    edges = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("b", "c", True), ("c", "d", True), ("a", "z", True), ("b", "d", False)], "gene_a string, gene_b string, significant boolean")
    degrees = spark.createDataFrame([("a", 3), ("b", 2), ("c", 3), ("d", 1), ("z", 1)], "gene string, degree long")
    sets = spark.createDataFrame([("t", "a", "L1"), ("t", "b", "L1"), ("t", "c", "L2"), ("t", "d", "L2"), ("u", "a", "L1"), ("u", "c", "L1")], "term string, gene string, parent_locus string")
    got = {(r.term, r.gene): (r.local, r["global"], r.fitted) for r in ov.set_locality(edges, degrees, sets, ["term"]).collect()}
    assert {k: v[:2] for k, v in got.items()} == {("t", "a"): (1, 2), ("t", "b"): (1, 1), ("t", "c"): (2, 2), ("t", "d"): (0, 0), ("u", "a"): (0, 2), ("u", "c"): (0, 2)}
    slope = (1 * 2 + 1 * 1 + 2 * 2) / (4 + 1 + 4)
    assert got["t", "a"][2] == pytest.approx(2 * slope)
    whole = {(r.term, r.gene): (r.local, r["global"]) for r in ov.set_locality(edges, degrees, sets.drop("parent_locus"), ["term"]).collect()}
    assert whole["t", "a"] == (2, 3) and whole["u", "c"] == (1, 3)


def test_term_graphs_and_json(spark):
    rels = spark.createDataFrame([("c", "p"), ("p", "r"), ("q", "r"), ("c", "q"), ("z", "r")], "child string, parent string")
    terms = spark.createDataFrame([(x, x.upper()) for x in "cpqrzy"], "id string, name string")
    wanted = spark.createDataFrame([("c",)], "term string")
    own = spark.createDataFrame([("p", "g1"), ("p", "g2"), ("p", "g2")], "term string, gene string")
    attrs = spark.createDataFrame([("p", "color", '"b'), ("p", "color", "a"), ("q", "w", "1")], "term string, key string, val string")
    assert {r.term for r in ontology.reached(rels, wanted).collect()} == set("pqr") and ontology.reached(rels, wanted.limit(0)).count() == 0
    nodes, edges = ontology.term_graph(rels, terms, wanted)
    assert {r.id for r in nodes.collect()} == set("pqr") and {tuple(r) for r in edges.collect()} == {("p", "r"), ("q", "r")}
    nodes, edges = ontology.term_graph(rels, terms, wanted, True, own, attrs)
    assert {(r.id, r.size, tuple(sorted((r.attr or {}).items()))) for r in nodes.collect()} == {("c", 0, ()), ("p", 2, (("color", "a"),)), ("q", 0, (("w", "1"),)), ("r", 0, ())}
    rows, links = writers.graph_json(nodes, edges)
    data = {d["id"]: d for d in (json.loads(r.value)["data"] for r in rows.collect())}
    assert data["p"] == {"id": "p", "name": "P", "size": 2, "color": "a"} and data["c"] == {"id": "c", "name": "C", "size": 0}
    assert {tuple(json.loads(r.value)["data"].values()) for r in links.collect()} == {("c", "p"), ("c", "q"), ("p", "r"), ("q", "r")}
    whole, _ = ontology.term_graph(rels, terms)
    assert whole.count() == 6
    cells, index = ontology.term_matrix(rels, terms)
    at = {r.term: r.idx for r in index.collect()}
    assert [at[x] for x in "cpqryz"] == list(range(6))
    assert sorted((r.i, r.j) for r in cells.collect()) == sorted(x for a, b in (("c", "p"), ("p", "r"), ("q", "r"), ("c", "q"), ("z", "r")) for x in ((at[a], at[b]), (at[b], at[a])))


def test_heat_map_in_leaf_order(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0, 3, (7, 4))
    values[2, 1] = 90.0
    rows = [(f"g{i}", f"a{j}", None if (i, j) == (5, 0) else float(values[i, j])) for i in range(7) for j in range(4)]
    expr = spark.createDataFrame(rows, "gene string, accession string, value double")
    places = spark.createDataFrame([("g3", 0), ("g1", 1), ("g0", 2), ("g2", 3), ("g6", 4)], "gene string, place long")
    order = [3, 1, 0, 2, 6, 4, 5]
    got = {(r.i, r.j): (r.value, r.n) for r in expression.heat_map(expr, places, normalized=False).collect()}
    assert got[6, 0] == (None, 0) and got[3, 1] == (3.5, 1)
    assert all(got[k, j][0] == pytest.approx(max(-3.5, min(3.5, values[i, j]))) for k, i in enumerate(order) for j in range(4) if (i, j) != (5, 0))
    small = {(r.i, r.j): (r.value, r.n) for r in expression.heat_map(expr, places, rows=3, columns=2, normalized=False).collect()}
    own = [min(3.5, max(-3.5, values[i, j])) for k, i in enumerate(order) for j in (0, 1) if k * 3 // 7 == 0]
    assert small[0, 0] == (pytest.approx(np.mean(own)), len(own)) and len(small) == 6


def test_records_in_order_and_filtered_genomes(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 4), ("b", 2, 9), ("a", 2, 7)], "id string, at int, v int")
    assert {tuple(r) for r in ordered.one_each(rows, ["id"], "at").select("id", "v").collect()} == {("a", 4), ("b", 9)}
    assert {tuple(r) for r in ordered.one_each(rows, ["id"], "at", last=False).select("id", "v").collect()} == {("a", 5), ("b", 9)}
    old = spark.createDataFrame([("b", 1), ("c", 1)], "id string, v int")
    assert {tuple(r) for r in records.replaced(old, rows, ["id"], "at").collect()} == {("a", 4), ("b", 9), ("c", 1)}
    assert {tuple(r) for r in records.kept_first(old, rows, ["id"], "at").collect()} == {("a", 5), ("b", 1), ("c", 1)}
    genes = spark.createDataFrame([("G1", "1", 1, 5), ("G2", "1", 7, 9), ("G3", "2", 1, 2)], "id string, chrom string, start long, end long")
    aliases = spark.createDataFrame([("al", "G1"), ("bl", "G3")], "alias string, id string")
    notes = spark.createDataFrame([("G1", "x"), ("G2", "y")], "id string, desc string")
    tables = {"genes": genes, "aliases": aliases, "annotations": notes, "gene_attrs": spark.createDataFrame([("G2", "k", "v")], "id string, key string, val string"), "chromosomes": spark.createDataFrame([("1", 9)], "id string, length long")}
    some = records.genome_of(tables, spark.createDataFrame([("al",), ("g2",), ("none",)], "gene string"))
    assert {k: t.count() for k, t in some.items()} == {"genes": 2, "aliases": 1, "annotations": 2, "gene_attrs": 1, "chromosomes": 1}
    assert {k: t.count() for k, t in records.genome_of(tables).items()} == {"genes": 3, "aliases": 2, "annotations": 2, "gene_attrs": 1, "chromosomes": 1}
    g1 = spark.createDataFrame([("g1",)], "gene string")
    assert [r.alias for r in records.remove_aliases(aliases, g1).collect()] == ["bl"] and records.remove_aliases(aliases).count() == 0
    assert [r.desc for r in records.remove_annotations(notes, g1).collect()] == ["y"] and records.remove_annotations(notes).count() == 0
    assert jobs.refgen_summary(tables)["genes with aliases"] == 2
    assert jobs.ontology_summary(spark.range(3), spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "term string, gene string")) == {"terms": 3, "genes": 2, "smallest": 1, "mean size": 1.5, "largest": 2}


def test_last_gene_of_an_id_wins(spark, tmp_path):
    (tmp_path / "g.gff").write_text("".join(f"1\tx\tgene\t{k * 10 + 1}\t{k * 10 + 5}\t.\t+\t.\tID={'a' if k % 2 else 'b'}\n" for k in range(20)))
    genes, _, _ = readers.genome_from_gff(readers.read_gff(spark, str(tmp_path / "g.gff")))
    assert {(r.id, r.start) for r in genes.collect()} == {("A", 191), ("B", 181)}


def test_a_gene_with_itself_and_parent_snps(spark):
    edges = spark.createDataFrame([("a", "b", 0.5, 1.2, 7.0, True)], "gene_a string, gene_b string, r double, score double, distance double, significant boolean")
    row = coexpression.coexpression(edges, "b", "b", 0.1, 0.5).first()
    assert (row.gene_a, row.gene_b, row.distance, row.significant) == ("b", "b", 0.0, False) and row.score == pytest.approx((math.atanh(coexpression.CLIP) - 0.1) / 0.5)
    assert coexpression.coexpression(edges, "q", "q").count() == 0 and coexpression.coexpression(edges, "b", "a").count() == 1
    snps = spark.createDataFrame([("t", "s1", "1", 100, 100, {"numIterations": "3"}), ("t", "s2", "1", 110, 110, {"numIterations": "9"}), ("t", "s3", "1", 900, 900, {"numIterations": "1"})], "term string, id string, chrom string, start long, end long, attr map<string,string>")
    genes = spark.createDataFrame([("A", "1", 105, 108), ("B", "1", 905, 950)], "id string, chrom string, start long, end long")
    out = jobs.parent_snp_info(snps, {"net": genes}, [20, 1], [1]).collect()
    assert {(r.cob, r.gene, r.parent_locus) for r in out if r.window_size == 20} == {("net", "A", "s2"), ("net", "B", "s3")}


def test_catalog_keeps_the_table_until_the_new_one_is_whole(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.save("T", "x", "", {"t": spark.range(3)})
    kept = catalog.load("T", "x", "t")
    catalog.save("T", "x", "", {"t": kept.union(spark.range(2))}, force=True)  # reads what it replaces
    assert catalog.load("T", "x", "t").count() == 5 and kept.count() == 3
    bad = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        catalog.save("T", "x", "", {"t": bad}, force=True)
    assert catalog.load("T", "x", "t").count() == 5


def test_log_factorials_in_closed_form(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(60), 1000, 10**6, 10**9]], "k long").select("k", stats.log_factorial(F.col("k")).alias("v")).collect()
    for r in rows:
        assert r.v == pytest.approx(math.lgamma(r.k + 1), rel=1e-14, abs=1e-14)
    p = spark.range(1).select(stats.hypergeom_sf(F.lit(3), F.lit(10**7), F.lit(2000), F.lit(5000)).alias("p")).first().p
    assert p == pytest.approx(0.0802, abs=1e-3)  # Poisson of mean 1: 1 - 5 / (2 e)


def test_small_records(spark, tmp_path):
    chromosomes = spark.createDataFrame([("1", 9)], "id string, length long")
    assert records.chromosome(chromosomes, 1).first().length == 9
    with pytest.raises(ValueError, match="no chromosome"):
        records.chromosome(chromosomes, "2")
    genes = spark.createDataFrame([("A", "1", 5, 9), ("B", "1", 7, 7)], "id string, chrom string, start long, end long")
    attrs = spark.createDataFrame([("A", "strand", "+"), ("A", "id", "clash"), ("A", "strand", "-")], "id string, key string, val string")
    full = records.with_attrs(genes, attrs)
    assert {r.id: dict(r.attr) for r in full.collect()} == {"A": {"strand": "-", "id": "clash"}, "B": {}}
    maps = records.as_record(full)
    assert sorted(r.record["id"] for r in maps.collect()) == ["A", "B"]
    back = {r.id: r for r in records.from_record(maps).collect()}
    assert (back["A"].start, back["A"].end, dict(back["A"].attr)) == (5, 9, {"strand": "-"}) and back["B"].end == 7
    terms, own = spark.createDataFrame([("t", "first")], "id string, desc string"), spark.createDataFrame([("t", "A")], "term string, gene string")
    more = spark.createDataFrame([("A",), ("B",)], "gene string")
    assert sorted(tuple(r) for r in records.add_loci(own, "t", more).collect()) == [("t", "A"), ("t", "B")]
    new, loci = records.copy_term(terms, own, "t", "u", "second", more)
    assert sorted(tuple(r) for r in new.collect()) == [("t", "first"), ("u", "second")] and sorted(tuple(r) for r in loci.collect()) == [("t", "A"), ("u", "A"), ("u", "B")]
    with pytest.raises(ValueError, match="no term"):
        records.copy_term(terms, own, "x", "u")
    rels, alts = spark.createDataFrame([("c", "p")], "child string, parent string"), spark.createDataFrame([("x", "c")], "alt string, main string")
    assert records.add_parents(rels, "c", ["p", "q"]).count() == 2 and records.add_alts(alts, "c", ["x", "y"]).count() == 2
    with pytest.raises(records.RecordExistsError):
        records.add_alts(alts, "p", ["x"])
    expr = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0), ("h", "a", 2.0)], "gene string, accession string, value double")
    assert expression.shape(expr) == (2, 2) and {tuple(r) for r in expression.profile(expr, "g").collect()} == {("a", 1.0), ("b", 3.0)}
    with pytest.raises(GeneAbsentError):
        expression.profile(expr, "nosuch")
    catalog = Catalog(spark, str(tmp_path))
    for kind in SCHEMAS:
        catalog.create(kind, "empty", "nothing yet")
        assert {t: catalog.load(kind, "empty", t).count() for t in catalog.tables(kind, "empty")} == dict.fromkeys(SCHEMAS[kind], 0)
