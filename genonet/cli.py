"""Command line: python -m genonet.cli COMMAND ... ; datasets live in a catalog folder."""

from __future__ import annotations

import argparse
import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genonet.operators import coexpression, expression, layout, ontology, overlap
from genonet.plans import jobs
from genonet.sources import readers, records, writers
from genonet.sources.catalog import Catalog
from genonet.sources.shared import materialised


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genonet")
    p.add_argument("--config", help="a JSON file with values for flags, by name")
    p.add_argument("--catalog", default="genonet-data")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        c = sub.add_parser(name)
        for names, options in flags:
            c.add_argument(*names.split(), **options)

    named = [("filename", {}), ("name", {}), ("description", {})]
    force = ("--force", {"action": "store_true"})
    command("build-refgen", *named, ("--chrom-feature", {"default": "chromosome"}), ("--gene-feature", {"default": "gene"}), ("--id-attr", {"default": "ID"}), ("--attr-split", {"default": "="}), force)
    command("build-cob", *named, ("refgen", {}), ("--rawtype", {"default": "RNASEQ"}), ("--sep", {"default": "\t"}), ("--zscore-cutoff", {"type": float, "default": 3.0}), ("--skip-quality-control", {"action": "store_true"}), ("--skip-normalization", {"action": "store_true"}), ("--skip-quantile", {"action": "store_true"}), ("--min-expr", {"type": float, "default": 0.001}), ("--max-gene-missing-data", {"type": float, "default": 0.3}), ("--max-accession-missing-data", {"type": float, "default": 0.5}), ("--min-single-sample-expr", {"type": float, "default": 0.08}), ("--max-val", {"type": float}), ("--index-col", {}), ("--allow-non-membership", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}), ("--clusters", {"action": "store_true"}), ("--skip-hierarchy", {"action": "store_true"}), force)
    command("build-go", *named, ("obo", {}), ("refgen", {}), ("--go-col", {"type": int, "default": 1}), ("--id-col", {"type": int, "default": 0}), force)
    command("build-gwas", *named, ("refgen", {}), ("--trait-col", {"default": "Trait"}), ("--chrom-col", {"default": "CHR"}), ("--pos-col", {"default": "POS"}), ("--sep", {"default": "\t"}), ("--add-trait", {}), ("--skip-traits", {"nargs": "*", "default": []}), ("--query", {}), force)
    command("list ls".split()[0], ("--type", {}), ("--name", {"default": "%"}))
    command("rm", ("type", {}), ("name", {}))
    command("snp2gene", ("gwas", {}), ("refgen", {}), ("--terms", {"nargs": "*"}), ("--candidate-window-size", {"type": int, "nargs": "+", "default": [1]}), ("--candidate-flank-limit", {"type": int, "nargs": "+", "default": [0]}), ("--strongest", {}), ("--strongest-higher", {"action": "store_true"}), ("--include-parent-attrs", {"nargs": "*", "default": []}), ("--gene-info", {"nargs": "*", "default": []}), ("--out", {"required": True}))
    scored = ( ("--gwas", {}), ("--go", {}), ("--genes", {"nargs": "*"}), ("--terms", {"nargs": "+", "default": ["all"]}), ("--skip-terms", {"nargs": "*", "default": []}), ("--candidate-window-size", {"type": int, "default": 50_000}), ("--candidate-flank-limit", {"type": int, "default": 2}), ("--num-bootstraps", {"default": "auto"}), ("--min-term-size", {"type": int, "default": 2}), ("--max-term-size", {"type": int}), ("--snp2gene", {"choices": ["effective", "strongest"], "default": "effective"}), ("--strongest-attr", {}), ("--strongest-higher", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}), ("--seed", {"type": int, "default": 1}), ("--out", {"required": True}), force)
    command("overlap", ("cob", {}), ("method", {"choices": ["density", "locality"]}), *scored)
    command("locality", ("cob", {}), *scored)
    command("cistrans", ("cob", {}), ("--cis-distance", {"type": float, "default": 100_000}), ("--bandwidth", {"type": float, "default": 0.2}), ("--points", {"type": int, "default": 1000}), ("--out", {"required": True}))
    command("simulate-gwas", ("go", {}), ("refgen", {}), ("--missing-rate", {"type": float, "default": 0.0}), ("--false-rate", {"type": float, "default": 0.0}), ("--seed", {"type": int, "default": 1}), ("--out", {"required": True}))
    command("layout", ("cob", {}), ("--iterations", {"type": int, "default": 50}), ("--all-components", {"action": "store_true"}), ("--seed", {"type": int, "default": 0}), ("--out", {"required": True}))
    command("filter-refgen", ("refgen", {}), ("name", {}), ("description", {}), ("--genes", {"nargs": "*"}), force)
    command("neighbors", ("cob", {}), ("genes", {"nargs": "+"}), ("--num", {"type": int, "default": 10}), ("--out", {"required": True}))
    command("health", ("cob", {}), ("--go", {}), ("--num-bootstraps", {"type": int, "default": 50}), ("--min-term-size", {"type": int, "default": 10}), ("--max-term-size", {"type": int, "default": 300}), ("--max-terms", {"type": int}), ("--edge-zscore-cutoff", {"type": float}), ("--two-tailed", {"action": "store_true"}), ("--out", {"required": True}))
    return p


def _named(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string").coalesce(1).write.mode("overwrite").csv(path, sep="\t")


def _network(catalog: Catalog, name: str) -> jobs.Network:
    t = {k: catalog.load("COB", name, k) for k in ("expr", "qc_gene", "qc_accession", "genes", "edges", "degree")}
    return jobs.Network(**t)


def _overlap(catalog: Catalog, a: argparse.Namespace) -> None:
    """Scores a gene list, a gene ontology's or a GWAS's terms, writes the rows and merges them into the results kept of this source."""
    net, window, flank = _network(catalog, a.cob), a.candidate_window_size, a.candidate_flank_limit
    if a.genes:
        names = [g for x in a.genes for g in re.split("[,; ]", x) if g]
        name, rows, window, flank = "GeneList", jobs.gene_list(net.genes, names), 1, 0
    elif a.go:
        name, rows, window, flank = a.go, jobs.term_genes(catalog.load("GOnt", a.go, "term_loci"), net.genes), 1, 0
    elif a.gwas:
        name, rows, kept = a.gwas, catalog.load("GWAS", a.gwas, "snps"), catalog.params("GWAS", a.gwas)
        if a.snp2gene == "strongest":
            # what was chosen last holds until another is given
            catalog.set_params("GWAS", a.gwas, strongest_attr=a.strongest_attr, strongest_higher=a.strongest_higher or None)
            a.strongest_attr, a.strongest_higher = a.strongest_attr or kept.get("strongest_attr"), a.strongest_higher or kept.get("strongest_higher", False)
    else:
        raise SystemExit("give --genes, --go or --gwas")
    if not a.genes and "all" not in a.terms:
        rows = rows.where(F.col("term").isin(a.terms))
    if a.skip_terms:
        rows = rows.where(~F.col("term").isin(a.skip_terms))
    if a.dry_run:
        mapped, _ = jobs.mapped_loci(rows, window, flank, a.snp2gene, a.strongest_attr, a.strongest_higher)
        mapped.groupBy("term").agg(F.count(F.lit(1)).alias("loci")).orderBy("term").show(10_000, truncate=False)
        return
    count = a.num_bootstraps if a.num_bootstraps == "auto" else int(a.num_bootstraps)
    out = materialised(jobs.run_overlap(net, rows, a.method, window, flank, count, a.seed, a.snp2gene, a.strongest_attr, a.strongest_higher, a.min_term_size, a.max_term_size, a.cob, name))
    writers.write_tsv(out.orderBy("term", F.desc("zscore"), "gene"), a.out, a.force)
    out = out.withColumns({c: F.lit(None).cast("double") for c in ("local", "global", "fitted") if c not in out.columns})
    if catalog.exists("Overlap", name):
        out = materialised(overlap.upsert(catalog.load("Overlap", name, "results").select(out.columns), out))
    catalog.save("Overlap", name, "overlap results", {"results": out}, force=True)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(args)
    if a.config:
        with open(a.config) as f:
            p.set_defaults(**json.load(f))
        a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("genonet").getOrCreate()
    catalog = Catalog(spark, a.catalog)
    if a.command == "build-refgen":
        genes, attrs, chromosomes = readers.genome_from_gff(readers.read_gff(spark, a.filename), a.chrom_feature, a.gene_feature, a.id_attr, a.attr_split)
        catalog.save("RefGen", a.name, a.description, {"genes": genes, "gene_attrs": attrs, "chromosomes": chromosomes}, force=a.force)
    elif a.command == "build-cob":
        raw = expression.cleaned(readers.read_matrix(spark, a.filename, a.sep, a.index_col))
        qc = {"min_expr": a.min_expr, "max_gene_missing": a.max_gene_missing_data, "max_accession_missing": a.max_accession_missing_data, "min_single_sample": a.min_single_sample_expr}
        own = {} if a.skip_quality_control else qc
        if a.dry_run:  # what quality control would keep; no pair of genes is looked at
            kept = raw if a.skip_quality_control else expression.quality_control(raw, None if a.allow_non_membership else catalog.load("RefGen", a.refgen, "genes").select(F.col("id").alias("gene")), **qc)[0]
            raw.groupBy().agg(F.countDistinct("gene").alias("genes"), F.countDistinct("accession").alias("accessions")).show()
            kept.groupBy().agg(F.countDistinct("gene").alias("kept_genes"), F.countDistinct("accession").alias("kept_accessions")).show()
            return
        net = jobs.build_network(raw, catalog.load("RefGen", a.refgen, "genes"), a.rawtype, a.zscore_cutoff, not a.skip_normalization, None, a.max_val, not a.skip_quantile, not a.skip_quality_control, a.clusters, not a.allow_non_membership, not a.skip_hierarchy, **own)
        tables = {"expr": net.expr, "genes": net.genes, "edges": net.edges, "degree": net.degree}
        tables |= {"qc_gene": net.qc_gene, "qc_accession": net.qc_accession} if net.qc_gene is not None else {"qc_gene": net.genes.select(F.col("id").alias("gene"), F.lit(True).alias("pass_all")), "qc_accession": net.expr.select("accession", F.lit(True).alias("pass_all")).distinct()}
        if net.merges is not None:
            tables |= {"merges": net.merges, "leaves": net.leaves}
        if net.clusters is not None:
            tables["clusters"] = net.clusters
            terms, own = jobs.cluster_ontology(net.clusters, a.name)
            catalog.save("Ontology", f"{a.name}MCL", f"{a.name} MCL Clusters", {"terms": terms, "term_loci": own}, {"refgen": a.refgen}, a.force)
        catalog.save("COB", a.name, a.description, tables, {"log": net.log, "zscore_cutoff": a.zscore_cutoff, "refgen": a.refgen}, a.force)
    elif a.command == "build-go":
        terms, rels, alts = readers.read_obo(spark, a.obo)
        own = ontology.resolve_alts(readers.read_gene_terms(spark, a.filename, a.id_col, a.go_col), alts)
        kept = ontology.in_genome(ontology.propagate(own, rels), catalog.load("RefGen", a.refgen, "genes"))
        catalog.save("GOnt", a.name, a.description, {"terms": terms, "rels": rels, "alts": alts, "term_loci": kept}, force=a.force)
    elif a.command == "build-gwas":
        df = spark.read.csv(a.filename, sep=a.sep, header=True, inferSchema=True)
        df = df.withColumn(a.trait_col, F.lit(a.add_trait)) if a.add_trait else df
        df = df.where(~F.col(a.trait_col).isin(a.skip_traits)) if a.skip_traits else df
        df = df.where(a.query) if a.query else df
        catalog.save("GWAS", a.name, a.description, {"snps": readers.gwas_from_dataframe(df, a.trait_col, a.chrom_col, a.pos_col)}, {"refgen": a.refgen}, a.force)
    elif a.command == "list":
        catalog.datasets(a.type, a.name).select("type", "name", "description", "added").orderBy("type", "name").show(10_000, truncate=False)
    elif a.command == "rm":
        catalog.remove(a.type, a.name)
    elif a.command == "snp2gene":
        kind = "COB" if catalog.exists("COB", a.refgen) else "RefGen"
        snps = catalog.load("GWAS", a.gwas, "snps")
        snps = snps.where(F.col("term").isin(a.terms)) if a.terms else snps
        snps = snps.withColumn(a.strongest, F.col("attr")[a.strongest]) if a.strongest else snps
        info = [spark.read.csv(p, sep="\t", header=True) for p in a.gene_info]
        writers.write_tsv(jobs.snp2gene(snps, catalog.load(kind, a.refgen, "genes"), a.candidate_window_size, a.candidate_flank_limit, a.strongest, not a.strongest_higher, info, a.include_parent_attrs), a.out, True)
    elif a.command in ("overlap", "locality"):
        a.method = getattr(a, "method", "locality")
        _overlap(catalog, a)
    elif a.command == "cistrans":
        dense, test = jobs.cis_trans_report(_network(catalog, a.cob).edges, a.cis_distance, a.bandwidth, a.points)
        writers.write_tsv(dense.orderBy("x"), a.out, True)
        _named(spark, test, f"{a.out}_summary")
    elif a.command == "simulate-gwas":
        terms = overlap.simulated_terms(catalog.load("GOnt", a.go, "term_loci"), catalog.load("RefGen", a.refgen, "genes"), a.missing_rate, a.false_rate, a.seed)
        writers.write_tsv(terms, a.out, True)
    elif a.command == "layout":
        net = _network(catalog, a.cob)
        places = materialised(layout.layout(net.edges.where("significant"), a.iterations, a.seed, not a.all_components))
        catalog.save("Coordinates", a.cob, f"places of {a.cob}", {"coordinates": places}, force=True)
        writers.write_tsv(places, a.out, True)
    elif a.command == "filter-refgen":
        tables = {t: catalog.load("RefGen", a.refgen, t) for t in catalog.tables("RefGen", a.refgen)}
        wanted = spark.createDataFrame([(g,) for g in a.genes], "gene string") if a.genes is not None else None
        catalog.save("RefGen", a.name, a.description, records.genome_of(tables, wanted), force=a.force)
    elif a.command == "neighbors":
        net = _network(catalog, a.cob)
        top = coexpression.top_neighbors(net.edges, a.num)
        writers.write_tsv(top.where(F.col("gene").isin([g.upper() for g in a.genes])).select("gene", "neighbor", "score", "distance", "significant"), a.out, True)
    elif a.command == "health":
        net = _network(catalog, a.cob)
        if a.edge_zscore_cutoff is not None:
            net.edges = coexpression.with_cutoff(net.edges, a.edge_zscore_cutoff)
            net.degree = materialised(coexpression.degree(net.edges, net.genes.select(F.col("id").alias("gene"))))
        writers.write_tsv(jobs.qc_report(net), f"{a.out}_qc_gene", True)
        _named(spark, jobs.summary(net) | jobs.degree_fit(net.degree), f"{a.out}_summary")
        writers.write_tsv(jobs.score_table(net.edges), f"{a.out}_scores", True)
        leaves = catalog.load("COB", a.cob, "leaves") if "leaves" in catalog.tables("COB", a.cob) else None
        writers.write_tsv(expression.heat_map(net.expr, leaves), f"{a.out}_heat_map", True)
        if a.go:
            health = materialised(jobs.go_health(net, catalog.load("GOnt", a.go, "term_loci"), a.min_term_size, a.max_term_size, a.num_bootstraps, a.two_tailed, max_terms=a.max_terms))
            writers.write_tsv(health, f"{a.out}_GO", True)
            writers.write_tsv(jobs.fold_enrichment(health), f"{a.out}_GO_fold", True)


if __name__ == "__main__":
    main()
