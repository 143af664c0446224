"""Gene sets: ontologies, the is_a graph, enrichment.

term_loci has term and gene; rels has child and parent; alts has alt and main.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genonet.functions.stats import dense_index, hypergeom_sf
from genonet.sources.shared import materialised


def ancestors(rels: DataFrame) -> DataFrame:
    """term and ancestor for every path up the graph, each pair once. Doubles the length of known paths each round, going on from the paths found last."""
    paths = new = materialised(rels.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct())
    while not new.isEmpty():
        longer = new.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.term")).select("a.term", "b.ancestor").distinct()
        new = materialised(longer.join(paths, ["term", "ancestor"], "left_anti"))
        paths = paths.unionByName(new)
    return paths


def children(rels: DataFrame, term: str) -> DataFrame:
    return rels.where(F.col("parent") == term).select(F.col("child").alias("term"))


def parents(rels: DataFrame, term: str) -> DataFrame:
    return ancestors(rels).where(F.col("term") == term).select(F.col("ancestor").alias("term"))


def reached(rels: DataFrame, wanted: DataFrame) -> DataFrame:
    """All ancestors (term) of the wanted terms. Goes up level by level from these alone, so that the rest of the graph is never closed."""
    start = materialised(wanted.select("term").distinct())
    found, new = None, start
    while True:
        up = rels.join(new.select(F.col("term").alias("child")), "child", "left_semi").select(F.col("parent").alias("term")).distinct()
        new = materialised(up if found is None else up.join(found, "term", "left_anti"))
        if new.isEmpty():
            return start.limit(0) if found is None else found
        found = new if found is None else found.unionByName(new)


def term_graph(rels: DataFrame, terms: DataFrame, wanted: DataFrame | None = None, itself: bool = False, term_loci: DataFrame | None = None, attrs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all terms (id, ...), or of the ancestors of the wanted ones and, with ``itself``, those too.

    Every is_a link of a node is an edge (term, parent), whose other end is a node as well. Nodes
    get ``size``, their genes in term_loci, and the attributes of attrs (term, key, val) as a map ``attr``; where a key
    comes twice, the last value by order stays.
    """
    if wanted is None:
        nodes = terms
    else:
        up = reached(rels, wanted)
        up = up.union(wanted.select("term")).distinct() if itself else up
        nodes = terms.join(up.select(F.col("term").alias("id")), "id", "left_semi")
    edges = rels.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").select(F.col("child").alias("term"), "parent").distinct()
    if term_loci is not None:
        nodes = nodes.join(term_sizes(term_loci).withColumnRenamed("term", "id"), "id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    if attrs is not None:
        own = attrs.groupBy("term", "key").agg(F.max("val").alias("val")).groupBy(F.col("term").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "val")))).alias("attr"))
        nodes = nodes.join(own, "id", "left")
    return nodes, edges


def term_matrix(rels: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells i, j, value of the symmetric matrix of is_a links, 1 for a link from either end, and the index (term, idx), dense from 0 by id."""
    index = materialised(dense_index(terms.select(F.col("id").alias("term")).distinct(), "term"))
    a, b = (index.select(F.col("term").alias(c), F.col("idx").alias(i)) for c, i in (("child", "i"), ("parent", "j")))
    cells = rels.select("child", "parent").distinct().join(a, "child").join(b, "parent").select("i", "j", F.lit(1).alias("value"))
    return cells.unionByName(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")), index


def enriched_terms(term_loci: DataFrame, lists: DataFrame, pval_cutoff: float = 0.05, low: int = 2, high: int = 300, min_overlap: int = 1) -> DataFrame:
    """Terms that any of the gene lists (term, gene) enriches, all lists in one job: term, the least p and the lists' names as ``label``."""
    universe = term_loci.select("gene").distinct().count()
    rows = ontology_enrichment(term_loci, lists, pval_cutoff, low, high, universe, any_target=True).where(F.col("num_common") >= min_overlap)
    return rows.groupBy(F.col("source_term").alias("term")).agg(F.min("pval").alias("pval"), F.array_join(F.array_sort(F.collect_set("target_term")), ",").alias("label"))


def num_children(rels: DataFrame) -> DataFrame:
    return rels.groupBy(F.col("parent").alias("term")).agg(F.countDistinct("child").alias("children"))


def resolve_alts(rows: DataFrame, alts: DataFrame, term: str = "term") -> DataFrame:
    """Alternative ids replaced by the main ones."""
    return rows.join(alts.select(F.col("alt").alias("_alt"), F.col("main").alias("_main")), F.col(term) == F.col("_alt"), "left").withColumn(term, F.coalesce("_main", term)).drop("_alt", "_main")


def propagate(term_loci: DataFrame, rels: DataFrame) -> DataFrame:
    """Each gene in its terms and in all their ancestors."""
    up = term_loci.join(ancestors(rels), "term").select(F.col("ancestor").alias("term"), "gene")
    return term_loci.select("term", "gene").union(up).distinct()


def term_sizes(term_loci: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    sizes = term_loci.groupBy("term").agg(F.countDistinct("gene").alias("size")).where(F.col("size") >= low)
    return sizes if high is None else sizes.where(F.col("size") <= high)


def in_genome(term_loci: DataFrame, genes: DataFrame) -> DataFrame:
    return term_loci.select("term", F.upper("gene").alias("gene")).distinct().join(genes.select(F.upper("id").alias("gene")).distinct(), "gene", "left_semi")


def terms_containing(term_loci: DataFrame, genes: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Terms with any of the listed genes, and their sizes."""
    hit = term_loci.join(genes.select("gene").distinct(), "gene", "left_semi").select("term").distinct()
    return term_sizes(term_loci, low, high).join(hit, "term", "left_semi")


def enrichment(term_loci: DataFrame, genes: DataFrame, pval_cutoff: float = 0.05, low: int = 2, high: int = 300, universe: int | None = None, min_overlap: int = 1, label: str | None = None) -> DataFrame:
    """Terms that share more genes with the list than chance gives, by the hypergeometric tail.

    The number drawn is the list's length as given, repeats and unknown genes included.
    """
    drawn = genes.count()
    universe = universe or term_loci.select("gene").distinct().count()
    terms = terms_containing(term_loci, genes, low, high)
    common = term_loci.join(genes.select("gene").distinct(), "gene", "left_semi").groupBy("term").agg(F.countDistinct("gene").alias("num_common"), F.array_sort(F.collect_set("gene")).alias("genes"))
    tested = terms.count()
    rows = terms.join(common, "term")
    p = hypergeom_sf(F.col("num_common"), F.lit(universe), F.col("size"), F.lit(min(drawn, universe)))
    rows = rows.withColumn("pval", p).where((F.col("pval") <= pval_cutoff) & (F.col("num_common") >= min_overlap))
    return rows.select(
        "term", "pval", F.lit(tested).alias("terms_tested"), "num_common", F.lit(universe).alias("num_universe"), F.col("size").alias("source_term_size"),
        F.lit(drawn).alias("target_term_size"), F.lit(label).cast("string").alias("label"), (F.col("pval") <= pval_cutoff / max(tested, 1)).alias("bonferroni"), "genes",
    )


def ontology_enrichment(source: DataFrame, target: DataFrame, pval_cutoff: float = 0.05, low: int = 2, high: int = 300, universe: int | None = None, any_target: bool = False) -> DataFrame:
    """Every term of ``target`` as a gene list against every term of ``source``; one join on genes. Sizes are bounded on both sides, or, with any_target, on the source's alone."""
    universe = universe or source.select("gene").union(target.select("gene")).distinct().count()
    a = source.join(term_sizes(source, low, high), "term").select("gene", F.col("term").alias("source_term"), F.col("size").alias("source_size")).distinct()
    b = target.join(term_sizes(target) if any_target else term_sizes(target, low, high), "term").select("gene", F.col("term").alias("target_term"), F.col("size").alias("target_size")).distinct()
    both = a.join(b, "gene").groupBy("source_term", "target_term", "source_size", "target_size").agg(F.count(F.lit(1)).alias("num_common"))
    p = hypergeom_sf(F.col("num_common"), F.lit(universe), F.col("source_size"), F.least("target_size", F.lit(universe)))
    return both.withColumn("pval", p).where(F.col("pval") <= pval_cutoff)


def adjacency(left: DataFrame, right: DataFrame, universe: int) -> DataFrame:
    """Shared genes of each two terms, the hypergeometric p and the Bonferroni flag at .05; pairs without a shared gene are left out."""
    pairs = left.select("term").distinct().count() * right.select("term").distinct().count()
    rows = ontology_enrichment(left, right, pval_cutoff=1.0, low=1, high=10**9, universe=universe)
    return rows.withColumn("bonferroni", F.col("pval") <= 0.05 / max(pairs, 1))
