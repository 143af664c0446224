"""Writers of networks, ontologies and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, force: bool = False) -> None:
    """One folder of tab-separated files; skipped where it exists, unless forced."""
    df.write.mode("overwrite" if force else "ignore").csv(path, sep="\t", header=True)


def write_dat(edges: DataFrame, path: str, sig_only: bool = False, min_distance: float = 0.0) -> None:
    own = edges.where("significant") if sig_only else edges
    own.where(F.col("distance") >= min_distance).select("gene_a", "gene_b", "score").write.csv(path, sep="\t")


def top_edges(edges: DataFrame, max_edges: int | None) -> DataFrame:
    return edges if max_edges is None else edges.orderBy(F.desc("score"), "gene_a", "gene_b").limit(max_edges)


def network_json(edges: DataFrame, nodes: DataFrame, flags: DataFrame | None = None, max_edges: int | None = None, remove_orphans: bool = False, min_degree: int | None = None, coordinates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a Cytoscape network, one JSON object a row; write with .write.text().

    flags: gene and term, which become a boolean on the node each. Infinite distances are -1.
    """
    edges = top_edges(edges, max_edges)
    ends = edges.select(F.explode(F.array("gene_a", "gene_b")).alias("gene")).groupBy("gene").agg(F.count(F.lit(1)).alias("degree"))
    nodes = nodes.select("gene").distinct().join(ends, "gene", "inner" if remove_orphans else "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if min_degree is not None:
        nodes = nodes.where(F.col("degree") >= min_degree)
        edges = edges.join(nodes.select(F.col("gene").alias("gene_a")), "gene_a", "left_semi").join(nodes.select(F.col("gene").alias("gene_b")), "gene_b", "left_semi")
    if flags is not None:
        marks = flags.groupBy("gene").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        nodes = nodes.join(marks, "gene", "left")
    if coordinates is not None:
        nodes = nodes.join(coordinates, "gene", "left")
    extra = [c for c in nodes.columns if c not in ("gene", "x", "y")]
    place = [F.struct("x", "y").alias("position")] if coordinates is not None else []
    node_rows = nodes.select(F.to_json(F.struct(F.struct(F.col("gene").alias("id"), *extra).alias("data"), *place)).alias("value"))
    far = F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance"))
    edge_rows = edges.select(F.to_json(F.struct(F.struct(F.col("gene_a").alias("source"), F.col("gene_b").alias("target"), "score", far.alias("distance")).alias("data"))).alias("value"))
    return node_rows, edge_rows


def _escaped(c: str) -> Column:
    text = F.col(c).cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def graphml(edges: DataFrame) -> DataFrame:
    """The lines of a GraphML file, numbered: head, nodes, edges, tail."""
    spark = edges.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="score" for="edge" attr.name="score" attr.type="double"/>\n<graph edgedefault="undirected">'
    fixed = spark.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "part int, value string")
    names = edges.select(F.explode(F.array("gene_a", "gene_b")).alias("g")).distinct()
    nodes = names.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _escaped("g"), F.lit('"/>')).alias("value"))
    lines = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _escaped("gene_a"), F.lit('" target="'), _escaped("gene_b"), F.lit('"><data key="score">'), F.col("score").cast("string"), F.lit("</data></edge>")).alias("value"))
    return fixed.unionByName(nodes).unionByName(lines)


def write_graphml(edges: DataFrame, path: str) -> None:
    """A folder of text files whose names' order is the order of the document."""
    graphml(edges).repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def sparse_matrix(edges: DataFrame, index: DataFrame) -> DataFrame:
    """i, j and score of both triangles; index has gene and idx."""
    a, b = (index.select(F.col("gene").alias(f"gene_{s}"), F.col("idx").alias(k)) for s, k in (("a", "i"), ("b", "j")))
    both = edges.join(a, "gene_a").join(b, "gene_b")
    return both.select("i", "j", "score").unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "score"))


def ontology_json(terms: DataFrame, closure: DataFrame, rels: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the wanted terms and all their ancestors, one JSON object a row."""
    up = wanted.select("term").union(closure.join(wanted, "term", "left_semi").select("ancestor")).distinct()
    nodes = terms.join(up, terms.id == up.term, "left_semi")
    edges = rels.join(up, rels.child == up.term, "left_semi").select(F.col("child").alias("term"), "parent").distinct()
    return graph_json(nodes.select("id", "name"), edges)


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id and whatever else they have; entries of a map ``attr`` become fields) and edges (term, parent), one JSON object a row."""
    fields = [c for c in nodes.columns if c != "attr"]
    data = F.to_json(F.struct(*fields))
    if "attr" in nodes.columns:
        extra = F.to_json(F.col("attr"))
        data = F.when(F.size("attr") > 0, F.concat(F.substr(data, F.lit(1), F.length(data) - 1), F.lit(","), F.substr(extra, F.lit(2)))).otherwise(data)
    node_rows = nodes.select(F.concat(F.lit('{"data":'), data, F.lit("}")).alias("value"))
    edge_rows = edges.select(F.to_json(F.struct(F.struct(F.col("term").alias("source"), F.col("parent").alias("target")).alias("data"))).alias("value"))
    return node_rows, edge_rows
