"""Readers of the domain's file formats. Spark reads plain, .gz and .bz2 alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genonet.functions.ordered import one_each
from genonet.operators.expression import AccessionNameError

GFF = "seqid string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The rows of GFF files, with their order as ``line``."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GFF)
    return rows.withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")))


def _attributes(c: Column, pair: str = "=", sep: str = ";") -> Column:
    """key=value texts to a map; only the first = of a part separates."""
    parts = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    entries = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, pair, 1)).alias("k"), F.trim(F.when(F.instr(x, pair) > 0, F.regexp_replace(x, f"^[^{pair}]*{pair}", "")).otherwise("")).alias("v")))
    return F.map_from_entries(F.array_distinct(entries))


def genome_from_gff(gff: DataFrame, chrom_feature: str = "chromosome", gene_feature: str = "gene", id_attr: str = "ID", attr_split: str = "=") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genes (id upper-cased), their attributes (id, key, val) and chromosomes. A declared length wins over the last gene's end; of genes of one id the last line wins."""
    rows = gff.withColumn("attr", _attributes(F.col("attributes"), attr_split))
    own = rows.where(F.col("feature") == gene_feature).withColumn("id", F.upper(F.regexp_replace(F.element_at("attr", id_attr), '"', "")))
    ordered = "line" in gff.columns
    genes = own.select("id", F.col("seqid").alias("chrom"), "start", "end", *(["line"] if ordered else []))
    genes = one_each(genes, ["id"], "line" if ordered else None).select("id", "chrom", "start", "end")
    attrs = own.select("id", F.explode(F.map_concat("attr", F.create_map(F.lit("strand"), "strand"))).alias("key", "val"))
    declared = rows.where(F.col("feature") == chrom_feature).groupBy(F.coalesce(F.element_at("attr", id_attr), "seqid").alias("id")).agg(F.max("end").alias("declared"))
    inferred = genes.groupBy(F.col("chrom").alias("id")).agg(F.max("end").alias("inferred"))
    chromosomes = declared.join(inferred, "id", "full").select("id", F.coalesce("declared", "inferred").alias("length"))
    return genes, attrs, chromosomes


def genome_from_dataframe(df: DataFrame, chrom: str, start: str, end: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Genes and attributes out of a table; every column is an attribute."""
    genes = df.select(F.upper(F.col(id_col).cast("string")).alias("id"), F.col(chrom).cast("string").alias("chrom"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    names = [c for c in df.columns if c != id_col]
    attrs = df.select(F.upper(F.col(id_col).cast("string")).alias("id"), *[F.col(c).cast("string").alias(c) for c in names]).unpivot("id", names, "key", "val").where("val is not null")
    return genes, attrs


def read_aliases(spark: SparkSession, path: str, genes: DataFrame, id_col: int = 0, alias_col: int = 1) -> DataFrame:
    """alias and id of lines cut at commas or tabs, for ids of the genome; a header names no gene of it and so drops out."""
    parts = spark.read.text(path).select(F.split("value", "[,\t]").alias("p"))
    rows = parts.select(F.get("p", F.lit(alias_col)).alias("alias"), F.upper(F.get("p", F.lit(id_col))).alias("id"))
    return rows.join(genes.select("id"), "id", "left_semi").dropDuplicates(["alias"])


def read_annotations(spark: SparkSession, path: str, genes: DataFrame, sep: str = "\t", gene_col: int = 0, skip: tuple[int, ...] = ()) -> DataFrame:
    """id and desc of every further column, without nulls and repeats."""
    wide = spark.read.csv(path, sep=sep)
    name = wide.columns[gene_col]
    others = [c for k, c in enumerate(wide.columns) if k != gene_col and k not in skip]
    rows = wide.select(F.upper(name).alias("id"), *others).unpivot("id", others, "column", "desc").where("desc is not null").select("id", "desc")
    return rows.join(genes.select("id"), "id", "left_semi").dropDuplicates()


def resolve(names: DataFrame, genes: DataFrame, aliases: DataFrame) -> DataFrame:
    """name and gene: by id, else by alias; unknown names are left out."""
    found = names.select("name", F.upper("name").alias("_u")).join(aliases.select(F.upper("alias").alias("_a"), F.col("id").alias("_i")), F.col("_u") == F.col("_a"), "left")
    return _resolved(found, genes)


def _resolved(found: DataFrame, genes: DataFrame) -> DataFrame:
    """Two equi-joins, as a join on either column would be a nested loop."""
    own = genes.select("id")
    direct = found.select("name", F.col("_u").alias("id")).join(own, "id", "left_semi")
    other = found.join(direct.select("name"), "name", "left_anti").select("name", F.col("_i").alias("id")).join(own, "id", "left_semi")
    return direct.unionByName(other).select("name", F.col("id").alias("gene")).distinct()


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", index_col: str | None = None) -> DataFrame:
    """gene, accession and value of a matrix whose header may lack the name of the gene column; index_col names it where it is not the first."""
    lines = [r[0] for r in spark.read.text(path).limit(2).collect()]
    head, width = lines[0].split(sep), len(lines[-1].split(sep))
    names = ["gene", *head] if width > len(head) else head
    at = names.index(index_col) if index_col else 0
    own = names[:at] + names[at + 1 :]
    if len(set(own)) < len(own):
        raise AccessionNameError("accession names must be unique")
    rows = spark.read.text(path).where(F.col("value") != sep.join(head)).select(F.split("value", sep).alias("p"))
    values = F.explode(F.transform(F.array(*[F.struct(F.lit(n).alias("a"), F.lit(k).alias("k")) for k, n in enumerate(names) if k != at]), lambda x: F.struct(x["a"].alias("accession"), F.get(F.col("p"), x["k"]).alias("raw"))))
    long = rows.select(F.upper(F.col("p")[at]).alias("gene"), values.alias("v")).select("gene", "v.accession", F.expr("try_cast(v.raw as double)").alias("value"))
    return long.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """terms (id, name, namespace, desc, is_obsolete), rels (child, parent) and alts (alt, main); one stanza is one row."""
    stanzas = spark.read.text(path, lineSep="\n\n").where(F.col("value").rlike(r"(^|\n)\[Term\]"))
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}:\s*(.*?)\s*$", 1)
    every = lambda name: F.regexp_extract_all("value", F.lit(rf"(?m)^{name}:\s*([^\s!]+)"), F.lit(1))
    rows = stanzas.select("value", field("id").alias("id"))
    terms = rows.select("id", field("name").alias("name"), field("namespace").alias("namespace"), F.trim(F.concat_ws(" ", field("def"), field("comment"))).alias("desc"), (field("is_obsolete") == "true").alias("is_obsolete"))
    rels = rows.select(F.col("id").alias("child"), F.explode(every("is_a")).alias("parent")).distinct()
    alts = rows.select(F.explode(every("alt_id")).alias("alt"), F.col("id").alias("main")).distinct()
    return terms, rels, alts


def read_gene_terms(spark: SparkSession, path: str, gene_col: int = 0, term_col: int = 1, cut: bool = True) -> DataFrame:
    """gene and term; lines that begin with # or ! are skipped; cut: genes end at the first underscore."""
    parts = spark.read.text(path).where(~F.col("value").rlike("^[#!]")).select(F.split("value", "\t").alias("p"))
    gene = F.get("p", F.lit(gene_col))
    return parts.select(F.upper(F.substring_index(gene, "_", 1) if cut else gene).alias("gene"), F.trim(F.get("p", F.lit(term_col))).alias("term")).where("gene <> '' and term <> ''").distinct()


def gwas_from_dataframe(df: DataFrame, term: str, chrom: str, pos: str | None = None, start: str | None = None, end: str | None = None, id_col: str | None = None, window: int = 1) -> DataFrame:
    """term, id, chrom, start, end, window and attr (texts of the other columns); one row for each place of a term."""
    low, high = (F.col(pos), F.col(pos)) if pos else (F.col(start), F.col(end))
    used = {term, chrom, pos, start, end, id_col} - {None}
    others = [c for c in df.columns if c not in used or (pos and c in (start, end))]
    attr = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*[F.col(c).cast("string") for c in others])) if others else F.create_map().cast("map<string,string>")
    place = F.concat(F.lit("<None>"), F.col(chrom).cast("string"), F.lit(":"), low.cast("string"), F.lit("-"), high.cast("string"))
    rows = df.select(F.col(term).cast("string").alias("term"), (F.col(id_col).cast("string") if id_col else place).alias("id"), F.col(chrom).cast("string").alias("chrom"), F.greatest(low.cast("long"), F.lit(0)).alias("start"), high.cast("long").alias("end"), F.lit(window).cast("long").alias("window"), attr.alias("attr"))
    return rows.dropDuplicates(["term", "chrom", "start", "end"])


def read_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.csv(f"{folder}/*.overlap.tsv", sep="\t", header=True, inferSchema=True)


def with_trait_type(rows: DataFrame, term: str = "Term") -> DataFrame:
    t = F.col(term)
    return rows.withColumn("trait_type", F.when(t.startswith("Log"), "Log").when(t.startswith("PCA"), "PCA").when(t.startswith("Trans"), "Trans").otherwise("Element"))


def read_coordinates(spark: SparkSession, path: str, invert_y: bool = True) -> DataFrame:
    """gene, x and y of a Cytoscape network file."""
    nodes = spark.read.json(path, multiLine=True).select(F.explode("elements.nodes").alias("n"))
    y = F.col("n.position.y").cast("double")
    return nodes.select(F.col("n.data.id").alias("gene"), F.col("n.position.x").cast("double").alias("x"), (-y if invert_y else y).alias("y"))
