"""Single records of a dataset's tables: added, replaced, removed and looked up, as new DataFrames.

genes has id, chrom, start, end; attrs id, key, val; chromosomes id, length; aliases alias, id;
annotations id, desc; terms id and more; term_loci term, gene; term_attrs term, key, val.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genonet.functions.ordered import one_each
from genonet.sources.catalog import GeneAbsentError
from genonet.sources.readers import resolve


class RecordExistsError(ValueError):
    """A record with this key is there already."""


def replaced(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """old with new rows in place of those of the same key; of equal keys in ``new`` the last by ``order`` stays."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(one_each(new, key, order).select(*[c for c in new.columns if c != order or c in old.columns]), allowMissingColumns=True)


def kept_first(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """old and those new rows whose key it lacks; of equal keys in ``new`` the first by ``order`` stays."""
    new = one_each(new, key, order, last=False).select(*[c for c in new.columns if c != order or c in old.columns])
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new rows; a key that is there, or twice in ``new``, raises."""
    clash = new.join(old.select(*key).distinct(), key, "left_semi").select(*key).union(new.groupBy(*key).count().where("count > 1").select(*key)).limit(1).collect()
    if clash:
        raise RecordExistsError(str(clash[0].asDict()))
    return old.unionByName(new, allowMissingColumns=True)


def add_genes(genes: DataFrame, attrs: DataFrame, new: DataFrame, new_attrs: DataFrame | None = None, aliases: DataFrame | None = None, other_aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """genes, attrs and aliases with new genes put in; another genome's aliases follow for those that lack one."""
    new = new.withColumn("id", F.upper("id"))
    if other_aliases is not None and aliases is not None:
        aliases = kept_first(aliases, other_aliases.join(new.select("id"), "id", "left_semi").select("alias", "id"), ["alias"])
    return replaced(genes, new, ["id"]), attrs if new_attrs is None else replaced(attrs, new_attrs.withColumn("id", F.upper("id")), ["id", "key"]), aliases


def remove_aliases(aliases: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """aliases without those of the given genes (gene), or without any."""
    return aliases.limit(0) if genes is None else aliases.join(genes.select(F.upper("gene").alias("id")).distinct(), "id", "left_anti").select(*aliases.columns)


def remove_annotations(annotations: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """annotations without those of the given genes (gene), or without any."""
    return annotations.limit(0) if genes is None else annotations.join(genes.select(F.upper("gene").alias("id")).distinct(), "id", "left_anti").select(*annotations.columns)


def genome_of(tables: dict[str, DataFrame], wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """A genome's tables (genes, gene_attrs, chromosomes, aliases, annotations, as far as they are there) with the wanted genes (gene) alone, or all: a copy or a filtered genome.

    Aliases, attributes and annotations follow their genes; chromosomes stay. Wanted names that are aliases
    stand for their gene; unknown ones are left out.
    """
    if wanted is None:
        return dict(tables)
    genes = tables["genes"]
    names = wanted.select(F.col("gene").alias("name"))
    ids = resolve(names, genes, tables["aliases"]).select(F.col("gene").alias("id")) if "aliases" in tables else names.select(F.upper("name").alias("id"))
    ids = ids.distinct()
    return {k: t if k == "chromosomes" else t.join(ids, "id", "left_semi").select(*t.columns) for k, t in tables.items()}


def add_chromosomes(chromosomes: DataFrame, new: DataFrame) -> DataFrame:
    return replaced(chromosomes, new, ["id"])


def add_terms(terms: DataFrame, term_loci: DataFrame, new: DataFrame, new_loci: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """terms and term_loci with new terms; one that is there raises unless overwritten."""
    if overwrite:
        terms, term_loci = del_terms(terms, term_loci, new.select("id"))
    return inserted(terms, new, ["id"]), term_loci.unionByName(new_loci.distinct())


def del_terms(terms: DataFrame, term_loci: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the terms of ``gone`` (id)."""
    ids = gone.select("id").distinct()
    return terms.join(ids, "id", "left_anti"), term_loci.join(ids.withColumnRenamed("id", "term"), "term", "left_anti")


def from_ids(names: DataFrame, genes: DataFrame, aliases: DataFrame, check_shape: bool = False) -> DataFrame:
    """name and the gene it stands for, by id or alias; check_shape: an unknown name raises, else it is left out."""
    found = resolve(names.select("name"), genes, aliases)
    if check_shape and (lost := names.join(found.select("name"), "name", "left_anti").limit(1).collect()):
        raise GeneAbsentError(lost[0]["name"])
    return found.join(genes.select(F.col("id").alias("gene"), "chrom", "start", "end"), "gene")


def aliases_of(genes: DataFrame, aliases: DataFrame) -> DataFrame:
    """gene and its aliases, for those that have any."""
    return aliases.join(genes.select(F.upper("gene").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("gene")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def annotations_of(genes: DataFrame, annotations: DataFrame) -> DataFrame:
    """gene and its descriptions, for those that have any; all genes' for a genome, to export."""
    return annotations.join(genes.select(F.upper("gene").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("gene")).agg(F.array_sort(F.collect_set("desc")).alias("desc"))


def random_terms(terms: DataFrame, n: int = 1, seed: int = 1) -> DataFrame:
    """n terms, the same for the same seed."""
    return terms.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def chromosome(chromosomes: DataFrame, name: str) -> DataFrame:
    """The chromosome's row; one that is not there raises."""
    row = chromosomes.where(F.col("id") == str(name))
    if row.isEmpty():
        raise ValueError(f"no chromosome {name}")
    return row


def with_attrs(rows: DataFrame, attrs: DataFrame, key: str = "id") -> DataFrame:
    """rows with their attributes (key, key and val) as a map ``attr``, empty for none; of a key's values the largest stays."""
    one = attrs.groupBy(F.col(key).alias("_id"), "key").agg(F.max("val").alias("val"))
    maps = one.groupBy("_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "val")))).alias("attr"))
    out = rows.join(maps, F.col(key) == F.col("_id"), "left").drop("_id")
    return out.withColumn("attr", F.coalesce("attr", F.create_map().cast(maps.schema["attr"].dataType)))


def as_record(loci: DataFrame, fields: tuple[str, ...] = ("id", "chrom", "start", "end")) -> DataFrame:
    """Each locus as one map of texts, ``record``: its own fields, and its attributes where they do not clash with these."""
    own = F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c).cast("string"))])
    attr = F.map_filter("attr", lambda k, _: ~k.isin(*fields)) if "attr" in loci.columns else F.create_map().cast("map<string,string>")
    return loci.select(F.map_concat(own, F.coalesce(attr, F.create_map().cast("map<string,string>"))).alias("record"))


def from_record(records: DataFrame) -> DataFrame:
    """Loci (id, chrom, start, end, attr) of maps of texts; whatever is no field is an attribute. A missing end is the start."""
    get = lambda c: F.col("record")[c]
    attr = F.map_filter("record", lambda k, _: ~k.isin("id", "chrom", "start", "end"))
    return records.select(get("id").alias("id"), get("chrom").alias("chrom"), get("start").cast("long").alias("start"), F.coalesce(get("end"), get("start")).cast("long").alias("end"), attr.alias("attr"))


def add_loci(term_loci: DataFrame, term: str, genes: DataFrame) -> DataFrame:
    """term_loci with the genes (gene) in the term as well, each once."""
    return term_loci.unionByName(genes.select(F.lit(term).alias("term"), "gene")).distinct()


def copy_term(terms: DataFrame, term_loci: DataFrame, old: str, new: str, desc: str | None = None, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """terms and term_loci with a copy of a term under another id, with the old one's genes and the given ones; an id that is there raises."""
    own = terms.where(F.col("id") == old)
    if own.isEmpty():
        raise ValueError(f"no term {old}")
    row = own.withColumn("id", F.lit(new))
    if desc is not None and "desc" in terms.columns:
        row = row.withColumn("desc", F.lit(desc))
    loci = term_loci.where(F.col("term") == old).withColumn("term", F.lit(new))
    if genes is not None:
        loci = add_loci(loci, new, genes)
    return inserted(terms, row, ["id"]), term_loci.unionByName(loci.distinct())


def add_parents(rels: DataFrame, term: str, parents: list[str]) -> DataFrame:
    """rels with is_a links of a term, each once."""
    return rels.unionByName(rels.sparkSession.createDataFrame([(term, p) for p in parents], "child string, parent string")).distinct()


def add_alts(alts: DataFrame, term: str, others: list[str]) -> DataFrame:
    """alts with other ids of a term; an id that stands for another term already raises."""
    return inserted(alts, alts.sparkSession.createDataFrame([(a, term) for a in others], "alt string, main string").join(alts, ["alt", "main"], "left_anti"), ["alt"])
