"""Named datasets: a folder of Parquet tables for each, and a catalog table of what there is."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genonet.sources.shared import latest, write_version

FIELDS = "name string, type string, description string, tables array<string>, params string, added timestamp"


#: Tables of a new, empty dataset of each kind.
SCHEMAS = {
    "RefGen": {"genes": "id string, chrom string, start long, end long", "gene_attrs": "id string, key string, val string", "chromosomes": "id string, length long", "aliases": "alias string, id string", "annotations": "id string, desc string"},
    "Expr": {"expr": "gene string, accession string, value double", "qc_gene": "gene string, pass_all boolean", "qc_accession": "accession string, pass_all boolean"},
    "COB": {"expr": "gene string, accession string, value double", "genes": "id string, chrom string, start long, end long", "edges": "gene_a string, gene_b string, r double, score double, distance double, significant boolean", "degree": "gene string, degree long", "qc_gene": "gene string, pass_all boolean", "qc_accession": "accession string, pass_all boolean"},
    "Ontology": {"terms": "id string, desc string", "term_loci": "term string, gene string"},
    "GOnt": {"terms": "id string, name string, desc string", "rels": "child string, parent string", "alts": "alt string, main string", "term_loci": "term string, gene string"},
    "GWAS": {"snps": "term string, id string, chrom string, start long, end long, window long, attr map<string,string>"},
}


class DatasetExistsError(ValueError):
    """A dataset of this name and type is there already."""


class GeneAbsentError(KeyError):
    """A gene is not in the dataset."""


@dataclass
class Catalog:
    """Datasets under one folder that Spark can reach. The catalog has a row file for each dataset, so writers of different ones do not meet."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _home(self, kind: str, name: str) -> str:
        return f"{self.root}/data/{kind}/{name}"

    def _entry(self, kind: str, name: str) -> str:
        return f"{self.root}/catalog/type={kind}/name={name}"

    def save(self, kind: str, name: str, description: str, tables: dict[str, DataFrame], params: dict | None = None, force: bool = False) -> None:
        if not force and self.exists(kind, name):
            raise DatasetExistsError(f"{kind} {name}")
        for table, df in tables.items():
            write_version(df, f"{self._home(kind, name)}/{table}")
        entry = self.spark.createDataFrame([(description, sorted(tables), json.dumps(params or {}))], "description string, tables array<string>, params string").withColumn("added", F.current_timestamp())
        entry.coalesce(1).write.mode("overwrite").parquet(self._entry(kind, name))

    def create(self, kind: str, name: str, description: str, force: bool = False) -> None:
        """A dataset of the kind with empty tables; with ``force`` in place of one that is there."""
        self.save(kind, name, description, {t: self.spark.createDataFrame([], schema) for t, schema in SCHEMAS[kind].items()}, force=force)

    def params(self, kind: str, name: str) -> dict:
        return json.loads(self.spark.read.parquet(self._entry(kind, name)).first()["params"])

    def set_params(self, kind: str, name: str, **values) -> None:
        """Sets parameters kept with a dataset, such as strongest_attr and strongest_higher; None leaves one as it is."""
        entry = self.spark.read.parquet(self._entry(kind, name)).collect()[0]
        kept = json.loads(entry["params"]) | {k: v for k, v in values.items() if v is not None}
        self._write_entry(kind, name, (entry["description"], entry["tables"], json.dumps(kept), entry["added"]))

    def _write_entry(self, kind: str, name: str, row: tuple) -> None:
        self.spark.createDataFrame([row], "description string, tables array<string>, params string, added timestamp").coalesce(1).write.mode("overwrite").parquet(self._entry(kind, name))

    def exists(self, kind: str, name: str) -> bool:
        fs, p = self._fs(self._entry(kind, name))
        return bool(fs.exists(p))

    def tables(self, kind: str, name: str) -> list[str]:
        return list(self.spark.read.parquet(self._entry(kind, name)).first()["tables"])

    def load(self, kind: str, name: str, table: str) -> DataFrame:
        return latest(self.spark, f"{self._home(kind, name)}/{table}")

    def datasets(self, kind: str | None = None, like: str = "%") -> DataFrame:
        fs, p = self._fs(f"{self.root}/catalog")
        if not fs.exists(p):
            return self.spark.createDataFrame([], FIELDS)
        rows = self.spark.read.option("basePath", f"{self.root}/catalog").parquet(f"{self.root}/catalog").select("name", "type", "description", "tables", "params", "added")
        rows = rows.where(F.col("name").cast("string").like(like))
        return rows if kind is None else rows.where(F.col("type") == kind)

    def remove(self, kind: str, name: str) -> None:
        """Deletes a dataset; an expression set takes its filtered genome and its clusters with it."""
        for k, n in [(kind, name), *([("RefGen", f"Filtered{name}"), ("Ontology", f"{name}MCL")] if kind in ("Expr", "COB") else [])]:
            for path in (self._entry(k, n), self._home(k, n)):
                fs, p = self._fs(path)
                if fs.exists(p):
                    fs.delete(p, True)

    def move(self, kind: str, name: str, new: str) -> None:
        if self.exists(kind, new):
            raise DatasetExistsError(f"{kind} {new}")
        for path in (self._home, self._entry):
            fs, p = self._fs(path(kind, name))
            _, q = self._fs(path(kind, new))
            fs.mkdirs(q.getParent())
            fs.rename(p, q)

    def redescribe(self, kind: str, name: str, description: str) -> None:
        entry = self.spark.read.parquet(self._entry(kind, name)).collect()
        self._write_entry(kind, name, (description, entry[0]["tables"], entry[0]["params"], entry[0]["added"]))
