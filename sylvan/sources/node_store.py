"""The node store on disk: typed Parquet tables, one folder for each run.

Nodes are partitioned by level, vectors live in a table of their own, so an update of vectors
does not rewrite texts. Writing replaces whole documents, so no stale rows of an earlier run stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sylvan import schemas
from sylvan.operators import store

TABLES = {"nodes": schemas.NODES, "edges": schemas.EDGES, "trees": schemas.TREES, "embeddings": schemas.EMBEDDINGS}
PARTITIONS = {"nodes": ["level"]}


class NodeStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the documents of ``rows``, keep all others. The new table is complete before it
        takes the old one's place."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = rows.select(*[c if c in rows.columns else F.lit(None).alias(c) for c in columns])
        kept = self.read(name).join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select(*columns)
        target = f"{self.path}/{name}"
        fresh = f"{target}.new"
        kept.unionByName(rows).write.mode("overwrite").partitionBy(*PARTITIONS.get(name, [])).parquet(fresh)
        self._swap(fresh, target)

    def _swap(self, fresh: str, target: str) -> None:
        jvm = self.spark.sparkContext._jvm
        to, old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (target, target + ".old", fresh))
        fs = to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        if fs.exists(to):
            fs.rename(to, old)
        fs.rename(new, to)
        fs.delete(old, True)

    def update_embeddings(self, vectors: DataFrame) -> None:
        """Upsert ``doc_id, node_id, embedding``; null vectors change nothing."""
        new = vectors.where("embedding is not null")
        both = store.upsert(self.read("embeddings"), new, ["doc_id", "node_id"], [])
        self.write("embeddings", both)

    def get(self, node_id: str) -> dict | None:
        """One node by id (pushed down to the files), or None."""
        row = self.read("nodes").where(F.col("node_id") == node_id).first()
        return row.asDict() if row else None
