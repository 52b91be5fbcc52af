"""Tables that change: versions of a Parquet folder, with vectors as the main use, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations as M


class Table:
    """A folder of whole versions. A change writes the next one; a version without its mark of success does not exist.

    One writer at a time; readers keep the version they opened. `keep` old versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *keys: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keys, self.keep = spark, path.rstrip("/"), schema, keys, keep

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        found = self.versions()
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(f"{self.path}/v{(found[-1] if found else 0) + 1}")
        fs, path = self._fs()
        for old in found[:-self.keep] if self.keep else found:
            fs.delete(path(f"{self.path}/v{old}"), True)

    def upsert(self, rows: DataFrame) -> None:
        self.write(M.upsert(self.read(), rows, *self.keys))

    def delete_where(self, condition: Column) -> None:
        self.write(self.read().filter(~F.coalesce(condition, F.lit(False))))

    def update(self, condition: Column, **values: Column) -> None:
        hit = F.coalesce(condition, F.lit(False))
        self.write(self.read().withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}))

    def count(self, condition: Column | None = None) -> int:
        return (self.read() if condition is None else self.read().filter(condition)).count()


class Vectors(Table):
    """chunk vectors with the columns that searches filter by; all of one dimension."""

    SCHEMA = "chunk_id string, embedding array<float>, user_id string, doc_id string, source_type string, excluded boolean, chunk_index int, page int"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, self.SCHEMA, "chunk_id")

    def dim(self) -> int | None:
        row = self.read().filter("embedding is not null").select(F.size("embedding")).first()
        return row[0] if row else None

    def upsert(self, rows: DataFrame) -> None:
        dim = self.dim()
        if dim is not None:
            M.check_dimension(rows, dim)
        super().upsert(rows)


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_graph(edges: DataFrame, path: str) -> None:
    """A graph's edges, and its nodes beside them."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().write.mode("overwrite").parquet(f"{path}/nodes")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
