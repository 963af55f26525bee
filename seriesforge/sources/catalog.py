"""Tables in folders: registration as views, parametrised SQL, CSV with required columns, appends."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Catalog:
    """Views over the Parquet files or folders of a data folder, under logical names."""

    def __init__(self, spark: SparkSession, folder: str, names: Mapping[str, str] | None = None):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), dict(names or {})

    def physical(self, name: str) -> str:
        return self.names.get(name, name)

    def read(self, name: str) -> DataFrame | None:
        """The table's file or folder of files; None if neither is there."""
        for path in (f"{self.folder}/{self.physical(name)}.parquet", f"{self.folder}/{self.physical(name)}"):
            try:
                return self.spark.read.parquet(path)
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        return None

    def register(self, name: str) -> bool:
        """Makes the table a view, once; False if it isn't there."""
        if self.spark.catalog.tableExists(name):
            return True
        if (rows := self.read(name)) is None:
            return False
        rows.createOrReplaceTempView(name)
        return True

    def register_all(self, names: Sequence[str]) -> list[str]:
        return [n for n in names if self.register(n)]

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def query(self, text: str, **parameters) -> DataFrame:
        """SQL with named parameters (:name), which are values and never text."""
        return self.spark.sql(text, args=parameters)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds part files; columns go by name, so older files may lack some."""
        rows.write.mode("append").parquet(f"{self.folder}/{self.physical(name)}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new table in the old one's place: written beside it, then renamed; the old files go last.

        A failure leaves the old table, or both under names that :meth:`recover` puts right.
        """
        path = f"{self.folder}/{self.physical(name)}"
        rows.write.mode("overwrite").parquet(f"{path}.new")
        fs, at = self._files(path)
        if fs.exists(at(path)):
            fs.delete(at(f"{path}.old"), True)
            fs.rename(at(path), at(f"{path}.old"))
        fs.rename(at(f"{path}.new"), at(path))
        fs.delete(at(f"{path}.old"), True)

    def recover(self, name: str) -> None:
        """Finishes or undoes a replacement that was cut off between its renames."""
        path = f"{self.folder}/{self.physical(name)}"
        fs, at = self._files(path)
        if not fs.exists(at(path)):
            for other in (f"{path}.new/_SUCCESS", f"{path}.old"):
                if fs.exists(at(other)):
                    fs.rename(at(other.removesuffix("/_SUCCESS")), at(path))
                    break

    def merge(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Appends rows to the table; rows with the same keys take the old ones' place. Readers see the old or the new table."""
        from ..operators.ledger import upsert

        old = self.read(name)
        self.replace(name, rows if old is None else upsert(old, rows, keys))

    def ensure(self, name: str, schema: StructType) -> DataFrame:
        """The table, made empty if it isn't there; columns of the schema that it lacks are an error."""
        if (rows := self.read(name)) is None:
            self.truncate(name, schema)
            rows = self.read(name)
        if missing := [c for c in schema.names if c not in rows.columns]:
            raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
        return rows

    def cached(self, name: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        """The stored table; computed and stored if it isn't there or is to be refreshed."""
        if refresh or self.read(name) is None:
            self.replace(name, compute())
        return self.read(name)

    def register_folder(self) -> dict[str, str]:
        """Every table of the folder as a view under its logical name: {logical name: physical name}."""
        logical = {physical: name for name, physical in self.names.items()}
        fs, at = self._files(self.folder)
        found = {}
        for entry in fs.listStatus(at(self.folder)):
            physical = entry.getPath().getName().removesuffix(".parquet")
            if not physical.startswith(("_", ".")) and not physical.endswith((".new", ".old")) and self.register(name := logical.get(physical, physical)):
                found[name] = physical
        return found

    def _files(self, path: str):
        """(the path's file system, names to paths)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return at(path).getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def truncate(self, name: str, schema: StructType) -> None:
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.folder}/{self.physical(name)}")


def read_csv(spark: SparkSession, path: str, required: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; columns that are asked for and missing are an error."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return rows


def concatenated(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str], limit_id: int | None = None) -> DataFrame:
    """Chunk files of one table put together: the given columns by name and type, null where a chunk lacks one, ids below the limit."""
    rows = None
    for path in paths:
        chunk = spark.read.parquet(path)
        chunk = chunk.select(*[(F.col(c) if c in chunk.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
        rows = chunk if rows is None else rows.unionByName(chunk)
    if rows is None:
        raise ValueError("no chunks")
    return rows if limit_id is None else rows.where(F.col("entity") < limit_id)


def tail_events(rows: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """Events as time and value in order; rows where either isn't a number go."""
    return numeric(rows.select(F.col(time).alias("time"), F.col(value).alias("value")), ["time", "value"]).orderBy("time", "value")


def numeric(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; rows where one isn't a number go."""
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns}).dropna(subset=list(columns))


def push(rows: DataFrame, url: str, target: str, stored: int, properties: Mapping[str, str] | None = None) -> bool:
    """Replaces a database table by the rows, unless they are under a tenth of more than a hundred stored ones."""
    if stored > 100 and rows.count() < 0.1 * stored:
        return False
    rows.write.jdbc(url, target, mode="overwrite", properties=dict(properties or {}))
    return True


def pull(spark: SparkSession, url: str, source: str, key: str, low: int, high: int, partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Reads a database table in ranges of its key, one task each."""
    return spark.read.jdbc(url, source, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=dict(properties or {}))
