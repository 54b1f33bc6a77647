"""Table discovery over any Hadoop file system and a lazy catalog of the tables found."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from staywise.functions.vocab import TABLE_PREFIXES, TABLE_SUFFIXES


def table_key(file_name: str) -> str:
    """Bare lower-case table name of a parquet file or directory."""
    stem = file_name.rstrip("/").rsplit("/", 1)[-1]
    for suffix in TABLE_SUFFIXES:
        stem = stem.removesuffix(suffix)
    stem = stem.lower()
    prefix = next((p for p in TABLE_PREFIXES if stem.startswith(p)), "")
    return stem[len(prefix) :]


class TableCatalog(Mapping):
    """Read-only mapping of table name to lazy DataFrame. Lookups ignore case."""

    def __init__(
        self,
        spark: SparkSession,
        paths: Mapping[str, str] | None = None,
        frames: Mapping[str, DataFrame] | None = None,
    ) -> None:
        self.spark = spark
        self.paths = {name.lower(): path for name, path in (paths or {}).items()}
        self._frames = {name.lower(): frame for name, frame in (frames or {}).items()}
        self._names = sorted({*self.paths, *self._frames})

    @classmethod
    def discover(cls, spark: SparkSession, root: str, pattern: str = "*.parquet") -> TableCatalog:
        """Register every match of ``pattern`` directly under ``root`` (local, HDFS or object store)."""
        jvm = spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(str(root))
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            raise FileNotFoundError(f"data root does not exist: {root}")
        matches = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, pattern)) or []
        paths: dict[str, str] = {}
        for location in sorted(status.getPath().toString() for status in matches):
            key = table_key(location)
            if key in paths:
                raise ValueError(f"Duplicate table name {key!r}: {paths[key]} and {location}")
            paths[key] = location
        if not paths:
            raise FileNotFoundError(f"no parquet tables match {pattern!r} under {root}")
        return cls(spark, paths=paths)

    def __getitem__(self, name: str) -> DataFrame:
        key = name.lower()
        if key not in self._frames:
            if key not in self.paths:
                raise KeyError(f"missing table {name!r}; available tables: {', '.join(self._names)}")
            self._frames[key] = self.spark.read.parquet(self.paths[key])
        return self._frames[key]

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and name.lower() in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        """A table, optionally cut to any ``limit`` rows for inspection."""
        return self[name] if limit is None else self[name].limit(limit)

    def inventory(self) -> DataFrame:
        """One row per table: name, path (null for tables given as frames) and column count."""
        rows = [(name, self.paths.get(name), len(self[name].columns)) for name in self]
        return self.spark.createDataFrame(rows, "`table` string, path string, n_columns int")
