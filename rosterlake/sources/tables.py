"""Tables on storage: versions that replace one another, appends, JDBC, and a probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A database's table; with a numeric key and its bounds, read in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, as Hadoop sees them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


class VersionedTable:
    """A table in a folder: each write is a new version, and readers see whole versions only.

    With a key its rows are parted by a hash of it into buckets, and a write may
    replace some of the buckets and leave the others in the versions where they
    are. Two writers never get the same version, but there should be one: what a
    write replaces is what its writer has read. Versions that no bucket needs are
    removed, except for the last few, which readers may still be at.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = 64, keep: int = 3) -> None:
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), key, keep
        self.buckets = buckets if key else 1
        self._fs, _ = _folder(spark, self.path)

    def _at(self, below: str):
        return _folder(self.spark, f"{self.path}/{below}")[1]

    def _names(self, below: str = "") -> list[str]:
        folder = self._at(below)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _versions(self) -> list[int]:
        """The versions that are complete, in order."""
        found = [n for n in self._names() if n[:1] == "v" and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in found if self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def _latest(self) -> dict[int, int]:
        """The version that holds each bucket."""
        return {int(n.split("=")[1]): v for v in self._versions() for n in self._names(f"v{v}") if n.startswith("bucket_=")}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most `buckets`

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table as it is, or some of its buckets; None if there is nothing."""
        paths = [f"{self.path}/v{v}/bucket_={b}" for b, v in sorted(self._latest().items()) if only is None or b in only]
        paths = [p for p in paths if any(n.startswith("part-") for n in self._names(p[len(self.path) + 1 :]))]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, df: DataFrame, only: list[int] | None = None) -> None:
        """A new version of the whole table, or of the buckets in only (df has no rows of others)."""
        version = max([*self._versions(), *(int(n[1:-5]) for n in self._names() if n.endswith(".lock"))], default=-1) + 1
        while not self._fs.createNewFile(self._at(f"v{version}.lock")):
            version += 1
        rows = df.withColumn("bucket_", self.bucket())
        rows = rows.repartition("bucket_") if self.key else rows  # a file for each bucket
        rows.write.partitionBy("bucket_").parquet(f"{self.path}/v{version}_")
        for b in range(self.buckets) if only is None else only:  # a bucket without rows is there, empty
            self._fs.mkdirs(self._at(f"v{version}_/bucket_={b}"))
        self._fs.rename(self._at(f"v{version}_"), self._at(f"v{version}"))
        needed = {*self._latest().values(), *self._versions()[-self.keep :]}
        for v in set(self._versions()) - needed:
            self._fs.delete(self._at(f"v{v}"), True)
            self._fs.delete(self._at(f"v{v}.lock"), False)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: Buckets of the results' folder, by a hash of request_id.
RESULT_BUCKETS = 64


def _result_bucket() -> Column:
    return F.pmod(F.xxhash64("request_id"), F.lit(RESULT_BUCKETS)).cast("int")


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All results that are stored; None if there never were any."""
    fs, folder = _folder(spark, path)
    return spark.read.parquet(path).drop("bucket_") if fs.exists(folder) and len(fs.listStatus(folder)) > 0 else None


def _kept_results(spark: SparkSession, path: str, gone: DataFrame, touched: list[int]) -> DataFrame | None:
    """The stored results in the buckets touched but for the requests that go, fixed before their files are replaced."""
    if read_results(spark, path) is None:
        return None
    old = spark.read.parquet(path).filter(F.col("bucket_").isin(touched)).drop("bucket_")
    return written(old.join(gone.select("request_id").distinct(), "request_id", "left_anti"), "results")


def _put_results(rows: DataFrame, path: str) -> None:
    dealt = rows.withColumn("bucket_", _result_bucket()).repartition("bucket_")  # a file for each bucket
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_").parquet(path)


def store_results(results: DataFrame, path: str) -> None:
    """Results by request_id; those of the requests in the batch are replaced, others stay. Only the buckets that these fall into are written."""
    fixed = written(results, "results")
    touched = [r[0] for r in fixed.select(_result_bucket()).distinct().collect()]  # at most RESULT_BUCKETS
    kept = _kept_results(results.sparkSession, path, fixed, touched)
    _put_results(fixed if kept is None else fixed.unionByName(kept), path)


def clear_results(spark: SparkSession, path: str, request_ids: DataFrame | None = None) -> None:
    """Takes out the results of some requests (column request_id), or all of them."""
    fs, folder = _folder(spark, path)
    if request_ids is None:
        fs.delete(folder, True)
        return
    touched = [r[0] for r in request_ids.select(_result_bucket()).distinct().collect()]
    kept = _kept_results(spark, path, request_ids, touched)
    if kept is None:
        return
    _put_results(kept, path)
    left = {r[0] for r in kept.select(_result_bucket()).distinct().collect()}
    for bucket in set(touched) - left:  # a bucket without rows is not replaced by the write
        fs.delete(_folder(spark, f"{path}/bucket_={bucket}")[1], True)


def lookup(rows: DataFrame, column: str, value: str, order: str = "id") -> DataFrame:
    """The first row with the value, by order."""
    return rows.filter(F.col(column) == value).orderBy(order).limit(1)


def probe(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS one").first()["one"] == 1
