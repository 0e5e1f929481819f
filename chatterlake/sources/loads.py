"""What has been loaded already: a manifest of files by path, size and time, so that a rerun reads new files only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, length long, modificationTime timestamp"


@dataclass
class Manifest:
    spark: SparkSession
    path: str

    def known(self) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(FILES).parquet(self.path) if there else self.spark.createDataFrame([], FILES)

    def new_files(self, folder: str) -> DataFrame:
        """Files below a folder that aren't in the manifest, or have changed since. Their contents aren't read."""
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
        return there.join(self.known(), ["path", "length", "modificationTime"], "left_anti")

    def record(self, files: DataFrame) -> None:
        """To be called when what the files hold is stored: a load that is lost before is done again."""
        files.coalesce(1).write.mode("append").parquet(self.path)  # names of files
