"""Tables between steps: they cut lineage, so that plans stay small and lost executors cost one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Writes frames as Parquet in the folder of ``spark.checkpoint.dir``; a temporary one, only where that is unset."""

    def __init__(self, spark: SparkSession):
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            folder = tempfile.mkdtemp(prefix="gristmill-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.root, self.n = spark, f"{folder.rstrip('/')}/steps-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
