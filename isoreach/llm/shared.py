"""What the operators share: tables in the cluster's shared folder, and joins with a measured small side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its measured rows take at most this many bytes.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run
    on this machine, as in tests; on a cluster a machine's own folder would lose rows, so that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="isoreach-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


class Stash:
    """A table written as Parquet into the shared folder, and df, which reads it: lineage is cut
    there, and a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/stash-{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        # the shuffle files of finished jobs go when the driver collects what refers to them
        spark._jvm.System.gc()
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def bytes_in_memory(self) -> int:
        """Its bytes on disk times 6, which bounds what its rows take in memory."""
        return 6 * self._fs.getContentSummary(self._at).getLength()

    def side(self, *cols, limit: int = BROADCAST_BYTES, grows: bool = False) -> DataFrame:
        """The columns as a join's small side: with a broadcast hint if the measured size is within
        the limit, else without, and the join is a shuffled one whose hot keys adaptive execution splits.
        A side that grows with the table is shuffled whatever its size, so that a small table shows what a large one takes."""
        out = self.df.select(*cols) if cols else self.df
        if grows:
            return out.hint("merge")
        return F.broadcast(out) if self.bytes_in_memory() <= limit else out

    def drop(self) -> None:
        """Delete the files, once no later step reads them."""
        self._fs.delete(self._at, True)


class Aside:
    """A caller's rows under names of their own (in_0, in_1, ...), so that no column of theirs can meet one
    of an operator's. The columns in replaced are left out, since the operator returns its own of that name."""

    def __init__(self, rows: DataFrame, replaced: Iterable[str] = ()):
        gone = set(replaced)
        self.names = [c for c in rows.columns if c not in gone]
        self.at = {c: f"in_{i}" for i, c in enumerate(self.names)}
        self.df = rows.drop(*gone).toDF(*self.at.values())

    def col(self, name: str) -> Column:
        return F.col(self.at[name])

    def back(self) -> list[Column]:
        """The columns under the caller's names."""
        return [F.col(made).alias(name) for name, made in self.at.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
