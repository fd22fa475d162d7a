"""What the operators of this subpackage share: column picking, shared folders, written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has.

    An exact spelling wins over one that differs in case, the first of several
    equal names wins; so extra columns with clashing names do no harm.
    """
    columns = df.columns
    unique = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    chosen = []
    for name in names:
        exact = [i for i, c in enumerate(columns) if c == name]
        loose = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if not exact and not loose:
            raise ValueError(f"column {name!r} is not among {columns}")
        chosen.append(F.col(f"_c{(exact or loose)[0]}").alias(name))
    return unique.select(*chosen)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a folder of its own is made, on a local master only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="inkfield-")
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(_forget_local, own)
    return own


def _forget_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; what is left there goes when the driver exits."""
    path = f"{shared_dir(spark)}/inkfield-{what}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the driver exits
        pass


class Written:
    """A table cut off from its lineage: Parquet in the shared folder, read again."""

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, what)
        self.schema = df.schema
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def spread(df: DataFrame) -> DataFrame:
    """Rows read straight from files that make fewer tasks than there are cores, dealt out to as many; others as they are.

    A Parquet file cannot be split within a row group, so a small table would keep one core busy.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "FileScan" not in plan or "Exchange" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str, even: bool = True) -> DataFrame:
    """mapInArrow with per-task state: make() is called once a task; the function it
    returns takes a batch (and at the end None) and yields dicts of column lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for out in step(batch):
                yield as_batch(out, target)
        for out in step(None):
            yield as_batch(out, target)

    plain = df.toDF(*[f"p{i}" for i in range(len(df.columns))])  # mapInArrow looks columns up by name
    return (spread(plain) if even else plain).mapInArrow(run, schema)


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)
