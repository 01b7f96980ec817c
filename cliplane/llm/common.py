"""Shared plumbing: durable intermediate tables and row-preserving Arrow scans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one in-memory piece of an Arrow batch may hold (a longer document is a piece by itself).
PIECE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir; on one machine (tests) a temporary one if unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cliplane-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the written table that materialise returned, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    base = shared_dir(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName() and base.split(":", 1)[-1].rstrip("/") in folder:
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in column at (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < n:
        j = int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right"))
        j = min(n, max(j, i + 1))
        yield batch.slice(i, j - i)
        i = j


def scan_text(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    fields: Sequence[T.StructField],
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
    cast: str | None = "string",
) -> DataFrame:
    """Append columns computed from a text (or, with cast = None, binary) column, partition by partition and without a shuffle.

    make() runs once in each task and returns a function from a text array to one array for each field.
    keep: the input columns to carry (default all). Where a carried column has the name of a new one, the new one replaces it.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    cols = keep + [text_col] * (text_col not in keep)
    at = cols.index(text_col)
    source = df.select(*[quoted(c).cast(cast).alias(c) if c == text_col and cast else quoted(c) for c in cols])
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))
    kept = range(len(keep))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in pieces(batch, at, piece_bytes):
                out = fn(part.column(at))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + list(out), names=names)

    return source.mapInArrow(run, schema)


def lists(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    """Arrow list array from its values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
