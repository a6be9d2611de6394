"""Tables, shared storage and small helpers that the corpus operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: What separates words everywhere in this subpackage: space and the ASCII controls tab to carriage return.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    On a local master, where both are one process, a temporary folder stands in for it; elsewhere it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, has sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and that nothing reads any more."""
    session = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Texts that a worker turns into Python strings at a time: so many, and so many bytes unless one text alone is longer.
SLICE_ROWS, SLICE_BYTES = 256, 2_000_000


def text_slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Every batch in pieces whose column number ``text`` is short; no row is left out or cut."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < whole.num_rows:
            end, held = at + 1, int(sizes[at])
            while end < min(at + SLICE_ROWS, whole.num_rows) and held + sizes[end] <= SLICE_BYTES:
                held += int(sizes[end])
                end += 1
            yield whole.slice(at, end - at)
            at = end


def map_texts(rows: DataFrame, text: str, made: str, of: Callable[[list[str]], list], *, keep_text: bool = False) -> DataFrame:
    """rows with the columns ``made`` (DDL) that ``of`` makes of a list of texts, one list or array a column.

    Null texts reach ``of`` as empty ones. All other columns pass through the worker unread, so that nothing has to be
    held back and matched up again; ``text`` itself is left out unless keep_text. A worker holds one slice of texts as
    strings, whatever the number of rows in a batch.
    """
    added = StructType.fromDDL(made)
    types = [to_arrow_type(f.dataType) for f in added]
    at = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if keep_text or i != at]
    names = [rows.columns[i] for i in kept] + added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            found = of([t or "" for t in part.column(at).to_pylist()])
            columns = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *columns], names=names)

    return rows.mapInArrow(run, StructType([rows.schema[i] for i in kept] + list(added)))
