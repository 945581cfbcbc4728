"""What the operators of this subpackage share: word patterns, table access, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and a word, for Java and Python alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, as in tests, a local run gets a folder of its own; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = context._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="argosy-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Computes `df` once and cuts its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """`df`, after bounding the session's Arrow batches: whole texts are long, and a batch stands in memory several times."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return df


def text_of(name: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


_HELD: dict = {}


def held(key, make):
    """This Python worker's one large helper (a cache of words, an encoder): kept from task to task, and let go when another is asked for."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Returns freed memory to the system, as a worker that goes on to another operator would else hold what both need."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def each_text(docs: DataFrame, fn, schema: str, id_col: str = "doc_id") -> DataFrame:
    """The id and what `fn` makes of each batch of whole texts (null: empty): a list of rows, one for each text, by `schema`."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    docs = small_batches(docs).select(F.col(id_col), text_of().alias("_text"))
    out = StructType([docs.schema[id_col], *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            rows = fn(batch.column(1).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns))], schema=arrow)

    return docs.mapInArrow(run, out)
