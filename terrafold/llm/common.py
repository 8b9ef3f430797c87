"""Helpers the text operators share: written tables that cut lineage, free column names, samples, sorted group iteration."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that count as white space wherever a contract speaks of words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings while a table is written: its shuffle files go when it ends, and batches to Python are of bounded bytes, so that
#: rows with whole texts or sets do not fill a worker.
_WHILE_WRITING = {_CLEAN_UP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
_LOCK, _WRITERS = threading.Lock(), {"n": 0}
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this process in
    local mode, which goes when the process ends; an error on a cluster, whose machines share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="terrafold-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _while_writing(spark: SparkSession) -> Iterator[None]:
    """_WHILE_WRITING holds from the first of several writers at once to the last; then what was set before holds again."""
    with _LOCK:
        if not _WRITERS["n"]:
            _WRITERS["before"] = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
        _WRITERS["n"] += 1
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS["n"] -= 1
            if not _WRITERS["n"]:
                for k, v in _WRITERS["before"].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, columns stay prunable.

    The write's own shuffle files go when it ends. The table goes with discard(), else when the driver ends."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with _while_writing(spark):
        df.write.option("compression", compression).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t._written
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns of df; a missing one is an error that names it."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {', '.join(missing)}")
    return df.select(*names)


def with_row(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, str, bool]:
    """docs with a long column that tells rows apart, its name, and whether it is the id: else numbers in a written table."""
    row = free_name(docs, "_row")
    plain = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    if plain and docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs.withColumn(row, F.col(id_col).cast("long")), row, True
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row, False


def numbered(df: DataFrame, keys: list[Column], name: str, table: str) -> DataFrame:
    """df with the place of each row (a long from 0) in the order of keys, from a range partitioning and per-partition offsets."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), table)
    part, inside = F.shiftrightunsigned(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition: bounded by the number of partitions
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + inside).cast("long")).drop("_part", "_start")


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves that remainder."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % modulus) == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of key: the same ones at every partitioning.

    Only keys are sorted; their list, of `rows` entries at most, is broadcast to pick the rows."""
    chosen = df.select(key).distinct().orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)
    return df.join(F.broadcast(chosen), key, "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, name: str) -> DataFrame:
    """doc_id, text and label of at most `rows` documents with text and a label, those whose id has the smallest hash.

    The list of ids, of `rows` entries at most, is broadcast; only the chosen documents' texts move, into a table.
    An id that is labelled or occurs more than once counts once: its least label, its least text."""
    marked = need(labels, "doc_id", label).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias(label))
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    found = need(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return materialize(found.groupBy("doc_id", label).agg(F.min("text").alias("text")), name)


def by_group(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Groups of rows with one key, from batches that come sorted by it."""
    held: list[pd.DataFrame] = []
    held_key = None
    for batch in batches:
        if batch.empty:
            continue
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), len(keys)]
        for a, b in zip(starts, ends):
            if held and keys[a] != held_key:
                yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held_key = keys[a]
            held.append(batch.iloc[a:b])
    if held:
        yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def text_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about `size` bytes: Python strings are made of one list at a time, not of a whole batch,
    whose size is a setting of whoever runs the query."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield texts.slice(a, b - a).to_pylist()
        a = b


def struct_of(parts: list[pd.DataFrame], fields: dict[str, pa.DataType]) -> pa.StructArray:
    """One Arrow struct array of frames on end; of none an empty one."""
    columns = [pa.chunked_array([pa.array(p[c], t) for p in parts], t).combine_chunks() for c, t in fields.items()]
    return pa.StructArray.from_arrays(columns, list(fields))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; TOKENIZERS_DIR overrides the installed package's folder."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
