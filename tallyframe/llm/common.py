"""Shared plumbing: tables in the shared folder, keys, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the word-level operators: space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_paths: dict[int, str] = {}
#: Tables are written to a local folder without checksum files: Hadoop starts a process for every file and folder
#: that it makes there, to set its mode, and until that runs chmod it counts as a second copy of the JVM's memory.
#: Other file systems are not concerned.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: What Python workers keep between tasks; steps marked ``tidy`` empty them.
CACHES: list[dict] = []


def _drop_caches() -> None:
    for kept in CACHES:
        kept.clear()


def _give_back() -> None:
    """Return to the system what the allocators hold free."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """A step whose worker holds little when idle.  Workers outlive their tasks,
    and what they hold adds to the heap of the executor's JVM: other operators'
    caches go before the step, and memory that it no longer uses after it."""

    @functools.wraps(run)
    def step(batches):
        _drop_caches()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return step


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees; a temporary one only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks, not the steps
    before.  The shuffles of steps whose tables are written are released first,
    and ``forget`` removes a table that no later step reads.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **LOCAL).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables.  Nothing lazy may still read them."""
    for df in tables:
        if path := _paths.pop(id(df), None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Half of a row's key.  Rows that agree in id and text have equal results,
    so (id, text_key) may stand for the row even where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, null as empty, no copy of the text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Bytes of text that a Python step works on at a time; a longer document goes alone.
SLICE = 1 << 20


def slices(offs: np.ndarray, limit: int = SLICE):
    """(a, b): runs of whole documents offs[a:b + 1] of about ``limit`` bytes."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(int(np.searchsorted(offs, offs[a] + limit, "right")) - 1, a + 1)
        yield a, b
        a = b


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each of 0..n-1's component under the edges (u, v)."""
    label = np.arange(n)
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label


@tidy
def _forest(batches):
    """Replace a task's edges by stars with the same components."""
    import pandas as pd

    for pdf in batches:
        ids, codes = np.unique(np.concatenate([pdf.u.to_numpy(), pdf.v.to_numpy()]), return_inverse=True)
        root = roots(codes[: len(pdf)], codes[len(pdf) :], len(ids))
        yield pd.DataFrame({"u": ids, "v": ids[root]})[lambda x: x.u != x.v]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (u, v: long, no nulls).

    Alternating large-star and small-star passes: each is a min per node and a
    join on the node, so no component is ever gathered in one task.
    """
    schema = "u long, v long"
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    e = materialize(e.mapInPandas(_forest, schema).distinct(), "edges")
    total = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    state = total(e)
    while state[0]:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        old, e = e, materialize(small, "edges")
        forget(old)
        before, state = state, total(e)
        if before == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
