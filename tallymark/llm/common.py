"""Helpers that the operators of this folder share.

Working tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and every executor can reach; a lost executor then costs a re-read and
not a recomputation.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of one Arrow batch, which a worker holds in memory, and rows of a slice of it.
BATCH_BYTES = 16 << 20
SLICE_ROWS = 512
#: Folders of local sessions without a shared one, and working tables that are left when the program ends.
_LOCAL: dict[str, str] = {}
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share. Only a local session that has none (tests) gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL.get(app) or _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tallymark-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, keeps true sizes.

    The files go when ``dropped`` is called or the program ends, while the session still runs then.
    """
    path = new_path(df.sparkSession, what)
    _LEFT[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallymark_path = path
    return out


def removed_at_end(spark: SparkSession, *paths: str) -> None:
    """Has files that a result is read from go when the program ends, while the session still runs then."""
    _LEFT.update(dict.fromkeys(paths, spark))


def dropped(*frames: DataFrame) -> None:
    """Removes the files of ``stored`` frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tallymark_path", None)
        if path:
            with suppress(Exception):
                remove_path(df.sparkSession, path)


@atexit.register
def _remove_left() -> None:
    """Results are read after the operators return, so what they read can only go at the end."""
    with suppress(Exception):  # the session may have been stopped
        for path, spark in list(_LEFT.items()):
            if spark.sparkContext._jsc is None:
                return
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches down to ``BATCH_BYTES``, so that long texts and whole files fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 (uint64 in and out)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches that come sorted by them. One group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``most_rows`` rows and, beyond one row, ``most_bytes`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, size = 0, 0
        for i in range(batch.num_rows):
            if i > start and (size + n[i] > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n[i])
        yield batch.slice(start)


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers, or ``name`` itself if it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def opened(path: str):
    """A file of the shared folder for range reads, ``read_at(n, offset)``, or None where Python doesn't know its store."""
    from pyarrow import fs

    try:
        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    except Exception:  # any failure of a store that only Spark reads
        return None


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a folder that aren't empty; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a folder that aren't empty."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def all_open(files: DataFrame) -> bool:
    """Whether Python opens the files of a folder, by its first one; true where there is none."""
    first = files.select("path").limit(1).collect()
    if not first:
        return True
    f = opened(first[0].path)
    if f is not None:
        f.close()
    return f is not None


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every piece, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(spark: SparkSession, edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, component) for edges (a, b): the smallest node that each can reach.

    Labels spread to neighbours and then jump along their own labels, so the
    rounds grow with the logarithm of the longest chain. All steps are joins
    and sums over rows of two numbers; nothing is gathered on the driver but
    one count a round. Self-edges are allowed; null ends are not.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{what}-edges")
    nodes = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    first = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    labels = stored(nodes.join(first, "v", "left").select("v", F.least("v", F.coalesce("m", "v")).alias("c")), what)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        spread = labels.join(near, "v", "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c1"))
        jumped = spread.join(labels.select(F.col("v").alias("c1"), F.col("c").alias("j")), "c1", "left")
        new = stored(jumped.select("v", "old", F.least("c1", F.coalesce("j", "c1")).alias("c")), what)
        moved = new.where("c <> old").limit(1).count()
        dropped(labels)
        labels = new
        if not moved:
            dropped(both)
            return labels.select(F.col("v").alias("node"), F.col("c").alias("component"))
