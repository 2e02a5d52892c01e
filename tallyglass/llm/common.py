"""Helpers that the corpus operators share: inputs, text mapping, shared tables."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to the per-batch functions in slices of about so many bytes.
SLICE_BYTES = 1 << 20
_own_dir: dict[str, str] = {}
#: The tables that the innermost `settled` of this thread has seen written.
_within: ContextVar[list[DataFrame] | None] = ContextVar("within", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id, written as text, is divisible by 5 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`.

    Where it is unset a temporary folder serves, but only on a local master, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dir[app] = tempfile.mkdtemp(prefix="tallyglass-")
    return _own_dir[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def staged(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage ends here.

    A lost executor then costs the running stage only. The table goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyglass-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path.rpartition("/")[0])
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path.rpartition("/")[0]
    if (within := _within.get()) is not None:
        within.append(table)
    return table


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What `make` returns, staged; the tables that it has staged on its way are deleted."""
    token = _within.set(made := [])
    try:
        found = make()
    finally:
        _within.reset(token)
    found = staged(found, tag)
    if made:
        discard(*made)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and free their shuffle files."""
    for table in tables:
        _delete(table.sparkSession, table._staged_at)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow, after which the worker, which Spark uses again, gives its memory back."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not that C library
                pass

    return inner


#: Rows of texts that Spark hands to Python at once; its own default, 10,000, makes batches of tens of megabytes.
BATCH_ROWS = 1000


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, unless it has smaller ones: buffers outside the heap stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    narrow_batches(rows.sparkSession)
    return rows.mapInArrow(lean(run), schema)


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes (or are one text)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    total = sizes.cumsum()
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(total.searchsorted(done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    schema: str,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Rows `doc_id, *extra` as they came, beside what a function makes of each text.

    `make()` runs once a task and returns a function from texts to arrow arrays, one
    row per text. Ids never pass through Python objects, so null ids stay null.
    """
    spark = docs.sparkSession
    picked = docs.select("doc_id", *extra, "text")
    head = picked.drop("text").schema
    fields = spark.createDataFrame([], schema).schema
    out = type(head)([*head.fields, *fields.fields])
    n_head = len(head.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        work = make()
        for batch in batches:
            for part in by_bytes(batch, n_head):
                made = work(part.column(n_head).to_pylist())
                columns = [part.column(i) for i in range(n_head)] + made
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return in_arrow(picked, run, out)


def same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, null matching null; of `b` only its other columns are added."""
    b = b.withColumnsRenamed({c: f"__{c}" for c in on})
    return a.join(b, functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__{c}"]) for c in on]), how).drop(*[f"__{c}" for c in on])


#: Marks are bits of so many: 4 MB in all, in bitmaps of 4 KB, whatever the input.
MARKS, PER_MAP = 1 << 25, 1 << 15


def marks(rows: DataFrame, *key: str) -> DataFrame:
    """The hashed keys of `rows` as bitmaps (__slot, __bits): at most MARKS / PER_MAP rows of 4 KB, safe to broadcast."""
    at = F.pmod(F.xxhash64(*key), F.lit(MARKS))
    spots = rows.select((at / PER_MAP).cast("int").alias("__slot"), (at % PER_MAP).alias("__at")).distinct()
    return staged(spots.groupBy("__slot").agg(F.bitmap_construct_agg("__at").alias("__bits")), "marks")


def with_marks(rows: DataFrame, marked: DataFrame, *key: str | Column) -> DataFrame:
    """`rows` with `__maybe`: false only where the key is surely none of the marked ones."""
    at = F.pmod(F.xxhash64(*key), F.lit(MARKS))
    put = rows.withColumn("__at", at).withColumn("__slot", (F.col("__at") / PER_MAP).cast("int"))
    byte = F.substring("__bits", (F.col("__at") % PER_MAP / 8).cast("int") + 1, F.lit(1))
    hit = F.floor(F.conv(F.hex(byte), 16, 10).cast("int") / F.pow(F.lit(2), F.col("__at") % 8)) % 2 == 1
    return put.join(F.broadcast(marked), "__slot", "left").withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__slot", "__at", "__bits")


def text_tag(text: str | Column = "text") -> Column:
    """A hash by which rows of one doc_id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` that are not in `gone`, with all columns; null matches null.

    `gone` has doc_id, or doc_id and tag (see `text_tag`) to name single rows. Rows that
    the bitmaps rule out pass by; only the others are shuffled.
    """
    own, keys = docs.withColumn("__row_tag", text_tag()), ["doc_id", *(["tag"] if "tag" in gone.columns else [])]
    near = with_marks(own, marks(gone, *keys), *("__row_tag" if k == "tag" else k for k in keys))
    lost = gone.select([F.col(k).alias(f"__gone_{k}") for k in keys])
    asked = near.filter("__maybe")
    match = functools.reduce(lambda x, y: x & y, [asked["__row_tag" if k == "tag" else k].eqNullSafe(lost[f"__gone_{k}"]) for k in keys])
    return near.filter(~F.col("__maybe")).unionByName(asked.join(lost, match, "left_anti")).drop("__row_tag", "__maybe")
