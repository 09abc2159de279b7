"""What the operators of this subpackage share: scratch tables, row selection without a shuffle, Arrow column passes.

Scratch tables are Parquet files under the folder named by ``spark.checkpoint.dir``. They cut lineage the way
``checkpoint()`` does, survive the loss of any executor, keep their statistics for the planner and are columnar. A table
that is only a step goes when the ``scratch`` block that made it ends; what a result still reads is handed to the block
around it, and the outermost leaves it to ``delete`` or, in a local session's own folder, to the end of the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF and CR (RE2 and Java read it alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch, and bytes of its texts, that are in Python objects at a time (one row at least).
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20
#: The folder of a local session that names none; it goes when the process ends.
_OWN: list[str] = []
#: Scratch paths of the open blocks, the innermost last.
_OPEN: list[list[str]] = []
#: Columns that number the rows of a frame: file and place in it.
FILE, PLACE = "__pl_file", "__pl_place"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or, where it is unset, one of our own.

    Only a local session may leave it unset, since a machine-local folder is not shared by executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="paperloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; the innermost ``scratch`` block owns it."""
    path = f"{scratch_dir(spark).rstrip('/')}/paperloom-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the scratch tables made inside, but for those of frames given to the yielded ``keep``."""
    paths: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        used = df.inputFiles()
        kept.extend(p for p in paths if any(f"/{p.rpartition('/')[2]}/" in u for u in used))
        return df

    _OPEN.append(paths)
    try:
        yield keep
    finally:
        _OPEN.pop()
        if _OPEN:
            _OPEN[-1].extend(kept)
        delete(spark, [p for p in paths if p not in kept])


@contextmanager
def held(paths: list[str]):
    """Adds what the blocks inside leave, or what is made outside of them, to ``paths`` instead; ``delete`` is the caller's."""
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.pop()


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with FILE and PLACE, by which a row is found again however often the frame is read.

    A plain Parquet table has these places already; anything else is written once.
    """
    if {c.lower() for c in docs.columns} & {FILE, PLACE}:
        docs = without(docs, [FILE, PLACE])
    plan = docs._jdf.queryExecution().analyzed()
    plain = plan.nodeName() == "LogicalRelation" and "parquet" in plan.simpleString(25).lower()
    frame = docs if plain and "_metadata" not in docs.columns else materialize(docs, "rows")
    return frame.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def picked(
    frame: DataFrame,
    marks: DataFrame,
    names: Sequence[str],
    keep: Callable[[DataFrame], DataFrame],
    make: Callable[[], Callable[..., tuple]] | None = None,
    fields: Sequence[T.StructField] = (),
) -> DataFrame:
    """The columns ``names`` of the rows of ``frame`` (from ``numbered``) that ``marks`` (FILE, PLACE, times) names, each
    ``times`` times. Texts aren't shuffled: marks are written in one folder a file, and a task reads those of its file.

    With ``make`` and ``fields``, as those of ``append_columns``, what is computed of the columns comes in their stead. It
    is so in the same pass, as a second one in a stage would take another worker process for each core, which stays.
    Where pyarrow can't open the shared folder, the rows are joined instead. ``keep`` is that of the ``scratch`` block.
    """
    from pyarrow import fs

    spark = frame.sparkSession
    schema = T.StructType(list(fields) if make else [frame.schema[c] for c in names])
    then = _computed(make, range(len(names)), {}, fields) if make else None
    times = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    marks = marks.select(F.lower(F.hex(F.xxhash64(FILE))).alias("bin"), F.col(FILE).alias("file"), F.col(PLACE).alias("place"), "times")
    marks = marks.repartition("bin").sortWithinPartitions("bin", "file", "place")
    written = materialize(marks, "marks", partition_by="bin")
    folder = next(p for p in reversed(_OPEN[-1]) if "paperloom-marks-" in p)
    try:
        fs.FileSystem.from_uri(folder)
    except Exception:  # a scheme that only Spark's readers know
        both = (F.col(FILE) == F.col("file")) & (F.col(PLACE) == F.col("place"))
        joined = keep(frame.join(written, both).withColumn("__pl_times", times).select(*[F.col(f"`{c}`") for c in names]))
        return joined.mapInArrow(then, schema) if then else joined

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, base = fs.FileSystem.from_uri(folder)
        now, places, copies = None, np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in (part for whole in batches for part in slices(whole)):
            files = batch.column(len(names))
            for file in files.dictionary_encode().dictionary.to_pylist():
                if file != now:
                    now, at = file, f"{base}/bin={_spark_hash(file)}"
                    found = None
                    if store.get_file_info(at).type == fs.FileType.Directory:
                        parts = [f for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet")]
                        found = pa.concat_tables([pq.read_table(f.path, filesystem=store, partitioning=None) for f in parts])
                        found = found.filter(pc.equal(found.column("file"), file)).sort_by("place")
                    places = found.column("place").to_numpy() if found else np.zeros(0, np.int64)
                    copies = found.column("times").to_numpy() if found else np.zeros(0, np.int32)
                own = batch.filter(pc.equal(files, file))
                place = own.column(len(names) + 1).to_numpy()
                k = np.searchsorted(places, place)
                hit = np.flatnonzero((k < len(places)) & (places[np.minimum(k, len(places) - 1)] == place)) if len(places) else []
                if len(hit):
                    rows = pa.array(np.repeat(hit, copies[k[hit]]))
                    yield pa.RecordBatch.from_arrays([own.column(i).take(rows) for i in range(len(names))], names=list(names))
        give_back()

    own = frame.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], FILE, PLACE)
    keep(written)
    return own.mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def _spark_hash(text: str) -> str:
    """``lower(hex(xxhash64(text)))`` as Spark has it."""
    from xxhash import xxh64_intdigest

    return f"{xxh64_intdigest(text.encode(), 42):x}"


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names compare without case, as Spark's do."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def give_back() -> None:
    """Returns memory that a task has freed to the system, since its worker process stays for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch) -> Iterator:
    """Parts of an Arrow batch, in order, of SLICE_ROWS rows at most and of about SLICE_BYTES, but one row at least."""
    rows = max(1, min(SLICE_ROWS, SLICE_ROWS if not batch.num_rows else SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        if part.num_rows > 1 and part.nbytes > 4 * SLICE_BYTES:  # a few very long texts
            half = part.num_rows // 2
            yield from slices(part.slice(0, half))
            yield from slices(part.slice(half))
        else:
            yield part


def _computed(make: Callable[[], Callable[..., tuple]], inputs: Sequence, carried: dict, fields: Sequence[T.StructField]) -> Callable[[Iterator], Iterator]:
    """A pass over Arrow batches: the columns ``carried`` (by new name) and what ``make()`` computes of the columns ``inputs``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    names = [*carried, *(f.name for f in fields)]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for batch in slices(whole):
                out = compute(*[batch.column(i).to_pylist() for i in inputs])
                arrays = [batch.column(c) for c in carried.values()] + [pa.array(v, type=k) for v, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        del compute
        give_back()

    return run


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., tuple]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add Arrow-computed columns in one map-only pass.

    ``make()`` runs once a task and returns ``compute(*lists) -> tuple of lists``, one per field. ``keep`` names the
    columns to carry (default: all). A carried column whose name equals a new one is replaced by it.
    """
    lower = {f.name.lower() for f in fields}
    carried = [c for c in (keep if keep is not None else df.columns) if c.lower() not in lower]
    extra = [c for c in inputs if c not in carried]
    frame = df.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(extra)])
    at = {c: c for c in carried} | {c: f"__in_{i}" for i, c in enumerate(extra)}
    schema = T.StructType([df.schema[c] for c in carried] + list(fields))
    return frame.mapInArrow(_computed(make, [at[c] for c in inputs], {c: c for c in carried}, fields), schema)
