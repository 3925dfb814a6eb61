"""What the text operators share: code shipping, shared storage, and mapping texts batch by batch."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_waywright_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="waywright-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._waywright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one, but only in a single process, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='waywright-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and survives lost executors.

    The folder is deleted by discard(), or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_at_end)
    _paths[path] = spark
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


_paths: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _paths.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of staged frames that nothing reads any more: all that was made from them is written itself."""
    for df in frames:
        if df is not None and getattr(df, "staged_path", None) in _paths:
            _delete(df.staged_path)


def _at_end() -> None:
    for path in list(_paths):
        try:
            _delete(path)
        except Exception:  # the JVM may have ended before
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def share(wanted: int, n: int) -> int:
    """The largest of the 63-bit draws with which about 5 / 4 x wanted of n rows are taken."""
    return min((1 << 63) - 1, (wanted * 5 << 63) // (4 * n))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def unused(columns: list[str], name: str) -> str:
    """name, with marks until none of columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], maker: Callable, *args, keep_text: bool = True) -> DataFrame:
    """df with columns computed from its text column by work(texts), where work = maker(*args) is made once per partition.

    work takes a list of str or None and returns one Arrow array (or list) for each of fields. An input column
    whose name equals a new one's, case ignored, gives way to the new one; all other columns pass through.
    """
    ship(df.sparkSession)
    fresh = {name.lower() for name, _ in fields}
    names = [c for c in df.columns if c.lower() not in fresh or c == text]
    base = df.select(*[F.col(quoted(c)) for c in names])
    at = names.index(text)
    kept = [i for i, c in enumerate(names) if c.lower() not in fresh and (keep_text or i != at)]
    schema = T.StructType([base.schema.fields[i] for i in kept] + [T.StructField(n, t) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for _, t in fields]
    labels = [f.name for f in schema.fields]

    def run(batches):
        work = maker(*args)
        for batch in batches:
            made = work(batch.column(at).to_pylist())
            made = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], names=labels)

    return base.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)  # which doesn't take names with dots


def local_path(uri: str) -> str:
    return uri.removeprefix("file://") if uri.startswith("file://") else uri


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; WAYWRIGHT_TOKENIZERS names another folder."""
    if folder := os.environ.get("WAYWRIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to all executors, once per context; returns path, which received() takes."""
    sent = getattr(spark.sparkContext, "_waywright_files", set())
    if path not in sent:
        spark.sparkContext.addFile(local_path(path))
        spark.sparkContext._waywright_files = sent | {path}
    return path


def received(path: str) -> str:
    """Where a file that was sent lies on this executor."""
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else local_path(path)


MOST_BITS = 1 << 27


def bit_set(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """A set of the hashes in a long column as bits: 16 of them for each of rows, but 2^27 (16 MB) at most whatever rows is.

    holds() may say yes to a hash that isn't in df, never no to one that is."""
    bits = min(MOST_BITS, 1 << max(13, (16 * rows).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = df.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast({quoted(column)} & 63 AS INT))").alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("at").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes are in the set."""
    slot = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 1 << 24):
    """A batch in slices whose strings in the given column take about most bytes, of one row at least."""
    import pyarrow.compute as pc

    upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
