"""What the operators share: safe input columns, tables that cut lineage, Bloom filters and Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 2_000_000


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir. On one machine a local folder does where that is unset; on a cluster
    each executor would write to a disk of its own, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/millrace-llm"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a lost executor costs a read, not a recomputation.

    `discard` deletes such a table. Those that a result still reads stay until the shared folder is cleared.
    """
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` has written, once nothing reads them any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A Bloom filter's key sets bits of one 64-bit word, which its low bits choose; shifts of the key that give these bits.
#: The filter's bits: per key, at least, at most (4 MB).
PROBES = (40, 46, 52, 58)
BITS_PER_KEY, FEWEST_BITS, MOST_BITS = 64, 1 << 13, 1 << 25


@dataclass
class Bloom:
    """A bitmap of bounded size that holds 64-bit keys; some other keys seem to be in it, the more the fuller it is.

    `bits` is the same bitmap as the one value of a table: a plan names that table and does not spell the bitmap out.
    """

    bitmap: bytes
    bits: DataFrame

    def column(self, key: Column) -> Column:
        """May the key be in it? JVM expressions only; a null key is not in it."""
        if not any(self.bitmap):
            return F.lit(False)
        bits, out = self.bits.scalar(), F.lit(True)
        word = key.bitwiseAND(F.lit(8 * len(self.bitmap) - 64))
        for shift in PROBES:
            at = word.bitwiseOR(F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(63)))
            byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1)
        return F.coalesce(out, F.lit(False))

    def array(self, keys: np.ndarray) -> np.ndarray:
        """The same for an array of uint64."""
        return probed(self.bitmap, keys)


def probed(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    bits, out = np.frombuffer(bitmap, np.uint8), np.ones(keys.size, bool)
    word = keys & np.uint64(8 * bits.size - 64)
    for shift in PROBES:
        at = word | (keys >> np.uint64(shift)) & np.uint64(63)
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bloom(keys: DataFrame) -> Bloom:
    """Of the one column of 64-bit keys. The driver gets one number for each word of the map, at most half a million, as
    Arrow columns: as Python objects they would take over a hundred MB of its memory."""
    spark, keys = keys.sparkSession, keys.toDF("key").filter("key is not null")
    size = FEWEST_BITS
    while size < min(MOST_BITS, BITS_PER_KEY * keys.count()):
        size *= 2
    own = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key, {s}) & 63 as int))" for s in PROBES))
    word = F.shiftright(F.col("key").bitwiseAND(F.lit(size - 1)), 6)
    got = keys.groupBy(word.alias("w")).agg(F.bit_or(own).alias("v")).toArrow()
    bitmap = np.zeros(size // 64, "<i8")
    bitmap[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return Bloom(bitmap.tobytes(), cut(spark.createDataFrame([(bytearray(bitmap.tobytes()),)], "bits binary"), "bits"))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text becomes empty. Other columns cannot clash."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(table: pa.Table | pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of about `most` bytes of text each; at least one row."""
    column = table.column(text)
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield table.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield table.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int):  # noqa: ANN201
    """True for documents whose crc32(doc_id as text) mod folds is the held-out fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))
