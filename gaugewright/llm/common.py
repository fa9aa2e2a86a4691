"""What the operators share: reading tables, words of texts, packing texts for tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.session import new_stage, ship

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Bytes that belong to words of letters and digits, A-Z lowered; every other ASCII byte parts words.
LETTERS = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the workers get this package with the first.

    Rows hold whole texts, so Arrow batches of the default size are cut to fewer rows; another setting is left alone.
    """
    ship(spark)
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character left alone; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of anything but white space (0x20, 0x09-0x0D), A-Z lowered."""
    return raw(text).lower().split()


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lowered."""
    return raw(text).translate(LETTERS).split()


def text_packs(
    batches: Iterator[pa.RecordBatch], columns: list[str], text: str, most: int = 4 << 20
) -> Iterator[tuple[list[list], list[bytes]]]:
    """Values of some columns and the UTF-8 texts, in packs of bounded bytes (or one longer text)."""
    for batch in batches:
        kept = [batch.column(c) for c in columns]
        texts = batch.column(text)
        start = size = 0
        pack: list[bytes] = []
        for i in range(len(texts)):
            value = texts[i]
            data = value.as_buffer().to_pybytes() if value.is_valid else b""
            pack.append(data)
            size += len(data)
            if size >= most or i + 1 == len(texts):
                yield [c.slice(start, len(pack)).to_pylist() for c in kept], pack
                start, size, pack = i + 1, 0, []


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finalizer of a public-domain generator), in wrapping arithmetic."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_c = ctypes.CDLL(None)
_remembered: dict[str, Callable[[], None]] = {}


def enter(operator: str, forget: Callable[[], None] | None = None) -> None:
    """A task begins: what tasks of other operators remember in this worker is dropped, as workers live on."""
    for other, clear in _remembered.items():
        if other != operator:
            clear()
    if forget:
        _remembered[operator] = forget
    gc.collect()


def release() -> None:
    """Memory that this worker has freed goes back to the machine, where the allocators can do that."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c, "malloc_trim"):
        _c.malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows per Arrow batch while wide rows (two texts each) are worked on and written."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def partitions(df: DataFrame) -> int:
    """Partitions that the scan of a table gets: follows the input's bytes."""
    return max(1, df.rdd.getNumPartitions())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a path that tasks can open; it must be mounted on every machine."""
    path = f"{new_stage(spark)}-{name}"
    scheme, found, rest = path.partition(":")
    if found and scheme != "file":
        raise ValueError(f"{name} needs spark.checkpoint.dir on a file system that every machine mounts, not {scheme}:")
    return "/" + (rest if found else path).lstrip("/")


def checksum(text: str) -> str:
    """SQL (of the reference engine) for the crc32 of a text of ASCII characters, bit by bit."""
    bits = "lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1))"
    step = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), {bits})"
    characters = f"[ord(x)::UBIGINT for x in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {characters}), {step}), 4294967295)"
