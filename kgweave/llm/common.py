"""What the corpus operators share: tables, word rules and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stash import discard, shared_dir, stash

__all__ = ["BLANKS", "claim", "discard", "n_words", "shared_dir", "ship", "stash", "table", "utf8"]

#: The characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts go to Python workers in batches of so many bytes, where the session has no setting of its own.
BATCH_BYTES, _OURS, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Make the session ready for operators that run Python on executors: bounded batches, and this package
    sent to them, once for each application."""
    if spark.conf.get(BATCH_BYTES, _OURS) == _DEFAULT:
        spark.conf.set(BATCH_BYTES, _OURS)
    context, top = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top) and not any("kgweave-code" in f for f in context.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="kgweave-"), "kgweave-code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
    return spark


_HELD: dict[str, Callable[[], None]] = {}


def frugal() -> None:
    """Once for each Python worker: memory that is freed goes back to the system, where the C library can do that."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        # Fixed values of glibc: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD and M_ARENA_MAX.
        c = ctypes.CDLL(None)
        for option, value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 1)):
            c.mallopt(option, value)


def claim(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called where an operator's task starts in a Python worker: what other operators remember there is dropped."""
    if not _HELD:
        frugal()
    others = [k for k in _HELD if k != owner]
    for other in others:
        _HELD.pop(other)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _HELD[owner] = clear


def utf8(text: Column) -> Column:
    """The text's bytes; a null text counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def n_words(text: Column) -> Column:
    """Number of runs of characters that aren't blanks; 0 for a null text."""
    parts = F.split(F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " ")), " ")
    return F.when(text.isNull() | ~text.rlike(f"[^{BLANKS}]"), F.lit(0)).otherwise(F.size(parts)).cast("long")
