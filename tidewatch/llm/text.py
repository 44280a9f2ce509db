"""Shared column expressions and NumPy helpers for whole texts.

`ASCII_SPACE` words are maximal runs of anything but the six ASCII space
characters; `ALNUM` words are runs of digits, letters a-z and all non-ASCII
characters, after A-Z (and nothing else) went to lower case.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 200_000
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Only A-Z are lowered; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Words of a text (null: none), without the empty ends of a split."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def row_id(*columns: str) -> Column:
    """Tells apart rows that share a document id but differ in text; equal rows share it and get equal results."""
    return F.xxhash64(*columns)


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Whole texts go to Python in batches of few rows, so that one batch of long texts stays small; workers get this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        # Spark serves the archive to every executor; it must last as long as the session
        context.addPyFile(shutil.make_archive(os.path.join(folder, "tidewatch_llm"), "zip", os.path.dirname(package), os.path.basename(package)))


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` over batches; when it ends, what it freed goes back to the system, since workers live on between tasks."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
            if trim is not None:
                trim(0)

    return run


def chunks(texts: Sequence[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) runs of about `most` bytes; a longer text is a run of its own. None reads as empty."""
    begin, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size >= most:
            yield begin, held
            begin, size, held = i + 1, 0, []
    if held:
        yield begin, held


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, the space mask, and powers of an odd base with its inverse for steps below 2**16."""
    values = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    base = 0x9E3779B97F4A7C17
    inverse = pow(base, -1, 2**64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(65_536, base, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(65_536, inverse, np.uint64)], dtype=np.uint64)
    return values, space, up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(steps: np.ndarray | int, which: int) -> np.ndarray:
    small = _tables()[which]
    top = int(steps[-1] if isinstance(steps, np.ndarray) and len(steps) else steps if isinstance(steps, int) else 0)
    big = np.cumprod(np.r_[np.uint64(1), np.full(top // 65_536 + 1, small[65_536], np.uint64)], dtype=np.uint64)
    if isinstance(steps, int):
        return (big[:-1, None] * small[None, :65_536]).ravel()[:steps]
    return big[steps >> 16] * small[steps & 65_535]


def flat_words(texts: Iterable[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all ASCII_SPACE words of several texts in a row.

    Returns (hashes, words per text, starts, ends, bytes): starts and ends are
    byte positions in the joined buffer. The hash is a polynomial over random
    byte values, so a whole buffer is hashed by one running sum.
    """
    texts = list(texts)
    joined = b"\n".join(texts)
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    values, space, _, _ = _tables()
    blank = np.ones(len(data) + 2, np.int8)
    blank[1:-1] = space[data]
    turn = np.diff(blank)
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    total = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(values[data] * _powers(len(data), 2), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _powers(starts, 3)) if len(starts) else np.zeros(0, np.uint64)
    limits = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.r_[0, np.searchsorted(starts, limits)])
    return hashes, per_text, starts, ends, data


def shingle_sets(words: np.ndarray, per_text: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every run of `size` words of each text; of the whole sequence if it is shorter; none without words."""
    offsets = np.r_[0, np.cumsum(per_text)]
    n = max(0, len(words) - size + 1)
    runs = words[:n].copy()
    for j in range(1, size):
        runs = mix(runs) + words[j : n + j]
    runs = mix(runs ^ np.uint64(size))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= size:
            part = np.sort(runs[a : b - size + 1])
            out.append(part[np.r_[True, part[1:] != part[:-1]]])
        elif b > a:
            h = words[a : a + 1].copy()
            for j in range(a + 1, b):
                h = mix(h) + words[j : j + 1]
            out.append(mix(h ^ np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
