"""What the text operators share: the shared folder, written tables and byte hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only characters that separate words, as a Java, RE2 and Python class.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder takes its place, in local mode alone: on a
    cluster other machines would not see it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_own_shared_dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = context._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def publish(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a lost or repeated task leaves no half file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    if type(system).__name__ != "LocalFileSystem" and system.get_file_info(f"{path}/{name}").is_file:
        system.delete_file(f"{path}/{name}")
    system.move(own, f"{path}/{name}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# -- the memory of workers ------------------------------------------------------------------

#: Rows that a worker looks at together, however many Spark puts in a batch.
SLICE = 1024

Batches = Iterator[pa.RecordBatch]


def in_slices(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, over batches of at most SLICE rows; see returning."""

    def parts(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)

    return returning(lambda batches: run(parts(batches)))


def returning(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, giving free memory back at its end: Spark keeps idle workers."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                _c_library().malloc_trim(0)

    return whole


@functools.cache
def _c_library() -> ctypes.CDLL:
    return ctypes.CDLL(None)


# -- hashing of bytes, vectorised ---------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
#: A random 64-bit value for each byte.
BYTE_VALUE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or those of its inverse."""
    name = "inverse" if inverse else "base"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, BASE_INVERSE if inverse else BASE, dtype=np.uint64)
        out[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(out)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers modulo 2**64; length n + 1. Chooses places, decides no equality."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data)), out=out[1:])
    return out


# Fingerprints: polynomials modulo the prime 2**31 - 1 in four random bases. Two different strings of
# n bytes agree in all four with a probability of at most (n / 2**31) ** 4, whatever the strings.
PRIME = np.uint64(2**31 - 1)
_BASES = [int(x) for x in np.random.Generator(np.random.PCG64(0xF1D0)).integers(2**20, 2**31 - 2, size=4)]
#: Bytes that are fingerprinted together at most; their sums stay below 2**64. Every worker keeps
#: eight tables of 8 BLOCK bytes, so it counts in an executor's memory.
BLOCK = 1 << 18
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and those of its inverse, BLOCK long, by repeated doubling."""
    if not _TABLES:
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, int(PRIME))):
                out = np.ones(BLOCK, dtype=np.uint64)
                have = 1
                while have < BLOCK:
                    out[have : 2 * have] = out[:have] * np.uint64(pow(b, have, int(PRIME))) % PRIME
                    have *= 2
                pair.append(out)
            _TABLES.append((pair[0], pair[1]))
    return _TABLES


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """124 bits in two arrays for each byte span [start, end) of at most BLOCK bytes of data."""
    out = []
    plus = data.astype(np.uint64) + np.uint64(1)
    for power, inverse in _tables():
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(plus * power[: len(data)], out=sums[1:])
        out.append((sums[end] - sums[start]) % PRIME * inverse[np.minimum(start, BLOCK - 1)] % PRIME)
    two = np.uint64(31)
    return (out[0] << two) | out[1], (out[2] << two) | out[3]


SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no space."""
    edge = np.diff(np.concatenate(([True], SPACE_BYTE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one.
LONG_WORD = 4096


def hashes_of_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word: folded fingerprints, a keyed digest for very long words."""
    out = np.empty(len(start), dtype=np.uint64)
    short = np.flatnonzero(end - start <= LONG_WORD)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=b"words").digest()
        out[i] = int.from_bytes(digest, "little")
    at = 0
    while at < len(short):
        low = start[short[at]]
        stop = max(at + 1, int(np.searchsorted(end[short], low + BLOCK, "right")))
        own = short[at:stop]
        a, b = fingerprints(data[low : end[own[-1]]], start[own] - low, end[own] - low)
        out[own] = mixed(a + mixed(b + np.uint64(1)))
        at = stop
    return out


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """The hash of every word of a text, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if lower:
        data = LOWER[data]
    start, end = word_spans(data)
    return hashes_of_words(data, start, end) if len(start) else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of size words, in order; the whole as one when there are fewer."""
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = mixed(total * BASE + words[k : len(words) - n + 1 + k] + np.uint64(n))
    return total
