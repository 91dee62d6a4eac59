"""Token ids in files of bit or byte planes, each plane compressed, with a chunk index."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import publish, shared_dir, text_of, written

MAGIC = b"PLANES1\n"
#: Ids in a block, and ids after which a new file begins.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 22
#: The id after each document.
END_ID = 0
#: Pieces, and words in letters, whose ids a worker remembers (about 200 bytes each); the first ones
#: seen stay.
PIECES, WORDS = 900_000, 500_000

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, word by word.

    The vocabulary's pre-tokeniser always cuts before a single space between two characters that
    are no white space, so the ids of a text are those of its pieces one after the other, and
    pieces seen before need not be merged again. Other texts go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.pre, self.model = self.own.pre_tokenizer, self.own.model
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        hidden = [b for b in range(256) if b not in shown]
        self.table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.marks = {mark: self._merge(mark) for mark in ".,"}

    def _merge(self, word: str) -> bytes:
        """The ids of one pre-token."""
        symbols = word.encode().decode("latin-1").translate(self.table)
        return np.array([t.id for t in self.model.tokenize(symbols)], dtype="<u4").tobytes()

    def _core(self, word: str) -> bytes:
        """The ids of a space and letters, remembered while there is room."""
        ids = self.cores.get(word)
        if ids is None:
            ids = self._merge(" " + word)
            if len(self.cores) < WORDS:
                self.cores[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a space and the piece; None if white space touches the cut."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece.isalpha():
            ids = self._core(piece)
        elif piece[-1] in ".," and piece[:-1].isalpha():
            ids = self._core(piece[:-1]) + self.marks[piece[-1]]
        else:
            ids = self._general(" " + piece)
        if len(self.known) < PIECES:
            self.known[piece] = ids
        return ids

    def _general(self, text: str) -> bytes:
        ids = [t.id for symbols, _ in self.pre.pre_tokenize_str(text) for t in self.model.tokenize(symbols)]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        head, *pieces = text.split(" ")
        found = list(map(self.known.get, pieces))
        regular = not head[-1:].isspace() if pieces else True
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = ids = self._piece(pieces[i])
                    if ids is None:
                        regular = False
                        break
        if regular and (head or not pieces):
            return self._general(head) + b"".join(found)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The block transposed: plane k holds byte k (or bit k) of every id; zero planes are empty."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [octets[:, k] for k in range(4)]
    else:
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                octets[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


def make_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, kind: str = "byte", block: int = BLOCK_IDS) -> bytes:
    """Magic, compressed planes, then the index: documents, and offset and sizes of each chunk."""
    press = zstandard.ZstdCompressor(level=1)
    out, chunks = bytearray(MAGIC), []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [press.compress(p) if p else b"" for p in to_planes(part, kind)]
        chunks.append([len(out), len(part), [len(p) for p in planes]])
        out += b"".join(planes)
    index = press.compress(json.dumps({"kind": kind, "block": block, "docs": doc_ids, "lengths": lengths, "chunks": chunks}).encode())
    return bytes(out) + index + struct.pack("<I", len(index)) + MAGIC


def read_file(data: bytes, first: int = 0, last: int | None = None) -> tuple[dict, np.ndarray]:
    """The index, and the ids of the chunks first to last (all by default)."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a file of planes")
    end = len(data) - len(MAGIC) - 4
    (size,) = struct.unpack_from("<I", data, end)
    undo = zstandard.ZstdDecompressor()
    index = json.loads(undo.decompress(data[end - size : end]))
    parts = [np.empty(0, dtype="<u4")]
    for at, n, sizes in index["chunks"][first:last]:
        planes = []
        for s in sizes:
            planes.append(undo.decompress(data[at : at + s]) if s else b"")
            at += s
        parts.append(from_planes(planes, n, index["kind"]))
    return index, np.concatenate(parts)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, kind: str, end_id: int) -> DataFrame:
    """docs: id, text, in ascending ranges of id. Out: file, n_docs, n_ids."""
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        part, serial, done = TaskContext.get().partitionId(), 0, []
        ids, lengths, parts, held = [], [], [], 0

        def close() -> None:
            nonlocal serial, ids, lengths, parts, held
            if ids:
                name = f"ids-{part:06d}-{serial:05d}.planes"
                publish(folder, name, make_file(ids, lengths, np.frombuffer(b"".join(parts), dtype="<u4"), kind))
                done.append((name, len(ids), held))
                serial, ids, lengths, parts, held = serial + 1, [], [], [], 0

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = own.encode(text) + end
                ids.append(doc)
                lengths.append(len(data) // 4)
                parts.append(data)
                held += len(data) // 4
                if held >= FILE_IDS:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["file", "n_docs", "n_ids"],
        )

    return docs.mapInArrow(write, "file string, n_docs long, n_ids long")


def read_tokens(spark, folder: str) -> DataFrame:
    """file, id, start in the file, n_tokens and ids_crc32 of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                index, ids = read_file(data.as_py())
                length = np.array(index["lengths"], dtype=np.int64)
                stop = np.cumsum(length)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(stop.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rpartition("/")[2]] * len(length)),
                        pa.array(index["docs"], pa.int64()),
                        pa.array(stop - length),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                    ],
                    ["file", "id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder).select("path", "content")
    return files.mapInArrow(read, "file string, id long, local long, n_tokens long, ids_crc32 long")


def token_round_trip(
    docs: DataFrame,
    vocabulary: str,
    kind: str = "byte",
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Encode every whole text, write the ids in ascending id order, and read the files back.

    Rows move once, into ascending ranges of the id. Every task writes its own files (published
    by rename): ids in blocks of BLOCK_IDS, a block transposed into byte or bit planes, each
    plane compressed with Zstandard, and an index of documents and chunks at the end.

    Defined cases: a null or empty text has the end id alone; null ids come first; repeated ids
    follow one another, ordered by text; an empty table gives no files and no rows; extra
    columns are ignored. Out: id, start, n_tokens, ids_crc32.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ranged = base.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = written(write_tokens(ranged, folder, vocabulary, kind, end_id), "token-files")
    if not files.head(1):
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return read_tokens(spark, folder).join(starts, "file").select(
        F.col("id").alias(id_col), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
