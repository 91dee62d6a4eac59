"""Encoding and decoding with the pieces of a public vocabulary by a Viterbi search that shares prefixes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import text_of

MARK = "▁"
#: Stands for a mark that the text itself has; no valid text holds a lone surrogate.
OWN_MARK = "\ud800"
#: What a byte of a character without a piece costs below the worst piece.
BYTE_COST = 10.0
#: Words whose ids a worker remembers; the first ones seen stay.
REMEMBERED = 300_000


@dataclass
class Vocabulary:
    """Pieces with ids and scores, the ids of the 256 bytes, and the bytes of every id."""

    pieces: dict[str, tuple[int, float]]
    bytes_id: list[int]
    octets: list[bytes]
    known: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.byte_score = min((s for _, s in self.pieces.values()), default=0.0) - BYTE_COST

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file.

        Unigram scores are taken as they are. Scores of a BPE model are merge ranks and no
        log-probabilities; its pieces get the logarithm of Zipf's law on that rank instead.
        """
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(own.vocab_size())
        normal = [i for i in ids if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        scores = {i: own.get_score(i) for i in normal}
        ordered = sorted(normal, key=lambda i: (-scores[i], i))
        if all(scores[i] == int(scores[i]) for i in normal):
            scores = {i: -math.log(k + 2.0) for k, i in enumerate(ordered)}
        bytes_id = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        octets = [own.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        for b, i in enumerate(bytes_id):
            octets[i] = bytes([b])
        return cls({own.id_to_piece(i): (i, scores[i]) for i in normal}, bytes_id, octets)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def segment(words: list[str], vocab: Vocabulary) -> dict[str, list[int]]:
    """The ids of the best path of every distinct marked word.

    Sorted words are the depth-first walk of their trie: what a word shares with the one before
    it is a path from the root, whose forward scores stay on the stacks. For each end the
    longest last piece is tried first and only a greater score displaces it. A character that
    no piece covers costs its bytes.
    """
    pieces, longest = vocab.pieces, vocab.longest
    best, back, last = [0.0], [0], [()]
    out, before = {}, ""
    for word in sorted(words):
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], back[shared + 1 :], last[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, start, ids = -math.inf, end - 1, ()
            for at in range(max(0, end - longest), end):
                found = pieces.get(word[at:end])
                if found is not None and best[at] + found[1] > top:
                    top, start, ids = best[at] + found[1], at, found[0]
            if word[end - 1 : end] not in pieces:
                octets = (MARK if word[end - 1] == OWN_MARK else word[end - 1]).encode()
                score = best[end - 1] + vocab.byte_score * len(octets)
                if score > top:
                    top, start, ids = score, end - 1, tuple(vocab.bytes_id[b] for b in octets)
            best.append(top)
            back.append(start)
            last.append(ids)
        path, at = [], len(word)
        while at:
            ids = last[at]
            if isinstance(ids, tuple):
                path.extend(reversed(ids))
            else:
                path.append(ids)
            at = back[at]
        out[word] = path[::-1]
        before = word
    return out


def encode_batch(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """The ids of whole texts: every space opens a marked word, the first has a mark of its own."""
    split = [(t.replace(MARK, OWN_MARK) if MARK in t else t).split(" ") if t else [] for t in texts]
    known, fresh = vocab.known, {}
    new = {w for words in split for w in words if w not in known}
    if new:
        found = segment([MARK + w for w in new], vocab)
        fresh = {word[1:]: np.array(ids, dtype="<u4").tobytes() for word, ids in found.items()}
        if len(known) < REMEMBERED:
            for word in list(fresh)[: REMEMBERED - len(known)]:
                known[word] = fresh[word]
    return [np.frombuffer(b"".join([known.get(w) or fresh[w] for w in words]), dtype="<u4") for words in split]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids; the space of the first mark is not part of it."""
    return b"".join(map(vocab.octets.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def codec_round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and compare; no shuffle.

    Each task sorts the distinct marked words of a batch that it has not met before into a trie
    and walks it depth-first (see segment); words met before keep their ids in a bounded memory.

    Defined cases: a null or empty text has no words and no ids; runs of spaces give marks by
    themselves; a mark inside a text and characters without a piece become byte ids, so every
    text survives the round trip; null ids, repeated rows and extra columns do no harm; an
    empty table gives none. Out: id, n_words, n_tokens, n_byte_tokens, ids_crc32,
    decoded_crc32, round_trip.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        is_byte = np.zeros(len(vocab.octets), dtype=bool)
        is_byte[vocab.bytes_id] = True
        for batch in batches:
            texts, rows = batch["text"].to_pylist(), []
            for text, ids in zip(texts, encode_batch(texts, vocab), strict=True):
                back = decode(ids, vocab)
                words = text.count(" ") + 1 if text else 0
                octets = ids.tobytes()
                rows.append((words, len(ids), int(is_byte[ids].sum()), zlib.crc32(octets), zlib.crc32(back.encode()), back == text))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], *arrays], names)

    names = ["id", "n_words", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32", "round_trip"]
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
