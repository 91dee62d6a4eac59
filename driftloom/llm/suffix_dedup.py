"""Repeated strings of bytes or words: shared anchors bring candidates together, suffix arrays decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import BLOCK, fingerprints, hashes_of_words, in_slices, mixed, powers, prefix_hash, returning, text_of, word_spans, written
from driftloom.llm.linear_grouping import suffix_array, suffix_arrays

#: A string of so many bytes that starts twice is removed.
LENGTH = 400
#: Starts of a text that are looked at together, so that very long texts take bounded memory.
CHUNK = 1 << 20
#: Contexts in a unit; greater units are cut by SPANS starts, until none is greater.
UNIT_CONTEXTS, SPANS = 256, (24, 4, 1)
#: Symbols whose arrays are built in step, and the fewest texts for which that pays.
STEP_SYMBOLS, STEP_TEXTS = 1_200_000, 8
#: Stands for a null id in keys; results follow from the text alone, so it may be an id as well.
NO_ID = -(2**63)


@dataclass(frozen=True)
class Kind:
    """Strings of `length` bytes, or of as many words however they are spaced."""

    length: int = LENGTH
    words: bool = False

    @property
    def gram(self) -> int:
        return max(1, self.length // 4)


@dataclass(frozen=True)
class Tokens:
    """A text as tokens: data holds them (words joined by single spaces), first and last their bytes in the text."""

    data: np.ndarray
    begin: np.ndarray | None
    end: np.ndarray | None
    first: np.ndarray | None
    last: np.ndarray | None

    @classmethod
    def of(cls, text: str, kind: Kind) -> Tokens:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        if not kind.words:
            return cls(data, None, None, None, None)
        first, last = word_spans(data)
        end = np.cumsum(last - first + 1) - 1
        begin = end - (last - first)
        joined = np.frombuffer(b" ".join(data.tobytes().split()), dtype=np.uint8)
        return cls(joined, begin, end, first, last)

    def __len__(self) -> int:
        return len(self.data if self.begin is None else self.begin)

    def bytes_at(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens [low, high) begin and end in data."""
        return (low, high) if self.begin is None else (self.begin[low], self.end[high - 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, from running minima inside blocks of that width."""
    blocks = np.concatenate((values, np.full(-len(values) % width, 2**64 - 1, dtype=np.uint64))).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchors(tokens: Tokens, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk of a text: lo, hi, anchor, h, a, b of every context.

    A string's anchor is the leftmost of its grams (a quarter of its length) with the least
    hash, so equal strings have equal anchors at the same place. A context holds the strings that
    start from lo to hi, neighbours with one anchor; a and b are its fingerprints. On periodic text
    contexts are many, but few different ones.
    """
    gram, n = kind.gram, len(tokens) - kind.length + 1
    width = kind.length - gram + 1
    hashes = hashes_of_words(tokens.data, tokens.begin, tokens.end) if kind.words and n > 0 else None
    for at in range(0, max(0, n), CHUNK):
        starts = min(CHUNK, n - at)
        stop = at + starts + kind.length - 1
        if hashes is None:
            prefix = prefix_hash(tokens.data[at:stop])
        else:
            prefix = np.zeros(stop - at + 1, dtype=np.uint64)
            np.cumsum(hashes[at:stop] * powers(stop - at), out=prefix[1:])
        m = stop - at - gram + 1
        raw = mixed((prefix[gram:] - prefix[:m]) * powers(m, inverse=True))
        least = _sliding_least(raw, width)
        turn = np.concatenate(([True], (least[1:] != least[:-1]) | (raw[: starts - 1] == least[:-1])))
        lo = np.flatnonzero(turn)
        hi = np.append(lo[1:], starts) - 1
        h = least[lo]
        place = lo + width - 1  # a lesser hash that has just come in, or the leftmost of the least
        gone = np.flatnonzero(np.concatenate(([True], h[1:] >= h[:-1])))
        for i in range(0, len(gone), 4096):
            own = gone[i : i + 4096]
            place[own] = lo[own] + np.lib.stride_tricks.sliding_window_view(raw, width)[lo[own]].argmin(axis=1)
        lo, hi, place = lo + at, hi + at, place + at
        a, b = _prints(tokens, lo, hi + kind.length)
        yield lo, hi, place, h.view(np.int64), a, b


def _prints(tokens: Tokens, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the tokens [low, high) as signed integers; spans too long for one block take a digest."""
    begin, end = tokens.bytes_at(low, high)
    a, b = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    at = 0
    while at < len(low):
        first = int(begin[at])
        stop = int(np.searchsorted(end, first + BLOCK, "right"))
        if stop <= at:
            digest = hashlib.blake2b(tokens.data[first : end[at]].tobytes(), digest_size=16, key=b"strings").digest()
            a[at], b[at] = np.frombuffer(digest, dtype="<i8")
            at += 1
            continue
        own = slice(at, stop)
        x, y = fingerprints(tokens.data[first : end[stop - 1]], begin[own] - first, end[own] - first)
        a[own], b[own] = x.view(np.int64), y.view(np.int64)
        at = stop
    return a, b


# -- what runs in the workers -------------------------------------------------------------------

_CONTEXT = "key long, sig long, h long, a long, b long, n short, lo int, lead short, starts short"
_PLACED = ["h", "a", "b", "n", "lo", "lead", "starts"]
_PIECE = "h long, a long, b long, at int, unit long, pa long, pb long, lead int, starts int, n short, body binary"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.astype(types[t].to_pandas_dtype()) if isinstance(c, np.ndarray) else c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _contexts_of(kind: Kind):
    """The different contexts of every text: the number of their places, two at most, and the first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(8)]
            for k, text in enumerate(batch["text"].to_pylist()):
                found = list(anchors(Tokens.of(text, kind), kind))
                if not found:
                    continue
                lo, hi, place, h, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                _, first, back, n = np.unique(a ^ mixed(h.view(np.uint64)).view(np.int64), return_index=True, return_inverse=True, return_counts=True)
                if len(first) < len(h) and ((b != b[first][back]) | (a != a[first][back])).any():
                    _, first, n = np.unique(np.stack((h, a, b), axis=1), axis=0, return_index=True, return_counts=True)
                values = np.full(len(first), k), h[first], a[first], b[first], np.minimum(n, 2), lo[first], (place - lo)[first], (hi - lo + 1)[first]
                for column, part in zip(rows, values, strict=True):
                    column.append(part)
            row, *values = (np.concatenate(x) for x in rows)
            row = pa.array(row)
            yield _batch([batch["key"].take(row), batch["sig"].take(row), *values], _CONTEXT)

    return run


def _pieces_of(kind: Kind, span: int | None):
    """The bytes of the contexts that a text stands for; with span, cut into pieces of so many starts.

    Pieces are cut at fixed distances from the anchor, and their unit is named by what all
    strings of that distance hold, so equal strings meet in one unit again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, asked in zip(batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
                tokens = Tokens.of(text, kind)

                def octets(low: int, high: int, tokens: Tokens = tokens) -> bytes:
                    begin, end = (low, high) if tokens.begin is None else (tokens.begin[low], tokens.end[high - 1])
                    return tokens.data[begin:end].tobytes()

                for x in asked:
                    own, first, n = (x["h"], x["a"], x["b"]), x["lo"], x["n"]
                    last, anchor = first + x["starts"] - 1, first + x["lead"]
                    if span is None:
                        rows.append((*own, 0, *own, x["lead"], x["starts"], n, octets(first, last + kind.length)))
                        continue
                    at = first
                    while at <= last:
                        part = (anchor - at) // span
                        stop = min(last, anchor - part * span)
                        # what every string of this distance from the anchor holds
                        core = octets(anchor - part * span, anchor - part * span - span + 1 + kind.length)
                        unit = hashlib.blake2b(core, digest_size=8, key=b"%d %d" % (own[0], part)).digest()
                        body = octets(at, stop + kind.length)
                        piece = hashlib.blake2b(body, digest_size=16, key=b"%d" % (stop - at)).digest()
                        rows.append((*own, at - first, int.from_bytes(unit, "little", signed=True), *np.frombuffer(piece, dtype="<i8").tolist(), anchor - at, stop - at + 1, n, body))
                        at = stop + 1
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 11, _PIECE)

    return run


def _symbols(bodies: list[bytes], kind: Kind, names: dict[bytes, int]) -> list[np.ndarray]:
    """The tokens of every body as integers from 2 on; words are named exactly."""
    if not kind.words:
        return [np.frombuffer(b, dtype=np.uint8).astype(np.int64) + 2 for b in bodies]
    return [np.array([names.setdefault(w, len(names) + 300) for w in b.split(b" ")], dtype=np.int64) for b in bodies]


_GAP, _END = np.array([1]), np.array([0])


def _unit_text(kind: Kind, contexts: list[tuple[int, int, int, np.ndarray]]) -> tuple[np.ndarray, list[int], int, int]:
    """The text of a unit, where its contexts begin, and the tokens before and in their core.

    contexts: lead (tokens before the anchor), starts, n, symbols. All strings of a unit hold its
    core, the tokens from the last start to the first end; the core is one symbol, named by its
    content, so contexts with other bytes there have another symbol.
    """
    before = min(lead - starts + 1 for lead, starts, _, _ in contexts)  # from the core to the anchor
    size = kind.length - max(lead for lead, _, _, _ in contexts) + before
    cores: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    for lead, _, _, symbols in contexts:
        cut = lead - before
        core = symbols[cut : cut + size]
        name = 2**31 + cores.setdefault(core.tobytes(), len(cores))
        parts += [symbols[:cut], np.array([name]), symbols[cut + size :], _GAP]
        begins.append(at)
        at += len(symbols) - size + 2
    parts.append(_END)
    return np.concatenate(parts), begins, before, size


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many leading columns agree in every row."""
    differ = left != right
    return np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])


def repeated_masks(units: list[list[tuple[int, int, int, np.ndarray]]], kind: Kind) -> list[list[np.ndarray]]:
    """For every context of every unit the starts whose string another place has too.

    One suffix array is built over the text of each unit by linear grouping. A context that n
    places have counts n times there, so each of its suffixes has n equals. Suffixes that begin
    with equal strings are neighbours in the array; neighbours are compared symbol by symbol.
    """
    texts = [_unit_text(kind, u) for u in units]
    # a string that one place alone has could only equal itself
    order = sorted((i for i, u in enumerate(units) if sum(n for _, _, n, _ in u) > 1), key=lambda i: len(texts[i][0]))
    arrays: dict[int, np.ndarray] = {}
    at = 0
    while at < len(order):
        stop, held = at, 0
        while stop < len(order) and (stop == at or held + len(texts[order[stop]][0]) <= STEP_SYMBOLS) and stop - at < 2**16:
            held += len(texts[order[stop]][0])
            stop += 1
        own = order[at:stop]
        if len(own) < STEP_TEXTS:
            for i in own:
                arrays[i] = np.array(suffix_array(texts[i][0].tolist()))
        else:
            ends = np.cumsum([len(texts[i][0]) for i in own])
            whole = suffix_arrays(np.concatenate([texts[i][0] for i in own]), ends)
            for i, begin, end in zip(own, np.concatenate(([0], ends[:-1])), ends, strict=True):
                arrays[i] = whole[begin:end] - begin
        at = stop
    none = lambda u: [np.zeros(starts, dtype=bool) for _, starts, _, _ in u]
    return [_neighbours(kind, u, *texts[i], arrays[i]) if i in arrays else none(u) for i, u in enumerate(units)]


def _neighbours(kind: Kind, contexts: list, text: np.ndarray, begins: list[int], before: int, size: int, array: np.ndarray) -> list[np.ndarray]:
    masks = [np.full(starts, n > 1) for _, starts, n, _ in contexts]
    if len(contexts) == 1:
        return masks
    owner = np.full(len(text), -1, dtype=np.int64)
    ahead = np.zeros(len(text), dtype=np.int64)  # tokens from a start to the core
    for k, ((lead, starts, _, _), begin) in enumerate(zip(contexts, begins, strict=True)):
        owner[begin : begin + starts] = k
        ahead[begin : begin + starts] = lead - before - np.arange(starts)
    array = array[owner[array] >= 0]
    x, y = array[:-1], array[1:]
    near = ahead[x] == ahead[y]
    x, y = x[near], y[near]
    if not len(x):
        return masks
    longest = max(lead - before for lead, _, _, _ in contexts)
    wide = kind.length - size
    left, core, right = np.zeros((len(contexts), max(longest, 1)), np.int64), np.zeros(len(contexts), np.int64), np.zeros((len(contexts), max(wide, 1)), np.int64)
    for k, ((lead, _, _, symbols), begin) in enumerate(zip(contexts, begins, strict=True)):
        cut = lead - before
        left[k, :cut] = text[begin : begin + cut][::-1]
        core[k] = text[begin + cut]
        rest = text[begin + cut + 1 : begin + cut + 1 + min(wide, len(symbols) - cut - size)]
        right[k, : len(rest)] = rest
        right[k, len(rest) :] = -1 - k
        left[k, cut:] = -1 - k
    pair, back = np.unique(owner[x] * len(contexts) + owner[y], return_inverse=True)
    p, q = pair // len(contexts), pair % len(contexts)
    to_left, to_right = _common(left[p], left[q]), _common(right[p], right[q])
    hit = np.zeros(len(text), dtype=bool)
    equal = (core[p] == core[q])[back] & (to_left[back] >= ahead[x]) & (to_right[back] >= wide - ahead[x])
    hit[x[equal]] = hit[y[equal]] = True
    return [m | hit[begin : begin + len(m)] for m, begin in zip(masks, begins, strict=True)]


_MASK = "unit long, pa long, pb long, mask binary"


def _decide(kind: Kind):
    """Rows of a unit stand together; a mask of starts for each of its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: list[list] = []
        ids: list[list] = []
        names: dict[bytes, int] = {}
        now, held = None, 0

        def close() -> pa.RecordBatch:
            nonlocal units, ids, names, held
            rows = []
            for own, masks in zip(ids, repeated_masks(units, kind), strict=True):
                rows += [(*i, np.packbits(m, bitorder="little").tobytes()) for i, m in zip(own, masks, strict=True) if m.any()]
            units, ids, names, held = [], [], {}, 0
            return _batch(list(zip(*rows, strict=True)) or [[]] * 4, _MASK)

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("unit", "pa", "pb", "lead", "starts", "n", "body"))
            for unit, one, two, lead, starts, n, body in zip(*columns, strict=True):
                if unit != now:
                    if held > 4 * STEP_SYMBOLS:
                        yield close()
                    units.append([])
                    ids.append([])
                    now = unit
                symbols = _symbols([body], kind, names)[0]
                units[-1].append((lead, starts, n, symbols))
                ids[-1].append((unit, one, two))
                held += len(symbols)
        yield close()

    return run


def _spans_of(kind: Kind):
    """The runs of bytes that the found strings cover in every text, and what is left."""
    schema = "key long, sig long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, sig, text, found in zip(*(batch[c].to_pylist() for c in ("key", "sig", "text", "found")), strict=True):
                masks: dict[tuple, list] = {}
                tokens = Tokens.of(text, kind)
                edge = np.zeros(len(tokens) + 1, dtype=np.int32)

                def cover(low: np.ndarray, parts: list, edge: np.ndarray = edge) -> None:
                    for at, mask in parts:  # every start has one context, so no place is named twice
                        j = (low[:, None] + at + np.flatnonzero(mask)).ravel()
                        edge[j] += 1
                        edge[j + kind.length] -= 1

                for f in found:
                    parts = [(m["at"], np.unpackbits(np.frombuffer(m["mask"], np.uint8), bitorder="little")) for m in f["masks"]]
                    if f["n"] > 1:
                        masks[f["h"], f["a"], f["b"]] = parts
                    else:
                        cover(np.array([f["lo"]]), parts)
                # contexts that this text has again and again
                for lo, _, _, h, a, b in anchors(tokens, kind) if masks else ():
                    order = np.argsort(a)
                    ranked = a[order]
                    for (own, one, two), parts in masks.items():
                        i = order[np.searchsorted(ranked, one) : np.searchsorted(ranked, one, "right")]
                        cover(lo[i[(h[i] == own) & (b[i] == two)]], parts)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                begin, end = turn[0::2], turn[1::2]
                data = text.encode()
                if kind.words:
                    begin, end = tokens.first[begin], tokens.last[end - 1]
                left, at = hashlib.sha256(), 0
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    left.update(data[at:s])
                    at = e
                left.update(data[at:])
                rows.append((key, sig, int((end - begin).sum()), len(begin), left.hexdigest(), begin.tolist(), end.tolist()))
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 7, schema)

    return run, schema


# -- the operator ----------------------------------------------------------------------------------


def _masks_of_hot(held: DataFrame, hot: DataFrame, kind: Kind) -> DataFrame:
    """Masks of the contexts of units that are too great: cut ever finer, arrays for what is small enough."""
    key = ["h", "a", "b"]
    done = None
    held = held.where("size(asked_hot) > 0").drop("asked")
    for span in SPANS:
        if done is None:  # the texts hold what is asked of them
            asked = held.select("text", F.col("asked_hot").alias("asked"))
        else:
            asked = hot.groupBy("key", "sig").agg(F.collect_list(F.struct(*_PLACED)).alias("asked"))
            asked = held.join(asked, ["key", "sig"]).select("text", "asked")
        rows = written(asked.mapInArrow(in_slices(_pieces_of(kind, span)), _PIECE), "pieces")
        once = rows.groupBy("unit", "pa", "pb").agg(
            F.first("lead").alias("lead"), F.first("starts").alias("starts"), F.least(F.sum("n"), F.lit(2)).cast("short").alias("n"), F.first("body").alias("body")
        )
        once = written(once, "pieces_once")
        great = once.groupBy("unit").count().where(F.col("count") > UNIT_CONTEXTS).select("unit")
        great = written(great, "great_units")
        last = span == SPANS[-1] or great.isEmpty()
        if not last:
            once = once.join(great, "unit", "left_anti")
        found = _arrays(once, kind)
        found = rows.join(written(found, "piece_masks"), ["unit", "pa", "pb"]).select(*key, "at", "mask")
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        again = rows.join(great, "unit").select(*key).distinct()
        hot = hot.join(written(again, "still_hot"), key)
    return done


def _arrays(pieces: DataFrame, kind: Kind) -> DataFrame:
    columns = ["unit", "pa", "pb", "lead", "starts", "n", "body"]
    return pieces.select(*columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(returning(_decide(kind)), _MASK)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: bool = False
) -> DataFrame:
    """Find every byte that a string of `length` bytes covers which also starts anywhere else.

    With words, strings are of `length` words, however these are spaced.

    1. Each text is cut into contexts by anchors (see anchors): equal strings have equal anchors.
       Only hashes move; anchors that occur once are dropped, and equal contexts (124-bit
       fingerprints) become one, with the number of their places, counted before the shuffle.
    2. The contexts of an anchor are a unit. One suffix array by linear grouping is built over the
       text of each unit (see repeated_masks), for many units in step, and tells which strings
       start twice. Hashes bring candidates together; the array and its symbols decide.
    3. A unit of over UNIT_CONTEXTS contexts (a passage that very many documents share, in
       different surroundings) is cut at fixed distances from the anchor into smaller units, and
       pieces that agree there become one before the shuffle; SPANS gives the sizes, down to one
       string. No task holds an unbounded unit, and the array decides all of them.
    4. The masks come back to the texts, which cut what they cover.

    Defined cases: null and empty texts, and those below the length, lose nothing; rows repeated
    with the same id are two places of their text; null ids are one id among others; periodic
    texts have many equal contexts, which count once; an empty table gives none; extra columns
    are ignored.
    Out: id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (of the removed runs), and
    sig, a hash of the text that tells rows of one id apart.
    """
    kind = Kind(length, words)
    text = text_of(text_col)
    own = F.col(id_col).cast("long")
    base = docs.select(own.alias("own_id"), F.coalesce(own, F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("sig"), text.alias("text"))
    long = base.where(F.octet_length("text") >= (2 * length - 1 if words else length)).select("key", "sig", "text")
    doc, context = ["key", "sig"], ["h", "a", "b"]
    found = written(long.mapInArrow(in_slices(_contexts_of(kind)), _CONTEXT), "contexts_found")
    # aggregates are written before they are joined, so that adaptive execution may split a hot anchor
    repeated = written(found.groupBy("h").agg(F.sum("n").alias("places")).where("places > 1").select("h"), "anchors_repeated")
    often = written(found.join(repeated.hint("merge"), "h"), "contexts_repeated")
    once = often.groupBy(*context).agg(F.least(F.sum("n"), F.lit(2)).cast("short").alias("n"), F.min(F.struct(*doc, "lo", "lead", "starts")).alias("stands"))
    once = written(once.select(*context, "n", "stands.*"), "contexts_once")
    great = written(once.groupBy("h").count().where(F.col("count") > UNIT_CONTEXTS).select("h"), "great_anchors")
    hot = None if great.isEmpty() else written(once.join(great, "h"), "contexts_hot")
    marked = once.withColumn("hot", F.lit(None).cast("boolean")) if hot is None else once.join(great.withColumn("hot", F.lit(True)), "h", "left")
    asked = marked.groupBy(*doc).agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.struct(*_PLACED))).alias("asked"), F.collect_list(F.when(F.col("hot"), F.struct(*_PLACED))).alias("asked_hot")
    )
    holders = often.select(*doc).distinct()  # as many as there are texts, so never broadcast
    held = written(long.join(holders.hint("merge"), doc, "left_semi").dropDuplicates(doc).join(asked, doc, "left"), "texts_held")
    pieces = held.where("size(asked) > 0").select("text", "asked").mapInArrow(in_slices(_pieces_of(kind, None)), _PIECE)
    masks = _arrays(pieces, kind).select(F.col("unit").alias("h"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(0).alias("at"), "mask")
    if hot is not None:
        masks = masks.unionByName(_masks_of_hot(held, hot, kind))
    return _covered(base, held, often, masks, kind, id_col)


def _covered(base: DataFrame, held: DataFrame, often: DataFrame, masks: DataFrame, kind: Kind, id_col: str) -> DataFrame:
    doc, context = ["key", "sig"], ["h", "a", "b"]
    masks = written(masks.groupBy(*context).agg(F.collect_list(F.struct("at", "mask")).alias("masks")), "masks")
    back = often.select(*doc, *context, "n", "lo").join(masks.hint("merge"), context).groupBy(*doc).agg(F.collect_list(F.struct(*context, "n", "lo", "masks")).alias("found"))
    run, schema = _spans_of(kind)
    cut = written(held.select(*doc, "text").join(back.hint("merge"), doc).mapInArrow(in_slices(run), schema), "spans")
    lean = base.select("own_id", *doc, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return lean.join(cut.hint("merge"), doc, "left").select(
        F.col("own_id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "starts",
        "ends",
        "sig",
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH, words: bool = False
) -> DataFrame:
    """The documents with the repeated runs cut out of their texts; rows and columns stay.

    A run is what strings of `length` bytes (or words) cover that start twice (see
    repeated_spans), found in the whole texts and shortened to whole characters. Where chars_col
    is a column, it gets the new count of characters of the texts that are cut. Null texts stay null.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    spans = repeated_spans(docs, id_col, text_col, length, words).where("n_spans > 0")
    spans = spans.select(key.alias("__id"), F.col("sig").alias("__sig"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    spans = spans.dropDuplicates(["__id", "__sig"])
    signed = docs.withColumn("__own", F.xxhash64(text_of(text_col)))
    found = signed.join(spans.hint("merge"), (key == F.col("__id")) & (F.col("__own") == F.col("__sig")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch[text_col].to_pylist(), []
            for k, (starts, ends) in enumerate(zip(batch["__starts"].to_pylist(), batch["__ends"].to_pylist(), strict=True)):
                if starts:
                    texts[k] = _cut_text(texts[k], starts, ends)
                changed.append(bool(starts))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text_col] = pa.array(texts, batch[text_col].type)
            if chars_col in columns:
                counts = [len(t) if c else n for t, c, n in zip(texts, changed, columns[chars_col].to_pylist(), strict=True)]
                columns[chars_col] = pa.array(counts, columns[chars_col].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    names = docs.columns
    return found.select(*names, "__starts", "__ends").mapInArrow(in_slices(cut), docs.schema)


def _cut_text(text: str, starts: list[int], ends: list[int]) -> str:
    data, at, parts = text.encode(), 0, []
    for start, end in zip(starts, ends, strict=True):
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]]).decode()
