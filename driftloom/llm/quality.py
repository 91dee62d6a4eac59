"""Quality rules on counts of words, symbols and repeats, and on how a public vocabulary cuts the text."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import in_slices, shingle_hashes, text_of, word_hashes

#: Fewest words, and the most words in repeated windows, percent.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: By language: characters per token from and to, the greatest share of byte-fallback tokens, and
#: the least token entropy as a share of the bits that min(tokens, ENTROPY_TOKENS) distinct tokens
#: would have. None stands for all other languages. The edges come from all documents of a
#: language that pass the base rules (9,154 at sf0.1; labels only check them). Lower ones: the
#: median less 3.5 robust deviations (1.4826 times the median absolute deviation) of the
#: characters per token and less 3 of the entropy share, where the two modes part. Fallback:
#: 0.01 more than 1.25 times the quantile of 0.999 (0.0024, 0.0518, 0.0665, 0.0431), 0.03 at least.
#: Marks among the words lower the first and the last measure here, foreign scripts and broken
#: characters raise the second. Prose in longer words has more characters per token than this
#: corpus, so the upper edges of that measure are no quantiles: they meet only texts of a few
#: long tokens.
BANDS = {
    "en": (2.092, 8.0, 0.030, 0.686),
    "de": (2.156, 9.0, 0.075, 0.679),
    "fr": (1.904, 8.0, 0.093, 0.676),
    "es": (1.917, 8.0, 0.064, 0.669),
    None: (0.3, 12.0, 0.60, 0.50),
}
ENTROPY_TOKENS = 512
_ENCODERS: dict[tuple[str, str], tuple] = {}
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\r\v\f"


def _encoder(vocabulary: str, pattern: str):
    """The library's encoder for a file of byte-level ranks, and the ids that are no whole characters."""
    key = vocabulary, pattern
    if key not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        partial = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, rank in ranks.items():
            partial[rank] = not token.isascii() and token.decode("utf-8", "ignore").encode() != token
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), partial
    return _ENCODERS[key]


def base_counts(data: bytes, words: list[bytes], text: str) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    repeats = 0
    if len(words) > WINDOW:
        windows = shingle_hashes(word_hashes(text), WINDOW)
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        if twice.any():
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            edge[: len(windows)] += twice
            edge[WINDOW : WINDOW + len(windows)] -= twice
            repeats = int((np.cumsum(edge) > 0).sum())
    return chars, symbols, len(lines) - len(set(lines)), repeats


def fertility(text: str, chars: int, vocabulary: str, pattern: str) -> tuple[int, float, float, float]:
    """Tokens, word characters per token, share of byte-fallback tokens, token entropy in bits.

    A token falls back to bytes where its bytes are no whole characters.
    """
    if not chars:
        return 0, 0.0, 0.0, 0.0
    own, partial = _encoder(vocabulary, pattern)
    ids = np.array(own.encode_ordinary(text), dtype=np.int64)
    count = np.bincount(ids)
    p = count[count > 0] / len(ids)
    return len(ids), chars / len(ids), float(partial[ids].mean()), float(max(0.0, -(p * np.log2(p)).sum()))


def in_band(lang: str | None, n: int, per_token: float, fallback: float, bits: float, bands: dict) -> bool:
    least, most, bytes_most, entropy = bands.get(lang, bands[None])
    return n > 0 and least <= per_token <= most and fallback <= bytes_most and bits >= entropy * np.log2(min(n, ENTROPY_TOKENS))


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
_NAMES += ["n_tokens", "chars_per_token", "fallback_share", "entropy_bits"]
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_tokens long, chars_per_token double, fallback_share double, entropy_bits double"
)
#: Holds the verdict beside whatever columns the rows have.
VERDICT = "__verdict"


def judged(
    docs: DataFrame, vocabulary: str, pattern: str, bands: dict | None = None, text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """The rows as they are, with the struct VERDICT of their counts and verdict; see quality."""
    bands = bands or BANDS

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch[lang_col].to_pylist() if lang_col in batch.schema.names else [None] * batch.num_rows
            rows = []
            for text, lang in zip(batch[text_col].to_pylist(), langs, strict=True):
                text = text or ""
                data = text.encode()
                words = data.split()
                counts = base_counts(data, words, text)
                tokens = fertility(b" ".join(words).decode(), counts[0], vocabulary, pattern)
                failed = len(words) < LEAST_WORDS or 100 * counts[3] > REPEAT_PERCENT * len(words)
                rows.append((len(words), *counts, failed, not failed and bool(in_band(lang, *tokens, bands)), *tokens))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            verdict = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)
            yield pa.RecordBatch.from_arrays([*batch.columns, verdict], [*batch.schema.names, VERDICT])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(in_slices(judge), f"{own}, {VERDICT} struct<{_SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>")


def quality(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    bands: dict | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """Counts, tokeniser fertility and a verdict for every document; no shuffle.

    Words are the runs of characters that are no ASCII white space. A document fails the base
    rules with fewer than LEAST_WORDS words or with over REPEAT_PERCENT of its words in 5-word
    windows that occur twice. Others are kept if characters per token, byte-fallback share and
    token entropy, as the public vocabulary cuts the words joined by single spaces, lie in the band
    of the language; how the words were spaced or broken into lines plays no part.

    Defined cases: a null or empty text has no words, zero counts, and fails; a null or unknown
    language, or none given, has the band None; null ids and repeated rows are judged row by
    row; extra columns are ignored; an empty table gives none.
    Out: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_tokens, chars_per_token, fallback_share, entropy_bits.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), lang.alias("lang"))
    out = judged(base, vocabulary, pattern, bands)
    return out.select(F.col("id").alias(id_col), *[F.col(f"{VERDICT}.{n}").alias(n) for n in _NAMES])
