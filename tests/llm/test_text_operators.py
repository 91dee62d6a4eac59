"""The ten text operators against brute force, round trips and the cases their docstrings define."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftloom.llm import common, exact_dedup, minhash, linear_grouping, packing, quality, sentencepiece_codec, sharding, suffix_dedup, token_output, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None, 0, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts():
    rng = random.Random(5)
    long = words(rng, 6000)
    return [None, "", "  \n\t", "one", "one  two\nthree", "one two three", long, long, "日本語 テキスト naïve é", "a  b \n c", "tail ", " head"]


def collect(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# -- exact duplicates ------------------------------------------------------------------------


def test_exact_duplicates_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP_SLICE", 3)
    texts = ["x  y"] * 20 + ["x\ny", "x y ", None, "", "z"]
    got = collect(exact_dedup.exact_dedup(docs(spark, texts)))
    assert got[20]["keep_id"] == 0 and got[20]["group_size"] == 21 and not got[20]["kept"]
    assert got[21]["keep_id"] == 21  # a trailing space stays one space
    assert got[23]["keep_id"] == 22 and got[22]["group_size"] == 2
    assert got[24]["text_sha256"] == hashlib.sha256(b"z").hexdigest()


def test_exact_duplicates_of_repeated_rows_and_nothing(spark):
    rows = exact_dedup.exact_dedup(docs(spark, ["a", "a", "b", "b"], [1, 1, None, 3])).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [(-1, 3, 2, False), (1, 1, 2, True), (1, 1, 2, True), (3, 3, 2, True)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    got = collect(exact_dedup.exact_dedup(docs(spark, ["a", "b", "a", "b", "c"])))
    assert [(got[i]["keep_id"], got[i]["group_size"]) for i in range(5)] == [(0, 2), (1, 2), (0, 2), (1, 2), (4, 1)]


# -- shards ------------------------------------------------------------------------------------


@pytest.mark.parametrize("count", [0, 1, 5, 300])
def test_shards_follow_the_bytes_before(spark, count):
    rng = random.Random(count)
    texts = ["x" * rng.randrange(200) for _ in range(count)]
    ids = [rng.randrange(10**12) for _ in range(count)]
    got = collect(sharding.shard_by_bytes(docs(spark, texts, ids)))
    total, before, slots = sum(len(t) + 1 for t in texts), 0, {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        r = got[i]
        shard = sum(before >= -(-j * total // 16) for j in range(1, 16))
        assert (r["shard"], r["slot"], r["text_crc32"]) == (shard, slots.get(shard, 0), zlib.crc32(t.encode()))
        slots[shard] = slots.get(shard, 0) + 1
        before += len(t) + 1


def balanced_shards(rows, largest):
    total, held, slots = sum(r["size"] for r in rows), {}, {}
    for r in rows:
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(held.get(s, 0) - total / 16) <= largest + 1 for s in range(16))


@pytest.mark.parametrize("ids", [[7] * 900 + list(range(100)), [None] * 1000, [None] * 400 + [3] * 300 + [9] * 300])
def test_shards_part_the_rows_of_one_id(spark, ids):
    rng = random.Random(8)
    texts = ["same"] * 500 + ["x" * rng.randrange(60) for _ in range(500)]
    rows = sharding.shard_by_bytes(docs(spark, texts, ids)).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, len(t) + 1) for i, t in zip(ids, texts, strict=True))
    balanced_shards(rows, 61)


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/ü\n", "x" * 50), (3, None, "x" * 50), (None, "http://b", "x" * 50), (9, "http://c", None), (2**60 + 1, "http://d", ""), (7, "u", "naïve")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first_id", F.lit("clash"))
    got = collect(warc.warc_round_trip(df, folder=f"file://{tmp_path}/a"), "page_id")
    assert got[3]["record_type"] == "response" and got[5]["refers_to"] == 3 and got[None]["refers_to"] == 3
    assert got[9]["record_type"] == "response" and got[2**60 + 1]["refers_to"] == 9 and got[2**60 + 1]["payload_bytes"] == 0
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".zst"))
    data = (tmp_path / "a" / files[0]).read_bytes()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    headers, block = next(warc.parse_archive(data))
    assert headers["warc-type"] in ("response", "revisit") and block.startswith(b"HTTP/1.1 200")
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_reads_only_listed_archives_and_repeated_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "v", "x"), (2, "v", "x")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    common.publish(folder, "pages-000000-stale-00000.warc.zst", b"left by a lost attempt")
    rows = warc.warc_round_trip(pages, folder=folder).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows) == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2


# -- token files ----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 60_000, 1001).astype("<u4")
    index, back = token_output.read_file(token_output.make_file([1, None], [1000, 1], ids, kind, block=100))
    assert (back == ids).all() and index["docs"] == [1, None] and len(index["chunks"]) == 11
    _, part = token_output.read_file(token_output.make_file([1], [1001], ids, kind, block=100), 2, 4)
    assert (part == ids[200:400]).all()
    assert len(token_output.read_file(token_output.make_file([], [], ids[:0], kind))[1]) == 0


def test_token_files_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "FILE_IDS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = [*edge_texts(), "it's 12 don't, <|endoftext|> x", "a　b c", "a  b"]
    got = collect(token_output.token_round_trip(docs(spark, texts), path))
    start = 0
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


# -- quality -----------------------------------------------------------------------------------------


def naive_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)


def test_quality_counts_and_bands(spark):
    rng = random.Random(2)
    texts = [*[t for t in edge_texts() if not t or len(t) < 1000], "a b c d e f a b c d e x y", "# $ x\n\n# $ x\n# $ x", words(rng, 60, 9), "De " * 300, "The committee met on Tuesday to discuss new plans for the old harbour, and everyone agreed that more time was needed."]
    got = collect(quality.quality(docs(spark, texts), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        r, n = got[i], naive_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, t
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[len(texts) - 1]["kept"]


def test_quality_verdict_equals_a_plain_version_and_each_measure_rejects(spark):
    import base64
    import math

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(21)
    clean = "The committee met on Tuesday to discuss new plans for the old harbour, and everyone agreed that more time was needed."
    bits = "00000100011001010011101011011111"  # every window of five once
    texts = [
        clean,
        " ".join(w + "%#*"[rng.randrange(3)] * 3 for w in clean.split()),  # few characters per token
        " ".join(rng.sample(["responsibilities", "communications", "representatives", "international", "organizations", "relationships", "characteristics", "administration", "opportunities", "understanding", "recommendations", "particularly"], 12)),
        clean + " " + " ".join("\U00010330\U00010331\U00010332" for _ in range(3)),  # byte fallback
        " ".join("of" if b == "0" else "the" for b in bits),  # low entropy
        None, "", "too short", "one\n" * 30,
    ]
    langs = ["en"] * 6 + [None, "xx", "de"]
    rows = spark.createDataFrame([(None if i == 7 else i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    got = collect(quality.quality(rows, path, public_tokenizers.PATTERN))
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        n = naive_counts(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        ids = own.encode_ordinary(" ".join((t or "").split()))
        share = [ids.count(x) / len(ids) for x in set(ids)]
        fallback = 0
        for x in ids:
            try:
                own.decode_single_token_bytes(x).decode()
            except UnicodeDecodeError:
                fallback += 1
        low, high, most, least = quality.BANDS.get(lang, quality.BANDS[None])
        kept = not failed and low <= n[1] / len(ids) <= high and fallback / len(ids) <= most
        kept = kept and -sum(p * math.log2(p) for p in share) >= least * math.log2(min(len(ids), quality.ENTROPY_TOKENS))
        assert (got[None if i == 7 else i]["base_failed"], got[None if i == 7 else i]["kept"]) == (failed, kept), i
        assert i > 4 or (not failed and kept == (i == 0)), i
    assert quality.quality(rows.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_quality_rejects_symbol_junk_and_keeps_clean_text(spark):
    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    judged = quality.quality(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    judged = judged.where("not base_failed").join(labels, "doc_id").join(rows.select("doc_id", "text"), "doc_id").collect()
    marked = lambda t: np.mean([any(c in w for c in "#*$%&|<>") for w in t.split()]) >= 0.3
    junk = [r["kept"] for r in judged if r["quality"] == 0 and marked(r["text"])]
    clean = [r["kept"] for r in judged if r["quality"] == 1]
    assert len(junk) >= 20 and np.mean(junk) <= 0.1
    assert len(clean) >= 200 and np.mean(clean) >= 0.98


# -- near duplicates -----------------------------------------------------------------------------------


def naive_components(texts, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("members", [minhash.UNIT_MEMBERS, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(minhash, "UNIT_MEMBERS", members)
    rng = random.Random(7)
    base = words(rng, 120).split()
    texts = [*edge_texts(), "a b", "A b", "a b c"]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [words(rng, 50) for _ in range(20)]
    got = collect(minhash.near_duplicates(docs(spark, texts), percent=85))
    n, root = naive_components(texts, 85)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n[i], root[i], root[i] == i)


@pytest.mark.parametrize("fold", [7, 1 << 20])
def test_connected_equals_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(minhash, "FOLD_EDGES", fold)
    rng = random.Random(3)
    path = list(range(100, 400))
    rng.shuffle(path)
    edges = list(itertools.pairwise(path))  # a long chain in random order
    edges += [(999, x) for x in range(500, 560)] + [(1000, x) for x in range(1001, 1060)]  # hubs above and below
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    edges += [(5000, 5000), (-3, 7), (7, -3), (2**62, -(2**62))] + edges[:20]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    got = minhash.connected(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent if find(x) != x)
    assert minhash.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_compare_words_and_not_hashes(spark):
    assert sum(map(len, map(set, [common.word_hashes(balanced(1024)).tolist(), common.word_hashes(balanced(1024).translate({97: "b", 98: "a"})).tolist()]))) == 2
    texts = [balanced(1024), balanced(1024).translate({97: "b", 98: "a"}), balanced(5000), balanced(5000).translate({97: "b", 98: "a"}), "A " + balanced(1024)]
    texts += ["one two three four five six", "ONE two three four five six", "one two three four five six one two three four five six"]
    got = collect(minhash.near_duplicates(docs(spark, texts), percent=85))
    n, root = naive_components(texts, 85)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == list(zip(n, root, strict=True))
    sets = minhash.exact_sets(texts, 5)
    assert [len(s) for s in sets] == n and len(set(sets[0]) & set(sets[1])) == 0


def test_workers_keep_little_between_tasks(spark):
    """Tables, batches of any size and a second worker in a task count in an executor's memory."""
    import pyarrow as pa

    data = np.frombuffer(b"ab cd " * 100, dtype=np.uint8)
    common.word_hashes(data.tobytes().decode())
    assert sum(x.nbytes for pair in common._tables() for x in pair) <= 32 << 20
    seen = []
    rows = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    out = list(common.in_slices(lambda batches: (seen.append(b.num_rows) or b for b in batches))(iter([rows, rows[:0]])))
    assert max(seen) <= common.SLICE and pa.Table.from_batches(out).column("x").to_pylist() == list(range(2500))
    base = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    dealt = spark.createDataFrame([("u", None, 1), ("u", None, 2)], "unit string, leader string, doc_id long")
    links = minhash._decided(base, dealt, 5, 80)
    assert "MapIn" not in links._jdf.queryExecution().toString()
    assert {frozenset(r) for r in links.collect()} == {frozenset((1, 2))}


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = minhash.near_duplicates(docs(spark, ["a b c", "a b c", "a b c"], [4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (4, 4), (4, 4)]


# -- repeated substrings -----------------------------------------------------------------------------------


def naive_cut(texts):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - 399):
            seen[d[i : i + 400]] = seen.get(d[i : i + 400], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def balanced(n):
    """The Thue-Morse word: polynomial hashes modulo a power of two can't tell it from its complement."""
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("contexts", [256, 2])
def test_repeated_spans_equal_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "UNIT_CONTEXTS", contexts)
    rng = random.Random(3)
    passage = words(rng, 110)
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, "ab" * 600, passage[:399], words(rng, 300)]
    texts += [balanced(512) + "z", balanced(512).translate({97: "b", 98: "a"}) + "q", "abc" * 500, "q" + "cab" * 140, "é" * 450]
    for k in range(12):
        cut = rng.randrange(60)
        texts.append(words(rng, rng.randrange(60)) + "é" * (k % 3) + passage[cut : len(passage) - rng.randrange(60)] + words(rng, rng.randrange(60)))
    texts += [texts[-1], texts[-1]]
    got = collect(suffix_dedup.repeated_spans(docs(spark, texts)))
    for i, expected in enumerate(naive_cut(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected, i


def test_repeated_spans_of_a_long_periodic_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100_000)
    rng = random.Random(4)
    lone = words(rng, 500)
    texts = ["ab" * 150_000 + lone, "a" * 350_000, lone[:399] + "!" + "a" * 399]
    got = collect(suffix_dedup.repeated_spans(docs(spark, texts)))
    assert got[0]["n_removed"] == 300_000 and got[0]["kept_sha256"] == hashlib.sha256(lone.encode()).hexdigest()
    assert got[1]["n_removed"] == 350_000 and got[1]["n_spans"] == 1
    assert got[2]["n_removed"] == 0


def test_repeated_spans_of_nothing_null_ids_and_repeated_rows(spark):
    assert suffix_dedup.repeated_spans(docs(spark, [])).count() == 0
    rng = random.Random(6)
    long = words(rng, 200)
    rows = suffix_dedup.repeated_spans(docs(spark, [long, long, None, words(rng, 200)], [None, None, None, 4])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (-1, len(long)), (-1, len(long)), (4, 0)]


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(400):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(40))] + [0] for _ in range(rng.randrange(1, 8))]
        ends = np.cumsum([len(t) for t in texts])
        side_by_side = linear_grouping.suffix_arrays(np.concatenate([np.array(t) for t in texts]), ends)
        for text, end in zip(texts, ends.tolist(), strict=True):
            expected = sorted(range(len(text)), key=lambda i: text[i:])
            assert linear_grouping.suffix_array(text) == expected
            assert (side_by_side[end - len(text) : end] - (end - len(text))).tolist() == expected


def test_cut_texts_keep_rows_columns_and_characters(spark):
    passage = "é" * 300
    df = docs(spark, ["abc" + passage + "xyz", "qrs" + passage + "t", None, "kept as it is"])
    out = collect(suffix_dedup.without_repeats(df))
    assert out[0]["text"].startswith("abc") and out[0]["text"].endswith("xyz") and len(out[0]["text"]) < 20
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[2]["text"] is None and out[3]["text"] == "kept as it is"
    assert set(out[0]) == set(df.columns)


@pytest.mark.parametrize("contexts", [256, 2])
def test_repeated_passages_of_words_equal_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "UNIT_CONTEXTS", contexts)
    rng = random.Random(31)
    passage = words(rng, 40, 30).split()
    texts = [None, "", " ".join(passage)]
    for k in range(40):
        cut = rng.randrange(25)
        parts = words(rng, rng.randrange(30)).split() + passage[cut : cut + rng.randrange(18, 30)] + words(rng, rng.randrange(30)).split()
        texts.append("é " * (k % 3) + rng.choice([" ", "  ", "\n"]).join(parts))
    texts += [texts[-1], "a " * 40]
    size, seen = 21, {}
    for t in texts:
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    got = collect(suffix_dedup.repeated_spans(docs(spark, texts), length=size, words=True))
    for i, t in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        w, expected = (t or "").split(), []
        covered = {k + j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(size)}
        for k in sorted(covered):
            if k - 1 in covered:
                expected[-1] = (expected[-1][0], spans[k][1])
            else:
                expected.append(spans[k])
        assert list(zip(got[i]["starts"] or [], got[i]["ends"] or [], strict=True)) == expected, i


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(32)
    letters = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    short, just, many = letters(50), letters(51), words(rng, 60, 1000)  # 99, 101 and below 400 bytes
    assert len(many) < 400
    texts = [f"{words(rng, 40, 9**6)} {p} {words(rng, 40, 9**6)}" for p in (short, short, just, just, many, many)]
    out = collect(corpus_pipeline.suffix_stage(spark, docs(spark, texts).withColumn("n_chars", F.length("text").cast("long")), ""))
    for i, t in enumerate(texts):
        assert out[i]["text"] == (t if i < 2 else t.replace(just if i < 4 else many, "")), i
        assert out[i]["n_chars"] == len(out[i]["text"])


# -- packing -------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        bounds = np.cumsum(rng.integers(1, 9, n))
        count = rng.integers(0, 9, n)
        cost = lambda chosen: sum(c * min(b for b in chosen if b >= x) for x, c in zip(bounds, count, strict=True))  # noqa: B023, E731
        best = min(cost((*cut, bounds[-1])) for size in range(k) for cut in itertools.combinations(bounds[:-1], size))
        chosen = packing.best_boundaries(bounds, count, count * bounds, k)
        assert len(chosen) <= k and cost(chosen) == best


def test_packing_of_null_ids_repeated_rows_and_one_very_long_text(spark):
    texts = ["a b"] * 5 + ["w " * 30_001, None]
    rows = packing.pack_documents(docs(spark, texts, [None, None, 2, 2, 2, 3, 4]), buckets=2, budget=16).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows) == [(-1, 2), (-1, 2), (2, 2), (2, 2), (2, 2), (3, 30_001), (4, 0)]
    assert max(r["bound"] for r in rows) == 30_008 and len({(r["bucket"], r["batch"], r["place"]) for r in rows}) == 7


def test_batches_keep_the_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 16)
    rng = random.Random(9)
    texts = [None, "", *[words(rng, rng.choice([1, 5, 9, 30, 200, 900])) for _ in range(300)]]
    rows = packing.pack_documents(docs(spark, texts), buckets=4, budget=1000).collect()
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(range(len(texts)))
    batches = {}
    for r in rows:
        assert r["length"] == len((texts[r["doc_id"]] or "").split()) <= r["bound"] and r["padding"] == r["bound"] - r["length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for own in batches.values():
        assert sorted(r["place"] for r in own) == list(range(len(own)))
        assert len(own) * own[0]["bound"] <= 1000 or len(own) == 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


# -- SentencePiece ---------------------------------------------------------------------------------------------


def naive_best(word, vocab):
    """Best score over all segmentations, by plain dynamic programming without shared prefixes."""
    best = [0.0] + [-1e300] * len(word)
    for end in range(1, len(word) + 1):
        for at in range(end):
            if word[at:end] in vocab.pieces:
                best[end] = max(best[end], best[at] + vocab.pieces[word[at:end]][1])
        if word[end - 1] not in vocab.pieces:
            best[end] = max(best[end], best[end - 1] + vocab.byte_score * len(word[end - 1].encode()))
    return best[-1]


def test_shared_prefixes_give_the_best_paths(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = sentencepiece_codec.Vocabulary.load(path)
    score = {i: s for i, s in vocab.pieces.values()} | dict.fromkeys(vocab.bytes_id, vocab.byte_score)
    rng = random.Random(11)
    found = ["".join(rng.choice("abcdeinrst日é") for _ in range(rng.randrange(12))) for _ in range(400)]
    marked = list({sentencepiece_codec.MARK + w for w in found})
    for word, ids in sentencepiece_codec.segment(marked, vocab).items():
        assert sum(score[i] for i in ids) == pytest.approx(naive_best(word, vocab))
        assert b"".join(vocab.octets[i] for i in ids).decode() == word.replace(sentencepiece_codec.MARK, " ")
    texts = [*edge_texts(), "has ▁ inside", "\u0000control", "🙂 emoji 🙂"]
    got = collect(sentencepiece_codec.codec_round_trip(docs(spark, texts), path))
    for i, t in enumerate(texts):
        assert got[i]["round_trip"] and got[i]["decoded_crc32"] == zlib.crc32((t or "").encode())


# -- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = random.Random(13)
    bad = ["idiotish", "scumlike", "trashy"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        body = words(rng, 30).split()
        if toxic:
            body.insert(rng.randrange(30), rng.choice(bad))
        texts.append(" ".join(body))
        labels.append((i, int(toxic)))
    texts += [None, ""]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = collect(toxicity.toxicity(docs(spark, texts), marks))
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(test)) for i in range(600))
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in test]) > 0.95
    assert got[600]["score"] == got[601]["score"] and 0 <= got[600]["score"] <= 1
    # the held-out labels don't matter
    turned = spark.createDataFrame([(i, 1 - y if i in set(test) else y) for i, y in labels], "doc_id long, toxic int")
    again = collect(toxicity.toxicity(docs(spark, texts), turned))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-12 for i in got)
    none = collect(toxicity.toxicity(docs(spark, ["a"]), marks.limit(0)))
    assert none[0]["predicted"] == 0


def test_toxicity_model_equals_a_plain_version():
    rng = random.Random(14)
    texts = [words(rng, 12, 40) + (" trashy scum" if i % 3 == 0 else "") for i in range(60)]
    labels = np.array([int(i % 3 == 0) for i in range(60)])
    sets = [np.unique(toxicity.features(t)) for t in texts]
    model = toxicity.fit(sets, labels)
    grams = [set(s.tolist()) for s in sets]
    ratio = {}
    for g in set().union(*grams):
        p, q = (sum(g in s for s, y in zip(grams, labels, strict=True) if y == k) for k in (1, 0))
        r = np.log((p + 0.5) / (labels.sum() + 1)) - np.log((q + 0.5) / ((1 - labels).sum() + 1))
        if p + q >= toxicity.LEAST_TEXTS and abs(r) >= toxicity.LEAST_RATIO:
            ratio[g] = r
    assert set(np.flatnonzero(model.weight).tolist()) == set(ratio)
    # Newton steps on the same penalised likelihood reach the same scores
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in s) for g in names] + [0] for s in grams])
    scale = np.sqrt(np.maximum(1, (x**2).sum(axis=1))).max() / 8
    x = x / scale
    x[:, -1] = 1
    penalty = np.diag([toxicity.RIDGE] * len(names) + [1e-12])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + penalty, x.T @ (p - labels) / len(x) + penalty @ w)
    plain = 1 / (1 + np.exp(-x @ w))
    own = np.array([toxicity.score_text(t, model) for t in texts])
    assert ((own >= 0.5) == (plain >= 0.5)).all() and ((own >= 0.5) == labels).all()
    loss = lambda p: -np.mean(np.where(labels, np.log(p), np.log(1 - p)))
    assert loss(own) < 0.05 and loss(plain) < 0.05


def test_toxicity_of_repeated_rows_null_ids_and_several_labels(spark):
    rng = random.Random(15)
    texts = [words(rng, 12, 40) + (" trashy scum" if i % 2 else "") for i in range(80)]
    ids = [None if i == 0 else i for i in range(80)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 80)] + [(4, 1), (4, 0)], "doc_id long, toxic int")
    once = toxicity.train(docs(spark, texts, ids), marks)
    again = toxicity.train(docs(spark, texts * 3, ids * 3), marks)
    assert np.array_equal(once.weight, again.weight) and once.constant == again.constant
    rows = toxicity.toxicity(docs(spark, texts * 2, ids * 2), marks).collect()
    assert len(rows) == 160 and len({(r["doc_id"], r["score"]) for r in rows}) == 80
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]


# -- hashing ----------------------------------------------------------------------------------------------------------


def test_word_and_shingle_hashes_follow_the_words():
    a, b = common.word_hashes("x  yy\tzz"), common.word_hashes("zz yy x")
    assert a[0] == b[2] and a[1] == b[1] and a[2] == b[0] and len(set(a.tolist())) == 3
    assert common.shingle_hashes(common.word_hashes("p q"), 5).shape == (1,)
    assert common.shingle_hashes(common.word_hashes(""), 5).shape == (0,)
    assert (common.word_hashes("AB é", lower=True) == common.word_hashes("ab é")).all()


# -- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(17)
    parts = "the and ing tion ent ation for tha her ter hat ere ate his con res ver all ons nce men ith ted ers".split()
    body = lambda: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(100))
    a, b = body(), body()
    near = a.split()
    near[50] = "other"
    shared = body()
    texts = [a, a.replace(" ", "  "), " ".join(near), b, "short", None, "De " * 200, body() + " " + shared, body() + " " + shared]
    rows = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.written(stage(spark, rows, ""), name)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert kept["quality"] == {0, 1, 2, 3, 7, 8}
    assert kept["exact_dedup"] == {0, 2, 3, 7, 8}
    assert kept["near_dedup"] == {0, 3, 7, 8} == kept["suffix_dedup"]
    cut = collect(rows)
    assert cut[3]["text"] == b and shared not in cut[7]["text"] and len(cut[7]["text"]) > 300
    out = corpus_pipeline.STAGES[-1][1](spark, rows, "")
    assert out.count() == 4


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    rows = docs(spark, [None, ""]).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        rows = common.written(stage(spark, rows, ""), name)
    assert rows.count() == 0


def test_token_files_and_pieces_of_nothing_and_null_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_output.token_round_trip(docs(spark, []), path).count() == 0
    rows = token_output.token_round_trip(docs(spark, ["a", "a", None], [None, 2, 2]), path).collect()
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"]) for r in rows) == [(-1, 0, 2), (2, 2, 1), (2, 3, 2)]
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    assert sentencepiece_codec.codec_round_trip(docs(spark, []), pieces).count() == 0
    rows = sentencepiece_codec.codec_round_trip(docs(spark, ["a b", "a b", None], [None, 2, 2]), pieces).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in rows) == [(-1, 2), (2, 0), (2, 2)] and all(r["round_trip"] for r in rows)


def test_pipeline_keeps_one_row_of_copies_with_shared_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(41)
    parts = "the and ing tion ent ation for tha her ter hat ere ate his con res ver all ons nce men ith ted ers".split()
    body = lambda: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(100))
    a, b, c, d, e, f = (body() for _ in range(6))

    def near(t):
        w = t.split()
        w[60] = "other"
        return " ".join(w)

    rows = [
        (1, a), (1, a), (1, a.replace(" ", "  ")),  # a repeated row, and the same with other spaces
        (2, b), (None, b), (None, near(b)),  # a copy and a near copy without ids
        (None, c), (None, c), (None, near(c)),  # copies and a near copy that have no id at all
        (5, d), (6, d), (6, e),  # one id, two texts, one of them a copy
        (7, f), (8, near(f)), (8, near(f)),
    ]
    out = docs(spark, [t for _, t in rows], [i for i, _ in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, out, ""), name)
        assert name != "quality" or out.count() == len(rows)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(i or 0 for i, _ in got) == [0, 1, 2, 5, 6, 7]
    texts = dict(got)
    assert " ".join(texts[1].split()) == a and texts[2] == b and texts[None] in (c, near(c)) and (texts[5], texts[6], texts[7]) == (d, e, f)
    assert corpus_pipeline.packing_stage(spark, out, "").count() == 6
