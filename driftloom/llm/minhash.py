"""Near-duplicate documents: circulant MinHash, banding, and links confirmed on whole sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import in_slices, mixed, returning, shingle_hashes, text_of, word_hashes, written

#: 30 bands of 6 coordinates: at a similarity of 0.85 a pair shares no band once in 1.5 million.
BANDS, ROWS = 30, 6
#: Members of a unit of comparison, and the shingles that its sets may sum to.
UNIT_MEMBERS, UNIT_SHINGLES = 1024, 2_000_000
#: Members of one unit that are compared with a leader alone.
STAR_MEMBERS = 512
#: Edges that a task gathers before it turns them into stars.
FOLD_EDGES = 1 << 20
#: Up to so many members are compared pair by pair, more by products of incidence matrices.
FEW, COLUMNS = 12, 4096

_SHIFT = (np.arange(BANDS * ROWS, dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z in lower case."""
    return np.unique(shingle_hashes(word_hashes(text, lower=True), words))


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates from two permutations of 32-bit positions.

    The first permutation gives every shingle a position; the second one, turned by the k-th
    shift (added to the position before it, modulo 2**32), gives coordinate k as its minimum.
    """
    position = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(position), 2048):
        x = position[None, at : at + 2048] + _SHIFT
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x21F0AAAD)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x735A2D97)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for column in best.reshape(BANDS, ROWS).T.astype(np.uint64):
        total = mixed(total ^ column) + total
    return total


def exact_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The shingles of several texts as sorted distinct integers, equal for equal words alone.

    Words are named by their bytes; runs of 2, 3, ... words are named by the name of the run before
    and of the next word, so nothing is hashed.
    """
    names: dict[bytes, int] = {}
    rows = []
    for text in texts:
        own = [names.setdefault(w, len(names) + 1) for w in text.encode("utf-8", "surrogatepass").lower().split()]
        rows.append(own + [0] * (words - len(own)) if own else [0] * words)
    size = np.array([len(r) for r in rows])
    word = np.fromiter((w for r in rows for w in r), np.int64, int(size.sum()))
    run = word
    for k in range(1, words):
        run = np.unique(run[:-1] * (len(names) + 1) + word[k:], return_inverse=True)[1]
    begin = np.cumsum(size) - size
    return [np.unique(run[b : b + n - words + 1]) if rows[i][0] else run[:0] for i, (b, n) in enumerate(zip(begin, size, strict=True))]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, 128 bits that stand for the set, and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, bands = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                whole = np.frombuffer(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16, key=b"sets").digest(), dtype="<i8")
                one.append(int(whole[0]))
                two.append(int(whole[1]))
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else np.empty(0, np.int64))
            bands = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), bands],
                ["doc_id", "n", "set_a", "set_b", "bands"],
            )

    return docs.mapInArrow(in_slices(sketch), "doc_id long, n long, set_a long, set_b long, bands array<long>")


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Edges from every node to the smallest one that it is linked with, and whether they differ from those given."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    given = np.unique(x * len(nodes) + y)
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))  # both are roots, so no cycle arises
        while not np.array_equal(higher := root[root], root):
            root = higher
    node = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[node], nodes[root[node]], not np.array_equal(node * len(nodes) + root[node], given)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars; moved tells whether any edge had moved or moves here."""
    held = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    count, moved = 0, False

    def fold() -> None:
        nonlocal held, count, moved
        a, b, changed = spanning_stars(np.concatenate(held[0]), np.concatenate(held[1]))
        held, count, moved = ([a], [b]), 0, moved or changed

    for batch in batches:
        for column, part in zip(held, (batch["a"], batch["b"]), strict=True):
            column.append(part.to_numpy(zero_copy_only=False))
        moved = moved or bool(np.any(batch["moved"].to_numpy(zero_copy_only=False)))
        count += batch.num_rows
        if count > FOLD_EDGES:
            fold()
    fold()
    a, b = held[0][0], held[1][0]
    for at in range(0, len(a), 65536):
        rows = pa.array(a[at : at + 65536]), pa.array(b[at : at + 65536])
        yield pa.RecordBatch.from_arrays([*rows, pa.array([moved] * len(rows[0]), pa.bool_())], ["a", "b", "moved"])


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over the edges (a, b), by stars within and across partitions.

    Each task turns the edges of its partition into stars around their smallest nodes, in memory
    that grows with its nodes. Then every edge to a node that has a lesser neighbour elsewhere
    moves to that neighbour, and edges meet again by their greater end, until none moves. Rows never
    become more. Stars are made before the first exchange too, so a node has no more
    edges than there were tasks, and a hub is the lesser end, whose edges a join may split. Each
    step is written to the shared folder.
    """
    given = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("moved"))
    schema = "a long, b long, moved boolean"
    contract = returning(_contract)
    now = written(given.mapInArrow(contract, schema).repartition("a").mapInArrow(contract, schema), "edges")
    while not now.where("moved").isEmpty():
        # the aggregate is written before it is joined, so that adaptive execution may split a hub
        least = written(now.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")), "least")
        hooked = now.join(least, F.col("b") == F.col("c"), "left")
        hooked = hooked.select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        now = written(hooked.repartition("a").mapInArrow(contract, schema), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def unit_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a unit's sets; every pair is decided on whole sets."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((ids[x], ids[y]))

    out: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if len(ids) <= FEW:
        for x in range(len(ids)):
            for y in range(x):
                if 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]) and find(x) != find(y):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= percent * (size[x] + size[y] - shared):
                        link(x, y)
        return out
    owner = np.repeat(np.arange(len(ids)), size)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_column = np.cumsum(count > 1) - 1
    use = count[column] > 1
    owner, column = owner[use], shared_column[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(ids), len(ids)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        rows = np.unique(owner[lo:hi])
        part = np.zeros((len(rows), min(COLUMNS, width - at)), dtype=np.float32)
        part[np.searchsorted(rows, owner[lo:hi]), column[lo:hi] - at] = 1
        both[np.ix_(rows, rows)] += part @ part.T
    shared = both.astype(np.int64)  # counts below 2**24 are exact in single precision
    near = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    for x, y in zip(*np.nonzero(np.tril(near, -1)), strict=True):
        link(int(x), int(y))
    return out


def star_links(ids: list[int], sets: list[np.ndarray], percent: int, leader: int) -> list[tuple[int, int]]:
    """The links of the leader with the others of its unit."""
    own = sets[ids.index(leader)]
    out = []
    for x, s in zip(ids, sets, strict=True):
        if x != leader and 100 * min(len(s), len(own)) >= percent * max(len(s), len(own)):
            shared = len(np.intersect1d(s, own, assume_unique=True))
            if 100 * shared >= percent * (len(s) + len(own) - shared):
                out.append((x, leader))
    return out


def links_of_units(units: DataFrame, words: int, percent: int) -> DataFrame:
    """units: unit, leader (null: all pairs), doc_id, text, all rows of a unit together. Out: the links (a, b).

    Every link is decided on the words themselves, not on hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, lead = None, [], [], None

        def close() -> list[tuple[int, int]]:
            sets = exact_sets(texts, words) if len(ids) > 1 else []
            if not sets:
                return []
            return unit_links(ids, sets, percent) if lead is None else star_links(ids, sets, percent, lead)

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            found = []
            columns = (batch[c].to_pylist() for c in ("unit", "leader", "doc_id", "text"))
            for unit, leader, doc, text in zip(*columns, strict=True):
                if unit != now:
                    found += close()
                    now, ids, texts, lead = unit, [], [], None if leader is None else int(leader)
                ids.append(int(doc))
                texts.append(text)
            yield rows(found)
        yield rows(close())

    return units.mapInArrow(in_slices(run), "a long, b long")


def _dealt(members: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """unit, doc_id: groups of members whole or, beyond UNIT_MEMBERS, as pairs of blocks.

    members: node, `group`, n; sizes: `group`, m, total. Memory is bounded however large a group is.
    """
    blocks = F.when(
        (F.col("m") > UNIT_MEMBERS) | (F.col("total") > UNIT_SHINGLES),
        F.greatest(F.ceil(F.col("m") * 2.2 / UNIT_MEMBERS), F.ceil(F.col("total") * 2.2 / UNIT_SHINGLES), F.lit(2)),
    ).otherwise(1)
    dealt = members.join(sizes.select(group, blocks.cast("int").alias("blocks")), group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("node", group, "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.where("blocks = 1 or own <> other").select(
        F.concat_ws("/", group, F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.lit(None).cast("string").alias("leader"), F.col("node").alias("doc_id")
    )


def near_duplicates(
    docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The component of every document under links of a Jaccard similarity of percent or more.

    Sets are the distinct runs of `words` lower-cased words. Documents of equal sets are one
    class. Circulant MinHash signatures are banded; documents that share a band, directly or
    through others, form a candidate group (stars to the smallest id of a band, so rows stay
    linear). Links are decided on the words of whole texts, in units that a task can hold:

    * a group of at most UNIT_MEMBERS is one unit, and every pair is decided;
    * in a greater group each member is first compared with the leaders of its bands. Members so
      linked need no other link; only bands whose members still lie in different components are
      compared pair by pair, in pairs of blocks where they are great. Copies of one text, however
      many, thus cost one comparison a band, not one a pair.

    Units give links that span what they found, never all pairs.

    Defined cases: with fewer words than `words` the whole sequence is one shingle; a text
    without words, empty or null, has an empty set and is linked with nothing; rows repeated
    with the same id and text are one document, and of different texts under one id the smallest
    stands for the class they lead; a null id has a null component and links with nothing; an
    empty table gives none; extra columns are ignored.
    Out: id, n_shingles, component_id, kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    marks = written(sketches(base, words), "sketches")
    full = marks.where("n > 0 and doc_id is not null")
    classes = written(
        full.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes"
    )
    sized = classes.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n"))
    keys = classes.select("doc_id", F.explode("bands").alias("band"))
    leaders = keys.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "leader")
    leaders = written(leaders, "leaders")
    stars = keys.join(leaders, "band").where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    stars = written(stars.distinct(), "stars")
    member = connected(stars)
    member = member.unionByName(member.select(F.col("root").alias("node"), "root").distinct()).join(sized, "node")
    member = written(member, "members")
    sizes = written(member.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")), "group_sizes")
    great = (F.col("m") > UNIT_MEMBERS) | (F.col("total") > UNIT_SHINGLES)
    small = _dealt(member, "root", sizes.where(~great))
    hot = None if sizes.where(great).isEmpty() else written(member.join(sizes.where(great).select("root"), "root"), "great_groups")
    if hot is not None:
        fans = stars.join(hot.select(F.col("node").alias("a")), "a")
        fan = fans.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).alias("slices"))
        fans = fans.join(written(fan, "fans"), "b").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")))
        unit = F.concat_ws("*", "b", "slice").alias("unit")
        rays = fans.select(unit, F.col("b").cast("string").alias("leader"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        small = small.unionByName(rays)
    links = _decided(base, small, words, percent)
    if hot is None:
        root = connected(links)
    else:
        # bands whose members are not yet in one component
        root = connected(links)
        label = hot.join(root.withColumnRenamed("root", "part"), "node", "left").select("node", "n", F.coalesce("part", "node").alias("part"))
        label = written(label, "parts")
        banded = keys.withColumnRenamed("doc_id", "node").join(label, "node")
        open_bands = banded.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("p <> q")
        open_bands = written(open_bands.select("band", "m", "total"), "open_bands")
        if not open_bands.isEmpty():
            more = _dealt(banded.join(open_bands.select("band"), "band").select("node", "band"), "band", open_bands)
            # the stars found so far stand for their links
            root = connected(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_decided(base, more, words, percent)))
    own = classes.select(F.col("doc_id").alias("class_id"), "n", "set_a", "set_b").hint("merge")
    same = full.join(own, ["n", "set_a", "set_b"]).select("doc_id", "n", "class_id")
    joined = same.join(root, F.col("class_id") == F.col("node"), "left")
    labelled = joined.select("doc_id", "n", F.coalesce("root", "class_id").alias("component_id"))
    rest = marks.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return labelled.unionByName(rest).select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _decided(base: DataFrame, dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """The links of the units that unit, leader and doc_id name; written, so that a task needs no second worker for the stars."""
    dealt = written(dealt, "dealt")
    # the named documents may be all of them, so they are never broadcast
    texts = base.join(dealt.select("doc_id").distinct().hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    units = dealt.hint("merge").join(texts, "doc_id").repartition("unit").sortWithinPartitions("unit")
    return written(links_of_units(units, words, percent), "links")
