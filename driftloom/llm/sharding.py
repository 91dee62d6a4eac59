"""Shards of near equal bytes by histogram sort, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import text_of, written

#: Parts of a bracket that one pass counts.
PROBES = 32
#: Pieces of a shard that are sorted apart, so that no task sorts a whole shard: so many at least, more
#: with the rows, and so many at most (a tree of comparisons places each row).
CELLS, CELL_ROWS, MOST_CELLS = 4, 2_000_000, 64


def _index(edges: list[tuple[int, int]]) -> Column:
    """How many edges are at or below the row's key and number; edges ascend."""
    if not edges:
        return F.lit(0)
    middle = len(edges) // 2
    key, seq = edges[middle]
    below = (F.col("key") < F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("seq") < F.lit(seq)))
    return F.when(below, _index(edges[:middle])).otherwise(F.lit(middle + 1) + _index(edges[middle + 1 :]))


def splitters(keys: DataFrame, targets: list[int], low: int, high: int, tolerance: int = 0) -> list[int]:
    """For every target the smallest boundary with at least that many bytes below it.

    keys has the columns key (long) and size. Each pass counts, in all partitions at once, the
    exact bytes below PROBES - 1 probes inside the bracket of every splitter; the driver gets one
    row per probe. A splitter is settled when its bracket holds one boundary, or when the bytes
    below its upper end exceed the target by the tolerance at most.
    """
    brackets = {t: (low, 0, high + 1, None) for t in targets}  # below(lo) < t <= below(hi)
    while True:
        wide = sorted(
            {(lo, hi) for t, (lo, _, hi, above) in brackets.items() if hi - lo > 1 and (above is None or above - t > tolerance)}
        )
        if not wide:
            return [brackets[t][2] for t in targets]
        # brackets of different splitters are the same or do not overlap
        steps = [-(-(hi - lo) // PROBES) for lo, hi in wide]
        key = F.col("key")
        part = F.lit(None).cast("long")
        for i in reversed(range(len(wide))):
            (lo, hi), step = wide[i], steps[i]
            offset = key - F.lit(lo) if hi - lo < 2**62 else key.cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")
            cell = F.floor(offset / F.lit(step)) if hi - lo >= 2**62 else F.expr(f"(key - {lo}L) div {step}L")
            part = F.when((key >= F.lit(lo)) & (key < F.lit(hi)), F.lit(i * PROBES) + cell.cast("long")).otherwise(part)
        counted = keys.select(part.alias("part"), "size").where("part is not null").groupBy("part").agg(F.sum("size").alias("size"))
        found = {r["part"]: int(r["size"]) for r in counted.collect()}  # at most PROBES rows per splitter
        for t, (lo, below, hi, above) in list(brackets.items()):
            if (lo, hi) not in wide:
                continue
            i, running = wide.index((lo, hi)), below
            for j in range(PROBES):
                running_next = running + found.get(i * PROBES + j, 0)
                end = min(hi, lo + (j + 1) * steps[i])
                if running_next >= t or end == hi:
                    brackets[t] = (lo + j * steps[i], running, end, running_next)
                    break
                running = running_next


def edges_of(keyed: DataFrame, targets: list[int], low: int, high: int, tolerance: int) -> dict[int, tuple[int, int]]:
    """For every target the edge (key, number): rows below it hold at least that many bytes.

    Splitters of the key come first. Where the rows of the last key below a splitter are several,
    the splitter is sought again among their numbers, so rows of one key may be parted anywhere.
    """
    at = dict(zip(targets, splitters(keyed.select("key", "size"), targets, low, high, tolerance), strict=True))
    last = sorted({b - 1 for b in at.values()})
    is_last = F.col("key").isin(last)
    tied = keyed.select(_index([(k, 0) for k in last]).alias("part"), is_last.alias("is_last"), "size", "seq")
    tied = tied.groupBy("part", "is_last").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("top")).collect()
    # at most two rows for each splitter; a key in `last` is the first of its part
    before, below, found = {}, 0, {}
    for r in sorted(tied, key=lambda r: (r["part"], not r["is_last"])):
        if r["is_last"]:
            before[last[r["part"] - 1]] = below, r["n"], r["top"]
        below += r["size"]
    for key in last:
        own = [t for t in targets if at[t] - 1 == key]
        below, n, top = before.get(key, (0, 0, 0))
        if n < 2:
            found |= {t: (key + 1, 0) for t in own}
            continue
        rows = keyed.where(F.col("key") == F.lit(key)).select(F.col("seq").alias("key"), "size")
        inner = sorted({max(1, t - below) for t in own})
        numbers = dict(zip(inner, splitters(rows, inner, 0, top, tolerance), strict=True))
        found |= {t: (key, numbers[max(1, t - below)]) for t in own}
    return found


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0, cells: int | None = None
) -> DataFrame:
    """Put all rows into shards of near equal bytes, in ascending order of the id.

    The size of a row is the UTF-8 bytes of its text plus 1 (a null text has none). Splitters
    are found by a histogram sort: candidate boundaries are counted exactly and refined until
    the bytes below each splitter exceed its target by at most `tolerance` of a shard (0: the
    smallest boundary that reaches the target). Rows of one id are told apart by a running
    number, so however many rows share an id, shards differ by the size of one row at most. Then
    the rows move once, to `cells` pieces per shard (by default they grow with the rows, from
    CELLS to MOST_CELLS); a row's slot is its rank in its piece plus the rows of the shard's
    earlier pieces. At most shards * cells * PROBES rows of counts reach the driver.

    Defined cases: null ids stand before all others, as one id; rows with the same id, repeated
    rows included, may stand in different shards, in the order of their running numbers; an empty
    table gives no rows; extra columns are ignored.
    Out: id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("seq")
    )
    rows = written(rows, "sizes")  # the numbers are fixed from here on
    total, low, high, n = rows.agg(F.sum("size"), F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if total is None:
        return spark.createDataFrame([], f"{id_col} long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    low, high = (0, 0) if low is None else (low, high)
    floor = low - 1 if low > -(2**63) else low
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(floor)))
    cells = cells or min(MOST_CELLS, max(CELLS, -(-n // (shards * CELL_ROWS))))
    pieces = shards * cells
    targets = sorted({-(-j * total // pieces) for j in range(1, pieces)})
    at = edges_of(keyed, targets, floor, high, int(tolerance * total / shards))
    edges = [at[-(-j * total // pieces)] for j in range(1, pieces)]
    inner = sorted(set(edges))
    placed = keyed.withColumn("piece", _index(inner))
    counts = {r["piece"]: r["count"] for r in placed.groupBy("piece").count().collect()}  # at most shards * cells rows
    ends = [edges[j * cells - 1] for j in range(1, shards)]
    shard_of = [sum(e <= inner[p - 1] for e in ends) if p else 0 for p in range(len(inner) + 1)]
    before, seen = [], {}
    for p in range(len(inner) + 1):
        before.append(seen.get(shard_of[p], 0))
        seen[shard_of[p]] = before[-1] + counts.get(p, 0)
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("piece") + 1)
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("key", "seq"))
    return placed.withColumn("rank", rank).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        pick(shard_of, "int").alias("shard"),
        (pick(before, "long") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
