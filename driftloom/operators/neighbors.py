"""Exact nearest neighbours in blocks, and what is derived from one neighbour table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from driftloom.frame import ROLE, SPLIT, SRC_ID, SRC_SPLIT, TARGET, TEST, TRAIN, WEIGHT, SplitFrame
from driftloom.functions.two_sample import ks
from driftloom.operators.encode import frequency
from driftloom.operators.lineage import written
from driftloom.operators.scale import impute_median
from driftloom.operators.select import select_cumulative

#: Rows of a block; a task holds two blocks at a time.
BLOCK = 1024


def importance(frame: SplitFrame, columns: tuple[str, ...]) -> dict[str, float]:
    """The absolute correlation of every column with the target in train; 0 where one is constant."""
    cells = [F.corr(F.col(c).cast("double"), TARGET).alias(c) for c in columns]
    row = frame.train.agg(*cells).first()  # one row
    return {c: 0.0 if row[c] is None or row[c] != row[c] else abs(row[c]) for c in columns}


def space(frame: SplitFrame, columns: tuple[str, ...] | None = None, weighting: str = "none", threshold: float = 0.05) -> DataFrame:
    """id, split, vec: frequencies of the categoricals and imputed numerics, scaled over both splits.

    weighting `cumshift` keeps the columns that hold most of the shift; `ks` multiplies each by the
    root of its share of the shift. `importance` and `filter` weigh a column by its shift times its
    absolute correlation with the target in train: `importance` as `ks` does, while `filter` keeps
    the columns of at least `threshold` of the greatest weight, and three at least.
    """
    (key,) = frame.ids
    if frame.spec.cat:
        frame = frequency(frame, "combined")
        frame = replace(frame, spec=replace(frame.spec, cat=(), num=(*[f"{c}_freq_joint" for c in frame.spec.cat], *frame.spec.num)))
    columns = columns or frame.spec.num
    factor = dict.fromkeys(columns, 1.0)
    if weighting != "none":
        shift = {r["column"]: float(r["ks"]) for r in ks(frame, columns).collect()}
        scores = {c: shift.get(c, 0.0) for c in columns}
        if weighting in ("importance", "filter"):
            with_label = importance(frame, columns)
            scores = {c: scores[c] * with_label[c] for c in columns}
        if weighting == "cumshift":
            picked = select_cumulative(scores)
            columns = tuple(c for c in columns if c in picked)
        elif weighting == "filter":
            ranked = sorted(columns, key=lambda c: -scores[c])
            most = scores[ranked[0]] if ranked else 0.0
            picked = {*ranked[:3], *[c for c in ranked if scores[c] >= threshold * most]}
            columns = tuple(c for c in columns if c in picked)
        else:
            total = sum(scores.values())
            factor = {c: (scores[c] / total * len(columns)) ** 0.5 if total > 0 else 1.0 for c in columns}
    scaled = F.array(*[x * F.lit(factor[c]) if weighting != "none" else x for c, x in _scaled(frame, columns).items()])
    return frame.df.select(F.col(key).alias("id"), F.col(SPLIT).alias("split"), scaled.alias("vec"))


def _scaled(frame: SplitFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """Imputed and scaled columns, as `zscore` after `impute_median` has them, by numbers from one row.

    Medians are taken of columns with gaps alone, and plans stay short at many columns.
    """
    cells = {c: F.col(c).cast("double") for c in columns}

    def stats() -> Row:
        of = lambda x, i: (F.count(F.when(x.isNull(), 1)).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}"))
        return frame.df.agg(*[e for i, x in enumerate(cells.values()) for e in of(x, i)]).first()

    row = stats()
    gaps = [c for i, c in enumerate(columns) if row[f"n{i}"]]
    if gaps:
        middle = frame.df.agg(*[F.median(cells[c]).alias(f"m{i}") for i, c in enumerate(gaps)]).first()
        cells |= {c: F.coalesce(cells[c], F.lit(float(middle[f"m{i}"] or 0.0))) for i, c in enumerate(gaps)}
        row = stats()
    return {c: (x - F.lit(row[f"a{i}"])) / F.lit(row[f"s{i}"] if (row[f"s{i}"] or 0.0) > 0 else 1.0) for i, (c, x) in enumerate(cells.items())}


def _packed(k: int):
    """A row of bytes for each block: ids and vectors, first those that can be neighbours, by id.

    Of equal vectors the k + 1 smallest ids are enough on that side, as ties go to the smaller id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, flat = batch["rows"][i].values.flatten()
                ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
                vec = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, vec = ids[order], np.ascontiguousarray(vec[order])
                equal = np.unique(vec.view(f"V{max(1, vec.shape[1] * 8)}").ravel(), return_inverse=True)[1].ravel() if vec.size else np.zeros(len(ids), np.int64)
                order = np.argsort(equal, kind="stable")
                begin = np.searchsorted(equal[order], equal[order])
                spare = np.empty(len(ids), bool)
                spare[order] = np.arange(len(ids)) - begin > k
                order = np.argsort(spare, kind="stable")
                cells = [batch["split"][i].as_py()], [len(ids) - int(spare.sum())], [ids[order].tobytes()], [vec[order].tobytes()]
                types = pa.string(), pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], ["split", "first", "ids", "vecs"])

    return run


def _unpacked(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vecs, np.float64).reshape(len(ids), -1)


def _streamed(files: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Split, ids and vectors of the possible neighbours, block by block from the shared folder."""
    for name in files:
        system, path = fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=4):
                for row in batch.to_pylist():
                    ids, vec = _unpacked(row["ids"], row["vecs"])
                    yield row["split"], ids[: row["first"]], vec[: row["first"]]


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared distances less the first squared norm, that norm, and more than the error of their sum.

    One product of matrices; in single precision where no norm is near the ends of its range.
    """
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    most = float(aa.max() + bb.max())
    kind = np.float32 if 1e-20 < most < 1e30 else np.float64
    left, right = np.hstack((-2.0 * a, np.ones((len(a), 1)))).astype(kind), np.hstack((b, bb[:, None])).astype(kind)
    return left @ right.T, aa, 8.0 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * most


def _mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of the coordinates that differ, in the narrowest integers; what is missing differs from nothing."""
    dims = a.shape[1]
    for kind in (np.int8, np.int16, np.int32):
        most = np.iinfo(kind)
        if all(np.all((x >= most.min) & (x <= most.max) & (x == np.floor(x))) for x in (a, b)):
            a, b = a.astype(kind), b.astype(kind)
            break
    count = np.uint8 if dims < 256 else np.uint16 if dims < 65536 else np.uint32
    out, columns = np.zeros((len(a), len(b)), count), np.ascontiguousarray(b.T)
    step = max(1, (1 << 17) // max(1, len(b)))
    for at in range(0, len(a), step):
        part, differs = a[at : at + step], None
        for j in range(dims):
            differs = np.not_equal(part[:, j, None], columns[j][None, :], out=differs)
            if a.dtype == np.float64:
                differs &= (part[:, j, None] == part[:, j, None]) & (columns[j] == columns[j])[None, :]
            out[at : at + step] += differs.view(np.uint8)
    return out


def _offered(a: np.ndarray, b: np.ndarray, own: np.ndarray, worst: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and distances of all pairs that may beat worst, the k-th distance so far.

    own: each row's own place in b, or len(b).
    """
    here = np.flatnonzero(own < len(b))
    if metric == "euclidean":
        with np.errstate(over="ignore", invalid="ignore"):
            s, norm, error = _squares(a, b)
            s[here, own[here]] = np.inf
            limit = worst * worst * (1 + 1e-12) - norm + error
            if len(b) > k and np.isinf(worst).any():
                limit = np.minimum(limit, np.partition(s, k - 1, axis=1)[:, k - 1] + 2 * error)
            limit = np.nextafter(limit.astype(s.dtype), s.dtype.type(np.inf))
            near = s <= limit[:, None] if np.isfinite(error) else np.ones(s.shape, bool)
            i, j = np.divmod(np.flatnonzero(near), len(b))
            d = np.empty(len(i))
            for at in range(0, len(i), 32768):  # the distance itself, of few pairs
                gap = a[i[at : at + 32768]] - b[j[at : at + 32768]]
                d[at : at + 32768] = np.sqrt((gap * gap).sum(axis=1))
    else:
        s = _mismatches(a, b)
        limit = np.minimum(worst * a.shape[1] + 0.5, a.shape[1] + 0.5).astype(np.int64)
        if len(b) > k + 1 and np.isinf(worst).any():  # one more, as the own row may be among them
            limit = np.minimum(limit, np.partition(s, k, axis=1)[:, k])
        i, j = np.divmod(np.flatnonzero(s <= limit[:, None].astype(s.dtype)), len(b))
        d = s[i, j] / a.shape[1]
    keep = np.isfinite(d) & (j != own[i]) & (d <= worst[i])
    return i[keep], j[keep], d[keep]


def _nearest_in_blocks(files: list[str], k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "split", "nid", "nsplit", "dist", "rank"]
        for batch in batches:
            for row in batch.to_pylist():
                ids, a = _unpacked(row["ids"], row["vecs"])
                found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
                for split, other, b in _streamed(files):
                    dist, near = found.setdefault(split, (np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)))
                    own = np.searchsorted(other, ids)
                    own[other[np.minimum(own, len(other) - 1)] != ids] = len(other)
                    i, j, d = _offered(a, b, own, dist[:, -1], k, metric)
                    keep = (d < dist[i, -1]) | (other[j] < near[i, -1])  # ties: the smaller id
                    i, j, d = i[keep], j[keep], d[keep]
                    touched = np.unique(i)
                    at = np.concatenate((np.repeat(touched, k), i))
                    d, n = np.concatenate((dist[touched].ravel(), d)), np.concatenate((near[touched].ravel(), other[j]))
                    order = np.lexsort((n, d, at))
                    at, d, n = at[order], d[order], n[order]
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    best = place < k
                    dist[at[best], place[best]], near[at[best], place[best]] = d[best], n[best]
                for split, (dist, near) in found.items():
                    i, place = np.nonzero(np.isfinite(dist))
                    own, other = (pa.array([x] * len(i), pa.string()) for x in (row["split"], split))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), own, pa.array(near[i, place]), other, pa.array(dist[i, place]), pa.array(place + 1, pa.int32())], names)

    return run


def nearest(points: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """id, split, nid, nsplit, dist, rank: the k nearest of every point in each split, itself left out.

    Exact: points are packed in blocks of about `block` rows by the hash of their id and written to
    the shared folder once. A task holds one block and streams all others past it, keeping the k best
    of every point. Euclidean pairs are passed over by one product of matrices only where its
    error can't hide a neighbour; all others are decided on their differences. Work is the product of the
    sizes, as for any exact search; no pair of blocks is shuffled. The result is written too.
    """
    n = points.count()
    blocks = max(1, -(-n // block))
    rows = points.select("split", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    packed = rows.groupBy("split", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("rows")).select("split", "rows")
    packed = written(packed.mapInArrow(_packed(k), "split string, first long, ids binary, vecs binary"), "blocks")
    search = _nearest_in_blocks(sorted(packed.inputFiles()), k, metric)
    dealt = packed.repartition(2 * blocks)  # blocks, not rows
    return written(dealt.mapInArrow(search, "id long, split string, nid long, nsplit string, dist double, rank int"), "neighbours")


def effective_k(frame: SplitFrame, k: int) -> int:
    """At least one, and fewer than the rows of either split."""
    sizes = {r[SPLIT]: r["count"] for r in frame.df.groupBy(SPLIT).count().collect()}
    return max(1, min(k, sizes.get(TEST, 0) - 1, sizes.get(TRAIN, 0) - 1))


def distance_features(near: DataFrame, relative: bool = False) -> DataFrame:
    """id, split and the distances to the other split, to the own one, and to train."""
    cross = F.col("split") != F.col("nsplit")
    out = near.groupBy("id", "split").agg(
        F.avg(F.when(cross, F.col("dist"))).alias("mean_dist_to_other"),
        F.min(F.when(cross, F.col("dist"))).alias("min_dist_to_other"),
        F.avg(F.when(~cross, F.col("dist"))).alias("mean_dist_self_density"),
        F.min(F.when(F.col("nsplit") == TRAIN, F.col("dist"))).alias("nearest_train_dist"),
    )
    if not relative:
        return out
    r = F.col("mean_dist_to_other") / (F.col("mean_dist_self_density") + 1e-8)
    return out.select("id", "split", r.alias("rel_dist_to_other"), F.log1p(r).alias("log_rel_dist_to_other"), "mean_dist_self_density", "nearest_train_dist")


def nearest_test(frame: SplitFrame, k: int = 10, relative: bool = False, weighting: str = "none", return_as: str = "both") -> SplitFrame:
    """Distance features, and the weight 1 / (1 + distance) of train rows."""
    (key,) = frame.ids
    found = distance_features(nearest(space(frame, weighting=weighting), effective_k(frame, k)), relative)
    names = [c for c in found.columns if c not in ("id", "split")]
    df = frame.df.join(found.drop("split").withColumnRenamed("id", key), key, "left")
    if return_as in ("weight", "both"):
        far = "rel_dist_to_other" if relative else "mean_dist_to_other"
        df = df.withColumn(WEIGHT, F.when(F.col(SPLIT) == TRAIN, 1.0 / (1.0 + F.col(far))))
    return frame.adding(df, *(names if return_as != "weight" else []))


def augmented(
    frame: SplitFrame, k: int = 5, lam: float = 0.7, n_augments: int = 1, weight: float = 0.5, weighting: str = "none", per_feature: bool = False, by_distance: bool = False
) -> SplitFrame:
    """Train rows moved toward their nearest test rows, appended with their labels and provenance.

    Mixes imputed numerics; originals keep what is missing. per_feature raises the share of the
    own value where a column shifts little; by_distance lowers the weight of far moves.
    """
    (key,) = frame.ids
    columns = frame.spec.num
    n_test = frame.test.count()
    near = nearest(space(frame, weighting=weighting), min(k, n_test))
    pairs = near.where((F.col("split") == TRAIN) & (F.col("nsplit") == TEST) & (F.col("rank") <= min(n_augments, k)))
    clean = impute_median(frame).df
    own = clean.where(F.col(SPLIT) == TRAIN).select(F.col(key).alias("id"), TARGET, *[F.col(c).alias(f"__a_{c}") for c in columns])
    other = clean.where(F.col(SPLIT) == TEST).select(F.col(key).alias("nid"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    share = dict.fromkeys(columns, lam)
    if per_feature:
        shift = {r["column"]: float(r["ks"]) for r in ks(impute_median(frame)).collect()}
        share = {c: lam + (1 - lam) * (1 - shift.get(c, 0.0)) for c in columns}
    moved = pairs.join(own, "id").join(other, "nid")
    mixed = [(F.lit(share[c]) * F.col(f"__a_{c}") + F.lit(1 - share[c]) * F.col(f"__b_{c}")).alias(c) for c in columns]
    far = F.lit(weight) / (1 + F.col("dist")) if by_distance else F.lit(weight)
    rest = [c for c in frame.df.columns if c not in (key, SPLIT, TARGET, *columns)]
    source = frame.train.select(F.col(key).alias("id"), *rest) if rest else None
    moved = moved.join(source, "id") if rest else moved
    # a new row's key is its source's; provenance tells them apart
    new = moved.select(
        F.col("id").alias(key), F.lit(TRAIN).alias(SPLIT), TARGET, *mixed, *rest, far.alias(WEIGHT), F.lit(TRAIN).alias(SRC_SPLIT), F.col("id").alias(SRC_ID), F.lit("tdda_augment").alias(ROLE)
    )
    old = frame.df.withColumns(
        {WEIGHT: F.when(F.col(SPLIT) == TRAIN, 1.0), SRC_SPLIT: F.col(SPLIT), SRC_ID: F.col(key), ROLE: F.lit("original")}
    )
    return frame.adding(old.unionByName(new))


def consensus(points: DataFrame, scores: DataFrame, k: int, weighting: str = "distance", classify: bool = True) -> DataFrame:
    """Agreement of a score with the scores of the nearest rows of the same split.

    points: id, split, vec. scores: id, score. A split of one row gets zeros.
    """
    near = nearest(points, k).where(F.col("split") == F.col("nsplit"))
    raw = 1.0 / F.greatest(F.col("dist"), F.lit(1e-4)) if weighting == "distance" else F.lit(1.0)
    own = scores.select("id", F.col("score").alias("own"))
    other = scores.select(F.col("id").alias("nid"), F.col("score").alias("theirs"))
    joined = near.withColumn("w", raw).join(own, "id").join(other, "nid")
    means = joined.groupBy("id", "split").agg(
        F.first("own").alias("own"),
        (F.sum(F.col("w") * F.col("theirs")) / F.sum("w")).alias("mean"),
        (F.sum(F.col("w") * F.col("theirs") * F.col("theirs")) / F.sum("w")).alias("square"),
        F.avg(((F.col("theirs") >= 0.5) == (F.col("own") >= 0.5)).cast("double")).alias("agree"),
    )
    out = means.select(
        "id",
        "split",
        F.col("own").alias("nbr_consensus_self"),
        F.col("mean").alias("nbr_consensus_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("nbr_consensus_std"),
        (F.col("own") - F.col("mean")).alias("nbr_consensus_diff"),
        *([F.col("agree").alias("nbr_consensus_agree")] if classify else []),
    )
    names = [c for c in out.columns if c not in ("id", "split")]
    every = points.select("id", "split").join(out.drop("split"), "id", "left")
    return every.select("id", "split", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def leaf_distance(leaves: DataFrame, k: int) -> DataFrame:
    """Hamming distances of leaf vectors to the other split, and the share of near rows from it.

    leaves: id, split, vec (leaf ids as numbers).
    """
    near = nearest(leaves, k, "hamming")
    cross = F.col("split") != F.col("nsplit")
    far = near.where(cross).groupBy("id", "split").agg(F.avg("dist").alias("leaf_hamming_dist_to_other"))
    every = near.withColumn("all_rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nid"))).where(F.col("all_rank") <= k)
    share = every.groupBy("id").agg(F.avg(cross.cast("double")).alias("leaf_cross_split_frac"))
    return far.join(share, "id")


def row_fold(ids: tuple[str, ...], folds: int) -> Column:
    """A deterministic fold of every row."""
    return F.pmod(F.xxhash64(*ids), F.lit(folds)).cast("int")
