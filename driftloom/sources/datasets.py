"""Dataset folders, fold tables, raw formats, and the named datasets."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TEST, TRAIN, ContractError, FeatureSpec, SplitFrame, bind
from driftloom.operators.etl import exact_sample, first_by

#: The target and time columns of a dataset folder.
FOLDER_TARGET, FOLDER_TIME = "__target__", "__time__"


@dataclass(frozen=True)
class Dataset:
    """A frame of both splits and the description it came with."""

    name: str
    frame: SplitFrame
    meta: dict


def find_root(given: str | None = None, variable: str = "DATASET_ROOT", places: tuple[str, ...] = ("data/datasets",)) -> str:
    """An argument, the environment, or the first place that exists."""
    for root in (given, os.environ.get(variable), *places):
        if root and ("://" in root or os.path.isdir(root)):
            return root
    raise FileNotFoundError(f"no dataset root; give one or set {variable}")


def read_meta(spark: SparkSession, folder: str) -> dict:
    """meta.json of a folder, read where Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/meta.json", wholetext=True).collect()))


def check_meta(train: DataFrame, test: DataFrame, meta: dict) -> None:
    """Same columns in the same order; the declared lists partition them; regressions have a real target."""
    if train.columns != test.columns:
        raise ContractError("train and test have different columns")
    declared = [*meta["cat_features"], *meta["num_features"]]
    features = [c for c in train.columns if c not in (FOLDER_TARGET, meta.get("time_col", FOLDER_TIME), FOLDER_TIME)]
    if len(declared) != len(set(declared)) or sorted(declared) != sorted(features):
        raise ContractError("the declared features do not partition the columns")
    if meta["task_type"] == "regression":
        kind = dict(train.dtypes)[FOLDER_TARGET]
        if kind == "boolean" or train.agg(F.count_distinct(FOLDER_TARGET)).first()[0] <= 2:
            raise ContractError("a regression needs more than two target values")


def _numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A stable id from the content; repeated rows get their place among their equals."""
    from pyspark.sql import Window

    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.withColumn("__h", h).withColumn(name, F.xxhash64("__h", F.row_number().over(Window.partitionBy("__h").orderBy(F.lit(0))))).drop("__h")


def load_folder(spark: SparkSession, folder: str, name: str | None = None, max_rows: int | None = None, seed: int = 0) -> Dataset:
    """train.parquet, test.parquet and meta.json as one frame; at most max_rows of each split."""
    meta = read_meta(spark, folder)
    parts = {s: spark.read.parquet(f"{folder}/{s}.parquet") for s in (TRAIN, TEST)}
    check_meta(parts[TRAIN], parts[TEST], meta)
    time = meta.get("time_col") or (FOLDER_TIME if FOLDER_TIME in parts[TRAIN].columns else None)
    rows = None
    for split, df in parts.items():
        df = _numbered(df)
        df = exact_sample(df, max_rows, ["row_id"], seed) if max_rows else df
        df = df.withColumn("__side", F.lit(split))
        rows = df if rows is None else rows.unionByName(df)
    spec = FeatureSpec(tuple(meta["cat_features"]), tuple(meta["num_features"]), meta["task_type"], time)
    return Dataset(name or meta["name"], bind(rows, ["row_id"], spec, F.col("__side") == TRAIN, F.col(FOLDER_TARGET)), meta)


def fold_rows(data: DataFrame, folds: DataFrame, fold: int, key: str = "row_id") -> DataFrame:
    """The rows of a fold with their split; folds has fold, key, split. Ids that data lacks are an error."""
    own = folds.where(F.col("fold") == fold).select(key, F.col("split").alias(SPLIT))
    if own.join(data, key, "left_anti").head(1):
        raise ContractError("a fold names rows that do not exist")
    return data.join(own, key)


def fold_table(spark: SparkSession, path: str) -> DataFrame:
    """fold, row_id, split from an archive of index arrays train_idx_i and test_idx_i on the driver."""
    import numpy as np

    with np.load(path) as arrays:
        rows = [(int(k.rsplit("_", 1)[1]), int(i), k.split("_")[0]) for k in arrays.files for i in arrays[k]]
    return spark.createDataFrame(rows, "fold int, row_id long, split string")


def write_folder(frame_rows: DataFrame, folder: str, meta: dict, time: str | None = FOLDER_TIME) -> None:
    """train.parquet, test.parquet and meta.json; refuses an empty split, no target, or train after test."""
    if FOLDER_TARGET not in frame_rows.columns or (time and time not in frame_rows.columns):
        raise ContractError("the target or the time is missing")
    cells = [F.count(F.when(F.col(SPLIT) == s, 1)).alias(s) for s in (TRAIN, TEST)]
    if time:
        cells += [F.max(F.when(F.col(SPLIT) == TRAIN, F.col(time))).alias("last"), F.min(F.when(F.col(SPLIT) == TEST, F.col(time))).alias("first")]
    r = frame_rows.agg(*cells).first()
    if not r[TRAIN] or not r[TEST]:
        raise ContractError("a split is empty")
    if time and r["last"] >= r["first"]:
        raise ContractError("train reaches into the time of test")
    for s in (TRAIN, TEST):
        frame_rows.where(F.col(SPLIT) == s).drop(SPLIT).write.parquet(f"{folder}/{s}.parquet")
    text = json.dumps(meta | {"n_train": r[TRAIN], "n_test": r[TEST]})
    frame_rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/meta.json")


# -- raw formats ------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, null: str | None = None, schema: str | None = None) -> DataFrame:
    """CSV, gzipped or not, with the wanted columns alone."""
    reader = spark.read.option("header", True)
    reader = reader.option("nullValue", null) if null is not None else reader
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """All parquet files of a pattern, columns by name, missing ones null."""
    return spark.read.option("mergeSchema", True).parquet(pattern)


def read_sparse(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Lines `class idx:val ...` or `class;concentration idx:val ...`, indices from 1, as dense columns."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    head = F.split(F.trim("value"), r"\s+")[0]
    pairs = F.regexp_extract_all("value", F.lit(r"(\d+):"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(r"\d+:(\S+)"), F.lit(1))
    cells = F.map_from_arrays(F.transform(pairs, lambda x: x.cast("int")), F.transform(values, lambda x: x.cast("double")))
    out = lines.select(F.split(head, ";")[0].cast("int").alias("label"), F.try_element_at(F.split(head, ";"), F.lit(2)).cast("double").alias("concentration"), cells.alias("m"))
    return out.select("label", "concentration", *[F.try_element_at("m", F.lit(i + 1)).alias(f"f{i}") for i in range(dims)])


def read_excel(spark: SparkSession, path: str, **options) -> DataFrame:
    """A small workbook through pandas on the driver (needs its reader)."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, **options))


def read_xpt(spark: SparkSession, path: str) -> DataFrame:
    """A SAS transport file through pandas on the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.read_sas(path, format="xport"))


def parquet_shape(path: str) -> tuple[int, int]:
    """Rows and columns from the footers alone."""
    import pyarrow.dataset as ds

    data = ds.dataset(path)
    return data.count_rows(), len(data.schema.names)


def read_zipped_csv(spark: SparkSession, path: str, member: str, null: str = "NA", columns: list[str] | None = None) -> DataFrame:
    """One CSV of a ZIP archive. An archive can't be split: one task unpacks it, and the rows are dealt out."""
    import io
    import zipfile

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive, archive.open(member) as text:
                    held = []
                    for line in io.TextIOWrapper(text, encoding="utf-8"):
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")
    head = rows.first()["value"].split(",")
    cells = F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in head)), {"nullValue": null})
    out = rows.where(F.col("value") != ",".join(head)).select(cells.alias("r")).select("r.*").repartition(spark.sparkContext.defaultParallelism)
    return out.select(*columns) if columns else out


def unpack_archive(spark: SparkSession, path: str, target: str, pattern: str = "") -> DataFrame:
    """member, n_bytes of every file of TAR or ZIP archives, written below target by the tasks that read them."""

    def unpack(batches):
        import io
        import os
        import tarfile
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            names, sizes = [], []
            for content in batch["content"]:
                data = io.BytesIO(content.as_py())
                if zipfile.is_zipfile(data):
                    archive = zipfile.ZipFile(data)
                    files = [(n, archive.read(n)) for n in archive.namelist() if not n.endswith("/")]
                else:
                    data.seek(0)
                    archive = tarfile.open(fileobj=data)
                    files = [(m.name, archive.extractfile(m).read()) for m in archive.getmembers() if m.isfile()]
                for name, inner in files:
                    safe = os.path.normpath(name)
                    if pattern not in name or safe.startswith(("..", "/")):  # nothing is written outside the target
                        continue
                    system.create_dir(os.path.dirname(f"{root}/{safe}"), recursive=True)
                    with system.open_output_stream(f"{root}/{safe}") as out:
                        out.write(inner)
                    names.append(safe)
                    sizes.append(len(inner))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["member", "n_bytes"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "member string, n_bytes long")


def streamed_sample(rows: DataFrame, ids: list[str], fraction: float, keep: Column | None = None, seed: int = 0) -> DataFrame:
    """Rows that satisfy keep, each with the probability `fraction` by a hash of its ids; nothing is collected."""
    rows = rows if keep is None else rows.where(keep)
    return rows.where((F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)) < fraction)


def stratified_split(rows: DataFrame, target: str, ids: list[str], test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """SPLIT for every row: of each target value the nearest whole number to the share tests.

    Rows are ranked by a hash inside cells of a target value, so one frequent value is not one task.
    """
    from pyspark.sql import Window

    h = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 20))
    keyed = rows.withColumn("__h", h)
    counts = keyed.groupBy(target, "__h").agg(F.count(F.lit(1)).alias("__n"))
    from driftloom.operators.running import running

    counts = counts.withColumn("__t", F.coalesce(F.col(target).cast("string"), F.lit("\0")))
    summed = running(counts, ["__t"], "__h", ["__n"]).select("__t", "__h", F.col("before___n").alias("__b"), F.col("all___n").alias("__all"))
    own = F.row_number().over(Window.partitionBy("__t", "__h").orderBy(*ids))
    placed = keyed.withColumn("__t", F.coalesce(F.col(target).cast("string"), F.lit("\0"))).join(summed, ["__t", "__h"])
    test = F.col("__b") + own <= F.round(F.col("__all") * test_share)
    return placed.withColumn(SPLIT, F.when(test, TEST).otherwise(TRAIN)).select(*rows.columns, SPLIT)


# -- named datasets: how each splits its rows ----------------------------------------------------------


def bike_sharing(rows: DataFrame) -> SplitFrame:
    """The first year trains, the second tests."""
    cat = ("season", "holiday", "weekday", "workingday", "weathersit", "mnth", "hr")
    num = ("temp", "atemp", "hum", "windspeed")
    return bind(rows, ["instant"], FeatureSpec(cat, num, "regression"), F.col("yr") == 0, F.col("cnt"))


def diabetes_hospital(rows: DataFrame, cat: tuple[str, ...], num: tuple[str, ...], emergency: tuple[int, ...] = (1, 2, 3, 7)) -> SplitFrame:
    """The first stay of each patient; emergency admissions train, the others test."""
    first = first_by(rows, ["patient_nbr"], ["encounter_id"])
    for c in ("diag_1", "diag_2", "diag_3"):
        first = first.withColumn(c, icd9_group(F.col(c))) if c in first.columns else first
    return bind(first, ["encounter_id"], FeatureSpec(cat, num), F.col("admission_type_id").isin(*emergency), (F.col("readmitted") == "<30").cast("double"))


def icd9_group(code: Column) -> Column:
    """Chapters of the ICD-9 by their fixed ranges; V and E codes, and unknown ones, have groups of their own."""
    n = F.regexp_replace(code, "[EV]", "").try_cast("double")
    within = lambda a, b: (n >= a) & (n <= b)
    return (
        F.when(code.isNull() | (code == "?"), "unknown")
        .when(n.isNull(), "other")
        .when(code.startswith("V"), "supplementary")
        .when(code.startswith("E"), "external_causes")
        .when(within(390, 459) | (n == 785), "circulatory")
        .when(within(460, 519) | (n == 786), "respiratory")
        .when(within(520, 579) | (n == 787), "digestive")
        .when((n >= 250) & (n < 251), "diabetes")
        .when(within(800, 999), "injury")
        .when(within(710, 739), "musculoskeletal")
        .when(within(580, 629) | (n == 788), "genitourinary")
        .when(within(140, 239), "neoplasms")
        .otherwise("other")
    )


def lending_club(rows: DataFrame, cat: tuple[str, ...], num: tuple[str, ...]) -> SplitFrame:
    """Loans that ended, 2007 to 2014 against 2015 to 2018; the target is default."""
    bad = ("Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off")
    good = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
    year = F.year(F.to_date("issue_d", "MMM-yyyy"))
    ended = rows.where(F.col("loan_status").isin(*bad, *good)).withColumn("issue_year", year).where("issue_year between 2007 and 2018")
    for c in ("int_rate", "revol_util"):
        ended = ended.withColumn(c, F.regexp_replace(c, "%", "").try_cast("double")) if dict(ended.dtypes).get(c) == "string" else ended
    if dict(ended.dtypes).get("term") == "string":
        ended = ended.withColumn("term", F.regexp_extract("term", r"(\d+)", 1).try_cast("double"))
    return bind(ended, ["id"], FeatureSpec(cat, num), F.col("issue_year") <= 2014, F.col("loan_status").isin(*bad).cast("double"))


def state_column(rows: DataFrame) -> DataFrame:
    """Census files from 2019 on name the state otherwise."""
    return rows.withColumnRenamed("STATE", "ST") if "STATE" in rows.columns and "ST" not in rows.columns else rows


def brfss(rows: DataFrame, regions: dict[int, str], target: str, positive: list[int], negative: list[int], cat: tuple[str, ...], num: tuple[str, ...], train: tuple[str, ...], ids: list[str]) -> SplitFrame:
    """Survey rows by census region: regions maps state codes, other states and other answers go.

    Targets _RFHYPE count 2 as yes and 1 as no. Numbers 77 and 99 stand for no answer, 88 for none.
    """
    if target.startswith("_RFHYPE"):
        positive, negative = [2], [1]
    where = F.element_at(F.create_map(*[F.lit(x) for kv in regions.items() for x in kv]), F.col("_STATE").cast("int"))
    kept = rows.withColumn("region", where).where(F.col("region").isNotNull() & F.col(target).isin(*positive, *negative))
    kept = kept.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).cast("string") for c in cat})
    kept = kept.withColumns({c: F.when(F.col(c).isin(77, 99), None).when(F.col(c) == 88, 0.0).otherwise(F.col(c).cast("double")) for c in num})
    return bind(kept, ids, FeatureSpec(cat, num), F.col("region").isin(*train), F.col(target).isin(*positive).cast("double"))


def load(spark: SparkSession, name: str, root: str | None = None, **options) -> SplitFrame:
    """The frame of a named dataset: generated ones by name, others from their folder below the root."""
    if name == "synthetic":
        return synthetic(spark, **options)
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; there are {sorted(DATASETS)}")
    return load_folder(spark, f"{find_root(root)}/{name}", name, **options).frame


def by_state(rows: DataFrame, state: str, train: tuple[str, ...], spec: FeatureSpec, ids: list[str], target: str) -> SplitFrame:
    """Census-like tables: some states train, the others test."""
    return bind(rows, ids, spec, F.col(state).isin(*train), F.col(target).cast("double"))


def by_file(train: DataFrame, test: DataFrame, spec: FeatureSpec, ids: list[str], target: str) -> SplitFrame:
    """Tables whose splits come as files."""
    rows = train.withColumn("__side", F.lit(TRAIN)).unionByName(test.withColumn("__side", F.lit(TEST)), allowMissingColumns=True)
    return bind(rows, ids, spec, F.col("__side") == TRAIN, F.col(target).cast("double"))


def by_batch(rows: DataFrame, batch: str, last: int, spec: FeatureSpec, ids: list[str], target: str) -> SplitFrame:
    """Sensor batches: the early ones train."""
    return bind(rows, ids, spec, F.col(batch) <= last, F.col(target).cast("double"))


# Fixed values of the synthetic census: shares without a shift, what one unit of shift adds, and
# the least share before the shares are scaled to one.
_SHARES = {
    "SCHL": ([0.02, 0.02, 0.03, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10, 0.10, 0.09, 0.08, 0.07, 0.07], [-0.01 + 0.02 * i / 15 for i in range(16)], 0.005),
    "OCCP": ([0.18, 0.15, 0.15, 0.20, 0.17, 0.15], [0.02, -0.01, 0.04, -0.02, -0.03, 0.00], 0.02),
    "MAR": ([0.45, 0.30, 0.15, 0.10], [-0.03, 0.03, 0.01, -0.01], 0.02),
    "ST": ([0.25, 0.20, 0.20, 0.18, 0.17], [-0.01, 0.03, -0.02, 0.02, -0.02], 0.02),
}
_LEVELS = {
    "SCHL": [float(i) for i in range(1, 17)],
    "OCCP": ["mgmt", "sales", "tech", "service", "labor", "office"],
    "MAR": ["married", "single", "divorced", "widowed"],
    "ST": ["CA", "TX", "NY", "FL", "IL"],
}
_OCCP_SCORE = {"mgmt": 1.5, "tech": 1.2, "office": 0.3, "sales": 0.5, "service": -0.5, "labor": -0.3}
_MAR_SCORE = {"married": 0.5, "single": -0.2, "divorced": -0.1, "widowed": -0.3}
_PARTIAL = ("AGEP", "SCHL", "OCCP")


def _cumulative(column: str, strength: float) -> list[float]:
    base, tilt, least = _SHARES[column]
    share = [max(b + t * strength, least) for b, t in zip(base, tilt, strict=True)]
    return [sum(share[: i + 1]) / sum(share) for i in range(len(share))]


def synthetic(spark: SparkSession, n_train: int, n_test: int, strength: float = 1.0, mode: str = "full", prevalence: float = 0.65, seed: int = 42) -> SplitFrame:
    """A census-like table whose test split is shifted by strength.

    `partial` shifts three columns; `label_shift` keeps what columns are like given the label, and
    the share of positive labels in test is the prevalence.
    """
    if mode not in ("full", "partial", "label_shift"):
        raise ValueError(f"unknown mode {mode!r}")
    u = lambda k: (F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(u(k))) * F.cos(2 * 3.141592653589793 * u(k + 100))
    by = lambda c: 0.0 if mode == "label_shift" or (mode == "partial" and c not in _PARTIAL) else float(strength)
    in_test = F.col("row_id") >= n_train
    s = lambda c: F.when(in_test, by(c)).otherwise(0.0)

    def pick(k: int, column: str) -> Column:
        """The level whose stretch of the shares holds the draw."""

        def drawn(strength: float) -> Column:
            out = F.lit(_LEVELS[column][-1])
            for name, upper in reversed(list(zip(_LEVELS[column], _cumulative(column, strength), strict=True))[:-1]):
                out = F.when(u(k) < upper, F.lit(name)).otherwise(out)
            return out

        return F.when(in_test, drawn(by(column))).otherwise(drawn(0.0))

    clip = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    # with a label shift, test rows are taken from enough draws of both labels
    draws = n_test * (2 + int(4 * max(prevalence, 1 - prevalence))) if mode == "label_shift" else n_test
    rows = spark.range(n_train + draws).withColumnRenamed("id", "row_id").select(
        "row_id",
        clip(40 + 2 * s("AGEP") + 12 * normal(1), 16.0, 90.0).alias("AGEP"),
        pick(2, "SCHL").alias("SCHL"),
        clip(40 + 1.5 * s("WKHP") + 10 * normal(3), 1.0, 80.0).alias("WKHP"),
        pick(4, "OCCP").alias("OCCP"),
        pick(5, "MAR").alias("MAR"),
        pick(6, "ST").alias("ST"),
        clip(-(500 + 200 * s("CAPITALGAIN")) * F.ln(u(7)), 0.0, 1e5).alias("CAPITALGAIN"),
        clip(-(50 + 20 * s("CAPITALLOSS")) * F.ln(u(8)), 0.0, 5e3).alias("CAPITALLOSS"),
    )
    looked = lambda c, scores: F.element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), F.col(c))
    score = 0.03 * F.col("AGEP") + 0.15 * F.col("SCHL") + 0.02 * F.col("WKHP") + 0.0002 * F.col("CAPITALGAIN") - 0.0003 * F.col("CAPITALLOSS")
    score = score + looked("OCCP", _OCCP_SCORE) + looked("MAR", _MAR_SCORE) - 4.5
    rows = rows.withColumn("label", (u(9) < 1 / (1 + F.exp(-score))).cast("double"))
    if mode == "label_shift":
        positive = int(n_test * prevalence)
        later = lambda y, n: rows.where(in_test & (F.col("label") == y)).orderBy("row_id").limit(n)
        rows = rows.where(~in_test).unionByName(later(1.0, positive)).unionByName(later(0.0, n_test - positive))
    spec = FeatureSpec(("OCCP", "MAR", "ST"), ("AGEP", "SCHL", "WKHP", "CAPITALGAIN", "CAPITALLOSS"))
    return bind(rows, ["row_id"], spec, F.col("row_id") < n_train, F.col("label"))


_TABRED = ("sberbank", "homesite", "ecom_offers", "homecredit", "cooking_time", "delivery_eta", "maps_routing", "weather")
#: Dataset names with what makes their frames; folders for those that come prepared.
DATASETS: dict[str, Callable] = (
    {"synthetic": synthetic, "bike_sharing": bike_sharing, "diabetes_hospital": diabetes_hospital, "lending_club": lending_club, "gas_sensor_drift": by_batch, "brfss_diabetes": by_state, "shifts_weather": by_file}
    | {f"folktables_{t}": by_state for t in ("income", "coverage", "employment", "travel_time", "mobility")}
    | {f"tschalzev_{t}": load_folder for t in ("mbgm", "aeac", "ogpcc", "sctp")}
    | {f"tabred_{t}": load_folder for t in _TABRED}
)
