"""Bookkeeping of runs: what is pending, what is done, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Errors that begin so are skips that a retry would repeat.
SKIPS = ("joint_tsne_skip:", "pseudo_label_skip:", "tabpfn_skip:", "tabicl_skip:")
KEY = ["dataset", "method", "model", "seed", "fold"]


def manifest(datasets: DataFrame, methods: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """One task for each combination of small lists; folds come with the datasets (dataset, folds, cost)."""
    folds = datasets.select("dataset", "cost", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fold"))
    return folds.crossJoin(methods).crossJoin(models).crossJoin(seeds)


def settled(results: DataFrame) -> DataFrame:
    """Results that need no retry: without an error, or a deterministic skip."""
    skip = F.lit(False)
    for prefix in SKIPS:
        skip = skip | F.col("error").startswith(prefix)
    return results.where(F.col("error").isNull() | skip)


def pending(tasks: DataFrame, results: DataFrame, key: list[str] | None = None) -> DataFrame:
    return tasks.join(settled(results), key or KEY, "left_anti")


def collected(tasks: DataFrame, parts: list[DataFrame], key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All results by name, and the tasks that lack one."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged, tasks.join(merged, key or KEY, "left_anti")


def same_runs(a: DataFrame, b: DataFrame, key: list[str] | None = None) -> bool:
    """Whether two tables hold the same runs, as often."""
    key = key or KEY
    return not a.select(key).exceptAll(b.select(key)).head(1) and not b.select(key).exceptAll(a.select(key)).head(1)


def flat_record(record: dict, metadata: dict, reserved: set[str]) -> dict:
    """A result row: metadata under meta_, long lists left out, reserved names untouched."""
    kept = {k: v for k, v in metadata.items() if not (isinstance(v, (list, tuple, dict)) and len(v) > 10)}
    return record | {f"meta_{k}" if k in reserved or not k.startswith("meta_") else k: v for k, v in kept.items()}


def costly_first(tasks: DataFrame) -> DataFrame:
    """Tasks in the order in which they should start: the costly ones first, then by key."""
    return tasks.orderBy(F.col("cost").desc(), *KEY)


def write_sweep(results: DataFrame, folder: str) -> None:
    """All results of a sweep as CSV with a header, in the order of their keys."""
    results.orderBy(*[k for k in KEY if k in results.columns]).write.option("header", True).csv(folder)


def summary(datasets: dict, diagnose) -> list[dict]:
    """A row for each dataset: what diagnose(frame) gives, or the error that it raised; one bad dataset stops no other."""
    out = []
    for name, frame in datasets.items():
        try:
            out.append({"dataset": name, "error": None} | diagnose(frame() if callable(frame) else frame))
        except Exception as error:  # reported beside the others
            out.append({"dataset": name, "error": f"{type(error).__name__}: {error}"})
    return out


def chains(draws: list[dict], methods: dict) -> dict:
    """A pipeline for each draw {"name", "steps"}; a step that no method has is an error."""
    from driftloom.operators.compose import pipeline

    unknown = sorted({s for d in draws for s in d["steps"]} - set(methods))
    if unknown:
        raise KeyError(f"unknown steps: {unknown}")
    return {d["name"]: pipeline(*[methods[s] for s in d["steps"]]) for d in draws}
