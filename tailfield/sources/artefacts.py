"""Stored artefacts that are reused only while their inputs and parameters are unchanged."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailfield.sources.tables import path_exists

FORMAT_VERSION = 1


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Path, size and modification time of every input file, folded into one value; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    row = files.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h"),
    ).first()
    return f"{row['n']}:{row['h']}"


def signature(spark: SparkSession, inputs: list[str], params: dict) -> str:
    body = {"inputs": input_fingerprint(spark, inputs), "params": params, "version": FORMAT_VERSION}
    return hashlib.md5(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


def stored_table(
    spark: SparkSession, root: str, inputs: list[str], params: dict, build: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """The table for this signature and whether it was reused.

    Each signature has its own folder and counts as present once its job has committed,
    so a failed or concurrent build never leaves a table that looks valid.
    """
    path = f"{root.rstrip('/')}/{signature(spark, inputs, params)}"
    reused = path_exists(spark, f"{path}/_SUCCESS")
    if not reused:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), reused


def stored_model(
    spark: SparkSession, root: str, inputs: list[str], params: dict, required: list[str],
    fit: Callable[[], tuple[PipelineModel, dict]],
) -> tuple[PipelineModel, dict, bool]:
    """A fitted pipeline and its facts; refitted when the signature or a required fact is absent."""
    path = f"{root.rstrip('/')}/{signature(spark, inputs, params)}"
    if path_exists(spark, f"{path}/facts/_SUCCESS"):
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        if set(required) <= set(facts):
            return PipelineModel.load(f"{path}/model"), facts, True
    model, facts = fit()
    lacking = set(required) - set(facts)
    if lacking:
        raise ValueError(f"fit did not report {sorted(lacking)}")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/facts"
    )
    return model, facts, False
