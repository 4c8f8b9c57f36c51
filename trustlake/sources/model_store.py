"""Fitted calibrators on shared storage: written whole, checked, and published by one mark.

A version is a folder with the ``pyspark.ml`` model, a manifest (inputs in order, base rate, runtime, number of rows) and,
last, the mark. The mark is made by renaming a finished file, so a reader sees all of a version or nothing, and it
carries the digest of the manifest, so a version whose manifest was changed or cut off is refused. A version is
immutable: publishing it again is an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, SparkSession

from trustlake.operators.models import Calibrator, score_column
from trustlake.sources.tables import file_system

MARK, MANIFEST, MODEL = "_PUBLISHED", "manifest.json", "model"


class RefusedModel(Exception):
    """A version that must not score, with the reason."""


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target, _ = file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, target, jvm = file_system(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folder(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/version={version}"


def publish(
    spark: SparkSession, root: str, version: str, calibrator: Calibrator, inputs: Sequence[str], runtime_version: str
) -> None:
    """Write a version and publish it. ``inputs`` names the numbers of the vector in order.

    What a broken-off attempt has left is written anew.
    """
    path = folder(root, version)
    fs, mark, jvm = file_system(spark, f"{path}/{MARK}")
    if fs.exists(mark):
        raise FileExistsError(f"version {version} is published already")
    if calibrator.model is not None:
        calibrator.model.write().overwrite().save(f"{path}/{MODEL}")
    manifest = json.dumps(
        {
            "version": version,
            "inputs": list(inputs),
            "base_rate": calibrator.base_rate,
            "n": calibrator.n,
            "runtime_version": runtime_version,
            "has_model": calibrator.model is not None,
        },
        sort_keys=True,
    )
    _write_text(spark, f"{path}/{MANIFEST}", manifest)
    finished = f"{path}/_publishing-{uuid.uuid4().hex}"
    _write_text(spark, finished, hashlib.sha256(manifest.encode()).hexdigest())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(finished), mark):
        raise FileExistsError(f"version {version} was published by another writer")


def load(spark: SparkSession, root: str, version: str, inputs: Sequence[str], runtime_version: str) -> Calibrator:
    """A published version, if it takes exactly ``inputs`` and runs on this runtime; otherwise ``RefusedModel``."""
    path = folder(root, version)
    mark, manifest = _read_text(spark, f"{path}/{MARK}"), _read_text(spark, f"{path}/{MANIFEST}")
    if mark is None or manifest is None:
        raise RefusedModel("not published")
    if hashlib.sha256(manifest.encode()).hexdigest() != mark:
        raise RefusedModel("manifest does not match its mark")
    said = json.loads(manifest)
    if said["runtime_version"] != runtime_version:
        raise RefusedModel(f"made for runtime {said['runtime_version']}")
    if said["inputs"] != list(inputs):
        raise RefusedModel("other inputs")
    if not said["has_model"]:
        return Calibrator(None, said["base_rate"], said["n"])
    model = LogisticRegressionModel.load(f"{path}/{MODEL}")
    if model.numFeatures != len(inputs):
        raise RefusedModel(f"{model.numFeatures} coefficients for {len(inputs)} inputs")
    return Calibrator(model, said["base_rate"], said["n"])


def scorer(
    spark: SparkSession, root: str, inputs: dict[str, Column], runtime_version: str
) -> Callable[[str], Column]:
    """What the live gate loads a version with: a version -> the column that scores with it."""

    def column(version: str) -> Column:
        return score_column(load(spark, root, version, list(inputs), runtime_version), list(inputs.values()))

    return column
