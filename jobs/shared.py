"""What the jobs share: settings files, logs, and the output as it stands."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def settings_of(kind: type[T], path: str | None) -> T:
    """``kind`` with the values of a JSON file; a name that it does not have is an error."""
    if path is None:
        return kind()
    with open(path) as f:
        given = json.load(f)
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**given)


def as_it_stands(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows written so far below ``path``; none where nothing was."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def command(name: str, kind: type[T], paths: dict[str, str], job: Callable, args: list[str] | None = None, **more: dict) -> None:
    """The command line of a job: one option for each path, ``--config``, and ``more``. It alone makes and stops a session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    for option, text in paths.items():
        parser.add_argument(f"--{option}", required=True, help=text)
    parser.add_argument("--config", help="settings, a JSON file")
    for option, how in more.items():
        parser.add_argument(f"--{option}", **how)
    given = vars(parser.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = settings_of(kind, given.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, settings=settings, **given)
    finally:
        spark.stop()
