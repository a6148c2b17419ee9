"""What the jobs share: reading a configuration through Spark, logging, and a session for the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import fields
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from veritide.shipping import ship


def read_config(spark: SparkSession, path: str | None, kind: type) -> Any:
    """The dataclass kind with the values of a JSON object at path; without a path its defaults. An unknown name is an error."""
    if path is None:
        return kind()
    values = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or an empty one of the schema before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command(about: str, paths: list[str], config: type, run: Callable[..., Any]) -> None:
    """Parses --config and one option a path, starts a session, runs, and stops the session."""
    parser = argparse.ArgumentParser(description=about, allow_abbrev=False)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark and all its executors can open")
    parser.add_argument("--config", help="a JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(":")[0]).getOrCreate()
    try:
        run(ship(spark), *[getattr(args, name) for name in paths], read_config(spark, args.config, config))
    finally:
        spark.stop()
