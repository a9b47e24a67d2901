"""The command line that both jobs share: a config file, values of it given anew, and a session that ends with the job."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def load_config(name: str, **given: str | None) -> dict:
    """The job's own config file (or the one given as `config`), with what is given and not None in place of its values."""
    with open(given.pop("config", None) or os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        config = json.load(f)
    unknown = set(given) - set(config)
    if unknown:
        raise ValueError(f"{name} has no setting {', '.join(sorted(unknown))}")
    return config | {k: v for k, v in given.items() if v is not None}


def exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, or None where there is none yet. Other failures of the read are raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def command(name: str, run: Callable[[SparkSession, dict], dict], doc: str | None) -> int:
    """Reads arguments, makes the session, runs the job, logs its counts."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    parser.add_argument("--config", help="a JSON file like the one beside this job")
    settings = load_config(name)
    for key, value in settings.items():
        parser.add_argument(f"--{key}", type=type(value) if isinstance(value, (int, float)) else str, help=f"in place of {value!r}")
    config = load_config(name, **vars(parser.parse_args()))
    missing = [k for k in ("input", "output") if not config[k]]
    if missing:
        parser.error(f"give {' and '.join(missing)} here or in the config file")
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(HERE), os.environ.get("PYTHONPATH", "")) if x)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        logging.getLogger(name).info("done: %s", run(spark, config))
    finally:
        spark.stop()
    return 0


def entry(name: str, run: Callable[[SparkSession, dict], dict], doc: str | None) -> None:
    sys.exit(command(name, run, doc))
