"""What the jobs share: settings, log, high-water marks and tables that may not be there yet. All of it through Spark."""

from __future__ import annotations

import argparse
import logging
import tomllib
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quadrille.session import prepare, shared_dir

log = logging.getLogger("jobs")


def settings(job: str, path: str | None = None) -> dict:
    """The job's own settings file, with values of another one over it."""
    out = tomllib.loads((Path(__file__).parent / f"{job}.toml").read_text())
    return out | (tomllib.loads(Path(path).read_text()) if path else {})


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the job; one without rows if no run has written it yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def last_mark(spark: SparkSession, path: str, schema: str, by: str):
    """The newest row of a mark, or None. A run appends its mark when all else is written."""
    return read_or_empty(spark, path, schema).orderBy(F.desc(by)).first()


def add_mark(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def counted(df: DataFrame, what: str) -> tuple[DataFrame, Observation]:
    """A table whose rows are counted while an action reads them."""
    seen = Observation(f"{what}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def rows_of(seen: Observation) -> int:
    """What was counted; none if Spark found the table empty beforehand, and left the count out with it."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> int:
    """Writes partitions over those of the same values, leaves all others; the number of rows."""
    df, seen = counted(df, "rows")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return rows_of(seen)


def new_folder(spark: SparkSession, job: str) -> str:
    """A folder that no other run has, in the folder that the cluster shares."""
    return f"{shared_dir(prepare(spark))}/jobs/{job}-{uuid.uuid4().hex}"


def main(job: str, run: Callable, description: str) -> None:
    """The command line: makes a session, runs the job once and ends the session."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=description)
    p.add_argument("--input", required=True, help="folder of the tables")
    p.add_argument("--output", required=True, help="folder of the job's tables, mark and checkpoint")
    p.add_argument("--config", help="settings that replace those of the job's own file")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = prepare(SparkSession.builder.appName(job).getOrCreate())
    try:
        run(spark, a.input.rstrip("/"), a.output.rstrip("/"), settings(job, a.config))
    finally:
        spark.stop()
