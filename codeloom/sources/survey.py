"""Survey answers as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of answer files, in any case.
NAMES = "*.{[jJ][sS][oO][nN],[jJ][sS][oO][nN][lL],[tT][xX][tT]}"


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """value: the lines that are JSON, of files named .json, .jsonl or .txt (in any case); none of a folder that is not there."""
    try:
        lines = spark.read.option("pathGlobFilter", NAMES).text(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    return lines.where(F.try_parse_json(F.trim("value")).isNotNull())


def write_report(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
