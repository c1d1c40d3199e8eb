"""Members of ZIP archives, read through Spark so that any store works, and small side files beside outputs."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tesserae.runtime import ship


def read_zip(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, member, content) of every member whose name ends in ``suffix``; one archive is one task's work."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix) and not name.endswith("/"):
                            yield pd.DataFrame({"path": [p], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def write_side_file(spark: SparkSession, path: str, values: dict) -> None:
    """A one-line JSON text beside an output, such as the cell size of a sample."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_side_file(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
