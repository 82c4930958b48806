"""Dataset registry, readers and writers.

A dataset is one Parquet file or a directory of parts; Spark reads all parts either way.  Columns are
asked for at the scan, so that only they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, StructType

DATASETS = {
    "disease": "id string, name string, exactSynonyms array<string>, therapeuticAreas array<string>, ancestors array<string>, descendants array<string>",
    "reactome": "id string, label string",
    "evidence_reactome": "diseaseId string, pathways array<struct<id:string,name:string>>",
    "target": "approvedSymbol string",
    "go": "id string, label string",
}
STAGES = {
    "surface_forms": "diseaseId string, diseaseName string, raw string, source string, isAbbreviation boolean, normalised string",
    "chunks": "diseaseId string, diseaseName string, surfaceForm string, source string, isAbbreviation boolean, chunk string, nTokens int, specificity double, coverage double, nDiseases long",
    "matches": "pathwayId string, pathwayLabel string, diseaseId string, method string, matchedText string, nDiseases long",
}


def _path(root: str, name: str) -> str:
    DATASETS[name]  # an unknown name is a KeyError
    return f"{root}/{name}"


def _fits(have: DataType, wanted: DataType) -> bool:
    """Equal types; a struct may have more fields than are wanted."""
    if isinstance(have, ArrayType) and isinstance(wanted, ArrayType):
        return _fits(have.elementType, wanted.elementType)
    if isinstance(have, StructType) and isinstance(wanted, StructType):
        return all(f.name in have.names and _fits(have[f.name].dataType, f.dataType) for f in wanted)
    return have == wanted


def load(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A dataset with the columns asked for (all by default); missing ones, and declared ones of another type,
    are a ValueError at once."""
    frame = spark.read.parquet(_path(root, name))
    declared = StructType.fromDDL(DATASETS[name])
    wanted = list(columns or declared.names)
    if missing := [c for c in wanted if c not in frame.columns]:
        raise ValueError(f"{name} has no column {', '.join(missing)}")
    if other := [c for c in wanted if c in declared.names and not _fits(frame.schema[c].dataType, declared[c].dataType)]:
        raise ValueError(f"{name} has columns of another type: " + ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in other))
    return frame.select(*wanted)


def list_parts(spark: SparkSession, root: str, name: str) -> list[str]:
    """Files of a dataset; none is a RuntimeError."""
    try:
        found = sorted(spark.read.parquet(_path(root, name)).inputFiles())
    except AnalysisException:
        found = []
    if not found:
        raise RuntimeError(f"no parts of {name} under {root}")
    return found


def read_stage(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    return (spark.read.schema(STAGES[stage]) if stage else spark.read).parquet(path)


def write_stage(frame: DataFrame, path: str) -> None:
    """Parquet; Spark's committer shows the files only when all are written."""
    frame.write.mode("overwrite").parquet(path)


def write_csv(frame: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, a file for each partition; as one file in the order of its columns for small reports."""
    frame = frame.orderBy(*frame.columns).coalesce(1) if one_file else frame
    frame.write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What is stored under ``path``; built and stored first if it isn't there, or if forced."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    write_stage(build(), path)
    return spark.read.parquet(path)
