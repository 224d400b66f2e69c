"""Backup manifests: written last, read for all folders of a location at once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.schemas import MANIFEST
from keepsake.session import settle
from keepsake.sources.storage import list_folders

MANIFEST_FOLDER = "_manifest"


def write_manifest(spark: SparkSession, backup_path: str, manifest: dict) -> None:
    schema = T._parse_datatype_string(MANIFEST)
    row = tuple(manifest.get(field.name) for field in schema.fields)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{backup_path}/{MANIFEST_FOLDER}")


def _scan(spark: SparkSession, path: str) -> DataFrame | None:
    """Manifest rows at a path, None where there is none. Anything else that goes wrong is raised: a
    manifest that cannot be read must not look like a missing one."""
    schema = T._parse_datatype_string(MANIFEST)
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_manifest(spark: SparkSession, backup_path: str) -> Row | None:
    """One backup's manifest, None when there is none."""
    scan = _scan(spark, f"{backup_path}/{MANIFEST_FOLDER}")
    if scan is None:
        return None
    found = scan.first()
    if found is None or found.backup_id is None:
        raise ValueError(f"the manifest of {backup_path} is not readable")
    return found


def read_manifests(spark: SparkSession, locations: list[str]) -> DataFrame:
    """``location, folder_name, manifest`` of every folder that has a manifest, one scan per location."""
    found = T.StructType([T.StructField("location", T.StringType()), T.StructField("folder_name", T.StringType()),
                          T.StructField("manifest", T._parse_datatype_string(MANIFEST))])
    result = spark.createDataFrame([], found)
    for location in locations:
        location = location.rstrip("/")
        scan = _scan(spark, f"{location}/*/{MANIFEST_FOLDER}")
        if scan is None:
            continue
        folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{MANIFEST_FOLDER}/[^/]+$", 1)
        unreadable = F.raise_error(F.concat(F.lit("manifest not readable: "), F.col("_metadata.file_path"))).cast("string")
        checked = F.when(F.col("backup_id").isNull(), unreadable).otherwise(F.lit(location))
        rows = scan.select(checked.alias("location"), folder.alias("folder_name"), F.struct(*scan.columns).alias("manifest"))
        result = result.unionByName(rows)
    return result


def all_manifests(spark: SparkSession, locations: list[str], folders: DataFrame) -> DataFrame:
    """``read_manifests``, written; raises if one of ``folders`` (location, folder_name, path) has a manifest file without a row.

    An empty file gives no row and no error, but the chain it should name is lost.
    """
    found = settle(read_manifests(spark, locations), "manifests")
    silent = folders.join(found.select("location", "folder_name"), ["location", "folder_name"], "left_anti")
    silent = silent.select("location", "folder_name", F.concat("path", F.lit(f"/{MANIFEST_FOLDER}")).alias("path"))
    file = list_folders(silent, locations).where(F.col("path").endswith(".json")).first()
    if file:
        raise ValueError(f"manifest not readable: {file.path}")
    return found


def copies_of(manifest: Row | None) -> dict[str, Row]:
    """How each table of a backup was copied, by name; empty for manifests that do not say."""
    return {copy.table_name: copy for copy in (manifest.copies or [])} if manifest is not None else {}
