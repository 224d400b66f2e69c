"""Folders and files: small driver-side steps, and listing and deleting spread over the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.schemas import LISTING
from keepsake.session import settle


class DriverFiles:
    """Hadoop file system calls for single paths: exists, names in one folder, rename, delete."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def scheme(self, path: str) -> str:
        """What this cluster's default file system puts before a path without a scheme, such as ``file:`` or ``hdfs://name:8020``."""
        fs, p = self._at(path)
        whole = fs.makeQualified(p).toUri()
        return f"{whole.getScheme()}:" + (f"//{whole.getAuthority()}" if whole.getAuthority() else "")

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def entries(self, path: str) -> list[tuple[str, bool]]:
        """(name, is folder) of one folder, sorted by name; empty if the folder is missing."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p))

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        parent = self._jvm.org.apache.hadoop.fs.Path(target).getParent()
        fs.mkdirs(parent)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def list_tables(spark: SparkSession, source: str) -> dict[str, str]:
    """Tables of a lakehouse folder: visible sub-folders and single Parquet files, both by their name without ``.parquet``.

    Where ``x`` and ``x.parquet`` lie side by side, the second keeps its whole name, so that neither is lost.
    """
    tables = {}
    for name, is_folder in DriverFiles(spark).entries(source):
        if name.startswith(("_", ".")) or not (is_folder or name.endswith(".parquet")):
            continue
        stem = name.removesuffix(".parquet")
        tables[name if stem in tables else stem] = f"{source.rstrip('/')}/{name}"
    return tables


# Marks a table of the session catalog where a path is expected.
CATALOG_PREFIX = "table:"


def load_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by path, or by name where the path is ``table:<name>``; a known schema saves a look into the files."""
    if path.startswith(CATALOG_PREFIX):
        return spark.table(path.removeprefix(CATALOG_PREFIX))
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def partition_types(table: DataFrame) -> dict[str, T.DataType]:
    """Partition columns of a table loaded from files and the types Spark gives them, from all of its files."""
    plan = table._jdf.queryExecution().analyzed()
    try:
        names = list(plan.relation().partitionSchema().fieldNames())
    except Exception:
        # Not a relation over files, such as a view.
        return {}
    return {name: table.schema[name].dataType for name in names}


def load_named(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None) -> tuple[DataFrame, dict[str, T.DataType]]:
    """A table whose partition values are the text of its folder names, and the types Spark would give them.

    Types are guesses that depend on which folders there are: ``m=01`` alone is the number 1, next to ``m=A1`` it
    is a text. As text, values are written back as the same folder names.
    """
    table = load_table(spark, path, fmt, schema)
    kinds = {} if path.startswith(CATALOG_PREFIX) else partition_types(table)
    if all(isinstance(kind, T.StringType) for kind in kinds.values()) or fmt == "delta":
        return table, kinds
    named = T.StructType([T.StructField(f.name, T.StringType()) if f.name in kinds else f for f in table.schema.fields])
    return load_table(spark, path, fmt, named), kinds


_NAME = "__folder_name_"


def with_types(table: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """A table of ``load_named`` with typed partition columns, for conditions; ``with_names`` takes it back."""
    kept = {f"{_NAME}{c}": F.col(f"`{c}`") for c in kinds}
    return table.withColumns(kept).withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in kinds.items()}) if kinds else table


def with_names(table: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    return table.select(*[F.col(f"`{_NAME}{c}`").alias(c) if c in kinds else F.col(f"`{c}`") for c in table.columns if not c.startswith(_NAME)])


def quoted(name: str) -> str:
    """A name as one part of an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def list_catalog_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names known to the session catalog."""
    return sorted(row.tableName for row in spark.sql(f"SHOW TABLES IN {quoted(database)}" if database else "SHOW TABLES").collect())


# File systems that tasks can open.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _has_scheme(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def qualified(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """What to put before paths below each of ``paths``, so that tasks use the file system the driver uses.

    Raises for a scheme that tasks cannot open, before anything is planned.
    """
    found = {}
    for path in paths:
        scheme = path.split(":", 1)[0] if _has_scheme(path) else DriverFiles(spark).scheme(path)
        if scheme.split(":", 1)[0] not in SCHEMES:
            raise ValueError(f"{path}: no access to {scheme} on the executors; use one of {', '.join(SCHEMES)}")
        found[path.rstrip("/")] = "" if _has_scheme(path) else scheme
    return found


def open_path(path: str, before: str):
    """(file system, path in it) of a path, for use in tasks."""
    from pyarrow import fs

    path = before + path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# Entries that one task lists before it hands the folders it has not reached to the next round.
ENTRIES_IN_ONE_TASK = 100_000


def _lister(budget: int, before: dict[str, str], deep: bool):
    """Function for mapInPandas: lists what is below ``path``; folders left over are marked open."""

    def list_below(batches):
        import pandas as pd
        from pyarrow import fs

        columns = ["location", "folder_name", "path", "length", "is_dir", "open", "error"]

        for batch in batches:
            # A folder given to this task was written as open by the round before.
            waiting = list(zip(batch["location"], batch["folder_name"], batch["path"]))
            listed, rows = 0, []
            while waiting and (listed < budget or len(waiting) == 1):
                location, folder, path = waiting.pop()
                try:
                    system, inner = open_path(path, before[location])
                    found = system.get_file_info(fs.FileSelector(inner))
                except Exception as exc:
                    rows.append((location, folder, path, 0, True, False, str(exc)))
                    continue
                if folder:
                    rows.append((location, folder, path, 0, True, False, None))
                listed += len(found) + 1
                for info in found:
                    name, child = folder or info.base_name, f"{path.rstrip('/')}/{info.base_name}"
                    if info.type == fs.FileType.Directory and not deep:
                        rows.append((location, name, child, 0, True, False, None))
                    elif info.type == fs.FileType.Directory:
                        waiting.append((location, name, child))
                    else:
                        rows.append((location, name, child, int(info.size or 0), False, False, None))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            rows += [(location, folder, path, 0, True, True, None) for location, folder, path in waiting]
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return list_below


def list_tree(spark: SparkSession, locations: list[str], deep: bool = True) -> DataFrame:
    """Every file and folder below the locations, hidden ones included; only the top level if not ``deep``.

    Folders are listed on the executors. A task stops at a fixed number of entries and hands the
    folders it has not reached to the next round, which spreads them over all tasks. Each round is
    written to the workspace, so neither the driver nor one task holds the whole tree, and a folder
    that cannot be read becomes a row with an error instead of a size of 0. A location that cannot be
    listed itself raises: it is not an empty one.
    """
    roots = [(location.rstrip("/"), None, location.rstrip("/")) for location in locations]
    return _walk(spark.createDataFrame(roots, "location string, folder_name string, path string"), locations, deep)


def list_below(folders: DataFrame, locations: list[str]) -> DataFrame:
    """Every file below ``folders`` (location, folder_name, path), as ``list_tree`` finds them; a folder that cannot be read is a row with an error."""
    return _walk(folders, locations, True).where("NOT is_dir OR error IS NOT NULL")


def table_of(path: str) -> Column:
    """The table folder that a path below ``location``/``folder_name`` lies in."""
    return F.get(F.split(F.substr(path, F.length("location") + F.length("folder_name") + 3), "/"), 0)


def is_data(path: str) -> Column:
    """Whether no part of a path below its table is hidden, as readers see it: partition folders such as ``_a=1`` are not."""
    parts = F.split(F.substr(path, F.length("location") + F.length("folder_name") + 3), "/")
    return ~F.exists(F.slice(parts, 2, F.size(parts)), lambda part: F.rlike(part, F.lit("^[_.]")) & ~F.contains(part, F.lit("=")))


def _walk(frontier: DataFrame, locations: list[str], deep: bool) -> DataFrame:
    spark = frontier.sparkSession
    before = qualified(spark, locations)
    tree = None
    while True:
        parts = spark.sparkContext.defaultParallelism
        level = settle(frontier.repartition(parts, "path").mapInPandas(_lister(ENTRIES_IN_ONE_TASK, before, deep), LISTING), "listing")
        closed = level.where("NOT open").drop("open")
        tree = closed if tree is None else tree.unionByName(closed)
        frontier = level.where("open").select("location", "folder_name", "path")
        unread = level.where("folder_name IS NULL AND error IS NOT NULL").first()
        if unread:
            raise OSError(f"cannot list {unread['path']}: {unread['error']}")
        if frontier.isEmpty():
            return tree


def list_folders(folders: DataFrame, locations: list[str]) -> DataFrame:
    """Files directly in each of ``folders`` (location, folder_name, path); missing folders have none."""
    spark = folders.sparkSession
    spread = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(_lister(ENTRIES_IN_ONE_TASK, qualified(spark, locations), False), LISTING).where("NOT is_dir")


def top_folders(tree: DataFrame) -> DataFrame:
    """Folders directly below each location."""
    return tree.where(F.col("is_dir") & (F.col("path") == F.concat_ws("/", "location", "folder_name"))).select("location", "folder_name", "path").distinct()


def folder_sizes(tree: DataFrame) -> DataFrame:
    """Bytes and files per backup folder, with the first read error if any."""
    return tree.where("folder_name IS NOT NULL").groupBy("location", "folder_name").agg(
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("length"))), F.lit(0).cast("bigint")).alias("size_bytes"),
        F.count_if(~F.col("is_dir")).alias("files"), F.min("error").alias("error"))


def table_sizes(tree: DataFrame) -> DataFrame:
    """Data files and bytes per table of one backup: location is the backup, folder_name the table.

    Raises while it is read if part of a table could not be listed: the sizes would be too small.
    """
    problem = F.concat(F.lit("cannot list "), "path", F.lit(": "), "error")
    tree = tree.withColumn("length", F.when(F.col("error").isNotNull(), F.raise_error(problem).cast("bigint")).otherwise(F.col("length")))
    name = F.element_at(F.split("path", "/"), -1)
    data = (~F.col("is_dir") | F.col("error").isNotNull()) & ~F.rlike(name, F.lit("^[_.]")) & ~F.rlike("folder_name", F.lit("^[_.]"))
    return tree.where(data).groupBy(F.regexp_replace("folder_name", r"\.parquet$", "").alias("table_name")).agg(
        F.count(F.lit(1)).alias("num_files"), F.sum("length").alias("size_bytes"))


def table_statistics(spark: SparkSession, tables: dict[str, str], fmt: str) -> DataFrame:
    """``table_name, num_files, size_bytes`` of tables: from the Delta log where there is one, else by listing."""
    if fmt == "delta":
        parts = [spark.sql(f"DESCRIBE DETAIL delta.`{path}`").select(
            F.lit(name).alias("table_name"), F.col("numFiles").cast("bigint").alias("num_files"),
            F.col("sizeInBytes").alias("size_bytes")) for name, path in tables.items()]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result
    # A table is a folder or a single file; either is an entry of the folder above it.
    names = spark.createDataFrame([(path.rstrip("/"), name) for name, path in tables.items()], "entry string, table_name string")
    above = sorted({path.rstrip("/").rsplit("/", 1)[0] for path in tables.values()})
    files = list_tree(spark, above).where("NOT is_dir").withColumn("entry", F.concat_ws("/", "location", "folder_name"))
    visible = files.where(~F.rlike(F.element_at(F.split("path", "/"), -1), F.lit("^[_.]")))
    return visible.join(names, "entry").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("num_files"), F.sum("length").alias("size_bytes"))


def _deleter(folders: bool, before: dict[str, str]):
    """Function for mapInPandas: deletes ``path`` and adds ``error`` and ``already_gone``."""

    def delete(batches):
        from pyarrow import fs

        def remove(location, path):
            try:
                system, inner = open_path(path, before[location])
                if system.get_file_info(inner).type == fs.FileType.NotFound:
                    return None, True
                if folders:
                    system.delete_dir(inner)
                else:
                    system.delete_file(inner)
            except FileNotFoundError:
                return None, True
            except Exception as exc:
                return str(exc), False
            return None, False

        for batch in batches:
            done = [remove(location, path) for location, path in zip(batch["location"], batch["path"])]
            yield batch.assign(error=[d[0] for d in done], already_gone=[d[1] for d in done])

    return delete


def delete_paths(rows: DataFrame, folders: bool, label: str, locations: list[str]) -> DataFrame:
    """Delete ``path`` of each row on the executors; returns the written rows with ``error`` and ``already_gone``.

    ``rows`` has the ``location`` (one of ``locations``) that each path is below, and must come from
    written tables: they must not change while files disappear. The result is written too, so that
    reading it twice never deletes twice. A path that is not there is no error, but said to be gone.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", error string, already_gone boolean"
    spread = rows.repartition(spark.sparkContext.defaultParallelism, "path")
    return settle(spread.mapInPandas(_deleter(folders, qualified(spark, locations)), schema), label)
