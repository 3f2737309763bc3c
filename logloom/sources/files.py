"""Log files: discovery, reading, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import put, standard


def source_id(path: Column) -> Column:
    """The first twelve hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 12)


def glob_pattern(glob: str) -> str:
    """A shell glob on a base name as a regex."""
    import fnmatch

    return fnmatch.translate(glob)


def wanted(path: Column, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = (), infix: bool = False) -> Column:
    """Include and exclude globs on the base name; excluded directories by prefix, or (``infix``) anywhere in the path."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    hit = lambda gs: reduce(lambda a, g: a | base.rlike(glob_pattern(g)), gs, F.lit(False))
    out = hit(include) & ~hit(exclude)
    for d in exclude_dirs:
        d = d.rstrip("/")
        out = out & ~(F.contains(path, F.lit(f"{d}/")) if infix else path.startswith(f"{d}/"))
    return out


def read_lines(spark: SparkSession, path: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = (), infix: bool = False, streaming: bool = False) -> DataFrame:
    """message, path: lines that aren't empty (a carriage return is kept), from all files below ``path``.

    A single include glob is handed to the reader, so that other files aren't listed.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if len(include) == 1 and include[0] != "*":
        reader = reader.option("pathGlobFilter", include[0])
    rows = reader.format("text").load(path).select(F.col("value").alias("message"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"))
    return rows.where((F.col("message") != "") & wanted(F.col("path"), include, exclude, exclude_dirs, infix))


def as_records(lines: DataFrame, host: str = "", hostname: str = "", labels: dict[str, str] | None = None) -> DataFrame:
    """Records with the standard labels, file_path and file_name."""
    own = F.create_map(*(F.lit(x) for kv in sorted((labels or {}).items()) for x in kv)).cast("map<string,string>") if labels else F.create_map().cast("map<string,string>")
    std = standard(own, "file", F.lit(host), F.lit(hostname))
    full = put(std, {"file_path": F.col("path"), "file_name": F.regexp_extract("path", "([^/]*)$", 1)})
    return lines.select("message", F.lit("file").alias("source_type"), source_id(F.col("path")).alias("source_id"), full.alias("labels"))


def read_listed(spark: SparkSession, files: list[dict], **labels) -> DataFrame:
    """An explicit list of {path, labels, enabled}; one read, the labels by a map of the listed paths."""
    chosen = [f for f in files if f.get("enabled", True)]
    if not chosen:
        return spark.createDataFrame([], "message string, source_type string, source_id string, labels map<string,string>")
    rows = spark.read.option("lineSep", "\n").text([f["path"] for f in chosen]).select(F.col("value").alias("message"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path")).where("message <> ''")
    side = spark.createDataFrame([(f["path"], f.get("labels") or {}) for f in chosen], "path string, own map<string,string>")
    joined = rows.join(F.broadcast(side), "path", "left")  # as many rows as the list has
    return joined.select("message", F.lit("file").alias("source_type"), source_id(F.col("path")).alias("source_id"), put(standard(F.col("own"), "file", F.lit(""), F.lit("")), {"file_path": F.col("path")}).alias("labels"))
