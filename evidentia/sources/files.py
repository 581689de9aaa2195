"""Repository files: reading, scan rules, sanitised views and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.operators.ranking import top_k

# What the two sanitised views leave out.
REPOSITORY_VIEW_DIRS = [".git", "target", "benchmark", "artifacts"]
WORKSPACE_VIEW_DIRS = [".git", "target", "build", "node_modules", "artifacts", "benchmark", "__pycache__"]
# end fixed values


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def scannable(path: Column) -> Column:
    """Indexable ending, and no excluded or hidden directory on the way."""
    hidden = F.exists(_dirs(path), lambda p: p.isin(*V.SCAN_EXCLUDED_DIRS) | F.startswith(p, F.lit(".")))
    return ~hidden & tx.extension_of(path).isin(*V.INDEXABLE_EXTENSIONS)


def _env_file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^\.env(?:\.|\z)")


def in_repository_view(path: Column, include_tests: bool = False) -> Column:
    parts = F.split(F.lower(path), "/")
    keep = ~F.arrays_overlap(parts, tx.words(*REPOSITORY_VIEW_DIRS)) & ~_env_file(path)
    keep = keep & ~F.endswith(F.lower(path), F.lit(".md"))
    if not include_tests:
        keep = keep & ~F.contains(F.concat(F.lit("/"), F.lower(path), F.lit("/")), F.lit("/src/test/"))
    return keep


def in_workspace_view(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return (
        ~F.arrays_overlap(parts, tx.words(*WORKSPACE_VIEW_DIRS))
        & ~_env_file(path)
        & ~F.lower(path).rlike(r"\.(?:md|class|jar|log)\z")
    )


def read_repositories(
    spark: SparkSession, root: str, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """(repo, file, content, size, truncated) of every scannable text file below ``root``.

    The first directory below ``root`` names the repository.  Files that are not
    UTF-8 are skipped.  ``max_bytes`` cuts longer ones (``truncated`` marks them) and
    ``max_files`` takes the first files of each repository in walk order; by default
    all files are read whole.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_extract("path", rf"(?s)\Q{root.rstrip('/')}\E/(.*)\z", 1)
    rel = F.substring_index(inside, "/", 1)
    files = raw.select(
        rel.alias("repo"), F.regexp_replace(inside, "^[^/]*/", "").alias("file"), "content", F.col("length").alias("size")
    ).where(scannable(F.col("file")) & F.is_valid_utf8(F.col("content").cast("string")))
    if max_files is not None:
        walk = tx.walk_key(F.col("file"))
        sizes = files.select("repo", "file")
        keep = top_k(sizes, ["repo"], [walk], max_files, "_n").select("repo", "file")
        files = files.join(keep, ["repo", "file"], "left_semi")
    text = tx.canonical_newlines(F.col("content").cast("string"))
    return files.select(
        "repo", "file", (text if max_bytes is None else F.left(text, F.lit(max_bytes))).alias("content"), "size",
        (F.lit(False) if max_bytes is None else F.col("size") > max_bytes).alias("truncated"),
    )


def write_logs(logs: DataFrame, path: str, key: str = "run_id") -> None:
    """Packs (key, log) into JSON lines, one whole log a line: as many files as tasks, however many logs."""
    logs.select(F.col(key).cast("string").alias(key), "log").write.json(path)


def read_logs(spark: SparkSession, root: str, key: str = "run_id", packed: bool = False) -> DataFrame:
    """(key, log) of the logs below ``root``, each whole: files in folders named ``key=value``, or ``packed`` by ``write_logs``."""
    if packed:
        return spark.read.schema(f"`{key}` string, log string").json(root)
    return spark.read.text(root, wholetext=True).select(key, F.col("value").alias("log"))


def tree_listing(paths: DataFrame, max_depth: int = 3, max_files: int = 200) -> DataFrame:
    """Per repository: files listed down to ``max_depth``, code files among them, truncation."""
    hidden = F.exists(_dirs(F.col("file")), lambda p: p.isin(*V.SCAN_EXCLUDED_DIRS))
    shallow = paths.where((F.size(F.split("file", "/")) <= max_depth) & ~hidden)
    listed = top_k(shallow.select("repo", "file"), ["repo"], [tx.walk_key(F.col("file"))], max_files + 1, "_n")
    kept = F.col("_n") <= max_files
    return listed.groupBy("repo").agg(
        F.count_if(kept).alias("file_count"),
        F.count_if(kept & F.endswith("file", F.lit(".java"))).alias("java_file_count"),
        (F.max("_n") > max_files).alias("truncated"),
    )
