"""Sources and sinks: source trees, decoding, ignore rules, JSON lines, lockfiles, licences, reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions import vocab as V

REPO = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "url", "role", "sha", "license", "license_sha256", "gitignore_sha256")] + [T.StructField("go_files", T.IntegerType())])
LOCK = T.StructType(
    [
        T.StructField("set", T.StringType()), T.StructField("fetched_at", T.StringType()), T.StructField("scan_config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("repos", T.ArrayType(REPO)), T.StructField("rejected", T.ArrayType(REPO)),
    ]
)


def decoded(content: Column) -> Column:
    """Text of bytes: one byte order mark goes, invalid bytes become U+FFFD, line ends become newlines."""
    text = F.make_valid_utf8(content.cast("string"))
    text = F.when(text.startswith("﻿"), F.substring(text, 2, 2_147_483_647)).otherwise(text)
    return F.regexp_replace(text, "\r\n?", "\n")


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(negated, regular expression over a relative path) of each line of a .gitignore; the last that fits decides."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!") if line.startswith("!") else line
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        rx, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                rx, i = rx + "(?:[^/]+/)*", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                rx, i = rx + "/.+", i + 3
            elif line[i] == "*":
                rx, i = rx + "[^/]*", i + 1
            elif line[i] == "?":
                rx, i = rx + "[^/]", i + 1
            elif line[i] == "[" and "]" in line[i + 1 :]:
                j = line.index("]", i + 2)
                rx, i = rx + "[" + line[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
            else:
                if line[i] == "\\" and i + 1 < len(line):
                    i += 1
                rx, i = rx + re.escape(line[i]), i + 1
        out.append((negated, ("^" if anchored else "^(?:.*/)?") + rx + ("/" if folder else "(?:/|$)")))
    return out


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for negated, rx in rules:
        out = F.when(path.rlike(rx), F.lit(not negated)).otherwise(out)
    return out


def _small_file(spark: SparkSession, path: str) -> str:
    """A file's text, empty if there is none. Spark's own readers pass over names that begin with a dot."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can write: below spark.checkpoint.dir, a temporary one where that is unset (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sieveline-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once and read back, for results that several parts of a plan use."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, by whichever file system the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(content)
    finally:
        stream.close()


def read_tree(spark: SparkSession, root: str, repo: str, gitignore: str | None = None, pattern: str = "*.go", skip_generated: bool = True) -> DataFrame:
    """repo, path, text of a source tree: files below the size limit, outside skipped and ignored folders."""
    at = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(at).where(F.col("length") <= V.MAX_FILE_BYTES)
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    if gitignore is None:
        gitignore = _small_file(spark, f"{at}/.gitignore")
    base = re.sub("^[a-z0-9]+:/*", "/", at) + "/"
    rel = F.substring(full, len(base) + 1, 100_000)
    files = files.where(~F.arrays_overlap(F.split(full, "/"), F.lit(list(V.SKIP_DIRS)))).where(~ignored(rel, ignore_rules(gitignore)))
    out = files.select(F.lit(repo).alias("repo"), rel.alias("path"), decoded(F.col("content")).alias("text"))
    return out.where(~is_generated(F.col("text"))) if skip_generated else out


def in_path_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.split("path", "/"))


def is_generated(text: Column) -> Column:
    return F.substring(text, 1, 4096).rlike(V.GENERATED.replace("(?m)", "(?dm)"))


def documents_as_files(documents: DataFrame) -> DataFrame:
    """The documents table as source files; every fifth lies in a test folder."""
    folder = F.when(F.col("doc_id") % 5 == 0, "pkg/testdata/doc_").otherwise("doc_")
    return documents.select(F.col("source").alias("repo"), F.concat(folder, F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; the schema is given, never inferred."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """All keys in every line, nulls too."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCK).json(path, multiLine=True)


def locked_repos(lock: DataFrame) -> DataFrame:
    return lock.select("set", F.explode("repos").alias("r")).select("set", "r.*")


def find_license(files: DataFrame) -> DataFrame:
    """repo, license and digest of each repository's licence file: the first by name. files: repo, path, text, and content where the bytes are known.

    The digest is that of the bytes, without which the text's own are taken.
    """
    order = F.array_position(F.lit(list(V.LICENSE_FILENAMES)), F.col("path"))
    w = Window.partitionBy("repo").orderBy("order")
    first = files.withColumn("order", order).where("order > 0").withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select("repo", P.license_of("text").alias("license"), F.sha2("content" if "content" in files.columns else "text", 256).alias("license_sha256"))


def license_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """repo, path, text and content of the files in a tree's root that may be its licence."""
    at = root.rstrip("/")
    files = spark.read.format("binaryFile").load(f"{at}/*").where(F.element_at(F.split("path", "/"), -1).isin(*V.LICENSE_FILENAMES))
    return files.select(F.lit(repo).alias("repo"), F.element_at(F.split("path", "/"), -1).alias("path"), decoded(F.col("content")).alias("text"), "content")


def accepted(repos: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories with an approved licence, and the others (those without any too)."""
    return repos.join(approved, "license", "left_semi"), repos.join(approved, "license", "left_anti")


def file_totals(locked: DataFrame) -> DataFrame:
    return locked.groupBy("set").agg(F.count("*").alias("repos"), F.sum("go_files").alias("go_files"))


def name_of(root: str) -> str:
    return PurePosixPath(root).name
