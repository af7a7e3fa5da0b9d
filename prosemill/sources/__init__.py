"""Sources: files, and any table with an id and a text."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read from folders.
EXTENSIONS = ("md", "markdown", "txt", "rst", "adoc", "html", "htm")


def from_files(spark: SparkSession, *paths: str, globs: Sequence[str] = ()) -> DataFrame:
    """(path, text) of files: given files whatever their names, folders with all below that have a known extension or a name that one of globs fits.

    A path counts once. Text is UTF-8. Spark's text reader serves any store that it knows, without reading at the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    single, folders = [], []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        (folders if at.getFileSystem(conf).getFileStatus(at).isDirectory() else single).append(p)
    parts = []
    if single:
        parts.append(spark.read.text(single, wholetext=True))
    if folders:
        found = spark.read.option("recursiveFileLookup", "true").text(folders, wholetext=True)
        path = F.col("_metadata.file_path")
        known = path.rlike(rf"\.({'|'.join(EXTENSIONS)})$")
        for g in globs:  # a pattern without a folder fits a file's name
            known |= (path if "/" in g else F.element_at(F.split(path, "/"), -1)).rlike(fnmatch.translate(f"*{g}" if "/" in g else g).replace("(?s:", "(?s:^").replace(r"\Z", r"\z"))
        parts.append(found.where(known))
    rows = [p.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")) for p in parts]
    if not rows:
        return spark.createDataFrame([], "path string, text string")
    return (rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).dropDuplicates(["path"])


def from_table(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(path, text) of any table."""
    return df.select(F.col(f"`{id_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
