"""Sinks: snapshots behind a pointer, append-only logs, curated files, metric lines, images."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleParent(RuntimeError):
    """The snapshot that a writer started from isn't the current one any more."""


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The id in the pointer file with the greatest number, or None before the first publication."""
    return _newest(spark, f"{root}/pointer")[1]


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and id of the newest pointer; (0, None) if there is none."""
    _, p, fs = _files(spark, path)
    if not fs.exists(p) or not any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(p)):
        return 0, None
    row = spark.read.schema("n long, id string").parquet(path).agg(F.max(F.struct("n", "id")).alias("x")).first()
    return row.x.n, row.x.id


def _claim(spark: SparkSession, path: str, number: int, to: str) -> bool:
    """Make the pointer file of this number, whole or not at all; False if another writer has it.
    The file is written aside and linked or renamed to its name, which fails where there is one."""
    jvm, p, fs = _files(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(p, f"_{uuid.uuid4().hex}")  # readers pass over such names
    spark.createDataFrame([(number, to)], "n long, id string").coalesce(1).write.parquet(aside.toString())
    written = next(f.getPath() for f in fs.listStatus(aside) if f.getPath().getName().endswith(".parquet"))
    target = jvm.org.apache.hadoop.fs.Path(p, f"{number:012d}.parquet")
    try:
        if fs.getScheme() == "file":  # a local rename replaces, a link doesn't
            local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(fs.makeQualified(target)), local(written))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), fs.getConf()).rename(written, target, none)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(aside, True)
    return True


def guard_parent(spark: SparkSession, root: str, parent: str | None) -> int:
    """The parent's number, if it is the current snapshot."""
    n, now = _newest(spark, f"{root}/pointer")
    if now != parent:
        raise StaleParent(f"parent is {parent}, current is {now}")
    return n


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], snapshot_id: str, root: str, parent: str | None) -> None:
    """All tables below snapshot_id=..., then the pointer: readers see all or nothing.

    The pointer after the parent's has one number, and only one writer can have it: of
    several that start from one parent, one publishes and the others get StaleParent."""
    n = guard_parent(spark, root, parent)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/snapshot_id={snapshot_id}/{name}")
    if not _claim(spark, f"{root}/pointer", n + 1, snapshot_id):
        raise StaleParent(f"parent {parent} was succeeded by another snapshot meanwhile")


def read_snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the current snapshot, resolved once."""
    at = current_snapshot(spark, root)
    if at is None:
        raise LookupError(f"nothing is published below {root}")
    return {n: spark.read.parquet(f"{root}/snapshot_id={at}/{n}") for n in names}


def append_answer_log(df: DataFrame, path: str) -> None:
    """Defaults for time, source and snapshot; answer texts are never stored."""
    d = df.drop("text", "answer").withColumns({"asked_at": F.coalesce("asked_at", F.current_timestamp()), "source": F.coalesce("source", F.lit("unknown")), "snapshot_id": F.nullif("snapshot_id", F.lit(""))})
    d.withColumn("day", F.to_date("asked_at")).write.mode("append").partitionBy("day").parquet(path)


def write_curated(df: DataFrame, statistics: DataFrame, root: str, version: str, at=None) -> None:
    """Cases and statistics, each row with version and time (now if not given), in a new
    directory; then the pointer."""
    stamp = {"version": F.lit(version), "curated_at": F.current_timestamp() if at is None else F.lit(at).cast("timestamp")}
    df.withColumns(stamp).write.parquet(f"{root}/{version}/cases")
    statistics.withColumns(stamp).write.parquet(f"{root}/{version}/statistics")
    pointer = f"{root}/pointer"
    while not _claim(df.sparkSession, pointer, _newest(df.sparkSession, pointer)[0] + 1, version):
        pass  # another version came first; this one comes after it


def read_curated(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Cases and statistics of the current version."""
    at = _newest(spark, f"{root}/pointer")[1]
    if at is None:
        raise LookupError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root}/{at}/cases"), spark.read.parquet(f"{root}/{at}/statistics")


def metric_lines(metrics: DataFrame, families: DataFrame) -> DataFrame:
    """nth, line: text exposition.  metrics: family, labels (map), value; families: family,
    help, kind (small).  HELP and TYPE once a family, even an empty one; whole numbers
    without decimals, others with six; backslash, quote and line break escaped in labels."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.format_string("%.6f", "value"))
    rows = metrics.select("family", F.lit(2).alias("part"), F.concat("family", F.when(labels != "", F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), value).alias("line"))
    head = families.select("family", F.posexplode(F.array(F.concat(F.lit("# HELP "), "family", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "family", F.lit(" "), "kind"))).alias("part", "line"))
    return head.unionByName(rows).orderBy("family", "part", "line")


def store_images(images: DataFrame) -> DataFrame:
    """image_hash, content: the same bytes once."""
    return images.select(F.sha2("content", 256).alias("image_hash"), "content").dropDuplicates(["image_hash"])
