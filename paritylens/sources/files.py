"""Reading and writing the file formats of recordings, labels and campaign fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.schemas import CLIENTS, ORDERS, PRODUCTS, REQUIRED, SAMPLE_LINE, TASKS


def read_samples(spark: SparkSession, path: str, recording_id: str | None = None) -> DataFrame:
    """Recording files as samples.

    Blank, cut, undecodable and ill-shaped lines are skipped: a line counts
    only if it is an object with all required fields and no unknown one.  The
    recording is the file name up to its first dot, unless it is given;
    line_no follows the place in the file, which holds because lines of a file
    never move.  Lines are numbered within the block that a task reads, after
    those of the blocks before it, so a recording of any size needs no task of its own.
    """
    lines = spark.read.text(path).select(
        (F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1) if recording_id is None else F.lit(recording_id)).alias("recording_id"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("__block"), F.monotonically_increasing_id().alias("__at"), "value",
    )
    parsed = lines.withColumn("s", F.from_json("value", SAMPLE_LINE)).withColumn("keys", F.json_object_keys("value"))
    unknown = F.size(F.array_except("keys", F.array(*(F.lit(f) for f in SAMPLE_LINE.names))))
    ok = (F.size("keys") > 0) & (unknown == 0)
    for name in REQUIRED:
        ok = ok & F.col(f"s.{name}").isNotNull()
    good = parsed.where(ok)
    # One row per block is summed in order.
    before = F.sum("n").over(Window.partitionBy("recording_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = good.groupBy("recording_id", "__block").agg(F.count(F.lit(1)).alias("n")).select("recording_id", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("recording_id", "__block").orderBy("__at"))
    numbered = good.withColumn("__within", within).join(blocks, ["recording_id", "__block"]).withColumn("line_no", (F.col("__before") + F.col("__within")).cast("long"))
    return numbered.select(
        "recording_id", "line_no", "s.input_id", "s.arm", "s.sample_idx", F.col("s.order").alias("ord"), "s.output", "s.latency_ms",
        F.coalesce("s.ts", F.lit(0.0)).alias("ts"), "s.model_id", "s.finish_reason", "s.error", F.coalesce("s.session", F.lit(0)).alias("session_no"),
    )


def write_samples(samples: DataFrame, path: str) -> None:
    """One folder of JSON lines per recording, in order of ``ord`` within each."""
    out = samples.select("recording_id", "input_id", "arm", "sample_idx", F.col("ord").alias("order"), "output", "latency_ms", "ts", "model_id", "finish_reason", "error", F.col("session_no").alias("session"))
    out.repartition("recording_id").sortWithinPartitions("recording_id", "order").write.partitionBy("recording_id").option("ignoreNullFields", "false").mode("overwrite").json(path)


def read_activation(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, input_id, sample_idx, hit) of label files ``{"<input>#<idx>": bool}``; the last # splits."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("recording_id"), "value")
    pairs = text.select("recording_id", F.explode(F.from_json("value", "MAP<STRING,BOOLEAN>")).alias("k", "hit"))
    return pairs.select("recording_id", F.regexp_extract("k", r"(?s)^(.*)#([^#]*)$", 1).alias("input_id"), F.expr(r"try_cast(regexp_extract(k, '(?s)^(.*)#([^#]*)$', 2) AS INT)").alias("sample_idx"), "hit")


def upsert_labels(new: DataFrame, path: str) -> None:
    """Lay labels (recording_id, input_id, sample_idx, hit, line_no) over those stored at ``path``, all at once.

    The merged table is written beside the old one and takes its name by a
    rename; a reader finds the old labels or the new ones, and a run that
    fails leaves the old ones.
    """
    import uuid

    from paritylens.operators.log import latest_labels, merge_labels

    spark = new.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    here = fs_path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    latest = latest_labels(new)
    merged = merge_labels(spark.read.parquet(path), latest) if fs.exists(here) else latest
    mark = uuid.uuid4().hex
    merged.write.parquet(f"{path}.new-{mark}")
    if fs.exists(here):
        fs.rename(here, fs_path(f"{path}.old-{mark}"))
    if not fs.rename(fs_path(f"{path}.new-{mark}"), here):
        raise OSError(f"the merged labels stand in {path}.new-{mark}")
    fs.delete(fs_path(f"{path}.old-{mark}"), True)


def read_campaign(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """orders, products and clients of a campaign, with their types."""
    read = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")
    return {"orders": read("orders", ORDERS), "products": read("products", PRODUCTS), "clients": read("clients", CLIENTS)}


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; decimals keep their two places."""
    df.write.option("header", True).mode("overwrite").csv(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, direction, lang, theme, text): inbound messages first, each list in its order."""
    whole = spark.read.schema(TASKS).json(path, multiLine=True)
    a = whole.select(F.posexplode("inbound").alias("p", "m")).select(F.lit(0).alias("part"), "p", "m.id", F.lit("inbound").alias("direction"), "m.lang", F.col("m.theme").alias("theme"), F.col("m.text").alias("text"))
    b = whole.select(F.posexplode("outbound").alias("p", "m")).select(F.lit(1).alias("part"), "p", "m.id", F.lit("outbound").alias("direction"), F.lit(None).cast("string").alias("lang"), F.col("m.kind").alias("theme"), F.col("m.brief").alias("text"))
    return a.unionByName(b).withColumn("pos", F.row_number().over(Window.orderBy("part", "p")) - 1).drop("part", "p")  # a fixture's few tasks


PROVENANCE = ["run_id", "config_hash", "git_commit", "git_dirty"]


def untraceable(rows: DataFrame, fields: list[str] = PROVENANCE) -> DataFrame:
    """Rows that lack a field, with the names of those they lack; a missing column counts as null."""
    lacks = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) if f in rows.columns else F.lit(f) for f in fields)), lambda x: x.isNotNull())
    return rows.withColumn("missing", F.concat_ws(",", lacks)).where("missing <> ''")


def write_results(rows: DataFrame, path: str, fields: list[str] = PROVENANCE) -> None:
    """Write results as JSON, or refuse before anything is written if a row can't be traced."""
    if not untraceable(rows, fields).isEmpty():
        raise ValueError("rows without provenance: nothing written")
    rows.write.mode("overwrite").json(path)
