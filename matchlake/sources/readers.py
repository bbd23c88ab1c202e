"""Reading runs, seasons and labels. A run is a folder with job.json, tracks.jsonl, events.jsonl, shots.jsonl and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from matchlake.functions.exprs import team_number
from matchlake.schemas import schema

CORRUPT = "_corrupt_record"


def _run_id() -> Column:
    """Name of the folder that holds the file a row came from."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)


def exists(spark: SparkSession, pattern: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lenient(spark: SparkSession, pattern: str, table: str) -> DataFrame:
    """JSON lines of all files; lines that are no objects are left out, and missing files are an empty table. Adds ``run``."""
    kind = schema(table)
    if not exists(spark, pattern):
        return spark.createDataFrame([], StructType([*kind.fields, StructField("run", StringType())]))
    wide = StructType([*kind.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = spark.read.text(pattern).where(F.trim("value") != "").select(parsed.alias("r"), _run_id().alias("run"))
    return rows.where(F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select(*[f"r.{f.name}" for f in kind], "run")


def strict(spark: SparkSession, pattern: str, table: str) -> DataFrame:
    """JSON lines of all files; a bad line fails the read."""
    return spark.read.schema(schema(table)).option("mode", "FAILFAST").json(pattern).withColumn("run", _run_id())


def document(spark: SparkSession, pattern: str, table: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema(table)).option("multiLine", True).json(pattern).withColumn("run", _run_id())


def runs(spark: SparkSession, root: str) -> list[str]:
    """Runs below a root, or the root itself, that hold tracks; a folder listing, not data."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(f"{root}/tracks.jsonl")):
        return [root]
    return sorted(str(s.getPath().getParent().toString()) for s in fs.globStatus(p(f"{root}/*/tracks.jsonl")) or [])


def load_run_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of all runs below ``root``, each row with the job_id of its run."""
    jobs = document(spark, f"{root}/*/job.json", "jobs") if exists(spark, f"{root}/*/job.json") else lenient(spark, f"{root}/*/job.json", "jobs")
    out = {"jobs": jobs}
    ids = jobs.select("run", F.col("job_id").alias("own_job"), F.col("match_id").alias("own_match"))
    for table, file in (("tracks", "tracks.jsonl"), ("events", "events.jsonl"), ("shots", "shots.jsonl"), ("goal_entries", "goal_entries.jsonl"), ("corrections", "corrections.jsonl")):
        rows = lenient(spark, f"{root}/*/{file}", table).join(ids, "run", "left")
        rows = rows.withColumn("job_id", F.coalesce("job_id", "own_job"))
        out[table] = (rows.withColumn("match_id", F.coalesce("match_id", "own_match")) if "match_id" in rows.columns else rows).drop("own_job", "own_match")
    return out


def seasons(spark: SparkSession, pattern: str) -> DataFrame:
    """Season rules, one small file a year. A year without a file has no row, and nothing stands in for it."""
    return document(spark, pattern, "seasons").drop("run")


def geometry(spark: SparkSession, pattern: str) -> DataFrame:
    """Field geometry, one small file a year, with the own hub's place in columns."""
    kind = StructType.fromDDL(
        "season int, field_length_ft double, field_width_ft double, hubs struct<own_hub:struct<x:double,y:double>>,"
        " zones array<struct<id:string,x_min:double,x_max:double>>, lanes array<struct<id:string,y_min:double,y_max:double>>"
    )
    g = spark.read.schema(kind).option("multiLine", True).json(pattern)
    return g.select("season", "field_length_ft", "field_width_ft", "zones", "lanes", F.col("hubs.own_hub.x").alias("hub_x"), F.col("hubs.own_hub.y").alias("hub_y"))


def tag_layout(spark: SparkSession, path: str) -> DataFrame:
    """Field tags ``(tag, x_ft, y_ft, z_ft, yaw)`` of a layout in metres; yaw from the quaternion."""
    kind = StructType.fromDDL(
        "tags array<struct<ID:int,pose:struct<translation:struct<x:double,y:double,z:double>,rotation:struct<quaternion:struct<W:double,X:double,Y:double,Z:double>>>>>"
    )
    t = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("tags").alias("t"))
    q, at, feet = "t.pose.rotation.quaternion.", "t.pose.translation.", 1 / 0.3048
    yaw = F.atan2(2 * (F.col(q + "W") * F.col(q + "Z") + F.col(q + "X") * F.col(q + "Y")), 1 - 2 * (F.col(q + "Y") ** 2 + F.col(q + "Z") ** 2))
    return t.select(F.col("t.ID").alias("tag"), *[(F.col(at + c) * feet).alias(f"{c}_ft") for c in "xyz"], yaw.alias("yaw"))


def tag_observations(observed: DataFrame, layout: DataFrame) -> DataFrame:
    """Seen tags with their field places, those of the most frequent height only."""
    both = observed.join(F.broadcast(layout), "tag").withColumn("height", F.bround("z_ft", 2))
    top = both.groupBy("frame_id", "height").count().groupBy("frame_id").agg(F.max_by("height", F.struct("count", (-F.col("height")))).alias("height"))
    return both.join(top, ["frame_id", "height"])


def label_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``stem, value`` of label text files."""
    return spark.read.text(pattern).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


def coco_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, width, height, category, x, y, w, h`` in pixels of one annotation document."""
    kind = StructType.fromDDL(
        "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,category_id:int,bbox:array<double>>>, categories array<struct<id:int,name:string>>"
    )
    doc = spark.read.schema(kind).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    boxes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("id"), "a.category_id", *[F.get("a.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")])
    return boxes.join(images, "id").join(F.broadcast(names), "category_id").select("file_name", "width", "height", "category", *"xywh")


def first_of(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``primary``, and those of ``fallback`` whose key it lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def official_results(matches: DataFrame) -> DataFrame:
    """``match_id, red, blue`` teams and scores of landed match documents; a side without three teams, or a score of -1, is null.

    ``matches (key, alliances struct<red struct<team_keys, score>, blue ...>)``.
    """

    def side(s: str) -> Column:
        teams = F.transform(F.col(f"alliances.{s}.team_keys"), team_number)
        return F.when(F.size(teams) == 3, teams).alias(s)

    score = lambda s: F.when(F.col(f"alliances.{s}.score") >= 0, F.col(f"alliances.{s}.score"))
    both = matches.select(F.col("key").alias("match_id"), side("red"), side("blue"), score("red").alias("r"), score("blue").alias("b"))
    whole = F.col("red").isNotNull() & F.col("blue").isNotNull()
    return both.select(
        "match_id", F.when(whole, F.struct("red", "blue")).alias("alliances"),
        F.when(F.col("r").isNotNull() & F.col("b").isNotNull(), F.struct(F.col("r").alias("red"), F.col("b").alias("blue"))).alias("tba_score"),
    )


def match_of_video(matches: DataFrame, video: str) -> DataFrame:
    """The first match, by key, that lists a video; ``matches (key, videos array<struct<type, key>>)``."""
    v = matches.select("key", F.explode("videos").alias("v")).where("v.type = 'youtube'")
    return v.where(F.split("v.key", r"\?")[0] == video).orderBy("key").limit(1).select(F.col("key").alias("match_id"))


def usable(frames: DataFrame) -> DataFrame:
    """Frames not marked as of bad quality."""
    return frames.where(F.coalesce("quality_ok", F.lit(True)))


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1, **options: str) -> DataFrame:
    """A database table, read in ``partitions`` ranges of a numeric column; old ``postgres://`` URLs are accepted."""
    url = "jdbc:postgresql://" + url.split("://", 1)[1] if url.startswith(("postgres://", "postgresql://")) else url
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()
