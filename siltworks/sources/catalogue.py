"""Catalogues: listings of files as items, still or sequence, train or test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions.hashing import draw, short_id
from siltworks.functions.text import ORIGINAL, is_clean, natural_key, path_tokens
from siltworks.operators.prefix import with_running

#: File name extensions of images.
IMAGES = "png jpg jpeg bmp webp tif tiff ppm".split()


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length`` of all files under a folder, by Spark's own listing; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", "length")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def image_files(files: DataFrame) -> DataFrame:
    """Visible files with an image's extension."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    return files.where(extension.isin(IMAGES) & ~name.startswith("."))


def capped_folders(files: DataFrame, cap: int, seed: int) -> DataFrame:
    """Files of whole folders, in an order by hash of the folder, until ``cap`` is reached; none is cut in half."""
    dirs = files.withColumn("folder", folder_of(F.col("path"))).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    ordered = with_running(dirs, [draw(F.col("folder"), seed), F.col("folder")], {"upto": F.col("n")})
    taken = ordered.where(F.col("upto") - F.col("n") < cap).select("folder")
    return files.withColumn("folder", folder_of(F.col("path"))).join(taken, "folder", "left_semi")


def shallowest(files: DataFrame, name: str, depth: int = 4) -> DataFrame:
    """The first file of a name, at the least depth and then in order; no row if there is none above ``depth``."""
    at = F.size(F.split("path", "/")) - 1
    found = files.where((F.element_at(F.split("path", "/"), -1) == name) & (at < depth))
    return found.agg(F.min_by("path", F.struct(at, F.col("path"))).alias("path")).where("path IS NOT NULL")


def only_originals(files: DataFrame, source: str) -> DataFrame:
    """If any file of a source is marked as an original, only those that are."""
    marked = F.arrays_overlap(path_tokens(F.col("path")), F.array(*[F.lit(x) for x in ORIGINAL]))
    some = files.withColumn("__hr", marked)
    any_marked = some.groupBy(source).agg(F.bool_or("__hr").alias("__any"))
    return some.join(F.broadcast(any_marked), source).where("NOT __any OR __hr").drop("__hr", "__any")


def item_id(source: Column, group: Column, first_frame: Column) -> Column:
    return F.concat_ws("/", source, group, short_id(first_frame))


def stills(files: DataFrame, source: str) -> DataFrame:
    """One item a file."""
    group = folder_of(F.col("path"))
    return files.select(
        item_id(F.col(source), group, F.col("path")).alias("item_id"), F.col(source).alias("source"), F.lit("still").alias("kind"),
        F.concat_ws(":", F.col(source), group).alias("group"), F.array("path").alias("frames"), F.lit(1).cast("long").alias("n_frames"),
    )


def sequences(files: DataFrame, source: str, min_frames: int = 3) -> DataFrame:
    """One item a folder with ``min_frames`` files or more, its frames in natural order."""
    folder = folder_of(F.col("path"))
    frames = F.transform(F.array_sort(F.collect_list(F.struct(natural_key(F.col("path")).alias("k"), F.col("path").alias("p")))), lambda x: x["p"])
    per = files.withColumn("folder", folder).groupBy(F.col(source).alias("source"), "folder").agg(frames.alias("frames"))
    per = per.where(F.size("frames") >= min_frames)
    return per.select(
        item_id(F.col("source"), F.col("folder"), F.get("frames", F.lit(0))).alias("item_id"), "source", F.lit("seq").alias("kind"),
        F.concat_ws(":", "source", "folder").alias("group"), "frames", F.size("frames").cast("long").alias("n_frames"),
    )


def catalogue(files: DataFrame, source: str, kind: str, test_folders: Sequence[str] = ()) -> DataFrame:
    """Clean files as items with their role: test where a part of the path is a test folder."""
    clean = only_originals(files.where(is_clean(path_tokens(F.col("path")))), source)
    items = stills(clean, source) if kind == "still" else sequences(clean, source)
    parts = F.split(F.get("frames", F.lit(0)), "/")
    tested = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in test_folders]).cast("array<string>"))
    return items.withColumn("role", F.when(tested, "test").otherwise("train"))


def test_list(lines: DataFrame, listed: DataFrame, name: str, seed: int, max_items: int) -> DataFrame:
    """Distinct trimmed names of a list in hash order, at most ``max_items``, and of those the ones that exist."""
    names = lines.select(F.trim("value").alias(name)).where(f"{name} <> ''").distinct()
    return names.orderBy(draw(F.col(name), seed), name).limit(max_items).join(listed.select(name), name, "left_semi")


def paired_frames(frames: DataFrame, flows: DataFrame) -> DataFrame:
    """``scene, variant, frames, flows`` from ``(scene, variant, stem, path)`` and ``(scene, stem, path)``, in order, without the last frame."""
    both = frames.alias("f").join(flows.alias("w"), F.expr("f.scene = w.scene AND f.stem = w.stem"), "left")
    both = both.select("f.scene", "f.variant", "f.stem", F.col("f.path").alias("frame"), F.col("w.path").alias("flow"))
    rows = both.groupBy("scene", "variant").agg(F.array_sort(F.collect_list(F.struct("stem", "frame", "flow"))).alias("rows"))
    rows = rows.withColumn("rows", F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))))
    return rows.select("scene", "variant", F.transform("rows", lambda r: r["frame"]).alias("frames"), F.transform("rows", lambda r: r["flow"]).alias("flows"))


def balanced_clips(members: DataFrame, high: str, low: str, least: int = 3) -> DataFrame:
    """Clips with ``least`` high-resolution frames or more and as many low-resolution ones."""
    per = members.groupBy("town", "clip").agg(
        F.count_if(F.col("res") == high).alias("n_high"), F.count_if(F.col("res") == low).alias("n_low")
    )
    return per.where((F.col("n_high") >= least) & (F.col("n_high") == F.col("n_low")))


def reachable(manifest: DataFrame, there: DataFrame, probes: int = 3) -> DataFrame:
    """``source, reachable``: whether any first frame of a source's first items exists."""
    line = Window.partitionBy("source").orderBy("item_id")
    first = manifest.withColumn("__at", F.row_number().over(line)).where(F.col("__at") <= probes)
    first = first.select("source", F.get("frames", F.lit(0)).alias("path"))
    found = first.join(there.select("path").distinct().withColumn("__there", F.lit(True)), "path", "left")
    return found.groupBy("source").agg(F.bool_or(F.coalesce("__there", F.lit(False))).alias("reachable"))


def select_items(manifest: DataFrame, split: str, sources: Sequence[str] = (), kinds: Sequence[str] = (), min_frames: int = 1) -> DataFrame:
    """Items of a split by source, kind and length; an empty list allows all."""
    out = manifest.where((F.col("split") == split) & (F.col("n_frames") >= min_frames))
    out = out.where(F.col("source").isin(list(sources))) if sources else out
    return out.where(F.col("kind").isin(list(kinds))) if kinds else out


def without_strides(items: DataFrame) -> DataFrame:
    """Items whose frames are consecutive: the stride is unknown, 0 or 1."""
    return items.where(F.coalesce(F.nullif(F.col("frame_stride"), F.lit(0)), F.lit(1)) <= 1)


def dataset_root(spark: SparkSession, root: str, owner: str, name: str) -> str | None:
    """The folder of a mounted data set: one of three layouts, else any folder of its name two levels down.

    Paths are resolved by Hadoop's file system on the driver, so any store that Spark reads will do.
    """
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for tail in (name, f"datasets/{owner}/{name}", f"datasets/{name}"):
        if fs.exists(make(f"{root}/{tail}")):
            return f"{root}/{tail}"
    for glob in (f"{root}/{name}", f"{root}/*/{name}"):
        found = fs.globStatus(make(glob))
        hits = sorted(str(f.getPath().toUri().getPath()) for f in (found or []) if f.isDirectory())
        if hits:
            return hits[0]
    return None
