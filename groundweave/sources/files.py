"""Scene folders, camera files, tie points, height grids, sample groups, result and metric files."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.functions.cameras import DIRECT, INVERSE, SCALARS
from groundweave.operators.sampling import numbered
from groundweave.sources.shared import spread, written

#: Labels of a model file by block, and units of the first ten: fixed by the format.
LABELS = {"lnum": "LINE_NUM_COEFF", "lden": "LINE_DEN_COEFF", "snum": "SAMP_NUM_COEFF", "sden": "SAMP_DEN_COEFF", "latnum": "LAT_NUM_COEFF", "latden": "LAT_DEN_COEFF", "lonnum": "LONG_NUM_COEFF", "londen": "LONG_DEN_COEFF"}
NAMES = {"line": "LINE", "samp": "SAMP", "lat": "LAT", "lon": "LONG", "height": "HEIGHT"}
UNITS = {"line": "pixels", "samp": "pixels", "lat": "degrees", "lon": "degrees", "height": "meters"}
#: Names in the other, bracketed format: fixed by it.
RPB = {"line_off": "lineOffset", "samp_off": "sampOffset", "lat_off": "latOffset", "lon_off": "longOffset", "height_off": "heightOffset", "line_scale": "lineScale", "samp_scale": "sampScale", "lat_scale": "latScale", "lon_scale": "longScale", "height_scale": "heightScale", "lnum": "lineNumCoef", "lden": "lineDenCoef", "snum": "sampNumCoef", "sden": "sampDenCoef"}


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def scene_catalog(spark: SparkSession, root: str, sub: str = "adjust_images", select: str = "-1") -> DataFrame:
    """scene_id, name of the folders under root/sub in order of name; all for '-1', else those at the comma-separated places.

    scene_id is the place after the selection. Only names are read, not the files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{sub}").select("path")
    names = files.select(_folder(F.col("path")).alias("name")).distinct()
    listed = numbered(names, [F.col("name")], "scene_id")
    if select != "-1":
        listed = numbered(listed.where(F.col("scene_id").isin([int(x) for x in select.split(",")])).select("name"), [F.col("name")], "scene_id")
    return listed.select("scene_id", "name")


def ortho_catalog(spark: SparkSession, root: str) -> DataFrame:
    """path, name of the .tif and .tiff files under root, whatever the case of their suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.where(F.lower("path").rlike(r"\.tiff?$")).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(_folder(F.input_file_name()).alias("name"), F.col("value"))


def _rpc(value: Column, adj: Column) -> Column:
    """The model struct of an array of at least 90 numbers."""
    block = lambda i: F.when(F.size(value) >= 30 + 20 * i, F.slice(value, 11 + 20 * i, 20))
    return F.struct(*(value[i].alias(k) for i, k in enumerate(SCALARS)), *(block(i).alias(k) for i, k in enumerate((*DIRECT, *INVERSE))), adj.alias("adj"))


def read_rpc_text(spark: SparkSession, path: str) -> DataFrame:
    """name (of the folder), rpc of model files: one `KEY: value [unit]` a line, read by position.

    Files of fewer than 170 values have no inverse blocks (inverse_rpc_fit makes them). With a block
    RFM_CORRECTION_PARAMETERS the line before it is left out as well, and its six values become the affine.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "")
    marked = _texts(spark, path).select("name", lines.alias("l")).withColumn("at", F.array_position(F.transform("l", lambda s: F.contains(s, F.lit("RFM_CORRECTION_PARAMETERS"))), True).cast("int"))
    number = lambda s: F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(2)).cast("double")
    head = F.when(F.col("at") > 1, F.slice("l", F.lit(1), F.greatest(F.col("at") - 2, F.lit(0)))).otherwise(F.col("l"))
    tail = F.when(F.col("at") > 0, F.slice("l", F.col("at") + 1, F.lit(6)))
    from groundweave.functions.geometry import affine_from_offsets

    values = marked.select("name", F.transform(head, number).alias("v"), F.transform(tail, number).alias("o"))
    adj = F.when(F.size("o") == 6, affine_from_offsets(F.col("o"))).otherwise(F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))))
    return values.where(F.size("v") >= 90).select("name", _rpc(F.col("v"), adj).alias("rpc"))


def read_rpb(spark: SparkSession, path: str) -> DataFrame:
    """name (of the folder), rpc of bracketed model files: `key = value;` and `key = ( .. );` lists of twenty."""
    text = F.col("value")
    after = lambda k: F.element_at(F.split(text, rf"\b{RPB[k]}\s*="), -1)
    number = lambda x: F.trim(F.regexp_replace(x, r"\s", "")).try_cast("double")
    scalars = [number(F.split_part(after(k), F.lit(";"), F.lit(1))) for k in SCALARS]
    listed = lambda k: F.split(F.split_part(F.split_part(after(k), F.lit("("), F.lit(2)), F.lit(")"), F.lit(1)), ",")
    blocks = [F.transform(listed(k), number) for k in DIRECT]
    read = _texts(spark, path).select("name", F.concat(F.array(*scalars), *blocks).alias("v"))
    return read.select("name", _rpc(F.col("v"), F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))).alias("rpc"))


def rpc_lines(rpc: str = "rpc") -> Column:
    """The text of a model file: 170 labelled lines, the first ten with units."""
    first = [F.concat(F.lit(f"{NAMES[k.split('_')[0]]}_{'OFF' if k.endswith('off') else 'SCALE'}: "), F.col(f"{rpc}.{k}").cast("string"), F.lit(" " + UNITS[k.split("_")[0]])) for k in SCALARS]
    numbered = lambda label: lambda x, i: F.concat(F.lit(f"{label}_"), (i + 1).cast("string"), F.lit(": "), x.cast("string"))
    blocks = [F.array_join(F.transform(F.col(f"{rpc}.{k}"), numbered(LABELS[k])), "\n") for k in (*DIRECT, *INVERSE)]
    return F.concat_ws("\n", *first, *blocks)


def write_rpc_text(scenes: DataFrame, path: str) -> None:
    """One file for each scene (name, rpc) under path/scene_key=name, slashes in names as underscores."""
    keyed = scenes.select(F.replace("name", F.lit("/"), F.lit("_")).alias("scene_key"), rpc_lines().alias("value"))
    spread(keyed, "scene_key").write.mode("overwrite").partitionBy("scene_key").text(path)


def read_tie_points(spark: SparkSession, path: str) -> DataFrame:
    """name, tie_id, line, samp of tie point files: two whole numbers a row, the row's place is the tie's id. Files with
    another number of columns give no rows."""
    lines = F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "")
    rows = _texts(spark, path).select("name", F.transform(lines, lambda s: F.split(F.trim(s), r"\s+")).alias("r")).where(~F.exists("r", lambda x: F.size(x) != 2))
    return rows.select("name", F.posexplode("r").alias("tie_id", "p")).select("name", F.col("tie_id").cast("long"), F.col("p")[0].cast("double").cast("long").alias("line"), F.col("p")[1].cast("double").cast("long").alias("samp"))


def read_dem_tiles(spark: SparkSession, path: str, tile: int = 256, usgs: bool = False) -> DataFrame:
    """name, tile_r, tile_c, h, w, v (array of floats by row) of the height grids dem.npy, or dem_usgs.npy where asked and there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "dem*.npy").load(path)
    named = files.select(_folder(F.col("path")).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    wanted = named.where(F.col("file").isin(["dem.npy", "dem_usgs.npy"] if usgs else ["dem.npy"]))
    chosen = wanted.groupBy("name").agg(F.max_by("content", "file").alias("content"))  # dem_usgs.npy sorts after dem.npy

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                grid = np.load(io.BytesIO(content)).astype("float32")
                for r in range(0, grid.shape[0], tile):
                    for c in range(0, grid.shape[1], tile):
                        part = grid[r : r + tile, c : c + tile]
                        yield pd.DataFrame({"name": [name], "tile_r": [r // tile], "tile_c": [c // tile], "h": [part.shape[0]], "w": [part.shape[1]], "v": [part.ravel()]})

    return chosen.mapInPandas(cut, "name string, tile_r int, tile_c int, h int, w int, v array<float>")


def write_dem(grids: DataFrame, path: str) -> None:
    """One dem.npy for each grid (name, h, w, v by row) under path/name. A task that runs again writes the same bytes."""

    def save(rows: Iterator) -> None:
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(path)
        for row in rows:
            content = io.BytesIO()
            np.save(content, np.array(row["v"], "float32").reshape(row["h"], row["w"]))
            at.create_dir(f"{root}/{row['name']}")
            with at.open_output_stream(f"{root}/{row['name']}/dem.npy") as f:
                f.write(content.getvalue())

    grids.foreachPartition(save)


def append_sample_groups(groups: DataFrame, images: DataFrame, parallax: DataFrame, path: str) -> None:
    """Appends groups (group_id and their attributes), images and sparse parallax under path, by group. Groups that are
    there already are left as they are. The table of groups is written last, so a group that it names is whole."""
    spark = groups.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/groups")
    there = None
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.schema(groups.schema).parquet(f"{path}/groups").select("group_id").distinct()
    for name, df in (("group_images", images), ("parallax", parallax), ("groups", groups)):
        new = df if there is None else df.join(there, "group_id", "left_anti")
        new.write.mode("append").partitionBy("group_id").parquet(f"{path}/{name}")


#: The attributes that every group has: fixed by the format.
ATTRIBUTES = {
    "processing_crs": "string", "window_bounds": "array<double>", "window_size_m": "double", "output_size_px": "int",
    "resolution_m_per_px": "double", "global_indices": "array<bigint>", "source_paths": "array<string>", "complete": "boolean",
}
_PARTS = ("groups", "images", "parallax")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_checked_groups(groups: DataFrame, images: DataFrame, parallax: DataFrame, path: str, min_cover: int = 2) -> DataFrame:
    """Appends whole, checked groups under path in two phases, and returns group_id, violation (null if it was taken in) of each given group.

    groups: group_id and ATTRIBUTES; images and parallax: group_id, img, h, w, v (array of h * w values). First the new groups' rows are written
    to a folder of this run's own; then what was written is checked; last the run's manifest names the groups that hold: images and
    parallax have the same keys 0..n-1, n at least min_cover, one shape in a pair and as many values as it says, every attribute is there, indices and
    paths are as many as images, complete is true and the resolution is the size by the pixels. A reader sees what manifests name alone,
    so a group that fails, or a run that ends early, leaves nothing to be seen. Groups that a manifest names already are left as they are
    ("exists"), as is a group_id that is given twice ("given twice").
    """
    spark = groups.sparkSession
    run = uuid.uuid4().hex
    staged = f"{path}/runs/run={run}"
    there = None
    if _there(spark, f"{path}/manifest"):
        there = spark.read.parquet(f"{path}/manifest").select("group_id").distinct()
    for name, df in zip(_PARTS, (groups, images, parallax), strict=True):
        new = df if there is None else df.join(there, "group_id", "left_anti")
        new.write.parquet(f"{staged}/{name}")
    g, i, p = (spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in zip(_PARTS, (groups, images, parallax), strict=True))
    once = i.groupBy("group_id", "img").agg(F.count("*").alias("a"), F.max(F.struct("h", "w", F.size("v").alias("n"))).alias("x"))
    other = p.groupBy("group_id", "img").agg(F.count("*").alias("b"), F.max(F.struct("h", "w", F.size("v").alias("n"))).alias("y"))
    both = once.join(other, ["group_id", "img"], "full_outer")
    fits = lambda s: F.col(f"{s}.n") == F.col(f"{s}.h") * F.col(f"{s}.w")
    shapes = (F.col("x.h") == F.col("y.h")) & (F.col("x.w") == F.col("y.w")) & fits("x") & fits("y")
    keys = both.groupBy(F.col("group_id").alias("_g")).agg(
        F.min(F.coalesce((F.col("a") == 1) & (F.col("b") == 1), F.lit(False))).alias("same"), F.min(F.coalesce(shapes, F.lit(False))).alias("shaped"),
        F.count("*").alias("n"), F.min("img").alias("first"), F.max("img").alias("last"),
    )
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ATTRIBUTES))
    fields = whole & F.col("complete") & (F.size("window_bounds") == 4) & (F.size("global_indices") == F.col("n")) & (F.size("source_paths") == F.col("n"))
    fields = fields & (F.abs(F.col("resolution_m_per_px") * F.col("output_size_px") - F.col("window_size_m")) <= 1e-9 * F.col("window_size_m"))
    counted = g.join(g.groupBy(F.col("group_id").alias("_of")).agg(F.count("*").alias("_times")), F.col("group_id") == F.col("_of"))
    met = counted.join(keys, F.col("group_id") == F.col("_g"), "left")
    violation = (
        F.when(F.col("_times") > 1, "given twice").when(F.col("n").isNull() | ~F.col("same"), "keys differ").when(F.col("n") < min_cover, "too few images")
        .when((F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "keys not consecutive").when(~F.col("shaped"), "shapes differ").when(~F.coalesce(fields, F.lit(False)), "attributes")
    )
    judged = written(met.select("group_id", violation.alias("violation")).distinct(), "judged-groups")
    judged.where("violation is null").select("group_id", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/manifest")
    if there is None:
        return judged
    old = groups.select("group_id").distinct().join(there, "group_id", "left_semi").select("group_id", F.lit("exists").alias("violation"))
    return judged.unionByName(old)


def read_checked_groups(spark: SparkSession, path: str, images: str, parallax: str, like: str = "group_id long") -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups, images, parallax that the manifests under path name; images and parallax give the schemas of their values (v) and like that of the ids."""
    fields = ", ".join(f"{c} {kind}" for c, kind in ATTRIBUTES.items())
    if not _there(spark, f"{path}/manifest"):
        return tuple(spark.createDataFrame([], f"{like}, {s}") for s in (fields, f"img long, h int, w int, v {images}", f"img long, h int, w int, v {parallax}"))
    named = spark.read.schema(f"{like}, run string").parquet(f"{path}/manifest")

    def part(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(f"{like}, {schema}, run string").option("basePath", f"{path}/runs").parquet(f"{path}/runs/run=*/{name}")
        return rows.join(named, ["group_id", "run"], "left_semi").drop("run")

    return part("groups", fields), part("images", f"img long, h int, w int, v {images}"), part("parallax", f"img long, h int, w int, v {parallax}")


def path_key(path: Column) -> Column:
    """A path as a key: slashes become three underscores."""
    return F.replace(path, F.lit("/"), F.lit("___"))


def results_csv_append(df: DataFrame, path: str, fields: list[str]) -> None:
    """Appends the fields in order: missing ones and nulls empty, others left out, a header in each file."""
    text = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    df.select(*text).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def report_json(global_df: DataFrame, pair_df: DataFrame, params: dict[str, str]) -> DataFrame:
    """value: one JSON document of parameters, the global report and the array of pair reports, which is in order of i, j."""
    pairs = pair_df.agg(F.sort_array(F.collect_list(F.struct("i", "j", *(c for c in pair_df.columns if c not in ("i", "j"))))).alias("pair_reports"))
    whole = global_df.select(F.struct(*global_df.columns).alias("global_report"))
    made = whole.crossJoin(pairs).select(F.struct(*(F.lit(v).alias(k) for k, v in params.items())).alias("parameters"), "global_report", "pair_reports")  # one row each
    return made.select(F.to_json(F.struct("*")).alias("value"))


def normalised_results(df: DataFrame) -> DataFrame:
    """Whole numbers as long, floats as double, booleans as text; other types than these and text are refused."""
    kinds = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double", "boolean": "string", "string": "string"}
    for c, kind in df.dtypes:
        if kind not in kinds:
            raise TypeError(f"column {c} has type {kind}")
    return df.select(*(F.col(f"`{c}`").cast(kinds[kind]).alias(c) for c, kind in df.dtypes))


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Result tables as CSV with a header or JSON lines."""
    writer = normalised_results(df).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def read_results(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def metric_jsonl(df: DataFrame, path: str) -> None:
    """Appends one JSON object a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
