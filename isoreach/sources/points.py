"""Readers: point tables under their usual column names, graphs in GraphML, raster cells in ASCII grids, nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Column names that are understood, in order of preference.
LON = ["longitude", "lon", "lng", "long", "x", "xcoord"]
LAT = ["latitude", "lat", "y", "ycoord"]
WEIGHT = ["population", "demand", "weight", "headcount"]
POPULATION = ["population", "pop", "population_count", "population_estimate", "population_2020", "value"]


def _first(df: DataFrame, names: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((lower[n] for n in names if n in lower), None)


def normalised_points(rows: DataFrame, id_col: str | None = None, weights: Sequence[str] = WEIGHT) -> DataFrame:
    """(id string, lon, lat, weight) of a table that uses any of the known names; a weight is 1 where there is no
    column for it. Rows without a place within the degrees are left out. Without id_col, an id is hashed from the row."""
    lon, lat = _first(rows, LON), _first(rows, LAT)
    if lon is None or lat is None:
        raise ValueError(f"no longitude or latitude among {rows.columns}")
    weight = _first(rows, weights)
    key = F.col(id_col).cast("string") if id_col else F.hex(F.xxhash64(*[F.col(c) for c in rows.columns]))
    out = rows.select(key.alias("id"), F.expr(f"try_cast(`{lon}` as double)").alias("lon"), F.expr(f"try_cast(`{lat}` as double)").alias("lat"), (F.expr(f"try_cast(`{weight}` as double)") if weight else F.lit(1.0)).alias("weight"))
    return out.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


def read_points(spark: SparkSession, path: str, id_col: str | None = None, weights: Sequence[str] = WEIGHT) -> DataFrame:
    """A point table by the suffix of its path: .csv (also gzipped), .parquet, .json lines or .geojson of points."""
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        rows = spark.read.option("header", True).csv(path)
    elif name.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif name.endswith(".geojson"):
        rows = geojson_points(spark, path)
    elif name.endswith((".json", ".jsonl")):
        rows = spark.read.json(path)
    else:
        raise ValueError(f"unknown kind of point table: {path}")
    return normalised_points(rows, id_col, weights)


def population_points(spark: SparkSession, path: str, threshold: float | None = None) -> DataFrame:
    """Points whose population is above 0, or at least the threshold if one is given."""
    rows = read_points(spark, path, weights=POPULATION)
    return rows.where(F.col("weight") > 0 if threshold is None else F.col("weight") >= threshold)


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """The point features of a FeatureCollection: properties with lon and lat."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    return features.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lon, lat) and edges (u, v, length, highway, maxspeed, oneway) of GraphML, whose
    attributes are strings under declared keys."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    # a file declares a few keys
    named = {(r["_for"], r["_attr.name"]): r["_id"] for r in read("key", "_id string, _for string, `_attr.name` string").collect()}
    data = "data array<struct<_VALUE string, _key string>>"

    def attr(kind: str, name: str) -> Column:
        key = named.get((kind, name))
        return F.get(F.filter("data", lambda x: x["_key"] == F.lit(key)), F.lit(0))["_VALUE"] if key else F.lit(None).cast("string")

    nodes = read("node", f"_id long, {data}").select(F.col("_id").alias("node_id"), attr("node", "x").cast("double").alias("lon"), attr("node", "y").cast("double").alias("lat"))
    edges = read("edge", f"_source long, _target long, {data}").select(F.col("_source").alias("u"), F.col("_target").alias("v"), attr("edge", "length").cast("double").alias("length"), *[attr("edge", n).alias(n) for n in ("highway", "maxspeed", "oneway")])
    return nodes, edges


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells (row, col, lon, lat, value) of an ASCII grid, at their centres, without nodata. A file is one
    row of text, so a country's grid should be cut into tiles; tiles are read side by side."""
    files = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\s*\n").alias("lines"))
    head = F.map_from_entries(F.transform(F.filter("lines", lambda x: x.rlike(r"^\s*[A-Za-z]")), lambda x: F.struct(F.lower(F.split(F.trim(x), r"\s+")[0]).alias("k"), F.split(F.trim(x), r"\s+")[1].cast("double").alias("v"))))
    body = F.filter("lines", lambda x: x.rlike(r"^\s*[-+.\d]"))
    rows = files.select(head.alias("h"), body.alias("body")).select("h", F.size("body").alias("n"), F.posexplode("body").alias("row", "line"))
    cells = rows.select("h", "n", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    h = lambda k: F.try_element_at(F.col("h"), F.lit(k))
    lon = h("xllcorner") + (F.col("col") + 0.5) * h("cellsize")
    lat = h("yllcorner") + (F.col("n") - F.col("row") - 0.5) * h("cellsize")
    out = cells.select("row", "col", lon.alias("lon"), lat.alias("lat"), F.col("v").cast("double").alias("value"), h("nodata_value").alias("none"))
    return out.where(F.col("none").isNull() | (F.col("value") != F.col("none"))).drop("none")


def flattened(rows: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path; arrays stay."""
    def leaves(kind: StructType, path: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            at = [*path, f.name]
            out += leaves(f.dataType, at) if isinstance(f.dataType, StructType) and not isinstance(f.dataType, ArrayType) else [F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))]
        return out

    return rows.select(*leaves(rows.schema, []))


def distinct_amenities(rows: DataFrame, cell_deg: float = 0.00025) -> DataFrame:
    """One row for each amenity, name in lower case and cell of the place; nodes before ways, then the
    smaller id. Rows without a name share one for each amenity and cell. rows: id, element, amenity, name, lon, lat."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " ")))
    keyed = rows.withColumns({"k_name": F.when(name == "", "__unnamed__").otherwise(name), "k_x": F.floor(F.col("lon") / cell_deg), "k_y": F.floor(F.col("lat") / cell_deg)})
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = keyed.groupBy("amenity", "k_name", "k_x", "k_y").agg(F.min_by(whole, F.struct(F.when(F.col("element") == "node", 0).otherwise(1), "id")).alias("r"))
    return best.select("r.*")
