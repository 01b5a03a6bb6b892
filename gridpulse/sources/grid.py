"""Grid reference: GeoJSON FeatureCollection to (grid_id, geometry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpulse.functions.checks import check_rows, require, zero
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.schemas import EXPECTED_GRIDS, GRID_RANGE
from gridpulse.sources import sinks

_FEATURE = "struct<properties:struct<cellId:string>,geometry:string>"
_FILE, _BLOCK = "file", "block"


def _less(text: Column, characters: str) -> Column:
    """How many of the characters the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _before(blocks: DataFrame, *columns: str) -> list[Column]:
    """Sums over the earlier blocks of a file; one row a block, so a file is a short partition."""
    earlier = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in columns]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The documents cut behind every closing brace, with the nesting at both ends of a piece.

    The text source cuts records at the brace as it cuts lines, so byte ranges of a document are
    read by several tasks. A piece changes the state of the reader (inside a string or not) by the
    parity of its quotes, and the depth by its brackets outside strings: prefix sums inside a byte
    range and over the ranges of a file give both for every piece. No escape reaches over a brace.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    bare = F.regexp_replace("piece", r"\\.", "")
    pieces = lines.select(
        F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("piece"),
    ).withColumn("quotes", _less(bare, '"'))
    upto = Window.partitionBy(_FILE, _BLOCK).orderBy("at")
    pieces = pieces.withColumn("parity", (F.sum("quotes").over(upto) - F.col("quotes")) % 2)

    def change(base: int) -> Column:
        """Change of depth if the block begins outside (0) or inside (1) a string."""
        outside = F.filter(F.split(bare, '"'), lambda s, i: (i + F.col("parity") + base) % 2 == 0)
        text = F.array_join(outside, "")
        closed = ((F.col("parity") + F.col("quotes") + base) % 2 == 0).cast("int")
        return _less(text, "{[") - _less(text, "}]") - closed

    pieces = sinks.stage_table(pieces.withColumns({"change0": change(0), "change1": change(1)}), "pieces")
    blocks = pieces.groupBy(_FILE, _BLOCK).agg(*[F.sum(c).alias(c) for c in ("quotes", "change0", "change1")])
    blocks = blocks.withColumn("base", _before(blocks, "quotes")[0] % 2)
    blocks = blocks.withColumn("moved", F.when(F.col("base") == 0, F.col("change0")).otherwise(F.col("change1")))
    blocks = blocks.select(_FILE, _BLOCK, "base", _before(blocks, "moved")[0].alias("level"))
    change_here = F.when(F.col("base") == 0, F.col("change0")).otherwise(F.col("change1"))
    inside = (F.col("parity") + F.col("quotes") + F.col("base")) % 2
    return (
        pieces.join(broadcast_if_small(blocks), [_FILE, _BLOCK])
        .withColumn("change", change_here)
        .withColumn("depth", F.col("level") + F.sum("change").over(upto))
        .select(
            _FILE, _BLOCK, "at", "piece", (F.col("depth") - F.col("change")).alias("depth_before"),
            ((F.col("depth") == 2) & (inside == 0)).cast("int").alias("ends"),
        )
        .filter((F.col("depth_before") > 0) | (F.trim(F.regexp_replace("piece", r"\s", "")) != ""))
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: collection_type, cell_id (text), geometry (compact JSON text).

    A document is read by byte ranges in several tasks (compressed files by one). An object that
    closes into an array of the root is an element of it; those of ``features`` are rows, those of
    other root arrays are not. What is left of a document without these objects is small and gives
    its type, before or behind the features. A document without features is one row of NULLs with
    its type; features that are no objects give no rows; an object or a document that does not
    parse has NULLs. Not told apart: a root member *before* the features with arrays of objects at
    a greater depth; its first feature then does not parse and fails the reference checks.
    """
    pieces = sinks.stage_table(_pieces(spark, path), "pieces")
    upto = Window.partitionBy(_FILE, _BLOCK).orderBy("at")
    blocks = pieces.groupBy(_FILE, _BLOCK).agg(F.sum("ends").alias("ends"))
    blocks = blocks.select(_FILE, _BLOCK, _before(blocks, "ends")[0].alias("earlier"))
    parts = (
        pieces.join(broadcast_if_small(blocks), [_FILE, _BLOCK])
        .withColumn("part", F.col("earlier") + F.sum("ends").over(upto) - F.col("ends"))
        .groupBy(_FILE, "part")
        .agg(
            F.sort_array(F.collect_list(F.struct(_BLOCK, "at", "piece", "depth_before"))).alias("held"),
            F.max("ends").alias("ends"),
        )
        .select(
            _FILE, "part", "ends", F.concat(F.array_join("held.piece", "}"), F.lit("}")).alias("text"),
            (F.col("held")[0]["depth_before"] == 2).alias("goes_on"),
        )
    )
    next_element, first_element = r'^[^\[{"]*(?=\{)', r'(?s)^(.*?(?<!\\)"([^"\\]*)"\s*:\s*\[)[^\[{"]*(\{.*)$'
    plain = F.col("goes_on") & F.col("text").rlike(next_element)
    found = lambda k: F.regexp_extract("text", first_element, k)
    opens = (F.col("ends") == 1) & ~plain & F.col("text").rlike(first_element)
    element = F.when(opens, found(3)).when((F.col("ends") == 1) & plain, F.regexp_replace("text", next_element, ""))
    parts = sinks.stage_table(
        parts.select(
            _FILE, "part", element.alias("element"),
            F.when(opens, found(2)).alias("key"),
            F.when(opens, found(1))
            .when((F.col("ends") == 0) | ~plain, F.regexp_replace("text", r'^[^\[\]{}"]*(?=\])', ""))
            .alias("rest"),
        ),
        "features",
    )
    # one row a document: few parts hold something besides an element
    rest = F.sort_array(F.collect_list(F.when(F.col("rest").isNotNull(), F.struct("part", "rest", "key"))))
    documents = parts.groupBy(_FILE).agg(rest.alias("rests")).select(
        _FILE, "rests", F.get_json_object(F.array_join("rests.rest", ""), "$.type").alias("collection_type")
    )
    array = F.element_at(F.filter("rests", lambda r: (r["part"] <= F.col("part")) & r["key"].isNotNull()), -1)["key"]
    features = (
        parts.filter("element is not null")
        .join(broadcast_if_small(documents.select(_FILE, "rests")), _FILE)
        .filter(array == "features")
        .select(_FILE, F.from_json("element", _FEATURE).alias("f"))
    )
    return documents.join(features, _FILE, "left").select(
        "collection_type", F.col("f.properties.cellId").alias("cell_id"), F.col("f.geometry").alias("geometry")
    )


def grid_lookup(features: DataFrame) -> DataFrame:
    """(grid_id, geometry); keyed by ``properties.cellId``."""
    return features.select(
        F.expr("try_cast(cell_id as int)").alias("grid_id"),
        F.when(F.col("geometry") != "null", F.col("geometry")).alias("geometry"),
    )


def reference_checks(
    features: DataFrame, expected: int = EXPECTED_GRIDS, grids: tuple[int, int] = GRID_RANGE
) -> DataFrame:
    """Validation of the reference as check rows, from one aggregate."""
    grid = F.expr("try_cast(cell_id as int)")
    stats = features.agg(
        F.count_if(F.coalesce(F.col("collection_type") != "FeatureCollection", F.lit(True))).alias(
            "not_collection"
        ),
        F.count("*").alias("features"),
        F.count_if(F.col("cell_id").isNull()).alias("missing_id"),
        F.count_if(F.col("cell_id").isNotNull() & grid.isNull()).alias("invalid_id"),
        F.count_if((grid < grids[0]) | (grid > grids[1])).alias("out_of_range"),
        F.count_distinct(grid).alias("distinct_ids"),
    )
    return check_rows(
        stats,
        {
            "feature_collection": zero("not_collection"),
            "feature_count": (F.col("features"), F.col("features") == expected),
            "missing_cell_id": zero("missing_id"),
            "invalid_cell_id": zero("invalid_id"),
            "cell_id_range": zero("out_of_range"),
            "distinct_ids": (F.col("distinct_ids"), F.col("distinct_ids") == expected),
        },
    )


def load_grid_lookup(
    spark: SparkSession, path: str, expected: int = EXPECTED_GRIDS
) -> DataFrame:
    features = read_features(spark, path)
    require(reference_checks(features, expected))
    return grid_lookup(features)


def square_cell(grid_id, side: float = 0.002, columns: int = 100):
    """Closed square Polygon text of a cell on a regular grid (for generated references)."""
    column = (grid_id - 1) % columns
    row = F.floor((grid_id - 1) / columns)
    west, south = F.lit(9.0) + column * side, F.lit(45.0) + row * side
    east, north = west + side, south + side
    corners = [west, south, east, south, east, north, west, north, west, south]
    points = ",".join(["[%.6f,%.6f]"] * 5)
    return F.format_string('{"type":"Polygon","coordinates":[[' + points + "]]}", *corners)
