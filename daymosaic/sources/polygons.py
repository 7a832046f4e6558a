"""GeoJSON boundaries to polygon rows, and audits of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymosaic.functions.text import strip

# Property names under which boundary files keep their attributes.
ENTITY_ALIASES = ("entity", "district", "DISTRICT", "District", "lgd_districtname", "dtname", "NAME_2")
REGION_ALIASES = ("region", "state", "STATE_UT", "State", "lgd_statename", "stname", "NAME_1")
CODE_ALIASES = ("code", "DIST_LGD", "lgd_districtcode", "Dist_LGD", "dt_code")

POINT = "struct<x:double,y:double>"
FEATURE = ("struct<type:string,properties:map<string,string>,"
           "geometry:struct<type:string,coordinates:string>>")


def signed_area(ring: Column) -> Column:
    """Twice the shoelace area: positive when counter-clockwise."""
    steps = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: (
        F.get(ring, i - 1)["x"] * F.get(ring, i)["y"]
        - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def orient(ring: Column, outer: Column) -> Column:
    """Outer rings counter-clockwise, holes clockwise."""
    return F.when((signed_area(ring) > 0) == outer, ring).otherwise(F.reverse(ring))


def _first_alias(props: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_element_at(props, F.lit(n)) for n in names])


def read_polygons(spark: SparkSession, path: str,
                  entity_aliases: Sequence[str] = ENTITY_ALIASES,
                  region_aliases: Sequence[str] = REGION_ALIASES,
                  code_aliases: Sequence[str] = CODE_ALIASES) -> DataFrame:
    """(region, entity, code, geometry_type, rings) from GeoJSON files.

    Attribute columns are found by trying the known names in order. Polygons
    and multipolygons both become a flat list of oriented rings.
    """
    raw = spark.read.option("multiLine", True).schema(
        f"type string, features array<{FEATURE}>").json(path)
    f = raw.select(F.explode("features").alias("f")).select(
        F.col("f.properties").alias("p"), F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("c"))
    nested = "array<array<array<array<double>>>>"
    multi = (F.when(F.col("geometry_type") == "MultiPolygon", F.from_json("c", nested))
             .when(F.col("geometry_type") == "Polygon",
                   F.array(F.from_json("c", "array<array<array<double>>>"))))
    ring = lambda pts: F.transform(pts, lambda q: F.struct(
        F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))
    rings = F.flatten(F.transform(multi, lambda poly: F.transform(
        poly, lambda r, i: orient(ring(r), i == 0))))
    return f.select(strip(_first_alias(F.col("p"), region_aliases)).alias("region"),
                    strip(_first_alias(F.col("p"), entity_aliases)).alias("entity"),
                    strip(_first_alias(F.col("p"), code_aliases)).alias("code"),
                    "geometry_type", rings.alias("rings"))


def ring_faults(rings: Column) -> dict[str, Column]:
    """Boolean faults of a ring list."""
    any_ring = lambda test: F.coalesce(F.exists(rings, test), F.lit(False))
    first, last = (lambda r: F.get(r, F.lit(0))), (lambda r: F.get(r, F.size(r) - 1))
    return {
        "missing": rings.isNull(),
        "empty": F.coalesce(F.size(rings) == 0, F.lit(False)),
        "short_ring": any_ring(lambda r: F.size(r) < 4),
        "open_ring": any_ring(lambda r: (first(r)["x"] != last(r)["x"]) | (first(r)["y"] != last(r)["y"])),
        "zero_area": any_ring(lambda r: (F.size(r) >= 2) & (signed_area(r) == 0)),
    }


def boundary_audit(polygons: DataFrame) -> DataFrame:
    """Per geometry type: features, faults, distinct regions, entities and codes."""
    faults = ring_faults(F.col("rings"))
    return polygons.groupBy("geometry_type").agg(
        F.count(F.lit(1)).alias("features"),
        *[F.count_if(t).alias(n) for n, t in faults.items()],
        F.count_distinct("region").alias("regions"), F.count_distinct("entity").alias("entities"),
        F.count_distinct("code").alias("codes"))


def duplicate_codes(polygons: DataFrame, col: str = "code") -> DataFrame:
    return polygons.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def polygon_checks(polygons: DataFrame, expected: int | None = None) -> DataFrame:
    """checks(name, passed, detail): null, empty, faulty, duplicate and count checks."""
    faults = ring_faults(F.col("rings"))
    one = polygons.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("region", "entity").alias("keys"),
        F.count_if(F.col("region").isNull() | F.col("entity").isNull()).alias("null_keys"),
        *[F.count_if(t).alias(f"f_{n}") for n, t in faults.items()])
    rows = [("keys_present", F.col("null_keys") == 0, F.col("null_keys")),
            ("keys_unique", F.col("keys") == F.col("n"), F.col("n") - F.col("keys"))]
    rows += [(f"no_{n}", F.col(f"f_{n}") == 0, F.col(f"f_{n}")) for n in faults]
    if expected is not None:
        rows.append(("expected_count", F.col("n") == expected, F.col("n")))
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), p.alias("passed"), v.cast("string").alias("detail"))
        for n, p, v in rows])).alias("r")).select("r.*")
