"""Hexagon ids, polygons and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
RESOLUTION_SHIFT = 52
DIGIT_BITS = 3
FINEST_RESOLUTION = 15


def h3_to_long(cell: Column) -> Column:
    """The 64-bit id behind the hexadecimal text of a cell."""
    return F.conv(F.lower(F.trim(cell)), 16, 10).try_cast("long")


def h3_resolution(cell_id: Column) -> Column:
    return F.shiftright(cell_id, RESOLUTION_SHIFT).bitwiseAND(F.lit(15))


def h3_parent(cell_id: Column, resolution: int) -> Column:
    """Parent cell: write the coarser resolution and blank the finer digits with ones.

    Null for a cell that is already coarser than ``resolution``.
    """
    cleared = cell_id.bitwiseAND(F.lit(~(15 << RESOLUTION_SHIFT)))
    blank = (1 << (DIGIT_BITS * (FINEST_RESOLUTION - resolution))) - 1
    parent = cleared.bitwiseOR(F.lit(resolution << RESOLUTION_SHIFT)).bitwiseOR(F.lit(blank))
    return F.when(h3_resolution(cell_id) >= resolution, parent)


def h3_text(cell_id: Column) -> Column:
    return F.lower(F.hex(cell_id))


_AREA = r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTIPOLYGON|POLYGON)\s*(ZM|Z|M)?\s*(?=\(|EMPTY)"
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
_NESTED = "array<array<array<array<string>>>>"


def _nested(wkt: Column) -> Column:
    """Positions of an area as texts, nested as multi-polygon, polygon, ring; null when the brackets do not fit.

    Every position is quoted and round brackets become square ones, which leaves JSON; its parser
    follows the depth of the brackets.
    """
    body = F.regexp_replace(F.regexp_replace(wkt, _AREA, ""), "(?i)\\bEMPTY\\b", "()")
    quoted = F.regexp_replace(body, r"[^\s(),]+(?:\s+[^\s(),]+)*", '"$0"')
    return F.concat(F.lit("["), F.translate(quoted, "()", "[]"), F.lit("]"))


def _position(flag: Column):
    """A position from its numbers: a third one is the height, unless the flag says it is a measure."""

    def build(text: Column) -> Column:
        parts = F.split(text, r"\s+")

        def number(i: int) -> Column:
            part = F.try_element_at(parts, F.lit(i))
            return F.when(part.rlike(_NUMBER), part.try_cast("double"))

        return F.struct(
            number(1).alias("lon"),
            number(2).alias("lat"),
            F.when(flag != "M", number(3)).alias("alt"),
            (F.size(parts).between(2, 4) & F.forall(parts, lambda x: x.rlike(_NUMBER))).alias("valid"),
        )

    return build


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in the expression."""
    return F.transform(F.array(value), use)[0]


def _read_area(wkt: Column) -> Column:
    """``kind, problem, polygons`` of an area's text; the polygons are null where there is a problem."""
    kind = F.upper(F.regexp_extract(wkt, _AREA, 1))
    at = _position(F.upper(F.regexp_extract(wkt, _AREA, 2)))
    text = _nested(wkt)
    # A polygon is a multi-polygon of one.
    listed = F.when(kind == "POLYGON", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    # What follows the area shows whether all of the text was part of it.
    read = F.from_json(F.concat(F.lit('{"area":'), listed, F.lit(',"end":1}')), f"area {_NESTED}, end int")

    def missing(levels: Column) -> Column:
        return F.exists(levels, lambda p: p.isNull() | F.exists(p, lambda r: r.isNull() | F.exists(r, lambda x: x.isNull())))

    def numbers(levels: Column) -> Column:
        points = F.transform(F.filter(levels, lambda p: F.size(p) > 0), lambda p: F.transform(p, lambda r: F.transform(r, at)))
        return F.struct(F.lit(None).cast("string").alias("problem"), points.alias("points"))

    def fits(read: Column) -> Column:
        # One area, and one polygon in it unless several are allowed.
        whole = read["area"]
        first = F.try_element_at(whole, F.lit(1))
        one = (read["end"] == 1) & (F.size(whole) == 1) & first.isNotNull() & ~missing(first)
        return F.coalesce(one & ((kind != "POLYGON") | (F.size(first) == 1)), F.lit(False))

    def judged(read: Column) -> Column:
        broken = F.struct(F.lit("brackets").alias("problem"), numbers(F.try_element_at(read["area"], F.lit(1)))["points"].alias("points"))
        return F.when(fits(read), numbers(F.try_element_at(read["area"], F.lit(1)))).otherwise(broken)

    def checked(area: Column) -> Column:
        bad = F.exists(area["points"], lambda p: F.exists(p, lambda r: F.exists(r, lambda x: ~x["valid"])))
        problem = F.when(kind == "", F.lit("type")).when(area["problem"].isNotNull(), area["problem"]).when(bad, F.lit("number"))
        return F.struct(kind.alias("kind"), problem.alias("problem"), F.when(problem.isNull(), area["points"]).alias("polygons"))

    return F.when(wkt.isNotNull(), _once(_once(read, judged), checked))


def wkt_problem(wkt: Column) -> Column:
    """Why an area cannot be read (``type``, ``brackets`` or ``number``); null when it can, or is null itself."""
    return _read_area(wkt)["problem"]


def wkt_polygons(wkt: Column) -> Column:
    """Polygons of ``POLYGON`` or ``MULTIPOLYGON`` text, each an array of rings (the outer one, then its holes).

    Rings are arrays of ``lon, lat, alt`` structs; ``alt`` is null without a height, and a measure (M) has no
    place. An empty area is an empty array; a text that cannot be read is null (see ``wkt_problem``).
    """

    def point(x: Column) -> Column:
        return F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), x["alt"].alias("alt"))

    return F.transform(_read_area(wkt)["polygons"], lambda p: F.transform(p, lambda r: F.transform(r, point)))


def wkt_ring(wkt: Column) -> Column:
    """Outer ring of the first polygon as an array of lon/lat structs."""
    ring = F.try_element_at(F.try_element_at(wkt_polygons(wkt), F.lit(1)), F.lit(1))
    return F.transform(ring, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))


def wkt_geojson(wkt: Column) -> Column:
    """GeoJSON geometry of an area with all its polygons, holes and heights; null when it cannot be read."""

    def position(x: Column) -> Column:
        return F.filter(F.array(x["lon"], x["lat"], x["alt"]), lambda v: v.isNotNull())

    def shown(area: Column) -> Column:
        polygons = F.transform(area["polygons"], lambda p: F.transform(p, lambda r: F.transform(r, position)))
        none = F.array().cast("array<array<array<double>>>")
        single = F.struct(F.lit("Polygon").alias("type"), F.coalesce(F.try_element_at(polygons, F.lit(1)), none).alias("coordinates"))
        several = F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))
        text = F.when(area["kind"] == "POLYGON", F.to_json(single)).otherwise(F.to_json(several))
        return F.when(area["polygons"].isNotNull(), text)

    return _once(_read_area(wkt), shown)


def ring_geojson(ring: Column) -> Column:
    """GeoJSON geometry text of one ring."""
    pairs = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.when(
        ring.isNotNull(),
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates"))),
    )


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point of the unit sphere at a place in degrees."""
    flat = F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_RADIUS_M)


def shares_element(left: Column, right: Column) -> Column:
    """Whether two arrays have an element in common; false when either is null."""
    return F.coalesce(F.size(F.array_intersect(left, right)) > 0, F.lit(False))
