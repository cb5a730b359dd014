"""Radius search, nearest places, pairs and density clusters on coordinates.

Points are joined by grid cells as wide as the radius, so that a search compares a point
with its nine neighbouring cells and not with all points.  Rows are (id, lat, long).
"""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.expressions import EARTH_KM, contains_text, ellipsoid_km, haversine_km
from orebody.operators.components import components
from orebody.operators.running import running, spread
from orebody.sources.scratch import settle

KM_PER_DEGREE = EARTH_KM * pi / 180
#: Beyond this latitude a degree of longitude is too short for cells of whole degrees.
POLAR = 85.0


def distance_km(kind: str, *places: Column) -> Column:
    return ellipsoid_km(*places) if kind == "ellipsoid" else haversine_km(*places)


def _in_cells(points: DataFrame, radius_km: float, lat: str = "lat", long: str = "long", around: bool = False, ahead: bool = False) -> DataFrame:
    """Points with ``row`` and ``column`` of their cell; ``around``: of each cell that their radius reaches, in their own row and the two beside it.

    ``ahead``: only in their own row (kept as ``__row``) and the next.

    Columns of a row are as wide as its narrowest end asks; a row's cells are found by its own width.
    """
    # as text: a column object for each term costs more than the search on small tables
    step = f"{radius_km / KM_PER_DEGREE!r}D"
    row = f"floor(({lat} + 90) / {step})"
    # the row's neighbours may be narrower still: the widest latitude of three rows counts
    far = f"greatest(abs(`row` * {step} - 90 - {step}), abs((`row` + 1) * {step} - 90 + {step}))"
    count = f"CASE WHEN {far} >= {POLAR} THEN 1L ELSE greatest(1L, floor(360 * cos(radians({far})) / {step})) END"
    column = f"pmod(floor(({long} + 180) / 360 * __count), __count)"
    if around:
        if ahead:
            points = points.selectExpr("*", f"{row} AS __row")
        row = "explode(sequence(__row, __row + 1))" if ahead else f"explode(sequence({row} - 1, {row} + 1))"
        column = f"explode(array_distinct(transform(array(-1L, 0L, 1L), d -> pmod({column} + d, __count))))"
    rows = points.selectExpr("*", f"{row} AS `row`").selectExpr("*", f"{count} AS __count")
    return rows.selectExpr("*", f"{column} AS `column`").drop("__count")


#: Ellipsoidal distances are up to a hundredth longer or shorter than those on the sphere.
LOOSE = {"ellipsoid": 1.01}


def _with_chords(points: DataFrame, suffix: str = "") -> DataFrame:
    """Points with their place on the unit sphere."""
    lat, long = f"radians(lat{suffix})", f"radians(long{suffix})"
    return points.selectExpr("*", f"cos({lat}) * cos({long}) AS __x{suffix}", f"cos({lat}) * sin({long}) AS __y{suffix}", f"sin({lat}) AS __z{suffix}")


def _may_be_near(radius_km: float, kind: str) -> Column:
    """Whether the chord between two points lets them be within the radius: sums of squares alone, and a little generous."""
    angle = min(pi, radius_km * LOOSE.get(kind, 1.0) / EARTH_KM)
    most = (2 * sin(angle / 2)) ** 2 * (1 + 1e-9) + 1e-14
    return F.expr(" + ".join(f"(__{c} - __{c}_b) * (__{c} - __{c}_b)" for c in "xyz") + f" <= {most!r}D")


def near_of(left: DataFrame, right: DataFrame, radius_km: float, kind: str = "haversine") -> DataFrame:
    """All columns of both sides and ``km`` for left and right points (lat, long) within the radius, by an equi-join on cells.

    Right columns are named with ``_b`` behind; every left point meets each right point once.
    """
    known = _in_cells(_with_chords(right.withColumnsRenamed({c: f"{c}_b" for c in right.columns}), "_b"), radius_km, "lat_b", "long_b")
    km = distance_km(kind, F.col("lat"), F.col("long"), F.col("lat_b"), F.col("long_b"))
    met = _in_cells(_with_chords(spread(left, "lat", "long")), radius_km, around=True).join(known, ["row", "column"]).where(_may_be_near(radius_km, kind))
    return met.select(*left.columns, *[f"{c}_b" for c in right.columns], km.alias("km")).where(F.col("km") <= radius_km)


def placed(points: DataFrame) -> DataFrame:
    """(id, lat, long) of the points that have a place."""
    return points.select("id", F.col("lat").cast("double").alias("lat"), F.col("long").cast("double").alias("long")).where("lat IS NOT NULL AND long IS NOT NULL")


#: Points of one place in a row, and points of a part of a cell: fuller places and cells are cut into parts.
HELD, PART = 256, 1024


def _parts(rows: DataFrame, keys: tuple[str, ...], size: Column, most: int) -> DataFrame:
    """``keys`` and ``__parts`` of the groups of more than ``most``."""
    full = rows.groupBy(*keys).agg(F.sum(size).alias("__n")).where(F.col("__n") > most)
    full = settle(full.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__parts")), "full")
    return F.broadcast(full) if full.count() <= BROADCAST_CELLS else full


def near_pairs(points: DataFrame, radius_km: float, kind: str = "haversine", digits: int | None = None) -> DataFrame:
    """(a, b, km), a < b, of all pairs within the radius, by an equi-join on cells; ``digits``: of km, rounded once for two places.

    Points of one place are a row, so that places are compared and not points.  A place meets its own row of
    cells and the next, and the parts of a full cell one by one: no cell is one task.
    """
    part = F.coalesce(F.col("__parts"), F.lit(1))
    p = placed(points)
    full = _parts(p, ("lat", "long"), F.lit(1), HELD)
    held = p.join(full, ["lat", "long"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), part)).groupBy("lat", "long", "salt").agg(F.collect_list("id").alias("ids"))
    held = settle(held, "places")
    known = _in_cells(held, radius_km)
    full = _parts(known, ("row", "column"), F.size("ids"), PART)
    known = known.join(full, ["row", "column"], "left").withColumn("part", F.pmod(F.xxhash64("lat", "long", "salt"), part)).drop("__parts")
    known = _with_chords(known.withColumnsRenamed({c: f"{c}_b" for c in held.columns}), "_b")
    met = _in_cells(_with_chords(held), radius_km, around=True, ahead=True).join(full, ["row", "column"], "left")
    met = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), part.cast("long") - 1)).alias("part")).drop("__parts")
    cell = ("row", "column", "part")
    pairs = spread(met, *cell).join(spread(known, *cell), list(cell))
    # of two places in a row of cells the first meets the second, and each itself
    pairs = pairs.where(F.expr("`row` > __row OR struct(lat, long, salt) <= struct(lat_b, long_b, salt_b)") & _may_be_near(radius_km, kind))
    km = distance_km(kind, F.col("lat"), F.col("long"), F.col("lat_b"), F.col("long_b"))
    same = F.expr("struct(lat, long, salt) = struct(lat_b, long_b, salt_b)").alias("same")
    pairs = pairs.select("ids", "ids_b", same, km.alias("km")).where(F.col("km") <= radius_km)
    if digits is not None:
        pairs = pairs.withColumn("km", F.round("km", digits))
    pairs = pairs.select(F.explode("ids").alias("__a"), "ids_b", "same", "km").select("__a", F.explode("ids_b").alias("__b"), "same", "km")
    return pairs.where("__a < __b OR (NOT same AND __a > __b)").select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"), "km")


def within(points: DataFrame, lat: float, long: float, radius_km: float, limit: int, kind: str = "haversine", exclude: object = None) -> DataFrame:
    """The nearest points of a place within a radius; a box on latitude reaches the scan."""
    reach = radius_km / KM_PER_DEGREE * 1.01
    box = F.col("lat").between(lat - reach, lat + reach)
    edge = abs(lat) + reach
    if edge < POLAR and (wide := reach / cos(radians(edge))) < 180:
        off = F.abs(F.pmod(F.col("long") - F.lit(long) + 180, F.lit(360.0)) - 180)
        box &= off <= wide
    near = points.where(box)
    if exclude is not None:
        near = near.where(F.col("id") != F.lit(exclude))
    near = near.withColumn("km", distance_km(kind, F.lit(lat), F.lit(long), F.col("lat"), F.col("long")))
    return near.where(F.col("km") <= radius_km).orderBy("km", "id").limit(limit)


def near_each(references: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """(ref_id, id, km) of the points within a radius of each of a few places."""
    pairs = near_pairs(points.select("id", "lat", "long"), radius_km)
    both = pairs.select(F.col("a").alias("ref_id"), F.col("b").alias("id"), "km").unionByName(pairs.select(F.col("b").alias("ref_id"), F.col("a").alias("id"), "km"))
    return both.join(references.select(F.col("id").alias("ref_id")), "ref_id", "left_semi")


#: Named points that pair statistics take at most: all their pairs are asked for.
MAX_NAMED = 1000


def pair_statistics(points: DataFrame) -> DataFrame:
    """Mean, least, greatest and number of the distances of all pairs of a named few points; more than MAX_NAMED are an error."""
    few = points.select("id", "lat", "long").limit(MAX_NAMED + 1)
    if few.count() > MAX_NAMED:
        raise ValueError(f"more than {MAX_NAMED} points: ask for pairs within a radius")
    a, b = few, few.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("long").alias("long_b"))
    km = haversine_km(F.col("lat"), F.col("long"), F.col("lat_b"), F.col("long_b"))
    pairs = a.join(F.broadcast(b), F.col("id") < F.col("id_b")).select(km.alias("km"))
    return pairs.agg(F.avg("km").alias("avg_km"), F.min("km").alias("min_km"), F.max("km").alias("max_km"), F.count("*").alias("n_pairs"))


def place_named(points: DataFrame, name: str, area: str | None = None) -> DataFrame:
    """The one point (id, name, wk_name, lat, long) that a name means: the name itself first, then the first that holds it, by name and id."""
    found = points.where(contains_text(F.col("name"), name) & F.col("lat").isNotNull() & F.col("long").isNotNull())
    if area:
        found = found.where(contains_text(F.col("wk_name"), area))
    exact = F.when(F.lower("name") == name.lower(), 0).otherwise(1)
    return found.orderBy(exact, "name", "id").limit(1)


def distance_between(points: DataFrame, start: str, end: str, area: str | None = None) -> DataFrame:
    """(from_name, to_name, distance_km) on the sphere between two named points; no row where either is missing."""
    a = place_named(points, start, area).select(F.col("name").alias("from_name"), F.col("lat").alias("lat_a"), F.col("long").alias("long_a"))
    b = place_named(points, end, area).select(F.col("name").alias("to_name"), F.col("lat").alias("lat_b"), F.col("long").alias("long_b"))
    # a row on either side at most
    km = haversine_km(F.col("lat_a"), F.col("long_a"), F.col("lat_b"), F.col("long_b"))
    return a.crossJoin(F.broadcast(b)).select("from_name", "to_name", F.round(km, 2).alias("distance_km"))


def near_named(points: DataFrame, name: str, radius_km: float = 20.0, limit: int = 10, area: str | None = None, kind: str = "ellipsoid") -> DataFrame:
    """The points around a named one, without it, nearest first; no row where the name means nothing."""
    at = place_named(points, name, area).first()
    if at is None:
        return points.withColumn("km", F.lit(0.0)).limit(0)
    around = points if not area else points.where(contains_text(F.col("wk_name"), area))
    return within(around, at["lat"], at["long"], radius_km, limit, kind, exclude=at["id"])


def points_in_area(points: DataFrame, area: str, limit: int = 50) -> DataFrame:
    """(id, name, wk_name, lat, long) of the points of a work area, by name."""
    return points.where(contains_text(F.col("wk_name"), area)).select("id", "name", "wk_name", "lat", "long").distinct().orderBy("name", "id").limit(limit)


def area_centres(points: DataFrame) -> DataFrame:
    """(id, name, wk_name, lat, long): each work area at the mean of its points."""
    centres = points.where("wk_name IS NOT NULL").groupBy("wk_name").agg(F.avg("lat").alias("lat"), F.avg("long").alias("long"))
    return centres.select(F.col("wk_name").alias("id"), F.col("wk_name").alias("name"), "wk_name", "lat", "long")


#: Questions about places: what answers them, and the arguments that they need.
PLACE_QUESTIONS = {
    "near_field": (near_named, ("name",)),
    "in_area": (points_in_area, ("area",)),
    "distance": (distance_between, ("start", "end")),
    "coordinates": (place_named, ("name",)),
    "nearest": (within, ("lat", "long", "radius_km", "limit")),
    "clusters": (lambda points, radius_km=20.0, least=2: clusters(points, radius_km, least), ()),
    "adjacent_areas": (lambda points, area, radius_km=20.0, limit=10, kind="ellipsoid": near_named(area_centres(points), area, radius_km, limit, kind=kind), ("area",)),
    "average_distance": (lambda points, names: pair_statistics(points.where(F.lower("name").isin(*[n.lower() for n in names]))), ("names",)),
}


def ask_places(points: DataFrame, question: str, **given) -> tuple[str, DataFrame | None]:
    """(status, rows) of a question about points (id, name, wk_name, lat, long).

    status: ``success``; ``no_results`` where a place is known and nothing is around it;
    ``not_found`` where a name means no place; ``error`` for an unknown question or
    a missing argument.
    """
    if question not in PLACE_QUESTIONS or any(a not in given for a in PLACE_QUESTIONS[question][1]):
        return "error", None
    rows = PLACE_QUESTIONS[question][0](points, **given)
    if not rows.isEmpty():
        return "success", rows
    known = question in ("nearest", "clusters")
    if question == "near_field":
        known = not place_named(points, given["name"], given.get("area")).isEmpty()
    elif question == "adjacent_areas":
        known = not place_named(area_centres(points), given["area"]).isEmpty()
    return ("no_results" if known else "not_found"), rows


#: Parts of a cell's side into which core points are summed up.
PARTS = 8
#: Full cells up to so many are broadcast.
BROADCAST_CELLS = 100_000


def _small_cells(radius_km: float | Column) -> tuple[Column, Column]:
    """(cell, part of the cell) of a point: all points of a cell are within the radius of each other."""
    # a little less than the radius over the root of two, so that rounding keeps within it
    side = radius_km / 2**0.5 * 0.999 / KM_PER_DEGREE
    row = F.floor((F.col("lat") + 90) / side)
    low, high = row * side - 90, (row + 1) * side - 90
    nearest = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    # columns by the row's widest latitude
    count = F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(nearest)) / side)).cast("long")
    across = (F.col("long") + 180) / 360 * count
    column = F.least(F.floor(across), count - 1)
    part = F.floor(((F.col("lat") + 90) / side - row) * PARTS) * (PARTS + 1) + F.floor((across - column) * PARTS)
    return (F.shiftleft(row.cast("long"), 32) + column).alias("cell"), part.cast("int").alias("part")


#: Comparisons of points that are made at once; beyond, what sure links join is left out first.
TESTS = 50_000_000


def _linked_cells(core: DataFrame, radius_km: float) -> DataFrame:
    """(a, b): pairs of cells of which two core points are within the radius.

    Core points are summed up by parts of cells, each a box with a reach; boxes whose centres
    and reaches lie within the radius are linked without a look at their points.  Only where
    no box of two cells is sure and some might be, points are compared; where these are many,
    only between cells that nothing else links.
    """
    boxes = core.groupBy("cell", "part").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("long").alias("long0"), F.max("long").alias("long1"), F.count("*").alias("n"))
    lat, long = (F.col("lat0") + F.col("lat1")) / 2, (F.col("long0") + F.col("long1")) / 2
    boxes = boxes.withColumns({"lat": lat, "long": long})
    corners = [haversine_km(F.col("lat"), F.col("long"), F.col(y), F.col("long0")) for y in ("lat0", "lat1")]
    alone = (F.col("lat0") == F.col("lat1")) & (F.col("long0") == F.col("long1"))
    boxes = settle(boxes.select("cell", "part", "lat", "long", "n", F.when(alone, 0.0).otherwise(F.greatest(*corners) * 1.0001).alias("reach")), "boxes")
    slack = F.col("reach") + F.col("reach_b")

    def meetings(one: DataFrame, two: DataFrame) -> DataFrame:
        met = near_of(one, two, radius_km * (1 + 1.5 / PARTS)).where("cell < cell_b").where(F.col("km") - slack <= radius_km)
        return met.select("cell", "part", "cell_b", "part_b", (F.col("n") * F.col("n_b")).alias("tests"), (F.col("km") + slack <= radius_km).alias("sure"))

    pairs = settle(meetings(boxes, boxes).groupBy("cell", "cell_b").agg(F.max("sure").alias("sure"), F.sum("tests").alias("tests")), "cell-pairs")
    sure = pairs.where("sure").select(F.col("cell").alias("a"), F.col("cell_b").alias("b"))
    left = pairs.where("NOT sure").select("cell", "cell_b", "tests")
    tests = left.agg(F.sum("tests").alias("n")).first()["n"]
    if not tests:
        return sure
    if tests > TESTS:
        known = components(sure)
        ends = left.join(known.select(F.col("node").alias("cell"), F.col("component").alias("x")), "cell", "left").join(known.select(F.col("node").alias("cell_b"), F.col("component").alias("y")), "cell_b", "left")
        left = ends.where(F.coalesce("x", "cell") != F.coalesce("y", "cell_b"))
    left = settle(left.select("cell", "cell_b"), "open-cells")
    one, two = boxes.join(left.select("cell"), "cell", "left_semi"), boxes.join(left.select(F.col("cell_b").alias("cell")), "cell", "left_semi")
    doubt = meetings(one, two).join(left, ["cell", "cell_b"], "left_semi").select("cell", "part", "cell_b", "part_b")
    other = core.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("lat").alias("lat_b"), F.col("long").alias("long_b"))
    tested = doubt.join(core.select("cell", "part", "lat", "long"), ["cell", "part"]).join(other, ["cell_b", "part_b"])
    tested = tested.where(haversine_km(F.col("lat"), F.col("long"), F.col("lat_b"), F.col("long_b")) <= radius_km)
    return sure.unionByName(tested.select(F.col("cell").alias("a"), F.col("cell_b").alias("b")).distinct())


def clusters(points: DataFrame, radius_km: float, least: int) -> DataFrame:
    """(id, cluster, size): density clusters; a core point has ``least`` points within the radius, itself included.

    Core points within the radius of each other are one cluster; a border point joins the
    cluster of its least core neighbour; clusters are numbered by falling size.

    Points lie in cells so small that all points of a cell are within the radius of each
    other.  A cell of ``least`` points has core points only, whose distances are not looked at;
    points of other cells, fewer than ``least`` each, count their neighbours.  Clusters are
    components of cells.  What is written is a few rows a point, never the near pairs.
    """
    cell, part = _small_cells(radius_km)
    p = placed(points).select("id", "lat", "long", cell, part)
    full = settle(p.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cell", F.lit(True).alias("full")), "full-cells")
    p = settle(p.join(F.broadcast(full) if full.count() <= BROADCAST_CELLS else full, "cell", "left").withColumn("full", F.coalesce("full", F.lit(False))), "placed")
    few = p.where("NOT full").select("id", "lat", "long")
    counted = near_of(few, p.select("lat", "long"), radius_km).groupBy("id").agg(F.count("*").alias("n"))
    crowded = settle(counted.where(F.col("n") >= least).select("id"), "crowded")
    core = settle(p.where("full").unionByName(p.where("NOT full").join(crowded, "id", "left_semi")).drop("full"), "core")
    linked = components(_linked_cells(core, radius_km)).select(F.col("node").alias("cell"), F.col("component").alias("root"))
    cored = core.join(linked, "cell", "left").select("id", "lat", "long", F.coalesce("root", "cell").alias("root"))
    cored = settle(cored, "cored")
    # a cluster is known by its least core point
    named = settle(cored.groupBy("root").agg(F.min("id").alias("component")), "clusters")
    border = near_of(few.join(crowded, "id", "left_anti"), cored.select("id", "lat", "long", "root"), radius_km).groupBy("id").agg(F.min_by("root_b", "id_b").alias("root"))
    members = settle(cored.select("id", "root").unionByName(border).join(named, "root").select("id", "component"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    numbers = running(sizes, [F.col("size").desc(), F.col("component").asc()], number="cluster")
    return members.join(numbers, "component").select("id", F.col("cluster").cast("int").alias("cluster"), "size")


def centroids(points: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, size, lat, long) with the mean place of each cluster to four places."""
    joined = members.join(points.select("id", "lat", "long"), "id")
    return joined.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("long"), 4).alias("long"))


#: Half of the Earth's circumference and a little, beyond which no point lies.
FARTHEST_KM = EARTH_KM * pi * 1.001
#: Radii are halved so often at most, down to millimetres.
HALVINGS = 24


def nearest_each(points: DataFrame, k: int) -> DataFrame:
    """(place, rank, id, km): the k nearest other points of every point, without a radius; equal distances by id.

    A place looks as far as it must: the radius is halved while the place's cell, in which all
    points are within the radius, still holds enough points, so that k neighbours are certain.
    Only places in sparse regions look far, and each place keeps its k best.  Points of one
    place are one, with the k + 1 smallest ids, so that a crowd at one place is no work.
    """
    p = placed(points)
    order = Window.partitionBy("lat", "long").orderBy("id")
    kept = settle(p.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "kept")
    spots = settle(kept.select("lat", "long").distinct(), "spots")
    levels = range(HALVINGS + 1)
    cell = _small_cells(F.lit(FARTHEST_KM) / F.pow(F.lit(2.0), F.col("level")))[0]
    every = F.explode(F.array(*[F.lit(h) for h in levels])).alias("level")
    counts = spread(kept).select("lat", "long", every).select("level", cell).groupBy("level", "cell").agg(F.count("*").alias("n")).where(F.col("n") > k)
    own = spread(spots).select("lat", "long", every).select("lat", "long", "level", cell)
    deep = own.join(counts, ["level", "cell"], "left").groupBy("lat", "long").agg(F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("level"))), F.lit(-1)).alias("level"))
    deep = settle(deep, "levels")
    found = None
    # no more than the number of levels
    for (level,) in sorted(deep.select("level").distinct().collect()):
        # where no cell is certain there are few points in all
        radius = FARTHEST_KM * 2 if level < 0 else FARTHEST_KM / 2**level
        near = near_of(deep.where(F.col("level") == level).select("lat", "long"), kept, radius).select("lat", "long", F.col("id_b").alias("id"), "km")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return p.select(F.col("id").alias("place"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("km")).limit(0)
    # a point may be among its own: one more than k is enough
    best = settle(found.withColumn("n", F.row_number().over(Window.partitionBy("lat", "long").orderBy("km", "id"))).where(F.col("n") <= k + 1).drop("n"), "nearest")
    each = p.withColumnRenamed("id", "place").join(best, ["lat", "long"]).where("place <> id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("km", "id")))
    return ranked.where(F.col("rank") <= k).select("place", "rank", "id", "km")
