"""Overlaps of intervals as equi-joins.

The axis of whole numbers is a binary tree of blocks of 1, 2, 4, ... numbers.  An interval is
the union of at most two blocks of each size, and a point lies in an interval where exactly
one of the blocks around it is one of these: so a point meets an interval once, by an
equality, however long the interval is.  Two intervals overlap where the start of one lies in
the other; of the two starts the later owns the pair (the right one's, where they are equal),
so no pair is found twice.

Every row that leaves the join is a result; only where a key has few rows on both sides they
meet by the key alone, as their blocks would be more than the pairs.  Blocks that no interval has are left out before
points are shuffled; blocks that stand around more than a 1,024th of the points' rows (no
more than 1,024 can) are dealt over several tasks.

Both ends belong to an interval.  A null end is open on that side; an interval whose start is
behind its end holds nothing; a null point lies in nothing; a null equality key meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.running import spread
from orebody.sources.scratch import settle

#: Bits of the axis at most; a join takes no more than the distance of its least and greatest end asks.
BITS = 62
HOT_SHARE = 1 / 1024
SALTS = 32
#: Blocks that intervals have are broadcast up to so many rows.
BROADCAST_BLOCKS = 100_000
#: Rows of a key on either side that meet all rows of the key on the other.
FEW = 64


def days(date: Column) -> Column:
    """A date's number, for intervals of dates."""
    return F.unix_date(date.cast("date"))


def blocks_of_point(x: Column, base: int, bits: int) -> Column:
    """(size, block) of the blocks of all sizes around a number of the axis, which has 2**bits numbers from ``base`` on."""
    at = x.cast("long") - base
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.cast("int").alias("size"), F.call_function("shiftright", at, k.cast("int")).alias("block")))


def blocks_of_interval(a: Column, b: Column, base: int, bits: int) -> Column:
    """(size, block) of the fewest blocks whose union is the part of an interval on the axis."""
    low = F.coalesce(F.greatest(F.lit(0), a.cast("long") - base), F.lit(0))
    high = F.coalesce(F.least(F.lit(1 << bits), b.cast("long") - base + 1), F.lit(1 << bits))

    def at(k: Column) -> Column:
        k = k.cast("int")
        # blocks of this size between the ends: an odd first one and an odd number before the last stand alone
        first, last = F.negate(F.call_function("shiftright", -low, k)), F.call_function("shiftright", high, k)
        alone = F.array(F.when(first % 2 == 1, first), F.when(last % 2 == 1, last - 1))
        found = F.when(first < last, F.array_distinct(F.array_compact(alone))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(found, lambda x: F.struct(k.alias("size"), x.alias("block")))

    whole = F.array(F.struct(F.lit(bits).alias("size"), F.lit(0).cast("long").alias("block")))
    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max(bits - 1, 0))), at))
    none = F.array().cast("array<struct<size:int,block:bigint>>")
    return F.when(low >= high, none).when((low == 0) & (high == 1 << bits), whole).otherwise(inner)


def axis(*columns: tuple[DataFrame, str]) -> tuple[int, int]:
    """(base, bits) of an axis that holds all numbers of some columns."""
    # a row for each column
    ends = [df.agg(F.min(F.col(c).cast("long")).alias("a"), F.max(F.col(c).cast("long")).alias("b")).first() for df, c in columns]
    low, high = min((e["a"] for e in ends if e["a"] is not None), default=0), max((e["b"] for e in ends if e["b"] is not None), default=0)
    bits = (high - low + 1).bit_length()
    if bits > BITS:
        raise ValueError(f"ends {low} and {high} are too far apart")
    return low, bits


def stabbed(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """All columns of points and of the intervals that hold them, a row a pair; ``keys`` are equal on both sides and appear once."""
    keys = keys or []
    place = [*keys, "__size", "__block"]
    # an end beyond all points says no more than the last point does
    base, bits = axis((points, point))
    own = spread(intervals).withColumn("__r", F.explode(blocks_of_interval(F.col(start), F.col(end), base, bits))).withColumns({"__size": F.col("__r.size"), "__block": F.col("__r.block")}).drop("__r")
    own = settle(own, "interval-blocks")
    known = settle(own.select(*place).distinct(), "blocks")
    sizes = [r["__size"] for r in known.select("__size").distinct().collect()]  # one more than there are bits at most
    asked = spread(points.where(F.col(point).isNotNull())).withColumn("__r", F.explode(F.filter(blocks_of_point(F.col(point), base, bits), lambda r: r["size"].isin(*sizes) if sizes else F.lit(False))))
    asked = asked.withColumns({"__size": F.col("__r.size"), "__block": F.col("__r.block")}).drop("__r")
    met = asked.join(F.broadcast(known) if known.count() <= BROADCAST_BLOCKS else known, place, "left_semi")
    counts = settle(met.groupBy(*place).agg(F.count("*").alias("__n")), "block-counts")
    total = counts.agg(F.sum("__n").alias("n")).first()["n"] or 0
    hot = F.broadcast(counts.where(F.col("__n") > total * HOT_SHARE).select(*place, F.lit(True).alias("__hot")))
    left = met.join(hot, place, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[c for c in points.columns]), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    right = own.join(hot, place, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return left.join(right, [*place, "__salt"]).drop("__size", "__block", "__salt")


def _by_blocks(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str] | None = None) -> DataFrame:
    """Overlapping rows by the blocks of their starts."""
    keys = keys or []
    (a, b), (c, d) = left_ends, right_ends
    # an open start lies before everything that has an end
    before = min(axis((left, a), (left, b))[0], axis((right, c), (right, d))[0]) - 1
    first, second = (side.withColumn("__start", F.coalesce(F.col(s).cast("long"), F.lit(before))).where(F.col(e).isNull() | (F.col("__start") <= F.col(e))) for side, s, e in ((left, a, b), (right, c, d)))
    later_right = stabbed(second, "__start", first.drop("__start"), a, b, keys).drop("__start")
    # starts that are equal were found above
    open_c = F.coalesce(F.col(c).cast("long"), F.lit(before))
    later_left = stabbed(first, "__start", second.drop("__start"), c, d, keys).where(open_c < F.col("__start")).drop("__start")
    names = [*keys, *[x for x in left.columns if x not in keys], *[x for x in right.columns if x not in keys]]
    return later_right.select(*names).unionByName(later_left.select(*names))


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str] | None = None) -> DataFrame:
    """All columns of left and right rows whose intervals overlap, a row a pair; apart from ``keys`` the sides share no names.

    Keys with at most ``FEW`` rows on each side meet as they are, with at most so many tests a
    row; the rows of other keys, and everything without keys, go by blocks.
    """
    if shared := (set(left.columns) & set(right.columns)) - set(keys or []):
        raise ValueError(f"both sides have {sorted(shared)}")
    if not keys:
        return _by_blocks(left, right, left_ends, right_ends)
    # no more keys than a FEW-th of the rows
    counts = [side.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > FEW).select(*keys) for side in (left, right)]
    many = settle(counts[0].unionByName(counts[1]).distinct(), "crowded-keys")
    found = many.count()

    def part(side: DataFrame, how: str) -> DataFrame:
        return side.join(F.broadcast(many) if found <= BROADCAST_BLOCKS else many, keys, how)

    one, two = (part(side, "left_anti") if found else side for side in (left, right))
    (a, b), (c, d) = left_ends, right_ends
    x, y = ([F.col(n).cast("long") for n in ends] for ends in ((a, b), (c, d)))
    whole = [F.coalesce(low <= high, F.lit(True)) for low, high in (x, y)]
    names = [*keys, *[n for n in left.columns if n not in keys], *[n for n in right.columns if n not in keys]]
    met = one.where(whole[0]).join(two.where(whole[1]), keys).where(F.coalesce(x[0] <= y[1], F.lit(True)) & F.coalesce(y[0] <= x[1], F.lit(True))).select(*names)
    return met.unionByName(_by_blocks(part(left, "left_semi"), part(right, "left_semi"), left_ends, right_ends, keys)) if found else met
