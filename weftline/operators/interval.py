"""Joins of points and intervals as equi joins on a dyadic grid.

An interval lies on one level of the grid, whose cells are a power of two wide, a
quarter to an eighth of the interval; so it covers a few cells however wide it is. A
point has one cell on each level that intervals lie on. Points and intervals that
share a cell are compared; as intervals cover their cells but for the two at their
ends, most of these comparisons hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FractionalType, TimestampNTZType, TimestampType

from weftline.operators.ordered import counted_up_to

FINER = 3  # levels below the one whose cells are as wide as the interval
WHOLE = 5_000  # the level of intervals without an end: one cell


def _axis(df: DataFrame, c: str) -> Column:
    """A column as long (microseconds or days for times), or as double."""
    kind = df.schema[c].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(F.col(c)).cast("long")
    return F.col(c).cast("double" if isinstance(kind, FractionalType) else "long")


def _cell(x: Column, level: Column) -> Column:
    """The number of the cell of ``x`` on a level."""
    return F.when(level == WHOLE, F.lit(0)).otherwise(F.floor(x.cast("double") * F.pow(F.lit(2.0), -level))).cast("long")


def _sizes(low: Column, high: Column) -> Column:
    width = high.cast("double") - low.cast("double")
    return F.when(width == float("inf"), WHOLE).otherwise(F.floor(F.log2(F.greatest(width, F.lit(1e-300)))) - FINER).cast("int")


def _covered(df: DataFrame, low: str, high: str) -> DataFrame:
    """``df`` once for each cell (_level, _cell) of its intervals; intervals that are empty or have a null or NaN end have none."""
    a, b = _axis(df, low), _axis(df, high)
    known = df.where((a < b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))).withColumn("_level", _sizes(a, b))
    return known.withColumn("_cell", F.explode(F.sequence(_cell(a, F.col("_level")), _cell(b, F.col("_level")))))


def _levels(covered: DataFrame) -> list[int]:
    """The levels in use: fewer than there are exponents of a double."""
    return sorted(r["_level"] for r in covered.select("_level").distinct().collect())


def _points(df: DataFrame, value: str, levels: list[int]) -> DataFrame:
    """``df`` once for each level, with its value's cell there."""
    x = _axis(df, value)
    known = df.where(x.isNotNull() & ~F.isnan(x.cast("double"))).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    return known.withColumn("_cell", _cell(x, F.col("_level")))


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _meet(points: DataFrame, value: str, bands: DataFrame, low: str, high: str, by: list[tuple[str, str]], open_low: bool = False) -> DataFrame:
    """Pairs with low <= value < high (low < value if ``open_low``) and equal ``by`` (points' column, bands' column)."""
    cut = _covered(bands, low, high)
    own = _points(points, value, _levels(cut)).withColumnsRenamed({"_level": "_own_level", "_cell": "_own_cell"})
    same = (F.col("_own_level") == F.col("_level")) & (F.col("_own_cell") == F.col("_cell"))
    for p, b in by:
        same &= F.col(p) == F.col(b)
    inside = (F.col(value) > F.col(low) if open_low else F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    return own.join(cut, same & inside).drop("_own_level", "_own_cell", "_level", "_cell")


def in_bands(points: DataFrame, value: str, bands: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of points with each band that holds their value: low <= value < high.

    Numbers, dates and timestamps; bands of any width, without end too. Null and NaN
    values and bounds, and bands that are empty, hold nothing. Columns of the two sides
    have different names.
    """
    return _meet(points, value, bands, low, high, [])


def overlapping(left: DataFrame, right: DataFrame, low: str, high: str, *by: str) -> DataFrame:
    """Pairs, as columns l_* and r_*, of a left and a right row whose intervals [low, high) share a point and whose ``by`` are equal.

    Two intervals overlap where one of them holds the other's start: the left one the
    right one's, or else the right one, beyond its own start, the left one's. So a pair is
    found in one of two joins, and in one cell of it. Empty intervals, null and NaN ends and null
    ``by`` pair with nothing; repeated rows pair each for itself.
    """
    l, r = _named(left, "l"), _named(right, "r")
    ends = [f"{s}_{c}" for s in "lr" for c in (low, high)]
    real = r.where(F.col(ends[2]) < F.col(ends[3])), l.where(F.col(ends[0]) < F.col(ends[1]))
    first = _meet(real[0], ends[2], l, ends[0], ends[1], [(f"r_{c}", f"l_{c}") for c in by])
    second = _meet(real[1], ends[0], r, ends[2], ends[3], [(f"l_{c}", f"r_{c}") for c in by], open_low=True)
    columns = [*l.columns, *r.columns]
    return first.select(*columns).unionByName(second.select(*columns))


def _ends(df: DataFrame, low: str, high: str, by: list[str], kept: list[str]) -> DataFrame:
    """The starts and stops of the intervals in ``df`` (with columns asks and counts, booleans), in the order of ``by`` and value, with _place, and starts and stops of those that count up to each.

    Stops come before the starts at the same value: so two intervals of one ``by`` overlap
    where each starts at a place before the other's stop.
    """
    a, b = _axis(df, low).cast("double"), _axis(df, high).cast("double")
    known = df.where((F.col(low) < F.col(high)) & ~F.isnan(a) & ~F.isnan(b))
    for c in by:
        known = known.where(F.col(c).isNotNull())
    value = (lambda c: F.col(c) + 0.0) if df.schema[low].dataType.typeName() in ("double", "float") else F.col  # -0.0 is 0.0
    both = F.array(F.struct(value(high).alias("at"), F.lit(False).alias("starts")), F.struct(value(low).alias("at"), F.lit(True).alias("starts")))
    ends = known.select(*known.columns, F.explode(both).alias("_end")).select(*known.columns, "_end.at", F.col("_end.starts").alias("_starts"))
    ends = ends.withColumns({"_start": F.col("counts") & F.col("_starts"), "_stop": F.col("counts") & ~F.col("_starts")})
    order = [*map(F.col, by), F.col("at"), F.col("_starts"), F.xxhash64(*kept)]  # the last one lets ties be dealt out
    return counted_up_to(ends, order, [*kept, "asks", "counts", "_starts"], {"starts": "_start", "stops": "_stop"})


def _counts(ends: DataFrame, row: str) -> DataFrame:
    """What an interval overlaps: what starts before its stop, less what stops up to its start. Intervals of an earlier ``by`` are in both."""
    n = F.when(F.col("_starts"), -F.col("stops")).otherwise(F.col("starts"))
    return ends.where("asks").select(row, n.alias("n"), F.col("_starts").cast("long").alias("rows"))


def overlap_counts(df: DataFrame, low: str, high: str, row: str, *by: str) -> DataFrame:
    """``row``, n, rows: with how many rows (their own included) the rows of each value of ``row`` overlap, over all of them, and how many they are.

    No pair is made: rows are sorted once by ``by`` and their ends, over ranges. Which
    intervals overlap is as in ``overlapping``; rows that overlap nothing, not even
    themselves, are left out.
    """
    kept = df.withColumns({"asks": F.lit(True), "counts": F.lit(True)})
    ends = _ends(kept, low, high, list(by), [row])
    return _counts(ends, row).groupBy(row).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def _nodes(df: DataFrame, first: Column, stop: Column) -> DataFrame:
    """``df`` once for each (_level, _node) of the binary tree over places that make up [first, stop): two on a level at most."""
    some = df.withColumns({"_a": first, "_b": stop}).where("_a < _b")
    each = some.withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2((F.col("_b") - F.col("_a")).cast("double"))).cast("int") + 1)))
    a, b = F.expr("shiftright(_a + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_b, _level)")
    each = each.withColumns({"_a": a, "_b": b}).where("_a < _b")
    ends = F.array(F.when(F.col("_a") % 2 == 1, F.col("_a")), F.when(F.col("_b") % 2 == 1, F.col("_b") - 1))
    return each.withColumn("_node", F.explode(ends)).where("_node is not null").drop("_a", "_b")


def _paths(df: DataFrame, place: str, levels: int) -> DataFrame:
    """``df`` once for each node above its place."""
    return df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_node", F.expr(f"shiftright({place}, _level)"))


def overlap_summary(left: DataFrame, right: DataFrame, low: str, high: str, row: str, value: str) -> DataFrame:
    """``row``, n, least: with how many right rows the left rows of each value of ``row`` overlap, and the least ``value`` of these.

    Which intervals overlap is as in ``overlapping``, but no pair is made. Right rows
    are counted as in ``overlap_counts``. The least value is that of the right rows that start
    within the left one, by the nodes of a binary tree over places that make it up, or that hold
    its start, by the nodes above it. Left rows that overlap nothing are left out.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    asks = left.select(F.col(row).alias("row"), none(right, value).alias("value"), F.col(low).alias("low"), F.col(high).alias("high"), F.lit(True).alias("asks"), F.lit(False).alias("counts"))
    counts = right.select(none(left, row).alias("row"), F.col(value).alias("value"), F.col(low).alias("low"), F.col(high).alias("high"), F.lit(False).alias("asks"), F.lit(True).alias("counts"))
    ends = _ends(asks.unionByName(counts), "low", "high", [], ["row", "value", "low", "high"])
    whole = ends.groupBy("row", "value", "low", "high", "asks").agg(F.min(F.when(F.col("_starts"), F.col("_place"))).alias("first"), F.max(F.when(~F.col("_starts"), F.col("_place"))).alias("last"))
    asked, held = whole.where("asks").select("row", "first", "last"), whole.where("not asks").select("value", "first", "last")
    widest = {r["asks"]: (r["width"] or 1).bit_length() for r in whole.groupBy("asks").agg(F.max(F.col("last") - F.col("first")).alias("width")).collect()}
    starts = ends.where("counts and _starts").select("value", "_place")
    at, inside = ["side", "_level", "_node"], lambda df: _nodes(df, F.col("first") + 1, F.col("last"))
    mine = _paths(starts, "_place", widest.get(True, 1)).withColumn("side", F.lit(0)).select(*at, "value")
    mine = mine.unionByName(inside(held).withColumn("side", F.lit(1)).select(*at, "value")).groupBy(*at).agg(F.min("value").alias("value"))
    ours = inside(asked).withColumn("side", F.lit(0)).select(*at, "row").unionByName(_paths(asked, "first", widest.get(False, 1)).withColumn("side", F.lit(1)).select(*at, "row"))
    least = ours.join(mine, at).select("row", F.lit(0).cast("long").alias("n"), F.col("value").alias("least"))
    both = _counts(ends, "row").select("row", "n", none(right, value).alias("least")).unionByName(least)
    return both.groupBy(F.col("row").alias(row)).agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n > 0")


def within(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs of a left and a right row of one key whose time lies 0 to ``seconds`` after the left one's; columns are l_* and r_*.

    Rows meet by key and bin of time, so that a frequent key is many bins: a left row
    looks into its own bin and the next one. Null keys and times pair with nothing;
    repeated rows pair each for itself.
    """
    epoch = F.unix_micros(F.col(time).cast("timestamp"))
    width = seconds * 1_000_000
    bin_width = max(width, 1)
    sides = []
    for df, x, bins in ((left, "l", F.array(F.lit(0), F.lit(1))), (right, "r", F.array(F.lit(0)))):
        named = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumns({"_at": epoch})
        sides.append(named.select(F.col(key).alias(f"_{x}k"), F.col("_at").alias(f"_{x}at"), F.explode(F.transform(bins, lambda k: F.floor(F.col("_at") / bin_width) + k)).alias(f"_{x}bin"), *[F.col(c).alias(f"{x}_{c}") for c in df.columns]))
    both = sides[0].join(sides[1], (F.col("_lk") == F.col("_rk")) & (F.col("_lbin") == F.col("_rbin")) & (F.col("_rat") - F.col("_lat")).between(0, width))
    return both.select(*[c for c in both.columns if not c.startswith("_")])
