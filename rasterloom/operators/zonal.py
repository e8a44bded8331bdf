"""Zonal statistics and the histogram family: aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Raster, ZonalSpec, ZonalStatistic
from ..plans.lineage import cut

_AGG = {
    "count": lambda v: F.count(v).cast("double"), "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "median": F.median,
}


def stat_names(stats) -> list[str]:
    if stats is None:
        return ZonalSpec().normalized()
    return stats.normalized() if isinstance(stats, ZonalSpec) else [ZonalStatistic(s).value for s in stats]


def zonal_stats(zones: Raster, values: Raster, stats=None) -> DataFrame:
    """One row per zone with valid values: zone and the statistics (``band_N_`` before them if there are more bands)."""
    names = stat_names(stats)
    if zones.meta.band_count != 1:
        raise ValueError("zones have one band")
    if (zones.meta.height, zones.meta.width) != (values.meta.height, values.meta.width):
        raise ValueError("zones and values differ in shape")
    z = zones.df.where("value is not null").select("row", "col", F.col("value").cast("long").alias("zone"))
    both = z.join(values.df.where("value is not null"), ["row", "col"])
    return zonal_aggregate(both, names, values.meta.band_count)


def zonal_aggregate(both: DataFrame, names: list[str], bands: int = 1) -> DataFrame:
    """Statistics of zone, band, value rows in one pass over all bands; medians of large zones by selection beside it."""
    if "median" in names and _largest(both, bands) > DIRECT:
        rest = [n for n in names if n != "median"]
        middle = medians(both)
        if bands == 1:
            middle = middle.select("zone", "median")
        else:
            middle = middle.groupBy("zone").agg(*(F.max(F.when(F.col("band") == k, F.col("median"))).alias(f"band_{k}_median") for k in range(1, bands + 1)))
        order = ["zone", *(names if bands == 1 else [f"band_{k}_{n}" for k in range(1, bands + 1) for n in names])]
        return (zonal_aggregate(both, rest, bands).join(middle, "zone") if rest else middle).select(*order)
    if bands == 1:
        return both.groupBy("zone").agg(*(_AGG[n](F.col("value")).alias(n) for n in names))
    own = lambda k: F.when(F.col("band") == k, F.col("value"))
    return both.groupBy("zone").agg(*(_AGG[n](own(k)).alias(f"band_{k}_{n}") for k in range(1, bands + 1) for n in names))


#: Values of a zone that one task may hold for its median.
DIRECT = 1 << 20


def _largest(both: DataFrame, bands: int) -> int:
    keys = ["zone", "band"] if bands > 1 else ["zone"]
    return both.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def medians(both: DataFrame, few: int = 4096, accuracy: int = 2000) -> DataFrame:
    """zone, band, median, exact, by selection: no task holds a zone's values.

    The middle one or two ranks are bracketed. A round takes, of the values between a rank's limits, two that an approximate
    percentile (a mergeable summary of bounded size) puts on either side of it, and counts exactly what lies below, at and
    between them; the rank is then at one of them or strictly between two limits that are closer. A round leaves about
    three in 512 of the values. Ranks with ``few`` values left are read from these, sorted.
    """
    both = cut(both.select("zone", "band", "value"))
    sizes = both.groupBy("zone", "band").count()
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("count") - 1) / 2), F.floor(F.col("count") / 2))))
    inf = float("inf")
    # lo and hi are exclusive; below: values up to lo; n: values between
    todo = cut(sizes.select("zone", "band", ranks.alias("rank"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("count").alias("n")))
    found: list[DataFrame] = []
    keys, v = ["zone", "band", "rank"], F.col("value")
    while not todo.isEmpty():
        within = both.join(todo, ["zone", "band"]).where((v > F.col("lo")) & (v < F.col("hi")))
        place = (F.col("rank") - F.col("below") + 1).cast("int")
        small = within.where(F.col("n") <= few).groupBy(*keys, "below").agg(F.sort_array(F.collect_list("value")).alias("values"))
        found.append(cut(small.select(*keys, F.element_at("values", place).alias("value"))))
        large = within.where(F.col("n") > few)
        share = (F.col("rank") - F.col("below") + 0.5) / F.col("n")
        # one summary a rank; which of its points are taken follows from the rank
        points = F.percentile_approx("value", F.array(*(F.lit(k / 512) for k in range(513))), F.lit(accuracy)).alias("points")
        summary = large.groupBy(*keys, "lo", "hi", "below", "n").agg(points)
        return_ = summary.withColumn("k", F.floor(share * 512).cast("int"))
        cuts = return_.select(*keys, "lo", "hi", "below", "n", F.element_at("points", F.greatest(F.col("k"), F.lit(1))).alias("a"), F.element_at("points", F.least(F.col("k") + 3, F.lit(513))).alias("b"))
        counted = large.join(cuts.select(*keys, "a", "b"), keys).groupBy(*keys, "lo", "hi", "below", "a", "b").agg(
            F.sum((v < F.col("a")).cast("long")).alias("low"), F.sum((v == F.col("a")).cast("long")).alias("at_a"),
            F.sum(((v > F.col("a")) & (v < F.col("b"))).cast("long")).alias("mid"), F.sum(((v == F.col("b")) & (F.col("b") > F.col("a"))).cast("long")).alias("at_b"), F.count(F.lit(1)).alias("n"),
        )
        ends, at = [F.col("below")], F.col("rank")
        for c in ("low", "at_a", "mid", "at_b"):
            ends.append(ends[-1] + F.col(c))
        hit = F.when((at >= ends[1]) & (at < ends[2]), F.col("a")).when((at >= ends[3]) & (at < ends[4]), F.col("b"))
        state = cut(counted.withColumn("hit", hit))
        found.append(state.where("hit is not null").select(*keys, F.col("hit").alias("value")))
        left = state.where("hit is null")
        in_low, in_mid = at < ends[1], (at >= ends[2]) & (at < ends[3])
        pick = lambda low, mid, high: F.when(in_low, low).when(in_mid, mid).otherwise(high)
        todo = cut(left.select(
            *keys, pick(F.col("lo"), F.col("a"), F.col("b")).alias("lo"), pick(F.col("a"), F.col("b"), F.col("hi")).alias("hi"),
            pick(F.col("below"), ends[2], ends[4]).alias("below"), pick(F.col("low"), F.col("mid"), F.col("n") - (ends[4] - F.col("below"))).alias("n"),
        ))
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every.groupBy("zone", "band").agg(F.avg("value").alias("median"))


def _limits(r: Raster, value_range: tuple[float, float] | None) -> DataFrame:
    """band, lo, hi: one row a band."""
    bands = r.df.sparkSession.range(1, r.meta.band_count + 1).select(F.col("id").cast("int").alias("band"))
    if value_range:
        return bands.select("band", F.lit(float(value_range[0])).alias("lo"), F.lit(float(value_range[1])).alias("hi0")).select("band", "lo", F.when(F.col("hi0") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi0")).alias("hi"))
    got = r.df.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi0"))
    lo = F.coalesce("lo", F.lit(0.0))
    return bands.join(got, "band", "left").select("band", lo.alias("lo"), F.when(F.coalesce("hi0", F.lit(1.0)) <= lo, lo + 1).otherwise(F.coalesce("hi0", F.lit(1.0))).alias("hi"))


def edge(lo: Column, hi: Column, k: Column, bins: int) -> Column:
    return lo + k * ((hi - lo) / bins)


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of the bin; values on an edge go by comparison with that edge, the last bin is closed."""
    k = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    k = F.when(v < edge(lo, hi, k, bins), k - 1).when((v >= edge(lo, hi, k + 1, bins)) & (k < bins - 1), k + 1).otherwise(k)
    return F.greatest(k, F.lit(0))


def raster_histogram(r: Raster, bins: int = 256, value_range: tuple[float, float] | None = None) -> DataFrame:
    """band, bin, count, edge_lo, edge_hi; every bin has a row, values outside of the range are left out."""
    limits = _limits(r, value_range)
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("value")
    counts = (
        r.df.where("value is not null").join(F.broadcast(limits), "band").where(v.between(lo, hi))
        .groupBy("band", bin_of(v, lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    every = limits.select("band", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    k = F.col("bin")
    return every.join(counts, ["band", "bin"], "left").select(
        "band", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"), edge(lo, hi, k, bins).alias("edge_lo"),
        F.when(k == bins - 1, hi).otherwise(edge(lo, hi, k + 1, bins)).alias("edge_hi"),
    )


def raster_cumulative_distribution(r: Raster, bins: int = 256, value_range: tuple[float, float] | None = None) -> DataFrame:
    """bin, cdf over all bands together, with the edges."""
    flat = r.derive(r.df.withColumn("band", F.lit(1)), band_count=1)
    w = Window.partitionBy("band").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    return raster_histogram(flat, bins, value_range).select("bin", F.sum("count").over(w).alias("cdf"), "edge_lo", "edge_hi")


def raster_percentile(r: Raster, percentiles: float | list[float], bins: int = 256) -> DataFrame:
    """band, percentile, value: the left edge of the first bin whose cumulative count reaches the target."""
    wanted = [float(p) for p in (percentiles if isinstance(percentiles, (list, tuple)) else [percentiles])]
    if any(not 0 <= p <= 100 for p in wanted):
        raise ValueError("percentiles are from 0 to 100")
    w = Window.partitionBy("band").orderBy("bin")
    cdf = raster_histogram(r, bins).withColumn("cdf", F.sum("count").over(w)).withColumn("total", F.sum("count").over(Window.partitionBy("band")))
    at = cdf.select("band", "edge_lo", "cdf", "total", F.explode(F.array(*map(F.lit, wanted))).alias("percentile"))
    hit = F.when((F.col("total") > 0) & (F.col("cdf") >= F.col("percentile") / 100 * F.col("total")), F.col("edge_lo"))
    return at.groupBy("band", "percentile").agg(F.coalesce(F.min(hit), F.lit(float("nan"))).alias("value"))


def raster_histogram_equalize(r: Raster) -> Raster:
    """uint8 by the 256-bin cumulative distribution of each band (a lookup table of 256 rows a band, broadcast)."""
    is_u8 = r.meta.dtype == "uint8"
    v = F.col("value")
    limits = r.df.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor(F.least(F.greatest((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, F.lit(0.0)), F.lit(255.0)))).otherwise(F.lit(0))
    df = r.df.join(F.broadcast(limits), "band").withColumn("level", F.when(v.isNotNull(), (v if is_u8 else scaled).cast("int")))
    span, base = (254, 1) if not is_u8 and r.meta.nodata is not None else (255, 0)
    w = Window.partitionBy("band").orderBy("level")
    lut = df.where("level is not null").groupBy("band", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("cdf", F.sum("n").over(w))
    whole = Window.partitionBy("band")
    lut = lut.withColumns({"first": F.min("cdf").over(whole), "total": F.max("cdf").over(whole)}).select(
        "band", "level", F.when(F.col("total") > F.col("first"), F.rint((F.col("cdf") - F.col("first")) / (F.col("total") - F.col("first")) * span + base)).otherwise(0.0).alias("new")
    )
    out = df.join(F.broadcast(lut), ["band", "level"], "left").withColumn("value", F.col("new"))
    nodata = r.meta.nodata if is_u8 else 0.0 if r.meta.nodata is not None else None
    return r.derive(out, dtype="uint8", nodata=nodata)
