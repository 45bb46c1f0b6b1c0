"""Aggregations over measurement tables: the conventional queries of benchmark analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_stats(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """count, sum, avg, min, max and sample standard deviation of a value by group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), digits).alias("mean"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_samp(v), digits).alias("sd"),
    )


def two_level(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Sum over the outer group of the inner groups' averages."""
    means = df.groupBy(*inner).agg(F.avg(value).alias("m"))
    return means.groupBy(*outer).agg(F.round(F.sum("m"), 4).alias("sum_of_means"), F.count("*").alias("groups"))


def time_to_share(df: DataFrame, keys: list[str], elapsed: str, done: str, shares=(50, 90, 100)) -> DataFrame:
    """When each group first reached a share of its final count."""
    most = df.groupBy(*keys).agg(F.max(done).alias("__most"))
    rows = df.join(most, keys)
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col(done) * 100 >= F.col("__most") * s, F.col(elapsed))).alias(f"to_{s}") for s in shares])


def quantiles(df: DataFrame, keys: list[str], value: str, at=(0.5, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """Exact interpolated quantiles by group."""
    found = df.groupBy(*keys).agg(F.percentile(value, list(at)).alias("__q"))
    return found.select(*keys, *[F.round(F.col("__q")[i], 6).alias("p" + f"{q * 100:g}".replace(".", "_")) for i, q in enumerate(at)])


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at place floor(n * share), from 0, at most n - 1, of the sorted values (nulls first).
    Two approximate quantiles bracket the place; what lies below is only counted, and just the values
    between them, a few in a thousand, are sorted."""
    near = F.percentile_approx(value, [max(0.0, share - 0.002), min(1.0, share + 0.002)], 2000)
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"), near.alias("__b"))
    place = F.least(F.floor(F.col("__n") * F.lit(share)), F.col("__n") - 1) + 1
    groups = groups.select(*keys, place.alias("__place"), F.col("__b")[0].alias("__low"), F.col("__b")[1].alias("__high"))
    rows = df.select(*keys, value).join(groups, keys)
    below = rows.groupBy(*keys).agg(F.count_if(F.col(value).isNull() | (F.col(value) < F.col("__low"))).alias("__below"), F.count_if(F.col(value).isNull() | (F.col(value) <= F.col("__high"))).alias("__upto"))
    hit = (F.col("__place") > F.col("__below")) & (F.col("__place") <= F.col("__upto"))
    # a bracket that misses its place (or a group of nulls) is widened to the whole group
    open_ = rows.join(below, keys).withColumn("__hit", F.coalesce(hit, F.lit(False)))
    inside = open_.where(~F.col("__hit") | F.col(value).between(F.col("__low"), F.col("__high")))
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) + F.when(F.col("__hit"), F.col("__below")).otherwise(0))
    return ranked.where("__r = __place").select(*keys, F.col(value).alias("value"))


def pivot(df: DataFrame, row: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """One column for each value, by conditional maxima."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == v, measure)).alias(v.lower().replace(" ", "_")) for v in values])


def peak_rate(samples: DataFrame, keys: list[str], t: str, count: str, window: float) -> DataFrame:
    """The highest rate over windows that end at the first sample at least ``window`` later. Each
    sample is joined by a probe at its time plus the window; in falling order of time a probe's sample
    is the last one passed. This runs within stretches of time one window long, with the first sample
    of the stretches after carried in, so no frame is read twice and no key is one task."""
    seen = F.struct(F.col(t).alias("t"), F.col(count).alias("c"))
    stretch = F.floor(F.col("at") / F.lit(window))
    both = samples.select(*keys, F.explode(F.array(F.struct(F.col(t).alias("at"), seen.alias("seen"), F.lit(0).alias("probe")), F.struct((F.col(t) + F.lit(window)).alias("at"), seen.alias("seen"), F.lit(1).alias("probe")))).alias("x"))
    both = both.select(*keys, "x.*").withColumn("stretch", stretch).withColumn("sample", F.when(F.col("probe") == 0, F.col("seen")))
    falling = Window.partitionBy(*keys, "stretch").orderBy(F.desc("at"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    edges = both.groupBy(*keys, "stretch").agg(F.min("sample").alias("edge")).withColumn("carried", F.last("edge", ignorenulls=True).over(later)).drop("edge")
    probes = both.withColumn("near", F.last("sample", ignorenulls=True).over(falling)).where("probe = 1").join(edges, [*keys, "stretch"])
    ahead = probes.withColumn("ahead", F.coalesce("near", "carried")).where("ahead is not null")
    rate = (F.col("ahead.c") - F.col("seen.c")) / (F.col("ahead.t") - F.col("seen.t"))
    return ahead.groupBy(*keys).agg(F.round(F.max(rate), 6).alias("peak"))


def as_views(spark, paths: dict[str, str]) -> None:
    """Measurement files as temporary views, for SQL over them by name."""
    for name, path in paths.items():
        (spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)).createOrReplaceTempView(name)
