"""Distribution statistics that hold up when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlens.operators.joins import join_measured
from epochlens.session import cut_lineage

SKETCH = 10_000
PERCENTILES = [("p5", 0.05), ("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p95", 0.95)]


def score_of(mode: Column, min_score: Column, max_score: Column) -> Column:
    """The score that represents a file: the larger end for entropy and validators, the smaller
    one for chi-square, and whichever exists otherwise."""
    low, high = _number(min_score), _number(max_score)
    name = F.lower(F.trim(mode))
    return (
        F.when(name.isin("entropy", "txt_fav", "zip_fav"), high)
        .when(name == "chi2", low)
        .otherwise(F.coalesce(high, low))
    )


def _number(text: Column) -> Column:
    bare = F.trim(text.cast("string"))
    return F.when(~F.lower(bare).isin("", "nan"), bare.try_cast("double"))


def exact_percentiles(
    df: DataFrame, groups: list[str], value: str, points: list[tuple[str, float]] = PERCENTILES,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group.

    ``percentile`` would hold all distinct values of a group in one task. Here a sketch brackets
    each target rank; rows are then counted below the bracket and only the rows inside it
    (about 6 / SKETCH of a group) are ranked.
    """
    eps = 3.0 / SKETCH
    data = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(
        F.count("*").alias("_c")
    )
    clean = df.filter(F.col(value).isNotNull())
    ends = [max(p - eps, 0.0) for _, p in points] + [min(p + eps, 1.0) for _, p in points]
    brackets = clean.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.percentile_approx(value, ends, SKETCH).alias("_q"),
    )
    whole = F.col("_n") <= SKETCH
    targets = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            (F.lit(p) * (F.col("_n") - 1)).alias("pos"),
            # Groups no larger than the sketch are ranked whole: their bracket is the full range.
            F.when(whole, F.col("_min")).otherwise(F.col("_q")[i]).alias("lo"),
            F.when(whole, F.col("_max")).otherwise(F.col("_q")[i + len(points)]).alias("hi"),
        )
        for i, (name, p) in enumerate(points)
    ])
    spec = brackets.select(*groups, "_n", targets.alias("_t"))
    return _ranked(data, spec, groups, len(points))


def _ranked(counts: DataFrame, spec: DataFrame, key: list[str], n_targets: int) -> DataFrame:
    joined = join_measured(counts, spec, key)
    v = F.col("_v")
    inside = joined.select(
        *key, "_v", "_c",
        F.explode(F.filter("_t", lambda t: (v >= t["lo"]) & (v <= t["hi"]))).alias("t"),
    ).select(*key, "t.name", "t.pos", "_v", "_c")
    # Everything below a bracket is one sum per target, made before the shuffle.
    sums = joined.groupBy(*key).agg(
        F.first("_t").alias("_t"),
        *[F.sum(F.when(v < F.col("_t")[i]["lo"], F.col("_c"))).alias(f"_b{i}") for i in range(n_targets)],
    )
    below = sums.select(*key, F.explode(F.array(*[
        F.struct(F.col("_t")[i]["name"].alias("name"), F.col("_t")[i]["pos"].alias("pos"), F.col(f"_b{i}").alias("_c"))
        for i in range(n_targets)
    ])).alias("b")).select(*key, "b.name", "b.pos", F.lit(None).cast("double").alias("_v"), "b._c").filter("_c IS NOT NULL")
    slim = inside.select(*key, "name", "pos", v.cast("double").alias("_v"), "_c").unionByName(below)
    w = Window.partitionBy(*key, "name").orderBy(F.col("_v").asc_nulls_first())
    ranked = slim.withColumn("_upto", F.sum("_c").over(w)).withColumn(
        "_from", F.col("_upto") - F.col("_c")
    )
    low, high = F.floor("pos"), F.ceil("pos")
    holds = lambda r: (F.col("_from") <= r) & (r < F.col("_upto"))
    ends = ranked.groupBy(*key, "name").agg(
        F.max("pos").alias("pos"),
        F.max(F.when(holds(low), F.col("_v"))).alias("a"),
        F.max(F.when(holds(high), F.col("_v"))).alias("b"),
    )
    frac = F.col("pos") - F.floor("pos")
    value = F.when(frac == 0, F.col("a")).otherwise(F.col("a") * (1 - frac) + F.col("b") * frac)
    return ends.select(*key, "name", value.alias("value"))


def basic_stats(
    df: DataFrame, groups: list[str], value: str, points: list[tuple[str, float]] = PERCENTILES,
) -> DataFrame:
    """count, min, max, mean, population standard deviation and percentiles per group."""
    key = groups or ["_one"]
    src = df if groups else df.withColumn("_one", F.lit(0))
    simple = src.filter(F.col(value).isNotNull()).groupBy(*key).agg(
        F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )
    pct = exact_percentiles(src, key, value, points)
    wide = pct.groupBy(*key).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n, _ in points]
    )
    out = simple.join(wide, key)
    return out if groups else out.drop("_one")


def histogram(df: DataFrame, groups: list[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins per group, empty ones included. The maximum falls in the last bin; a
    constant group gets a narrow range around its value."""
    clean = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    eps = F.when(F.col("_lo") == 0, F.lit(1e-9)).otherwise(F.abs("_lo") * 1e-3)
    flat = F.col("_lo") == F.col("_hi")
    key = groups or ["_one"]
    if not groups:
        clean = clean.withColumn("_one", F.lit(0))
    bounds = (
        clean.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .select(
            *key,
            F.when(flat, F.col("_lo") - eps).otherwise(F.col("_lo")).alias("_lo"),
            F.when(flat, F.col("_hi") + eps).otherwise(F.col("_hi")).alias("_hi"),
        )
        .withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    )
    bounds = cut_lineage(bounds)
    placed = join_measured(clean, bounds, key, ready=True)
    index = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counted = placed.groupBy(*key, index.alias("bin")).agg(F.count("*").alias("_n"))
    frame = bounds.select(
        *key, "_lo", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    out = frame.join(counted, [*key, "bin"], "left").select(
        *key, "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * F.col("_w") + F.col("_w")).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )
    return out if groups else out.drop("_one")


def bar_lines(rows: list[tuple[float, float, int]], width: int = 50) -> list[str]:
    """Text bars of one small histogram for a terminal."""
    top = max((c for _, _, c in rows), default=0) or 1
    return [f"[{a:.4g}, {b:.4g}) {'#' * round(width * c / top)} {c}" for a, b, c in rows]
