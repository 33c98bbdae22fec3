"""Expanded size distributions, histograms, density curves, fits and two-sample tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towline.operators.joins import null_safe_join
from towline.operators.ordering import brackets, bracketed, range_pieces, running_extremes, select_quantiles, with_group_values

# Rows that one step of the row expansion makes at most from one input row.
EXPANSION_PIECE = 50_000


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by ``keys`` to a fixed number of partitions, which adaptive execution does not merge."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def allocate_lengths(
    measured: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    height: str,
    total: str,
    scale: int = 10,
    step: int = 1,
) -> DataFrame:
    """Share the animals caught but not measured over the measured size bins.

    Heights are binned on whole numbers: ``scale`` units to one, bins of ``step`` units. A group
    is grown when something was caught, more than one animal was measured and more than one is
    missing. Each bin gets its proportional share rounded down, and what is left goes one each
    to the largest remainders, ties to the smaller bin. Returns
    ``(*keys, bin_units, bin, measured, added)``.
    """
    keys = list(keys)
    units = (F.floor(F.round(F.col(height) * scale) / step) * step).cast("bigint")
    bins = (
        measured.where(F.col(height).isNotNull())
        .groupBy(*keys, units.alias("bin_units"))
        .agg(F.count(F.lit(1)).alias("measured"))
    )
    joined = null_safe_join(bins, totals.select(*keys, F.col(total).cast("bigint").alias("__total")), keys, "left")
    # Several sorts of a group's rows are held at once here and in what follows on the keys, several times the bytes by which
    # adaptive execution would merge partitions.
    joined = _spread(joined, keys)
    group = Window.partitionBy(*keys)
    need = F.col("__total") - F.col("__m")
    grown = (F.col("__total") > 0) & (F.col("__m") > 1) & (need > 1)
    shared = joined.withColumn("__m", F.sum("measured").over(group))
    shared = shared.withColumn("__need", F.when(grown, need).otherwise(F.lit(0)).cast("bigint"))
    shared = shared.withColumns(
        {"__base": F.expr("(__need * measured) div __m"), "__rem": F.expr("(__need * measured) % __m")}
    )
    left = F.col("__need") - F.sum("__base").over(group)
    place = F.row_number().over(group.orderBy(F.col("__rem").desc(), F.col("bin_units")))
    extra = F.when(place <= left, 1).otherwise(0)
    return shared.select(
        *keys,
        "bin_units",
        (F.col("bin_units") / F.lit(float(scale))).alias("bin"),
        "measured",
        (F.col("__base") + extra).cast("bigint").alias("added"),
    )


def repeat_rows(df: DataFrame, count: str, piece: int = EXPANSION_PIECE) -> DataFrame:
    """Each row ``count`` times. Long repeats are cut in pieces that spread over the tasks."""
    pieces = df.where(F.col(count) > 0).withColumn(
        "__p", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / piece).cast("int")))
    )
    # A fixed number of partitions: adaptive merging would go by the few bytes of the pieces.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = pieces.repartition(tasks, *pieces.columns)
    size = F.least(F.lit(piece), F.col(count) - F.col("__p") * piece)
    return spread.withColumn("__i", F.explode(F.sequence(F.lit(1), size))).drop("__p", "__i", count)


def expand_lengths(
    measured: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    height: str,
    total: str,
    scale: int = 10,
    step: int = 1,
) -> DataFrame:
    """Measured rows and the rows added for animals not measured: ``(*keys, height, added)``."""
    added = allocate_lengths(measured, totals, keys, height, total, scale, step)
    new = repeat_rows(added.select(*keys, F.col("bin").alias(height), "added"), "added")
    old = measured.select(*keys, F.col(height).cast("double").alias(height), F.lit(False).alias("added"))
    return old.unionByName(new.select(*keys, height, F.lit(True).alias("added")))


def reconcile_totals(counts: DataFrame, totals: DataFrame, keys: Sequence[str], n: Column | str, total: str) -> DataFrame:
    """Compare the expanded number of animals with the number caught, group by group."""
    value = F.col(n) if isinstance(n, str) else n
    left = counts.groupBy(*keys).agg(F.sum(value).cast("bigint").alias("expanded"))
    right = totals.groupBy(*keys).agg(F.sum(total).cast("bigint").alias("caught"))
    joined = left.join(right, list(keys), "full").fillna(0, subset=["expanded", "caught"])
    return joined.withColumn("difference", F.col("expanded") - F.col("caught"))


def histogram(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    width: float | None = None,
    bins: int | None = None,
    low: float = 0.0,
    weight: str | None = None,
) -> DataFrame:
    """Counts per bin: ``(*by, bin, low, n)``, empty bins with 0.

    ``width`` cuts from ``low`` on, and each group has all bins between its lowest and highest; ``bins`` cuts the range
    of the whole table into equal parts, the last one closed, and each group has all of them.
    """
    value = F.col(x).cast("double")
    rows = df.where(F.col(x).isNotNull())
    if width is not None:
        start, size = F.lit(float(low)), F.lit(float(width))
        number = F.floor((value - start) / size)
    elif bins is not None:
        ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        rows = rows.withColumns({"__lo": ends.select("lo").scalar(), "__hi": ends.select("hi").scalar()})
        start, size = F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins
        number = F.least(F.floor(F.coalesce(F.try_divide(value - start, size), F.lit(0.0))), F.lit(bins - 1))
    else:
        raise ValueError("give width or bins")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cut = rows.withColumns({"bin": number.cast("bigint"), "__start": start, "__size": size})
    out = cut.groupBy(*by, "bin", "__start", "__size").agg(n.cast("bigint").alias("n"))
    ends = (F.min("bin"), F.max("bin")) if bins is None else (F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    groups = out.groupBy(*by, "__start", "__size").agg(F.sequence(*ends).alias("bins"))
    empty = groups.select(*by, F.explode("bins").alias("bin"), "__start", "__size", F.lit(0).cast("bigint").alias("n"))
    out = out.unionByName(empty).groupBy(*by, "bin", "__start", "__size").agg(F.sum("n").alias("n"))
    return out.select(*by, "bin", (F.col("__start") + F.col("bin") * F.col("__size")).alias("low"), "n")


def _bandwidth(n: Column, sd: Column, iqr: Column) -> Column:
    """Rule of thumb 0.9 min(sd, IQR / 1.34) n^-0.2; for groups without spread as if it were 1."""
    zero = F.lit(0.0)
    spread = F.coalesce(F.nullif(F.least(sd, iqr / 1.34), zero), F.nullif(sd, zero), F.lit(1.0))
    return F.lit(0.9) * spread * F.pow(n, F.lit(-0.2))


def density_grid(
    df: DataFrame,
    x: str,
    by: Sequence[str],
    bw: float | None = None,
    points: int = 128,
    bins: int = 256,
) -> DataFrame:
    """Gaussian density curve per group on an even grid over the group's range: ``(*by, point, x, density)``.

    Values are first counted in ``bins`` cells and each cell stands at its midpoint, so the curve costs cells x points per
    group however many rows there are. Two scans: the first takes counts, ranges, deviations and the brackets of the
    quartiles, the second counts cells and bracketed values together. Without ``by`` the whole table is the group.
    """
    by, quartiles = list(by), (0.25, 0.75)
    rows = df.select(*by, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    first = [F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.stddev_samp("__x").alias("sd")]
    stats = rows.groupBy(*by).agg(*brackets("__x", quartiles), *first).where("n > 0")
    joined = with_group_values(rows, stats, by)
    share = F.coalesce(F.try_divide(F.col("__x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    cell = F.least(F.floor(share * bins), F.lit(bins - 1))
    group = [*by, "n", "lo", "hi", "sd"]
    if bw is None:
        above, inside = bracketed("__x", len(quartiles))
        counts = joined.groupBy(*group, cell.alias("__cell"), above.alias("__above"), inside.alias("__inside")).agg(F.count(F.lit(1)).alias("__c"))
        ranked = counts.groupBy(*by, "n", "__above", "__inside").agg(F.sum("__c").alias("__c"))
        found = select_quantiles(ranked, by, quartiles, "q")
        iqr = found.groupBy(*by).agg((F.max("q") - F.min("q")).alias("iqr"))
        cells = counts.groupBy(*group, "__cell").agg(F.sum("__c").alias("__c"))
        cells = with_group_values(cells, iqr, by).withColumn("bw", _bandwidth(F.col("n"), F.col("sd"), F.col("iqr")))
    else:
        cells = joined.groupBy(*group, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__c")).withColumn("bw", F.lit(float(bw)))
    middle = F.col("lo") + (F.col("__cell") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    spread = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = (at - middle) / F.col("bw")
    kernel = F.col("__c") * F.exp(z * z * F.lit(-0.5)) / (F.col("n") * F.col("bw") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.groupBy(*by, "point", at.alias("x")).agg(F.sum(kernel).alias("density"))


def linear_fit(df: DataFrame, y: Column | str, x: Column | str, by: Sequence[str]) -> DataFrame:
    """Least-squares line per group: slope, intercept and r2."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def log_log_fit(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Allometric fit ``ln y = a + b ln x``; values without a logarithm are left out."""
    positive = df.where((F.col(x) > 0) & (F.col(y) > 0))
    return linear_fit(positive, F.ln(y), F.ln(x), by)


def min_group_size(df: DataFrame, by: Sequence[str], more_than: int) -> DataFrame:
    """Rows of groups that have more than so many rows."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > more_than)
    return null_safe_join(df, sizes.select(*by), by, "left_semi")


def ks_two_sample(df: DataFrame, by: Sequence[str], group: str, x: str, first: object, second: object) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group and its asymptotic p-value.

    Equal values are counted before they are ordered. The distance is an extreme of the running sum of the samples' shares,
    taken over pieces of range partitions, so no group is ordered in one task. Groups that lack one of the samples drop.
    Without ``by`` the whole table is the group.
    """
    by = list(by)
    one, two = F.col(group) == F.lit(first), F.col(group) == F.lit(second)
    rows = df.where((one | two) & F.col(x).isNotNull()).select(*by, F.col(x).alias("__x"), one.cast("bigint").alias("c1"), two.cast("bigint").alias("c2"))
    ties = rows.groupBy(*by, "__x").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    sizes = ties.groupBy(*by).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")).where("n1 > 0 and n2 > 0")
    # Whole numbers: both shares are brought to the common denominator n1 * n2.
    step = F.col("c1").cast("double") * F.col("n2") - F.col("c2").cast("double") * F.col("n1")
    steps = with_group_values(ties, sizes, by).select(*by, "n1", "n2", "__x", step.alias("gap"))
    keys = [*by, "n1", "n2"]
    ends = running_extremes(range_pieces(steps, keys, "__x", ["gap"]), keys, ["gap"])
    widest = F.greatest(F.abs("low_gap"), F.abs("high_gap"))
    d = ends.select(*keys, (widest / (F.col("n1").cast("double") * F.col("n2"))).alias("d"))
    lam2 = F.col("d") * F.col("d") * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    d = d.withColumn("__l", lam2)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * F.col("__l")),
    )
    p = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) * 2
    # The alternating series does not settle for a distance near 0, where p is 1.
    p = F.when(F.col("__l") < 0.01, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return d.withColumn("p_value", p).drop("__l")


def interval_table(df: DataFrame, keep: Sequence[str], interval: Mapping[str, str], scale: float = 1e-6) -> DataFrame:
    """Point and interval ends rescaled for plotting: ``{new name: column}``."""
    return df.select(*keep, *[(F.col(c) * F.lit(scale)).alias(n) for n, c in interval.items()])
