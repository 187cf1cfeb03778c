"""Cohort statistics from moments, counts and distributed ranks.

Every function takes a *long* table (feature, group, value), so all features are handled by one
pass, and no group is ever gathered: moments combine map-side, ranks come from ordered slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.functions import pvalues as P
from oscilla.operators.cohort import null_safe_join
from oscilla.operators.ordering import (
    SLICE,
    _attach_carry,
    average_rank,
    exact_percentiles,
    number_rows,
    running_sum,
    slice_by_order,
    tie_ranks,
)
from oscilla.session import durable

# Expected sign of change with clinical severity.
EXPECTED_DIRECTIONS = {
    "mean_amplitude": -1,
    "hilbert_amplitude": -1,
    "integral_amplitude": -1,
    "mean_frequency": -1,
    "avg_cycle_duration": 1,
    "peak_velocity": -1,
    "mean_velocity": -1,
    "global_velocity": -1,
    "norm_decrement_slope": -1,
    "raw_amp_slope": -1,
    "amp_decrement_onset": -1,
    "amp_decrement_pct": 1,
    "norm_ti_slope": 1,
    "raw_cycle_duration_slope": 1,
    "norm_velocity_decrement_slope": -1,
    "raw_velocity_slope": -1,
    "raw_speed_slope": -1,
    "velocity_decrement_onset": -1,
    "velocity_decrement_pct": 1,
    "amplitude_cv": 1,
    "rhythm_cv": 1,
    "cycle_duration_cv": 1,
    "peak_velocity_cv": 1,
    "mean_velocity_cv": 1,
    "num_hesitations": 1,
    "num_arrests": 1,
    "num_interruptions": 1,
    "max_pause_duration_s": 1,
    "pause_time_ratio": 1,
    "sample_entropy": 1,
    "amp_vel_coupling": -1,
    "arm_swing": 1,
    "composite_score": 1,
    "movement_vigor": -1,
    "amp_vel_product": -1,
    "fatigue_index": 1,
    "irregularity_burden": 1,
    "clinical_composite_v2": 1,
}


def long_features(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids..., feature, value) with missing values dropped."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    long = typed.unpivot(list(ids), list(features), "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def expected_direction(feature: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXPECTED_DIRECTIONS.items() for x in pair])
    return F.try_element_at(table, feature)


def _rank_table(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of each distinct value, with its tie count."""
    distinct = counts.groupBy(*keys, value).agg(F.sum("n").alias("_w"))
    ranked = tie_ranks(distinct, keys, value, "_w")
    return ranked.select(*keys, value, average_rank().alias("rank"), "ties")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, with_p: bool = True) -> DataFrame:
    """Spearman rho (tie-averaged ranks) per key; NULL below five pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    counts = durable(pairs.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n")))
    rx = _rank_table(counts, keys, x).select(*keys, x, F.col("rank").alias("_rx"))
    ry = _rank_table(counts, keys, y).select(*keys, y, F.col("rank").alias("_ry"))
    ranked = null_safe_join(null_safe_join(counts, rx, [*keys, x]), ry, [*keys, y])
    n, mean = F.sum("n"), (F.sum("n") + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum(F.col("n") * F.col("_rx") * F.col("_ry")) - n * mean * mean).alias("_sxy"),
        (F.sum(F.col("n") * F.col("_rx") * F.col("_rx")) - n * mean * mean).alias("_sxx"),
        (F.sum(F.col("n") * F.col("_ry") * F.col("_ry")) - n * mean * mean).alias("_syy"),
    )
    return _rho(sums, keys, with_p)


def _rho(sums: DataFrame, keys: Sequence[str], with_p: bool) -> DataFrame:
    rho = F.col("_sxy") / F.nullif(F.sqrt(F.col("_sxx") * F.col("_syy")), F.lit(0.0))
    out = sums.select(*keys, "n", F.when(F.col("n") >= 5, rho).alias("rho"))
    if not with_p:
        return out
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1.0 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    exact = F.when(F.abs(F.col("rho")) >= 1.0, F.lit(0.0))
    return out.withColumn("p", F.coalesce(exact, P.t_p(t, F.col("n") - 2)))


def profile(df: DataFrame, keys: Sequence[str], group: str, value: str, order: Column | None = None) -> DataFrame:
    """One row per key and group with all that the tests over few groups need, from one ordered exchange.

    Beside ``n``, ``mean``, ``var`` (n-1), ``min``, ``max`` and the exact ``med`` it holds sums of ranks: ``_r`` and ``_q`` of the
    centred rank and its square among the rows whose ``order`` (the group itself by default) is known, ``_h`` and ``_t`` of the rank and
    of the tie term among the groups with at least two values.  Missing values and groups take no part.  A group is a
    step of a short scale: the table, and that of the group sizes, have one row per key and step.
    """
    clean = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, group, value)
    counts = clean.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_n"))
    sliced = slice_by_order(counts, keys, [value])
    v, every = F.col(value).cast("double"), Window.partitionBy(*(keys or [F.lit(0)]))
    sizes = sliced.groupBy(*keys, group).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * v) / F.sum("_n")).alias("mean"))
    sizes = sizes.withColumn("order", order if order is not None else F.col(group))
    known = F.when(F.col("order").isNotNull(), F.col("n"))
    sizes = durable(sizes.withColumn("_all", F.coalesce(F.sum(known).over(every), F.lit(0))))
    if keys:
        base = null_safe_join(sliced, sizes, [*keys, group])
    else:
        base = sliced.join(sizes, group)
    base = base.withColumns(
        {
            "_wr": F.when(F.col("order").isNotNull(), F.col("_n")).otherwise(0),
            "_wh": F.when(F.col("n") >= 2, F.col("_n")).otherwise(0),
        }
    )
    peers = Window.partitionBy(SLICE, *keys).orderBy(value)
    upto = peers.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = peers.rangeBetween(Window.currentRow, Window.currentRow)
    own = Window.partitionBy(SLICE, *keys, group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select(
        "*",
        *[F.sum(f"_w{c}").over(equal).alias(f"_t{c}") for c in "rh"],
        *[(F.sum(f"_w{c}").over(upto) - F.sum(f"_w{c}").over(equal)).alias(f"_b{c}") for c in "rh"],
        (F.sum("_n").over(own) - F.col("_n")).alias("_bg"),
    )
    ranked = _attach_carry(local, base, keys, {f"_b{c}": F.sum(f"_w{c}") for c in "rh"}, keep_slice=True)
    ranked = _attach_carry(ranked, base, [*keys, group], {"_bg": F.sum("_n")})
    middle = (F.col("n") - 1) / 2.0

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_bg") <= place) & (place < F.col("_bg") + F.col("_n")), v))

    centred = F.col("_br") + (F.col("_tr") - F.col("_all")) / 2.0
    plain, ties = F.col("_bh") + (F.col("_th") + 1) / 2.0, F.col("_th").cast("double")
    off = v - F.col("mean")
    found = ranked.groupBy(*keys, group, "n", "mean", "order").agg(
        F.sum(F.col("_n") * off * off).alias("_ss"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        ((at(F.floor(middle)) + at(F.ceil(middle))) / 2.0).alias("med"),
        F.sum(F.col("_wr") * centred).alias("_r"),
        F.sum(F.col("_wr") * centred * centred).alias("_q"),
        F.sum(F.col("_wh") * plain).alias("_h"),
        F.sum(F.col("_wh") * (ties * ties - 1.0)).alias("_t"),
    )
    return durable(found.withColumn("var", F.when(F.col("n") > 1, F.col("_ss") / (F.col("n") - 1))).drop("_ss"))


def spearman_of(profiled: DataFrame, keys: Sequence[str], with_p: bool = True) -> DataFrame:
    """Spearman rho between the order of the groups and the values, from :func:`profile`; NULL below five pairs."""
    steps = profiled.filter(F.col("order").isNotNull()).groupBy(*keys, "order").agg(F.sum("n").alias("_w"), F.sum("_r").alias("_r"), F.sum("_q").alias("_q"))
    every = Window.partitionBy(*(keys or [F.lit(0)]))
    below = F.sum("_w").over(every.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")
    x = below + (F.col("_w") - F.sum("_w").over(every)) / 2.0
    sums = steps.withColumn("_x", x).groupBy(*keys).agg(
        F.sum("_w").alias("n"),
        F.sum(F.col("_x") * F.col("_r")).alias("_sxy"),
        F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_sxx"),
        F.sum("_q").alias("_syy"),
    )
    return _rho(sums, keys, with_p)


def kruskal_of(profiled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H over the groups with at least two values, from :func:`profile`."""
    joined = profiled.filter(F.col("n") >= 2).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("n").alias("n"),
        F.sum(F.col("_h") * F.col("_h") / F.col("n")).alias("_s"),
        F.sum("_t").alias("_t"),
    )
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("_s") - 3.0 * (n + 1)
    correction = 1.0 - F.col("_t") / F.nullif(n * n * n - n, F.lit(0.0))
    return joined.select(
        *keys, F.col("_k").alias("n_groups"), "n", F.when(F.col("_k") >= 2, raw / F.nullif(correction, F.lit(0.0))).alias("h")
    ).withColumn("p", P.chi2_p(F.col("h"), F.col("n_groups") - 1))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H over the groups with at least two values."""
    return kruskal_of(profile(df, keys, group, value), keys)


def group_moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(*keys, group)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"),
        )
    )


def _cohen(m1: str, v1: str, n1: str, m2: str, v2: str, n2: str) -> Column:
    dof = F.col(n1) + F.col(n2) - 2
    pooled = F.sqrt(
        ((F.col(n1) - 1) * F.col(v1) + (F.col(n2) - 1) * F.col(v2)) / F.nullif(dof, F.lit(0))
    )
    ok = (F.col(n1) >= 2) & (F.col(n2) >= 2) & (pooled > 1e-9)
    return F.when(ok, (F.col(m2) - F.col(m1)) / F.nullif(pooled, F.lit(0.0)))


def effect_sizes(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Cohen's d of adjacent groups and of 0 against the highest, with Glass's delta.

    Works on the group moments, a table with one row per feature and score.
    """
    return effect_sizes_of(group_moments(df, keys, group, value), keys, group)


def effect_sizes_of(m: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """The same from a table of moments, :func:`group_moments` or :func:`profile`."""
    m = m.select(*keys, group, "n", "mean", F.coalesce("var", F.lit(0.0)).alias("var"))
    by = Window.partitionBy(*keys).orderBy(group)
    adjacent = (
        m.withColumns({f"_{c}": F.lead(c).over(by) for c in (group, "n", "mean", "var")})
        .filter((F.col("n") >= 2) & (F.col("_n") >= 2))
        .select(
            *keys,
            F.col(group).alias("low"),
            F.col(f"_{group}").alias("high"),
            F.lit("adjacent").alias("contrast"),
            _cohen("mean", "var", "n", "_mean", "_var", "_n").alias("d"),
            F.lit(None).cast("double").alias("glass_delta"),
        )
    )
    row = F.struct("n", "mean", "var")
    ends = (
        m.groupBy(*keys)
        .agg(
            F.max(F.when(F.col(group) == 0, row)).alias("z"),
            F.max(group).alias("high"),
            F.max_by(row, F.col(group)).alias("t"),
        )
        .filter(F.col("z").isNotNull() & (F.col("high") > 0))
        .select(
            *keys,
            "high",
            *[F.col(f"z.{c}").alias(f"z_{c}") for c in ("n", "mean", "var")],
            *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("n", "mean", "var")],
        )
        .filter((F.col("z_n") >= 2) & (F.col("t_n") >= 2))
    )
    sd0 = F.sqrt("z_var")
    extreme = ends.select(
        *keys,
        F.lit(0).cast("int").alias("low"),
        "high",
        F.lit("extreme").alias("contrast"),
        _cohen("z_mean", "z_var", "z_n", "t_mean", "t_var", "t_n").alias("d"),
        F.when(sd0 > 1e-9, (F.col("t_mean") - F.col("z_mean")) / F.nullif(sd0, F.lit(0.0))).alias(
            "glass_delta"
        ),
    )
    return adjacent.unionByName(extreme).withColumn("label", N.effect_label(F.col("d")))


def direction_check(effects: DataFrame) -> DataFrame:
    """Observed against expected direction of the extreme contrast."""
    extreme = effects.filter(F.col("contrast") == "extreme")
    expected = expected_direction(F.col("feature"))
    observed = F.coalesce(F.signum("d"), F.lit(0.0)).cast("int")
    return extreme.select(
        "feature",
        expected.alias("expected"),
        observed.alias("observed"),
        F.when(expected.isNull(), None)
        .when(observed == 0, "none")
        .when(observed == expected, "correct")
        .otherwise("wrong")
        .alias("direction"),
    )


def _group_medians(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    clean = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    medians = exact_percentiles(clean, [*keys, group], value, {"med": 0.5})
    moments = group_moments(clean, keys, group, value).filter(F.col("n") >= 2)
    return null_safe_join(moments, medians, [*keys, group])


def kendall_on_medians(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Kendall tau-b between group order and group medians (one row per score, so pairs are few)."""
    return _tau(_group_medians(df, keys, group, value), keys, group)


def _tau(m: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    packed = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(group, "med"))).alias("g"))
    # group keys are distinct and sorted, so only the later medians decide the sign of a pair
    sign_sum = F.aggregate(
        F.transform(
            "g",
            lambda a, i: F.aggregate(
                F.slice("g", i + 2, F.size("g")),
                F.lit(0.0),
                lambda s, b: s + F.signum(b["med"] - a["med"]),
            ),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    untied = F.aggregate(
        F.transform(
            "g",
            lambda a, i: F.aggregate(
                F.slice("g", i + 2, F.size("g")),
                F.lit(0.0),
                lambda s, b: s + F.abs(F.signum(b["med"] - a["med"])),
            ),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    k = F.size("g")
    pairs = k * (k - 1) / 2.0
    return packed.select(
        *keys,
        k.alias("n_groups"),
        F.when(k >= 3, sign_sum / F.nullif(F.sqrt(pairs * untied), F.lit(0.0))).alias("tau"),
    )


def dispersion_ratios(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Pooled within-group spread against total variance and against the spread of medians."""
    return _spread(_group_medians(df, keys, group, value), keys)


def _spread(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    total_n, k = F.sum("n"), F.count(F.lit(1))
    # total sum of squares = within + between, both from the group moments
    agg = m.groupBy(*keys).agg(
        total_n.alias("n"),
        k.alias("k"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("_ssw"),
        (F.sum(F.col("n") * F.col("mean")) / total_n).alias("_gm"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_nmm"),
        F.stddev_samp("med").alias("_sdm"),
    )
    within = F.col("_ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    between = F.col("_nmm") - F.col("n") * F.col("_gm") * F.col("_gm")
    total = (F.col("_ssw") + between) / F.nullif(F.col("n") - 1, F.lit(0))
    ok = (F.col("k") >= 2) & (F.col("n") > F.col("k"))
    return agg.select(
        *keys,
        F.when(
            ok & (total > 1e-12), F.least(F.lit(2.0), F.sqrt(within / F.nullif(total, F.lit(0.0))))
        ).alias("dispersion_ratio"),
        F.when(
            ok & (F.col("_sdm") >= 1e-12),
            F.least(F.lit(5.0), F.sqrt(within) / F.nullif(F.col("_sdm"), F.lit(0.0))),
        ).alias("spread_ratio"),
    )


def alignment(
    df: DataFrame,
    group: str,
    value: str,
    dispersion_weight: float = 0.20,
    monotonicity_weight: float = 0.30,
    spread_weight: float = 0.20,
) -> DataFrame:
    """Contribution of each feature to the clinical alignment score."""
    return alignment_of(profile(df, ["feature"], group, value), group, dispersion_weight, monotonicity_weight, spread_weight)


def alignment_of(
    profiled: DataFrame,
    group: str,
    dispersion_weight: float = 0.20,
    monotonicity_weight: float = 0.30,
    spread_weight: float = 0.20,
) -> DataFrame:
    """The same from the :func:`profile` of the features."""
    keys = ["feature"]
    rho = spearman_of(profiled, keys, with_p=False)
    medians = profiled.filter(F.col("n") >= 2)
    tau, spread = _tau(medians, keys, group), _spread(medians, keys)
    joined = (
        rho.withColumn("direction", expected_direction(F.col("feature")))
        .filter(F.col("direction").isNotNull())
        .join(tau, keys, "left")
        .join(spread, keys, "left")
    )
    signed = F.col("rho") * F.col("direction")
    contribution = (
        signed
        + monotonicity_weight * F.coalesce(F.col("tau") * F.col("direction"), F.lit(0.0))
        - dispersion_weight * F.coalesce("dispersion_ratio", F.lit(0.0))
        - spread_weight * F.coalesce("spread_ratio", F.lit(0.0))
    )
    return joined.select(
        "feature", "n", "rho", "tau", "dispersion_ratio", "spread_ratio", "direction",
        F.coalesce(contribution, F.lit(0.0)).alias("contribution"),
    )


def shapiro(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shapiro-Wilk W and p per key, from distributed order statistics."""
    clean = df.filter(F.col(value).isNotNull()).select(*keys, value)
    ordered = number_rows(clean, keys, [value], "_i")
    sizes = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("_v"), F.avg(value).alias("_mean")
    )
    if keys:
        joined = null_safe_join(ordered, sizes, keys)
    else:
        joined = ordered.withColumns({c: sizes.select(c).scalar() for c in ("n", "_v", "_mean")})
    score = P.normal_quantile_col((F.col("_i") + 0.625) / (F.col("n") + 0.25))
    scored = joined.withColumn("_m", score).withColumn("_x", F.col(value) - F.col("_mean"))

    def at(offset: int, column: str) -> Column:
        where = F.col("_i") == (F.lit(offset) if offset >= 0 else F.col("n") + offset)
        return F.max(F.when(where, F.col(column)))

    agg = scored.groupBy(*keys).agg(
        F.max("n").alias("n"),
        (F.max("n") * F.max("_v")).alias("_ss"),
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.sum(F.col("_m") * F.col("_x")).alias("_mx"),
        at(0, "_x").alias("_x0"),
        at(1, "_x").alias("_x1"),
        at(-2, "_x").alias("_y1"),
        at(-1, "_x").alias("_y0"),
        at(-1, "_m").alias("_m0"),
        at(-2, "_m").alias("_m1"),
    )
    u = 1.0 / F.sqrt("n")

    def poly(coefficients: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for c in coefficients:
            out = (out + c) * u
        return out

    # Royston's published polynomials for the two outer weights (fixed values)
    norm = F.sqrt("_mm")
    outer = poly([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157]) + F.col("_m0") / norm
    second = poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981]) + F.col("_m1") / norm
    m0, m1 = F.col("_m0") * F.col("_m0"), F.col("_m1") * F.col("_m1")
    inner_two = F.col("_mm") - 2 * m0 - 2 * m1
    phi = F.when(
        F.col("n") > 5, inner_two / (1.0 - 2.0 * outer * outer - 2.0 * second * second)
    ).otherwise((F.col("_mm") - 2 * m0) / (1.0 - 2.0 * outer * outer))
    ends = F.col("_y0") - F.col("_x0")
    seconds = F.col("_y1") - F.col("_x1")
    inner = F.col("_mx") - F.col("_m0") * ends
    weighted = (
        F.when(F.col("n") == 3, F.lit(0.5**0.5) * ends)
        .when(
            F.col("n") > 5,
            outer * ends + second * seconds + (inner - F.col("_m1") * seconds) / F.sqrt(phi),
        )
        .otherwise(outer * ends + inner / F.sqrt(phi))
    )
    w = F.when(F.col("n") >= 3, weighted * weighted / F.nullif(F.col("_ss"), F.lit(0.0)))
    return agg.select(*keys, "n", F.least(F.lit(1.0), w).alias("w")).withColumn(
        "p", P.shapiro_p_value(F.col("w"), F.col("n"))
    )


def mann_whitney_vs_lowest(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """U of every group against the lowest one, with its tie term.

    U counts, for each value of the other group, the reference values below it: a running sum of
    reference counts over the value order, shared by all comparisons.
    """
    clean = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = clean.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("n"))
    lowest = clean.groupBy(*keys).agg(F.min(group).alias("ref"))
    marked = null_safe_join(counts, lowest, keys)
    is_ref = F.col(group) == F.col("ref")
    ref_counts = (
        marked.groupBy(*keys, value)
        .agg(F.coalesce(F.sum(F.when(is_ref, F.col("n"))), F.lit(0)).alias("_here"))
    )
    upto = running_sum(ref_counts, keys, [value], {"_upto": "_here"})
    others = marked.filter(~is_ref)
    joined = null_safe_join(others, upto, [*keys, value])
    here, n = F.col("_here"), F.col("n")

    def tied(c: Column) -> Column:
        d = c.cast("double")
        return d * d * d - d

    per_pair = joined.groupBy(*keys, "ref", group).agg(
        F.sum("n").alias("n2"),
        F.sum(n * (F.col("_upto") - here * 0.5)).alias("_below"),
        F.sum(tied(here + n) - tied(here)).alias("_tie"),
    )
    reference = marked.filter(is_ref).groupBy(*keys).agg(
        F.sum("n").alias("n1"), F.sum(tied(n)).alias("_tie_ref")
    )
    both = null_safe_join(per_pair, reference, keys)
    return both.select(
        *keys,
        "ref",
        group,
        "n1",
        "n2",
        (F.col("n1") * F.col("n2") - F.col("_below")).alias("u"),
        (F.col("_tie") + F.col("_tie_ref")).alias("tie_term"),
    )


def mann_whitney_z(u: Column, n1: Column, n2: Column, tie: Column) -> Column:
    """Continuity-corrected z of the larger U."""
    n = (n1 + n2).cast("double")
    mean = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - tie / (n * (n - 1))))
    return (F.greatest(u, n1 * n2 - u) - mean - 0.5) / F.nullif(sd, F.lit(0.0))


def posthoc(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Every group against the lowest: pooled t where both look normal, else Mann-Whitney.

    Bonferroni-corrected by the number of comparisons; groups below three values are skipped.
    """
    clean = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    normal = shapiro(clean, [*keys, group], value).select(*keys, group, F.col("p").alias("p_normal"))
    stats = null_safe_join(group_moments(clean, keys, group, value), normal, [*keys, group])
    by = Window.partitionBy(*keys).orderBy(group)
    every = Window.partitionBy(*keys)
    ref = stats.withColumns(
        {
            "_rn": F.row_number().over(by),
            "comparisons": F.count(F.lit(1)).over(every) - 1,
            **{f"r_{c}": F.first(c).over(by) for c in ("n", "mean", "var", "p_normal")},
        }
    ).filter(F.col("_rn") > 1)
    mwu = mann_whitney_vs_lowest(clean, keys, group, value)
    pairs = null_safe_join(ref, mwu, [*keys, group]).filter((F.col("n") >= 3) & (F.col("r_n") >= 3))
    dof = F.col("n") + F.col("r_n") - 2
    pooled = ((F.col("n") - 1) * F.col("var") + (F.col("r_n") - 1) * F.col("r_var")) / dof
    t = (F.col("r_mean") - F.col("mean")) / F.nullif(
        F.sqrt(pooled * (1.0 / F.col("n") + 1.0 / F.col("r_n"))), F.lit(0.0)
    )
    both_normal = (F.col("p_normal") > 0.05) & (F.col("r_p_normal") > 0.05)
    z = mann_whitney_z(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie_term"))
    untied = F.col("tie_term") == 0
    small = untied & (F.least("n1", "n2") <= 8)
    top = F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u"))
    staged = pairs.select(
        *keys, "ref", group, "n1", "n2", "u", "comparisons",
        F.when(both_normal, "t-test").otherwise("MWU").alias("test"),
        F.when(both_normal, t).alias("t"),
        F.when(~both_normal & ~small, z).alias("z"),
        dof.alias("dof"),
        F.when(~both_normal & small, top).alias("_u_exact"),
    )
    raw = F.coalesce(
        P.t_p(F.col("t"), F.col("dof")),
        P.mann_whitney_exact_p(F.col("_u_exact"), F.col("n1"), F.col("n2")),
        P.normal_two_sided_p(F.col("z")),
    )
    scored = staged.withColumn("p_raw", raw).drop("_u_exact")
    return scored.withColumn(
        "p_bonferroni", F.least(F.lit(1.0), F.col("p_raw") * F.col("comparisons"))
    ).withColumn("sig", N.significance(F.col("p_bonferroni")))


def ancova(
    df: DataFrame, keys: Sequence[str], group: str, value: str, covariates: Sequence[str]
) -> DataFrame:
    """Type II F of a categorical factor next to numeric covariates.

    The factor is absorbed by centring on its groups, so both residual sums of squares come from
    cross moments: within groups for the full model, over all rows for the reduced one.
    """
    complete = df
    for c in (value, group, *covariates):
        complete = complete.filter(F.col(c).isNotNull())
    variables = [value, *covariates]
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]

    def moments(by: Sequence[str]) -> DataFrame:
        return complete.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            *[(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"s_{a}__{b}") for a, b in pairs],
        )

    names = [f"s_{a}__{b}" for a, b in pairs]
    within = moments([*keys, group]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"w_{c}") for c in names]
    )
    total = moments(keys).select(*keys, "n", *[F.col(c).alias(f"t_{c}") for c in names])
    joined = null_safe_join(within, total, keys)

    def residual(prefix: str) -> Column:
        def s(a: str, b: str) -> Column:
            a, b = (a, b) if (a, b) in pairs else (b, a)
            return F.col(f"{prefix}_s_{a}__{b}")

        # eliminate one covariate after the other; one that is constant, or made of others, explains nothing
        left = {(a, b): s(a, b) for a in variables for b in variables}
        for i, x in enumerate(covariates):
            rest = [value, *covariates[i + 1 :]]
            pivot = left[x, x]
            usable = pivot > 1e-10 * s(x, x)
            left = {
                (a, b): F.when(usable, left[a, b] - left[a, x] * left[x, b] / pivot).otherwise(left[a, b]) for a in rest for b in rest
            }
        return left[value, value]

    d1 = F.col("k") - 1
    d2 = F.col("n") - F.col("k") - len(covariates)
    f = ((residual("t") - residual("w")) / F.nullif(d1, F.lit(0))) / F.nullif(
        residual("w") / F.nullif(d2, F.lit(0)), F.lit(0.0)
    )
    return joined.select(*keys, "n", f.alias("f"), d1.alias("d1"), d2.alias("d2")).withColumn(
        "p", P.f_p(F.col("f"), F.col("d1"), F.col("d2"))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], ranks: bool = False) -> DataFrame:
    """Pearson (or Spearman) matrix of the complete rows, one row per pair of columns."""
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    if ranks:
        # all columns are ranked together; the row numbers are written, so that they hold in both uses
        rows = durable(clean.withColumn("_row", F.monotonically_increasing_id()))
        long = rows.unpivot("_row", list(columns), "_name", "_value")
        counts = long.groupBy("_name", "_value").agg(F.count(F.lit(1)).alias("n"))
        ranked = null_safe_join(long, _rank_table(counts, ["_name"], "_value"), ["_name", "_value"])
        clean = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_name") == c, F.col("rank"))).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def r(a: str, b: str) -> Column:
        return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))

    row = clean.agg(
        F.array(
            *[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r(a, b).alias("r")) for a, b in pairs]
        ).alias("m"),
        F.count(F.lit(1)).alias("n"),
    )
    return row.select(F.explode("m").alias("m"), "n").select("m.x", "m.y", "m.r", "n")


# paired tests


def _sd(column: str) -> Column:
    return F.when(F.count(column) >= 2, F.stddev_samp(column))


def delta_summary(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """n, mean, median, std and effect size (mean over std) of paired differences."""
    clean = df.filter(F.col(delta).isNotNull())
    base = clean.groupBy(*keys).agg(
        F.count(delta).alias("n"), F.avg(delta).alias("delta_mean"), _sd(delta).alias("delta_std")
    )
    med = exact_percentiles(clean, keys, delta, {"delta_median": 0.5})
    out = null_safe_join(base, med, keys)
    return out.withColumn(
        "effect_size",
        F.when(F.col("delta_std") > 0, F.col("delta_mean") / F.nullif(F.col("delta_std"), F.lit(0.0))),
    )


def paired_t(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    base = df.filter(F.col(delta).isNotNull()).groupBy(*keys).agg(
        F.count(delta).alias("n"), F.avg(delta).alias("_m"), _sd(delta).alias("_s")
    )
    t = F.col("_m") / F.nullif(F.col("_s") / F.sqrt("n"), F.lit(0.0))
    return base.select(*keys, "n", F.when(F.col("n") >= 4, t).alias("t")).withColumn(
        "p", P.t_p(F.col("t"), F.col("n") - 1)
    )


def wilcoxon(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Signed-rank test against zero: zeros dropped, exact for small untied samples."""
    valid = df.filter(F.col(delta).isNotNull())
    asked = valid.groupBy(*keys).agg(F.count(delta).alias("n_pairs"))
    nonzero = valid.filter(F.col(delta) != 0).withColumn("_abs", F.abs(F.col(delta)))
    counts = nonzero.groupBy(*keys, "_abs").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("_pos")
    )
    ranked = null_safe_join(counts, _rank_table(counts, keys, "_abs"), [*keys, "_abs"])
    agg = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("_pos") * F.col("rank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("_pos")) * F.col("rank")).alias("w_minus"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("_t"),
    )
    joined = null_safe_join(asked, agg, keys)
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_t") / 48.0
    z = (w - n * (n + 1) / 4.0) / F.nullif(F.sqrt(var), F.lit(0.0))
    exact = (F.col("n") <= 50) & (F.col("_t") == 0) & (F.col("n") == F.col("n_pairs"))
    enough = F.col("n_pairs") >= 4
    staged = joined.select(
        *keys, "n", "n_pairs", "w_plus", "w_minus",
        F.when(enough, z).alias("z"),
        F.when(enough & exact, w).alias("_we"),
    )
    p = F.coalesce(P.signed_rank_exact_p(F.col("_we"), F.col("n")), P.normal_two_sided_p(F.col("z")))
    return staged.withColumn("p", p).drop("_we")


def friedman(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Tie-corrected Friedman statistic over complete rows (at least four)."""
    complete = df
    for c in columns:
        complete = complete.filter(F.col(c).isNotNull())
    k = len(columns)

    def rank(c: str) -> Column:
        below = sum((F.when(F.col(o) < F.col(c), 1.0).otherwise(0.0) for o in columns), F.lit(0.0))
        equal = sum((F.when(F.col(o) == F.col(c), 1.0).otherwise(0.0) for o in columns), F.lit(0.0))
        return below + (equal + 1.0) / 2.0

    # sum over the tied blocks of t^3 - t equals the sum over members of t^2 - 1
    def excess(c: str) -> Column:
        t = sum((F.when(F.col(o) == F.col(c), 1.0).otherwise(0.0) for o in columns), F.lit(0.0))
        return t * t - 1.0

    ranked = complete.select(
        *keys,
        *[rank(c).alias(f"_r_{c}") for c in columns],
        sum((excess(c) for c in columns), F.lit(0.0)).alias("_t"),
    )
    agg = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_t").alias("_t"),
        *[F.sum(f"_r_{c}").alias(f"_s_{c}") for c in columns],
    )
    n = F.col("n").cast("double")
    ssq = sum((F.col(f"_s_{c}") * F.col(f"_s_{c}") for c in columns), F.lit(0.0))
    raw = 12.0 / (k * n * (k + 1)) * ssq - 3.0 * n * (k + 1)
    correction = F.nullif(1.0 - F.col("_t") / (n * k * (k * k - 1)), F.lit(0.0))
    return agg.select(*keys, "n", F.when(F.col("n") >= 4, raw / correction).alias("chi2")).withColumn(
        "p", P.chi2_p(F.col("chi2"), F.lit(k - 1))
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro precision and macro F1 in percent."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(truth).alias("c"), F.lit("t").alias("s"), "n"),
                F.struct(F.col(predicted).alias("c"), F.lit("p").alias("s"), "n"),
                F.struct(
                    F.col(truth).alias("c"), F.lit("h").alias("s"),
                    F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("n"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    per = sides.groupBy("c").agg(
        *[F.coalesce(F.sum(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias(s) for s in "tph"]
    )
    precision = F.coalesce(F.col("h") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0))
    recall = F.col("h") / F.nullif(F.col("t"), F.lit(0))
    zero_recall = F.coalesce(recall, F.lit(0.0))
    f1 = F.coalesce(
        2 * precision * zero_recall / F.nullif(precision + zero_recall, F.lit(0.0)), F.lit(0.0)
    )
    return per.agg(
        (F.sum("h") / F.sum("t") * 100).alias("accuracy"),
        (F.avg(recall) * 100).alias("balanced_accuracy"),
        (F.avg(precision) * 100).alias("macro_precision"),
        (F.avg(f1) * 100).alias("macro_f1"),
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2 and Spearman correlation of predictions."""
    err = F.col(truth) - F.col(predicted)
    base = df.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1.0 - F.avg(err * err) / F.nullif(F.var_pop(truth), F.lit(0.0))).alias("r2"),
    )
    rho = spearman(df, [], truth, predicted, with_p=False).select("rho")
    return base.withColumn("spearman", rho.scalar())
