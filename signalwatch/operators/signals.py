"""From annotations to signals: disproportionality, trend spikes, spatial clusters, and the signal rows they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import decayed
from .slices import PLACE

HALF = 0.5
#: Entity kinds that count as events of a drug.
EVENT_KINDS = ("ADVERSE_EVENT", "SYMPTOM", "CONDITION")


def labelled_entities(annotations: DataFrame) -> DataFrame:
    """annotations with drugs and events: labels (code, else lower surface) of entities neither negated nor hypothetical."""
    live = F.filter("medical_entities", lambda e: ~F.coalesce(e["negated"], F.lit(False)) & ~F.coalesce(e["hypothetical"], F.lit(False)))
    label = lambda e: F.coalesce(e["code"], F.lower(e["surface"]))
    return annotations.withColumn("drugs", F.transform(F.filter(live, lambda e: e["kind"] == "DRUG"), label)).withColumn("events", F.transform(F.filter(live, lambda e: e["kind"].isin(*EVENT_KINDS)), label))


def pair_counts(df: DataFrame) -> DataFrame:
    """(drug, event, a): co-mentions from arrays drugs and events, or from one pair a row (drug, event)."""
    if "drugs" in df.columns:
        df = df.select(F.explode("drugs").alias("drug"), "events").select("drug", F.explode("events").alias("event"))
    return df.groupBy("drug", "event").agg(F.count("*").alias("a"))


def contingency(pairs: DataFrame) -> DataFrame:
    """(drug, event, a, b, c, d) by joins with the marginal sums of pair counts."""
    drugs, events = pairs.groupBy("drug").agg(F.sum("a").alias("of_drug")), pairs.groupBy("event").agg(F.sum("a").alias("of_event"))
    total = F.broadcast(pairs.agg(F.sum("a").alias("total")))  # one row
    full = pairs.join(drugs, "drug").join(events, "event").join(total, F.lit(True))
    return full.select("drug", "event", "a", (F.col("of_drug") - F.col("a")).alias("b"), (F.col("of_event") - F.col("a")).alias("c"), (F.col("total") - F.col("of_drug") - F.col("of_event") + F.col("a")).alias("d"))


def disproportionality(tables: DataFrame, least: int = 3, prr: float = 2.0, chi: float = 4.0) -> DataFrame:
    """tables (a, b, c, d) with expected, prr, ror, ic, ic_lower, chi_squared, is_signal; zero where a marginal is zero."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    ratio = F.when((a + b == 0) | (c + d == 0), 0.0).otherwise((a + HALF) / (a + b + HALF) / ((c + HALF) / (c + d + HALF)))
    expected = F.when(n == 0, 0.0).otherwise((a + b) * (a + c) / n)
    empty = (n == 0) | (a + b == 0) | (a + c == 0)
    ic = F.when(empty, 0.0).otherwise(F.log2((a + HALF) / (expected + HALF)))
    spread = F.sqrt(1.0 / F.greatest(a + HALF, F.lit(1.0))) / F.log(F.lit(2.0))
    excess = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    square = F.when((n == 0) | (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0), 0.0).otherwise(n * excess * excess / ((a + b) * (c + d) * (a + c) * (b + d)))
    return (
        tables.withColumn("is_signal", (a >= least) & (ratio >= prr) & (square >= chi))
        .withColumn("expected", F.greatest(expected, F.lit(HALF))).withColumn("prr", F.greatest(ratio, F.lit(HALF)))
        .withColumn("ror", F.greatest((a + HALF) * (d + HALF) / ((b + HALF) * (c + HALF)), F.lit(HALF)))
        .withColumn("ic", ic).withColumn("ic_lower", F.when(empty, 0.0).otherwise(ic - 1.96 * spread)).withColumn("chi_squared", F.greatest(square, F.lit(HALF))))


def running_tables(df: DataFrame, bucket: str) -> DataFrame:
    """(bucket, drug, event, a, b, c, d): cumulative counts at the end of each bucket in which the pair is seen."""
    pairs = df.groupBy(bucket, "drug", "event").agg(F.count("*").alias("k"))

    def upto(keys: list[str], name: str) -> DataFrame:
        sums = pairs.groupBy(bucket, *keys).agg(F.sum("k").alias("k"))
        window = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        return sums.select(bucket, *keys, F.sum("k").over(window).alias(name))

    # the totals by bucket are as many rows as buckets
    full = upto(["drug", "event"], "a").join(upto(["drug"], "of_drug"), [bucket, "drug"]).join(upto(["event"], "of_event"), [bucket, "event"]).join(upto([], "total"), bucket)
    return full.select(bucket, "drug", "event", "a", (F.col("of_drug") - F.col("a")).alias("b"), (F.col("of_event") - F.col("a")).alias("c"), (F.col("total") - F.col("of_drug") - F.col("of_event") + F.col("a")).alias("d"))


def bucket_counts(df: DataFrame) -> DataFrame:
    """(keyword, district, day, n)"""
    return df.groupBy("keyword", "district", "day").agg(F.count("*").alias("n"))


#: Mean, variance and number of the points so far.
NO_POINTS = (0.0, 0.0, 0)


def trend_point(state: tuple[float, float, int], n: int, window: int = 14, alpha: float = 0.3, least_points: int = 5, least_z: float = 3.0) -> tuple[tuple[float, float, int], tuple]:
    """One point against the baseline before it: (the state after it, (baseline, z, prior, is_spike)). What ewma_spikes computes, a point at a time."""
    mean, var, points = state
    base = mean if points else max(float(n), 1.0)
    z = (n - base) / max(var if points else 1.0, 1.0) ** 0.5
    prior = min(points, window)
    spike = prior >= least_points and z >= least_z and n >= max(base * 1.5, 3.0)
    after = (alpha * n + (1 - alpha) * mean, alpha * (n - mean) ** 2 + (1 - alpha) * var) if points else (float(n), max(float(n), 1.0))
    return (*after, points + 1), (base, z, prior, spike)


def ewma_spikes(counts: DataFrame, window: int = 14, alpha: float = 0.3, least_points: int = 5, least_z: float = 3.0) -> DataFrame:
    """counts (keyword, district, day, n) with baseline, z, prior (points before, at most `window`), is_spike.

    Mean and variance are linear recurrences, so a series is cut into slices that are summed side by side (see folds.decayed), however long or hot it is.
    """
    n, keep = F.col("n").cast("double"), 1 - alpha
    deviation = lambda place, mean: F.when(place == 1, F.greatest(n, F.lit(1.0))).otherwise(alpha * (n - mean) * (n - mean))
    points = counts.select("keyword", "district", F.col("day").cast("int").alias("day"), F.col("n").cast("bigint").alias("n"))
    both = decayed(points, ["keyword", "district"], ["day", "n"], F.floor(F.col("day") / 1000), keep, {"mean": lambda place, _: F.when(place == 1, n).otherwise(alpha * n), "var": deviation})
    # twelve places: beyond them the order of a sum shows, and a count that just meets a bound would miss it
    base = F.when(F.col(PLACE) == 1, F.greatest(n, F.lit(1.0))).otherwise(F.round("mean_before", 12))
    z = (n - F.col("baseline")) / F.sqrt(F.greatest(F.coalesce(F.round("var_before", 12), F.lit(1.0)), F.lit(1.0)))
    scored = both.withColumn("baseline", base).withColumn("z", z).withColumn("prior", F.least(F.col(PLACE) - 1, F.lit(window)).cast("int"))
    spike = (F.col("prior") >= least_points) & (F.col("z") >= least_z) & (n >= F.greatest(F.col("baseline") * 1.5, F.lit(3.0)))
    return scored.select("keyword", "district", "day", "n", "baseline", "z", "prior", spike.alias("is_spike"))


def poisson_llr(observed: Column, expected: Column) -> Column:
    return F.when((observed <= 0) | (expected <= 0) | (observed <= expected), 0.0).otherwise(observed * F.log(observed / expected) - (observed - expected))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a rational approximation (error under 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    return ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)


def poisson_clusters(obs: DataFrame, now: str, days: int = 7, degrees: float = 1.0, least: int = 3, least_llr: float = 4.0) -> DataFrame:
    """One row per occupied grid cell in the window that ends at `now`, both ends included. obs: lat, lon, ts, weight."""
    end = F.lit(now).cast("timestamp_ntz")
    recent = obs.where((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"INTERVAL {days} DAYS")))
    cells = recent.groupBy(F.floor(F.col("lat") / degrees).alias("cy"), F.floor(F.col("lon") / degrees).alias("cx")).agg(F.sum("weight").alias("weight"), F.count("*").alias("population"))
    rate = F.broadcast(cells.agg((F.sum("weight") / F.count("*")).alias("rate")))  # one row
    full = cells.join(rate, F.lit(True)).where("rate > 0")
    llr = poisson_llr(F.col("weight"), F.greatest("rate", F.lit(1e-6)))
    observed = F.round("weight").cast("bigint")
    return full.select(
        ((F.col("cy") + 0.5) * degrees).alias("centroid_lat"), ((F.col("cx") + 0.5) * degrees).alias("centroid_lon"), observed.alias("observed"), F.greatest("rate", F.lit(1e-6)).alias("expected"),
        llr.alias("llr"), F.when(llr <= 0, 1.0).otherwise(erfc(F.sqrt(llr))).alias("p_value"), "population", ((observed >= least) & (F.col("weight") > F.col("rate")) & (llr >= least_llr)).alias("is_cluster"))


def day_cells(weight: Column, ts: Column) -> list[Column]:
    """What a grid cell keeps of a day: weight and number of its rows, and of those at midnight sharp. Weights count to nine places, so that sums can be taken back exactly."""
    sharp, w = F.unix_micros(ts.cast("timestamp")) % 86_400_000_000 == 0, weight.cast("decimal(28,9)")
    return [F.sum(w).alias("weight"), F.sum(F.when(sharp, w).otherwise(0)).alias("edge"), F.count("*").alias("n"), F.count_if(sharp).alias("n_edge")]


def window_cells(cells: DataFrame, days: int = 7) -> DataFrame:
    """(until, cy, cx, weight, population, rate, llr): the occupied cells of every window that ends at a midnight `until` (days since 1970) and holds `days` days, both ends included.

    cells: cy, cx, day and day_cells(). A day comes into the window that ends where it begins with what lies on that midnight, into the next with the rest, and leaves
    `days` later: three signed rows, however long windows are, and a running sum along the days of a cell. rate is the mean weight of a window's occupied cells.
    """
    row = lambda day, w, n: F.struct(day.alias("day"), w.cast("decimal(38,9)").alias("w"), n.alias("n"))
    c = F.col
    signed = F.array(row(c("day"), c("edge"), c("n_edge")), row(c("day") + 1, c("weight") - c("edge"), c("n") - c("n_edge")), row(c("day") + (days + 1), -c("weight"), -c("n")))
    changes = cells.select("cy", "cx", F.explode(signed).alias("x")).groupBy("cy", "cx", "x.day").agg(F.sum("x.w").alias("w"), F.sum("x.n").alias("n"))
    along = Window.partitionBy("cy", "cx").orderBy("day")
    sums = changes.select("cy", "cx", "day", F.sum("w").over(along).cast("double").alias("weight"), F.sum("n").over(along).alias("population"), F.lead("day").over(along).alias("next"))
    each = sums.where("population > 0").select(F.explode(F.sequence("day", F.col("next") - 1)).alias("until"), "cy", "cx", "weight", "population")
    scored = each.join(each.groupBy("until").agg(F.avg("weight").alias("rate")), "until")
    return scored.withColumn("llr", poisson_llr(F.col("weight"), F.col("rate")))


def poisson_windows(obs: DataFrame, days: int = 7, degrees: float = 1.0) -> DataFrame:
    """window_cells() of observations (lat, lon, ts, weight); those without a place or time are in none."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    placed = obs.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("ts").isNotNull())
    cells = placed.groupBy(F.floor(F.col("lat") / degrees).alias("cy"), F.floor(F.col("lon") / degrees).alias("cx"), day.alias("day"))
    return window_cells(cells.agg(*day_cells(F.coalesce("weight", F.lit(0.0)), F.col("ts"))), days)


def signal_id(*parts: Column) -> Column:
    """A stable id from what makes a signal what it is."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 32)


def adr_signals(scored: DataFrame) -> DataFrame:
    d = scored.where("is_signal")
    return d.select(
        signal_id(F.lit("adr"), F.col("drug"), F.col("event")).alias("id"), F.lit("adr").alias("kind"), F.least(F.greatest(F.col("prr") / 10, F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.concat(F.lit("Possible ADR: "), "drug", F.lit(" ↔ "), "event").alias("title"),
        F.format_string("PRR=%.2f, ROR=%.2f, IC=%.2f (lower 95%% %.2f), chi²=%.2f, observed=%d, expected=%.2f.", "prr", "ror", "ic", "ic_lower", "chi_squared", "a", "expected").alias("explanation"))


def trend_signals(points: DataFrame) -> DataFrame:
    d = points.where("is_spike")
    return d.select(
        signal_id(F.lit("trend"), F.col("keyword"), F.coalesce("district", F.lit("")), F.col("day")).alias("id"), F.lit("trend").alias("kind"), F.least(F.greatest(F.col("z") / 10, F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.concat(F.lit("Volume spike: "), "keyword", F.coalesce(F.concat(F.lit(" in "), "district"), F.lit(""))).alias("title"),
        F.format_string("z=%.2f, current=%.1f, baseline=%.1f.", "z", F.col("n").cast("double"), "baseline").alias("explanation"))


def cluster_signals(cells: DataFrame) -> DataFrame:
    d = cells.where("is_cluster")
    return d.select(
        signal_id(F.lit("cluster"), F.col("centroid_lat"), F.col("centroid_lon")).alias("id"), F.lit("cluster").alias("kind"), F.least(F.greatest(F.col("llr") / 20, F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.format_string("Spatial cluster (%d reports near %.1f,%.1f)", "observed", "centroid_lat", "centroid_lon").alias("title"),
        F.format_string("observed=%d, expected=%.2f, LLR=%.2f, p≈%.3f.", "observed", "expected", "llr", "p_value").alias("explanation"))


def codes_by_system(codes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, system, codes): distinct codes of each system in order. codes: keys, system, code."""
    return codes.where("system is not null and code is not null").groupBy(*keys, "system").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


def located_only(obs: DataFrame) -> DataFrame:
    """Observations whose lat and lon, numbers or text, are a place on Earth; both come out as doubles."""
    number = lambda c: F.col(c).cast("string").try_cast("double").alias(c)
    rest = [c for c in obs.columns if c not in ("lat", "lon")]
    return obs.select(*rest, number("lat"), number("lon")).where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def prior_points(counts: DataFrame, window: int = 14) -> DataFrame:
    """(keyword, district, day, prior): how many points a series has before each, `window` at most."""
    before = F.row_number().over(Window.partitionBy("keyword", "district").orderBy("day")) - 1
    return counts.select("keyword", "district", "day").distinct().withColumn("prior", F.least(F.lit(window), before))
