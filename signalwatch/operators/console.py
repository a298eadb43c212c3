"""What the console shows: counts, histograms, grids, rates, alerts, fusion scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import keyed_fold
from .slices import OWN, PART, PLACE, by_rows, by_seconds
from .telemetry import epoch_seconds

# Kinds of entity, and the least confidence that each must have.
KINDS = ["CVE", "IP", "HASH", "EMAIL", "URL", "MONEY", "DATE", "GEO", "ORG", "PERSON", "EVENT"]
FLOORS = {"PERSON": 0.35, "ORG": 0.25, "GEO": 0.20, "EVENT": 0.20}


def confident(entities: DataFrame) -> DataFrame:
    floors = F.create_map(*(F.lit(x) for pair in FLOORS.items() for x in pair))
    return entities.where(F.col("confidence") >= F.coalesce(F.element_at(floors, F.col("kind")), F.lit(0.30)))


def relevant_items(items: DataFrame, words: list[str], least: int = 3) -> DataFrame:
    """Items whose title has one of the words; all of them if fewer than `least` do."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("title").contains(w.lower())
    enough = F.broadcast(items.where(hit).limit(least).agg((F.count("*") >= least).alias("enough")))  # one row
    return items.join(enough, F.lit(True)).where(~F.col("enough") | hit).drop("enough")


def model_entities(found: DataFrame, keys: list[str]) -> DataFrame:
    """Model output folded by kind and lower-cased name: counts add up, the most confidence stays; rows that break the rules are left out."""
    good = found.where(F.col("kind").isin(KINDS) & (F.trim("name") != "") & (F.col("count") >= 1) & F.col("confidence").between(0, 1))
    return good.groupBy(*keys, "kind", F.lower(F.trim("name")).alias("low")).agg(F.sum("count").alias("count"), F.max("confidence").alias("confidence"))


def equal_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of values from 0 to 1, bins without values included; 1 is in the last."""
    counts = df.where(F.col(value).between(0, 1)).groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").na.fill(0, ["n"])


def uneven_bins(value: Column) -> Column:
    return F.when(value < 0.3, "<.3").when(value < 0.5, ".3-.5").when(value < 0.7, ".5-.7").when(value < 0.9, ".7-.9").otherwise(">=.9")


def _kind_sum(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0))


def threat_level(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, band) from (keys, kind, count)."""
    raw = (10 * _kind_sum("CVE") + 5 * _kind_sum("IP") + 8 * _kind_sum("HASH") + 2 * _kind_sum("EMAIL")) / 2
    out = counts.groupBy(*keys).agg(F.least(F.lit(100), F.floor(raw + 0.5)).cast("int").alias("level"))
    return out.withColumn("band", F.when(F.col("level") < 25, "low").when(F.col("level") < 50, "guarded").when(F.col("level") < 75, "elevated").otherwise("severe"))


def threat_profile(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, axis, score): six weighted sums, as a share of the largest in per cent."""
    axes = {"CYBER": 4 * _kind_sum("CVE") + 3 * _kind_sum("IP") + 5 * _kind_sum("HASH"), "SURV": 2 * _kind_sum("PERSON") + 3 * _kind_sum("EMAIL"), "GEO": 3 * _kind_sum("GEO"),
            "INTEL": 2 * _kind_sum("ORG") + _kind_sum("DATE") + 2 * _kind_sum("MONEY"), "SITUATION": 4 * _kind_sum("EVENT"), "NETWORK": 2 * _kind_sum("URL")}
    sums = counts.groupBy(*keys).agg(*(v.alias(k) for k, v in axes.items()))
    most = F.greatest(F.lit(1), *axes)
    rows = F.array(*(F.struct(F.lit(k).alias("axis"), F.floor(100 * F.col(k) / most + 0.5).cast("int").alias("score")) for k in axes))
    return sums.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def kind_scatter(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.floor(100 * F.avg("confidence") + 0.5).cast("int").alias("confidence"), F.count("*").alias("n"))


def source_health(fetches: DataFrame) -> DataFrame:
    """(source, latency, ok, band): mean latency, the last outcome, and live, slow or degraded."""
    out = fetches.groupBy("source").agg(F.avg("latency").alias("latency"), F.max_by("ok", F.struct("ts", "event_id")).alias("ok"))
    return out.withColumn("band", F.when(F.col("latency") < 300, "live").when(F.col("latency") < 900, "slow").otherwise("degraded"))


def activity_matrix(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(day 0 Sunday to 6, hour, n), every cell."""
    counts = df.groupBy((F.dayofweek(ts) - 1).alias("day"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(counts, ["day", "hour"], "left").na.fill(0, ["n"])


def dense_grid(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """(rows, columns, n): counts for every row value met with every listed column value, zeros included."""
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    grid = df.select(rows).distinct().withColumn(columns, F.explode(F.array(*map(F.lit, values))))
    return grid.join(counts, [rows, columns], "left").na.fill(0, ["n"])


def row_intensity(counts: DataFrame, rows: str) -> DataFrame:
    """counts (rows, .., n) with intensity: n over the row's largest."""
    return counts.withColumn("intensity", F.col("n") / F.greatest(F.max("n").over(Window.partitionBy(rows)), F.lit(1)))


def velocity(fetches: DataFrame, key: str | None = None, rows: int = 100_000) -> DataFrame:
    """fetches that succeeded with velocity (a minute, over the last 30) and anomaly: over three times the mean of up to 24 before, which is over .5.

    A series is cut into runs of `rows` rows that carry what both windows need, so a source with most fetches is many tasks.
    """
    keys = [key] if key else []
    ok = by_rows(fetches.where("ok"), keys, ["ts", "event_id"], F.floor(epoch_seconds(F.col("ts")) / 3600), 29 + 24, rows)
    order = Window.partitionBy(*keys, PART).orderBy("ts", "event_id")
    last, micros = order.rowsBetween(-29, 0), F.unix_micros(F.col("ts").cast("timestamp"))
    n, minutes = F.count("*").over(last), (micros - F.min(micros).over(last)) / 60e6
    rated = ok.withColumn("velocity", F.when(n >= 2, F.floor(n / F.when(minutes == 0, 1.0).otherwise(minutes) * 10 + 0.5) / 10))
    before = order.rowsBetween(-24, -1)
    mean, seen = F.avg("velocity").over(before), F.count("velocity").over(before)
    return rated.withColumn("anomaly", F.coalesce((seen >= 4) & (mean > 0.5) & (F.col("velocity") > 3 * mean), F.lit(False))).where(OWN).drop(PART, OWN).withColumnRenamed(PLACE, "k")


def timeline(df: DataFrame, key: str, values: list[str], points: int, bucket: Column) -> DataFrame:
    """The last `points` buckets with a count column for each listed value of key."""
    wide = df.groupBy(bucket.alias("bucket")).pivot(key, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.orderBy(F.desc("bucket")).limit(points)


def rate_spikes(fetches: DataFrame, key: str, within: int = 60, least: int = 5, cool: int = 120) -> DataFrame:
    """Fetches at which `least` or more came within the last `within` seconds, none within `cool` seconds of the alert before. Counted in stretches of time, so a busy source is many tasks."""
    parts = by_seconds(fetches.withColumn("sec", epoch_seconds(F.col("ts"))), "sec", within - 1)
    recent = F.count("*").over(Window.partitionBy(key, PART).orderBy("sec").rangeBetween(-(within - 1), 0))
    hot = parts.withColumn("recent", recent).where(F.col(OWN) & (F.col("recent") >= least)).drop(PART, OWN)
    return cooled(hot, key, "sec", cool)


def bursts(fetches: DataFrame, key: str, least: int = 25, cool: int = 90) -> DataFrame:
    return cooled(fetches.withColumn("sec", epoch_seconds(F.col("ts"))).where(F.col("items") >= least), key, "sec", cool)


def cooled(candidates: DataFrame, key: str, sec: str, cool: int) -> DataFrame:
    """(key, sec): candidates in time order without those `cool` seconds or less after the last one kept. Of a key only its distinct seconds are put in order; each
    stretch of candidates without a pause is folded on its own."""
    gap = F.col(sec) - F.lag(sec).over(Window.partitionBy(key).orderBy(sec))
    # a pause longer than `cool` starts afresh
    parts = candidates.select(key, F.col(sec).cast("bigint").alias(sec)).distinct().withColumn("new", F.coalesce((gap > cool).cast("int"), F.lit(1)))
    parts = parts.withColumn("part", F.sum("new").over(Window.partitionBy(key).orderBy(sec).rowsBetween(Window.unboundedPreceding, 0)))

    def step(last: int | None, at: int) -> tuple[int | None, tuple | None]:
        return (at, (True,)) if last is None or at - last > cool else (last, None)

    return keyed_fold(parts.where(F.col(sec).isNotNull()), [key, "part"], [sec], [], "kept boolean", None, step).select(key, sec)


def first_sightings(entities: DataFrame, per_batch: int = 3) -> DataFrame:
    """(kind, value, batch, severity): the first batch in which an indicator is among the first three of its batch, or a place is sure. entities: batch, pos, kind, value, confidence."""
    threats = entities.where(F.col("kind").isin("CVE", "IP", "HASH", "EMAIL")).withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy("pos"))).where(F.col("k") <= per_batch)
    places = entities.where("kind = 'GEO' and confidence >= 0.75").withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy("pos"))).where("k = 1")
    both = threats.unionByName(places).groupBy("kind", "value").agg(F.min("batch").alias("batch"))
    return both.withColumn("severity", F.when(F.col("kind") == "CVE", "critical").when(F.col("kind") == "GEO", "info").otherwise("high"))


def by_severity(alerts: DataFrame, limit: int = 80) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 3).otherwise(4)
    return alerts.orderBy(rank, F.desc("at"), "id").limit(limit)


def primary_entity(entities: DataFrame, keys: list[str], query: str) -> DataFrame:
    """One entity a group: one that the query names, else an event, else an organisation, CVE or place, else the first."""
    rank = F.when(F.lower(F.lit(query)).contains(F.lower("value")), 0).when(F.col("kind") == "EVENT", 1).when(F.col("kind").isin("ORG", "CVE", "GEO"), 2).otherwise(3)
    return entities.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "pos"))).where("k = 1").drop("k")


def fusion(snapshot: DataFrame) -> DataFrame:
    """snapshot (sources, items, entities, leads, places, arcs, urgent, posture) with confidence, band and the states of four requirements."""
    ratio = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    geo = F.least(F.lit(1.0), (F.col("places") + F.col("arcs")) / 14)
    lift = F.least(F.lit(0.08), 0.04 * F.col("urgent")) + F.when((F.col("posture") == "TITAN") & (geo > 0.5), 0.04).when((F.col("posture") == "Finance") & (F.col("leads") > 0), 0.03).otherwise(0.0)
    raw = 38 + 20 * ratio("sources", 3) + 14 * ratio("items", 45) + 10 * ratio("entities", 18) + 8 * ratio("leads", 4) + 10 * geo + 100 * lift
    sure = F.floor(F.least(F.lit(94.0), F.round(raw, 9)) + 0.5).cast("int")
    state = lambda yes, half: F.when(yes, "satisfied").when(half, "partial").otherwise("open")
    return snapshot.withColumn("confidence", sure).withColumn("band", F.when((F.col("confidence") >= 78) | (F.col("urgent") > 0), "escalate").when(F.col("confidence") >= 60, "triage").otherwise("watch")).withColumn(
        "continuity", F.when((F.col("entities") > 0) | (F.col("leads") > 0), "satisfied").otherwise("partial")).withColumn("corroboration", state(F.col("sources") >= 3, F.col("sources") >= 2)).withColumn(
        "anchoring", state(F.col("places") > 0, F.lit(False))).withColumn("provenance", F.when(F.col("leads") > 0, "partial").otherwise("open"))


def map_pins(entities: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(low, count, confidence, lat, lon): places folded by lower-cased name, the most confidence (.5 without one), where the gazetteer has them."""
    folded = entities.where("kind = 'GEO'").groupBy(F.lower("value").alias("low")).agg(F.sum("count").alias("count"), F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    return located(folded, gazetteer, "low")


def _cuts(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(F.filter(F.array(*(one(n) for n in lengths)), lambda x: x.isNotNull())))


def located(names: DataFrame, gazetteer: DataFrame, name: str) -> DataFrame:
    """names with lat and lon of the first gazetteer entry (name, lat, lon, ord) that is equal, else contains it or is contained.

    Equi-joins on substrings both ways: those of a name that are as long as some entry, and those of an entry that are as long as some
    name. Both lists of lengths are bounded by the longest name. Empty names are nowhere.
    """
    each = names.select(name).where(F.length(name) > 0).distinct()
    known = gazetteer.withColumnRenamed("name", "g").where("length(g) > 0")
    lengths = lambda df, c: sorted(r[0] for r in df.select(F.length(c)).distinct().collect())
    of_known, of_names = lengths(known, "g"), lengths(each, name)
    if not of_known or not of_names:
        return names.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")).limit(0)
    holds = each.withColumn("g", F.explode(_cuts(F.col(name), of_known))).join(known, "g")
    held = known.withColumn(name, F.explode(_cuts(F.col("g"), of_names))).join(each, name)
    met = holds.select(name, "g", "lat", "lon", "ord").unionByName(held.select(name, "g", "lat", "lon", "ord"))
    best = met.groupBy(name).agg(F.min_by(F.struct("lat", "lon"), F.struct((F.col(name) != F.col("g")).alias("other"), "ord")).alias("p"))
    return names.join(best.select(name, "p.lat", "p.lon"), name)


def stored_or_gazetteer(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """places (id, name, lat, lon) with valid coordinates of their own, else those of the gazetteer (name, lat, lon) under the normalised name."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    known = gazetteer.select(norm("name").alias("n"), F.col("lat").alias("glat"), F.col("lon").alias("glon")).dropDuplicates(["n"])
    valid = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    full = places.withColumn("n", norm("name")).join(known, "n", "left")
    return full.select("id", F.when(valid, F.col("lat")).otherwise(F.col("glat")).alias("lat"), F.when(valid, F.col("lon")).otherwise(F.col("glon")).alias("lon"))


def dossier_confidence(hits: Column, mentions: Column, edges: Column, listed: Column) -> Column:
    return F.least(F.lit(94), 42 + 8 * hits + 2 * mentions + edges + F.when(listed, 12).otherwise(0))


def anchor_offset(identifier: Column, lat: Column, lon: Column) -> Column:
    """struct<lat, lon>: a place moved by an angle and distance that follow from the identifier's FNV-1a hash."""
    codes = F.transform(F.filter(F.split(identifier, ""), lambda c: c != ""), lambda c: F.ascii(c))
    mask = (1 << 32) - 1
    # the product of two 32-bit numbers passes 64 bits signed, so the multiplier is taken apart
    step = lambda h, c: ((h.bitwiseXOR(c.cast("bigint")) * 403 + F.shiftleft(h.bitwiseXOR(c.cast("bigint")).bitwiseAND(255), 24)).bitwiseAND(mask))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)
    angle, far = F.radians((h % 360).cast("double")), 2.4 + (h % 7) * 0.45
    x = lon + F.cos(angle) * far
    return F.struct(F.greatest(F.lit(-84.0), F.least(F.lit(84.0), lat + F.sin(angle) * far)).alias("lat"), F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x).alias("lon"))


def arc(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, n: int = 24) -> Column:
    """array<struct<lat, lon>> of n + 1 points on the straight line."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((a_lat + (b_lat - a_lat) * i / n).alias("lat"), (a_lon + (b_lon - a_lon) * i / n).alias("lon")))


def geojson(clusters: DataFrame) -> DataFrame:
    """(feature): one GeoJSON text a cluster."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("centroid_lon", "centroid_lat").alias("coordinates"))
    return clusters.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("observed", "expected").alias("properties"))).alias("feature"))


def source_mix(fetches: DataFrame) -> DataFrame:
    """(source, items): how much each source brought."""
    return fetches.groupBy("source").agg(F.sum("items").alias("items"))


def funnel(fetches: DataFrame, sure: Column) -> DataFrame:
    """One row: fetches, those with items, of them those that succeeded, and of them those that are sure."""
    some = F.col("items") > 0
    return fetches.agg(F.count("*").alias("crawled"), F.count_if(some).alias("with_entities"), F.count_if(some & F.col("ok")).alias("extracted"), F.count_if(some & F.col("ok") & sure).alias("confident"))


def top_entities(entities: DataFrame, limit: int = 10) -> DataFrame:
    """(low, count): the most frequent values, folded by lower case; ties by name."""
    return entities.groupBy(F.lower("value").alias("low")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "low").limit(limit)
