"""Structured Streaming twins of the batch operators: same functions, event-time watermarks, idempotent sinks.

Sources are files here; another source only changes read_stream. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.annotate import dominant_language, language_segments, misinformation, pii_findings, redacted, sentiment
from ..operators.dictionary import dictionary_entities
from ..operators.folds import keyed_fold
from ..operators.graph import confident_events, edge_uid, latest_by_key
from ..operators.ledger import HEALTHY, poll_outcome, salvage_outcome, salvaged_json
from ..operators.signals import NO_POINTS, contingency, day_cells, disproportionality, trend_point, window_cells
from ..sources.buckets import BucketTable


def read_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 250) -> DataFrame:
    """Parquet files as they land, `per_batch` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def decoded(raw: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON text in `value`."""
    full = raw.withColumn("r", F.from_json(value, f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    bad = F.col("r").isNull() | F.col("r.corrupt").isNotNull()
    return full.where(~bad).select("r.*").drop("corrupt"), full.where(bad).drop("r")


def write_keyed(batch: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch under its own id: a retry overwrites it, so nothing is there twice."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def started(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True)


def annotated(mentions: DataFrame, on: str = "clean") -> DataFrame:
    """mentions (text) with language, redacted text, findings, sentiment and misinformation; the last two on redacted text, or on the text as it came for on="text"."""
    found = mentions.withColumn("language", dominant_language(language_segments(F.col("text")))).withColumn("findings", pii_findings(F.col("text"))).withColumn("clean", redacted(F.col("text"), F.col("findings")))
    return found.withColumn("sentiment", sentiment(F.col(on))).withColumn("misinformation", misinformation(F.col(on)))


def annotate_stream(mentions: DataFrame, normalized: str, annotations: str, checkpoint: str, vocabulary: DataFrame | None = None, on: str = "clean") -> DataStreamWriter:
    """Two sinks from one pass; with a vocabulary, annotations have the entities. on: what is annotated, the redacted text or, for "text", the text as it came, whose cues and surfaces may stand in what is redacted."""
    def each(batch: DataFrame, batch_id: int) -> None:
        done = annotated(batch, on).persist()
        write_keyed(done.select("mention_id", "project_id", "clean", "findings"), normalized, batch_id)
        out = done.select("mention_id", "project_id", "language", "sentiment", "misinformation")
        if vocabulary is not None:
            found = dictionary_entities(done.select("mention_id", F.col(on).alias("text")), vocabulary)
            found = found.groupBy("mention_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "code", "negated"))).alias("entities"))
            out = out.join(found, "mention_id", "left")
        write_keyed(out, annotations, batch_id)
        done.unpersist()

    return started(mentions, checkpoint, each)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All micro-batches of a table, with the number of each; none where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


SPIKES = "keyword string, district string, day int, n bigint, baseline double, z double, prior int, is_spike boolean"


COUNTS = "keyword string, district string, day int, n bigint"
CLOSED = "until int, seen timestamp"
TRENDS = "keyword string, district string, mean double, var double, points bigint"


class SpikeTables:
    """Where a spike stream keeps what it knows: counts by day and micro-batch, late rows, how far days are closed, the trend of each series, and spikes."""

    def __init__(self, root: str) -> None:
        self.counts, self.late, self.closed, self.trends, self.spikes = (f"{root.rstrip('/')}/{x}" for x in ("counts", "late", "closed", "trends", "spikes"))


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of folders `prefix=number` in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(x.split("=", 1)[1]) for x in found if x.startswith(f"{prefix}="))


def _closed_before(spark: SparkSession, tables: SpikeTables, k: int | None) -> tuple[int | None, int | None, object]:
    """(batch, until, seen) of the last batch before k that closed days."""
    before = [b for b in _names(spark, tables.closed, "batch") if k is None or b < k]
    if not before:
        return None, None, None
    row = spark.read.schema(CLOSED).parquet(f"{tables.closed}/batch={before[-1]}").first()
    return before[-1], row["until"], row["seen"]


def _set_closed(spark: SparkSession, tables: SpikeTables, k: int, until: int, seen: object) -> None:
    """Notes how far days are closed; of older notes the last one stays, in case batch k is sent again."""
    write_keyed(spark.createDataFrame([(until, seen)], CLOSED), tables.closed, k)
    for old in _names(spark, tables.closed, "batch")[:-2]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{tables.closed}/batch={old}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _close(spark: SparkSession, tables: SpikeTables, k: int, since: int | None, until: int, rule: dict) -> None:
    """The days after `since` up to `until`, scored on the trends of their series, as batch k. Reads those days and the trends of buckets that they touch, nothing before."""
    days = [d for d in _names(spark, tables.counts, "day") if (since is None or d > since) and d <= until]
    if not days:
        return
    counts = spark.read.option("basePath", tables.counts).schema(f"{COUNTS}, batch bigint").parquet(*(f"{tables.counts}/day={d}" for d in days)).where(F.col("batch") <= k)
    new = counts.groupBy("keyword", "district", "day").agg(F.sum("n").alias("n"))
    trends = BucketTable(spark, tables.trends, TRENDS, ["keyword", "district"])
    known = trends.read(trends.touched(new), k - 1)
    # a series' trend goes ahead of its days and starts its fold
    rows = new.select("keyword", "district", "day", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("mean", "double"), ("var", "double"), ("points", "bigint"))))
    rows = rows.unionByName(known.select("keyword", "district", F.lit(-(1 << 31)).alias("day"), F.lit(None).cast("bigint").alias("n"), "mean", "var", "points"))

    def step(state: tuple, _: int, n: int | None, *trend: float) -> tuple[tuple, tuple | None]:
        if n is None:
            return trend, None
        after, told = trend_point(state, n, **rule)
        return after, (n, *told, *after)

    told = keyed_fold(rows, ["keyword", "district"], ["day"], ["n", "mean", "var", "points"], "count bigint, baseline double, z double, prior int, is_spike boolean, mean double, var double, points bigint", NO_POINTS, step)
    told = told.withColumnRenamed("count", "n").persist()
    write_keyed(told.drop("mean", "var", "points"), tables.spikes, k)
    last = told.groupBy("keyword", "district").agg(F.max_by(F.struct("mean", "var", "points"), "day").alias("t")).select("keyword", "district", "t.*")
    trends.replace(last, k, lambda old, fresh: latest_by_key(old.unionByName(fresh), ["keyword", "district"], [F.desc("points")]))
    trends.vacuum(k)
    told.unpersist()


def spike_stream(mentions: DataFrame, tables: SpikeTables, checkpoint: str, wait_days: int = 1, **rule: float) -> DataStreamWriter:
    """Counts by keyword, district and day from mentions (keyword, district, ts), and the points of days once they are closed.

    A day is closed when `wait_days` more have begun after it, by the latest time of the batches before. Rows of a closed day go to the late
    table. Each series has one row of trend (mean, variance, points) in a bucketed table, so closing days reads those days' counts and touched buckets, whatever came
    before; a restart needs no state but the tables, a batch that is tried again starts from the trends before it and overwrites its own, and
    points are those of the batch operator. Days still open are left to flush().
    """
    def each(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        _, closed, seen = _closed_before(spark, tables, k)
        day = F.floor(F.unix_seconds("ts") / 86400).cast("int")
        rows = batch.withColumn("day", day).persist()
        is_late = F.lit(False) if closed is None else F.col("day") <= closed
        write_keyed(rows.where(is_late).select("keyword", "district", "day", "ts"), tables.late, k)
        counts = rows.where(~is_late).groupBy("keyword", "district", "day").agg(F.count("*").alias("n")).withColumn("batch", F.lit(k))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(tables.counts)
        now = rows.agg(F.max("ts"), F.max("day")).first()
        rows.unpersist()
        until = max((x for x in (closed, None if now[1] is None else now[1] - wait_days - 1) if x is not None), default=None)
        if until is not None and (closed is None or until > closed):
            _close(spark, tables, k, closed, until, rule)
        if until is not None:
            _set_closed(spark, tables, k, until, now[0] or seen)

    return started(mentions, checkpoint, each)


def flush(spark: SparkSession, tables: SpikeTables, **rule: float) -> None:
    """Closes all days that are still open, after the last batch; a second call finds none."""
    last, closed, seen = _closed_before(spark, tables, None)
    still = [d for d in _names(spark, tables.counts, "day") if closed is None or d > closed]
    if not still:
        return
    k = 1 + max([last if last is not None else -1, *(b for d in still for b in _names(spark, f"{tables.counts}/day={d}", "batch"))])
    _close(spark, tables, k, closed, still[-1], rule)
    _set_closed(spark, tables, k, still[-1], seen)


def pair_count_stream(pairs: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Pair counts of each micro-batch under its id; totals are their sum (see total_pairs)."""
    return started(pairs, checkpoint, lambda batch, k: write_keyed(batch.groupBy("drug", "event").agg(F.count("*").alias("a")), table, k))


PAIRS = "drug string, event string, a bigint"


def total_pairs(spark: SparkSession, table: str, changed_since: int | None = None) -> DataFrame:
    """Scores on all counts so far; with changed_since only those of pairs that a batch after it has touched."""
    rows = stored(spark, table, PAIRS)
    scores = disproportionality(contingency(rows.groupBy("drug", "event").agg(F.sum("a").alias("a"))))
    return scores if changed_since is None else scores.join(rows.where(F.col("batch") > changed_since).select("drug", "event").distinct(), ["drug", "event"], "left_semi")


def compact_pairs(spark: SparkSession, table: str, into: str) -> None:
    """Writes the totals as the one batch of a new table, numbered as the last batch was."""
    rows = stored(spark, table, PAIRS)
    write_keyed(rows.groupBy("drug", "event").agg(F.sum("a").alias("a")), into, rows.agg(F.max("batch")).first()[0] or 0)


DAYS = "cy bigint, cx bigint, weight decimal(38,9), edge decimal(38,9), n bigint, n_edge bigint, day bigint, batch bigint"
WINDOWS = "until bigint, cy bigint, cx bigint, weight double, population bigint, rate double, llr double"


def cluster_stream(obs: DataFrame, root: str, checkpoint: str, days: int = 7, degrees: float = 1.0) -> DataStreamWriter:
    """Cells of sliding windows as window_cells() gives them, under root/windows, each window once the day that it ends on is closed.

    State is one row a cell and open day, whatever a window's length. A day is closed by the watermark, a day behind the latest time; it is written under root/days, from which the
    windows since the last closed day take their days. A batch that is tried again sees no later days and overwrites its own.
    """
    placed = obs.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withWatermark("ts", "1 day")
    cells = placed.groupBy(F.window("ts", "1 day").alias("w"), F.floor(F.col("lat") / degrees).alias("cy"), F.floor(F.col("lon") / degrees).alias("cx"))
    daily = cells.agg(*day_cells(F.coalesce("weight", F.lit(0.0)), F.col("ts"))).withColumn("day", F.floor(F.unix_seconds("w.start") / 86400)).drop("w")
    where = f"{root.rstrip('/')}/days"

    def each(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(k).cast("bigint")).persist()  # a stateful batch that is used twice
        until = rows.agg(F.max("day")).first()[0]
        if until is not None:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(where)
            found = _names(spark, where, "day")
            since = next((d for d in reversed(found) if any(b < k for b in _names(spark, f"{where}/day={d}", "batch"))), None)
            paths = [f"{where}/day={d}" for d in found if d <= until and (since is None or d > since - days)]
            known = spark.read.option("basePath", where).schema(DAYS).parquet(*paths).where(F.col("batch") <= k)
            told = F.col("until") <= until if since is None else F.col("until").between(since + 1, until)
            write_keyed(window_cells(known, days).where(told), f"{root.rstrip('/')}/windows", k)
        rows.unpersist()

    return started(daily, checkpoint, each)


ENTITIES = "id string, entity_type string, name string, confidence double, updated bigint"
EDGES = "uid string, src string, dst string, valid_from string, evidence string"


class GraphTables:
    """Where a graph stream writes: entities by id and edges by uid in buckets, and notices by micro-batch."""

    def __init__(self, root: str, buckets: int = 32) -> None:
        self.entities, self.edges, self.notices = (f"{root.rstrip('/')}/{x}" for x in ("entities", "edges", "notices"))
        self.buckets = buckets

    def stored(self, spark: SparkSession) -> tuple[BucketTable, BucketTable]:
        return BucketTable(spark, self.entities, f"{ENTITIES}, batch bigint", ["id"], self.buckets), BucketTable(spark, self.edges, EDGES, ["uid"], self.buckets)


def graph_stream(messages: DataFrame, tables: GraphTables, checkpoint: str, compact_every: int = 50) -> DataStreamWriter:
    """Extraction messages (entities array of ENTITIES, edges array of EDGES without uid) to entity updates, edges that weren't there, and then notices of confident events.

    Whether an edge is there is looked up in the buckets of the batch's own edges; every `compact_every` batches long buckets are rewritten."""
    def each(batch: DataFrame, k: int) -> None:
        batch = batch.persist()
        entities, edges = tables.stored(batch.sparkSession)
        named = batch.select(F.explode("entities").alias("e")).select("e.*")
        last = named.groupBy("id").agg(F.max_by(F.struct("entity_type", "name", "confidence", "updated"), F.struct("updated", "name", "confidence")).alias("e")).select("id", "e.*").persist()
        entities.append(last.withColumn("batch", F.lit(k).cast("bigint")), k)
        new = batch.select(F.explode("edges").alias("e")).select("e.*").withColumn("uid", edge_uid(F.col("src"), F.col("dst"), F.col("valid_from"), F.col("evidence")))
        edges.insert_absent(new, k)
        write_keyed(confident_events(last), tables.notices, k)
        if k % compact_every == compact_every - 1:
            compact_graph(batch.sparkSession, tables)
        last.unpersist()
        batch.unpersist()

    return started(messages, checkpoint, each)


def _last_writer(entities: DataFrame) -> DataFrame:
    return latest_by_key(entities, ["id"], [F.desc("batch")])


def compact_graph(spark: SparkSession, tables: GraphTables, most: int = 4) -> None:
    """Rewrites buckets of more than `most` folders: the last writer of each entity, and all edges."""
    entities, edges = tables.stored(spark)
    entities.compact(most, _last_writer)
    edges.compact(most)


def graph_snapshot(spark: SparkSession, tables: GraphTables) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) as they stand after all batches: the last writer of an entity wins."""
    entities, edges = tables.stored(spark)
    return _last_writer(entities.read()).drop("batch"), edges.read()


def extraction_stream(outputs: DataFrame, good: str, again: str, quarantine: str, checkpoint: str) -> DataStreamWriter:
    """Model outputs (id, text, attempt): their JSON, those to be tried again (attempt one higher), and quarantine."""
    def each(batch: DataFrame, k: int) -> None:
        done = batch.withColumn("json", salvaged_json(F.col("text"))).withColumn("outcome", salvage_outcome(F.col("text"), F.col("attempt"))).persist()
        write_keyed(done.where("outcome = 'ok'").select("id", "json"), good, k)
        write_keyed(done.where("outcome = 'retry'").select("id", "text", (F.col("attempt") + 1).alias("attempt")), again, k)
        write_keyed(done.where("outcome = 'quarantine'").select("id", "text", "attempt"), quarantine, k)
        done.unpersist()

    return started(outputs, checkpoint, each)


HEALTH = "source string, seq bigint, health double, failures int, is_open boolean"
STATES = "source string, health double, failures int, is_open boolean, batch bigint"


def health_stream(outcomes: DataFrame, root: str, checkpoint: str, alpha: float = 0.3, opens: float = 0.3, closes: float = 0.7) -> DataStreamWriter:
    """Source health after each outcome (source, seq, success) under root/health, micro-batch by micro-batch; what a source was after the last one is a row of a bucketed table.

    Within a batch outcomes are folded in order of seq as the batch operator does, with one state in memory, however many a source has; those of a later batch come after all
    before. A batch that is tried again starts from the states before it.
    """
    def each(batch: DataFrame, k: int) -> None:
        new = batch.select("source", F.col("seq").cast("bigint").alias("seq"), "success").persist()
        states = BucketTable(batch.sparkSession, f"{root.rstrip('/')}/states", STATES, ["source"])
        none = lambda kind: F.lit(None).cast(kind)
        known = states.read(states.touched(new), k - 1).select("source", none("bigint").alias("seq"), none("boolean").alias("success"), "health", "failures", "is_open", F.lit(0).alias("turn"))
        # a source's state goes ahead of its outcomes and starts its fold
        rows = new.select("*", none("double").alias("health"), none("int").alias("failures"), none("boolean").alias("is_open"), F.lit(1).alias("turn")).unionByName(known)

        def step(state: tuple, turn: int, _: int | None, success: bool | None, *stored: float) -> tuple[tuple, tuple | None]:
            if not turn:
                return (stored, 0), None
            after, place = poll_outcome(state[0], success, alpha, opens, closes)[0], state[1] + 1
            return (after, place), (*after, place)

        told = keyed_fold(rows, ["source"], ["turn", "seq"], ["success", "health", "failures", "is_open"], "health double, failures int, is_open boolean, place bigint", (HEALTHY, 0), step)
        write_keyed(told.drop("turn"), f"{root.rstrip('/')}/health", k)
        done = batch.sparkSession.read.schema(f"{HEALTH}, place bigint").parquet(f"{root.rstrip('/')}/health/batch={k}")
        last = latest_by_key(done, ["source"], [F.desc("place")]).select("source", "health", "failures", "is_open", F.lit(k).cast("bigint").alias("batch"))
        states.replace(last, k, lambda old, fresh: latest_by_key(old.unionByName(fresh), ["source"], [F.desc("batch")]))
        states.vacuum(k)
        new.unpersist()

    return started(outcomes, checkpoint, each)


def unseen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events whose id wasn't there before, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def event_notices(entities: DataFrame, least: Column | float = 0.85) -> DataFrame:
    """What subscribers get: confident events only."""
    return confident_events(entities, least)
