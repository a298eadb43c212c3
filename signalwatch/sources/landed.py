"""Readers of landed files and tables, by name; writers of signals and events.

Every reader takes explicit schemas where the shape is known and keeps rows that don't parse in a column of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotate import author_hash, mention_text

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str):
    def put(f):
        READERS[name] = f
        return f

    return put


def read_landed(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """By hint, else by the first reader whose name the path ends with. Readers: csv, ndjson, json (arrays), replay, xml (feeds)."""
    if hint in READERS:
        return READERS[hint](spark, path)
    for name, f in READERS.items():
        if path.rstrip("/*").endswith(name):
            return f(spark, path)
    raise ValueError(f"no reader for {path}")


@reader("csv")
def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; dates stay text. Without a schema, types come from the whole file."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).option("inferDate", False).option("preferDate", False).csv(path)


@reader("ndjson")
def ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return (r.schema(schema) if schema else r).json(path)


@reader("json")
def json_array(spark: SparkSession, path: str, pointer: str = "item", schema: str | None = None) -> DataFrame:
    """Rows of the array that a dotted pointer names; `item` is the top level."""
    r = spark.read.option("multiLine", True)
    df = (r.schema(schema) if schema else r).json(path)
    return df if pointer == "item" else df.select(F.explode(F.col(pointer)).alias("e")).select("e.*")


POST = "id string, text string, author string, created_at string, lang string"


@reader("replay")
def replay_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of files that are an array or hold one under `tweets`, with the file's name; a file that isn't JSON gives nothing."""
    df = spark.read.schema(f"{POST}, tweets array<struct<{POST.replace(' string', ':string')}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("origin"))
    own = F.struct(*(x.split()[0] for x in POST.split(", ")))
    return df.select(F.explode(F.coalesce("tweets", F.array(own))).alias("p"), "origin").select("p.*", "origin").where("id is not null")


@reader("xml")
def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, published, description, author) of RSS items and Atom entries."""
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    rss = rows("item", "title string, link string, guid string, pubDate string, description string, author string")
    http = F.when(F.col("guid").startswith("http"), F.col("guid"))
    a = rss.select("title", F.coalesce("link", http).alias("url"), F.col("pubDate").alias("published"), "description", "author")
    atom = rows("entry", "title string, link struct<_href:string,_VALUE:string>, id string, published string, updated string, summary string, content string, author struct<name:string>")
    own = F.when(F.col("id").startswith("http"), F.col("id"))
    b = atom.select("title", F.coalesce("link._href", "link._VALUE", own).alias("url"), F.coalesce("published", "updated").alias("published"), F.coalesce("summary", "content").alias("description"), F.col("author.name").alias("author"))
    return a.unionByName(b).where("title is not null or url is not null")


#: Connector: (id, title, body, author, at, most characters, extra columns)
CONNECTORS = {
    "forum": ("id", "title", "selftext", "author", "created_utc", 8000, ["subreddit", "permalink"]),
    "comments": ("comment_id", None, "text", "author", "published_at", 4000, ["video_id"]),
    "channel": ("message_id", None, "message", "sender", "date", 8000, ["channel"]),
    "web": ("url", "title", "markdown", "author", "fetched_at", 16000, ["url"]),
    "posts": ("id", None, "text", "author", "created_at", 4000, ["lang", "origin"]),
}


def health_mentions(landed: DataFrame, connector: str, project: str, salt: str) -> DataFrame:
    """(id, project_id, connector_type, source_id, author_hash, fetched_at, original_text, extra) of a connector's landed rows; rows without text are dropped."""
    key, title, body, author, at, most, extra = CONNECTORS[connector]
    text = mention_text(F.col(title) if title else F.lit(None).cast("string"), F.col(body), most)
    rest = F.create_map(*(x for c in extra if c in landed.columns for x in (F.lit(c), F.col(c).cast("string")))) if any(c in landed.columns for c in extra) else F.create_map().cast("map<string,string>")
    rows = landed.select(F.lit(project).alias("project_id"), F.lit(connector).alias("connector_type"), F.col(key).cast("string").alias("source_id"), author_hash(F.col(author), salt).alias("author_hash"), F.col(at).cast("string").alias("fetched_at"), text.alias("original_text"), rest.alias("extra"))
    return rows.where("original_text is not null").withColumn("id", F.substring(F.sha2(F.concat_ws("|", "project_id", "connector_type", "source_id"), 256), 1, 32))


def read_mentions(spark: SparkSession, path: str, connector: str, project: str, salt: str, hint: str | None = None) -> DataFrame:
    """Mentions of a connector from its landed files, read by hint or by name."""
    return health_mentions(read_landed(spark, path, hint), connector, project, salt)


#: Source: (id prefix, id, title, url, author, published, score, comments)
FEEDS = {
    "hackernews": ("hn-", "objectID", "title", "url", "author", "created_at", "points", "num_comments"),
    "forum": ("reddit-", "id", "title", "url", "author", "created_utc", "score", "num_comments"),
    "news": ("gdelt-", "url", "title", "url", "domain", "seendate", None, None),
    "papers": ("pubmed-", "uid", "title", "doi", "author", "pubdate", None, None),
}


def feed_rows(landed: DataFrame, source: str) -> DataFrame:
    """(id, source, title, url, author, published, score, comments, tags) of a source's landed payload; adult posts are left out."""
    prefix, key, title, url, author, at, score, comments = FEEDS[source]
    if source == "forum" and "over_18" in landed.columns:
        landed = landed.where(~F.coalesce("over_18", F.lit(False)))
    link = F.col(url)
    if source == "papers":
        link = F.coalesce(F.concat(F.lit("https://doi.org/"), F.when(link != "", link)), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col(key).cast("string"), F.lit("/")))
    number = lambda c: F.col(c).cast("bigint") if c else F.lit(None).cast("bigint")
    return landed.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(source).alias("source"), F.coalesce(F.when(F.trim(title) != "", F.col(title)), F.lit("Untitled")).alias("title"), link.alias("url"), F.col(author).cast("string").alias("author"), F.col(at).cast("string").alias("published"), number(score).alias("score"), number(comments).alias("comments"), F.array(F.lit(source)).alias("tags"))


def parsed_time(value: Column) -> Column:
    """A timestamp from ISO text or from seconds, milli-, micro- or nanoseconds since 1970; null if it is neither."""
    n = value.try_cast("decimal(20,0)")
    micros = F.when(n < 10**11, n * 10**6).when(n < 10**14, n * 1000).when(n < 10**17, n).otherwise(n / 1000)
    return F.coalesce(F.timestamp_micros(micros.cast("bigint")), F.try_to_timestamp(value))


def compact_time(value: Column) -> Column:
    """A timestamp from YYYYMMDDTHHMMSSZ."""
    return F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmssX"))


def bucket_report(rows: DataFrame) -> Column:
    """A Markdown line for a telemetry bucket (bucket, n, mean, low, high, last_avg)."""
    def number(c: str) -> Column:
        """Six digits without closing zeros; a dash for null."""
        short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", F.col(c)), r"(\.\d*?)0+(e.*)?$", "$1$2"), r"\.(e.*)?$", "$1")
        return F.when(F.col(c).isNull(), "-").otherwise(short)

    return F.concat_ws(" | ", F.lit(""), F.timestamp_seconds("bucket").cast("string"), F.col("n").cast("string"), number("mean"), number("low"), number("high"), number("last_avg"), F.lit(""))


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, a part file for each partition."""
    events.write.mode(mode).json(path)


def write_routed(signals: DataFrame, path: str, mode: str = "append") -> None:
    """One table by kind: a kind's topic is its partition, the whole table is the firehose."""
    signals.write.mode(mode).partitionBy("kind").parquet(path)


def routed(signals: DataFrame) -> DataFrame:
    """(topic, id): each signal under its kind and under the firehose."""
    return signals.select("id", F.explode(F.array(F.concat(F.lit("signals."), "kind"), F.lit("signals.all"))).alias("topic"))
