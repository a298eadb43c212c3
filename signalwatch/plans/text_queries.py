"""Queries over texts of documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate as a
from ..functions import webtext as w
from ..operators.dictionary import dictionary_entities, vocabulary_rows
from .registry import registry, rounded
from .views import view

QUERIES, ORACLES, query = registry()

#: Stand-in vocabulary: fragments of the given texts as drugs and events.
SECTIONS = [
    ("DRUG", [("onthe", "X", "D1", ["thein", "la le"]), ("erthe", "X", "D2", None), ("that the", "X", "D3", ["than"])]),
    ("SYMPTOM", [("of the", "Y", "S1", ["que la"]), ("heon", "Y", None, ["der die", "an"])]),
]
_VOCAB = [("DRUG", "onthe", "D1"), ("DRUG", "thein", "D1"), ("DRUG", "la le", "D1"), ("DRUG", "erthe", "D2"), ("DRUG", "that the", "D3"), ("DRUG", "than", "D3"), ("SYMPTOM", "of the", "S1"), ("SYMPTOM", "que la", "S1"), ("SYMPTOM", "heon", None), ("SYMPTOM", "der die", None), ("SYMPTOM", "an", None)]
_VOCAB_SQL = ", ".join(f"('{k}', '{s}', {repr(c) if c else 'NULL'})" for k, s, c in _VOCAB)


def vocabulary(spark: SparkSession) -> DataFrame:
    schema = "kind string, entries array<struct<surface:string,code_system:string,code:string,synonyms:array<string>>>"
    return vocabulary_rows(spark.createDataFrame(SECTIONS, schema))


_FOUND = f"""WITH RECURSIVE t(kind, surface, code) AS (VALUES {_VOCAB_SQL}), m AS (SELECT mention_id, lower(text) AS x FROM v_mentions),
    places AS (SELECT mention_id, kind, surface, code, x, CAST(instr(x, surface) AS BIGINT) AS p FROM m, t WHERE instr(x, surface) > 0
      UNION ALL SELECT mention_id, kind, surface, code, x, p + instr(substr(x, p + 1), surface) FROM places WHERE instr(substr(x, p + 1), surface) > 0)
    SELECT @ FROM places
    WHERE NOT regexp_matches(substr(x, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(x, p + length(surface), 1), '[\\p{{L}}\\p{{N}}_]')"""
_PLACES = _FOUND.replace("@", "mention_id, kind, code, CAST(p - 1 AS INTEGER) AS start, CAST(p - 1 + length(surface) AS INTEGER) AS stop")


@query("j1_dictionary_entities", _PLACES)
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary_entities(view(spark, sf, "v_mentions"), vocabulary(spark)).select("mention_id", "kind", "code", "start", "stop")


@query("s12_vocabulary_terms", "WITH RECURSIVE " + _FOUND.replace("@", "kind, surface, code, mention_id").strip()[15:].replace("SELECT kind, surface, code, mention_id", "SELECT kind, surface, code, count(DISTINCT mention_id) AS docs FROM (SELECT kind, surface, code, mention_id", 1) + ") GROUP BY 1, 2, 3")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """Every surface of the vocabulary that some text has, with the number of texts."""
    found = dictionary_entities(view(spark, sf, "v_mentions"), vocabulary(spark))
    return found.groupBy("kind", F.lower("surface").alias("surface"), "code").agg(F.countDistinct("mention_id").alias("docs"))


@query("u3_entity_dedupe", _PLACES)
def u3(spark: SparkSession, sf: str) -> DataFrame:
    """A surface listed twice is found once: the first in vocabulary order."""
    twice = vocabulary(spark).unionByName(vocabulary(spark).withColumn("ord", F.col("ord") + 10_000).withColumn("surface", F.upper("surface")))
    return dictionary_entities(view(spark, sf, "v_mentions"), twice).select("mention_id", "kind", "code", "start", "stop")


_BEFORE = "substr(x, CAST(greatest(p - 24, 1) AS BIGINT), CAST(least(p - 1, 24) AS BIGINT))"
_CUES = " OR ".join(f"contains({_BEFORE}, '{c}')" for c in a.NEGATIONS)


@query("f5_negated_entities", "WITH RECURSIVE " + _FOUND.replace("@", f"kind, {_CUES} AS negated").strip()[15:].replace("SELECT kind, " + _CUES, "SELECT kind, negated, count(*) AS n FROM (SELECT kind, " + _CUES, 1) + ") GROUP BY 1, 2")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary_entities(view(spark, sf, "v_mentions"), vocabulary(spark)).groupBy("kind", "negated").agg(F.count("*").alias("n"))


@query("a25_mention_confidence", f"""WITH e AS (SELECT mention_id, count(*) AS n FROM ({_PLACES}) GROUP BY 1)
    SELECT mention_id, round(CAST(CASE WHEN n > 0 THEN 0.7 WHEN mention_id % 3 = 1 THEN 0.2 ELSE 0.3 END AS DOUBLE), 6) AS confidence FROM v_mentions LEFT JOIN e USING (mention_id)""")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    """From the entities that a mention has, else from its sentiment (here every third one's), else a default."""
    found = dictionary_entities(view(spark, sf, "v_mentions"), vocabulary(spark)).groupBy("mention_id").agg(F.collect_list(F.struct("confidence")).alias("entities"))
    all_of = view(spark, sf, "v_mentions").select("mention_id").join(found, "mention_id", "left")
    entities = F.coalesce("entities", F.array().cast("array<struct<confidence:double>>"))
    return rounded(all_of.select("mention_id", a.mention_confidence(entities, F.when(F.col("mention_id") % 3 == 1, 0.2)).alias("confidence")))


@query("f1_redaction", None)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in documents and conversations; tests hold it against plain Python."""
    rows = view(spark, sf, "v_mentions").select("mention_id", "text").unionByName(view(spark, sf, "v_talk").select("mention_id", "text"))
    found = rows.withColumn("findings", a.pii_findings(F.col("text")))
    return found.select("mention_id", F.size("findings").alias("n"), F.transform("findings", lambda x: x["kind"]).alias("kinds"), F.sha2(a.redacted(F.col("text"), F.col("findings")), 256).alias("redacted_sha"))


#: Texts of documents and conversations with some words in other scripts.
_MIXED = r"""SELECT doc_id AS id, 'd' AS origin, regexp_replace(regexp_replace(text, '(^|\s)the(\s)', '\1बुखार\2', 'g'), '(^|\s)und(\s)', '\1காய்ச்சல்\2', 'g') AS text FROM documents
    UNION ALL SELECT conv_id * 1000 + turn, 'c', regexp_replace(text, '(^|\s)a(\s)', '\1ज्वर\2', 'g') FROM conversations"""
_SCRIPT = "CASE WHEN regexp_matches(t, '\\p{Devanagari}') THEN 'Devanagari' WHEN regexp_matches(t, '\\p{Tamil}') THEN 'Tamil' ELSE 'Latin' END"
_RUNS = f"""WITH x AS ({_MIXED}), t AS (SELECT id, origin, text, list_transform(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), lambda t: {_SCRIPT}) AS s FROM x),
    o AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: i = 1 OR s[i] <> s[i - 1]) AS o FROM t), r AS (SELECT *, list_transform(o, lambda i: s[i]) AS runs FROM o)"""


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda c, w, by: F.regexp_replace(c, rf"(^|\s){w}(\s)", f"$1{by}$2")
    docs = view(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("origin"), words(words(F.col("text"), "the", "बुखार"), "und", "காய்ச்சல்").alias("text"))
    return docs.unionByName(view(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("c").alias("origin"), words(F.col("text"), "a", "ज्वर").alias("text")))


@query("f2_dominant_scripts", f"WITH x AS ({_MIXED}), t AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS t FROM x) SELECT {_SCRIPT} AS script, count(*) AS n FROM t GROUP BY 1")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    """The script of every token."""
    tokens = _mixed(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return tokens.groupBy(a.dominant_script(F.col("t")).alias("script")).agg(F.sum("n").alias("n"))


@query("w6_language_segments", f"{_RUNS} SELECT origin, id, len(runs) AS n, md5(array_to_string(list_transform(runs, lambda x: CASE x WHEN 'Devanagari' THEN 'hi' WHEN 'Tamil' THEN 'ta' ELSE 'en' END), ',')) AS languages FROM r")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as runs of one language; tests hold their places against plain Python."""
    found = _mixed(spark, sf).withColumn("s", a.language_segments(F.col("text")))
    return found.select("origin", "id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: x["language"]), ",").cast("binary")).alias("languages"))


#: Characters of a text's runs: those of all tokens, and white space between two tokens of one script.
_SPANS = """, g AS (SELECT id, origin, s, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w, regexp_split_to_array(text, '[^ \\t\\n\\x0B\\f\\r]+') AS gaps FROM t),
    z AS (SELECT id, origin, s, list_transform(range(1, len(s) + 1), lambda i: length(w[i]) + CASE WHEN i > 1 AND s[i] = s[i - 1] THEN length(gaps[i]) ELSE 0 END) AS l FROM g),
    m AS (SELECT id, origin, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] = 'Devanagari' THEN l[i] ELSE 0 END)) AS hi, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] = 'Tamil' THEN l[i] ELSE 0 END)) AS ta, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] = 'Latin' THEN l[i] ELSE 0 END)) AS en, s[1] AS head FROM z)"""
_TOP = "CASE WHEN head IS NULL THEN 'en' WHEN head = 'Devanagari' AND hi >= greatest(ta, en) THEN 'hi' WHEN head = 'Tamil' AND ta >= greatest(hi, en) THEN 'ta' WHEN head = 'Latin' AND en >= greatest(hi, ta) THEN 'en' WHEN hi > greatest(ta, en) THEN 'hi' WHEN ta > greatest(hi, en) THEN 'ta' ELSE 'en' END"


@query("a7_dominant_language", f"{_RUNS}{_SPANS} SELECT origin, id, {_TOP} AS language FROM m")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("origin", "id", a.dominant_language(a.language_segments(F.col("text"))).alias("language"))


@query("f6_needs_translation", f"{_RUNS} SELECT origin, id, len(list_filter(s, lambda x: x <> 'Latin')) > 0 AS needs FROM r")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("origin", "id", a.needs_translation(a.language_segments(F.col("text"))).alias("needs"))


def _cue_sql(cues: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(low, '(?:^|[^\\p{{L}}\\p{{N}}_]){c}(?:$|[^\\p{{L}}\\p{{N}}_])'))" if c.isascii() else f"len(regexp_extract_all(low, '{c}'))" for c in cues)


@query("f3_sentiment", f"""WITH x AS (SELECT doc_id AS mention_id, regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS low, text FROM documents), c AS (SELECT mention_id, text, {_cue_sql(a.POSITIVE)} AS p, {_cue_sql(a.NEGATIVE)} AS n FROM x)
    SELECT mention_id, p AS positive, n AS negative FROM c""")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return view(spark, sf, "v_mentions").select("mention_id", a.cue_hits(text, a.POSITIVE).cast("bigint").alias("positive"), a.cue_hits(text, a.NEGATIVE).cast("bigint").alias("negative"))


@query("f3_sentiment_scores", None)
def f3s(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_mentions").select("mention_id", a.sentiment(F.col("text")).alias("s")).select("mention_id", "s.*")


@query("p5_keyword_filter", "SELECT doc_id AS mention_id FROM documents WHERE contains(lower(text), 'stupid') OR contains(lower(text), 'license') OR contains(lower(text), 'heitkeit')")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_mentions").where(a.has_keyword(F.col("text"), ["stupid", "LICENSE", "heitkeit"])).select("mention_id")


@query("p6_mention_text", "SELECT conv_id, turn, sha256(substr(trim(role || chr(10) || chr(10) || trim(text, ' ')), 1, 200)) AS sha FROM conversations WHERE trim(text) <> ''")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "conversations").where("trim(text) <> ''")
    return c.select("conv_id", "turn", F.sha2(a.mention_text(F.col("role"), F.col("text"), 200), 256).alias("sha"))


@query("p7_author_hash", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'anonymous' ELSE substr(sha256('salt::' || lower(trim(c_name))), 1, 16) END AS author FROM customer")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "customer").select("c_custkey", a.author_hash(F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit(" "), F.upper("c_name"))), "salt").alias("author"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("f15_clean_markdown", f"SELECT page_id, sha256({_CLEAN}) AS sha FROM pages")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "pages").select("page_id", F.sha2(w.clean_markdown(F.col("html")), 256).alias("sha"))


_PLAIN_LIST = ", ".join(f"'{x}'" for x in w.PLAIN_WORDS)


@query("f16_contextual_density", f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_''-]{{2,}}') AS t FROM documents), r AS (SELECT *, list_filter(t, lambda x: x NOT IN ({_PLAIN_LIST})) AS r FROM t)
    SELECT doc_id AS mention_id, round(CASE WHEN len(t) = 0 THEN 0 ELSE least(0.6 * len(r) / len(t) + 0.3 * least(len(list_distinct(r)) / 160.0, 1) + 0.1 * least((len(regexp_extract_all(text, '\\n#')) + len(regexp_extract_all(text, '\\n- ')) + len(regexp_extract_all(text, '\\|'))) / 24.0, 1), 1) END, 6) AS density FROM r""")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(view(spark, sf, "v_mentions").select("mention_id", w.contextual_density(F.col("text")).alias("density")))


@query("f17_density_limited", None)
def f17(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", "</(p|h1|li|nav|div)>|<br>", "\n\n"), "<script>.*?</script>", "")
    return view(spark, sf, "pages").select("page_id", w.density_limited(text, 0.6, 100, 800).alias("text"))


_WALL = " ".join(f"WHEN {extra} regexp_matches(html, '{p}') THEN {{{i}}}" for i, (extra, p) in enumerate((("page_id % 10 = 3 OR", w.HARD), ("page_id % 10 = 5 OR", w.SOFT), ("", w.CHALLENGE))))
_WALLS = "CASE " + _WALL.format("'hard_block'", "'soft_rate_limit'", "'interactive_challenge'") + " ELSE 'none' END AS tier, CAST(CASE " + _WALL.format("30", "5", "15") + " END AS DOUBLE) AS retry_after"


@query("p13_bot_walls", f"SELECT page_id, {_WALLS} FROM pages")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("page_id") % 10 == 3, 403).when(F.col("page_id") % 10 == 5, 429).otherwise(200)
    return view(spark, sf, "pages").select("page_id", w.bot_wall(status, F.col("html")).alias("w")).select("page_id", "w.*")


def _literals(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _phrase_sql(column: str) -> str:
    for pattern, by in w.PHRASE_STEPS:
        column = f"regexp_replace({column}, {_sql(pattern)}, {_sql(by)}, 'g')"
    return f"trim({column}, ' ')"


_HAS_PLACE = f"len(list_intersect(string_split(v, ' '), [{_literals(w.PLACE_WORDS)}])) > 0"
_KNOWN = f"(v IN ({_literals(w.SINGLE_ORGS)}) OR regexp_matches(v, {_sql(w.MIXED_CASE)}) OR regexp_matches(v, {_sql(w.SITE)}))"
_IS_EVENT = f"regexp_matches(v, {_sql(w.EVENT_WORDS)}) AND NOT regexp_matches(v, {_sql(w.NOT_EVENT)})"
_NO_NAME = f"length(v) < 3 OR v IN ({_literals(w.NOT_NAMES)})"
_KIND = f"""CASE WHEN {_NO_NAME} THEN NULL WHEN n = 1 AND lower(v) IN ({_literals(w.PATHOGENS)}) THEN 'EVENT' WHEN regexp_matches(v, {_sql(w.ORG_ENDS)}) THEN 'ORG' WHEN {_IS_EVENT} THEN 'EVENT'
    WHEN regexp_matches(v, {_sql(w.PRODUCT_WORDS)}) THEN CASE WHEN n > 1 OR {_KNOWN} THEN 'ORG' END WHEN {_HAS_PLACE} THEN 'GEO' WHEN n = 1 THEN CASE WHEN {_KNOWN} THEN 'ORG' END WHEN n <= 4 THEN 'PERSON' END"""
_ENTITIES = " UNION ALL ".join(f"SELECT mention_id, '{k}' AS kind, {'upper(v)' if k == 'CVE' else 'v'} AS v FROM (SELECT mention_id, unnest(regexp_extract_all(text, {_sql(p)})) AS v FROM v_mentions)" for k, p, _ in w.EXACT)
_ENTITIES += f""" UNION ALL SELECT mention_id, 'GEO', unnest(regexp_extract_all(text, {_sql(r"\b(?:" + "|".join(w.COUNTRIES) + r")\b")})) FROM v_mentions
    UNION ALL SELECT mention_id, kind, v FROM (SELECT mention_id, v, {_KIND} AS kind FROM (SELECT mention_id, v, len(string_split(v, ' ')) AS n FROM (SELECT mention_id, {_phrase_sql('p')} AS v FROM (SELECT mention_id, unnest(regexp_extract_all(text, {_sql(w.PROPER)})) AS p FROM v_mentions)))) WHERE kind IS NOT NULL"""
_BASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in w.BASE_CONFIDENCE.items()) + " END"


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return w.heuristic_entities(view(spark, sf, "v_mentions").select("mention_id", "text"))


@query("f11_pattern_entities", f"WITH e AS ({_ENTITIES}) SELECT mention_id, kind, count(*) AS n, count(DISTINCT lower(v)) AS n_values, sha256(string_agg(v, ',' ORDER BY v)) AS sha FROM e GROUP BY 1, 2")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.sha2(F.array_join(F.array_sort(F.collect_list("value")), ","), 256)
    return _entities(spark, sf).groupBy("mention_id", "kind").agg(F.count("*").alias("n"), F.countDistinct(F.lower("value")).alias("n_values"), sha.alias("sha"))


@query("a10_entity_counts", f"WITH e AS ({_ENTITIES}), c AS (SELECT kind, lower(v) AS low, count(*) AS n FROM e GROUP BY 1, 2) SELECT kind, low, n AS count, round(CAST(least(0.97, {_BASE} + least(0.06, 0.01 * n)) AS DOUBLE), 6) AS confidence FROM c")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(w.counted_entities(view(spark, sf, "v_mentions").select("mention_id", "text"), []).select("kind", "low", "count", "confidence"))


@query("a12_entities_per_kind", f"WITH e AS ({_ENTITIES}) SELECT kind, count(DISTINCT lower(v)) AS n FROM e GROUP BY 1")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return w.counted_entities(view(spark, sf, "v_mentions").select("mention_id", "text"), []).groupBy("kind").agg(F.count("*").alias("n"))


#: Titles of pages as queries, with words that queries are asked about put in.
_ASKED = "SELECT item_id AS mention_id, concat(lower(title), CASE item_id % 6 WHEN 0 THEN ' ebola outbreak' WHEN 1 THEN ' cargo ship in the red sea' WHEN 2 THEN ' sri lanka' WHEN 3 THEN ' CVE-2024-12345' WHEN 4 THEN ' harbour bank group' ELSE '' END) AS text FROM v_feed"
_TITLED = "array_to_string(list_transform(regexp_split_to_array(trim(text, ' '), '\\s'), lambda t: CASE WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1]) || t[2:] ELSE t END), ' ')"
_SEEDED = f"""WITH q AS ({_ASKED}), t AS (SELECT *, regexp_split_to_array(lower(trim(text, ' ')), '\\s+') AS w FROM q WHERE trim(text, ' ') <> '' AND length(trim(text, ' ')) < 2000),
    p AS (SELECT mention_id, v, len(string_split(v, ' ')) AS n FROM (SELECT mention_id, {_phrase_sql('p')} AS v FROM (SELECT mention_id, unnest(regexp_extract_all({_TITLED}, {_sql(w.PROPER)})) AS p FROM t))),
    k AS (SELECT mention_id, v, CASE WHEN {_NO_NAME} THEN NULL WHEN regexp_matches(v, {_sql(w.ORG_ENDS)}) THEN 'ORG' WHEN {_IS_EVENT} THEN 'EVENT' WHEN {_HAS_PLACE} THEN 'GEO' WHEN n BETWEEN 2 AND 4 THEN 'GEO' END AS kind FROM p),
    e AS (SELECT mention_id, 'EVENT' AS kind, upper(x[1]) || x[2:] AS v FROM (SELECT mention_id, unnest(list_transform(w, lambda x: regexp_replace(x, '[^a-z0-9-]', '', 'g'))) AS x FROM t) WHERE x IN ({_literals(w.PATHOGENS)})
      UNION ALL SELECT mention_id, 'GEO', 'Maritime vessel' FROM t WHERE len(list_intersect(list_transform(w, lambda x: regexp_replace(x, '[^a-z]', '', 'g')), [{_literals(w.VESSELS)}])) > 0
      UNION ALL SELECT mention_id, 'GEO', c FROM t, (SELECT unnest([{_literals(w.COUNTRIES)}]) AS c) WHERE contains(lower(text), lower(c))
      UNION ALL SELECT mention_id, 'CVE', upper(unnest(regexp_extract_all(text, {_sql(next(p for k, p, _ in w.EXACT if k == 'CVE'))}))) FROM t UNION ALL SELECT mention_id, kind, v FROM k WHERE kind IS NOT NULL)
    SELECT mention_id, kind, lower(v) AS low, CAST(3 * count(*) AS BIGINT) AS count FROM e GROUP BY 1, 2, 3"""


@query("f12_query_seeding", _SEEDED)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.sql(_ASKED.replace("v_feed", "{feed}"), feed=view(spark, sf, "v_feed"))
    return w.entity_counts(w.query_entities(asked), ["mention_id"]).select("mention_id", "kind", "low", "count")


def _label_sql(text: str) -> str:
    """The label of a text by the same cues, for RE2."""
    plain = lambda p: p.replace(a.EDGE, r"\b").replace(a.W, r"[\p{L}\p{N}_]")
    cases = " ".join(f"WHEN regexp_matches({text}, {_sql('(?i)' + '|'.join(map(plain, patterns)))}) THEN '{label}'" for label, _, patterns in a.CUES)
    return f"CASE WHEN trim({text}, ' ') = '' THEN NULL {cases} ELSE 'clean' END"


@query("f4_misinformation", f"SELECT doc_id AS mention_id, {_label_sql('text')} AS label FROM documents UNION ALL SELECT conv_id * 1000 + turn, {_label_sql('text')} FROM conversations")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    both = view(spark, sf, "v_mentions").select("mention_id", "text").unionByName(view(spark, sf, "v_talk").select("mention_id", "text"))
    return both.select("mention_id", a.misinformation(F.col("text"))["label"].alias("label"))


@query("x1_annotation_stages", f"{_RUNS}{_SPANS} SELECT origin, id, {_TOP} AS language, {_label_sql('text')} AS label FROM m JOIN x USING (origin, id)")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    """All stages by name; tests put a model in place of one."""
    from ..functions.stages import applied

    out = applied(_mixed(spark, sf), ["language", "redact", "translate", "sentiment", "misinformation"])
    return out.select("origin", "id", "language", F.col("misinformation.label").alias("label"))
