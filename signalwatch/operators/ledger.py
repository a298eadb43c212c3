"""Audit chains, triage, exports, privacy, validation: what governs signals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from .folds import keyed_fold

GENESIS = "0" * 64


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """The same text for the same values: keys in order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def chained(df: DataFrame, chain: str = "chain", sequence: str = "sequence", payload: str = "payload") -> DataFrame:
    """(chain, sequence, prev_hash, payload_hash): each hash is of the one before and the payload. Sequential within a chain, a row at a time; parallel across chains."""
    def step(before: str, _: int, text: str) -> tuple[str, tuple]:
        own = hashlib.sha256((before + text).encode()).hexdigest()
        return own, (before, own)

    rows = df.select(F.col(chain), F.col(sequence).cast("bigint").alias("sequence"), F.coalesce(payload, F.lit("")).alias("payload"))
    return keyed_fold(rows, [chain], ["sequence"], ["payload"], "prev_hash string, payload_hash string", GENESIS, step)


def verified(entries: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, entries, broken_at): the first sequence whose link or number doesn't follow from the entry before; null if all do."""
    order = Window.partitionBy(chain).orderBy("sequence")
    good = (F.col("prev_hash") == F.coalesce(F.lag("payload_hash").over(order), F.lit(GENESIS))) & (F.col("sequence") == F.coalesce(F.lag("sequence").over(order) + 1, F.lit(1)))
    return entries.withColumn("good", good).groupBy(chain).agg(F.count("*").alias("entries"), F.min(F.when(~F.col("good"), F.col("sequence"))).alias("broken_at"))


def recomputed(entries: DataFrame, payloads: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, sequence): entries whose hash isn't that of their payload."""
    both = entries.join(payloads.select(chain, "sequence", "payload"), [chain, "sequence"])
    return both.where(F.col("payload_hash") != F.sha2(F.concat("prev_hash", F.coalesce("payload", F.lit(""))), 256)).select(chain, "sequence")


def audit_tail(entries: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n entries, oldest first."""
    return entries.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def project_audit(entries: DataFrame, signals: DataFrame, project: str) -> DataFrame:
    return entries.join(signals.where(F.col("project_id") == project).select(F.col("id").alias("signal_id")), "signal_id", "left_semi")


def listed(signals: DataFrame, project: str, kind: str | None, status: str | None, limit: int) -> DataFrame:
    """Signals of a project, newest first."""
    df = signals.where(F.col("project_id") == project)
    df = df.where(F.col("kind") == kind) if kind else df
    df = df.where(F.col("status") == status) if status else df
    return df.orderBy(F.desc("detected"), "id").limit(limit)


def triaged(signals: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """signals with status and assignee by the latest decision on each."""
    last = decisions.groupBy("signal_id").agg(F.max_by(F.struct("actor", "decision"), F.struct(*order)).alias("d")).select(F.col("signal_id").alias("id"), "d.*")
    status = F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "more_data", "more_data").otherwise(F.col("status"))
    return signals.join(last, "id", "left").withColumn("status", status).withColumn("assignee", F.col("actor")).drop("actor", "decision")


def by_status(signals: DataFrame) -> DataFrame:
    """(status, n)"""
    return signals.groupBy("status").agg(F.count("*").alias("n"))


def history(decisions: DataFrame, signal: str, order: list[str]) -> DataFrame:
    """The decisions on a signal, oldest first."""
    return decisions.where(F.col("signal_id") == signal).orderBy(*order)


def rollup(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a project: signals by status and kind, sources and enabled ones, and the triage queue."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}_{v}")
    own = signals.groupBy("project_id").agg(F.count("*").alias("signals"), *(n("status", s) for s in ("new", "confirmed", "rejected", "more_data")), *(n("kind", k) for k in ("adr", "trend", "cluster")))
    of = sources.groupBy("project_id").agg(F.count("*").alias("sources"), F.count_if("enabled").alias("sources_enabled"))
    return own.join(of, "project_id", "left").na.fill(0).withColumn("queue", F.col("status_new") + F.col("status_more_data"))


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _coded(codes: Column) -> Column:
    """Codes grouped by their system, in the order they come."""
    systems = F.array_distinct(F.transform(codes, lambda c: c["code_system"]))
    entry = lambda c: F.struct(c["code"].alias("code"), c["surface"].alias("surface"), c["display_name"].alias("display"))
    return F.map_from_entries(F.transform(systems, lambda s: F.struct(s, F.transform(F.filter(codes, lambda c: c["code_system"] == s), entry))))


def _of_systems(codes: Column, systems: list[str]) -> Column:
    """Codings of the listed systems; null without one."""
    found = F.transform(F.filter(codes, lambda c: c["code_system"].isin(systems)), lambda c: F.struct(c["code_system"].alias("system"), c["code"].alias("code"), c["surface"].alias("surface")))
    return F.when(F.size(found) > 0, found)


def _header(generated_at: str, *first: Column) -> list[Column]:
    """What both forms say of their signal and, where it has one, its project."""
    project = [F.col("project.id").alias("project_id"), F.col("project.slug").alias("project_slug"), F.col("project.name").alias("project_name"), F.col("project.owner").alias("project_owner")]
    return [F.lit(generated_at).alias("generated_at"), *first, F.col("id").alias("signal_id"), F.col("score").alias("signal_score"), F.col("status").alias("signal_status"), F.col("audit_chain_head"), *project]


def _with_project(signals: DataFrame, projects: DataFrame) -> DataFrame:
    own = projects.select(F.col("id").alias("project_id"), F.struct("id", "slug", "name", "owner").alias("project"))
    return signals.join(own, "project_id", "left")


# Form names and versions, code systems of drugs and of reactions, and the note on patients.
OUTBREAK_FORM, CASE_FORM = ("IDSP-P", "2024.1-draft"), ("PvPI-ICSR", "E2B(R3)-flat-draft")
DRUG_SYSTEMS, REACTION_SYSTEMS = ["WHO-DRUG", "RxNorm"], ["MedDRA", "SNOMED-CT", "ICD-11", "ICD-10"]
PATIENT_NOTE = "Patient-level data not available; ICSR derived from aggregate social listening signal. Manual case follow-up required prior to submission."


def outbreak_forms(signals: DataFrame, projects: DataFrame, generated_at: str, reporter: str = "auto-draft", case_definition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): id and payload of outbreak forms. Signals with neither a cluster nor a trend statistic are rejected.

    signals: id, project_id, kind, score, status, title, explanation, district, started_at, detected_at, audit_chain_head, codes, evidence_mention_ids,
    cluster_stat, trend_stat. projects: id, slug, name, owner; a signal may have none. Times are UTC. Fields without a value are left out of the text.
    """
    full = _with_project(signals, projects)
    c, t = F.col("cluster_stat"), F.col("trend_stat")
    able = c.isNotNull() | t.isNotNull()
    cluster = F.when(c.isNotNull(), F.struct(*(c[x].alias(x) for x in ("centroid_lat", "centroid_lon", "radius_deg", "population", "observed", "expected", "log_likelihood", "p_value")), _iso(c["window_start"]).alias("window_start"), _iso(c["window_end"]).alias("window_end")))
    trend = F.when(t.isNotNull(), F.struct(*(t[x].alias(x) for x in ("keyword", "z_score", "baseline", "current")), _iso(t["window_start"]).alias("window_start"), _iso(t["window_end"]).alias("window_end"), t["district"].alias("district")))
    outbreak = F.struct(
        F.col("title").alias("syndrome_or_disease"), F.col("district"), F.coalesce(c["observed"].cast("bigint"), F.bround(t["current"]).cast("bigint")).alias("presumptive_case_count"),
        _iso(F.col("started_at")).alias("started_at"), _iso(F.col("detected_at")).alias("detected_at"), F.lit(case_definition).cast("string").alias("case_definition"))
    form = F.struct(
        F.lit(OUTBREAK_FORM[0]).alias("form_type"), F.lit(OUTBREAK_FORM[1]).alias("form_version"), F.struct(*_header(generated_at, F.lit(reporter).alias("reporter"), F.col("kind").alias("signal_kind"))).alias("header"),
        outbreak.alias("outbreak"), F.struct(cluster.alias("cluster"), trend.alias("trend")).alias("statistics"), _coded(F.col("codes")).alias("codes"), F.col("explanation").alias("narrative"),
        F.size("evidence_mention_ids").alias("evidence_mention_count"), F.col("evidence_mention_ids"))
    return full.where(able).select("id", F.to_json(form).alias("payload")), full.where(~able).select("id", F.lit("needs a cluster or trend statistic").alias("reason"))


def case_forms(signals: DataFrame, projects: DataFrame, generated_at: str, sender: str = "auto-draft", country: str = "IN", patient: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): id, serious and payload of case reports. Only adr signals with their statistic are reported; serious from a score of .7.

    signals: as for outbreak_forms, with adr_stat. patient: what is known beyond the defaults, by field. Fields without a value are left out of the text.
    """
    full = _with_project(signals, projects)
    s, able = F.col("adr_stat"), (F.col("kind") == "adr") & F.col("adr_stat").isNotNull()
    known = {"patientidentifier": F.concat(F.lit("setu-aggregate-"), F.col("id").cast("string")), "patientonsetage_unit": F.lit("unknown"), "patientsex": F.lit("unknown"), "note": F.lit(PATIENT_NOTE)} | {k: F.lit(v) for k, v in (patient or {}).items()}
    drug = F.struct(s["drug"].alias("medicinalproduct"), F.lit("1").alias("drugcharacterization"), _of_systems(F.col("codes"), DRUG_SYSTEMS).alias("drugcoding"))
    reaction = F.struct(s["event"].alias("reactionmeddrapt"), F.lit("unknown").alias("reactionoutcome"), _of_systems(F.col("codes"), REACTION_SYSTEMS).alias("reactioncoding"))
    numbers = F.struct(*(s[x].alias(x) for x in ("observed", "expected", "prr", "ror", "ic", "ic_lower", "chi_squared")), _iso(s["window_start"]).alias("window_start"), _iso(s["window_end"]).alias("window_end"))
    serious = F.col("score") >= 0.7
    form = F.struct(
        F.lit(CASE_FORM[0]).alias("form_type"), F.lit(CASE_FORM[1]).alias("form_version"), F.concat(F.lit("SETU-"), F.col("id").cast("string")).alias("safetyreportid"), F.lit(1).alias("safetyreportversion"),
        F.lit(country).alias("primarysourcecountry"), F.lit(country).alias("occurcountry"), F.lit(generated_at).alias("transmissiondate"), F.lit("2").alias("reporttype"), F.when(serious, "1").otherwise("2").alias("serious"),
        F.struct(F.lit("2").alias("sendertype"), F.lit(sender).alias("senderorganization")).alias("sender"), F.struct(F.lit("5").alias("qualification"), F.lit(country).alias("reportercountry")).alias("primarysource"),
        F.struct(*(v.alias(k) for k, v in known.items())).alias("patient"), F.array(drug).alias("drugs"), F.array(reaction).alias("reactions"), numbers.alias("statistics"), F.col("explanation").alias("narrative"),
        F.struct(*_header(generated_at)).alias("header"), F.size("evidence_mention_ids").alias("evidence_mention_count"), F.col("evidence_mention_ids"))
    why = F.when(F.col("kind") != "adr", "needs an adr signal").otherwise("needs an adverse event statistic")
    return full.where(able).select("id", serious.alias("serious"), F.to_json(form).alias("payload")), full.where(~able).select("id", why.alias("reason"))


def next_version(sets: DataFrame) -> DataFrame:
    """Keyword sets numbered within their project in the order they were made."""
    return sets.withColumn("version", F.row_number().over(Window.partitionBy("project_id").orderBy("created", "id")))


def noisy(df: DataFrame, keys: list[str], value: str, sensitivity: float, epsilon: float, seed: int, non_negative: bool = True) -> DataFrame:
    """df with noisy: value plus Laplace noise of scale sensitivity / epsilon. The draw follows from the row's keys and the seed, so a row that is computed
    again, or in another partition, gets the same noise and spends nothing more. Keys must tell rows apart, and the seed is a secret."""
    if epsilon <= 0 or sensitivity <= 0:
        raise ValueError("epsilon and sensitivity must be above 0")
    draw = F.pmod(F.xxhash64(F.lit(seed), *(F.col(k).cast("string") for k in keys)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    u = draw - 0.5
    out = F.col(value) - sensitivity / epsilon * F.signum(u) * F.log(F.greatest(F.lit(1e-12), 1 - 2 * F.abs(u)))
    return df.withColumn("noisy", F.greatest(out, F.lit(0.0)) if non_negative else out)


def charged(requests: DataFrame, budget: float) -> DataFrame:
    """(key, seq, epsilon, accepted, spent): requests in order against a budget; refused ones spend nothing, and those of no or negative epsilon are refused. requests: key, seq, epsilon."""
    def step(spent: float, _: int, epsilon: float | None) -> tuple[float, tuple]:
        fits = epsilon is not None and epsilon > 0 and spent + epsilon <= budget + 1e-12
        after = spent + epsilon if fits else spent
        return after, (epsilon, fits, after)

    rows = requests.select("key", F.col("seq").cast("bigint").alias("seq"), F.col("epsilon").cast("double").alias("asked"))
    return keyed_fold(rows, ["key"], ["seq"], ["asked"], "epsilon double, accepted boolean, spent double", 0.0, step)


#: Health, failures in a row, and whether the breaker is open, before any outcome.
HEALTHY = (1.0, 0, False)


def poll_outcome(state: tuple[float, int, bool], ok: bool | None, alpha: float, opens: float, closes: float) -> tuple[tuple, tuple]:
    """The state after one outcome, twice: to go on with, and as the outcome's row."""
    health, failures, is_open = state
    health = (1 - alpha) * health + (alpha if ok else 0.0)
    after = (health, 0, is_open and health < closes) if ok else (health, failures + 1, is_open or health < opens)
    return after, after


def breaker(outcomes: DataFrame, alpha: float = 0.3, opens: float = 0.3, closes: float = 0.7, base: float = 60.0, most: float = 16.0) -> DataFrame:
    """(source, seq, health, failures, is_open, delay) after each poll outcome. outcomes: source, seq, success (null: none)."""
    rows = outcomes.select("source", F.col("seq").cast("bigint").alias("seq"), "success")
    out = keyed_fold(rows, ["source"], ["seq"], ["success"], "health double, failures int, is_open boolean", HEALTHY, lambda s, _, ok: poll_outcome(s, ok, alpha, opens, closes))
    delay = F.when(~F.col("is_open") & (F.col("failures") == 0), base).otherwise(base * F.least(F.pow(F.lit(2.0), F.greatest(F.col("failures") - 1, F.lit(0))), F.lit(most)))
    return out.withColumn("delay", delay)


# ---- validation


def required(name: str) -> Column:
    return F.when(F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == ""), F.lit(f"{name}:missing"))


def in_range(name: str, low: float, high: float) -> Column:
    return F.when(~F.col(name).between(low, high), F.lit(f"{name}:range"))


def one_of(name: str, values: list[str]) -> Column:
    return F.when(~F.col(name).isin(values), F.lit(f"{name}:enum"))


def fits(name: str, pattern: str) -> Column:
    return F.when(~F.col(name).rlike(pattern), F.lit(f"{name}:pattern"))


def at_most(name: str, n: int) -> Column:
    return F.when(F.length(name) > n, F.lit(f"{name}:length"))


def validated(df: DataFrame, rules: list[Column], allowed: list[str] | None = None) -> DataFrame:
    """df with reasons (an array, empty if valid); columns that aren't allowed are a reason on every row."""
    extra = [F.lit(f"{c}:unknown") for c in df.columns if allowed is not None and c not in allowed]
    return df.withColumn("reasons", F.array_compact(F.array(*rules, *extra)))


def is_uuid(name: str) -> Column:
    return fits(name, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def checked(name: str, kind: str, *, optional: bool = False, at: str | None = None) -> list[Column]:
    """The rules of a declared field, by the name of its kind (see KINDS); at: where it stands, if not in a column of its name."""
    at = at or name
    rules = KINDS[kind](at)
    named = [F.when(r.isNotNull(), F.concat(F.lit(name), F.substring(r, F.lit(len(at) + 1), F.lit(64)))) for r in rules]
    return named if optional else [F.when(F.col(at).isNull(), F.lit(f"{name}:missing")), *named]


def _text(most: int):
    return lambda c: [F.when(F.trim(c) == "", F.lit(f"{c}:length")), at_most(c, most)]


# Kinds of field with their limits, and the fields of records.
KINDS = {
    "uuid": lambda c: [is_uuid(c)], "short": _text(512), "long": _text(8192), "raw": _text(65_536), "share": lambda c: [in_range(c, 0, 1)], "polarity": lambda c: [in_range(c, -1, 1)],
    "count": lambda c: [F.when(F.col(c) < 0, F.lit(f"{c}:range"))], "positive": lambda c: [F.when(~(F.col(c) >= 0), F.lit(f"{c}:range"))], "number": lambda c: [], "time": lambda c: [],
    "hash": lambda c: [fits(c, "^[0-9a-f]{8,128}$")], "language": lambda c: [fits(c, "^[a-z]{2,3}(-[A-Za-z0-9]{2,8})?$"), at_most(c, 8)], "slug": lambda c: [fits(c, "^[a-z0-9][a-z0-9_-]*$"), at_most(c, 128)],
    "latitude": lambda c: [in_range(c, -90, 90)], "longitude": lambda c: [in_range(c, -180, 180)], "signal_kind": lambda c: [one_of(c, ["adr", "trend", "cluster"])],
    "signal_status": lambda c: [one_of(c, ["new", "confirmed", "rejected", "more_data"])], "decision": lambda c: [one_of(c, ["confirm", "reject", "more_data"])],
    "label": lambda c: [one_of(c, ["likely_misinformation", "sarcasm", "coordinated_inauthentic", "clean"])], "form": lambda c: [one_of(c, ["IDSP_P", "PvPI_ICSR"])],
}
RECORDS = {
    "project": [("id", "uuid"), ("slug", "slug"), ("name", "short"), ("description", "long"), ("owner", "short"), ("created_at", "time"), ("updated_at", "time")],
    "source": [("id", "uuid"), ("project_id", "uuid"), ("name", "short"), ("connector_type", "short"), ("health_score", "share"), ("last_success_at", "time?"), ("last_error", "short?"), ("created_at", "time")],
    "mention": [("id", "uuid"), ("project_id", "uuid"), ("source_config_id", "uuid"), ("connector_type", "short"), ("source_uri", "short"), ("author_hash", "hash"), ("fetched_at", "time"), ("original_text", "raw"), ("locale_hint", "language?")],
    "normalized": [("mention_id", "uuid"), ("project_id", "uuid"), ("normalized_text", "raw"), ("translated_text", "raw?"), ("redaction_count", "count"), ("normalized_at", "time"), ("pipeline_version", "short")],
    "sentiment": [("polarity", "polarity"), ("subjectivity", "share"), ("model_version", "short"), ("confidence", "share")],
    "misinformation": [("label", "label"), ("confidence", "share"), ("rationale", "long?")],
    "adverse_event": [("drug", "short"), ("event", "short"), ("observed", "count"), ("expected", "positive"), ("prr", "positive"), ("ror", "positive"), ("ic", "number"), ("ic_lower", "number"), ("chi_squared", "positive"), ("window_start", "time"), ("window_end", "time")],
    "trend": [("keyword", "short"), ("district", "short?"), ("z_score", "number"), ("baseline", "positive"), ("current", "positive"), ("window_start", "time"), ("window_end", "time")],
    "cluster": [("centroid_lat", "latitude"), ("centroid_lon", "longitude"), ("radius_deg", "positive"), ("population", "count"), ("observed", "count"), ("expected", "positive"), ("log_likelihood", "number"), ("p_value", "share"), ("window_start", "time"), ("window_end", "time")],
    "signal": [("id", "uuid"), ("project_id", "uuid"), ("kind", "signal_kind"), ("score", "share"), ("title", "short"), ("explanation", "long"), ("district", "short?"), ("started_at", "time"), ("detected_at", "time"), ("status", "signal_status"), ("assignee", "short?"), ("audit_chain_head", "hash?")],
    "triage": [("signal_id", "uuid"), ("actor", "short"), ("decision", "decision"), ("rationale", "long?"), ("decided_at", "time")],
    "audit": [("id", "uuid"), ("sequence", "count"), ("prev_hash", "hash"), ("payload_hash", "hash"), ("actor", "short"), ("action", "short"), ("signal_id", "uuid?"), ("mention_id", "uuid?"), ("payload_summary", "short"), ("recorded_at", "time")],
    "health": [("source_config_id", "uuid"), ("health_score", "share"), ("uptime_ratio", "share"), ("error_rate", "share"), ("last_success_at", "time?"), ("throughput_per_min", "positive"), ("snapshot_at", "time")],
    "prefilled": [("form_kind", "form"), ("signal_id", "uuid"), ("generated_at", "time"), ("schema_version", "short")],
}


def validated_record(df: DataFrame, record: str, allowed: list[str] | None = None) -> DataFrame:
    """df with reasons why a row isn't a record of this name (see RECORDS); columns of nested values are allowed by name. Columns that a record needs and df lacks are a reason on every row."""
    fields = RECORDS[record]
    rules: list[Column] = []
    for name, kind in fields:
        if name in df.columns:
            rules += checked(name, kind.rstrip("?"), optional=kind.endswith("?"))
        elif not kind.endswith("?"):
            rules.append(F.lit(f"{name}:missing"))
    return validated(df, rules, [*(n for n, _ in fields), *(allowed or [])])


def string_leaves(schema: DataType, at: Column) -> list[Column]:
    """Every string in a value of this type, nested ones too, as columns of text."""
    if isinstance(schema, StringType):
        return [at]
    if isinstance(schema, StructType):
        return [x for f in schema.fields for x in string_leaves(f.dataType, at[f.name])]
    if isinstance(schema, ArrayType):
        return [F.array_join(F.transform(at, lambda e: F.concat_ws("\n", *string_leaves(schema.elementType, e))), "\n")] if string_leaves(schema.elementType, at[0]) else []
    if isinstance(schema, MapType):
        return string_leaves(ArrayType(schema.keyType), F.map_keys(at)) + string_leaves(ArrayType(schema.valueType), F.map_values(at))
    return []


def forbidden(df: DataFrame, terms: list[str]) -> Column:
    """Whether any string of a row, nested ones too, has one of the terms as a whole word, in any case."""
    leaves = [x for f in df.schema.fields for x in string_leaves(f.dataType, F.col(f.name))]
    return F.concat_ws("\n", *leaves).rlike(r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?![\p{L}\p{N}_])")


def utc_timestamp(text: Column) -> Column:
    """A timestamp for text with an offset; null without one."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def absolute_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) != ""), F.lit(False))


def content_type(value: Column) -> Column:
    return F.lower(F.trim(value))


def salvaged_json(text: Column) -> Column:
    """The first fenced block of a model's output that is a JSON object or array; without any fence, what stands from the first bracket to the last of its kind. Null if nothing parses."""
    fits = lambda j: F.try_parse_json(j).isNotNull()
    fenced = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"), 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.size(fenced) > 0, F.get(F.filter(fenced, fits), 0)).when((bare != "") & fits(bare), bare)


def salvage_outcome(text: Column, attempt: Column, most: int = 3) -> Column:
    """ok, retry or quarantine."""
    return F.when(salvaged_json(text).isNotNull(), "ok").when(attempt < most, "retry").otherwise("quarantine")
