"""Text annotations on columns: PII, scripts, sentiment, misinformation cues, negation, mention text.

Word characters are letters, digits and `_` of any script, without combining marks; that is spelled out because Java's \\w is ASCII.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

W = r"[\p{L}\p{N}_]"
NOT_BEFORE, NOT_AFTER = rf"(?<!{W})", rf"(?!{W})"
#: A word boundary: a word character on exactly one side.
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# Kind, pattern and token of personal data, in the order that decides ties.
PII = [
    ("aadhaar", EDGE + r"\p{Nd}{4}[-\s]?\p{Nd}{4}[-\s]?\p{Nd}{4}" + EDGE, "[AADHAAR]"),
    ("pan", EDGE + r"[A-Z]{5}\p{Nd}{4}[A-Z]" + EDGE, "[PAN]"),
    ("mobile", EDGE + r"(?:\+?91[-\s]?|0)?[6-9]\p{Nd}{9}" + EDGE, "[MOBILE]"),
    ("email", EDGE + rf"[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+" + EDGE, "[EMAIL]"),
    ("url_handle", r"(?i:https?)://[^\s)<>]+", "[URL]"),
    ("username", r"(?<![A-Za-z0-9_])@[A-Za-z0-9_]{2,32}" + EDGE, "[USER]"),
]

# Scripts, their languages and tags, in the order that decides ties.
SCRIPTS = [("Devanagari", "hi", "Deva"), ("Tamil", "ta", "Taml"), ("Telugu", "te", "Telu"), ("Kannada", "kn", "Knda"), ("Bengali", "bn", "Beng"), ("Gujarati", "gu", "Gujr"), ("Gurmukhi", "pa", "Guru"), ("Malayalam", "ml", "Mlym"), ("Oriya", "or", "Orya"), ("Arabic", "ar", "Arab"), ("Latin", "en", "Latn")]

#: A letter of a script other than Latin.
OTHER_SCRIPTS = "[" + "".join(rf"\p{{Is{n}}}" for n, _, _ in SCRIPTS[:-1]) + "]"

# Sentiment and negation cues.
POSITIVE = ["good", "great", "better", "relief", "thanks", "helpful", "safe", "अच्छा", "बेहतर", "ठीक", "நன்றி", "మంచి", "ಚೆನ್ನಾಗಿದೆ"]
NEGATIVE = ["bad", "worse", "pain", "vomit", "vomiting", "fever", "die", "death", "danger", "dangerous", "fake", "scared", "afraid", "harm", "harmful", "खराब", "दर्द", "मौत", "खतरा", "வலி", "నొప్పి", "ಸಾವು"]
SUBJECTIVE = ["i ", "we ", "my ", "मेरा", "எங்கள்", "మా", "ನನ್ನ", "feel", "think", "believe"]
NEGATION_REACH = 24
NEGATIONS = ["no ", "not ", "without ", "denies ", "नहीं", "இல்லை", "లేదు", "ಇಲ್ಲ"]

# Misinformation cues by label and confidence, the first that fits counts.
CUES = [
    ("likely_misinformation", 0.7, [rf"{EDGE}vaccin{W}* (?:cause|causes) (?:autism|infertility|death){EDGE}", rf"{EDGE}5g\s+(?:causes|spreads){EDGE}", rf"{EDGE}plandemic{EDGE}", rf"{EDGE}(cures?|cured)\s+(cancer|covid|hiv){EDGE}", rf"{EDGE}go[a]?[u]?mutra\s+cure{EDGE}"]),
    ("sarcasm", 0.55, [rf"{EDGE}(?:yeah|sure|right),?\s+(?:right|sure|ok+){EDGE}", rf"{EDGE}(?:totally|definitely)\s+not{EDGE}", rf"/s{EDGE}"]),
    ("coordinated_inauthentic", 0.5, [rf"#?{EDGE}(boycott|banthis){W}*{EDGE}"]),
]


#: What a lower-cased text must hold for a label's cues to find anything: looked for before the patterns, as it is far cheaper.
CUE_SIGNS = {
    "likely_misinformation": ["vaccin", "5g", "plandemic", "cure"],
    "sarcasm": ["yeah", "sure", "right", "totally", "definitely", "/s"],
    "coordinated_inauthentic": ["boycott", "banthis"],
}


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop>> of all matches, counted in characters from 0."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(pairs, state, step, lambda s: s["out"])


#: The least that a text must have for a pattern to find anything: far cheaper than the pattern.
_GATES = {"aadhaar": r"\p{Nd}{4}", "pan": r"[A-Z]\p{Nd}{4}[A-Z]", "mobile": r"[6-9]\p{Nd}{9}"}
_SIGNS = {"email": "@", "username": "@", "url_handle": "://"}


def pii_findings(text: Column) -> Column:
    """array<struct<start, stop, kind, token>> on the text: earliest first, then longest, then table order; no overlaps."""
    none = F.array().cast("array<struct<start:int,shorter:int,ord:int,stop:int,kind:string,token:string>>")

    def of(i: int, kind: str, pattern: str, token: str) -> Column:
        may = F.contains(text, F.lit(_SIGNS[kind])) if kind in _SIGNS else text.rlike(_GATES[kind])
        return F.when(may, F.transform(spans(text, pattern), lambda m: F.struct(m["start"].alias("start"), (m["start"] - m["stop"]).alias("shorter"), F.lit(i).alias("ord"), m["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lit(token).alias("token")))).when(text.isNotNull(), none)

    every = F.concat(*(of(i, *row) for i, row in enumerate(PII)))
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,stop:int,kind:string,token:string>>").alias("out"))
    keep = lambda s, m: F.when(m["start"] < s["end"], s).otherwise(F.struct(m["stop"].alias("end"), F.concat(s["out"], F.array(F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["kind"].alias("kind"), m["token"].alias("token")))).alias("out")))
    return F.aggregate(F.array_sort(every), empty, keep, lambda s: s["out"])


def redacted(text: Column, findings: Column) -> Column:
    """text with each finding replaced by its token."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, m: F.struct(m["stop"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), m["token"]).alias("out"))
    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def dominant_script(token: Column) -> Column:
    """The script with most letters of a token; Latin if it has none. Letters are counted only where there are some of other scripts."""
    counts = [F.regexp_count(token, F.lit(rf"\p{{Is{name}}}")) for name, _, _ in SCRIPTS]
    top = F.greatest(*counts)
    out = F.when(~token.rlike(OTHER_SCRIPTS), "Latin").when(top == 0, "Latin")
    for (name, _, _), n in zip(SCRIPTS, counts, strict=True):
        out = out.when(n == top, name)
    return out


def language_segments(text: Column) -> Column:
    """array<struct<start, stop, language, script>>: runs of tokens with one dominant script.

    A text without letters of other scripts is one run; only mixed texts are looked at token by token, and only tokens with such
    letters are counted. Runs are placed in one pass over their lengths.
    """
    names = F.create_map(*(F.lit(x) for n, lang, _ in SCRIPTS for x in (n, lang)))
    tags = F.create_map(*(F.lit(x) for n, _, tag in SCRIPTS for x in (n, tag)))
    row = lambda start, stop, script: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.element_at(names, script).alias("language"), F.element_at(tags, script).alias("script"))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), 0), lambda t: F.struct(F.length(t).alias("n"), dominant_script(t).alias("script")))
    parts = F.struct(tokens.alias("t"), F.transform(F.split(text, r"\S+", -1), lambda g: F.length(g)).alias("gaps"))
    none = F.array().cast("array<struct<start:int,stop:int,language:string,script:string>>")

    def runs(p: Column) -> Column:
        """Each run's first token, one after another; `at` is where the run before ended."""
        n = F.size(p["t"])
        opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(p["t"], i)["script"] != F.get(p["t"], i - 1)["script"]))
        pairs = lambda o: F.transform(o, lambda i, k: F.struct(i.alias("a"), F.coalesce(F.get(o, k + 1), n).alias("b")))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.get(p["gaps"], x["a"])
            words = F.aggregate(F.slice(p["t"], x["a"] + 1, x["b"] - x["a"]), F.lit(0), lambda m, t: m + t["n"])
            stop = start + F.aggregate(F.slice(p["gaps"], x["a"] + 2, x["b"] - x["a"] - 1), words, lambda m, g: m + g)
            return F.struct(stop.alias("at"), F.concat(s["out"], F.array(row(start, stop, F.get(p["t"], x["a"])["script"]))).alias("out"))

        return F.aggregate(let(opens, pairs), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    plain = F.array(row(F.length(F.regexp_extract(text, r"^\s*", 0)), F.length(F.regexp_replace(text, r"\s+$", "")), F.lit("Latin")))
    return F.when(~text.rlike(r"\S"), none).when(text.rlike(OTHER_SCRIPTS), let(parts, runs)).otherwise(plain)


def dominant_language(segments: Column) -> Column:
    """The language with most characters, the first in segment order on a tie; en without any."""
    def top(runs: Column) -> Column:
        names = F.array_distinct(F.transform(runs, lambda s: s["language"]))
        totals = F.transform(names, lambda n, i: F.struct(F.aggregate(F.filter(runs, lambda s: s["language"] == n), F.lit(0), lambda a, s: a + s["stop"] - s["start"]).alias("n"), (-i).alias("first"), n.alias("language")))
        return F.array_max(totals)["language"]

    # named once: segments would be found again for every language
    return F.coalesce(let(segments, top), F.lit("en"))


def needs_translation(segments: Column) -> Column:
    return F.exists(segments, lambda s: s["language"].isin("hi", "ta", "te", "kn", "bn", "gu", "pa", "ml", "or"))


def cue_hits(text: Column, cues: list[str]) -> Column:
    """ASCII cues as whole words, others as substrings, in lower-cased text. All ASCII cues are one pattern that a first letter opens; others are looked for only where there are letters of their scripts."""
    low, plain, other = F.lower(text), [c for c in cues if c.isascii()], [c for c in cues if not c.isascii()]
    letters = "".join(sorted({c[0] for c in plain}))
    hits = F.regexp_count(low, F.lit(f"(?=[{letters}]){NOT_BEFORE}(?:{'|'.join(rf'\Q{c}\E' for c in plain)}){NOT_AFTER}"))
    codes = sorted(ord(x) for c in other for x in c)
    far = sum((F.regexp_count(low, F.lit(rf"\Q{c}\E")) for c in other[1:]), F.regexp_count(low, F.lit(rf"\Q{other[0]}\E")))
    return hits + F.when(text.rlike(rf"[\x{{{codes[0]:x}}}-\x{{{codes[-1]:x}}}]"), far).otherwise(0)


def sentiment(text: Column) -> Column:
    """struct<polarity, subjectivity, confidence>; null for blank text."""
    p, n, s = (cue_hits(text, c).cast("double") for c in (POSITIVE, NEGATIVE, SUBJECTIVE))
    total = p + n + s
    none = F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"), F.lit(0.2).alias("confidence"))
    some = F.struct(((p - n) / F.greatest(p + n, F.lit(1.0))).alias("polarity"), (s / F.greatest(total, F.lit(1.0))).alias("subjectivity"), F.greatest(F.lit(0.3), F.least(F.lit(0.9), total / 6)).alias("confidence"))
    return F.when(F.trim(text) == "", None).when(total == 0, none).otherwise(some)


def misinformation(text: Column) -> Column:
    """struct<label, confidence>; null for blank text."""
    flag = lambda label, sure: F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"))

    def told(low: Column) -> Column:
        out = F.when(F.trim(text) == "", None)
        for label, sure, patterns in CUES:
            may = reduce(or_, (F.contains(low, F.lit(sign)) for sign in CUE_SIGNS[label]))
            out = out.when(may & text.rlike("(?i)" + "|".join(patterns)), flag(label, sure))
        return out.otherwise(flag("clean", 0.4))

    return let(F.lower(text), told)


def negated(text: Column, start: Column) -> Column:
    """Whether a cue stands in the 24 characters before `start` (from 0)."""
    return has_cue(F.substring(text, F.greatest(start - NEGATION_REACH, F.lit(0)) + 1, F.least(start, F.lit(NEGATION_REACH))))


def has_cue(before: Column) -> Column:
    """Whether a negation cue stands in what is before a place."""
    low, out = F.lower(before), F.lit(False)
    for cue in NEGATIONS:
        out = out | low.contains(cue)
    return out


def mention_text(title: Column, body: Column, most: int) -> Column:
    """Title, blank line, body; trimmed and cut; null if empty."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    text = F.substring(F.trim(F.concat_ws("\n\n", part(title), part(body))), 1, most)
    return F.when(text != "", text)


def author_hash(handle: Column, salt: str) -> Column:
    """16 hexadecimal digits for a handle, whatever its case; `anonymous` without one."""
    low = F.lower(F.trim(handle))
    return F.when(F.coalesce(low, F.lit("")) == "", "anonymous").otherwise(F.substring(F.sha2(F.concat(F.lit(f"{salt}::"), low), 256), 1, 16))


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Any keyword is a substring of the lower-cased text; no keywords let everything pass."""
    if not keywords:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), F.lower(k)))


def mention_confidence(entities: Column, sentiment_confidence: Column) -> Column:
    """Mean confidence of entities, else the sentiment's, else .3; from 0 to 1."""
    mean = F.aggregate(entities, F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size(entities)
    return F.least(F.greatest(F.coalesce(F.when(F.size(entities) > 0, mean), sentiment_confidence, F.lit(0.3)), F.lit(0.0)), F.lit(1.0))
