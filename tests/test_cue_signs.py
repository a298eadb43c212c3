"""Signs that are looked for before misinformation patterns let every text through that a pattern fits."""

from pyspark.sql import functions as F

from signalwatch.functions import annotate as a

TEXTS = [
    "Vaccines CAUSE autism", "vaccination causes death", "5G  spreads", "a PLANDEMIC", "cures cancer", "Cured HIV", "gaumutra cure", "gomutra  CURE", "yeah, right", "Sure ok", "right okkk", "TOTALLY not",
    "definitely not", "fine /S", "#boycottx", "BanThis now", "a cure", "right", "sure thing", "totally", "plain", "", "   ", None, "İ plandemic", "/shop", "curé cancer", "Iſure ok",
]


def test_signs_lose_no_cue(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    plain = F.when(F.trim("text") == "", None)
    for label, _, patterns in a.CUES:
        plain = plain.when(F.col("text").rlike("(?i)" + "|".join(patterns)), label)
    told = df.select("i", a.misinformation(F.col("text"))["label"].alias("got"), plain.otherwise("clean").alias("want"))
    rows = told.collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and {r["got"] for r in rows} == {None, "clean", *(c[0] for c in a.CUES)}
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Contains(") >= len(a.CUES)  # patterns aren't the first to see a text
