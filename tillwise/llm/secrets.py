"""Secret scans with an incremental ledger of blobs.

A blob is a text under its content address. The ledger holds the blobs that a version of the
rules has scanned and what it found; a run scans only (blob, rule version) pairs that are not in it,
appends them, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import new_folder

# Kinds, patterns, the group whose length counts, and its least length, in the order of ties.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*(?:[A-Z][A-Za-z]+-[A-Za-z]+:[^\n]*\n){0,9}[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("url", r"[a-z][a-z0-9+.-]{0,19}://[^\s/:@]+:[^\s/:@]+@", 0, 1),
    ("provider", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}", 0, 1),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rule_version string, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank, kind, end) of one rule, in code points.

    Splitting at the matches gives what lies between them, so running lengths are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("before"), found.alias("match"), checked.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    listed = F.aggregate(zipped, empty, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), listed).otherwise(empty["out"])


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule_version, spans in order) of texts (blob, text)."""
    found = [spans_of(F.col("text"), rank, *rule) for rank, rule in enumerate(rules)]
    return blobs.select("blob", F.lit(rule_version(rules)).alias("rule_version"), F.sort_array(F.concat(*found)).alias("spans"))


def addressed(versions: DataFrame) -> DataFrame:
    """The rows with their text's content address (null: that of the empty text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.withColumn("text", text).withColumn("blob", F.sha2(text.cast("binary"), 256))


def update(versions: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """Scan what the ledger (a folder of Parquet) lacks, append it, and return the ledger's rows of these rules.

    Equal texts are combined before they are shuffled, so a blob is scanned once
    however many versions hold it. A run that is broken off appends nothing. Runs that append at the same
    time may both scan a blob; their rows are equal and are read as one.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(versions)
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = spark.createDataFrame([], LEDGER)
    known = known.where(F.col("rule_version") == rule_version(rules))
    blobs = addressed(versions).select("blob", "text")
    unseen = blobs.join(known.select("blob"), "blob", "left_anti") if not known.isEmpty() else blobs
    once = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    scan(once, rules).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version(rules)).distinct()


def findings(documents: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """Per row: doc_id, blob and spans (start, rank, kind, end in code points), by its blob's findings.

    A null text is empty; repeated rows share a blob and have a row each; a null doc_id stays null;
    other columns are ignored; an empty table gives no rows.
    """
    scanned = update(documents, ledger, rules).where(F.size("spans") > 0).select("blob", "spans")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    paths = addressed(documents).select("doc_id", "blob")
    return paths.join(scanned, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, the base kinds' counts and digest, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    digest = F.sha2(written(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in BASE], digest, written(F.col("spans")).alias("spans"))
