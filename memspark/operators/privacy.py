"""Redaction of credentials and counting of personal data, in JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Credential patterns, in order of application.
CREDENTIALS = [
    "\\b(sk-[A-Za-z0-9]{20,})\\b",
    "\\b(sk-ant-[A-Za-z0-9-]{20,})\\b",
    "\\b(ghp_[A-Za-z0-9]{36})\\b",
    "\\b(gho_[A-Za-z0-9]{36})\\b",
    "\\b(ghs_[A-Za-z0-9]{36})\\b",
    "\\b(ghr_[A-Za-z0-9]{36})\\b",
    "\\b(xox[baprs]-[A-Za-z0-9-]{20,})\\b",
    "\\b(AKIA[0-9A-Z]{16})\\b",
    "\\b(AIza[0-9A-Za-z_-]{35})\\b",
    "\\b(sk_live_[0-9a-zA-Z]{24,})\\b",
    "\\b(pk_live_[0-9a-zA-Z]{24,})\\b",
    "\\b(sk_test_[0-9a-zA-Z]{24,})\\b",
    "\\b([0-9]{10}:[A-Za-z0-9_-]{35})\\b",
    "(?i)\\b(Bearer\\s+[A-Za-z0-9_\\-\\.]{20,})\\b",
    "(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    "(?s)<private>.*?</private>",
    "(?s)<secret>.*?</secret>",
    "(?s)<credentials>.*?</credentials>",
]
EMAIL, IP = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b"
PHONE = "\\+?[0-9][0-9 ()-]{7,}[0-9]"


def strip_secrets(text: Column, replacement: str = "[REDACTED]") -> Column:
    for pattern in CREDENTIALS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement.replace("$", "\\$")))
    return text


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for pattern in CREDENTIALS:
        out = out | text.rlike(pattern)
    return out


def personal_counts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns in keep with emails, ips and phones: how many of each a text holds; each place counts for one kind.

    What one step takes out is used by the next twice, so steps are projections of their own; texts without a sign
    of an address are not searched for one."""
    has = lambda c, sign, found, other: F.when(F.contains(c, F.lit(sign)), found).otherwise(other)
    t, bare = F.col("_t"), F.col("_bare")
    d = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", has(t, "@", F.regexp_replace(t, EMAIL, " "), t).alias("_bare"))
    d = d.select(*keep, has(t, "@", F.regexp_count(t, F.lit(EMAIL)), F.lit(0)).alias("emails"), "_bare", F.regexp_replace(bare, IP, " ").alias("_rest"))
    # A place that is an IP address leaves a blank, so texts that stay as they were have none.
    ips = F.when(F.col("_rest") == bare, F.lit(0)).otherwise(F.regexp_count(bare, F.lit(IP)))
    return d.select(*keep, "emails", ips.alias("ips"), F.regexp_count("_rest", F.lit(PHONE)).alias("phones"))


def masked(text: Column) -> Column:
    """Credentials, addresses and numbers replaced by typed placeholders."""
    out = strip_secrets(text)
    for pattern, name in ((EMAIL, "[EMAIL]"), (IP, "[IP]"), (PHONE, "[PHONE]")):
        out = F.regexp_replace(out, pattern, name)
    return out
