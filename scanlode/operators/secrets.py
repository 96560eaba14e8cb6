"""Secrets in any text: tokens of known form, credential assignments and high-entropy literals.

The families' targets are public token formats; thresholds are our own choice:
an assignment needs a quoted value of 8 characters or more that is no placeholder,
no reference to the environment and no constant name; a high-entropy literal needs 20
characters or more of one word with digits and letters and 4 bits a character. A value
that a known form or an assignment reports is not reported for its entropy again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.operators.findings import COLUMNS, no_evidence

#: Public token formats, each with a text that every match holds (a cheap test before the pattern): fixed values.
TOKENS = (
    ("SEC001", "AWS access key id", "AKIA", r"\bAKIA[0-9A-Z]{16}\b"),
    ("SEC001B", "AWS secret access key", "", r"(?i)aws_?secret_?access_?key[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9/+=]{40}\b"),
    ("SEC002", "GitHub personal token", "ghp_", r"\bghp_[A-Za-z0-9]{30,}\b"),
    ("SEC004B", "GitHub fine-grained token", "github_pat_", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b"),
    ("SEC004C", "GitLab token", "glpat-", r"\bglpat-[A-Za-z0-9_\-]{20,}"),
    ("SEC005", "Stripe live key", "sk_live_", r"\bsk_live_[A-Za-z0-9]{16,}\b"),
    ("SEC007B", "Slack webhook", "hooks.slack.com", r"https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]+"),
    ("SEC008", "Private key block", "PRIVATE KEY", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("SEC009", "SendGrid key", "SG.", r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    ("SEC010", "Google API key", "AIza", r"\bAIza[0-9A-Za-z_\-]{35}"),
    ("SEC010B", "Google OAuth secret", "GOCSPX-", r"\bGOCSPX-[A-Za-z0-9_\-]{20,}"),
    ("SEC010C", "Google service-account key", "service_account", r"\"type\"\s*:\s*\"service_account\""),
    ("SEC012", "JSON web token", "eyJ", r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"),
    ("SEC015", "sk- API key", "sk-", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("SEC016", "sk-ant- API key", "sk-ant-", r"\bsk-ant-[A-Za-z0-9_\-]{20,}"),
    ("SEC017", "Azure storage connection", "AccountKey=", r"DefaultEndpointsProtocol=https?;AccountName=[^;\s]+;AccountKey=[A-Za-z0-9+/=]{40,}"),
    ("SEC018", "npm token", "npm_", r"\bnpm_[A-Za-z0-9]{30,}\b"),
    ("SEC020", "Telegram bot token", ":AA", r"\b[0-9]{8,10}:AA[A-Za-z0-9_\-]{32,}"),
    ("SEC021", "Discord bot token", ".", r"\b[MN][A-Za-z0-9]{23,25}\.[A-Za-z0-9_\-]{6}\.[A-Za-z0-9_\-]{27,}"),
    ("SEC024", "PyPI token", "pypi-", r"\bpypi-[A-Za-z0-9_\-]{30,}"),
    ("SEC025", "Hugging Face token", "hf_", r"\bhf_[A-Za-z0-9]{30,}\b"),
    ("SEC026", "Databricks token", "dapi", r"\bdapi[0-9a-f]{32}\b"),
    ("SEC028", "Vault token", "hvs.", r"\bhvs\.[A-Za-z0-9_\-]{20,}"),
    ("SEC029", "Shopify token", "shpat_", r"\bshpat_[0-9a-fA-F]{32}\b"),
    ("SEC031", "Database address with credentials", "://", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s:/@\"']+:[^\s:/@\"']+@[^\s\"']+"),
)
ASSIGNMENT = r"(?i)(?:password|passwd|pwd|secret|token|api[-_]?key|auth[-_]?key|access[-_]?key|client[-_]?secret|private[-_]?key)[\"']?\s*[:=]+\s*[\"'][^\"'\s]{8,}[\"']"
#: Every name of ASSIGNMENT holds one of these.
KEY_PARTS = ("pass", "pwd", "secret", "token", "key")
VALUE = r"[\"']([^\"'\s]{8,})[\"']$"
HARMLESS = r"(?i)your|change|insert|replace|example|placeholder|dummy|<|>|\*{3,}|xxx|\$\{|process\.env|os\.environ|getenv"
CONSTANT = r"^[A-Z][A-Z0-9_]*$"
LITERAL = r"[\"'][A-Za-z0-9+/_\-]{20,}[\"']"
LEAST_BITS = 4.0


def is_assigned(text: Column) -> Column:
    """Whether an assignment's value is a secret by its looks."""
    value = F.regexp_extract(text, VALUE, 1)
    return ~value.rlike(HARMLESS) & ~value.rlike(CONSTANT)


def is_random(text: Column) -> Column:
    """Whether a literal looks random."""
    looks = lambda bare: bare.rlike("[0-9]") & bare.rlike("[A-Za-z]") & ~bare.rlike(HARMLESS) & (C.entropy(bare) >= LEAST_BITS)
    return F.get(F.transform(F.array(F.regexp_replace(text, "[\"']", "")), looks), F.lit(0))


def secret_matches(files: DataFrame) -> DataFrame:
    """file_path, content, language, rule_id, rule_name, severity, line_number, text of every secret."""
    quoted = F.col("content").contains('"') | F.col("content").contains("'")
    named = reduce(or_, (F.lower("content").contains(x) for x in KEY_PARTS))
    rules = [(i, n, "HIGH", p, F.col("content").contains(h) if h else named) for i, n, h, p in TOKENS]
    rules += [("SEC013", "Credential assigned in source", "HIGH", ASSIGNMENT, quoted & named), ("SEC014", "High-entropy text", "MEDIUM", LITERAL, quoted)]
    cells = [F.when(cheap & F.col("content").rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(n).alias("rule_name"), F.lit(s).alias("severity"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("matches"), F.split("content", p, -1).alias("gaps"))) for i, n, s, p, cheap in rules]
    # The array is exploded where it is made: a test of a column of it would be pushed down, below an exchange too, and match everything twice.
    rows = files.where(F.col("language").isNotNull()).select("file_path", "content", "language", F.explode(F.array_compact(F.array(*cells))).alias("h"))
    placed = F.arrays_zip(F.col("h.matches").alias("text"), C.lines_of(F.col("h.gaps"), F.col("h.matches")).alias("line_number"))
    rows = rows.select("file_path", "content", "language", "h.rule_id", "h.rule_name", "h.severity", F.inline(placed))
    return rows.where(F.when(F.col("rule_id") == "SEC013", is_assigned(F.col("text"))).when(F.col("rule_id") == "SEC014", is_random(F.col("text"))).otherwise(True)).select("file_path", "content", "language", "rule_id", "rule_name", "severity", "line_number", "text")


def secrets(files: DataFrame) -> DataFrame:
    """Findings, one per line and rule; entropy only where the line has no other secret."""
    rows = secret_matches(files).groupBy("file_path", "line_number").agg(F.first("content").alias("content"), F.first("language").alias("language"), F.collect_set(F.struct("rule_id", "rule_name", "severity")).alias("rules"))
    others = F.filter("rules", lambda r: r["rule_id"] != "SEC014")
    rows = rows.select("file_path", "line_number", "content", "language", F.explode(F.when(F.size(others) > 0, others).otherwise(F.col("rules"))).alias("r"))
    own = {
        "rule_id": F.col("r.rule_id"), "rule_name": F.col("r.rule_name"), "severity": F.col("r.severity"), "snippet": C.snippet(F.col("content"), F.col("line_number")), "confidence": F.lit("HIGH"), "evidence": no_evidence(),
        "description": F.lit("A secret is stored in the text."), "fix": F.lit("Revoke it and read it from the environment or a secret store."),
    }
    return rows.withColumns(own).select(*COLUMNS)
