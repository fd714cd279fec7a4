"""Ordered redaction by patterns, sensitivity and licence labels, safe diagnostics: all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One pattern; rules run in order, each on the text that the earlier ones left."""

    rule_id: str
    redaction_type: str
    severity: str
    pattern: str


#: Built-in patterns, the pattern for personal data, and ranks and labels of the policy.
BUILTIN = [
    Rule("builtin-api-key-assignment", "secret", "high", r"(?i)\b(?:api[_-]?key|token|secret|password|credential)\b\s*(?:is|=|:)\s*['\"]?[^'\"\s,;]+"),
    Rule("builtin-bearer-token", "secret", "high", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"),
    Rule("builtin-private-key-block", "secret", "critical", r"(?s)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----"),
    Rule("builtin-connection-string", "secret", "high", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb|redis)://[^\s'\"<>]+"),
    Rule("builtin-cloud-access-key", "secret", "high", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
]
EMAIL = Rule("builtin-email-address", "pii", "medium", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b")
SENSITIVITY = {"unknown": 0, "public": 1, "internal": 2, "confidential": 3, "restricted": 4}
ALLOWED_LICENSES = ["MIT", "Apache-2.0"]
SAFE_STATUSES = ["redacted", "redaction_checked"]

#: Stands for the colon inside a marker while rules run, so that no later rule can match within one.
_SHIELD = "\ue000"


def redact(df: DataFrame, text: str = "text", sensitivity: str | None = None, rules: list[Rule] | None = None, pii: Rule | None = EMAIL) -> DataFrame:
    """Add sanitized_text, findings and redaction_status.

    A rule that matches takes the next number of its type, and all its matches become
    ``[REDACTED:TYPE:number]``. The rule for personal data runs, last of the built-in ones, only on rows
    whose ``sensitivity`` column says confidential or restricted. ``rules`` are further, configured rules.
    Findings hold rule_id, redaction_type, marker, count and severity, never the matched text. A null
    text stays null without findings. The steps are separate projections, so each pattern runs once.
    """
    steps: list[tuple[Rule, Column | None]] = [(r, None) for r in BUILTIN]
    if pii is not None and sensitivity is not None:
        steps.append((pii, F.coalesce(F.col(sensitivity).isin("confidential", "restricted"), F.lit(False))))
    steps += [(r, None) for r in rules or []]
    df = df.withColumn("sanitized_text", F.col(text))
    sequence: dict[str, Column] = {}
    found = []
    for i, (rule, when) in enumerate(steps):
        n = F.regexp_count("sanitized_text", F.lit(rule.pattern))
        df = df.withColumn(f"_n{i}", F.coalesce(n if when is None else F.when(when, n).otherwise(0), F.lit(0)))
        hit = F.col(f"_n{i}") > 0
        number = sequence.get(rule.redaction_type, F.lit(0)) + hit.cast("int")
        df = df.withColumn(f"_s{i}", number)
        sequence[rule.redaction_type] = F.col(f"_s{i}")
        kind = rule.redaction_type.upper()
        marker = F.concat(F.lit(f"[REDACTED{_SHIELD}{kind}{_SHIELD}"), F.col(f"_s{i}").cast("string"), F.lit("]"))
        df = df.withColumn(
            "sanitized_text",
            F.when(hit, F.regexp_replace(F.col("sanitized_text"), F.lit(rule.pattern), marker)).otherwise(F.col("sanitized_text")),
        )
        found.append(
            F.when(
                hit,
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.lit(rule.redaction_type).alias("redaction_type"),
                    F.concat(F.lit(f"[REDACTED:{kind}:"), F.col(f"_s{i}").cast("string"), F.lit("]")).alias("marker"),
                    F.col(f"_n{i}").alias("count"),
                    F.lit(rule.severity).alias("severity"),
                ),
            )
        )
    df = df.withColumn("findings", F.filter(F.array(*found), lambda x: x.isNotNull()))
    # a generator ends the chain: a later filter on the text is not pushed into it, which would repeat every step
    kept = [c for c in df.columns if c not in ("sanitized_text", "findings")]
    done = F.struct(F.translate("sanitized_text", _SHIELD, ":").alias("sanitized_text"), F.col("findings"))
    df = df.select(*kept, F.inline(F.array(done)))
    df = df.withColumn("redaction_status", F.when(F.size("findings") > 0, "redacted").otherwise("redaction_checked"))
    return df.drop(*[f"_{c}{i}" for c in "ns" for i in range(len(steps))])


def raise_sensitivity(current: Column, findings: Column) -> Column:
    """The highest class that findings imply: secret restricted, pii confidential; never lower than before."""
    rank = F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv])
    now = F.coalesce(rank[current], F.lit(0))
    has = lambda kind: F.exists(findings, lambda f: f["redaction_type"] == kind)
    implied = F.when(has("secret"), 4).when(has("pii"), 3).otherwise(0)
    return F.when(implied > now, F.when(implied == 4, "restricted").otherwise("confidential")).otherwise(F.coalesce(current, F.lit("unknown")))


def safe_text(value: Column) -> Column:
    """Bounded text for diagnostics: no control characters, no named secrets, single spaces, 255 characters, never empty."""
    names = r"(?i)\b(token|secret|password|credential|api[_-]?key)\b"
    s = F.regexp_replace(value, "[\\p{C}\\p{Zl}\\p{Zp}\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]", " ")
    s = F.regexp_replace(s, names + r"(?:\s*(?:is|=|:)\s*|\s+)\S+", "[redacted]")
    s = F.regexp_replace(s, names, "[redacted]")
    s = F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, 255)
    return F.when(s == "", "[empty]").otherwise(s)


def classify_license(df: DataFrame, text: str, configured: str) -> DataFrame:
    """Add license_id, license_confidence, copyright_notice and license_policy_status from licence lines of a text."""
    found = F.substring(F.regexp_extract(F.col(text), r"(?im)^\s*(?:SPDX-License-Identifier|License)\s*:\s*([A-Za-z0-9.()+-]+)", 1), 1, 100)
    notice = F.regexp_extract(F.col(text), r"(?im)^\s*(copyright\b.{0,180})", 1)
    df = df.withColumn("license_id", F.when(found != "", found))
    return df.withColumns(
        {
            "license_confidence": F.when(F.col("license_id").isNotNull(), F.lit(0.95)),
            "copyright_notice": F.when(notice != "", safe_text(notice)),
            "license_policy_status": F.when(F.col("license_id").isin(ALLOWED_LICENSES), "allowed")
            .when(F.col("license_id").isNotNull(), "review_required")
            .otherwise(F.coalesce(F.col(configured), F.lit("unknown"))),
        }
    )


def require_redacted(df: DataFrame, status: str = "redaction_status") -> DataFrame:
    """The frame unchanged; evaluating it fails on any row that did not pass redaction."""
    ok = F.coalesce(F.col(status).isin(SAFE_STATUSES), F.lit(False))
    return df.withColumn(status, F.when(ok, F.col(status)).otherwise(F.raise_error(F.lit("row must pass redaction before it is stored"))))


def redaction_summary(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group: rows, findings, candidate counts by type as a map, and the distinct statuses sorted."""
    per = df.groupBy(*group, "candidate_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("findings")).alias("f"), F.collect_set("redaction_status").alias("s")
    )
    return per.groupBy(*group).agg(
        F.sum("n").alias("candidate_count"),
        F.sum("f").alias("redaction_events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("candidate_type", "n")))).alias("candidate_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("redaction_statuses"),
    )
