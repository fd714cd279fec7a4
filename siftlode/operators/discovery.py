"""Which artifacts of a source are wanted, and what they are: rules over paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language by suffix, directory names and endings of tool output and third-party code, types and roles.
LANGUAGES = {
    "c": "c", "cc": "c++", "cpp": "c++", "css": "css", "go": "go", "html": "html", "htm": "html", "java": "java", "js": "javascript",
    "json": "json", "md": "markdown", "markdown": "markdown", "mdx": "mdx", "py": "python", "rs": "rust", "sh": "shell",
    "toml": "toml", "ts": "typescript", "txt": "text", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
VENDORED = ["node_modules", "vendor", "vendors", "third_party", "third-party", "external", "deps"]
GENERATED = ["generated", "gen", "dist", "build", "coverage"]
GENERATED_ENDS = [".generated.py", ".generated.ts", ".generated.js", ".pb.go", ".pb.py", ".pb.cc", ".min.js", ".min.css"]
DOCUMENT_SUFFIXES = ["md", "markdown", "mdx", "html", "htm", "txt"]
STRUCTURED_SUFFIXES = ["json", "yaml", "yml", "toml", "xml"]
CODE_SUFFIXES = ["py", "js", "ts", "go", "rs", "java", "sh", "c", "cpp"]
CODE_LANGUAGES = ["python", "javascript", "typescript", "go", "rust", "java", "c", "c++"]
PROSE_LANGUAGES = ["markdown", "mdx", "html", "text"]


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern whose ``*`` crosses slashes.

    A leading ``**/`` may also match nothing, so ``**/x.md`` takes ``x.md`` too.
    """

    def body(p: str) -> str:
        out, i = "", 0
        while i < len(p):
            c = p[i]
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif c == "[" and (end := p.find("]", i + 2)) > 0:
                inside = p[i + 1 : end].replace("\\", "\\\\")
                out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
                i = end
            else:
                out += re.escape(c)
            i += 1
        return out

    p = pattern.replace("\\", "/")
    forms = [body(p)] + ([body(p[3:])] if p.startswith("**/") else [])
    return "(?s)^(?:" + "|".join(forms) + ")$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the patterns; no pattern matches nothing."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p))
    return hit


def first_match(path: Column, patterns: list[str]) -> Column:
    """The first pattern that matches, or null."""
    return F.coalesce(*[F.when(path.rlike(glob_regex(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def relative_path(path: Column) -> Column:
    """The path with forward slashes, or an error for one that is absolute, empty or climbs up."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    p = F.regexp_replace(p, "/$", "")
    bad = (p == "") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | (p == ".")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a relative path: "), path))).otherwise(F.regexp_replace(p, r"(^|/)(\./)+", "$1"))


def suffix_of(path: Column) -> Column:
    """The last suffix of the file name in lower case without dot; a leading dot is no suffix."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1)


def classify_paths(df: DataFrame, path: str = "path", mime: str | None = None) -> DataFrame:
    """Add language, generated, vendored, artifact_type and artifact_role from the path; a text ``mime`` type makes a document of other suffixes."""
    p = F.col(path)
    low = F.lower(p)
    name = F.element_at(F.split(low, "/"), -1)
    parts = F.split(low, "/")
    sfx = suffix_of(p)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    ends = F.lit(False)
    for e in GENERATED_ENDS:
        ends = ends | low.endswith(e)
    generated = (
        F.arrays_overlap(parts, F.array(*map(F.lit, GENERATED))) | ends | name.rlike(r"(^|[-_.])generated([-_.]|$)")
    )
    df = df.withColumns(
        {
            "language": F.when(sfx != "", table[sfx]),
            "generated": generated,
            "vendored": F.arrays_overlap(parts, F.array(*map(F.lit, VENDORED))),
            "artifact_type": F.when(sfx.isin(DOCUMENT_SUFFIXES), "document")
            .when(sfx.isin(STRUCTURED_SUFFIXES), "structured_data")
            .when(sfx.isin(CODE_SUFFIXES), "source_code")
            .when(F.col(mime).startswith("text/") if mime else F.lit(False), "document")
            .otherwise("file"),
        }
    )
    role = (
        F.when(name.startswith("license") | name.isin("copying", "notice"), "license")
        .when(name.startswith("changelog") | name.isin("changes.md", "history.md"), "changelog")
        .when(F.array_contains(parts, "test") | name.startswith("test_"), "test")
        .when(low.contains("example"), "example")
        .when(low.contains("openapi"), "openapi_spec")
        .when((sfx == "json") & low.contains("schema"), "json_schema")
        .when(F.col("language").isin(CODE_LANGUAGES), "source_code")
        .when(F.col("language").isin(PROSE_LANGUAGES), "documentation")
        .when(sfx.isin(STRUCTURED_SUFFIXES), "schema")
        .otherwise("unknown")
    )
    return df.withColumn("artifact_role", role)


def preferred_family(role: Column) -> Column:
    """The family of extractors that a role is read with, or null."""
    return (
        F.when(role.isin("documentation", "changelog", "license", "example"), "docs")
        .when(role == "source_code", "code")
        .when(role == "openapi_spec", "api_specs")
        .when(role.isin("schema", "json_schema"), "schemas")
    )


def select_profile(df: DataFrame, profiles: list[dict], explicit: str = "extractor_profile", path: str = "path") -> DataFrame:
    """Add ``profile``: the first enabled profile of the preferred family that matches, else the first enabled match, else the explicit one.

    ``profiles``: dicts with profile_id, family, file_patterns and enabled, in order of preference.
    """
    on = [p for p in profiles if p.get("enabled", True)]
    fam = preferred_family(F.col("artifact_role"))
    preferred = [F.when((fam == p["family"]) & matches_any(F.col(path), p["file_patterns"]), p["profile_id"]) for p in on]
    anyway = [F.when(matches_any(F.col(path), p["file_patterns"]), p["profile_id"]) for p in on]
    return df.withColumn("profile", F.coalesce(*preferred, *anyway, F.col(explicit)))


def skip_reasons(
    df: DataFrame,
    include: list[str],
    exclude: list[str],
    override_exclude: list[str] | None = None,
    override_reason: str | None = None,
    allow_generated: bool = False,
    allow_vendored: bool = False,
    path: str = "path",
) -> DataFrame:
    """Add skip_reason (null = wanted), skip_pattern and override_reason; the first reason that holds counts.

    An exclusion is lifted only where an override pattern matches and a reason for overriding is given.
    """
    p = F.col(path)
    hit = first_match(p, exclude) if exclude else F.lit(None).cast("string")
    lifted = hit.isNotNull() & matches_any(p, override_exclude or []) if override_reason else F.lit(False)
    allowed = (F.col("generated") & F.lit(allow_generated)) | (F.col("vendored") & F.lit(allow_vendored))
    kind = F.when(lifted, "excluded").when(F.col("generated"), "generated").when(F.col("vendored"), "vendored").otherwise("artifact")
    override = F.when(
        allowed | lifted, F.lit(override_reason) if override_reason else F.concat(F.lit("source_or_profile_allows_"), kind)
    )
    reason = (
        F.when(hit.isNotNull() & ~lifted, "excluded_by_glob")
        .when(~matches_any(p, include) if include else F.lit(False), "not_included_by_glob")
        .when(F.col("generated") & F.col("override_reason").isNull(), "generated_file")
        .when(F.col("vendored") & F.col("override_reason").isNull(), "vendored_file")
    )
    df = df.withColumn("override_reason", override).withColumn("skip_reason", reason)
    return df.withColumn("skip_pattern", F.when(F.col("skip_reason") == "excluded_by_glob", hit))
