"""Queries over extraction, catalogs and windows of time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.operators import extract as X
from siftlode.plans.corpus import CANDIDATES, candidates
from siftlode.plans.runtime import load, own_folder, parallelism
from siftlode.sources import config as C
from siftlode.sources.store import Store
from siftlode.streaming.increments import windowed_counts


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "artifact_files")
    return f.repartition(parallelism(spark), "file_id").groupBy("file_id").agg(F.max(F.struct("fetched_at", "path", "artifact_role", "language", "text")).alias("m")).select(
        "file_id", "m.path", "m.artifact_role", "m.language", F.col("m.text").alias("content")
    )


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return X.extract(_files(spark, d), ["file_id"])


def paragraph_extract(spark: SparkSession, d: str) -> DataFrame:
    p = X.paragraphs_native(load(spark, d, "documents").where("text is not null"), "doc_id", F.col("text"))
    return p.select("doc_id", "ordinal", "line_start", "line_end", F.md5("text").alias("digest"))


def extract_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)


def extract_summary(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).groupBy("parser", "status", "candidate_type").agg(F.count(F.lit(1)).alias("n"))


def extract_status(spark: SparkSession, d: str) -> DataFrame:
    """How many files each parser took, and how it went."""
    return _extracted(spark, d).groupBy("parser", "status").agg(F.count_distinct("file_id").alias("files"))


def json_tree_walk(spark: SparkSession, d: str) -> DataFrame:
    e = _extracted(spark, d).where("parser = 'json' and candidate_type = 'scalar'")
    return e.select("file_id", F.array_join("key_path", ".").alias("key"), "text")


def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    e = _extracted(spark, d).where("parser = 'markdown' and candidate_type = 'heading'")
    return e.groupBy("file_id").agg(F.count(F.lit(1)).alias("headings"))


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    e = _extracted(spark, d).where("parser = 'python' and candidate_type = 'symbol'")
    return e.select("file_id", F.array_join("symbol_path", ".").alias("symbol"), "signature_text", "line_start", "line_end")


def python_symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _extracted(spark, d).where("parser = 'python' and candidate_type = 'symbol'")
    name = F.element_at("symbol_path", -1)
    return e.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("signature_text").startswith("class ")).alias("classes"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


def store_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds on a stored table: all documents, corrections of every third with its first sight kept, and appended rows."""
    s = Store(spark, f"{own_folder(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size"), F.lit(1).alias("seen"))
    s.upsert("docs", docs, ["doc_id"])
    s.upsert("docs", docs.where("doc_id % 3 = 0").withColumns({"size": F.col("size") + 1, "seen": F.lit(2)}), ["doc_id"], keep=["seen"])
    s.append("docs", docs.where("doc_id % 5 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "size", F.lit(3).alias("seen")))
    return s.read("docs")


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Texts of candidates that hold HTML, read as pages."""
    c = candidates(spark, d).where("candidate_type in ('section', 'paragraph') and text rlike '(?i)<(p|h[1-6]|pre)[ >]'")
    pages = c.select("candidate_id", F.lit("page.html").alias("path"), F.lit("documentation").alias("artifact_role"), F.lit("html").alias("language"), F.col("text").alias("content"))
    return X.extract(pages, ["candidate_id"]).select("candidate_id", "ordinal", "candidate_type", "text", F.array_join("heading_path", " > ").alias("heading_path"))


def html_heading_counts(spark: SparkSession, d: str) -> DataFrame:
    return html_sections(spark, d).where("candidate_type = 'heading'").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("headings"))


def safe_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = X.safe_metadata(candidates(spark, d))
    return m.select("candidate_id", "candidate_type", "text_hash", "signature_hash")


def source_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog operator over the fixed table of sources, read as configuration."""
    return C.source_catalog(spark, [r.asDict() for r in load(spark, d, "sources").collect()])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(load(spark, d, "events"), "6 hours")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

ORACLE = {
    "paragraph_extract": r"""with l as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) as n from documents where text is not null),
b as (select *, not regexp_matches(line, '[^\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x0b]') as blank from l), r as (select *, sum(blank::int) over (partition by doc_id order by n) as run from b),
p as (select doc_id, run, min(n) as s, max(n) as e, string_agg(line, chr(10) order by n) as t from r where not blank group by 1, 2)
select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as ordinal, s::int as line_start, e::int as line_end, md5(t) as digest from p""",
    "extract_status": r"""with f as (select file_id, max((fetched_at, path, artifact_role, language)) as m from artifact_files group by 1),
s as (select m[3] as role, m[4] as language, regexp_extract(lower(split(m[2], '/')[-1]), '^.+\.([^.]+)$', 1) as sfx from f),
p as (select case when role in ('source', 'source_code') then case when language = 'python' or sfx = 'py' then 'python' else 'none' end
  when sfx in ('md', 'mdx') then 'markdown' when sfx in ('html', 'htm') then 'html' when sfx in ('yaml', 'yml') then 'yaml' when sfx in ('json', 'toml') then sfx else 'text' end as parser from s)
select parser, case parser when 'none' then 'skipped' else 'completed' end as status, count(*) as files from p group by 1, 2""",
    "json_tree_walk": """with f as (select distinct file_id, path, text from artifact_files where artifact_role not in ('source', 'source_code') and path like '%.json'),
a as (select file_id, json(text) as j from f), k as (select file_id, j, unnest(json_keys(j)) as k from a), v as (select file_id, k, json_extract(j, '$."' || k || '"') as v from k)
select file_id, k as key, json_extract_string(v, '$') as text from v where json_type(v) <> 'OBJECT'
 union all select file_id, k || '.' || kk, json_extract_string(v, '$."' || kk || '"') from (select *, unnest(json_keys(v)) as kk from v where json_type(v) = 'OBJECT')""",
    "markdown_headings": r"""with f as (select distinct file_id, text from artifact_files where artifact_role not in ('source') and (path like '%.md' or path like '%.MD')), l as (select file_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line from f)
select file_id, count(*) as headings from l where regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)') or regexp_matches(line, '^=+[ \t]*$') group by 1""",
    "safe_metadata": """select distinct candidate_id, candidate_type, 'sha256:' || sha256(text) as text_hash, 'sha256:' || sha256(signature_text) as signature_hash from (select *, row_number() over (partition by candidate_id order by extracted_at desc) as rn from extraction_candidates) where rn = 1""",
    "html_heading_counts": f"""with {CANDIDATES}, h as (select candidate_id, len(regexp_extract_all(text, '(?i)<h[1-6][ >\\n]')) as headings from cand
  where candidate_type in ('section', 'paragraph') and regexp_matches(text, '(?i)<(p|h[1-6]|pre)[ >]')) select * from h where headings > 0""",
    "python_symbol_counts": r"""with f as (select file_id, max((fetched_at, text)) as m from artifact_files where artifact_role = 'source' and (language = 'python' or lower(path) like '%.py') group by 1),
l as (select file_id, unnest(string_split(regexp_replace(m[2], '\r\n?', chr(10), 'g'), chr(10))) as line from f), s as (select file_id, regexp_extract(line, '^\s*(?:async\s+)?(def|class)\s+(\w+)', 1) as kind, regexp_extract(line, '^\s*(?:async\s+)?(def|class)\s+(\w+)', 2) as name from l)
select file_id, count(*) as symbols, count(*) filter (kind = 'class') as classes, min(name) as first_name, max(name) as last_name from s where kind <> '' group by 1""",
    "store_rounds": """select doc_id, coalesce(n_chars, 0) + (doc_id % 3 = 0)::int as size, 1 as seen from documents
 union all select -doc_id - 1, coalesce(n_chars, 0), 3 from documents where doc_id % 5 = 0""",
    "source_catalog": """select source_id, source_type, null::varchar[] as tracked_refs, null::varchar as version_strategy, extractor_profile, source_priority, visibility_label, corpus_eligibility,
  sensitivity_class, license_policy, null::varchar as refresh_cadence, enabled from sources""",
    "event_windows": "select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n from events group by 1, 2",
}
