"""Queries over identifiers, discovery, redaction, chunking and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions import identity as I
from siftlode.functions.paths import plain_checksum, plain_path
from siftlode.operators import chunking as C
from siftlode.operators import discovery as D
from siftlode.operators import incremental as N
from siftlode.operators import redaction as R
from siftlode.operators.ranking import has_wide_group
from siftlode.operators.snapshots import file_counts, snapshot_sequence
from siftlode.plans.corpus import CANDIDATES, CHUNKS, candidates, chunks
from siftlode.plans.runtime import load, stored, widen

#: Fixed value: namespace of the evidence identifiers used here.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    h = F.col("sanitized_content_hash")
    key = I.chunk_key(F.col("source_id"), F.col("artifact_path"), h, F.lit("docs"), F.array(F.lit("document"), F.col("artifact_role")), F.lit(0))
    return c.select(
        "doc_id", h.alias("content_hash"), key.alias("chunk_key"), I.citation_key(key).alias("citation_key"),
        I.artifact_id(F.col("source_id"), F.col("artifact_path")).alias("artifact_id"),
        I.source_version_id(F.col("source_id"), F.sha2(F.coalesce("version_label", F.lit("")), 256)).alias("source_version_id"),
        I.embedding_id(F.col("chunk_id"), F.lit("m"), F.lit("i"), h).alias("embedding_id"), I.uuid5(NAMESPACE, key).alias("evidence_uuid"),
    )


def combined_extraction_hash(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).where("text is not null")
    return c.groupBy("root_identifier", "artifact_path").agg(I.combined_hash(F.col("candidate_id"), I.content_hash(F.col("text"))).alias("combined_hash"))


def git_version_labels(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "source_snapshots").where("commit_sha is not null").dropDuplicates(["snapshot_id"])
    kind = F.when(F.col("tag").isNotNull(), "tag").when(F.col("branch").isNotNull(), "branch").otherwise("commit")
    ref = F.coalesce(F.concat(F.lit("refs/tags/"), F.col("tag")), F.concat(F.lit("refs/heads/"), F.col("branch")), F.col("commit_sha"))
    return s.select("snapshot_id", I.git_version_label(kind, ref, F.col("commit_sha")).alias("label"))


def discovery_classify(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "artifact_files").select("file_id", "path").distinct()
    return D.classify_paths(a)


def discovery_skip(spark: SparkSession, d: str) -> DataFrame:
    a = D.classify_paths(load(spark, d, "artifact_files").select("file_id", "path").distinct())
    return D.skip_reasons(a, ["src/**", "**/*.py", "**/*.md", "docs/*", "vendor/**"], ["**/*_test.py", "tools/**"], ["tools/keep*"], "kept on purpose").select(
        "file_id", "skip_reason", "skip_pattern", "override_reason"
    )


def discovery_profile(spark: SparkSession, d: str) -> DataFrame:
    a = D.classify_paths(load(spark, d, "artifact_files").select("file_id", "path", "extractor_profile").distinct())
    profiles = [
        {"profile_id": "docs", "family": "docs", "file_patterns": ["**/*.md", "**/*.txt", "LICEN*"]},
        {"profile_id": "web", "family": "code", "file_patterns": ["**/*.js", "**/*.ts"]},
        {"profile_id": "code", "family": "code", "file_patterns": ["**/*.py", "**/*.go", "**/*.rs", "**/*.java"]},
        {"profile_id": "off", "family": "schemas", "file_patterns": ["**"], "enabled": False},
        {"profile_id": "data", "family": "schemas", "file_patterns": ["**/*.toml", "**/*.json"]},
    ]
    return D.select_profile(a, profiles).select("file_id", "profile")


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "artifact_candidates").select("logical_locator").distinct()
    plain = plain_path(F.col("logical_locator"))
    return a.select("logical_locator", plain.alias("path"), D.suffix_of(plain).alias("suffix"))


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    return R.redact(candidates(spark, d), "text", "sensitivity_class")


def redact_ordered(spark: SparkSession, d: str) -> DataFrame:
    r = _redacted(spark, d)
    return r.select(
        "candidate_id", "sanitized_text", "redaction_status",
        F.array_join(F.transform("findings", lambda f: F.concat_ws("=", f["rule_id"], f["marker"], f["count"].cast("string"))), "|").alias("findings"),
    )


def sensitivity_raise(spark: SparkSession, d: str) -> DataFrame:
    r = _redacted(spark, d).withColumn("raised", R.raise_sensitivity(F.col("sensitivity_class"), F.col("findings")))
    return r.groupBy("sensitivity_class", "raised").agg(F.count(F.lit(1)).alias("n"))


def license_classify(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "artifact_files").select("file_id", "text", "license_policy_label").dropDuplicates(["file_id"])
    return R.classify_license(f, "text", "license_policy_label").select("file_id", "license_id", "license_confidence", "copyright_notice", "license_policy_status")


def diagnostic_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).where("text is not null").select("candidate_id", R.safe_text(F.col("text")).alias("safe"))


def redaction_guard(spark: SparkSession, d: str) -> DataFrame:
    return R.require_redacted(_redacted(spark, d)).groupBy("redaction_status").agg(F.count(F.lit(1)).alias("n"))


def redaction_summary(spark: SparkSession, d: str) -> DataFrame:
    s = R.redaction_summary(_redacted(spark, d), ["source_id"])
    return s.select(
        "source_id", "candidate_count", "redaction_events", F.array_join("redaction_statuses", ",").alias("statuses"),
        F.coalesce(F.col("candidate_counts")["symbol"], F.lit(0)).alias("symbols"),
    )


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_candidates(_redacted(spark, d), {"document": (400, 40), "code": (300, 30), "structured": (200, 20)})


def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    kind = C.dispatch(F.col("candidate_type"), F.col("key_path"), F.col("symbol_path"))
    return c.groupBy("candidate_type", kind.alias("chunker")).agg(F.count(F.lit(1)).alias("n"))


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").where("length(text) > 0").select("doc_id", F.posexplode(C.windows(F.col("text"), 1200, 120)).alias("ordinal", "piece"))
    return t.select("doc_id", "ordinal", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select(
        "candidate_id", "ordinal", "chunker", "chunk_kind", "heading_text", "symbol_text", "json_pointer", "dotted_key", "token_count",
        F.array_join("structure_path", "/").alias("structure"), "chunk_key",
    )


def chunk_citations(spark: SparkSession, d: str) -> DataFrame:
    c = C.citations(_chunked(spark, d), ["source_id", "line_start"])
    return c.groupBy("source_id", "redaction_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.substring("citation_key", 10, 64) == F.substring("chunk_key", 7, 64)).alias("agree")
    )


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "source_snapshots").groupBy("root_identifier", "snapshot_seq").agg(F.min("snapshot_id").alias("snapshot_id"))
    a = load(spark, d, "artifact_candidates").select("snapshot_id", "checksum", "extractor_profile", "corpus_eligibility_label", "received_at", plain_path(F.col("logical_locator")).alias("path"))
    last = F.max(F.struct("received_at", "checksum", "extractor_profile", "corpus_eligibility_label"))
    return (
        s.join(a, "snapshot_id").groupBy("root_identifier", "snapshot_seq", "path").agg(last.alias("m"))
        .select("root_identifier", "snapshot_seq", "path", "m.checksum", "m.extractor_profile", F.coalesce("m.corpus_eligibility_label", F.lit("unknown")).alias("corpus_eligibility_label"))
    )


_SNAPSHOTS = r"""raw as (select distinct logical_locator as loc from artifact_candidates),
dec as (select loc, '/' || regexp_replace(replace(url_decode(regexp_replace(trim(loc), '%([^0-9A-Fa-f]|$)', '%25\1', 'g')), '\', '/'), '/+', '/', 'g') || '/' as p from raw),
undot as (select loc, replace(replace(p, '/./', '/'), '/./', '/') as p from dec),
up as (select loc, regexp_replace(p, '/[^/]+/\.\./', '/', 'g') as p from undot),
plain as (select loc, nfc_normalize(trim(p, '/')) as path from up),
heads as (select root_identifier, snapshot_seq, min(snapshot_id) as snapshot_id from source_snapshots group by 1, 2),
snap as (select root_identifier, snapshot_seq, path, checksum, extractor_profile, coalesce(corpus_eligibility_label, 'unknown') as corpus_eligibility_label from (
   select h.root_identifier, h.snapshot_seq, p.path, a.*, row_number() over (partition by h.root_identifier, h.snapshot_seq, p.path
     order by a.received_at desc, a.checksum desc nulls last, a.extractor_profile desc nulls last, a.corpus_eligibility_label desc nulls last) as rn
   from heads h join artifact_candidates a using (snapshot_id) join plain p on p.loc = a.logical_locator) where rn = 1)"""

#: Each complete delivered snapshot's files (one), as later side (b) and as earlier side of the root's next one (a).
_DELIVERIES = _SNAPSHOTS + r""",
rec as (select a.snapshot_id, p.path, a.received_at, a.extractor_profile, a.corpus_eligibility_label,
   nullif(regexp_replace(lower(regexp_replace(a.checksum, '\s+', '', 'g')), '^[a-z0-9]{2,12}[:=-]', ''), '') as checksum
   from artifact_candidates a join plain p on p.loc = a.logical_locator),
n as (select snapshot_id, count(distinct path) as n from rec group by 1),
h as (select root_identifier, snapshot_seq, min(s.snapshot_id) as snapshot_id from source_snapshots s left join n using (snapshot_id)
   where coalesce(n.n, 0) >= coalesce(s.artifact_count, 0) group by 1, 2),
sq as (select *, lead(snapshot_seq) over (partition by root_identifier order by snapshot_seq) as nxt from h),
one as (select root_identifier, snapshot_seq, nxt, path, checksum, extractor_profile, coalesce(corpus_eligibility_label, 'unknown') as label, 1 as here from (
   select q.root_identifier, q.snapshot_seq, q.nxt, r.*, row_number() over (partition by r.snapshot_id, r.path
     order by r.received_at desc, r.checksum desc nulls last, r.extractor_profile desc nulls last, r.corpus_eligibility_label desc nulls last) as rn
   from sq q join rec r using (snapshot_id)) where rn = 1),
b as (select * from one),
a as (select * replace (nxt as snapshot_seq) from one where nxt is not null),
plan as (select root_identifier, snapshot_seq, path, b.checksum as checksum, a.checksum as previous_checksum,
   case when a.here is null then 'added' when b.here is null then 'tombstoned'
     when a.checksum is not distinct from b.checksum and a.extractor_profile is not distinct from b.extractor_profile and a.label = b.label then 'unchanged' else 'changed' end as status
   from a full join b using (root_identifier, snapshot_seq, path))"""


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The files of every complete delivered snapshot, with its number and the root's next one (next_seq, null for the last).

    Of several rows for a file the last received holds; locators and checksums have their plain spelling.
    """
    heads = load(spark, d, "source_snapshots").select(
        "snapshot_id", F.col("root_identifier").alias("root"), F.col("snapshot_seq").alias("seq"), F.col("artifact_count").alias("expected")
    )
    raw = load(spark, d, "artifact_candidates").where("snapshot_id is not null")
    # spelled once; the counts read two columns of it
    a = stored(widen(raw.select("snapshot_id", "checksum", "extractor_profile", "corpus_eligibility_label", "received_at", "logical_locator")).select(
        "snapshot_id", plain_checksum(F.col("checksum")).alias("checksum"), "extractor_profile", "corpus_eligibility_label", "received_at",
        plain_path(F.col("logical_locator")).alias("path"),
    ).where("path is not null"))
    sequence = snapshot_sequence(heads, file_counts(a.withColumnRenamed("path", "key")), has_wide_group(heads, "root"))
    last = F.max(F.struct("received_at", "checksum", "extractor_profile", "corpus_eligibility_label"))
    # by file, as the plans need it: the last rows and both neighbours of a file then take no further shuffle
    placed = a.join(sequence, "snapshot_id").repartition("root", "path")
    return placed.groupBy("root", "path", "seq", "next_seq").agg(last.alias("m")).select(
        F.col("root").alias("root_identifier"), F.col("seq").alias("snapshot_seq"), "next_seq", "path", "m.checksum", "m.extractor_profile",
        F.coalesce("m.corpus_eligibility_label", F.lit("unknown")).alias("corpus_eligibility_label"),
    )


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return N.plan_sequence(_deliveries(spark, d), ["root_identifier", "path"], ["checksum", "extractor_profile", "corpus_eligibility_label"])


def snapshot_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("root_identifier", "snapshot_seq", "path", "status", "checksum", "previous_checksum")


def ingestion_counters(spark: SparkSession, d: str) -> DataFrame:
    return N.plan_counts(_plan(spark, d), ["root_identifier", "snapshot_seq"])


def tombstone_absent(spark: SparkSession, d: str) -> DataFrame:
    t = N.tombstone_sequence(_deliveries(spark, d), ["root_identifier", "path"], "absent_from_snapshot")
    return t.select("root_identifier", "snapshot_seq", "path", "is_current", "tombstone_reason")


def current_version_flip(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "source_snapshots").select("snapshot_id", "root_identifier", "snapshot_seq", "received_at").distinct()
    return N.flip_current(s, ["root_identifier"], [F.col("snapshot_seq"), F.col("received_at"), F.col("snapshot_id")]).select("snapshot_id", "root_identifier", "is_current")


def version_containment(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshots(spark, d).withColumn("label", F.concat(F.lit("s"), F.col("snapshot_seq").cast("string")))
    return N.containment(s, ["root_identifier", "path"], "label", [F.col("snapshot_seq")], ~F.col("root_identifier").startswith("repos/"))


def run_status(spark: SparkSession, d: str) -> DataFrame:
    runs = load(spark, d, "source_snapshots").select(F.col("snapshot_id").alias("id"), "source_id", F.col("received_at").alias("started_at"), "artifact_count").distinct()
    return N.run_status(runs, source_id="src-lantern-core", limit=100)


def snapshot_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return N.latest_deliveries(load(spark, d, "source_snapshots")).select("snapshot_id", "ordinal")


_NAMES = {
    k: v
    for k, v in globals().items()
    if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")
}
QUERIES = dict(_NAMES)

_ROLE = """case when name like 'license%' or name in ('copying', 'notice') then 'license'
  when name like 'changelog%' or name in ('changes.md', 'history.md') then 'changelog'
  when list_contains(parts, 'test') or starts_with(name, 'test_') then 'test'
  when low like '%example%' then 'example' when low like '%openapi%' then 'openapi_spec'
  when sfx = 'json' and low like '%schema%' then 'json_schema'
  when language in ('python','javascript','typescript','go','rust','java','c','c++') then 'source_code'
  when language in ('markdown','mdx','html','text') then 'documentation'
  when sfx in ('json','yaml','yml','toml','xml') then 'schema' else 'unknown' end"""
_LANG = "case sfx " + " ".join(f"when '{k}' then '{v}'" for k, v in D.LANGUAGES.items()) + " end"
_CLASSIFIED = f"""p as (select distinct file_id, path, extractor_profile, lower(path) as low, split(lower(path), '/') as parts, split(lower(path), '/')[-1] as name,
    regexp_extract(split(lower(path), '/')[-1], '^.+\\.([^.]+)$', 1) as sfx from artifact_files),
l as (select *, {_LANG} as language from p),
k as (select *, list_has_any(parts, ['generated','gen','dist','build','coverage'])
    or regexp_matches(low, '(\\.generated\\.(py|ts|js)|\\.pb\\.(go|py|cc)|\\.min\\.(js|css))$') or regexp_matches(name, '(^|[-_.])generated([-_.]|$)') as generated,
  list_has_any(parts, ['node_modules','vendor','vendors','third_party','third-party','external','deps']) as vendored,
  case when sfx in ('md','markdown','mdx','html','htm','txt') then 'document' when sfx in ('json','yaml','yml','toml','xml') then 'structured_data'
    when sfx in ('py','js','ts','go','rs','java','sh','c','cpp') then 'source_code' else 'file' end as artifact_type, {_ROLE} as artifact_role from l)"""


def _redaction_sql() -> str:
    """The ordered rules as a chain of selects."""
    out, rules = [f"with {CANDIDATES}, t0 as (select *, text as t, 0 as q_secret, 0 as q_pii, [] ::varchar[] as f from cand)"], [*R.BUILTIN, R.EMAIL]
    for i, r in enumerate(rules):
        pat = r.pattern.replace("'", "''")
        when = "coalesce(sensitivity_class in ('confidential', 'restricted'), false)" if r is R.EMAIL else "true"
        q, up = f"q_{r.redaction_type}", r.redaction_type.upper()
        cols = "* exclude (t, n, q_secret, q_pii, f)"
        seq = f"{q} + (n > 0)::int"
        other = "q_pii" if q == "q_secret" else "q_secret"
        out.append(f", n{i} as (select *, case when {when} then coalesce(len(regexp_extract_all(t, '{pat}')), 0) else 0 end as n from t{i})")
        out.append(
            f", t{i + 1} as (select {cols}, case when n > 0 then regexp_replace(t, '{pat}', '[REDACTED:{up}:' || ({seq}) || ']', 'g') else t end as t,"
            f" {seq} as {q}, {other}, case when n > 0 then list_append(f, '{r.rule_id}=[REDACTED:{up}:' || ({seq}) || ']=' || n) else f end as f from n{i})"
        )
    return "".join(out) + f", red as (select *, case when len(f) > 0 then 'redacted' else 'redaction_checked' end as redaction_status from t{len(rules)})"


_RED = _redaction_sql()
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "identity_keys": f"""with {CHUNKS}, k as (select *, 'chunk:' || sha256(concat_ws(chr(31), source_id, coalesce(artifact_path, ''), sanitized_content_hash, 'docs', 'document/' || artifact_role, '0')) as ck from chunks),
u as (select *, sha1(unhex('{NAMESPACE}') || ck::blob) as s from k)
select doc_id, sanitized_content_hash as content_hash, ck as chunk_key, 'citation:' || substr(ck, 7) as citation_key,
  'artifact:' || source_id || ':' || substr(sha256(artifact_path), 1, 32) as artifact_id,
  'source-version:' || source_id || ':' || substr(sha256(coalesce(version_label, '')), 1, 16) as source_version_id,
  'embedding:' || sha256(concat_ws(chr(31), chunk_id, 'm', 'i', sanitized_content_hash)) as embedding_id,
  substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) as evidence_uuid
from u""",
    "combined_extraction_hash": f"""with {CANDIDATES} select root_identifier, artifact_path, sha256(string_agg('sha256:' || sha256(text), chr(10) order by candidate_id)) as combined_hash
from cand where text is not null group by 1, 2""",
    "git_version_labels": """select distinct snapshot_id, case when tag is not null then 'tag' when branch is not null then 'branch' else 'commit' end || ':' || coalesce(tag, branch, commit_sha) || '@' || substr(commit_sha, 1, 12) as label
from source_snapshots where commit_sha is not null""",
    "discovery_classify": f"with {_CLASSIFIED} select distinct file_id, path, language, generated, vendored, artifact_type, artifact_role from k",
    "discovery_skip": f"""with {_CLASSIFIED}, e as (select distinct file_id, path, generated, vendored, case when regexp_matches(path, '^(.*/.*_test\\.py|.*_test\\.py)$') then '**/*_test.py' when regexp_matches(path, '^tools/.*') then 'tools/**' end as hit,
  regexp_matches(path, '^(src/.*|.*\\.py|.*\\.md|docs/.*|vendor/.*)$') as inc from k),
o as (select *, hit is not null and regexp_matches(path, '^tools/keep') as lifted from e), r as (select *, case when lifted then 'kept on purpose' end as override_reason from o),
s as (select *, case when hit is not null and not lifted then 'excluded_by_glob' when not inc then 'not_included_by_glob'
  when generated and override_reason is null then 'generated_file' when vendored and override_reason is null then 'vendored_file' end as skip_reason from r)
select file_id, skip_reason, case when skip_reason = 'excluded_by_glob' then hit end as skip_pattern, override_reason from s""",
    "discovery_profile": f"""with {_CLASSIFIED}, m as (select distinct file_id, extractor_profile,
  case when artifact_role in ('documentation','changelog','license','example') then 'docs' when artifact_role = 'source_code' then 'code' when artifact_role = 'openapi_spec' then 'api_specs' when artifact_role in ('schema','json_schema') then 'schemas' end as fam,
  regexp_matches(path, '^(.*\\.md|.*\\.txt|LICEN.*)$') as a, regexp_matches(path, '^(.*\\.js|.*\\.ts)$') as b, regexp_matches(path, '^.*\\.(py|go|rs|java)$') as c, regexp_matches(path, '^.*\\.(toml|json)$') as dd from k)
select file_id, coalesce(case when fam = 'docs' and a then 'docs' when fam = 'code' and b then 'web' when fam = 'code' and c then 'code' when fam = 'schemas' and dd then 'data' end,
  case when a then 'docs' when b then 'web' when c then 'code' when dd then 'data' end, extractor_profile) as profile from m""",
    "path_normalize": f"with {_SNAPSHOTS} select loc as logical_locator, path, regexp_extract(split(lower(path), '/')[-1], '^.+\\.([^.]+)$', 1) as suffix from plain",
    "redact_ordered": _RED + " select candidate_id, t as sanitized_text, redaction_status, array_to_string(f, '|') as findings from red",
    "sensitivity_raise": _RED
    + """, x as (select sensitivity_class, case when len(list_filter(f, lambda y: contains(y, ':SECRET:'))) > 0 and coalesce(sensitivity_class, 'unknown') <> 'restricted' then 'restricted'
  when len(f) > 0 and coalesce(sensitivity_class, 'unknown') in ('unknown', 'public', 'internal') then 'confidential' else coalesce(sensitivity_class, 'unknown') end as raised from red)
select sensitivity_class, raised, count(*) as n from x group by 1, 2""",
    "redaction_guard": _RED + " select redaction_status, count(*) as n from red group by 1",
    "redaction_summary": _RED
    + """ select source_id, count(*) as candidate_count, sum(len(f))::bigint as redaction_events, string_agg(distinct redaction_status, ',' order by redaction_status) as statuses,
 count(*) filter (candidate_type = 'symbol') as symbols from red group by 1""",
    "license_classify": r"""with one as (select distinct file_id, text, license_policy_label from artifact_files),
x as (select *, nullif(substr(regexp_extract(text, '(?im)^\s*(?:SPDX-License-Identifier|License)\s*:\s*([A-Za-z0-9.()+-]+)', 1), 1, 100), '') as license_id,
  nullif(regexp_extract(text, '(?im)^\s*(copyright\b.{0,180})', 1), '') as c from one)
select file_id, license_id, case when license_id is not null then 0.95::double end as license_confidence,
  substr(trim(regexp_replace(regexp_replace(c, '[\r\n\t]', ' ', 'g'), '\s+', ' ', 'g')), 1, 255) as copyright_notice,
  case when license_id in ('MIT', 'Apache-2.0') then 'allowed' when license_id is not null then 'review_required' else coalesce(license_policy_label, 'unknown') end as license_policy_status from x""",
    "diagnostic_sanitize": rf"""with {CANDIDATES}, a as (select candidate_id, regexp_replace(text, '[\p{{C}}\p{{Zl}}\p{{Zp}}]', ' ', 'g') as s from cand where text is not null),
b as (select candidate_id, regexp_replace(regexp_replace(s, '(?i)\b(token|secret|password|credential|api[_-]?key)\b(?:\s*(?:is|=|:)\s*|\s+)\S+', '[redacted]', 'g'), '(?i)\b(token|secret|password|credential|api[_-]?key)\b', '[redacted]', 'g') as s from a)
select candidate_id, coalesce(nullif(substr(trim(regexp_replace(s, '\s+', ' ', 'g')), 1, 255), ''), '[empty]') as safe from b""",
    "chunk_dispatch": f"""with {CANDIDATES} select candidate_type, case when candidate_type in ('object','array','import') then 'none'
  when len(key_path) > 0 or candidate_type in ('scalar','endpoint','schema','schema_path') then 'structured' when len(symbol_path) > 0 or candidate_type = 'symbol' then 'code' else 'document' end as chunker, count(*) as n
from cand group by 1, 2""",
    "split_chunks": rf"""with t as (select doc_id, {_TRIM.format('text')} as t from documents where length(text) > 0),
w as (select doc_id, t, unnest(range(0, case when length(t) <= 1200 then 1 else ceil((length(t) - 1200) / 1080.0)::int + 1 end)) as i from t),
p as (select doc_id, i, {_TRIM.format('substr(t, i * 1080 + 1, 1200)')} as piece from w)
select doc_id, i::int as ordinal, length(piece)::int as chars, md5(piece) as digest from p""",
    "snapshot_plan": f"with {_DELIVERIES} select root_identifier, snapshot_seq, path, status, checksum, previous_checksum from plan",
    "ingestion_counters": f"""with {_DELIVERIES} select root_identifier, snapshot_seq, count(*) filter (status = 'added') as added_artifacts,
  count(*) filter (status = 'changed') as changed_artifacts, count(*) filter (status = 'unchanged') as unchanged_artifacts, count(*) filter (status = 'tombstoned') as tombstoned_artifacts
from plan group by 1, 2""",
    "tombstone_absent": f"""with {_DELIVERIES} select a.root_identifier, a.snapshot_seq, a.path, b.here is not null as is_current,
  case when b.here is null then 'absent_from_snapshot' end as tombstone_reason from a left join b using (root_identifier, snapshot_seq, path)""",
    "current_version_flip": """with s as (select distinct snapshot_id, root_identifier, snapshot_seq, received_at from source_snapshots)
select snapshot_id, root_identifier, row_number() over (partition by root_identifier order by snapshot_seq desc, received_at desc, snapshot_id desc) = 1 as is_current from s""",
    "version_containment": f"""with {_SNAPSHOTS} select root_identifier, path, arg_min('s' || snapshot_seq, snapshot_seq) as first_version,
 case when not starts_with(root_identifier, 'repos/') then arg_max('s' || snapshot_seq, snapshot_seq) end as last_version from snap group by 1, 2""",
    "run_status": """select distinct snapshot_id as id, source_id, received_at as started_at, artifact_count from source_snapshots where source_id = 'src-lantern-core' order by started_at desc, id limit 100""",
    "snapshot_ordinals": """with s as (select distinct snapshot_id, root_identifier, snapshot_seq, received_at from source_snapshots)
select snapshot_id, row_number() over (partition by root_identifier order by snapshot_seq, received_at, snapshot_id) as ordinal from s""",
}
_CHUNKED = (
    _RED
    + r""", d0 as (select *, case when candidate_type in ('object','array','import') then 'none' when len(key_path) > 0 or candidate_type in ('scalar','endpoint','schema','schema_path') then 'structured'
   when len(symbol_path) > 0 or candidate_type = 'symbol' then 'code' else 'document' end as chunker, regexp_replace(t, '^\s+|\s+$', '', 'g') as s from red),
d1 as (select *, case chunker when 'document' then 400 when 'code' then 300 else 200 end as size, case chunker when 'document' then 360 when 'code' then 270 else 180 end as step from d0 where chunker <> 'none' and length(s) > 0),
d2 as (select *, unnest(range(0, case when length(s) <= size then 1 else ceil((length(s) - size) / step::double)::int + 1 end)) as i from d1),
d3 as (select *, regexp_replace(substr(s, i * step + 1, size), '^\s+|\s+$', '', 'g') as piece, coalesce(heading_path, []) as hp, coalesce(key_path, []) as kp, coalesce(symbol_path, []) as sp from d2),
d4 as (select *, case chunker when 'document' then array_to_string(['document'] || hp || [candidate_type, coalesce(locator, '')], '/')
   when 'code' then array_to_string(['source_code', coalesce(language, 'unknown')] || (case when len(sp) > 0 then sp else [coalesce(locator, '')] end) || [candidate_type], '/')
   else case when len(kp) > 0 then array_to_string(['structured'] || kp || [candidate_type], '/') else array_to_string(['structured', candidate_type, coalesce(locator, '')], '/') end end as structure from d3),
d5 as (select *, 'chunk:' || sha256(concat_ws(chr(31), coalesce(source_id, ''), coalesce(locator, ''), 'sha256:' || sha256(piece), 'structure-aware', structure, i::varchar)) as chunk_key from d4)"""
)
ORACLE["structure_chunks"] = (
    _CHUNKED
    + r""" select candidate_id, i::int as ordinal, chunker, case chunker when 'document' then case when candidate_type in ('heading','section','paragraph','table','code_block') then candidate_type else 'document_block' end
   when 'code' then case when candidate_type = 'symbol' then 'source_symbol' else 'source_block' end else candidate_type end as chunk_kind,
  case when chunker = 'document' and len(hp) > 0 then array_to_string(hp, ' > ') end as heading_text, case when chunker = 'code' and len(sp) > 0 then array_to_string(sp, '.') end as symbol_text,
  case when chunker = 'structured' and len(kp) > 0 then '/' || array_to_string(list_transform(kp, lambda x: replace(replace(x, '~', '~0'), '/', '~1')), '/') end as json_pointer,
  case when chunker = 'structured' and len(kp) > 0 then array_to_string(kp, '.') end as dotted_key,
  case when length(piece) > 0 then len(regexp_split_to_array(piece, '\s+')) else 0 end::int as token_count, structure, chunk_key from d5"""
)
ORACLE["chunk_citations"] = _CHUNKED + " select source_id, 'redacted' as redaction_status, count(*) as n, count(*) as agree from d5 group by 1, 2"
