"""Configuration files: strict reading, cross-references, profiles and selection. Configuration is no data: the driver holds it."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KINDS = ["access", "evaluation", "extractors", "memory", "models", "retrieval", "security", "sources"]
#: Columns of a source in the catalog, and filters that every query profile must apply.
CATALOG = {
    "source_id": "string", "source_type": "string", "tracked_refs": "array<string>", "version_strategy": "string", "extractor_profile": "string",
    "source_priority": "int", "visibility_label": "string", "corpus_eligibility": "string", "sensitivity_class": "string", "license_policy": "string",
    "refresh_cadence": "string", "enabled": "boolean",
}
MANDATORY_FILTERS = ["source_allowlist", "visibility", "sensitivity_class", "license_policy_status", "version_or_release_scope", "active_index_version"]
INDEXED_FIELDS = {"sanitized_text", "heading_path", "artifact_path", "symbol_path", "signature_text", "version_label", "source_type", "language"}


class ConfigError(ValueError):
    """What is wrong with a configuration, one line each."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


def read_file(path: str | Path, kind: str | None = None) -> dict:
    """One YAML mapping with config_version and kind; ``kind`` must be the expected one if given."""
    import yaml

    doc = yaml.safe_load(Path(path).read_text())
    if not isinstance(doc, dict):
        raise ConfigError([f"{Path(path).name}: not a mapping"])
    faults = [f"{Path(path).name}: {k} missing" for k in ("config_version", "kind") if k not in doc]
    if kind and doc.get("kind") not in (None, kind):
        faults.append(f"{Path(path).name}: kind is {doc.get('kind')}, expected {kind}")
    if faults:
        raise ConfigError(faults)
    return doc


def _repeated(rows: list[dict], key: str) -> list[str]:
    seen: set = set()
    return [str(r.get(key)) for r in rows if r.get(key) in seen or seen.add(r.get(key))]


def load_dir(folder: str | Path) -> dict[str, dict]:
    """All required files of a folder by kind, checked one by one and against each other."""
    faults, docs = [], {}
    for kind in KINDS:
        path = Path(folder) / f"{kind}.yaml"
        if not path.is_file():
            faults.append(f"{kind}.yaml missing")
            continue
        try:
            docs[kind] = read_file(path, kind)
        except ConfigError as e:
            faults += e.faults
    if not faults:
        faults = cross_references(docs)
    if faults:
        raise ConfigError(faults)
    return docs


def cross_references(docs: dict[str, dict]) -> list[str]:
    """Faults across files: repeated ids, and profiles, models and sources that are named but not defined."""
    get = lambda kind, key: docs.get(kind, {}).get(key) or []
    sources, extractors = get("sources", "sources"), get("extractors", "profiles")
    embeds, reranks = get("models", "embedding_profiles"), get("models", "reranker_profiles")
    queries = get("retrieval", "query_profiles")
    faults = [f"source {x} repeated" for x in _repeated(sources, "source_id")]
    for kind, rows in (("embedding", embeds), ("reranker", reranks)):
        for r in rows:
            try:
                model_profile(r, kind)
            except ConfigError as e:
                faults += e.faults
    faults += [f"query profile {x} repeated" for x in _repeated(queries, "profile_id")]
    ids = lambda rows: {r.get("profile_id", r.get("model_id")) for r in rows}
    for s in sources:
        if extractors and s.get("extractor_profile") not in ids(extractors):
            faults.append(f"source {s.get('source_id')} names an unknown extractor profile")
    for q in queries:
        for key, known in (("embedding_profile_id", ids(embeds)), ("reranker_profile_id", ids(reranks))):
            if known and q.get(key) not in known:
                faults.append(f"query profile {q.get('profile_id')} names an unknown {key[:-3]}")
        faults += [f"query profile {q.get('profile_id')}: {f}" for f in profile_faults(q)]
    for x in (docs.get("security", {}).get("source_allowlist") or {}).get("source_ids") or []:
        if sources and x not in {s.get("source_id") for s in sources}:
            faults.append(f"allow-list names unknown source {x}")
    return faults


def profile_faults(q: dict) -> list[str]:
    """What breaks the rules of a query profile."""
    c, t, faults = q.get("candidate_counts") or {}, q.get("relationship_traversal") or {}, []
    for k in ("bm25_top_k", "vector_top_k"):
        if not 50 <= c.get(k, 50) <= 200:
            faults.append(f"{k} outside 50..200")
    if c.get("rerank_top_k", 0) > c.get("fused_top_k", 0):
        faults.append("rerank_top_k above fused_top_k")
    if any(w < 0 for w in (q.get("fusion_weights") or {}).values()):
        faults.append("negative fusion weight")
    faults += [f"filter {f} missing" for f in MANDATORY_FILTERS if f not in (q.get("filter_dimensions") or [])]
    faults += [f"bm25 field {f} has no index" for f in q.get("bm25_fields") or [] if f not in INDEXED_FIELDS]
    if t.get("enabled"):
        if not t.get("relationship_types"):
            faults.append("traversal without types")
        if not 1 <= t.get("max_depth", 0) <= 3 or t.get("max_fanout_per_seed", 0) < 1 or t.get("max_relationship_candidates", 0) < 1:
            faults.append("traversal without bounds")
    return faults


def resolve_profile(docs: dict[str, dict], profile_id: str) -> dict:
    """A query profile with the limits, weights and traversal that its stages use."""
    for q in docs["retrieval"].get("query_profiles") or []:
        if q.get("profile_id") == profile_id:
            c = q.get("candidate_counts") or {}
            return {
                "profile_id": profile_id, "exact_fields": q.get("exact_fields") or [], "bm25_fields": q.get("bm25_fields") or [],
                "limits": {k: c.get(f"{k}_top_k") for k in ("exact", "bm25", "vector", "fused", "rerank")}, "weights": q.get("fusion_weights") or {},
                "traversal": q.get("relationship_traversal") or {"enabled": False}, "token_budget": (q.get("evidence_packing") or {}).get("token_budget") or q.get("token_budget"),
                "embedding_profile_id": q.get("embedding_profile_id"), "reranker_profile_id": q.get("reranker_profile_id"),
            }
    raise KeyError(f"unknown query profile {profile_id}")


def provider_allowed(profile: dict, environment: dict | None = None) -> bool:
    """Whether a model profile may run: enabled, and if external also opted in and with its key in the environment."""
    env = os.environ if environment is None else environment
    if not profile.get("enabled", False):
        return False
    if not profile.get("external", False):
        return True
    return env.get("SIFTLODE_ALLOW_EXTERNAL") == "1" and bool(env.get(profile.get("credential_env") or "", ""))


def select_sources(sources: list[dict], wanted: list[str] | None = None) -> list[dict]:
    """The named sources in their order, each once, or all enabled ones; an unknown or disabled name is an error."""
    by = {s["source_id"]: s for s in sources}
    if not wanted:
        return [s for s in sources if s.get("enabled", True)]
    out = []
    for w in dict.fromkeys(wanted):
        if w not in by or not by[w].get("enabled", True):
            raise ValueError(f"source {w} is unknown or disabled")
        out.append(by[w])
    return out


def requested_ref(source: dict) -> str | None:
    return ",".join(source["tracked_refs"]) if source.get("tracked_refs") else source.get("version_strategy")


def config_hash(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def source_catalog(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """The sources as a frame of the catalog's columns: what they are and how they are kept, but not where they lie."""

    def value(s: dict, name: str, kind: str):  # noqa: ANN202
        v = s.get(name)
        return v if v is None or kind in ("int", "boolean") else [str(x) for x in v] if kind.startswith("array") else str(v)

    rows = [tuple(value(s, c, k) for c, k in CATALOG.items()) for s in sources]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in CATALOG.items()))


#: Older names of model profile keys, and the keys a profile has, with their kinds and limits.
ALIASES = {"model_id": "profile_id", "provider": "provider_id", "provider_model_id": "model_name"}
POSITIVE = {"embedding": ["dimensions", "batch_size", "timeout_seconds", "token_limit"], "reranker": ["candidate_limit", "timeout_seconds", "max_text_length"]}
DEFAULTS = {
    "embedding": {"enabled": True, "external": False, "deterministic": False, "batch_size": 32, "timeout_seconds": 30.0, "required_env_vars": [], "token_limit": None, "options": {}},
    "reranker": {
        "enabled": True, "external": False, "deterministic": False, "candidate_limit": 50, "timeout_seconds": 10.0, "max_text_length": 4096,
        "required_env_vars": [], "allow_fallback": False, "required": True, "options": {},
    },
}


def model_profile(raw: dict, kind: str) -> dict:
    """An embedding or reranker profile with its defaults, from present or older key names; everything that is wrong is one error.

    The newer name of a key holds where both are given. A reranker's older token_limit bounds its text where
    nothing else does, and its dimensions are dropped. An external embedding profile must be disabled.
    """
    row = {ALIASES.get(k, k): v for k, v in raw.items() if k in ALIASES} | {k: v for k, v in raw.items() if k not in ALIASES}
    if kind == "reranker":
        row.pop("dimensions", None)
        tokens = row.pop("token_limit", None)
        if tokens:
            row.setdefault("max_text_length", tokens)
    row = DEFAULTS[kind] | row
    known = {"profile_id", "provider_id", "model_name", *DEFAULTS[kind], *POSITIVE[kind]}
    faults = [f"{k} missing" for k in ("profile_id", "provider_id", "model_name") if not row.get(k)]
    if kind == "embedding" and row.get("dimensions") is None:
        faults.append("dimensions missing")
    faults += [f"{k} unknown" for k in sorted(set(row) - known)]
    faults += [f"{k} must be positive" for k in POSITIVE[kind] if row.get(k) is not None and not (isinstance(row[k], int | float) and row[k] > 0)]
    if kind == "reranker" and row["candidate_limit"] > 200:
        faults.append("candidate_limit above 200")
    if kind == "embedding" and row["external"] and row["enabled"]:
        faults.append("an external profile must be disabled")
    if faults:
        raise ConfigError([f"{kind} profile {row.get('profile_id')}: {f}" for f in faults])
    return row


def failure_diagnostic(error: BaseException, stage: str, source_id: str, locator: str | None = None, retryable: bool = False) -> dict:
    """What may be recorded of a failure: kinds and places, no message, no secret; arguments with addresses or values are masked."""
    out: dict = {"error_type": type(error).__name__, "stage": stage, "source_id": source_id, "retryable": retryable}
    if hasattr(error, "returncode"):
        out["exit_code"] = error.returncode
    command = getattr(error, "cmd", getattr(error, "command", None))
    if isinstance(command, list | tuple):
        hide = lambda p: "[redacted]" if "://" in p or "=" in p else p.rsplit("/", 1)[-1]
        out["command"] = [hide(str(p)) for p in command][:12]
    if locator is not None:
        out["artifact_locator"] = locator.replace("\\", "/").rsplit("/", 1)[-1][:255]
    return out
