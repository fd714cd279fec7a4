"""Command line: ``python -m siftlode.cli version | sources | ingest | status | check | validate``."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from siftlode import __version__


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftlode")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    s = sub.add_parser("sources", help="list configured sources")
    s.add_argument("config")
    s.add_argument("--format", choices=["table", "json"], default="table")
    i = sub.add_parser("ingest", help="bring a store in step with its sources: files, chunks and citations")
    i.add_argument("config")
    i.add_argument("store")
    i.add_argument("--base", default=".")
    i.add_argument("--cache", help="folder for copies of repositories")
    i.add_argument("--source", action="append", default=[])
    i.add_argument("--dry-run", action="store_true")
    t = sub.add_parser("status", help="newest runs")
    t.add_argument("store")
    t.add_argument("--run")
    t.add_argument("--source")
    t.add_argument("--limit", type=int, default=1)
    c = sub.add_parser("check", help="missing tables of a store")
    c.add_argument("store")
    c.add_argument("tables", nargs="+")
    v = sub.add_parser("validate", help="check one configuration file or a folder of them")
    v.add_argument("path")
    return p


def source_files(spark, source: dict, base: str, cache: str | None = None):  # noqa: ANN001, ANN201
    """(path, checksum, size_bytes, content) of a source's present state: a folder below ``base``, or the first tracked ref of a repository.

    A repository lies below ``base`` (local_path) or at an address (url), of which a copy is kept in ``cache``.
    """
    from siftlode.sources import files, git

    if not str(source.get("source_type", "")).startswith("git"):
        return files.scan_folder(spark, base, source["local_path"]).select("path", "checksum", "size_bytes", "content")
    repo = str(files.allowed_root(base, source["local_path"])) if source.get("local_path") else git.cached_clone(source["url"], cache or f"{base}/.git-cache")
    tree = git.read_tree(spark, repo, [(source.get("tracked_refs") or ["HEAD"])[0]])
    return git.with_content(tree, repo).select("path", "checksum", "size_bytes", "content")


def ingest_source(store, runs, source: dict, base: str, cache: str | None = None) -> dict:  # noqa: ANN001
    """Bring the store in step with one source; returns the counters.

    Files are scanned, classified and compared with the stored ones; of added and changed files the parts are extracted,
    redacted, classified and cut into chunks with their citations. Files that are gone, and chunks of files that
    are gone or changed, stay in the store as not live. A failure is recorded without messages or contents, and raised.
    """
    from pyspark.sql import functions as F

    from siftlode.operators.discovery import classify_paths, skip_reasons
    from siftlode.operators.incremental import plan_snapshot
    from siftlode.plans import service
    from siftlode.plans.runtime import cut, stored
    from siftlode.sources.config import failure_diagnostic

    run, sid, stage = uuid.uuid4().hex, source["source_id"], "started"

    def reached(name: str) -> None:
        nonlocal stage
        stage = name
        runs.record(run, sid, name)

    try:
        reached("started")
        raw = source_files(store.spark, source, base, cache)
        reached("discovering")
        found = skip_reasons(classify_paths(raw), source.get("include_paths") or [], source.get("exclude_paths") or []).withColumn("source_id", F.lit(sid))
        found = cut(
            found.select(
                "source_id", "path", "checksum", "size_bytes", "language", "artifact_role", "generated", "vendored", "skip_reason",
                F.lit(source.get("extractor_profile")).cast("string").alias("extractor_profile"), F.lit(source.get("corpus_eligibility") or "unknown").alias("corpus_eligibility_label"),
            )
        )
        old = store.read("artifacts")
        now = found.where("skip_reason is null").drop("skip_reason").withColumn("live", F.lit(True))
        mine = (old.where(F.col("source_id") == sid) if old is not None else now.where(F.lit(False)))
        plan = cut(plan_snapshot(mine, now, ["source_id", "path"], ["checksum", "extractor_profile", "corpus_eligibility_label"]))
        counts = {r["status"]: r["n"] for r in plan.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts |= {f"skipped_{r['skip_reason']}": r["n"] for r in found.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        reached("extracting")
        fresh = plan.where("status in ('added', 'changed')").select("path")
        labels = now.select("path", "artifact_role", "language")
        artifacts = raw.select("path", "content").join(fresh, "path", "left_semi").join(labels, "path").select(
            F.xxhash64(F.lit(sid), "path").alias("file_id"), F.lit(sid).alias("source_id"), "path", "artifact_role", "language", "content",
            F.lit(source.get("sensitivity_class") or "internal").alias("sensitivity_class"), F.lit(source.get("license_policy")).cast("string").alias("license_label"),
        )
        reached("chunking")
        made = service.ingest(artifacts)
        kept = [c for c in made["chunks"].columns if c not in ("findings", "sanitized_text", "file_id")]
        chunks = stored(made["chunks"].select(*kept, F.lit(True).alias("live")))
        counts["chunks"] = chunks.count()
        reached("persisting")
        known = store.read("chunks")
        stale = plan.where("status in ('changed', 'tombstoned')").select("source_id", "path")
        if known is not None:
            gone = known.where("live").join(stale, ["source_id", "path"], "left_semi").join(chunks.select("chunk_key"), "chunk_key", "left_anti")
            chunks = chunks.unionByName(gone.withColumn("live", F.lit(False)), allowMissingColumns=True)
        store.upsert("chunks", cut(chunks.dropDuplicates(["chunk_key"])), ["chunk_key"])
        store.upsert("citations", cut(made["citations"].dropDuplicates(["citation_key"])), ["citation_key"])
        gone = mine.join(plan.where("status = 'tombstoned'").select("source_id", "path"), ["source_id", "path"], "left_semi").withColumn("live", F.lit(False))
        # the artifacts last: a run that fails before leaves them as they were, and the next one does its work again
        store.upsert("artifacts", now.unionByName(gone.select(*now.columns)), ["source_id", "path"])
        runs.record(run, sid, "completed", counts)
        return counts
    except Exception as e:
        runs.record(run, sid, "failed", diagnostic=failure_diagnostic(e, stage, sid))
        raise


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    from siftlode.sources.config import ConfigError, load_dir, read_file, select_sources

    if a.command == "validate":
        from pathlib import Path

        try:
            load_dir(a.path) if Path(a.path).is_dir() else read_file(a.path)
        except ConfigError as e:
            print("\n".join(e.faults), file=sys.stderr)
            return 1
        print("valid")
        return 0
    if a.command == "sources":
        rows = read_file(a.config, "sources").get("sources") or []
        if a.format == "json":
            print(json.dumps(rows, default=str, sort_keys=True))
        else:
            for r in rows:
                print(f"{r.get('source_id', ''):32} {r.get('source_type', ''):24} {'enabled' if r.get('enabled', True) else 'disabled'}")
        return 0
    from siftlode.plans.runtime import session
    from siftlode.sources.store import Runs, Store

    store = Store(session("siftlode-cli"), a.store)
    if a.command == "check":
        gone = store.missing(a.tables)
        print(json.dumps({"missing": gone}))
        return int(bool(gone))
    runs = Runs(store)
    if a.command == "status":
        from siftlode.operators.incremental import run_status

        for r in run_status(runs.latest(), a.run, a.source, a.limit).collect():
            print(json.dumps(r.asDict(), default=str))
        return 0
    chosen = select_sources(read_file(a.config, "sources").get("sources") or [], a.source)
    for s in chosen:
        print(json.dumps({"source_id": s["source_id"], "planned": True}) if a.dry_run else json.dumps({"source_id": s["source_id"], **ingest_source(store, runs, s, a.base, a.cache)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
