"""Git repositories as a Spark data source: files of a tree and the log, read through the git command."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TREE = "path string, checksum string, size_bytes long, commit_sha string, ref string, ref_type string"
_LOG = "commit_sha string, parents array<string>, authored_at string, committed_at string, subject string, ref string"


def git(repo: str, *args: str) -> str:
    """Output of a git command in a repository; its message is not passed on if it fails."""
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, timeout=600)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed with code {done.returncode}")
    return done.stdout.decode("utf-8", "replace")


def records(repo: str, end: str, *args: str) -> Iterator[str]:
    """The output of a git command, one record at a time: nothing but the current piece is held."""
    run = subprocess.Popen(["git", "-C", repo, "-c", "core.quotepath=off", *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    rest, mark = b"", end.encode()
    while piece := run.stdout.read(1 << 16):
        *whole, rest = (rest + piece).split(mark)
        for x in whole:
            yield x.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")
    if run.wait():
        raise RuntimeError(f"git {args[0]} failed with code {run.returncode}")


def cached_clone(url: str, cache: str) -> str:
    """A bare copy of a repository in a folder of its own below ``cache``: cloned once, fetched after that; returns its path.

    Only https, ssh and file addresses are taken. The address is not part of the folder's name.
    """
    if not re.match(r"^(?:https|ssh|file)://", url) or url.startswith("-"):
        raise ValueError("a repository's address must be https, ssh or file")
    path = os.path.join(cache, hashlib.sha256(url.encode()).hexdigest()[:32])
    if os.path.isdir(path):
        git(path, "fetch", "--prune", "--tags", "--force", "origin", "+refs/heads/*:refs/heads/*")
    else:
        os.makedirs(cache, exist_ok=True)
        git(cache, "clone", "--bare", "--quiet", url, path)
    return path


def resolve(repo: str, ref: str) -> tuple[str, str]:
    """(commit, tag|branch|commit) of a ref: a tag goes before a local branch, that before a remote one, that before a commit."""
    for kind, name in (("tag", f"refs/tags/{ref}"), ("branch", f"refs/heads/{ref}"), ("branch", f"refs/remotes/origin/{ref}"), ("commit", ref)):
        try:
            return git(repo, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}").strip(), kind
        except RuntimeError:
            continue
    raise ValueError("ref is neither tag, branch nor commit")


class _Ref(InputPartition):
    def __init__(self, ref: str):
        self.ref = ref


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.what = options["path"], options.get("what", "tree")
        self.refs = [r.strip() for r in options.get("refs", "HEAD").split(",") if r.strip()]

    def partitions(self) -> list[InputPartition]:
        return [_Ref(r) for r in self.refs]

    def read(self, part: _Ref) -> Iterator[tuple]:
        commit, kind = resolve(self.repo, part.ref)
        if self.what == "log":
            for rec in records(self.repo, "\x1e", "log", "--format=%H%x1f%P%x1f%aI%x1f%cI%x1f%s%x1e", commit):
                f = rec.strip("\n").split("\x1f")
                if len(f) == 5:
                    yield f[0], f[1].split(), f[2], f[3], f[4], part.ref
            return
        for rec in records(self.repo, "\0", "ls-tree", "-r", "-l", "-z", commit):
            meta, _, path = rec.partition("\t")
            m = meta.split()
            if len(m) == 4 and m[1] == "blob":
                yield path, f"gitblob:{m[2]}", int(m[3]) if m[3].isdigit() else None, commit, part.ref, kind


class GitSource(DataSource):
    """``spark.read.format("git").option("path", repo).option("refs", "main,v1").option("what", "tree"|"log")``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return _LOG if self.options.get("what") == "log" else _TREE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, repo: str, refs: list[str]) -> DataFrame:
    """Files of each ref, one partition per ref."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").option("path", repo).option("refs", ",".join(refs)).load()


def with_content(tree: DataFrame, repo: str) -> DataFrame:
    """The rows of :func:`read_tree` with the blobs' content (binary), read by one git process per task; all executors must reach the repository."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        for b in batches:
            out = []
            for blob in b["checksum"]:
                p.stdin.write(blob.removeprefix("gitblob:").encode() + b"\n")
                p.stdin.flush()
                head = p.stdout.readline().split()
                if len(head) != 3:
                    out.append(None)
                    continue
                out.append(p.stdout.read(int(head[2])))
                p.stdout.read(1)
            yield b.assign(content=out)
        p.stdin.close()
        p.wait()

    return tree.mapInPandas(run, f"{_TREE}, content binary")


def read_log(spark: SparkSession, repo: str, refs: list[str]) -> DataFrame:
    """Commits of all refs, each once (the first ref by name holds), with cleaned subjects."""
    from siftlode.operators.redaction import safe_text

    spark.dataSource.register(GitSource)
    log = spark.read.format("git").option("path", repo).option("refs", ",".join(refs)).option("what", "log").load()
    one = log.withColumn("_n", F.row_number().over(Window.partitionBy("commit_sha").orderBy("ref"))).where("_n = 1").drop("_n")
    return one.withColumn("subject", safe_text(F.col("subject"))).orderBy("commit_sha")


def version_label(refs: list[tuple[str, str, str]]) -> str:
    """Label of a snapshot of (ref, commit, kind): one ref as ``kind:ref@commit``, several as a digest of all."""
    import hashlib
    import json

    if len(refs) == 1:
        ref, commit, kind = refs[0]
        prefix = kind if kind in ("tag", "branch") else "commit"
        return f"{prefix}:{ref.replace('refs/heads/', '').replace('refs/tags/', '')}@{commit[:12]}"
    all_refs = [{"label": r, "commit_sha": c, "ref_type": k} for r, c, k in refs]
    return "refs:" + hashlib.sha256(json.dumps(all_refs, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
