"""Parsers, folders, repositories, stores, configuration, streams and the command line."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from siftlode.operators import extract, parsers
from siftlode.sources import config, files, git
from siftlode.sources.store import Collection, Runs, Store


def kinds(text, parser, locator="f"):
    return [(r["candidate_type"], r.get("text")) for r in parsers.PARSERS[parser](text, locator)]


def test_markdown():
    text = "# Top\n\nFirst line\nsecond\n\nSub\n---\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py x\ncode # no heading\n```\n\n```\nplain\n```\n- item\n"
    rows = list(parsers.markdown(text, "d.md"))
    assert [r["candidate_type"] for r in rows] == ["heading", "section", "heading", "table", "code_block", "code_block", "section"]
    assert rows[2]["heading_path"] == ["Top", "Sub"] and rows[4]["language"] == "py" and rows[5]["language"] is None
    assert (rows[1]["line_start"], rows[1]["line_end"], rows[4]["text"]) == (3, 4, "code # no heading\n")


def test_html_json_toml_yaml():
    rows = list(parsers.html('<h1 id="x">Head <b>a</b></h1><p>one<p>two<pre><code>c &lt; d</code></pre><table><tr><td>1</table>', "p.html"))
    assert [(r["candidate_type"], r["text"]) for r in rows] == [("heading", "Head a"), ("section", "one"), ("section", "two"), ("code_block", "c < d"), ("code_block", "c < d"), ("table", None)]
    assert rows[0]["locator"] == "p.html#x" and rows[1]["heading_path"] == ["Head a"]
    assert kinds('{"b": [true, null], "a/~": {"x": 1.5}}', "json") == [("object", None), ("object", None), ("scalar", "1.5"), ("array", None), ("scalar", "true"), ("scalar", "null")]
    assert [r["locator"] for r in parsers.PARSERS["json"]('{"a/~": 1}', "f.json")][1] == "f.json#/a~1~0"
    assert kinds("a: [x]\n", "yaml")[-1] == ("scalar", "x") and kinds("[t]\na = 3\n", "toml")[-1] == ("scalar", "3")
    with pytest.raises(ValueError, match="json_parse_error"):
        kinds("{", "json")
    deep = "[" * 900 + "]" * 900
    assert len(kinds(deep, "json")) == 900


def test_python_openapi_schema():
    src = 'import os\nfrom a.b import c\n\nclass K(Base):\n    """Doc."""\n\n    def m(self, x: int = 1) -> str:\n        """Says."""\n\nasync def f(*a, **k): pass\n'
    rows = list(parsers.python_source(src, "s.py"))
    assert [(r["symbol_path"], r["signature_text"], r["text"]) for r in rows] == [(["K"], "class K", "Doc."), (["K", "m"], "def m(self, x: int=1)", "Says."), (["f"], "def f(*a, **k)", None)]
    assert rows[0]["metadata"]["imports"] == ["a.b", "os"]
    api = "paths:\n  /x:\n    get: {operationId: g, summary: S}\n    note: n\ncomponents:\n  schemas:\n    M: {description: D}\n"
    tail = [(r["candidate_type"], r.get("endpoint_path"), r.get("text")) for r in parsers.openapi(api, "openapi.yaml")][-2:]
    assert tail == [("endpoint", "GET /x", "S"), ("schema", None, "D")]
    sch = '{"properties": {"p": {"type": "string", "enum": [1, 2], "description": "P"}, "q": 5}}'
    assert [(r["schema_path"], r["text"], r["metadata"]) for r in parsers.json_schema(sch, "a.schema.json") if r["candidate_type"] == "schema_path"] == [(["properties", "p"], "P", {"type": "string", "enum_count": 2}), (["properties", "q"], None, {})]
    ok = "openapi: 3.0.1\ninfo: {title: t, version: '1'}\npaths:\n  /x:\n    get: {responses: {'200': {description: d}}}\n"
    assert parsers.openapi_faults(ok, "openapi.yaml") == [] and len(parsers.openapi_faults(api, "openapi.yaml")) == 4
    assert parsers.json_schema_faults(sch, "a.json") == ["#/properties/q is no schema"]
    assert parsers.json_schema_faults('{"type": "text", "required": ["a", "a"], "items": {"minItems": -1}, "anyOf": [], "not": true}', "a.json") == ["#/anyOf", "#/items/minItems", "#/required", "#/type"]
    assert parsers.json_schema_faults('{"type": ["string", "null"], "properties": {"a": {"enum": [1], "maximum": 2.5}}}', "a.json") == []
    with pytest.raises(ValueError, match="circle"):
        parsers.by_tools("a", {"a": {"enabled": False, "fallback": "b"}, "b": {"enabled": False, "fallback": "a"}})
    assert parsers.by_tools("a", {"a": {"enabled": False, "fallback": "b"}, "b": {"parser": "json"}}) == "json"


def test_extract_frame(spark):
    a = spark.createDataFrame(
        [(1, "a.md", "documentation", None, b"# T\n\ntext"), (2, "b.json", "schema", None, b"{"), (3, "c.go", "source_code", "go", b"package x"), (4, "d.txt", "x", None, b"\xff bad"), (5, "e.txt", "x", None, None), (6, None, None, None, b"one\n\ntwo"), (7, "s.json", "json_schema", None, b'{"type": 5}'), (8, "t.json", "json_schema", None, b'{"type": "object"}')],
        "id int, path string, artifact_role string, language string, content binary",
    )
    got = extract.extract(a, ["id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [r.candidate_type for r in by[1]] == ["heading", "section"] and by[2][0].diagnostic == "json_parse_error" and by[3][0].status == "skipped"
    assert by[7][0].diagnostic == "json_schema_validation_error" and by[7][0].status == "completed" and by[8][0].diagnostic is None
    assert by[4][0].diagnostic == "decode_replaced" and by[5][0].ordinal is None and [r.text for r in by[6]] == ["one", "two"]
    docs = spark.createDataFrame([(1, "a\nb\n\n  \nc"), (2, ""), (3, "x\r\ny")], "k int, t string")
    native = extract.paragraphs_native(docs, "k", F.col("t")).orderBy("k", "ordinal").collect()
    assert [(r.k, r.text, r.line_start, r.line_end) for r in native] == [(1, "a\nb", 1, 2), (1, "c", 5, 5), (3, "x\ny", 1, 2)]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "src" / "sub dir").mkdir(parents=True)
    (tmp_path / "src" / "sub dir" / "ü+1.py").write_text("x = 1\n")
    (tmp_path / "src" / "a.md").write_text("# a\n")
    got = {r.path: r for r in files.scan_folder(spark, str(tmp_path), "src").drop("content").collect()}
    assert set(got) == {"sub dir/ü+1.py", "a.md"} and got["a.md"].language == "markdown" and got["a.md"].size_bytes == 4
    h = files.snapshot_hash(files.scan_folder(spark, str(tmp_path), "src"), "s", "src", ["**"], [])
    import hashlib

    parts = [{"path": p, "checksum": got[p].checksum, "size_bytes": got[p].size_bytes} for p in sorted(got)]
    doc = {"source_id": "s", "root_identifier": "src", "include_paths": ["**"], "exclude_paths": [], "artifacts": parts}
    assert h == hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    for bad in ("../x", "/etc", "a/../b", ""):
        with pytest.raises(ValueError):
            files.allowed_root(str(tmp_path), bad)


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "t@t")
    run("config", "user.name", "t")
    (tmp_path / "a b.txt").write_text("one")
    run("add", ".")
    run("commit", "-qm", "first token: xyz")
    run("tag", "v1")
    (tmp_path / "c.txt").write_text("two")
    run("add", ".")
    run("commit", "-qm", "second")
    t = git.read_tree(spark, str(tmp_path), ["v1", "main"]).collect()
    assert sorted((r.ref, r.path, r.ref_type, r.size_bytes) for r in t) == [("main", "a b.txt", "branch", 3), ("main", "c.txt", "branch", 3), ("v1", "a b.txt", "tag", 3)]
    log = git.read_log(spark, str(tmp_path), ["v1", "main"]).collect()
    assert len(log) == 2 and "xyz" not in " ".join(r.subject for r in log)
    with pytest.raises(ValueError):
        git.resolve(str(tmp_path), "nothing")
    body = {r.path: bytes(r.content) for r in git.with_content(git.read_tree(spark, str(tmp_path), ["main"]), str(tmp_path)).collect()}
    assert body == {"a b.txt": b"one", "c.txt": b"two"}
    copy = git.cached_clone(f"file://{tmp_path}", str(tmp_path / "cache"))
    (tmp_path / "d.txt").write_text("three")
    run("add", "d.txt")
    run("commit", "-qm", "third")
    assert git.cached_clone(f"file://{tmp_path}", str(tmp_path / "cache")) == copy
    assert {r.path for r in git.read_tree(spark, copy, ["main"]).collect()} == {"a b.txt", "c.txt", "d.txt"}
    with pytest.raises(ValueError):
        git.cached_clone("--upload-pack=x", str(tmp_path))
    from siftlode.cli import source_files

    src = {"source_id": "g", "source_type": "git_repository", "url": f"file://{tmp_path}", "tracked_refs": ["v1"]}
    assert [(r.path, bytes(r.content)) for r in source_files(spark, src, str(tmp_path), str(tmp_path / "cache")).collect()] == [("a b.txt", b"one")]
    assert git.version_label([("refs/tags/v1", "a" * 40, "tag")]) == "tag:v1@" + "a" * 12
    assert git.version_label([("a", "1", "tag"), ("b", "2", "tag")]).startswith("refs:")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    schema = "id int, v string, first string"
    s.upsert("t", spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], schema), ["id"])
    s.upsert("t", spark.createDataFrame([(2, "c", "y"), (3, "d", "y")], schema), ["id"], keep=["first"])
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a", "x"), (2, "c", "x"), (3, "d", "y")]
    s.append("t", spark.createDataFrame([(9, "z", "z")], schema))
    assert s.read("t").count() == 4 and s.purge("t") > 0 and s.read("t").count() == 4 and s.missing(["t", "u"]) == ["u"]
    s.upsert("t", spark.createDataFrame([(9, "y", "z")], schema), ["id"])
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2, 3, 9] and s.purge("t") > 0 and s.read("t").count() == 4
    runs = Runs(s)
    assert runs.latest().count() == 0
    runs.record("r1", "src", "started")
    runs.record("r1", "src", "completed", {"added": 1})
    assert [(r.id, r.status) for r in runs.latest().collect()] == [("r1", "completed")]
    with pytest.raises(ValueError):
        runs.record("r1", "src", "dancing")
    c = Collection(s, "EvidenceChunk", "g1")
    c.bootstrap({"uuid": "string"})
    c.bootstrap({"uuid": "string"})
    with pytest.raises(ValueError):
        c.bootstrap({"uuid": "int"})
    o = spark.createDataFrame([("u1", None, None)], "uuid string, text string, n int")
    assert tuple(c.upsert(o).first()) == ("u1", "", 0)
    with pytest.raises(ValueError):
        Collection(s, "bad", "G")


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=8)
    s.upsert("t", spark.createDataFrame([(i, f"v{i}") for i in range(40)], "id int, v string"), ["id"])
    before = s._version("t")[1]["parts"]
    s.upsert("t", spark.createDataFrame([(7, "new", 1)], "id int, v string, extra int"), ["id"])
    after = s._version("t")[1]["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    rows = {r.id: (r.v, r.extra) for r in s.read("t").collect()}
    assert len(rows) == 40 and rows[7] == ("new", 1) and rows[8] == ("v8", None)
    s.upsert("e", spark.createDataFrame([], "id int, v string"), ["id"])
    assert s.read("e").count() == 0 and s.upsert("e", spark.createDataFrame([(1, "a")], "id int, v string"), ["id"]).count() == 1


def test_store_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    s.upsert("t", one, ["id"])
    put = Store._put

    def dies(self, path, text):
        put(self, path, text)
        raise OSError("gone")  # after the list is written, before it is made valid

    monkeypatch.setattr(Store, "_put", dies)
    for call in (lambda: s.upsert("t", spark.createDataFrame([(1, "b")], "id int, v string"), ["id"]), lambda: s.append("t", one), lambda: s.replace("t", one.limit(0))):
        with pytest.raises(OSError):
            call()
        assert [tuple(r) for r in s.read("t").collect()] == [(1, "a")]
    monkeypatch.undo()
    assert s.upsert("t", spark.createDataFrame([(2, "c")], "id int, v string"), ["id"]).count() == 2


def test_config(spark, tmp_path):
    docs = {
        "sources": {"sources": [{"source_id": "a", "extractor_profile": "p"}, {"source_id": "a", "extractor_profile": "x"}]},
        "extractors": {"profiles": [{"profile_id": "p"}]},
        "retrieval": {"query_profiles": [{"profile_id": "q", "candidate_counts": {"bm25_top_k": 10, "fused_top_k": 5, "rerank_top_k": 9}, "filter_dimensions": [], "bm25_fields": ["nope"], "fusion_weights": {"exact": -1}, "relationship_traversal": {"enabled": True}}]},
        "security": {"source_allowlist": {"source_ids": ["zz"]}},
    }
    text = " ".join(config.cross_references(docs))
    for part in ("a repeated", "unknown extractor", "bm25_top_k", "rerank_top_k", "negative", "visibility missing", "nope has no index", "without types", "without bounds", "unknown source zz"):
        assert part in text, part
    with pytest.raises(config.ConfigError, match="missing"):
        config.load_dir(tmp_path)
    s = [{"source_id": "a"}, {"source_id": "b", "enabled": False}]
    assert config.select_sources(s) == [s[0]] and config.select_sources(s, ["a", "a"]) == [s[0]]
    with pytest.raises(ValueError):
        config.select_sources(s, ["b"])
    assert not config.provider_allowed({"enabled": True, "external": True}, {}) and config.provider_allowed({"enabled": True})
    cat = config.source_catalog(spark, [{"source_id": "a", "enabled": True, "source_priority": 3, "tracked_refs": ["main"], "url": "https://x"}])
    assert cat.first().source_priority == 3 and cat.first().tracked_refs == ["main"] and "url" not in cat.columns
    e = config.model_profile({"model_id": "m", "provider": "local", "provider_model_id": "h", "dimensions": 8}, "embedding")
    assert (e["profile_id"], e["provider_id"], e["model_name"], e["batch_size"]) == ("m", "local", "h", 32)
    r = config.model_profile({"profile_id": "r", "provider_id": "local", "model_name": "h", "token_limit": 99, "dimensions": 3}, "reranker")
    assert r["max_text_length"] == 99 and r["candidate_limit"] == 50 and "dimensions" not in r
    for raw, kind, says in (
        ({"profile_id": "m", "provider_id": "x", "model_name": "h", "dimensions": 8, "external": True}, "embedding", "disabled"), ({"dimensions": 0}, "embedding", "positive"),
        ({"profile_id": "r", "provider_id": "x", "model_name": "h", "candidate_limit": 201}, "reranker", "above 200"), ({"profile_id": "r", "provider_id": "x", "model_name": "h", "nope": 1}, "reranker", "nope unknown"),
    ):
        with pytest.raises(config.ConfigError, match=says):
            config.model_profile(raw, kind)
    e = subprocess.CalledProcessError(3, ["/usr/bin/git", "clone", "https://u:p@h", "a=b"])
    d = config.failure_diagnostic(e, "fetch", "s", "/x/y/file.txt")
    assert d["exit_code"] == 3 and d["command"] == ["git", "clone", "[redacted]", "[redacted]"] and d["artifact_locator"] == "file.txt"


def test_stream_upsert(spark, tmp_path):
    from siftlode.streaming.increments import arriving, upsert_stream

    schema = "k string, v int, at int"
    inp, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], schema).coalesce(1).write.parquet(inp)
    upsert_stream(arriving(spark, inp, schema), store, "t", ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", 9, 1), ("b", 5, 3)], schema).coalesce(1).write.mode("append").parquet(inp)
    upsert_stream(arriving(spark, inp, schema), store, "t", ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.v, r["at"]) for r in store.read("t").collect()) == [("a", 2, 2), ("b", 5, 3)]


def test_cli(spark, tmp_path, capsys):
    from siftlode import cli

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# a\n\npassword: hunter2secret99\n")
    (tmp_path / "docs" / "b.min.js").write_text("x")
    cfg = tmp_path / "sources.yaml"
    cfg.write_text("config_version: 1\nkind: sources\nsources:\n  - {source_id: s, source_type: local_directory, local_path: docs}\n")
    store = str(tmp_path / "store")
    assert cli.main(["version"]) == 0 and cli.main(["validate", str(cfg)]) == 0 and cli.main(["sources", str(cfg), "--format", "json"]) == 0
    capsys.readouterr()
    assert cli.main(["ingest", str(cfg), store, "--base", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"source_id": "s", "added": 1, "skipped_generated_file": 1, "chunks": 2}
    from siftlode.plans.runtime import session

    s = Store(session("siftlode-cli"), store)
    kept = s.read("chunks").collect()
    assert s.read("citations").count() == 2
    assert all(r.live for r in kept) and sorted(r.redaction_status for r in kept) == ["redacted", "redaction_checked"]
    (tmp_path / "docs" / "a.md").unlink()
    (tmp_path / "docs" / "c.md").write_text("# c")
    cli.main(["ingest", str(cfg), store, "--base", str(tmp_path)])
    assert json.loads(capsys.readouterr().out) == {"source_id": "s", "added": 1, "tombstoned": 1, "skipped_generated_file": 1, "chunks": 1}
    assert sorted((r.path, r.live) for r in s.read("chunks").collect()) == [("a.md", False), ("a.md", False), ("c.md", True)]
    cli.main(["status", store, "--limit", "5"])
    assert capsys.readouterr().out.count('"completed"') == 2
    assert cli.main(["check", store, "artifacts", "nope"]) == 1
