"""Logs to index to search, on small sessions written by the tests."""

import json

import pytest

from turnstone.plans import search as Q
from turnstone.plans.index import Index, IndexMismatch
from turnstone.sources import sessions as S

ROOT = "/work/sample-project"
AT = "2026-07-13T10:11:15.000Z"


def header(session="s1", cwd=ROOT):
    return {"type": "session", "id": session, "cwd": cwd, "timestamp": AT, "version": 3}


def message(key, parent, role, content, **more):
    return {"type": "message", "id": key, "parentId": parent, "timestamp": AT, "message": {"role": role, "content": content, **more}}


def text(t):
    return {"type": "text", "text": t}


def call(key, name, **arguments):
    return {"type": "toolCall", "id": key, "name": name, "arguments": arguments}


def delivery(session="s1"):
    return [
        header(session),
        message("u1", None, "user", [text("修改货期规则，佣金入口在销售单编辑页")]),
        message("a1", "u1", "assistant", [text("I will search for delivery rule. Because delivery date must not be earlier than order date."), call("t1", "grep", pattern="delivery_rule|货期", path="src"), call("t2", "read", path="src/order/delivery_rule.ts")]),
        message("r1", "a1", "toolResult", [text("src/order/delivery_rule.ts: export function applyDeliveryDate")], toolCallId="t1", toolName="grep", isError=False),
        message("r2", "r1", "toolResult", [text("ok")], toolCallId="t2", toolName="read", isError=False),
        message("a2", "r2", "assistant", [text("I ruled out inventory module because stock is unrelated. Also must verify tests."), call("t3", "edit", path="src/order/delivery_rule.ts")]),
        message("r3", "a2", "toolResult", [text("ok")], toolCallId="t3", toolName="edit", isError=False),
        message("a3", "r3", "assistant", [text("Running tests."), call("t4", "bash", command="bun test src/order/delivery_rule.test.ts")]),
        message("r4", "a3", "toolResult", [text("1 pass")], toolCallId="t4", toolName="bash", isError=False),
        message("u2", "r4", "user", [text("fix JWT token expiration on auth middleware")]),
        message("a4", "u2", "assistant", [text("Looking at auth middleware JWT expiry."), call("t5", "grep", pattern="jwt|expiresIn", path="src/auth")]),
        message("r5", "a4", "toolResult", [text("src/auth/middleware.ts: expiresIn")], toolCallId="t5", toolName="grep", isError=False),
    ]


def write(folder, name, lines, tail=""):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines) + tail)


@pytest.fixture(scope="module")
def project():
    return S.project_of(ROOT)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory, project):
    at = tmp_path_factory.mktemp("logs")
    write(at, "one_x.jsonl", delivery())
    write(at, "foreign_x.jsonl", [header("f1", "/elsewhere"), message("x", None, "user", "never")])
    index = Index(spark, str(tmp_path_factory.mktemp("index") / "i"), project)
    return index, index.refresh(str(at)), at


def test_chunks(built):
    index, done, _ = built
    rows = {r["user_entry_id"]: r for r in index.tables()["chunks"].collect()}
    assert (done.added, done.rejected, done.chunks) == (2, 1, 2)
    one, two = rows["u1"], rows["u2"]
    assert len(one["raw_entry_ids"]) == 8 and len(two["raw_entry_ids"]) == 3
    assert (one["tool_call_count"], one["paired_result_count"]) == (4, 4)
    assert one["start_ts"] == one["end_ts"] == 1783937475000
    assert one["branch_leaf_id"] == two["branch_leaf_id"] == "r5"
    assert len(one["variant_hash"]) == 16 and len(one["chunk_id"]) == 32


def test_steps_and_constraints(built):
    tables = built[0].tables()
    one = tables["chunks"].filter("user_entry_id = 'u1'").first()["chunk_id"]
    steps = [(r["step_order"], r["step_type"], r["target"]) for r in tables["trace_steps"].filter(f"chunk_id = '{one}'").orderBy("step_order").collect()]
    assert steps == [
        (1, "grep", "delivery_rule|货期 in src"),
        (2, "read", "src/order/delivery_rule.ts"),
        (3, "edit", "src/order/delivery_rule.ts"),
        (4, "verification", "bun test src/order/delivery_rule.test.ts"),
        (10000, "exclusion", "inventory module because stock is unrelated"),
    ]
    words = [r["trigger_word"] for r in tables["constraints"].filter(f"chunk_id = '{one}'").orderBy("seq").collect()]
    assert words == ["rule", "because", "because", "must"]


@pytest.mark.parametrize(("query", "user"), [("JWT token expiration middleware", "u2"), ("货期规则", "u1"), ("delivery_rule.ts", "u1")])
def test_search(built, project, query, user):
    found = Q.search(built[0].tables(), {"q": query}, Q.Options(now_ms=1783937475000), project.project_id).collect()
    assert found[0]["user_entry_id"] == user
    assert found[0]["freshness"] == "High" and found[0]["relevance"] >= 40
    assert all(r["session_id"] == "s1" for r in found)
    assert "relevance" in Q.render(found)


def test_many_queries_are_one_plan(built, project):
    many = Q.search(built[0].tables(), {"a": "JWT", "b": "delivery rule", "c": "!!"}, Q.Options(now_ms=0), project.project_id).collect()
    assert {r["qid"] for r in many} == {"a", "b"}


def test_detail_is_bound_to_the_project(built, project):
    tables = built[0].tables()
    one = tables["chunks"].first()["chunk_id"]
    found = Q.chunk_detail(tables, one, project.project_id).collect()
    assert len(found) == 1 and found[0]["source_path"].endswith("one_x.jsonl")
    shown = Q.render_detail(found[0])
    assert one in shown and "one_x" not in shown and "steps:" in shown
    assert Q.chunk_detail(tables, one, "0" * 64).collect() == []


def test_branches_do_not_mix(spark, tmp_path, project):
    lines = [header("b"), message("u", None, "user", [text("fork")]), message("x", "u", "assistant", [text("left alpha")]), message("y", "u", "assistant", [text("right beta")])]
    write(tmp_path / "l", "b.jsonl", lines)
    index = Index(spark, str(tmp_path / "i"), project)
    index.refresh(str(tmp_path / "l"))
    rows = index.tables()["chunks"].collect()
    assert sorted(r["assistant_text"] for r in rows) == ["left alpha", "right beta"]
    assert len({r["variant_hash"] for r in rows}) == 2 and {r["user_entry_id"] for r in rows} == {"u"}
    found = Q.search(index.tables(), {"q": "fork"}, Q.Options(now_ms=0), project.project_id).collect()
    assert len(found) == 1 and len(found[0]["sibling_ids"]) == 1


def test_too_many_variants_build_nothing_and_keep_what_was(spark, tmp_path, project):
    few = [header("m"), message("u", None, "user", [text("many")]), *[message(f"a{i}", "u", "assistant", [text(f"answer {i}")]) for i in range(3)]]
    write(tmp_path / "l", "m.jsonl", few)
    index = Index(spark, str(tmp_path / "i"), project)
    assert index.refresh(str(tmp_path / "l")).chunks == 3
    write(tmp_path / "l", "m.jsonl", few + [message(f"b{i}", "u", "assistant", [text(f"more {i}")]) for i in range(66)])
    done = index.refresh(str(tmp_path / "l"))
    assert (done.limited, done.chunks) == (1, 3)


def test_refresh_equals_rebuild(spark, tmp_path, project):
    write(tmp_path / "l", "a.jsonl", delivery("a"))
    write(tmp_path / "l", "b.jsonl", delivery("b"))
    index = Index(spark, str(tmp_path / "i"), project)
    index.refresh(str(tmp_path / "l"))
    write(tmp_path / "l", "b.jsonl", delivery("b")[:4])
    write(tmp_path / "l", "c.jsonl", delivery("c"))
    (tmp_path / "l" / "a.jsonl").unlink()
    done = index.refresh(str(tmp_path / "l"))
    assert (done.added, done.modified, done.deleted) == (1, 1, 1)
    tables = {n: sorted(map(str, t.collect())) for n, t in index.tables().items() if n != "sessions"}
    index.rebuild(str(tmp_path / "l"))
    assert tables == {n: sorted(map(str, t.collect())) for n, t in index.tables().items() if n != "sessions"}
    assert index.refresh(str(tmp_path / "l")).unchanged == 2


def test_open_turn_and_secrets(spark, tmp_path, project):
    lines = [header("o"), message("u", None, "user", "rotate key sk-abcdefghijklmnopqrstuvwxyz123456 and password=supersecretvalue99"), message("a", "u", "assistant", [text("ok"), call("t", "bash", command="curl -H 'Bearer abc.def'")])]
    write(tmp_path / "l", "o_live.jsonl", lines, tail='{"type": "mess')
    index = Index(spark, str(tmp_path / "i"), project)
    index.refresh(str(tmp_path / "l"), active_id="o_live")
    row = index.tables()["chunks"].first()
    assert row["status"] == "open"
    assert row["user_text"] == "rotate key [REDACTED_API_KEY] and [REDACTED_CREDENTIAL]"
    assert "abc.def" not in index.tables()["trace_steps"].first()["target"]
    assert index.tables()["sessions"].first()["incomplete_trailing"]
    index.refresh(str(tmp_path / "l"), active_id=None)
    assert index.tables()["chunks"].first()["status"] == "complete"


def test_another_project_is_refused(spark, built):
    with pytest.raises(IndexMismatch):
        Index(spark, str(built[0].path), S.project_of("/other"))


def test_lease(spark, tmp_path):
    import socket

    from turnstone.plans import lease
    from turnstone.plans.files import Files

    files = Files(spark, str(tmp_path))
    first = lease.acquire(files)
    assert first is not None and lease.acquire(files) is None
    assert first.release() and not first.release()
    for said, free in (({"pid": 2**22 + 7}, True), ({"pid": 1}, False), ({"pid": 2**22 + 7, "host": "elsewhere"}, False), ({"pid": 2**22 + 7, "host": socket.gethostname()}, True), (None, False)):
        files.delete("writer.lock")
        files.create("writer.lock", "{" if said is None else json.dumps(said | {"token": "x"}))
        assert (lease.acquire(files) is not None) == free


def test_files(spark, tmp_path):
    from turnstone.plans.files import Files

    files = Files(spark, str(tmp_path / "f"))
    assert files.names() == [] and files.read("a") is None and files.age("a") is None and not files.delete("a")
    assert files.create("a", "é1") and not files.create("a", "2") and files.read("a") == "é1"
    files.replace("a", "3", "b")
    assert files.read("a") == "3" and files.names() == ["a"] and files.age("a") < 60


def test_a_failed_build_publishes_nothing(spark, tmp_path, project, monkeypatch):
    from turnstone.plans import index as module

    write(tmp_path / "l", "a.jsonl", delivery("a"))
    index = Index(spark, str(tmp_path / "i"), project)
    index.refresh(str(tmp_path / "l"))
    was, names = index.meta(), index.files.names()
    write(tmp_path / "l", "b.jsonl", delivery("b"))
    monkeypatch.setattr(module, "check", lambda tables: {"orphan_rows": 1})
    with pytest.raises(IndexMismatch):
        index.refresh(str(tmp_path / "l"))
    assert index.meta() == was and index.files.names() == names
    monkeypatch.undo()
    assert index.refresh(str(tmp_path / "l")).chunks == 4


def test_integrity(built):
    from turnstone.plans.index import check

    tables = built[0].tables()
    assert not any(check(tables).values())
    assert check(tables | {"postings": tables["postings"].limit(0)})["chunks_without_postings"] == 2
    assert check(tables | {"chunks": tables["chunks"].limit(1)})["orphan_rows"] > 0


def test_files_that_are_left_out_are_known(spark, tmp_path, project, monkeypatch):
    write(tmp_path / "l", "a.jsonl", delivery("a"))
    write(tmp_path / "l", "blank.jsonl", [], tail="\n")
    write(tmp_path / "l", "big.jsonl", [header("big"), message("u", None, "user", "x" * 9000)])
    monkeypatch.setattr(S, "MAX_FILE_BYTES", 8000)
    index = Index(spark, str(tmp_path / "i"), project)
    done = index.refresh(str(tmp_path / "l"))
    assert (done.added, done.rejected, done.too_large) == (3, 2, 1)
    assert index.refresh(str(tmp_path / "l")).unchanged == 3


def test_status_tells_settings_and_figures(spark, built):
    from turnstone.plans.settings import Settings

    row = built[0].status(Settings(min_relevance=55)).first()
    assert (row["min_relevance"], row["enabled"], row["chunks"], row["indexed_sessions"], row["skipped_foreign"], row["skipped_missing_cwd"]) == (55, True, 2, 1, 1, 0)
    assert built[0].status(Settings(enabled=False)).first()["chunks"] == 0


def test_settings(tmp_path):
    from turnstone.plans import settings

    (tmp_path / "u.json").write_text(json.dumps({"minRelevance": 150.4, "freshnessHighDays": 40, "enabled": "yes"}))
    (tmp_path / "p.json").write_text("[1]")
    got = settings.load(tmp_path / "u.json", tmp_path / "p.json")
    assert (got.min_relevance, got.enabled, got.freshness_medium_days) == (100, True, 40)
    settings.save(tmp_path / "p.json", {"minConfidence": 5})
    assert settings.load(tmp_path / "u.json", tmp_path / "p.json").min_confidence == 5


def test_stream_refreshes(spark, tmp_path, project):
    from turnstone.streaming.refresh import follow

    write(tmp_path / "l", "a.jsonl", delivery("a"))
    index = Index(spark, str(tmp_path / "i"), project)
    follow(index, str(tmp_path / "l"), str(tmp_path / "c"), available_now=True).awaitTermination(120)
    assert index.tables()["chunks"].count() == 2


def test_replaced_content_is_seen_by_content(spark, tmp_path, project):
    import os

    from turnstone.operators import manifest

    write(tmp_path / "l", "a.jsonl", delivery("a"))
    at = tmp_path / "l" / "a.jsonl"
    was = {b: S.list_files(spark, str(tmp_path / "l"), by_content=b).collect() for b in (False, True)}
    stat = at.stat()
    at.write_text(at.read_text().replace("Running", "Walking"))
    os.utime(at, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    for by_content, seen in ((False, "unchanged"), (True, "modified")):
        now = S.list_files(spark, str(tmp_path / "l"), by_content=by_content)
        assert manifest.manifest_diff(spark.createDataFrame(was[by_content], now.schema), now).first()["change"] == seen


def test_commands(spark, tmp_path):
    from turnstone.plans import commands
    from turnstone.plans.index import index_path

    root = tmp_path / "p"
    root.mkdir()
    write(tmp_path / "l", "a.jsonl", [header("a", str(root)), message("u", None, "user", "where is the parser"), message("v", "u", "assistant", [text("In `parse_tree`.")])])
    history = commands.history_of(spark, str(root), str(tmp_path / "l"))
    assert str(history.index.path) == index_path(str(root), "/nowhere") and commands.history_of(spark, str(root), str(tmp_path / "l")) is history
    found = history.search_project_history("parser", now_ms=0).collect()
    assert [r["user_entry_id"] for r in found] == ["u"] and list(found[0]["symbols"]) == ["parse_tree"]
    assert history.read_project_history(found[0]["chunk_id"]).first()["assistant_text"] == "In `parse_tree`."
    assert "In `parse_tree`." in history.read_as_text(found[0]["chunk_id"]) and "No chunk x" in history.read_as_text("x")
    assert history.status().first()["chunks"] == 1
    assert history.clear() and history.index.tables() is None
    assert commands.main(["off", "--root", str(root), "--logs", "l", "--index", "i"]) == 0
    assert commands.main(["query", "parser", "--root", str(root), "--logs", "l", "--index", "i"]) == 1
    assert commands.parsed(["how", "to"]) == ("query", ["how", "to"]) and commands.parsed(["Status"]) == ("status", [])
    assert commands.parsed([], ask=lambda cs: cs[-1]) == ("help", []) and commands.parsed([]) == ("help", [])
    assert commands.completions("re") == ["read", "rebuild"] and all(c in commands.help_text() for c in commands.COMMANDS)
    commands.forget()
