"""Trees listed, read, deleted and written by tasks; the mirror as a transaction."""

import json
import os
import random
import time

import pytest
from pyspark.errors import PySparkException

from tidemark.operators import mirror, state
from tidemark.plans import records
from tidemark.sources import tree
from tidemark.sources.corpus import list_files

OUTPUT = "relpath string, output binary"


def test_listing(spark, tmp_path):
    rng = random.Random(3)
    for i in range(200):
        at = tmp_path / "/".join([rng.choice(["a", "b", ".c", "_d"]) for _ in range(rng.randint(0, 4))]) / f"{i}{rng.choice(['.txt', '.jsonl', '.md', ''])}"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * rng.randint(0, 9))
    (tmp_path / "empty" / "deep").mkdir(parents=True)
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "linked.txt").symlink_to(next(tmp_path.rglob("*.txt")))
    listed = tree.list_tree(spark, str(tmp_path))
    assert sorted(map(tuple, listed.collect())) == list_files(str(tmp_path))
    everything = tree.list_tree(spark, str(tmp_path), None)
    assert everything.count() == sum(len(names) for _, _, names in os.walk(tmp_path))
    assert tree.list_tree(spark, str(tmp_path / "none")).count() == 0
    read = {r.relpath: bytes(r.content) for r in tree.read_files(listed, str(tmp_path)).collect()}
    assert read == {rel: (tmp_path / rel).read_bytes() for rel, *_ in list_files(str(tmp_path))}
    gone = tree.delete_files(listed.where("suffix = '.jsonl'"), str(tmp_path))
    assert gone.count() == listed.where("suffix = '.jsonl'").count()
    assert not list(tmp_path.rglob("*.jsonl"))


def test_large_texts_are_not_opened(spark, tmp_path, monkeypatch):
    for name in ("large.txt", "large.jsonl", "even.txt"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(mirror.MOST_TEXT_BYTES + (name != "even.txt"))
    files = tree.read_files(tree.list_tree(spark, str(tmp_path)), str(tmp_path), mirror.MOST_TEXT_BYTES)
    assert {r.relpath: r.n for r in files.selectExpr("relpath", "length(content) as n").collect()} == {"large.txt": None, "large.jsonl": mirror.MOST_TEXT_BYTES + 1, "even.txt": mirror.MOST_TEXT_BYTES}
    found = {r.relpath: r.error for r in mirror.redact_files(files.where("relpath = 'large.txt'")).collect()}
    assert found == {"large.txt": f"OversizeTextError: {mirror.MOST_TEXT_BYTES + 1} bytes"}


def test_all_files_or_none(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"d{i % 3}/{i}.jsonl", bytearray(json.dumps({"n": i}).encode() + b"\n")) for i in range(40)]
    tree.write_tree(spark.createDataFrame(rows, OUTPUT).repartition(5), root)
    assert {rel: (tmp_path / "out" / rel).read_bytes() for rel, *_ in list_files(root)} == {rel: bytes(data) for rel, data in rows}
    before = sorted(os.listdir(tmp_path))
    assert before == ["out"]
    for bad in (b'{"a": 1}\nnot json\n', b'"\xff"\n'):
        again = [(rel, bytearray(b"{}\n")) for rel, _ in rows] + [("d9/bad.jsonl", bytearray(bad))]
        with pytest.raises(PySparkException):
            tree.write_tree(spark.createDataFrame(again, OUTPUT).repartition(5), root)
        assert {rel: (tmp_path / "out" / rel).read_bytes() for rel, *_ in list_files(root)} == {rel: bytes(data) for rel, data in rows}
        end = time.monotonic() + 10  # tasks of the failed job may still be at work
        while list(tmp_path.rglob("*.tmp")) and time.monotonic() < end:
            time.sleep(0.1)
        assert not list(tmp_path.rglob("*.tmp"))
        assert sorted(os.listdir(tmp_path)) == before


def test_a_task_that_runs_again_leaves_one_copy(tmp_path):
    writer = tree.TreeWriter({"path": str(tmp_path / "out")})
    rows = [{"relpath": "a.txt", "output": b"one"}, {"relpath": "b/c.txt", "output": b"two"}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    other = writer.write(iter([{"relpath": "z.txt", "output": b"three"}]))
    assert lost.files == kept.files == 2
    assert len(list(tmp_path.rglob("*.tmp"))) == 5
    writer.commit([kept, other])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/a.txt", "out/b/c.txt", "out/z.txt"]
    writer = tree.TreeWriter({"path": str(tmp_path / "out")})
    writer.write(iter([{"relpath": "a.txt", "output": b"changed"}]))
    writer.abort([])
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"one"
    assert not list(tmp_path.rglob("*.tmp"))


def test_no_target_leads_back_into_the_source(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "mirror"
    (source / "d").mkdir(parents=True)
    (source / "d" / "a.txt").write_text("write to jo@site.example\n")
    target.mkdir()
    (target / "d").symlink_to(source / "d")
    with pytest.raises(PySparkException, match="is inside"):
        mirror.build_mirror(spark, str(source), str(target))
    assert (source / "d" / "a.txt").read_text() == "write to jo@site.example\n"
    assert os.listdir(source / "d") == ["a.txt"]


def test_strange_files_in_the_mirror_are_an_error(spark, tmp_path):
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "a.txt").write_text("x\n")
    (tmp_path / "mirror").mkdir()
    (tmp_path / "mirror" / "note.md").write_text("x")
    with pytest.raises(AssertionError, match="note.md"):
        mirror.build_mirror(spark, str(tmp_path / "source"), str(tmp_path / "mirror"))


def test_build_command(spark, tmp_path, monkeypatch, capsys):
    from tidemark import cli, session

    monkeypatch.setattr(session, "local_session", lambda: spark)
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "a.txt").write_text("write to jo@site.example\n")
    (tmp_path / "source" / "b.jsonl").write_text('{"x": 1}\n')
    args = ["build", str(tmp_path / "source"), str(tmp_path / "out" / "mirror"), "--runs", str(tmp_path / "runs")]
    assert cli.main(args) == 0
    said = json.loads(capsys.readouterr().out)
    assert (said["files_processed"], said["failed"]) == (2, False)
    assert (tmp_path / "out" / "mirror" / "a.txt").read_text() == "write to [EMAIL_ADDRESS]\n"
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["skip_ceiling_exceeded"] is False
    (tmp_path / "source" / "b.jsonl").write_text('{"x": \n{}\n')
    assert cli.main(args) == 1


def test_redaction_log(tmp_path):
    path = str(tmp_path / "log" / "redactions.jsonl")
    state.log_redactions(path, {"EMAIL_ADDRESS": 2})
    state.log_redactions(path, {})
    entries = [json.loads(x) for x in open(path, encoding="utf-8")]
    assert [e["counts"] for e in entries] == [{"EMAIL_ADDRESS": 2}, {}]
    assert all(set(e) == {"at", "counts"} for e in entries)


@pytest.mark.parametrize(("most", "parts"), [(1_000_000, 10), (3_000_000_000, 1)])
def test_a_tree_in_parts(spark, monkeypatch, most, parts):
    """All notes are mirrored, part by part, and a part's files are gone before the next one is written."""
    count = lambda at: sum(len(names) for _, _, names in os.walk(at))
    roots, held, build = [], [], mirror.build_mirror

    def counted(spark, source, target):
        assert all(count(root) == 0 for root in roots)
        roots.append(os.path.dirname(source))
        held.append(count(source))
        return build(spark, source, target)

    monkeypatch.setattr(mirror, "build_mirror", counted)
    monkeypatch.setattr(records, "_PART_BYTES", most, raising=False)
    rows = records.mirrored_files(spark, "/root/testdata/sf0.001").collect()
    assert (len(held), sum(held), len({r.relpath for r in rows}), len(rows)) == (parts, 150, 150, 150)
    assert [(r.relpath, r["size"], r.hash) for r in rows if r.error == "OversizeTextError"] == [("d0/0.txt", -1, "none")]
    assert all(count(root) == 0 for root in roots)
