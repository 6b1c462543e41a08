"""File, registry and version-control sources on temporary folders."""

import subprocess

from lumenvault.sources import files
from lumenvault.sources.git import GitSource


def test_files_search_and_manifest(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"a.py": b"x = 1\nNeedle here\n", "sub/b.c": b"int main(void) {}\nneedle\n", "node_modules/c.py": b"needle\n", ".hidden/d.py": b"needle\n", "e.png": b"needle", "bin.py": b"\0needle", "cut.py": b"caf\xc3"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    rows = files.files(spark, str(root))
    assert {r.file for r in rows.select("file").collect()} == {"a.py", "sub/b.c", "bin.py", "cut.py"}
    text = files.sources(rows)
    assert {r.file for r in text.select("file").collect()} == {"a.py", "sub/b.c"}
    assert [(r.file, r.line, r.truncated) for r in files.grep(text, "needle").orderBy("file").collect()] == [("a.py", 2, False), ("sub/b.c", 2, False)]
    assert [r.truncated for r in files.grep(text, "needle", most=1).collect()] == [True]
    assert files.grep(text, "main(void", most=None).count() == 1  # doesn't compile, so it is literal
    files.write_manifest(files.manifest(rows), str(tmp_path / "manifest"), "model")
    assert files.read_manifest(spark, str(tmp_path / "manifest")).count() == 4
    assert files.read_manifest(spark, str(tmp_path / "none")) is None


def test_eval_set_and_registry(spark, tmp_path):
    (tmp_path / "set.jsonl").write_text('{"query": "q", "gold": ["a"], "tier": "L1"}\n\n')
    assert [(r.query, r.gold) for r in files.eval_set(spark, str(tmp_path / "set.jsonl")).collect()] == [("q", ["a"])]
    old = files.registry(spark, [{"name": "a", "url": "u", "role": "baseline", "odd": 1}, {"name": "b", "role": "what"}])
    new = files.registry(spark, [{"name": "a", "branch": "main", "role": "baseline"}, {"name": "c"}])
    got = {r.name: r for r in files.upsert_registry(old, new).collect()}
    assert got["a"].url == "u" and got["a"].branch == "main" and got["b"].role == "unmanaged" and set(got) == {"a", "b", "c"}


def test_git_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.txt").write_text("one\n")
    git("add", "."), git("commit", "-qm", "first")
    (tmp_path / "b.txt").write_text("two\n")
    spark.dataSource.register(GitSource)
    load = lambda what: spark.read.format("git").option("what", what).load(str(tmp_path)).collect()
    assert [r.file for r in load("files")] == ["a.txt", "b.txt"]
    assert [(r.author, r.subject) for r in load("log")] == [("n", "first")]
    assert len(load("patches")) == 1
