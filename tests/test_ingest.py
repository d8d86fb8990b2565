"""A folder taken in as a stream: no file twice, whatever is restarted; what can't be read stands aside with its reason."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pytest

from tessera.sources import ingest


def rows(inbox, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in inbox.read(name).collect())


def test_a_folder_is_taken_in_once(spark, tmp_path, monkeypatch):
    folder, marks = tmp_path / "in", str(tmp_path / "marks")
    (folder / "sub").mkdir(parents=True)
    for name, data in {"a.md": b"# One\n\ntext", "b.txt": b"plain  ", "sub/c.HTML": b"<p>para</p>", "d.py": b"x = 1", "e.zip": b"PK", "f.txt": b"", "g.docx": b"no zip", "h.txt": b" \n ", "i.txt": b"plain"}.items():
        (folder / name).write_bytes(data)
        os.utime(folder / name, (1_700_000_000 + len(name), 1_700_000_000 + ord(name[-3])))
    inbox = ingest.Inbox(spark)
    inbox.follow(str(folder), marks, files_at_once=3).awaitTermination()
    assert [(n, r.split(":")[0]) for n, r in rows(inbox, "quarantine", "name", "reason")] == [("e.zip", "unsupported"), ("g.docx", "BadZipFile"), ("h.txt", "no text")]
    queue = rows(inbox, "queue", "file_path", "status")
    assert [n for n, _ in queue] == ["a.md", "b.txt", "c.HTML", "d.py", "i.txt"] and sorted(s for n, s in queue if n in ("b.txt", "i.txt")) == ["failed", "pending"]
    assert len(rows(inbox, "files", "path")) == 8 and len(set(rows(inbox, "queue", "track"))) > 1
    (folder / "j.md").write_bytes(b"new one")
    inbox.follow(str(folder), marks).awaitTermination()  # started again
    assert len(rows(inbox, "files", "path")) == 9
    inbox.follow(str(folder), str(tmp_path / "other"), stream="again").awaitTermination()  # its checkpoint lost: all files come again
    assert len(rows(inbox, "files", "path")) == 9 and len(rows(inbox, "queue", "id")) == 6
    time.sleep(0.01)
    (folder / "a.md").write_bytes(b"# One\n\nchanged")
    inbox.follow(str(folder), str(tmp_path / "third"), stream="third").awaitTermination()
    assert len([1 for (n,) in rows(inbox, "queue", "file_path") if n == "a.md"]) == 2  # a changed file is a new one


def test_a_batch_that_dies_or_comes_again_gives_no_second_row(spark, tmp_path, monkeypatch):
    Path(tmp_path, "in").mkdir()
    for i in range(4):
        Path(tmp_path, "in", f"{i}.txt").write_text(f"text {i}")
    inbox = ingest.Inbox(spark)
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(inbox.tables), "commit", dies)
        with pytest.raises(RuntimeError):
            inbox.take(files, 0, "s")
    assert inbox.tables.state().version == 0
    assert inbox.take(files, 0, "s") and not inbox.take(files, 0, "s") and inbox.take(files, 1, "s")
    assert len(rows(inbox, "queue", "id")) == 4 and len(rows(inbox, "files", "path")) == 4
    empty = spark.createDataFrame([("x/y.txt", 0, b"")], "path string, length long, content binary").selectExpr("*", "timestamp'2024-01-01' as modificationTime")
    assert inbox.take(empty, 2, "s") and rows(inbox, "quarantine", "name", "reason") == [("y.txt", "empty file")]
