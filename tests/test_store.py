"""The stored key-value table and the application of previews."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import apply
from quillmesh.sources.store import KeyValueStore

ENTRY = "key string, value string, fetched_at string"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def held(df):
    return {r.key: r.value for r in df.collect()}


def test_newest_entries_count_and_old_ones_expire(spark, tmp_path):
    store = KeyValueStore(spark, str(tmp_path / "kv"))
    assert store.read().count() == 0 and store.compact() is None
    store.append(entries(spark, [("a", "1", "2024-01-01"), ("b", "1", "2024-01-01"), (None, "x", "2024-01-01"), ("a", "0", "2023-01-01")]))
    store.append(entries(spark, [("a", "2", "2024-03-01"), ("c", None, "2024-03-01"), ("b", "0", "2023-01-01")]))
    assert held(store.read()) == {"a": "2", "b": "1", "c": None}
    assert held(store.read(since="2024-02-01")) == {"a": "2", "c": None}
    keys = spark.createDataFrame([("a",), ("b",), ("z",), ("a",), (None,)], "k string")
    assert sorted(((r.k, r.value) for r in store.lookup(keys, "k", since="2024-02-01").collect()), key=str) == sorted([("a", "2"), ("b", None), ("z", None), ("a", "2"), (None, None)], key=str)
    assert sorted(r.key for r in store.missing(keys, "k", since="2024-02-01").collect()) == ["b", "z"]


def test_readers_do_not_notice_compaction(spark, tmp_path):
    store = KeyValueStore(spark, str(tmp_path / "kv"), buckets=4)
    for i in range(5):
        store.append(entries(spark, [(f"k{j}", f"{i}", f"2024-01-0{i + 1}") for j in range(i, 20)]))
    begun = store.read()  # planned before the compaction, read after it
    want = held(store.read())
    name = store.compact()
    assert store.runs() == [name] and held(store.read()) == want == held(begun)
    assert store.vacuum(0) == [] and len(store.vacuum(int(time.time() * 1000) + 10_000)) == 5
    assert held(store.read()) == want
    store.compact(since="2024-01-04")
    assert held(store.read()) == {k: v for k, v in want.items() if v >= "3"}
    empty = KeyValueStore(spark, str(tmp_path / "empty"))
    empty.append(entries(spark, []))
    empty.append(entries(spark, [("a", "1", "2024-01-01")]))
    assert held(empty.read()) == {"a": "1"}


def test_two_writers_and_two_compactions(spark, tmp_path):
    stores = [KeyValueStore(spark, str(tmp_path / "kv")) for _ in range(2)]
    frames = [entries(spark, [(f"{who}{i}", f"{who}", "2024-01-01"), ("both", f"{who}", "2024-01-02")]) for who in "xy" for i in range(3)]
    threads = [threading.Thread(target=stores[i % 2].append, args=(f,)) for i, f in enumerate(frames)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    want = {f"{w}{i}": w for w in "xy" for i in range(3)} | {"both": "y"}
    assert len(stores[0].runs()) == 6 and held(stores[0].read()) == want
    threads = [threading.Thread(target=s.compact) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert held(stores[0].read()) == want
    stores[0].compact()
    assert held(stores[1].read()) == want


def vault(tmp_path, notes):
    for path, text in notes.items():
        full = tmp_path / "vault" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    return str(tmp_path / "vault")


def texts(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, fs in os.walk(folder) for f in fs}


OLD = {"a.md": "one", "dir/b +c.md": "two\nlines", "keep.md": "same", "é.md": "x"}
NEW = {"a.md": "ONE", "dir/b +c.md": "TWO", "keep.md": "same", "é.md": "y", "new/d.md": "four", "p%20q.md": "five", "empty.md": ""}
WRITTEN = {k: v for k, v in NEW.items() if v}


def frames(spark, folder):
    return apply.notes_in(spark, folder), spark.createDataFrame(list(NEW.items()), "path string, text string")


def test_apply_reports_batches_and_goes_back(spark, tmp_path):
    folder = vault(tmp_path, OLD)
    before, after = frames(spark, folder)
    assert {r.path: r.text for r in before.collect()} == OLD
    report = apply.apply_preview(before, after, folder, str(tmp_path / "log"), 3).collect()
    assert {r.state for r in report} == {"written"} and sum(r.n for r in report) == 5
    assert texts(folder) == WRITTEN
    (tmp_path / "vault" / "a.md").write_text("mine")
    left = apply.roll_back(spark, folder, str(tmp_path / "log")).collect()
    assert [(r.path, r.state) for r in left] == [("a.md", "foreign")]
    assert texts(folder) == OLD | {"a.md": "mine"}


def test_a_note_changed_in_between_stops_the_apply(spark, tmp_path):
    folder = vault(tmp_path, OLD)
    before, after = frames(spark, folder)
    seen = spark.createDataFrame([(r.path, r.text) for r in before.collect()], "path string, text string")
    (tmp_path / "vault" / "é.md").write_text("someone else")
    with pytest.raises(apply.NotesChanged, match="é.md"):
        apply.apply_preview(seen, after, folder, str(tmp_path / "log"))
    assert texts(folder) == OLD | {"é.md": "someone else"}


def test_a_failure_half_way_leaves_the_notes_as_they_were(spark, tmp_path):
    folder = vault(tmp_path, OLD)
    before, after = frames(spark, folder)
    late = after.union(spark.createDataFrame([("blocked/x.md", "never")], "path string, text string"))
    (tmp_path / "vault" / "blocked").write_text("a file where a folder should be")
    with pytest.raises(Exception, match="blocked|Not a directory|File exists"):
        apply.apply_preview(before, late, folder, str(tmp_path / "log"), 4)
    assert {k: v for k, v in texts(folder).items() if k.endswith(".md")} == OLD


def test_resume_after_a_crash(spark, tmp_path):
    folder = vault(tmp_path, OLD)
    before, after = frames(spark, folder)
    log = str(tmp_path / "log")
    apply.apply_preview(before, after, folder, log, 2)
    (tmp_path / "vault" / "a.md").write_text("one")  # as if this batch had never been written
    os.unlink(tmp_path / "vault" / "p%20q.md")
    states = {r.path: r.state for r in apply.states(apply._manifest(spark, log), apply.notes_in(spark, folder)).collect()}
    assert states == {"a.md": "pending", "p%20q.md": "pending", "dir/b +c.md": "written", "é.md": "written", "new/d.md": "written"}
    apply.resume(spark, folder, log)
    assert texts(folder) == WRITTEN
