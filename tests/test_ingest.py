"""The bucketed store, the ledger and the merge: nothing lost, nothing changed by running again, one writer a commit."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyrank.sources.buckets import BucketStore
from tallyrank.sources.commits import CommitLog, Conflict
from tallyrank.sources.store import PoolStore
from tallyrank.streaming import ingest

PARSED = "name string, current_title string, skills_listed array<string>, archive string, source_file string, digest string, error string"


def rows_of(spark, *rows):
    return spark.createDataFrame([(n, t, s, "z", f, "", e) for n, t, s, f, e in rows], PARSED)


def pool(store):
    return {r["name"]: r for r in ingest.pool_of(store).collect()}


class Lines:
    """Parses a text by its lines; texts that hold 'bad' can't be parsed."""

    def parse(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("unreadable")
        return [{"name": t.split("\n")[0], "current_title": t.split("\n")[1]} for t in texts]


def archive(path, **entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/"), text)
    path.write_bytes(data.getvalue())


def test_equal_base_names_both_enter(spark, tmp_path):
    store, parse = BucketStore(spark, str(tmp_path / "pool"), 4), ingest.parsed_resumes(Lines(), [lambda b: b.decode()])
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in" / "one.zip", **{"ann__resume.pdf": "Ann Lee\nDev", "cyd__resume.pdf": "Cyd Fox\nDev"})
    ingest.ingest_batch(store, parse(spark.read.format("binaryFile").load(str(tmp_path / "in" / "one.zip"))))
    archive(tmp_path / "in" / "two.zip", **{"bob__resume.pdf": "Bob Ray\nDev", "ann\\resume.pdf": "Dee Poe\nDev", "__MACOSX\\._x.pdf": "junk"})
    told = ingest.ingest_batch(store, parse(spark.read.format("binaryFile").load(str(tmp_path / "in" / "two.zip"))))
    assert told == {"total": 2, "skipped": 0, "parsed": 2, "failed": 0}
    assert {n: r["source_file"] for n, r in pool(store).items()} == {"Ann Lee": "ann/resume.pdf", "Cyd Fox": "cyd/resume.pdf", "Bob Ray": "bob/resume.pdf", "Dee Poe": "ann/resume.pdf"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 4)
    batch = rows_of(spark, ("Ann Lee", "Junior Dev", ["b "], "a.pdf", None), ("ann lee", "Lead Dev", ["a", "b"], "b.pdf", None), ("unknown", "Dev", [], "c.pdf", None), (None, None, [], "d.pdf", "bad"))
    ingest.ingest_batch(store, batch)
    before = sorted(map(repr, ingest.pool_of(store).collect()))
    ann = pool(store)["Ann Lee"]
    assert (ann["current_title"], ann["skills_listed"], ann["source_file"], len(before)) == ("Lead Dev", ["b", "a"], "b.pdf", 2)
    assert ingest.ingest_batch(store, batch) == {"total": 4, "skipped": 3, "parsed": 0, "failed": 1}
    assert sorted(map(repr, ingest.pool_of(store).collect())) == before and ingest.failures(store).count() == 1


def test_a_committed_batch_is_left_alone(spark, tmp_path):
    """As after a crash between the commit and the stream's own mark: the figures are those of the first run."""
    store = BucketStore(spark, str(tmp_path), 4)
    batch = rows_of(spark, ("Ann Lee", "Dev", [], "a", None), (None, None, [], "b", "bad"))
    first = ingest.ingest_batch(store, batch, 7)
    assert first["parsed"] == 1 and ingest.ingest_batch(store, batch, 7) == {} and store.snapshot().number == 1
    assert [(r["batch"], r["parsed"], r["failed"]) for r in store.read("batches").collect()] == [(7, 1, 1)]
    assert ingest.ingest_batch(store, batch, 0, "another query")["skipped"] == 1


def test_thirty_failures_are_named_and_run_again(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "pool"), 4)
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in" / "one.zip", **{f"d{i}__resume.pdf": f"Person {i}\nbad" for i in range(30)}, good="x", **{"ok.pdf": "Ann Lee\nDev"})
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    parse = ingest.parsed_resumes(Lines(), [lambda b: b.decode()])
    assert ingest.ingest_batch(store, parse(files))["failed"] == 30
    event = ingest.progress_event(store)
    assert ingest.failures(store).count() == 30 and (event["failed"], len(event["failed_files"])) == (30, 20)
    mended = ingest.parsed_resumes(type("All", (), {"parse": lambda self, texts: [{"name": t.split("\n")[0]} for t in texts]})(), [lambda b: b.decode()])
    assert ingest.run_failed(store, mended) == {"total": 30, "skipped": 0, "parsed": 30, "failed": 0}
    assert ingest.failures(store).count() == 0 and len(pool(store)) == 31 and ingest.run_failed(store, mended) == {}


def test_merge_keeps_what_a_later_file_lacks(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 4)
    ingest.ingest_batch(store, rows_of(spark, ("Ann Lee", "Lead", ["a"], "a", None), ("Bo Kim", None, None, "b", None)))
    ingest.ingest_batch(store, rows_of(spark, (" ann LEE ", None, ["b"], "c", None), ("Cyd Fox", "Dev", [], "d", None)))
    rows = pool(store)
    assert rows["Ann Lee"]["current_title"] == "Lead" and rows["Ann Lee"]["skills_listed"] == ["a", "b"] and rows["Bo Kim"]["current_title"] == "Software Engineer"
    assert [rows[n]["candidate_id"] for n in ("Ann Lee", "Bo Kim", "Cyd Fox")] == ["cand_0001", "cand_0002", "cand_0003"]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 16)
    ingest.ingest_batch(store, rows_of(spark, *((f"Person {i}", "Dev", [], f"f{i}", None) for i in range(60))))
    before = store.snapshot()
    ingest.ingest_batch(store, rows_of(spark, ("Person 7", "Lead", [], "g", None)))
    after = store.snapshot()
    changed = [b for b in before.files["pool"] if before.files["pool"][b] != after.files["pool"][b]]
    assert len(changed) == 1 and len(before.files["pool"]) > 10 and store.read("pool", before).count() == 60
    assert store.vacuum() == 0 or store.read("pool").count() == 60
    assert pool(store)["Person 7"]["current_title"] == "Lead" and len(pool(store)) == 60


def test_vacuum_keeps_the_last_commits(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 1)
    for i in range(3):
        ingest.ingest_batch(store, rows_of(spark, (f"Person {i}", "Dev", [], f"f{i}", None)))
    assert store.vacuum(keep=2) > 0 and store.log.numbers() == [2, 3] and store.read("pool", store.snapshot(2)).count() == 2
    ingest.ingest_batch(store, rows_of(spark, ("Person 9", "Dev", [], "f9", None)))
    assert store.snapshot().number == 4 and len(pool(store)) == 4


def test_two_writers_give_one_error(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "b"), 2)
    rows = spark.createDataFrame([(0, "x"), (1, "y")], "bucket int, v string")
    since = store.snapshot()
    store.commit(since, {"t": (rows, [0, 1])})
    with pytest.raises(Conflict):
        store.commit(since, {"t": (rows, [0, 1])})
    assert store.read("t").count() == 2 and store.snapshot().number == 1
    with pytest.raises(ValueError):
        store.commit(store.snapshot(), {"t": (rows, [0])})

    class Late(PoolStore):  # another writer commits while this one writes
        def write(self, pool):
            self.log.last, last = (lambda told=self.log.last(): told), self.log.last
            PoolStore(spark, self.path).write(pool)
            try:
                return super().write(pool)
            finally:
                self.log.last = last

    with pytest.raises(Conflict):
        Late(spark, str(tmp_path / "p")).write(rows)
    assert PoolStore(spark, str(tmp_path / "p")).read().count() == 2


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == (0, None)
    log.append(1, {"a": "ä"})
    for _ in range(2):
        with pytest.raises(Conflict):
            log.append(1, {"a": 2})
    assert log.last() == (1, {"a": "ä"}) and log.numbers() == [1]
    log._local = False  # as on other file systems
    with pytest.raises(Conflict):
        log.append(1, {"a": 3})
    log.append(2, {"a": 4})
    assert log.last() == (2, {"a": 4}) and sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")) == ["000000000001", "000000000002"]
    with pytest.raises(FileNotFoundError):
        open(tmp_path / "log" / "none")


def test_empty_batches(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 4)
    assert ingest.ingest_batch(store, rows_of(spark)) == {"total": 0, "skipped": 0, "parsed": 0, "failed": 0}
    assert ingest.pool_of(store).count() == 0 and ingest.failures(store).count() == 0
    assert ingest.progress_event(store)["percent"] == 100
    clash = rows_of(spark, ("Ann Lee", "Dev", [], "a", None)).withColumns({"bucket": F.lit(99), "person": F.lit("x"), "row": F.lit("y"), "place": F.lit(1), "total": F.lit(2)})
    assert ingest.ingest_batch(store, clash)["parsed"] == 1 and len(pool(store)) == 1
