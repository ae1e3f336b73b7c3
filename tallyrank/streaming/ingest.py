"""Streaming ingest: each micro-batch is parsed, what the ledger knows is skipped, the rest is merged into the pool.

The pool, the ledger and the batches' figures are tables of one ``BucketStore`` and change in one commit, so a crash leaves all or
none of a batch. The ledger tells files apart by archive, path in it and a digest of the content; a file that was parsed is
never merged again, one that failed is tried again whenever it comes. A batch of a query is committed once: its number stands
in the commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators.parsing import FIELDS, parse_files
from tallyrank.operators.pool import COLUMNS, HISTORY, clean_records, merge_buckets, person_key, with_new_ids
from tallyrank.sources.buckets import BucketStore
from tallyrank.sources.candidates import extract_text, zip_entries
from tallyrank.sources.store import written

FILES_PER_BATCH = 15
KEY = ("archive", "source_file", "digest")
LEDGER = "bucket int, archive string, source_file string, digest string, state string, batch long, error string"
POOL = f"bucket int, candidate_id string, name string, name_not_extracted boolean, current_title string, years_experience double, career_history {HISTORY}, skills_listed array<string>, last_active string, education string, location string, resume_text string, source_file string"
BATCHES = "bucket int, batch long, total long, skipped long, parsed long, failed long, percent long"


def _known(store: BucketStore, table: str, schema: str, at, only: list[int]) -> DataFrame:
    found = store.read(table, at, only)
    return store.spark.createDataFrame([], schema) if found is None else found


def ingest_batch(store: BucketStore, rows: DataFrame, batch: int | None = None, query: str = "ingest") -> dict:
    """Merges parsed rows into the pool and gives the batch's figures (total, skipped, parsed, failed).

    ``rows`` have record fields, source_file (the whole path in its archive), error (null where the file was parsed), and may have
    archive and digest, without which a file is known by its path alone. A file that comes twice in a batch counts and merges once.
    A ``batch`` that the query has committed is left alone; so are figures and pool where every file is known.
    ``Conflict`` is raised where another writer committed meanwhile.
    """
    at = store.snapshot()
    if batch is not None and at.values.get("done", {}).get(query, -1) >= batch:
        return {}
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in KEY]
    rows = rows.select(*(c for c in rows.columns if c not in KEY), *given)
    rows = rows.withColumn("row", F.concat_ws("\x1f", *KEY)).withColumn("place", store.bucket(F.col("row"), at))
    once = F.row_number().over(W.partitionBy("row").orderBy("place"))
    rows = clean_records(rows.withColumn("__nth", once).filter("__nth = 1")).select("place", "row", *KEY, "error", *(c for c in COLUMNS if c not in ("candidate_id", "source_file")))
    person = person_key(rows)
    rows = written(rows.withColumn("person", person).withColumn("bucket", store.bucket(F.coalesce(F.concat(F.lit("p"), "person"), F.concat(F.lit("f"), "row")), at)), "parsed")
    files = store.touched(rows.select(F.col("place").alias("bucket")))
    ledger = _known(store, "ledger", LEDGER, at, files)
    rows = written(rows.join(ledger.select(*KEY, F.col("state").alias("was")), list(KEY), "left"), "seen")
    done = F.col("was").eqNullSafe("parsed")
    good = ~done & F.col("error").isNull()
    # only the ledger's entries of files that failed before are replaced
    again = F.collect_set(F.when(F.col("was") == "failed", F.col("place")))
    told = rows.agg(F.count("*").alias("total"), F.count_if(done).alias("skipped"), F.count_if(good).alias("parsed"), F.collect_set(F.when(good, F.col("bucket"))).alias("touched"), again.alias("again")).first()
    figures = {c: told[c] for c in ("total", "skipped", "parsed")}
    figures["failed"] = figures["total"] - figures["skipped"] - figures["parsed"]
    number = at.number + 1 if batch is None else batch
    changes, values = {}, {"done": {**at.values.get("done", {}), query: number}} if batch is not None else {}
    if figures["skipped"] < figures["total"]:
        entries = rows.filter(~done).select(F.col("place").alias("bucket"), *KEY, F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("state"), F.lit(number).cast("long").alias("batch"), "error")
        anew = sorted({*told["again"], *(b for b in store.crowded("ledger", at) if b in files)})
        before = [_known(store, "ledger", LEDGER, at, anew).join(entries.select(*KEY), list(KEY), "left_anti").select(*entries.columns)] if anew else []
        changes["ledger"] = (reduce(DataFrame.unionByName, before, entries), anew)
    if figures["parsed"]:
        touched, top = sorted(told["touched"]), at.values.get("top", 0)
        old = _known(store, "pool", POOL, at, touched)
        numbered, new = with_new_ids(rows.filter(good), old.select(person_key(old).alias("person")), top)
        changes["pool"] = (merge_buckets(old, numbered), touched)
        values["top"] = top + new
    counted = store.spark.createDataFrame([(number, *figures.values())], "batch long, total long, skipped long, parsed long, failed long")
    counted = counted.withColumn("percent", C.progress(F.col("parsed"), F.col("failed"), F.col("total"), F.col("skipped")).cast("long")).withColumn("bucket", F.lit(number % at.buckets))
    where = [number % at.buckets]
    before = _known(store, "batches", BATCHES, at, where)
    changes["batches"] = (before.unionByName(counted.select(*before.columns)), where)
    store.commit(at, changes, values, added={"ledger": files})
    return figures


def pool_of(store: BucketStore) -> DataFrame:
    """The pool's records."""
    return _known(store, "pool", POOL, store.snapshot(), None).select(*COLUMNS)


def failures(store: BucketStore) -> DataFrame:
    """(archive, source_file, digest, batch, error) of every file that failed when it was last tried."""
    return _known(store, "ledger", LEDGER, store.snapshot(), None).filter("state = 'failed'").select(*KEY, "batch", "error")


def run_failed(store: BucketStore, parse: Callable[[DataFrame], DataFrame]) -> dict:
    """Reads the archives and files that have failures again, parses them and merges what the ledger says has failed. Their paths, nothing
    else, go through the driver."""
    bad = failures(store)
    paths = [r["archive"] for r in bad.select("archive").distinct().collect()]
    if not paths:
        return {}
    rows = parse(store.spark.read.format("binaryFile").load(paths))
    return ingest_batch(store, rows.join(bad.select("archive", "source_file").distinct(), ["archive", "source_file"], "left_semi"))


def start_ingest(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], store: BucketStore, checkpoint: str):
    """A query that takes the files of a folder, ``FILES_PER_BATCH`` at a time, until none is left. It resumes from
    ``checkpoint``, whose query id stands for the query in the store. ``parse`` turns file rows (path, content) into parsed rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", FILES_PER_BATCH).load(path)

    def merge(batch: DataFrame, number: int) -> None:
        ingest_batch(store, parse(batch), number, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parsed_resumes(parser, extractors: list | None = None) -> Callable[[DataFrame], DataFrame]:
    """A parse function for PDFs and archives of them: text by the first extractor that finds any (``pdf_text`` where none are named), then ``parser``. A file is told by its
    archive and its whole path there."""

    def parse(files: DataFrame) -> DataFrame:
        archives = files.filter(F.lower("path").endswith(".zip"))
        single = files.filter(~F.lower("path").endswith(".zip")).select(F.col("path").alias("archive"), F.regexp_extract("path", r"([^/]+)$", 1).alias("entry"), "content", F.lit(None).cast("string").alias("error"))
        entries = extract_text(zip_entries(archives).unionByName(single), extractors).select("archive", F.coalesce("entry", F.lit("")).alias("source_file"), F.sha2("content", 256).alias("digest"), "content", "text", "error")
        entries = entries.withColumn("source_file", F.concat_ws("\x1f", "archive", "source_file", "digest"))  # the parser gives it back
        bad = entries.filter("error is not null").select("source_file", "error")
        rows = parse_files(entries.filter("error is null"), parser).drop("how").unionByName(bad, allowMissingColumns=True)
        parts = F.split("source_file", "\x1f")
        return rows.withColumns({"archive": F.get(parts, F.lit(0)), "digest": F.get(parts, F.lit(2)), "source_file": F.get(parts, F.lit(1))})

    return parse


def progress_event(store: BucketStore, running: bool = False, most_files: int = 20) -> dict:
    """The state of an ingest as a record: its batches' counts, percent and the first failed files (``failures`` has them all); the pool's
    size once it is over."""
    at = store.snapshot()
    sums = ("total", "skipped", "parsed", "failed")
    row = _known(store, "batches", BATCHES, at, None).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums)).first()
    event = {c: row[c] for c in sums}
    left = event["total"] - event["skipped"]
    shown = failures(store).select("source_file").distinct().orderBy("source_file").limit(most_files).collect()
    event |= {"failed_files": [r["source_file"] for r in shown], "percent": 100 if left <= 0 else min(100, (event["parsed"] + event["failed"]) * 100 // left), "status": "running" if running else "done"}
    if not running:
        event["total_candidate_count"] = pool_of(store).count()
    return event


def progress(query, store: BucketStore, every: float = 2.0) -> Iterator[dict]:
    """The events of a running ingest, one every so many seconds, and the last when it has ended."""
    while query.isActive:
        yield progress_event(store, running=True)
        query.awaitTermination(every)
    if query.exception() is not None:
        yield {**progress_event(store), "status": "error", "error_message": str(query.exception())}
    else:
        yield progress_event(store)


def json_resumes(files: DataFrame) -> DataFrame:
    """The default parser: a file is one JSON record; one that can't be read has an error."""
    rows = files.select(F.col("path").alias("archive"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), F.sha2("content", 256).alias("digest"), F.from_json(F.col("content").cast("string"), FIELDS).alias("r"))
    return rows.select(*KEY, "r.*", F.when(F.col("r.name").isNull(), "not a record").alias("error"))
