"""Pool upkeep: skipping what was ingested, merging records of one person, allocating ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.functions import constants as K
from tallyrank.operators.order import numbered
from tallyrank.sources.store import written

HISTORY = "array<struct<title:string,company:string,start_date:string,end_date:string>>"


def skip_ingested(incoming: DataFrame, pool: DataFrame, key: str = "source_file") -> DataFrame:
    """The incoming rows whose key the pool lacks."""
    return incoming.join(pool.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def clean_records(parsed: DataFrame) -> DataFrame:
    """Parsed fields as a record's columns, without the defaults that a merge must not put over known values: title, education,
    location and text stay null where they were not parsed. Missing columns are taken as null."""
    have = set(parsed.columns)
    col = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    job = lambda j: F.struct(
        F.coalesce(j["title"], F.lit("Developer")).alias("title"), F.coalesce(j["company"], F.lit("Company")).alias("company"),
        F.coalesce(j["start_date"], F.lit("2020-01-01")).alias("start_date"), j["end_date"].alias("end_date"),
    )
    return parsed.withColumns({
        "name": C.strip_cheap(F.coalesce(col("name"), F.lit("Unknown Candidate"))),
        "name_not_extracted": F.coalesce(col("name_not_extracted", "boolean"), F.lit(False)),
        "current_title": col("current_title"),
        "years_experience": F.coalesce(col("years_experience", "double"), F.lit(1.0)),
        "career_history": F.transform(F.filter(F.coalesce(col("career_history", HISTORY), F.array().cast(HISTORY)), lambda j: j.isNotNull()), job),
        "skills_listed": F.coalesce(col("skills_listed", "array<string>"), F.array().cast("array<string>")),
        "last_active": F.nullif(col("last_active"), F.lit("")),
        "education": col("education"),
        "location": col("location"),
        "resume_text": col("resume_text"),
        "source_file": col("source_file"),
    })


def fill_records(rows: DataFrame) -> DataFrame:
    """The defaults of what no parse has given."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("current_title", "Software Engineer"), ("education", ""), ("location", "Remote"), ("resume_text", ""))})


def build_records(parsed: DataFrame) -> DataFrame:
    """Parsed fields with the defaults of a record. Missing columns are taken as null."""
    return fill_records(clean_records(parsed))


def union_skills(a: Column, b: Column) -> Column:
    """First seen first, trimmed; case counts."""
    return F.array_distinct(F.concat(F.transform(a, C.strip_cheap), F.transform(b, C.strip_cheap)))


def union_history(a: Column, b: Column) -> Column:
    """Jobs of one company, title and start once: where the first stood, as the last was given."""
    return distinct_jobs(F.concat(a, b))


def distinct_jobs(jobs: Column) -> Column:
    """A list's jobs of one company, title and start once, in the same way. Keys are sorted, so the work is all but linear in the list."""
    key = lambda j: F.concat_ws("\x1f", C.strip_cheap(F.lower(F.coalesce(j["company"], F.lit("")))), C.strip_cheap(F.lower(F.coalesce(j["title"], F.lit("")))), C.strip_cheap(F.coalesce(j["start_date"], F.lit(""))))
    keys = F.array_distinct(F.transform(jobs, key))
    firsts = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    rows = F.sort_array(F.transform(jobs, lambda j, i: F.struct(key(j).alias("k"), i.alias("i"), j.alias("j"))))
    marked = F.zip_with(rows, F.slice(rows, 2, F.size(rows)), lambda r, after: F.struct(r["j"].alias("j"), (~r["k"].eqNullSafe(after["k"])).alias("last")))
    placed = F.zip_with(firsts, F.filter(marked, lambda r: r["last"]), lambda f, r: F.struct(f["i"].alias("i"), r["j"].alias("j")))  # both by key
    return F.when(F.size(keys) == F.size(jobs), jobs).otherwise(F.transform(F.sort_array(placed), lambda r: r["j"]))


def person_key(df: DataFrame) -> Column:
    """What makes two records one person; null for names that are none."""
    low = C.strip_cheap(F.lower(F.col("name")))
    return F.when(~F.col("name_not_extracted") & ~low.isin("", *K.GENERIC_NAMES), low)


#: Of these the last value that is not empty counts.
LATEST = ("current_title", "education", "location", "last_active", "resume_text", "source_file")


def _folded(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("person",)) -> DataFrame:
    """Rows of one person made one, in the order given: later values that are not empty win. A person has few rows."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(*order)))
    out = rows.groupBy(*keys).agg(
        F.min_by("candidate_id", F.struct(*order)).alias("candidate_id"), F.min_by("name", F.struct(*order)).alias("name"), *(last(c).alias(c) for c in LATEST),
        F.max("years_experience").alias("years_experience"), F.array_sort(F.collect_list(F.struct(*order, "skills_listed", "career_history"))).alias("__l"),
    )
    lists = lambda c: F.flatten(F.transform("__l", lambda r: r[c]))
    out = out.withColumns({"skills_listed": lists("skills_listed"), "career_history": lists("career_history")}).drop("__l")
    return out.withColumns({"skills_listed": union_skills(F.col("skills_listed"), F.array().cast("array<string>")), "career_history": distinct_jobs(F.col("career_history")), "name_not_extracted": F.lit(False)})


COLUMNS = ["candidate_id", "name", "name_not_extracted", "current_title", "years_experience", "career_history", "skills_listed", "last_active", "education", "location", "resume_text", "source_file"]


def upsert(pool: DataFrame, incoming: DataFrame, order: str = "source_file") -> DataFrame:
    """The pool with the incoming records merged in by name; rows of one person in one batch merge too.

    Of several pool rows of a name the first by id takes the merge and the others stay as they are. Records whose
    name is none are added. Merging the same batch again changes nothing.
    """
    pool = pool.select(*COLUMNS).withColumn("person", person_key(pool))
    incoming = incoming.withColumn("candidate_id", F.lit(None).cast("string")).select(*COLUMNS)
    incoming = incoming.withColumn("person", person_key(incoming))
    # only rows that have a person are dealt out by it, once: places and merges are worked out where they lie
    named = pool.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1))).filter("person is not null")
    named = named.repartition(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), "person")
    named = named.withColumn("__nth", F.row_number().over(W.partitionBy("person").orderBy("__new", "candidate_id")))  # pool rows come first; filters on them stay above the shuffle
    rest = named.filter("__new = 0 and __nth > 1").select(*COLUMNS).unionByName(pool.filter("person is null").select(*COLUMNS))
    merged = _folded(named.filter("__new = 1 or __nth = 1").withColumn("__order", F.coalesce(F.col(order), F.lit(""))), ["__new", "__order"]).select(*COLUMNS)
    loose = incoming.filter("person is null").select(*COLUMNS).join(pool.select("source_file").distinct(), "source_file", "left_anti").select(*COLUMNS)
    # written once: ids are numbered from it and given to it
    return allocate_ids(written(merged.unionByName(loose).unionByName(rest), "merged"))


def allocate_ids(rows: DataFrame) -> DataFrame:
    """Numbers rows without a candidate_id on from the highest there is, by name and file."""
    top = rows.agg(F.coalesce(F.max(F.expr("try_cast(regexp_extract(candidate_id, '^cand_([0-9]+)$', 1) as bigint)")), F.lit(0)).alias("__top"))
    new = numbered(rows.filter("candidate_id is null"), F.asc("name"), F.asc("source_file"), F.asc("resume_text"))
    new = new.join(F.broadcast(top)).withColumn("candidate_id", F.format_string("cand_%04d", F.col("__top") + F.col("rank")))  # one row
    return rows.filter("candidate_id is not null").unionByName(new.select(*rows.columns))


def with_new_ids(incoming: DataFrame, known: DataFrame, top: int) -> tuple[DataFrame, int]:
    """(rows, how many ids are new): incoming rows (``person`` null where they have none) with candidate_id, one number on from ``top`` for each person that ``known``
    (person) lacks and for each row without a person, by name and file; null for known persons. Only incoming rows are numbered."""
    named = incoming.filter("person is not null").select("person", "name", "source_file", "row").join(known.filter("person is not null").select("person"), "person", "left_anti")
    named = named.groupBy("person").agg(F.min("name").alias("name"), F.min("source_file").alias("source_file"), F.min("row").alias("row"))
    # written once: ranges are drawn from it before it is sorted by them
    new = written(named.unionByName(incoming.filter("person is null").select("person", "name", "source_file", "row")), "new-persons")
    ids = numbered(new, F.asc("name"), F.asc("source_file"), F.asc("row"))
    count, ids = new.count(), ids.withColumn("id", F.format_string("cand_%04d", F.lit(top) + F.col("rank")))
    incoming = incoming.drop("candidate_id")
    some = incoming.filter("person is not null").join(ids.filter("person is not null").select("person", F.col("id").alias("candidate_id")), "person", "left")
    loose = incoming.filter("person is null").join(ids.filter("person is null").select("row", F.col("id").alias("candidate_id")), "row")
    return some.unionByName(loose), count


def merge_buckets(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pool rows of some buckets with incoming rows (``COLUMNS``, bucket, person, row) merged in; a person's rows share a bucket. Of several
    old rows of a name the first by id takes the merge. Incoming rows merge in the order of their files, first among themselves; old rows
    that none of them meets stay as they are."""
    old = old.select("bucket", *COLUMNS).withColumn("person", person_key(old))
    incoming = incoming.select("bucket", *COLUMNS, "person", "row")
    new = incoming.filter("person is not null").withColumn("__order", F.coalesce("source_file", F.lit(""))).withColumn("row", F.coalesce("row", F.lit("")))
    # most persons have one row in a batch: those need no aggregate
    new = new.withColumn("__n", F.count("*").over(W.partitionBy("bucket", "person")))
    one = new.filter("__n = 1").withColumns({"skills_listed": union_skills(F.col("skills_listed"), F.array().cast("array<string>")), "career_history": distinct_jobs(F.col("career_history"))})
    new = one.select("person", "bucket", *COLUMNS).unionByName(_folded(new.filter("__n > 1"), ["__order", "row"], ("bucket", "person")).select("person", "bucket", *COLUMNS))
    new = new.select(F.struct("bucket", *COLUMNS).alias("n"), F.col("bucket").alias("__bucket"), F.col("person").alias("__person"))
    first = F.row_number().over(W.partitionBy("bucket", "person").orderBy("candidate_id"))
    named = old.filter("person is not null").withColumn("__nth", first)
    met = named.join(new, (F.col("bucket") == F.col("__bucket")) & (F.col("person") == F.col("__person")) & (F.col("__nth") == 1), "full_outer")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    both = {c: F.coalesce(given(f"n.{c}"), given(c)) for c in LATEST} | {
        "years_experience": F.greatest("years_experience", "n.years_experience"),
        "skills_listed": union_skills(F.col("skills_listed"), F.col("n.skills_listed")),
        "career_history": union_history(F.col("career_history"), F.col("n.career_history")),
        "name_not_extracted": F.lit(False),
    }
    side = lambda c: F.when(F.col("__person").isNull(), F.col(c)).when(F.col("person").isNull(), F.col(f"n.{c}")).otherwise(both.get(c, F.col(c))).alias(c)
    merged = met.select(*(side(c) for c in ("bucket", *COLUMNS)))
    loose = old.filter("person is null").unionByName(incoming.filter("person is null"), allowMissingColumns=True).select("bucket", *COLUMNS)
    return fill_records(merged.unionByName(loose))
