"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from tallyrank.llm import queries


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    told = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in told.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    show = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(show, got.select(*names).collect())) == sorted(map(show, told.fetchall()))


def test_pipeline_against_brute_force(spark, sf):
    """The whole pipeline by hand on the smallest tables, from what the classifier lets through."""
    from collections import Counter
    from hashlib import md5

    from tallyrank.llm import toxicity
    from tallyrank.llm.common import read
    from tallyrank.llm.decontamination import edit_distance, plain
    from tests.llm.test_operators import brute_groups, iterated_targets

    documents = read(spark, sf, "documents")
    classifier = toxicity.fit(documents, queries.toxic_labels(spark, sf))
    restorer = toxicity.Restorer(classifier.chars)
    docs = [r.asDict() for r in documents.collect()]
    docs = [r for r in docs if classifier.score(restorer, r["text"] or "") < 0.5]
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").encode().lower().decode()
    often = Counter(k for r in docs for k in {key(x) for x in (r["text"] or "").split("\n")})
    for r in docs:
        r["text"] = "\n".join(x for x in (r["text"] or "").split("\n") if not (key(x) and often[key(x)] >= 10))
    root = brute_groups([(r["doc_id"], r["text"]) for r in docs])
    docs = [r for r in docs if root[r["doc_id"]] == r["doc_id"]]
    items = [plain(r["text"]).decode() for r in read(spark, sf, "benchmark").collect()]
    near = lambda item, text: edit_distance(item, text) <= int(0.2 * len(item) + 1e-9)
    docs = [r for r in docs if not any(near(i, plain(r["text"]).decode()) for i in items)]
    words = lambda r: len(r["text"].encode().split())
    size = Counter()
    for r in docs:
        size[r["source"]] += words(r)
    target, want = iterated_targets(dict(size)), {}
    for s in size:
        sure = int(target[s] // size[s]) if size[s] else 0
        missing = target[s] - sure * size[s]
        mine = sorted((int(md5(f"7:{r['doc_id']}".encode()).hexdigest()[:13], 16), r["doc_id"], words(r)) for r in docs if r["source"] == s)
        total, cut = 0, 0
        for n, (_, _, w) in enumerate(mine, 1):
            if abs(total + w - missing) <= abs(total - missing):
                cut = n
            total += w
            if total >= missing:
                break
        for n, (_, d, w) in enumerate(mine):
            if w and sure + (n < cut):
                want[d] = w * (sure + (n < cut))
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(want) > 50


KEPT = {  # of the awkward rows below, what each of the first four stages leaves
    "toxicity": [(None, None), (10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (10**6 + 2, "x " * 5000)],
    "line dedup": [(None, ""), (10**6, ""), (10**6 + 1, ""), (10**6 + 1, ""), (10**6 + 2, "x " * 5000)],
    "SimHash near-dedup": [(None, None), (10**6, None), (10**6 + 2, "x " * 5000)],
    "benchmark decontamination": [(None, None), (10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (10**6 + 2, "x " * 5000)],
}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, sf, stage):
    """Nulls, empty and long texts and repeated rows: what stays of them, with all columns; empty tables stay empty."""
    rows = [(None, None, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "x " * 5000, "en", "src0", 1)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.orderBy("doc_id").limit(30).unionByName(spark.createDataFrame(rows, docs.schema))
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, docs, sf)
    assert f(spark, docs.limit(0), sf).count() == 0
    mine = [(r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is None or r["doc_id"] >= 10**6]
    if stage < 4:
        assert got.columns == docs.columns and sorted(mine, key=repr) == sorted(KEPT[name], key=repr)
    else:
        assert all(t for _, t in mine) and got.filter("copies < 1 OR taken <> copies * size").count() == 0
