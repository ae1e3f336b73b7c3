"""The sample that decides which pairs' whole shingle sets are compared, and the tables that near-dedup leaves."""

import numpy as np

from tallyrank.llm import simhash
from tallyrank.llm.common import passing_tables, shared_dir, shared_table


def pair(rng, n, shared):
    """Two sorted sets of n hashes of which ``shared`` are in both."""
    h = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
    return np.sort(h[:n]).tobytes(), np.sort(h[n - shared :]).tobytes()


def test_sample_keeps_near_copies_and_drops_others():
    rng = np.random.default_rng(1)
    near = [simhash.sample_alike(*pair(rng, n, int(np.ceil(n * 16 / 18))), 0.8) for n in (1, 9, 30, 90, 500) for _ in range(800)]
    assert all(near)
    far = [simhash.sample_alike(*pair(rng, 500, 250), 0.8) for _ in range(1000)]  # a third
    assert sum(far) < 5
    assert simhash.sample_alike(b"", b"", 0.8)


def test_tables_pass(spark):
    from pathlib import Path

    folder = Path(shared_dir(spark)) / "tallyrank"
    with passing_tables(spark):
        gone, kept = shared_table(spark, spark.range(3), "passes"), shared_table(spark, spark.range(5), "stays", keep=True)
        assert gone.count() == 3 and any(p.name.startswith("passes-") for p in folder.iterdir())
    assert kept.count() == 5 and not any(p.name.startswith("passes-") for p in folder.iterdir())


def test_near_groups_leave_one_table(spark):
    from pathlib import Path

    folder = Path(shared_dir(spark)) / "tallyrank"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40)) + f" x{i}") for i in range(6)], "doc_id long, text string")
    groups = simhash.near_groups(docs)
    assert [p.split("-")[0] for p in {p.name for p in folder.iterdir()} - before] == ["near"]
    assert {(r["doc_id"], r["group"]) for r in groups.collect()} == {(i, 0) for i in range(6)}
