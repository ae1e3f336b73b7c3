"""Each operator against a brute-force version on small tables, awkward rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyrank.llm import decontamination, fingerprints, langid, line_dedup, lm_scoring, mixing, simhash, substring_dedup, token_counts, toxicity
from tallyrank.llm.common import mix
from tallyrank.llm.queries import tokenizer_file

KIND = "doc_id long, text string, lang string, source string, n_chars long, SCORE double, fp string, n_lines string"
WORDS = "the of and in that was for with this from lorem ipsum dolor sit amet rose lily oak elm ash".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared lines, repeated rows, clashing columns."""
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "one", "Ünï cödé  \t text", "a" * 3000, prose(rng, 4000), "same line\nother"]
    base = prose(rng, 130)
    for i in range(14):
        words = base.split()
        if i % 3:
            words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words) + "\n  Shared LINE \n" + prose(rng, 5 + 4 * i))
    texts += [prose(rng, 60) + " " + " ".join(base.split()[20:90]), base, base, "x " * 400]
    out = [(i * 3, t, "en", f"s{i % 4}" if i % 5 else None, 1, 1.0, "f", "n") for i, t in enumerate(texts)]
    out += [out[10], out[10], (None, "no id " + base, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def text_of(r):
    return r[1] or ""


def words_of(text):
    return text.encode().split()


def test_line_dedup(docs, rows, nothing):
    count = Counter(k for r in rows for k in set(line_dedup.keys(text_of(r).encode())[1]))
    want = []
    for r in rows:
        lines, keys = line_dedup.keys(text_of(r).encode())
        kept = [x for x, k in zip(lines, keys, strict=True) if not (k and count[k] >= 10)]
        want.append((r[0], b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    want.sort(key=repr)
    for size in (16 << 20, 0):  # the broadcast arrays, and those that stay where they are
        got = line_dedup.dedup_lines(docs, broadcast_bytes=size)
        assert got.columns.count("n_lines") == 1 and "SCORE" in got.columns
        assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == want
        assert line_dedup.dedup_lines(nothing, broadcast_bytes=size).count() == 0
    assert sum(w[3] for w in want) >= 14


def test_minimal_perfect_hash():
    h = np.unique(np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 5000, dtype=np.uint64))
    h[1] = h[0]  # two keys that share a half
    words, offsets, slot = line_dedup.build_mph(h, h2 := mix(np.arange(len(h), dtype=np.uint64)))
    assert sorted(slot) == list(range(len(h)))
    prints, counts = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint32)
    prints[slot], counts[slot] = h2, np.arange(1, len(h) + 1)
    shard = line_dedup.Shard(words.tobytes(), offsets.tobytes(), prints.tobytes(), counts.tobytes())
    assert (shard.find(h, h2) == np.arange(1, len(h) + 1)).all()
    assert not shard.find(h + np.uint64(1), h).any()


def test_token_counts(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    library, counter = Tokenizer.from_file(path), token_counts.counter(path)
    odd = ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "   \n\n x", "x   ", " x", "日本語 ½²", "ab" * 300, "x　y \x85 z", "🙂🙂 don't I'LL", "a  b", "\x1c a \x1d"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(" \n\tab'sé1.ß<|> ") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in odd:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    got = token_counts.token_counts(docs, path, limit=100)
    want = sorted((r[0] if r[0] is not None else -1, len(text_of(r).encode()), n := len(library.encode(text_of(r), add_special_tokens=False).ids), n > 100) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
    assert token_counts.token_counts(nothing, path).count() == 0


def brute_fingerprint(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_the_engines_hash(spark):
    got = spark.createDataFrame([("a b c d",), ("é x",)], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in ("a b c d", "é x")]


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, rows, nothing, bucket):
    prints = {r[1]: brute_fingerprint(text_of(r)) for r in rows}
    links = {a: {b for b in prints.values() if bin(a ^ b).count("1") <= 4} for a in prints.values()}
    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen
    least = {a: min(r[0] for r in rows if r[0] is not None and prints[r[1]] in reach(a)) if any(r[0] is not None and prints[r[1]] in reach(a) for r in rows) else None for a in set(prints.values())}
    want = sorted(((r[0], prints[r[1]], least[prints[r[1]]]) for r in rows), key=repr)
    got = simhash.near_duplicates(docs, bucket=bucket)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got.collect()), key=repr) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_blocks_cover_all_pairs():
    rng = random.Random(3)
    for n in (10, 10**5, 10**9):
        masks = simhash.block_masks(simhash.blocks_for(n, 4), 4)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def similarity(a, b, k=5):
    """Jaccard similarity of two texts' shingles; of texts without words, 1."""
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_groups(texts):
    """The smallest id of each id's group; ``texts``: pairs of id and text."""
    root = {i: i for i, _ in texts}
    links = [(i, j) for n, (i, x) in enumerate(texts) for j, y in texts[:n] if i == j or similarity(x, y) >= 0.8]
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_similar_groups(spark, docs, rows, nothing):
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    root = brute_groups([(r[0], text_of(r)) for r in rows if r[0] is not None])
    assert sorted(ids) == sorted(set(root.values())) and len([r for r in out if r["doc_id"] is None]) == 1
    assert len(ids) < len(root) - 5
    assert simhash.drop_similar(nothing).count() == 0


def test_rows_of_one_id(spark):
    """Of rows that share an id the smallest text stays, whatever order they come in."""
    rows = [(1, "b text of some words here", 1), (1, "a text of some words here", 2), (1, "a text of some words here", 1), (2, None, 3), (3, "", 4), (4, "quite another text than all of those", 5)]
    for order in (rows, rows[::-1]):
        got = simhash.drop_similar(spark.createDataFrame(order, "doc_id long, text string, COPY long")).collect()
        assert sorted(map(tuple, got), key=repr) == [(1, "a text of some words here", 1), (2, None, 3), (4, "quite another text than all of those", 5)]


def test_chains_are_one_group(spark):
    """Texts of which only the larger ids are alike to both ends are one group; one text of it stays."""
    rng = random.Random(41)
    base = prose(rng, 100).split()
    step = lambda n: " ".join([*base[:-n], *prose(rng, n).split()]) if n else " ".join(base)
    ends = [step(0), " ".join([*prose(rng, 8).split(), *base[8:]])]
    middle = " ".join([*prose(rng, 4).split(), *base[4:]])
    rows = [(1, ends[0]), (2, ends[1]), (9, middle), (5, prose(rng, 100))]
    root = brute_groups(rows)
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(root.values())


def test_similar_groups_recall(spark):
    """Texts with edits in scattered places, in one stretch and at the end, down to a similarity of 0.8."""
    rng = random.Random(21)
    rows = []
    for i in range(600):
        base = prose(rng, rng.randrange(40, 300)).split()
        words, n = list(base), len(base)
        if i % 3 == 0:
            for p in rng.sample(range(n), max(1, n // 48)):
                words[p] = f"edit{i}"
        elif i % 3 == 1:
            p, k = rng.randrange(n // 2), max(1, n // 12 - 4)
            words[p : p + k] = prose(rng, k).split()
        else:
            words += prose(rng, n // 6).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(words))]
    alike = [i for i in range(600) if similarity(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8]
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i in range(600) if 2 * i + 1 not in kept}
    assert len(alike) > 300 and gone <= set(alike) and len(gone) >= 0.9 * len(alike)


def test_similar_groups_checks_every_pair_of_a_bucket(spark):
    """Groups of near copies that share their words, but not their order, with a smaller text."""
    rng = random.Random(22)
    base = sorted(set(prose(rng, 150).split()))
    rows = [(0, " ".join(base))]
    for g in range(40):
        order = rng.sample(base, len(base))
        for i in range(4):
            # two of the same words with the last four moved, and two with another first word
            words = order[:-4] + rng.sample(order[-4:], 4) if i < 2 else [f"edit{g}{i}", *order[1:]]
            rows.append((1 + 4 * g + i, " ".join(words)))
    rng.shuffle(rows)
    root = brute_groups(rows)
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(root.values())) < 60 and kept == set(root.values())


def brute_removed(rows, window=50):
    first, out = {}, []
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(text_of(r))
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), r[0])
    for r in rows:
        w = words_of(text_of(r))
        gone = set()
        if r[0] is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < r[0]:
                    gone.update(range(p, p + window))
        out.append((r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"group": 3}, {"filter_bits": 64}])
def test_substring_dedup(docs, rows, nothing, sizes):
    want = brute_removed(rows)
    got = substring_dedup.drop_repeats(docs, digest=True, **sizes)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=repr) == want
    assert sum(w[2] for w in want) > 500
    assert substring_dedup.drop_repeats(nothing, **sizes).count() == 0


def iterated_targets(sizes, weights=(5, 2, 1), most=3.0):
    """Resharing the excess by weight, again and again, until no source is above its most."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 10**rng.randrange(6)]) for i in range(9)} | {None: 50}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r["source"]: r["target"] for r in got.collect()} == pytest.approx(iterated_targets(sizes))


def test_mixing(spark, docs, rows, nothing):
    got = mixing.mix_sources(docs).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words_of(text_of(r)))
    target = iterated_targets(size)
    longest = max(len(words_of(text_of(r))) for r in rows)
    for s in size:
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s] and r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= longest
    assert len(got) == len(rows) and sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect())) == sorted(map(repr, got))
    assert mixing.mix_sources(nothing).count() == 0


def test_pareto_ranks(spark):
    """Unequal inclusion probabilities: Q against the formula, and the sample of each source is that of smallest Q."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 7).alias("text"), F.concat(F.lit("s"), (F.sqrt("id") / 10).cast("int").cast("string")).alias("source"))
    plan, sources = mixing.plan_mix(rows)
    chance = {r["source"]: r["p"] for r in sources.collect()}
    assert len({round(p, 6) for p in chance.values()}) >= 3 and all(0 <= p < 1 for p in chance.values())
    u = {r["doc_id"]: (r["u"] + 0.5) / 16**13 for r in plan.collect()}
    taken = {}
    for r in mixing.mix_sizes(rows).collect():
        p = chance[r["source"]]
        if p > 0:
            q = u[r["doc_id"]] / (1 - u[r["doc_id"]]) / (p / (1 - p))
            taken.setdefault(r["source"], []).append((q, r["copies"]))
    for s, mine in taken.items():
        mine.sort()
        copies = [c for _, c in mine]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1
        assert abs(sum(c > min(copies) for c in copies) / len(copies) - chance[s]) <= 1 / len(copies) + 1e-9 or max(copies) == min(copies)


def test_mixing_nears_targets(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.concat(F.lit("s"), F.floor(F.sqrt(F.col("id") / 700)).cast("string")).alias("source"))
    got = mixing.mix_sizes(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 18.5 for r in got)


def test_language_model(docs, rows, nothing):
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3]
    tokens = lambda r: text_of(r).encode().lower().split() + [b" "]
    c = Counter(t for r in train for t in tokens(r))
    n, v = sum(c.values()), len(c)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.withColumn("part", F.coalesce(crc % 3, F.lit(1)))
    base = lambda r: sum(log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r))
    train_ids = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3]
    c = Counter(t for r in train_ids for t in tokens(r))
    n, v = sum(c.values()), len(c)
    for sizes in ({}, {"words": 10, "bits": 1 << 16, "bucket_bytes": 1000}, {"words": 10, "bucket_bytes": 1000, "fan": 4}):
        got = sorted(lm_scoring.score_texts(split, split.filter("part <> 0"), **sizes).collect(), key=lambda r: (repr(r["doc_id"]), r["n_tokens"]))
        want = sorted(rows, key=lambda r: (repr(r[0]), len(tokens(r))))
        for g, r in zip(got, want, strict=True):
            assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (r[0], len(tokens(r)), sum(c[t] > 0 for t in tokens(r)), n)
            assert g["base_score"] == pytest.approx(base(r)) and g["score"] <= 0
        assert sum(g["score"] for g in got) > sum(g["base_score"] for g in got)
    assert lm_scoring.score_texts(nothing, nothing).count() == 0
    assert {r["n_known"] for r in lm_scoring.score_texts(docs, nothing).collect()} == {0}


def test_scores_of_a_small_corpus_by_hand(spark):
    """Every pair is held, those found once too; the model's log10 probabilities against the formulas."""
    lines = ["a b a b a c", "b a", "c c c c c c c c c"]
    told = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    model, _ = lm_scoring.train(told)
    assert model.least == {lm_scoring.WORD: 1, lm_scoring.PAIR: 1}
    tokens = [t.split() + [" end"] for t in lines]
    one, two = Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip(["<"] + t, t))
    lv = lambda n: lm_scoring.level(np.array([n]))
    mid, top = (lambda n: float(lm_scoring.middle(lv(n))[0]) if n else 0.0), (lambda n: float(lm_scoring.top(lv(n))[0]) if n else 0.0)
    whole, v = sum(map(mid, one.values())), len(one)
    p1 = lambda w: (mid(one[w]) + 0.1) / (whole + 0.1 * (v + 1))

    def p(w, h):
        after = {x: n for (a, x), n in two.items() if a == h}
        r, t = top(int(np.ceil(sum(map(mid, after.values()))))) if after else 0.0, mid(len(after))
        c = max(top(one[h if h != "<" else " end"]), r)
        return (mid(two[h, w]) + (c - r + t) * p1(w)) / (c + t) if c else p1(w)

    got = lm_scoring.score_texts(told, told).collect()
    for r in got:
        t = tokens[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(log10(p(w, h)) for h, w in zip(["<"] + t, t)), rel=1e-6)


def test_bloom_levels():
    counts = np.arange(1, 5000)
    lv = lm_scoring.level(counts)
    assert (lm_scoring.top(lv) >= counts).all() and (np.abs(lm_scoring.middle(lv) - counts) <= 0.3 * counts).all() and (np.diff(lv) >= 0).all()


def test_toxicity(spark, nothing):
    rng = random.Random(6)
    bad = ["trashling", "moronoid", "scumbat", "losertype", "idiotic"]
    texts, labels = [], []
    for i in range(600):
        words = prose(rng, 30).split()
        if i % 5 == 0:
            words[3:3] = rng.sample(bad, 3)
        texts.append((i, " ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in words)))
        labels.append((i, int(i % 5 == 0)))
    labels += [(None, 1), (7, None), (10**6, 1)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    restorer = toxicity.Restorer(model.chars)
    assert [restorer.word(w) for w in ("m0r0n0id", "scuuumbaaat", "l.o.s.e.r.t.y.p.e", "1d10tic", "trashl1ng!!!", "scumbat###", "2024", "")] == ["moronoid", "scumbat", "losertype", "idiotic", "trashling", "scumbat", "2024", ""]
    assert "moronoid" in model.found(restorer, "you m o r o n o i d there")
    odd = [(1, None), (2, ""), (3, "m0r0n0id $cumbat 1d10tic"), (4, "the rose and the lily"), (4, "the rose and the lily"), (5, "z" * 5000)]
    got = toxicity.score_toxicity(spark.createDataFrame(odd, "doc_id long, text string").withColumn("SCORE", F.lit(1)), model, restored=True).collect()
    assert [(r["doc_id"], r["predicted"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(1, 0), (2, 0), (3, 1), (4, 0), (4, 0), (5, 0)]
    assert all(0 <= r["score"] <= 1 for r in got) and {r["restored_text"] for r in got if r["doc_id"] == 3} == {"moronoid scumbat idiotic"}
    held = toxicity.score_toxicity(table, model).join(spark.createDataFrame(labels[:600], "doc_id long, toxic int"), "doc_id")
    assert held.filter("predicted <> toxic").count() == 0
    assert toxicity.score_toxicity(nothing, model).count() == toxicity.drop_toxic(nothing, model).count() == 0
    assert toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.drop_toxic(table, None).count() == 600


@pytest.fixture(scope="module")
def plain_reader():
    words = {w: 5 for w in "you are stupid idiot loser the rose and lily coffee street".split()}
    chars = toxicity.CharModel(words)
    return toxicity.Restorer(chars), toxicity.Classifier(chars, ["stupid", "idiot", "loser"], np.ones(3), 0.0)


@pytest.mark.parametrize("text", [" ".join("youare" * 20 + "stupid" + "theroseandthelily" * 10), "a " * 400 + "s t u p i d", "st" + "u" * 90 + "pid", "the.rose." * 20 + "s.t.u.p.1.d", " ".join("xq" * 20000 + "stupid")])
def test_toxicity_of_long_runs(plain_reader, text):
    restorer, classifier = plain_reader
    assert classifier.found(restorer, text) == ["stupid"]
    assert "stupid" in restorer.text(text)


def test_viterbi_against_all_paths(plain_reader):
    model = plain_reader[0].model
    rng = random.Random(12)

    def paths(arcs, i):
        if i == len(arcs):
            yield "", 0.0
            return
        for j, letters, cost in arcs[i]:
            for rest, more in paths(arcs, j):
                yield letters + rest, cost + more

    def score(read):
        total, h = 0.0, toxicity.START
        for c in read + toxicity.END:
            end = c in " " + toxicity.END
            total += model.log(h, toxicity.END if end else c)
            h = toxicity.START if end else h[1:] + c
        return total

    words = ["1d10t", "l0ser", "s t u p i d", "y 0 u a r e", "coofffee", "s.t.u", "2", "$t0p1d!!"]
    words += ["".join(rng.choice("stu1d0. i$") for _ in range(rng.randrange(1, 9))).strip() or "x" for _ in range(60)]
    for word in words:
        best = max(score(read) - cost for read, cost in paths(toxicity.lattice(word), 0))
        got = toxicity.decode(word, model)
        assert max(score(read) - cost for read, cost in paths(toxicity.lattice(word), 0) if read == got) == pytest.approx(best), word


def test_spaced_runs_are_cut_into_words(plain_reader):
    restorer, classifier = plain_reader
    assert restorer.run("y o u a r e s t u p 1 d") == "you are stupid"
    assert restorer.text("Then: y 0 u\ta r e  l o s e r and lily") == "then you are  loser and lily"
    assert classifier.found(restorer, "y o u a r e a n i d i o t") == ["idiot"]


def test_a_score_of_one_half(spark, plain_reader):
    rows = spark.createDataFrame([(1, ""), (1, ""), (2, None), (3, "rose")], "doc_id long, text string")
    got = toxicity.score_toxicity(rows, plain_reader[1]).collect()
    assert {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)} and len(got) == 4
    assert toxicity.drop_toxic(rows, plain_reader[1]).count() == 0


def test_doubled_letters_and_signs_alone(plain_reader):
    restorer, classifier = plain_reader
    assert [restorer.word(w) for w in ("stuupiid", "iddiott", "looserr", "coffee", "cofffee", "street", "1!1y", "!d!0+", "1|1y", "2024", "|", "--")] == ["stupid", "idiot", "loser", "coffee", "coffee", "street", "lily", "idiot", "lily", "2024", "", ""]
    assert restorer.word("105€") == "lose" and classifier.found(restorer, "you stuupiid iddiott") == ["idiot", "stupid"]


def test_language(spark, nothing):
    sample = {"aa": "kala mata sata pana rasa", "bb": "brnk strk vlkt drst prst"}
    rng = random.Random(8)
    make = lambda lang, n: " ".join("".join(rng.sample(sample[lang].split(), 2)) for _ in range(n))
    known = spark.createDataFrame([(make(x, 20), x) for x in sample for _ in range(60)] + [(None, "aa"), ("kala", None)], "text string, lang string")
    models = langid.fit(known)
    odd = [(1, make("aa", 12)), (2, make("bb", 12)), (3, None), (4, ""), (5, "123 !?"), (6, "ЖЖЖ ЩЩЩ " * 30), (7, make("bb", 5000)), (7, make("bb", 1))]
    got = sorted(langid.identify(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("x")), models, reject=True).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got[:5]] == ["aa", "bb", "und", "und", "und"] and got[5]["lang_pred"] == "und"
    assert [r["lang_pred"] for r in got[6:]] == ["bb", "bb"] and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), None).collect()} == {"und"}
    told = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), models).collect()}
    assert told[1] is False and told[3] is None and told[6] is True
    copies = spark.createDataFrame([("same text here", "aa")] * 3000 + [(make("aa", 9), "aa") for _ in range(40)] + [(make("bb", 9), "bb") for _ in range(40)], "text string, lang string")
    assert langid.identify(spark.createDataFrame(odd[:2], "doc_id long, text string"), langid.fit(copies)).filter("lang_pred = 'bb'").count() == 1
    assert langid.fit(nothing.select("text", "lang")) is None and langid.identify(nothing, models).count() == 0


def brute_kneser_ney(counts, order=langid.ORDER):
    """P(c | context) of interpolated Kneser-Ney over words between boundaries, with plain dictionaries."""
    edge = "\x03"
    seen = [Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        x = edge + w + edge
        for e in range(1, len(x)):
            for k in range(1, min(order, e + 1) + 1):
                seen[k][(x[e - k + 1 : e + 1], e - k + 1 == 0)] += n
    grams = {k: {g for g, _ in seen[k]} for k in range(1, order + 1)}
    used = {}
    for k in range(1, order + 1):
        for g in grams[k]:
            opens = (g, True) in seen[k]
            if k == order or (opens and k > 1):
                used[g] = seen[k][(g, True)] + seen[k][(g, False)]
            else:
                used[g] = max(1, sum(h[1:] == g for h in grams[k + 1]))
    d = {}
    for k in range(1, order + 1):
        once, twice = (sum(used[g] == i for g in grams[k]) for i in (1, 2))
        d[k] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    floor = 1 / (len(grams[1]) + 1)

    def p(c, context):
        k = len(context) + 1
        mine = [g for g in grams[k] if g[:-1] == context]
        lower = floor if k == 1 else p(c, context[1:])
        if not mine:
            return lower
        total = sum(used[g] for g in mine)
        g = context + c
        return max(0, used[g] - d[k] if g in grams[k] else 0) / total + d[k] * len(mine) / total * lower

    return p, {g for g in grams[1]}


def test_kneser_ney_against_brute_force():
    counts = Counter({"abab": 3, "abc": 2, "ca": 1, "b": 5, "abcabcab": 1})
    models, (p, letters) = langid.Models(["x"], [counts]), brute_kneser_ney(counts)
    for word in ("a", "b", "ab", "abab", "cabab", "zz", "abcz", "bbbbbbbb", "abcabcabc"):
        x = "\x03" + word + "\x03"
        want = sum(np.log(p(x[e], x[max(0, e - langid.ORDER + 1) : e])) for e in range(1, len(x)))
        total, size = models.score([word])
        assert total[0, 0] == pytest.approx(want, rel=1e-4) and size[0] == len(word) + 1
    for context in ("", "a", "\x03ab", "abab", "cc"):
        # the letters seen and one for all others share the whole
        assert sum(p(c, context) for c in letters) + p("?", context) == pytest.approx(1.0)


def test_equal_entropies_go_to_the_first_language(spark):
    models = langid.Models(["aa", "bb"], [{"xy": 3}, {"xy": 3}])
    got = langid.identify(spark.createDataFrame([(1, "xy xy"), (2, "q")], "doc_id long, text string"), models).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("aa", 0.5), ("aa", 0.5)]


def test_fingerprints(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 7)
    piece = re.compile(fingerprints.PIECE).findall
    order = sorted(((r[0] if r[0] is not None else -(2**63), text_of(r), r[0]) for r in rows), key=lambda r: r[:2])
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = []
    for i, (_, t, key) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a = set(piece(t))
        want.append((key, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, set(piece(edited))), 9), round(near(a, set(piece(after))), 9)))
    got = fingerprints.compare_versions(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=repr) == sorted(want, key=repr)
    texts = {}
    for r in rows:
        texts.setdefault(text_of(r), set()).update(g["fingerprint"] for g in got if g["doc_id"] == r[0])
    assert all(len(v) == 1 for t, v in texts.items())
    assert fingerprints.compare_versions(nothing).count() == 0


def test_sketches_retry(spark):
    a, b = list(range(0, 400)), list(range(300, 900))
    rows = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], []), (4, [k * 0x1E3779B97F4A7C15 % 2**62 for k in (1, 2, 3)], [k * 0x1E3779B97F4A7C15 % 2**62 for k in (2, 3, 4, 5)])], "rid long, a array<long>, b array<long>")
    rows = rows.withColumn("a_print", fingerprints.fingerprint(F.col("a"))).withColumn("b_print", fingerprints.fingerprint(F.col("b")))
    got = {r["rid"]: (r["plus"], r["minus"]) for r in fingerprints.differences(rows, [("a", "b", 0.01)], 4).collect()}
    assert got == {1: (300, 500), 4: (1, 2)}
    # the fingerprints alone do for a few differing digests, not for hundreds
    first = {r["rid"]: (r["plus"], r["minus"]) for r in fingerprints._first(rows, [("a", "b", 0.01)], 4).filter("left = 0").collect()}
    assert first == {4: (1, 2)}


def test_differing_digests_from_two_strings(spark):
    """The cells of two strings, subtracted and peeled by hand, give the digests that differ; counts are the sizes."""
    rng = random.Random(18)
    shared = [rng.getrandbits(63) - 2**62 for _ in range(70000)]
    more, less = [rng.getrandbits(63) - 2**62 for _ in range(5)], [rng.getrandbits(63) - 2**62 for _ in range(4)]
    for common in (shared[:30], shared):
        rows = spark.createDataFrame([(common + more, common + less)], "a array<long>, b array<long>")
        rows = rows.select(fingerprints.fingerprint(F.col("a")).alias("x"), fingerprints.fingerprint(F.col("b")).alias("y"))
        r = rows.select("x", "y", fingerprints.subtract(F.col("x"), F.col("y")).alias("d"), fingerprints.count_of(F.col("x")).alias("n")).first()
        assert r["n"] == len(common) + 5 and len(r["x"]) == 24 * 32 and r["x"] != r["y"]
        cells = {c["cell"]: [c["sign"], c["key"], c["check"]] for c in r["d"]}
        hash_of = lambda k: xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42) & 0xFFFFFFFF
        got = {1: set(), -1: set()}
        while alone := [(c, v) for c, v in cells.items() if abs(v[0]) == 1 and hash_of(v[1]) == v[2]]:
            sign, key, check = alone[0][1]
            got[sign].add(key)
            for j in range(3):
                c = j * 8 + (key >> (7 * j + 5) & 7)
                cells[c] = [cells[c][0] - sign, cells[c][1] ^ key, cells[c][2] ^ check]
        assert not any(map(any, cells.values())) and got == {1: set(more), -1: set(less)}


def test_range_search(spark):
    bounds = sorted(random.Random(1).sample(range(10**6), 300))
    rows = spark.range(0, 10**6, 3331).filter(F.col("id") >= bounds[0])
    got = rows.select("id", fingerprints._bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["id"] for x in bounds) - 1 for r in got)


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("abç") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert decontamination.edit_distance(a, b) == levenshtein_in(a, b)


def edited(rng, text, share):
    """Edits of so many characters: replaced, put in, taken out."""
    chars = list(text)
    for _ in range(int(share * len(text))):
        p, kind, c = rng.randrange(len(chars)), rng.randrange(3), rng.choice("abcdefghijklmnopqrstuvwxyz ")
        chars[p : p + (kind != 1)] = [c] * (kind != 2)
    return "".join(chars)


def test_decontamination(spark, docs, nothing):
    rng = random.Random(10)
    items = [(i, prose(rng, 35)) for i in range(30)] + [(30, None), (None, prose(rng, 20)), (31, ""), (32, "short"), (33, "Short too")]
    table, truth = [], {(202, 32)}
    for i in range(30):
        text = edited(rng, items[i][1], i / 300)  # up to a tenth of the characters
        table.append((i, prose(rng, 50) + "\n" + text.upper() + " " + prose(rng, 50)))
        truth.add((i, i))
    table += [(100 + i, prose(rng, 200)) for i in range(20)] + [(200, None), (201, ""), (0, table[0][1]), (202, "A  shOrt\none"), (203, "shorter"), (204, items[0][1][:-90])]
    texts, wanted = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 19, 1200):
        got = decontamination.find_items(texts.withColumn("item_id", F.lit(1)), wanted, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == truth and len(got) == 32
        by_doc = dict(table[:30])
        for r in got[:30]:
            if r["doc_id"] < 30:
                assert r["distance"] == levenshtein_in(decontamination.plain(items[r["item_id"]][1]).decode(), decontamination.plain(by_doc[r["doc_id"]]).decode())
    assert {r["doc_id"] for r in decontamination.decontaminate(texts, wanted).collect()} == {100 + i for i in range(20)} | {200, 201, 203, 204}
    assert decontamination.find_items(nothing, wanted).count() == decontamination.find_items(texts, wanted.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, wanted).count() == docs.count()
    clash = texts.withColumn("DISTANCE", F.lit("x"))
    assert decontamination.decontaminate(clash, wanted).columns == clash.columns


@pytest.mark.parametrize("n_words", [4, 7, 12, 15, 35, 70])
@pytest.mark.parametrize("kind", ["characters", "words", "every second word"])
def test_decontamination_recall(n_words, kind):
    """Items of 20 to 400 characters, edited as far as a similarity of 0.8 allows, against brute force."""
    rng = random.Random(n_words)
    items = [prose(rng, n_words) for _ in range(50)]
    table, truth = [], set()
    for i, text in enumerate(items * 3):
        words = text.split()
        if kind == "characters":
            text = edited(rng, text, 0.18)
        elif kind == "words":
            for p in rng.sample(range(n_words), int(0.18 * n_words)):
                words[p] = prose(rng, 1)
            text = " ".join(words)
        else:
            for p in range(0, n_words, 2):
                words[p] = edited(rng, words[p], 1.01 / len(words[p]))
            text = " ".join(words)
        pattern = items[i % 50]
        if decontamination.edit_distance(pattern, text) <= int(0.2 * len(pattern) + 1e-9):
            truth.add((i, i % 50))
        table.append(f"{prose(rng, 3 + i % 5)}\n{text}  {prose(rng, 5)}".encode())
    found = decontamination.Items([(i, decontamination.plain(t)) for i, t in enumerate(items)], 0.8)
    data, off = np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])])
    got = {(r, n) for r, n, _ in found.near(*decontamination.flat(data, off))}
    assert len(truth) > 40 and len(got & truth) >= 0.9 * len(truth)
    assert all(decontamination.edit_distance(items[n], decontamination.plain(table[r]).decode()) <= 0.2 * len(items[n]) + 1e-9 for r, n in got)


def test_decontamination_of_very_long_texts():
    rng = random.Random(31)
    item = prose(rng, 40)
    text = (prose(rng, 2000) + "\n") * 40 + item + " x" * 30
    data = np.frombuffer(text.encode(), np.uint8)
    found = decontamination.Items([(7, decontamination.plain(item)), (8, decontamination.plain(item)), (9, b"never here at all, not even once")], 0.8)
    assert [(found.ids[n], d) for _, n, d in found.near(*decontamination.flat(data, np.array([0, len(data)])))] == [([7, 8], 0)]


def test_decontamination_of_items_that_share_words(spark):
    """Edited passages of items that are alone, there twice, or have a twin that differs in one word."""
    rng = random.Random(23)
    items, table = [], []
    for i in range(45):
        words = prose(rng, 15).split()
        items.append((3 * i, " ".join(words)))
        if i % 3 == 1:
            items.append((3 * i + 1, " ".join(words)))
        if i % 3 == 2:
            items.append((3 * i + 1, " ".join([*words[:7], "twin", *words[8:]])))
        for p in (2, 5, 8, 11):  # an edit in each of four words that don't touch
            words[p] = words[p][:1] + "_" + words[p][2:]
        table.append((i, prose(rng, 40) + " " + " ".join(words) + " " + prose(rng, 40)))
    truth = {(d, i) for d, t in table for i, x in items if levenshtein_in(x, t) <= int(0.2 * len(x) + 1e-9)}
    texts, wanted = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 19, 3000):
        got = [(r["doc_id"], r["item_id"]) for r in decontamination.find_items(texts, wanted, block_bytes=size).collect()]
        assert len(truth) == 75 and set(got) == truth and len(got) == 75
