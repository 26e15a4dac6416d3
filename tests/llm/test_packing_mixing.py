import random

import pytest
from pyspark.sql import functions as F

from kumihimo.llm import mixing as mx, packing as pk, tokens as tk


def items(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_tokens long")


def sizes(spark, *caps):
    return spark.createDataFrame(list(enumerate(caps)), "pack_size_id int, capacity_tokens int")


def check(packs, rows, caps):
    for k, cap in enumerate(caps):
        own = [r for r in packs if r["pack_size_id"] == k]
        fill, covered = {}, {}
        for r in own:
            fill[r["pack_id"]] = fill.get(r["pack_id"], 0) + r["n_tokens"]
            covered.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert all(v <= cap for v in fill.values())
        for i, n in rows:
            parts = sorted(covered.get(i, []))
            assert sum(x[1] for x in parts) == n and [x[0] for x in parts] == [sum(y[1] for y in parts[:j]) for j in range(len(parts))]
            assert len(parts) == -(-n // cap)


def test_every_item_is_packed_once(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 7, 50, 120, 333, 700, 5000])) for i in range(400)] + [(900, 0)]
    packs = pk.pack(items(spark, rows), sizes(spark, 512, 1024), block=100)
    check(packs.collect(), rows, [512, 1024])
    report = {r["pack_size_id"]: r for r in pk.pack_report(packs, sizes(spark, 512, 1024)).collect()}
    assert all(r["packs"] >= r["least_packs"] and r["fill"] > 0.95 for r in report.values())


def test_optimal_on_small_blocks():
    rng = random.Random(2)
    for _ in range(30):
        # three items cut from each full container
        ns = []
        for _ in range(6):
            a, b = sorted(rng.sample(range(10, 90), 2))
            ns += [a, b - a, 100 - b]
        packs = {x[0] for x in pk.pack_block(list(range(len(ns))), ns, 100)}
        assert len(packs) <= 7


def test_filling_is_the_best(spark):
    for room, ns in ((10, [3, 4, 6]), (9, [2, 5, 8]), (100, [7, 13, 29, 41])):
        counts = [2] * len(ns)
        best = sum(ns[i] for i in pk.complete(room, ns, counts, 100_000))
        reach = {0}
        for n in ns:
            reach |= {r + n * k for r in reach for k in (1, 2) if r + n * k <= room}
        assert best == max(reach) and counts == [2] * len(ns)


def test_packing_edges(spark):
    assert pk.pack(items(spark, [(1, 0)]), sizes(spark, 8)).count() == 0
    assert pk.pack(items(spark, [(1, 1)]).where("false"), sizes(spark, 8)).count() == 0
    assert pk.pack(items(spark, [(1, 16), (2, 16)]), sizes(spark, 8)).count() == 4
    with pytest.raises(ValueError):
        pk.pack(items(spark, [(1, 1)]), sizes(spark, 0))


TARGETS = [("big", 0.5, 1), ("small-one", 0.3, 4), ("odd", 0.2, 2), ("absent", 0.0, 1)]


def mixture(spark, docs, targets=TARGETS, **kw):
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("h", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mx.mix(df, t, **kw)
    return mixed, {r["source"]: r for r in mx.mix_report(mixed, t).collect()}


def test_shares_and_repeats(spark):
    rng = random.Random(4)
    docs = [(i, "big", rng.randrange(20, 80)) for i in range(3000)] + [(10_000 + i, " Small One " if i % 2 else "SMALL_ONE", rng.randrange(20, 80)) for i in range(300)]
    docs += [(20_000 + i, "odd", rng.randrange(20, 80)) for i in range(900)] + [(30_000, None, 50), (30_001, "other", 50), (30_002, "big", 0)]
    mixed, report = mixture(spark, docs)
    for s, share, most in TARGETS[:3]:
        r = report[s.replace("-", "_")]
        assert r["actual_share"] == pytest.approx(share, abs=0.003) and r["most_uses"] <= most
    assert mixed.where("doc_id >= 30000").count() == 0
    assert mixed.count() == mixed.select("doc_id").distinct().count()


def test_a_smaller_mixture_lies_within_a_larger_one(spark):
    docs = [(i, ("big", "small-one", "odd")[i % 3], 10) for i in range(3000)]
    small, _ = mixture(spark, docs, total=4000)
    large, _ = mixture(spark, docs, total=8000)
    assert small.join(large, "doc_id", "left_anti").count() == 0
    assert small.agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0] == pytest.approx(4000, abs=30)


def test_mixing_edges(spark):
    mixed, report = mixture(spark, [(1, "big", 10)])
    assert mixed.count() == 1 and report["odd"]["actual_share"] == 0
    empty, _ = mixture(spark, [(1, None, 10)])
    assert empty.count() == 0


def test_tokens_of_whole_texts(spark):
    from pathlib import Path

    if not Path(tk.FOLDER, tk.VOCABULARY).exists():
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "語" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tk.with_token_counts(df, "doc_id", "text").collect()}
    encoding = tk.load_encoding(tk.FOLDER, tk.VOCABULARY)
    assert got == {1: len(encoding.encode_ordinary("hello world")), 2: 0, 3: 0, 4: len(encoding.encode_ordinary("語" * 5000))}


def test_packs_lie_between_the_bound_and_best_fit():
    rng = random.Random(8)
    for capacity in (50, 100):
        sizes = [rng.randrange(1, capacity) for _ in range(60)]
        packs = {n: len({p for p, *_ in pk.pack_block(list(range(60)), sizes, capacity, n)}) for n in (1, 400, 0)}
        assert all(-(-sum(sizes) // capacity) <= n <= len(pk.best_fit(sizes, capacity)) for n in packs.values())
        for n in (1, 0):
            filled = {}
            for p, _, _, _, size in pk.pack_block(list(range(60)), sizes, capacity, n):
                filled[p] = filled.get(p, 0) + size
            assert max(filled.values()) <= capacity and sum(filled.values()) == sum(sizes)
