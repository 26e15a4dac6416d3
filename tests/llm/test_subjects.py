import random

import pytest

from kumihimo.llm import subjects as sj

TRAIN = "row_id long, project_id string, o string, s string, label string, subjects string"
NOUNS = {"D01": ["望遠鏡", "触媒反応", "加速器", "試料分析"], "D05": ["病床", "透析施設", "予防接種", "看護師"], "D10": ["橋梁", "除雪車", "滑走路", "踏切"]}


def sentence(rng, d):
    return f"{rng.choice(NOUNS[d])}に係る費用は一件当たり約{rng.randrange(99)}万円である。"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows, labels, truth = [], [], {}
    for i in range(300):
        d = rng.choice(list(NOUNS))
        e = rng.choice(list(NOUNS)) if i % 4 == 0 else d
        s = "".join(sentence(rng, d) for _ in range(5)) + "".join(sentence(rng, e) for _ in range(4)) * (e != d)
        other = rng.choice([x for x in NOUNS if x not in (d, e)])
        s += f"なお、{rng.choice(NOUNS[other])}は本事業の対象に含まない。" * (i % 5 == 0)
        rows.append((i, f"P{i}", sentence(rng, d) if i % 3 else None, s, "clash", "clash"))
        truth[i] = {d, e}
        if i % 2:
            labels.append((f"P{i}", rng.choice(list(NOUNS)) if i % 15 == 1 else d.lower().replace("0", "") if i % 7 == 0 else d))
    rows += [(900, "P900", None, None, "clash", "clash"), (901, "P901", "", " ", "clash", "clash"), (902, None, "橋梁", None, "clash", "clash")]
    labels += [("P1", None), ("P900", "D01"), (None, "D01"), ("P3", "D77")]
    return (
        spark.createDataFrame(rows, TRAIN),
        spark.createDataFrame(labels, "project_id string, policy_domain string"),
        spark.createDataFrame([("D01",), ("D05",), ("D10",), (None,)], "policy_domain string"),
        truth,
    )


def assign(train, features, domains):
    out = {}
    for r in sj.assign_subjects(train, features, domains, "row_id", "project_id", "o", "s").collect():
        out.setdefault(r["row_id"], set()).add(r["policy_domain"])
    return out


def test_held_out_accuracy(tables):
    train, features, domains, truth = tables
    got = assign(train, features, domains)
    right = sum(got.get(i) == t for i, t in truth.items())
    assert right / len(truth) > 0.97
    assert 900 not in got and 901 not in got and got[902] == {"D10"}


def test_composition_sums_to_one(tables):
    train, features, domains, _ = tables
    shares = sj.composition(sj.assign_subjects(train, features, domains, "row_id", "project_id", "o", "s")).collect()
    assert sum(r["share"] for r in shares) == pytest.approx(1)


def test_empty_tables(tables):
    train, features, domains, _ = tables
    assert assign(train.where("false"), features, domains) == {}
    assert assign(train, features.where("false"), domains) == {}


def test_accuracies_are_learned():
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        own = rng.sample("abcdef", 2 if rng.random() < 0.3 else 1)
        votes = [[rng.choice(own) if rng.random() < p else rng.choice([c for c in "abcdef" if c not in own]) for _ in range(3)] for p in (0.95, 0.8, 0.6, 0.9)]
        seen = sorted({v for f in votes for v in f})
        rows.append([[f.count(c) for c in seen] for f in votes])
    accuracies, two = sj.learn_accuracies(rows, 6)
    assert accuracies == pytest.approx([0.95, 0.8, 0.6, 0.9], abs=0.05) and two == pytest.approx(0.3, abs=0.06)
    assert sj.learn_accuracies([], 6) == ([0.8] * 4, 0.2)


def test_phrases_that_set_a_subject_apart_are_learned(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        d, e = rng.sample(list(NOUNS), 2)
        rows.append((i, f"P{i}", None, "".join(sentence(rng, d) for _ in range(3)) + (f"{rng.choice(NOUNS[e])}の窓口は別の制度で扱う。" if i % 2 else ""), d, ""))
    df = spark.createDataFrame(rows, TRAIN)
    lexicon = {t: d for d, terms in NOUNS.items() for t in terms}
    chosen = spark.createDataFrame([(r[1], r[4]) for r in rows], "label_key string, label string")
    apart, _ = sj.learn_cues(df, chosen, lexicon, "project_id", ["o", "s"])
    assert "別の制度" in apart and not any("費用" in g for g in apart)


def test_long_text_and_ties(spark, tables):
    train, features, domains, _ = tables
    rng = random.Random(9)
    tie = "".join(sentence(rng, d) for d in ("D01", "D05"))
    extra = spark.createDataFrame([(950, "X", None, tie, "", ""), (950, "X", None, tie, "", ""), (951, "Y", None, sentence(rng, "D10") * 3000, "", "")], TRAIN)
    got = assign(train.unionByName(extra), features, domains)
    assert got[950] == {"D01", "D05"} and got[951] == {"D10"}
