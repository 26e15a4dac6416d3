"""Subject areas of each document (problem 4): labelling functions and a latent model.

A lexicon is learned from a bounded sample of labelled rows: script runs that stand mostly in
rows of one subject. So are two kinds of cues: phrases of sentences whose subject isn't the
row's, which set a subject apart, and what follows the terms that are the row's subject most
reliably, as it follows an addressee. Labelling functions then vote on every row: the lexicon
in each section (one vote per sentence and subject), the addressees, and the imperfect label
of the source. A latent model, in which a row is about one subject or two and every vote is
right with its function's accuracy, learns the accuracies and the share of rows of two subjects
without truth, by expectation maximisation over labelled rows that the lexicon wasn't learned
from, so a label doesn't vote on what it taught. Subjects are assigned where their posterior
probability is high enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kumihimo.sources.shared import written

#: Labelled rows from which the lexicon is learned, at most.
SAMPLE = 20_000
#: Terms of the lexicon, at most; more are refused. With 60 bytes each they are broadcast.
MOST_TERMS = 50_000
#: Rows of the sample a term must stand in, and the smoothed share of its main subject there.
LEAST_ROWS = 4
PURITY = 0.6
SMOOTHING = 3.0
#: One labelled key in HELD is kept from the lexicon; on those rows the accuracies are learned.
HELD = 4
#: Characters of a cue, sentences of the sample it must stand in, and the shares of those whose
#: subject isn't the row's (set apart) or is (addressees).
CUE, AFTER, LEAST_SENTENCES, APART, ADDRESSED = 4, 2, 20, 0.8, 0.97
#: Posterior probability from which a row is about a subject.
POSTERIOR = 0.5

RE_TERM = re.compile(r"[一-鿿々ァ-ヺーA-Za-z]{2,}")
RE_SENTENCE = re.compile(r"[。\n]")
FUNCTIONS = ("n_objective", "n_summary", "n_address", "n_label")


def sentences_of(text: str | None) -> Iterator[str]:
    from kumihimo.llm.glyphs import clean

    for sentence in RE_SENTENCE.split(clean(text)) if text else ():
        if sentence:
            yield sentence


def known_terms(sentence: str, lexicon: dict[str, str]) -> list[tuple[str, str]]:
    """Subject of each term of the lexicon in a sentence, and what follows the term."""
    hits = ((lexicon.get(m.group()), m.end()) for m in RE_TERM.finditer(sentence))
    return [(subject, sentence[end : end + AFTER]) for subject, end in hits if subject]


def subject_labels(features: DataFrame, subjects: Sequence[str], key: str, label: str) -> DataFrame:
    """One subject code per key: blanks, case and single digits repaired, unknown codes dropped."""
    code = F.upper(F.trim(F.col(label)))
    code = F.regexp_replace(code, "^([A-Z])([0-9])$", "$10$2")
    known = features.select(F.col(key).alias("label_key"), code.alias("label")).where(F.col("label").isin(list(subjects)) & F.col("label_key").isNotNull())
    return known.groupBy("label_key").agg(F.mode("label", True).alias("label"))


def label_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """label_key, label, held: at most ``sample`` keys, the first by hash, whatever their order or partitions."""
    chosen = labels.orderBy(F.xxhash64("label_key"), "label_key").limit(sample)
    return chosen.withColumn("held", F.pmod(F.xxhash64("label_key", F.lit("held")), F.lit(HELD)) == 0)


def learn_lexicon(df: DataFrame, chosen: DataFrame, key: str, sections: Sequence[str]) -> dict[str, str]:
    """Terms of mostly one subject, from the rows of the chosen keys."""
    # the sample is bounded by SAMPLE keys
    rows = df.select(F.col(key).alias("label_key"), *[F.col(c).cast("string") for c in sections]).join(F.broadcast(chosen), "label_key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                terms = {t for text in row[1:] for sentence in sentences_of(text) for t in RE_TERM.findall(sentence)}
                seen.update((t, row[0]) for t in terms)
                seen[("", row[0])] += 1
            terms, subjects = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(subjects, pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "label", "n"])

    counts = rows.select("label", *sections).mapInArrow(count, "term string, label string, n long").groupBy("term", "label").agg(F.sum("n").alias("n"))
    counts = written(counts)
    prior = {r["label"]: r["n"] for r in counts.where("term = ''").collect()}  # a row per subject
    whole = sum(prior.values())
    if not whole:
        return {}
    prior_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in prior.items() for x in (k, v / whole)]), F.col("label")), F.lit(0.0))
    totals = counts.where("term <> ''").groupBy("term").agg(F.sum("n").alias("rows"), F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("top"))
    pure = totals.where((F.col("rows") >= LEAST_ROWS) & ((F.col("top") + SMOOTHING * prior_of) / (F.col("rows") + SMOOTHING) >= PURITY))
    lexicon = {r["term"]: r["label"] for r in pure.select("term", "label").limit(MOST_TERMS + 1).collect()}
    if len(lexicon) > MOST_TERMS:
        raise ValueError(f"the lexicon has more than {MOST_TERMS} terms; raise LEAST_ROWS")
    return lexicon


def learn_cues(df: DataFrame, chosen: DataFrame, lexicon: dict[str, str], key: str, sections: Sequence[str]) -> tuple[set[str], set[str]]:
    """Phrases that set a subject apart, and what follows addressees, from the rows of the chosen keys.

    A sentence of a single subject is the row's own if that is the row's label or the subject of
    another of its sentences.
    """
    rows = df.select(F.col(key).alias("label_key"), *[F.col(c).cast("string") for c in sections]).join(F.broadcast(chosen), "label_key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for label, *texts in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                found = [(s, known_terms(s, lexicon)) for text in texts for s in sentences_of(text)]
                single = [(s, hits) for s, hits in found if len({h[0] for h in hits}) == 1]
                often = Counter(hits[0][0] for _, hits in single)
                for s, hits in single:
                    own = hits[0][0] == label or often[hits[0][0]] > 1
                    plain = RE_TERM.sub(lambda m: " " if m.group() in lexicon else m.group(), s)
                    seen.update(("cue", g, own) for g in {plain[i : i + CUE] for i in range(len(plain) - CUE + 1)} if " " not in g)
                    seen.update(("after", h[1], own) for h in hits if len(h[1]) == AFTER)
            kinds, grams, own = zip(*seen) if seen else ((), (), ())
            arrays = [pa.array(kinds, pa.string()), pa.array(grams, pa.string()), pa.array(own, pa.bool_()), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "gram", "own", "n"])

    counts = rows.select("label", *sections).mapInArrow(count, "kind string, gram string, own boolean, n long")
    rates = counts.groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own"))
    share = F.col("own") / F.col("n")
    cues = rates.where((F.col("n") >= LEAST_SENTENCES) & (((F.col("kind") == "cue") & (share <= 1 - APART)) | ((F.col("kind") == "after") & (share >= ADDRESSED))))
    taken = cues.select("kind", "gram").limit(MOST_TERMS + 1).collect()
    if len(taken) > MOST_TERMS:
        raise ValueError(f"there are more than {MOST_TERMS} cues; raise LEAST_SENTENCES")
    return {g for k, g in taken if k == "cue"}, {g for k, g in taken if k == "after"}


def votes(df: DataFrame, lexicon: dict[str, str], apart: set[str], addressing: set[str], id_column: str, key: str, objective: str, summary: str) -> DataFrame:
    """Per row the subjects voted for and the votes of the three text functions for each.

    Rows with neither text are left out; a row whose texts have no term has no subjects.
    """
    schema = "row_id long, label_key string, subjects array<string>, n_objective array<int>, n_summary array<int>, n_address array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        cues = ahocorasick.Automaton()
        for g in apart:
            cues.add_word(g, g)
        if apart:
            cues.make_automaton()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for o, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                by: list[Counter] = [Counter(), Counter(), Counter()]
                for i, text in enumerate((o, s)):
                    for sentence in sentences_of(text):
                        hits = known_terms(sentence, lexicon)
                        if hits and not (apart and next(cues.iter(sentence), None)):
                            by[i].update({h[0] for h in hits})
                            by[2].update({h[0] for h in hits if h[1] in addressing})
                subjects = sorted(by[0] | by[1] | by[2])
                out[0].append(subjects)
                for i in range(3):
                    out[i + 1].append([by[i][x] for x in subjects])
            arrays = [batch.column(0), batch.column(1), pa.array(out[0], pa.list_(pa.string())), *[pa.array(x, pa.list_(pa.int32())) for x in out[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row_id", "label_key", "subjects", "n_objective", "n_summary", "n_address"])

    some = (F.trim(F.coalesce(F.col(objective), F.lit(""))) != "") | (F.trim(F.coalesce(F.col(summary), F.lit(""))) != "")
    picked = df.where(some).select(F.col(id_column).cast("long"), F.col(key).cast("string"), F.col(objective).cast("string"), F.col(summary).cast("string"))
    return picked.mapInArrow(run, schema)


def with_candidates(voted: DataFrame) -> DataFrame:
    """The votes with the label's as a fourth function: row_id, candidates and an array of each function."""
    both = F.when(F.col("label").isNotNull(), F.array_union("subjects", F.array("label"))).otherwise(F.col("subjects"))
    out = voted.withColumn("candidates", both)
    padded = [F.expr(f"transform(candidates, (x, i) -> coalesce(get({c}, i), 0))").alias(c) for c in FUNCTIONS[:3]]
    return out.select("row_id", "label_key", "candidates", *padded, F.expr("transform(candidates, x -> if(x <=> label, 1, 0))").alias("n_label")).where(F.size("candidates") > 0)


def subject_sets(m: int) -> np.ndarray:
    """Which of m candidates are in each set of one or two."""
    sets = [(i,) for i in range(m)] + [(i, j) for i in range(m) for j in range(i + 1, m)]
    inside = np.zeros((len(sets), m))
    for t, members in enumerate(sets):
        inside[t, list(members)] = 1
    return inside


def set_posteriors(counts: np.ndarray, accuracies: Sequence[float], two: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each set of candidates, for rows of equally many: counts is rows x functions x candidates."""
    inside = subject_sets(counts.shape[2])
    size = inside.sum(axis=1)
    right = counts @ inside.T  # rows x functions x sets
    wrong = counts.sum(axis=2, keepdims=True) - right
    a = np.asarray(accuracies)[None, :, None]
    log = (right * (np.log(a) - np.log(size)) + wrong * (np.log(1 - a) - np.log(np.maximum(k - size, 1)))).sum(axis=1)
    log += np.where(size == 1, math.log((1 - two) / k), math.log(two / max(k * (k - 1) / 2, 1)))
    post = np.exp(log - log.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True), inside


def learn_accuracies(rows: Sequence[Sequence[Sequence[int]]], k: int, rounds: int = 40) -> tuple[list[float], float]:
    """Accuracy of each function, and the share of rows of two subjects.

    A row is the votes of each function for each of its candidates; ``k`` is the number of all subjects.
    """
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row[0]), []).append(row)
    groups = [np.array(g, dtype=float) for g in by_size.values()]
    accuracies, two = np.full(len(FUNCTIONS), 0.8), 0.2
    for _ in range(rounds if groups else 0):
        right, votes_cast, twos, n = np.zeros(len(FUNCTIONS)), np.zeros(len(FUNCTIONS)), 0.0, 0
        for counts in groups:
            post, inside = set_posteriors(counts, accuracies, two, k)
            right += np.einsum("rjt,rt->j", counts @ inside.T, post)
            votes_cast += counts.sum(axis=(0, 2))
            twos += (post * (inside.sum(axis=1) == 2)).sum()
            n += len(counts)
        accuracies = np.clip((right + 1) / (votes_cast + 2), 0.05, 0.995)
        two = min(max((twos + 1) / (n + 2), 0.01), 0.9)
    return accuracies.tolist(), float(two)


def posterior_subjects(votes_of: DataFrame, accuracies: Sequence[float], two: float, k: int) -> DataFrame:
    """row_id, policy_domain, probability of every candidate of every row."""
    accuracies = list(accuracies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, candidates = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cells = [batch.column(i + 2).to_pylist() for i in range(len(FUNCTIONS))]
            by_size: dict[int, list[int]] = {}
            for i, c in enumerate(candidates):
                by_size.setdefault(len(c), []).append(i)
            out: list[list] = [[], [], []]
            for own in by_size.values():
                counts = np.array([[cells[j][i] for j in range(len(FUNCTIONS))] for i in own], dtype=float)
                post, inside = set_posteriors(counts, accuracies, two, k)
                for i, probabilities in zip(own, (post @ inside).tolist()):
                    out[0] += [ids[i]] * len(probabilities)
                    out[1] += candidates[i]
                    out[2] += probabilities
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["row_id", "policy_domain", "probability"])

    return votes_of.select("row_id", "candidates", *FUNCTIONS).mapInArrow(run, "row_id long, policy_domain string, probability double")


def assign_subjects(df: DataFrame, features: DataFrame, subjects: DataFrame, id_column: str, key: str, objective: str, summary: str, posterior: float = POSTERIOR, sample: int = SAMPLE) -> DataFrame:
    """row_id, policy_domain, probability: one row per subject a row is about.

    ``features`` has the key and policy_domain, ``subjects`` the codes (at most 1000). Rows
    with neither text have none; rows whose texts tell nothing take the source's label, if
    they have one. Equal rows are judged each. Without labels there is no lexicon, and no
    subject.
    """
    codes = [r[0] for r in subjects.where("policy_domain IS NOT NULL").select("policy_domain").distinct().limit(1001).collect()]
    if len(codes) > 1000:
        raise ValueError("more than 1000 subjects")
    labels = written(subject_labels(features, codes, key, "policy_domain"))
    chosen = written(label_sample(labels, sample))
    taught = chosen.where("NOT held").select("label_key", "label")
    lexicon = learn_lexicon(df, taught, key, [objective, summary])
    apart, addressing = learn_cues(df, taught, lexicon, key, [objective, summary])
    voted = written(with_candidates(votes(df, lexicon, apart, addressing, id_column, key, objective, summary).join(labels, "label_key", "left")))
    held = voted.join(F.broadcast(chosen.where("held").select("label_key")), "label_key", "left_semi").select(*FUNCTIONS)
    # as many rows as keys at most: a key's repeated rows don't make the model's sample larger
    rows = [tuple(r) for r in held.limit(sample).collect()]
    accuracies, two = learn_accuracies(rows, max(len(codes), 2))
    return posterior_subjects(voted, accuracies, two, max(len(codes), 2)).where(F.col("probability") >= posterior)


def composition(assigned: DataFrame) -> DataFrame:
    """Subject, rows about it, and its share of the corpus (a row of two subjects counts half for each)."""
    per_row = assigned.groupBy("row_id").agg(F.count("*").alias("k"), F.collect_set("policy_domain").alias("d"))
    flat = per_row.select(F.explode("d").alias("policy_domain"), (1 / F.col("k")).alias("part"))
    sums = flat.groupBy("policy_domain").agg(F.count("*").alias("rows"), F.sum("part").alias("weight"))
    total = sums.agg(F.sum("weight")).first()[0] or 1.0
    return sums.select("policy_domain", "rows", (F.col("weight") / F.lit(float(total))).alias("share"))
