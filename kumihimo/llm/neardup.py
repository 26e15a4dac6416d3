"""Near-duplicate records with small edits (problem 3), by deletion-variant signatures.

A text is cut into units: its sentences, and where there are no stop marks, pieces between
local minima of a hash, which edits elsewhere don't move. Units are put in the order of a hash
of their content, whatever their order in the text, and every two neighbours of this order give
a segment of ten minhash digits over their character 2-grams. All segments together are the
text's signature. Two texts that share well over half of their wording agree in some segment up
to one place. Each segment is indexed under its variants with one place (two digits) replaced
by a wildcard, so an equality join finds them. Partners are then verified on minhash registers
of 5-grams of the whole texts, and the links joined into groups.

Single sentences would meet far more texts that share no more than a sentence of a common
pattern; two together are rarely shared by chance, and neighbours by content survive moves.

Cost: one pass over the texts; ``PLACES`` index rows of 24 bytes for each unit of each distinct
text, moved once; everything after that handles only texts that share a variant. Equal folded
texts are represented by one of them throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kumihimo.operators.components import connected_components
from kumihimo.operators.skew import large_groups, with_group_values
from kumihimo.sources.shared import written

#: A segment has PLACES places that a wildcard may stand for, of DIGITS digits of 5 bits.
PLACES, DIGITS = 5, 2
GRAM = 2
#: Folded characters from which a unit is indexed by itself; a text without any is one unit.
LEAST = 8
#: A longer unit is cut at local minima of a hash among so many characters on either side.
LONG, REACH = 60, 11
#: Partners are verified on longer grams, which tell long texts of one vocabulary apart.
CHECK_GRAM = 5
CHECK_REGISTERS = 112
#: Registers of the brief sketch that the index rows carry, and how many agree at least: 15 or
#: more of 32 do for 98 % of the pairs at the threshold, and for one pair in four without likeness.
BRIEF, BRIEF_LEAST = 32, 15
#: Registers to a word of the rough sketch, which has two bits of each of them.
ROUGH = 28
#: Estimated Jaccard similarity of 5-grams from which two texts are one; texts that share
#: well over half of their wording stand above 0.65, others below 0.35.
THRESHOLD = 0.5
#: A variant shared by more texts than this is linked through one of them first.
HOT = 64
#: Members of a common variant to a block, into which they are dealt, and most blocks of one.
BLOCK, BLOCKS = 512, 64

RE_STOPS = re.compile(r"[。｡．！？!?\r\n]+")

_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("fp_a", T.LongType()),
        T.StructField("fp_b", T.LongType()),
        T.StructField("segments", T.ArrayType(T.LongType())),
        T.StructField("brief", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("rough", T.ArrayType(T.LongType())),
    ]
)


def unit_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the units begin: ``starts`` (of sentences), and cuts within long ones."""
    long = np.flatnonzero(np.diff(starts) > LONG)
    if not len(long):
        return starts
    from kumihimo.llm.batches import mix

    wide = codes.astype(np.uint64)
    h = mix(wide[:-1] * np.uint64(0x100000001B3) + wide[1:] + np.uint64(7))
    padded = np.concatenate([np.full(REACH, 2**64 - 1, np.uint64), h, np.full(REACH, 2**64 - 1, np.uint64)])
    window, step, least = 2 * REACH + 1, 1, padded
    while 2 * step <= window:  # the least of 2 * step from each place on
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(h)], least[window - step :][: len(h)])
    cuts = np.flatnonzero(h == least)
    unit = np.searchsorted(starts, cuts, side="right") - 1
    inside = np.isin(unit, long) & (cuts - starts[unit] >= LEAST) & (starts[unit + 1] - cuts >= LEAST)
    return np.union1d(starts, cuts[inside])


def least_hashes(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per run of grams, none of them empty, the least value of each hash function; the last is for order."""
    rng = np.random.default_rng(20)  # fixed odd multipliers
    factors = [np.uint64(int(rng.integers(0, 2**63)) * 2 + 1) for _ in range(PLACES * DIGITS + 1)]
    out = np.empty((len(begins), len(factors)), dtype=np.uint64)
    if len(begins):
        for i, factor in enumerate(factors):
            out[:, i] = np.minimum.reduceat(hashes * factor, begins)
    return out


def paired(least: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of neighbouring units in the order of their contents, and where each text's begin.

    The order is a ring, so a text of m units has m segments; of two, one; of one, itself.
    """
    order = np.lexsort((least[:, -1], doc))
    least, doc = least[order], doc[order]
    begins = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(begins)[doc]
    place = np.arange(len(doc)) - begins[doc]
    both = np.minimum(least, least[begins[doc] + (place + 1) % np.maximum(count, 1)])
    segments = np.zeros(len(doc), dtype=np.int64)
    for d in range(PLACES * DIGITS):
        segments |= ((both[:, d] >> np.uint64(24)) & np.uint64(31)).astype(np.int64) << (5 * d)
    once = (count != 2) | (place == 0)
    return segments[once], np.searchsorted(doc[once], np.arange(n + 1))


def signatures(df: DataFrame, id_column: str, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """row_id, 128-bit fingerprint, segments, a brief sketch, register bytes, a rough sketch.

    The columns are read as one text, a null as nothing. Rows whose ``required`` columns are
    null, and rows without any letter or digit, have no signature and so no partner.
    The brief sketch is two bits of each of BRIEF registers, the rough one the two lowest of each byte.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kumihimo.llm.batches import binary_column, fingerprints, folded, gram_hashes, minhash_registers, owners

        for batch in batches:
            cells = [batch.column(i + 1).to_pylist() for i in range(len(names))]
            for lo in range(0, batch.num_rows, 2048):
                part = [c[lo : lo + 2048] for c in cells]
                sentences = [RE_STOPS.split("\n".join(t for t in row if t)) for row in zip(*part)]
                n = len(sentences)
                codes, at_sentence = folded([s for text in sentences for s in text])
                first = np.zeros(n + 1, dtype=np.int64)
                first[1:] = np.cumsum([len(text) for text in sentences])
                starts = at_sentence[first]
                fp = fingerprints(codes, starts)
                keep = np.flatnonzero(np.diff(starts) > 0)
                # units: those long enough, or the whole text if none is
                begins = unit_starts(codes, np.unique(at_sentence))
                sizes = np.diff(begins)
                doc = owners(begins[:-1], starts)
                ok = sizes >= LEAST
                hashes, at = gram_hashes(codes, begins, GRAM)
                run_of = owners(at, begins)
                with_grams, run_at = np.unique(run_of, return_index=True)
                good = ok[with_grams]
                least, doc_of = least_hashes(hashes, run_at)[good], doc[with_grams[good]]
                small = np.ones(n, dtype=bool)
                small[doc_of] = False
                gram_doc = doc[run_of] if len(run_of) else run_of
                rest = np.flatnonzero(small[gram_doc]) if len(run_of) else run_of
                small_docs, small_at = np.unique(gram_doc[rest], return_index=True)
                least = np.concatenate([least, least_hashes(hashes[rest], small_at)])
                seg, ends = paired(least, np.concatenate([doc_of, small_docs]), n)
                segments = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(seg))
                hashes, at = gram_hashes(codes, starts, CHECK_GRAM)
                check = minhash_registers(hashes, owners(at, starts), n, CHECK_REGISTERS)
                sketch = binary_column((check & np.uint64(0xFF)).astype(np.uint8))
                two = (check[:, :BRIEF] >> np.uint64(8)) & np.uint64(3)
                brief = (two << (2 * np.arange(BRIEF, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)
                low = (check & np.uint64(3)).reshape(n, -1, ROUGH) << (2 * np.arange(ROUGH, dtype=np.uint64))
                words = low.sum(axis=2, dtype=np.uint64).view(np.int64)
                rough = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
                taken = pa.array(keep)
                arrays = [batch.column(0).slice(lo, n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), segments, pa.array(brief), sketch, rough]
                yield pa.RecordBatch.from_arrays([x.take(taken) for x in arrays], names=_SCHEMA.fieldNames())

    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c)) != "") for c in required], F.lit(True))
    picked = df.where(ok).select(F.col(id_column).cast("long"), *[F.col(c).cast("string") for c in names])
    return picked.mapInArrow(run, _SCHEMA)


def index_rows(reps: DataFrame) -> DataFrame:
    """row_id, brief, variant: each segment under its one-wildcard variants."""
    flat = reps.select("row_id", "brief", F.explode("segments").alias("segment"))
    bits = 5 * DIGITS
    variants = []
    for p in range(PLACES):
        kept = ((1 << (bits * PLACES)) - 1) & ~(((1 << bits) - 1) << (bits * p))
        variants.append(F.col("segment").bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(p << (bits * PLACES))))
    return flat.select("row_id", "brief", F.explode(F.array(*variants)).alias("variant"))


def shared_variants(reps: DataFrame, hot: int) -> DataFrame:
    """Pairs a < row_id that meet in a variant of at most ``hot`` rows, by their brief sketches; a is null in the rows of a more common one.

    The index rows move once: those of a variant stand in order of row_id, and each is held
    against the few before it. Variants of a share of all rows are taken apart and are common.
    The rows of a common variant, each once, have its least row as ``center`` where they may be similar to it.
    """
    centered = F.when((F.col("first") != F.col("row_id")) & may_be_similar("first_brief", "brief"), F.col("first")).alias("center")
    indexed = index_rows(reps)
    large = large_groups(indexed, ["variant"], "row_id")
    rows = indexed if large is None else indexed.join(F.broadcast(large), "variant", "left_anti")
    order = Window.partitionBy("variant").orderBy("row_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.collect_list(F.when(F.col("n") <= hot, F.struct("row_id", "brief"))).over(order.rowsBetween(-max(hot, 1), -1))
    rows = rows.withColumns({"n": F.count("*").over(whole), "first": F.first("row_id").over(whole), "first_brief": F.first("brief").over(whole)}).where("n > 1")
    rows = rows.withColumns({"before": before, "last": F.lag("row_id").over(order)})
    rows = rows.select("variant", "row_id", "brief", "n", "last", centered, F.explode_outer("before").alias("x")).withColumns({"a": F.col("x.row_id"), "brief_a": F.col("x.brief")})
    once = (F.col("n") > hot) & ~F.col("row_id").eqNullSafe(F.col("last"))
    rows = rows.where(once | ((F.col("a") < F.col("row_id")) & may_be_similar("brief_a", "brief")))
    in_common = [F.when(F.col("a").isNull(), F.col(c)).alias(c) for c in ("variant", "brief", "n", "center")]
    rows = rows.select("row_id", "a", *in_common)
    if large is not None:
        taken = indexed.join(F.broadcast(large), "variant", "left_semi")
        stats = taken.groupBy("variant").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.min_by("brief", "row_id").alias("first_brief"))
        taken = taken.distinct().join(F.broadcast(stats), "variant")
        rows = rows.unionByName(taken.select("row_id", F.lit(None).cast("long").alias("a"), "variant", "brief", "n", centered))
    return written(rows)


def may_be_similar(a: str, b: str) -> F.Column:
    """Whether brief sketches agree in as many registers as those of similar texts do."""
    x = F.col(a).bitwiseXOR(F.col(b))
    odd = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return BRIEF - F.bit_count(odd) >= BRIEF_LEAST


def may_be_linked(a: str, b: str, similarity: float) -> F.Column:
    """Whether rough sketches agree in as many registers as those of all texts of this ``register_similarity`` do."""
    differ = F.lit(0)
    for k in range(CHECK_REGISTERS // ROUGH):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x55555555555555)))
    # one register less, for rounding
    return CHECK_REGISTERS - differ >= int(CHECK_REGISTERS * (similarity * 255 + 1) / 256) - 1


def register_similarity(a: str, b: str) -> F.Column:
    """Estimated Jaccard similarity of two texts from their register bytes."""

    @F.pandas_udf(T.FloatType())
    def similar(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float32")
        left = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        equal = (left == right).mean(axis=1)
        return pd.Series(((equal - 1 / 256) / (1 - 1 / 256)).astype("float32"))

    return similar(F.col(a), F.col(b))


def group_links(reps: DataFrame, hot: int = HOT, similarity: float = THRESHOLD) -> DataFrame:
    """Verified links a < b between distinct texts, enough of them to connect every group.

    A variant shared by at most ``hot`` texts gives all its pairs. The members of a more common
    one, all of them, are linked with the least one first; then every member that is not in
    the component of most is tried against all members outside its own component, in blocks,
    which may be as many trials as such a variant has pairs. Links left out
    thereby join texts that are connected anyway, so groups don't depend on ``hot``.
    """
    shared = shared_variants(reps, hot)
    met = shared.where("a is not null").select("a", F.col("row_id").alias("b"))
    links = verified(met.distinct(), reps, similarity)
    warm = shared.where("a is null").select("row_id", "brief", "variant", "n", "center")
    if warm.isEmpty():
        return links
    star = warm.where("center is not null").select(F.col("center").alias("a"), F.col("row_id").alias("b")).distinct()
    links = written(links.unionByName(verified(star, reps, similarity)).distinct())
    known = connected_components(links, "a", "b").withColumnRenamed("node", "row_id")
    placed = warm.join(known, "row_id", "left").join(reps.select("row_id", "rough"), "row_id")
    placed = written(placed.select("row_id", "brief", "rough", "variant", "n", F.coalesce("component", "row_id").alias("component")))
    sizes = placed.groupBy("variant", "component").agg(F.count("*").alias("n"))
    most = written(sizes.groupBy("variant").agg(F.max_by("component", F.struct("n", "component")).alias("most")))
    marked = placed.join(most, "variant").withColumn("odd", F.expr("component <> most"))
    odd = marked.where("odd and n > %d" % BLOCK)
    if marked.where("odd").isEmpty():
        return links
    near = (F.col("cx") != F.col("cy")) & may_be_similar("brief_x", "brief_y") & may_be_linked("rough_x", "rough_y", similarity)
    # a variant of one block: both sides are the same rows, which are moved once
    one = marked.where(F.col("n") <= BLOCK)
    p, q = (one.select("variant", F.col("row_id").alias(m), F.col("brief").alias(f"brief_{m}"), F.col("rough").alias(f"rough_{m}"), F.col("component").alias(f"c{m}"), F.col("odd").alias(f"odd_{m}")) for m in "xy")
    within = p.join(q, "variant").where((F.col("x") < F.col("y")) & (F.col("odd_x") | F.col("odd_y")) & near).select(F.col("x").alias("a"), F.col("y").alias("b"))
    blocks = F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK)).cast("int")
    x = odd.select("variant", F.col("row_id").alias("x"), F.col("brief").alias("brief_x"), F.col("rough").alias("rough_x"), F.col("component").alias("cx"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    y = placed.where(F.col("n") > BLOCK).select("variant", F.col("row_id").alias("y"), F.col("brief").alias("brief_y"), F.col("rough").alias("rough_y"), F.col("component").alias("cy"), F.pmod(F.xxhash64("row_id"), blocks).cast("int").alias("block"))
    rest = x.join(y, ["variant", "block"]).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    rest = rest.unionByName(within).distinct()
    return links.unionByName(verified(written(rest), reps, similarity))


def verified(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose registers agree to at least ``similarity``."""
    left = reps.select(F.col("row_id").alias("a"), F.col("sketch").alias("sketch_a"))
    right = reps.select(F.col("row_id").alias("b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(register_similarity("sketch_a", "sketch_b") >= similarity).select("a", "b")


def near_duplicate_groups(df: DataFrame, id_column: str, columns: Sequence[str], required: Sequence[str] = (), hot: int = HOT, similarity: float = THRESHOLD) -> DataFrame:
    """One row for every row that has a near-duplicate: row_id, group_id.

    ``group_id`` is the least row id of the group's texts. Rows without text, or alone, have
    no row; copies of one text are a group; ids are taken to be unique; an empty table gives
    an empty one. ``hot`` changes the plan, not the groups.
    """
    sigs = written(signatures(df, id_column, columns, required))
    prints = sigs.select("row_id", "fp_a", "fp_b")
    member = with_group_values(prints, ["fp_a", "fp_b"], {"rep": F.min("row_id"), "copies": F.count("*")}, "row_id")
    member = written(member.where("copies > 1").select("row_id", "rep", "copies"))
    reps = sigs.join(member.where("row_id <> rep").select("row_id"), "row_id", "left_anti")
    links = written(group_links(reps, hot, similarity))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    copies = member.join(groups, "rep", "left").select("row_id", F.coalesce("component", "rep").alias("group_id"))
    single = groups.join(member.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("row_id"), F.col("component").alias("group_id"))
    return copies.unionByName(single)


def pairs_of(groups: DataFrame) -> DataFrame:
    """All pairs row_id_a < row_id_b of each group; as many rows as the groups have pairs."""
    a = groups.select("group_id", F.col("row_id").alias("row_id_a"))
    b = groups.select("group_id", F.col("row_id").alias("row_id_b"))
    return a.join(b, "group_id").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
