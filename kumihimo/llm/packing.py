"""Filling fixed-capacity containers with items (problem 7), by bin completion.

Items are dealt by a hash of their id into blocks of about ``BLOCK`` items, each packed on
its own; a block wastes at most about one container, so the loss falls as the block grows,
and blocks are packed in parallel. A block's incumbent is its best-fit solution; where that
needs as many containers as the sum of sizes does at least, nothing can be better and the
search is cut. Otherwise the largest item left opens a container, and fillings around it are
searched by branch and bound: a branch is cut when the room it can still fill, bounded by the
sizes left, can't waste less than the best filling so far. Fillings are tried from the largest
sizes down and replaced only by less waste, so a filling that another dominates, by holding a
larger item in place of smaller ones, is never preferred to it. The solution with fewer
containers is kept. An item above the capacity is split into full containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Items of a block on average; a block's size in memory is bounded by it.
BLOCK = 2000
#: Nodes that the search around one item may visit before it keeps its best filling; 0 for all.
NODES = 400


def complete(room: int, sizes: list[int], counts: list[int], nodes: int = NODES) -> list[int]:
    """Multiset of sizes that fills ``room`` best, as indexes into ascending ``sizes``.

    Depth first from the largest size that fits, so the first leaf is the best-fit filling.
    A branch that leaves room in which nothing fits is a maximal filling; branches whose
    room can't be filled to less waste than the incumbent's are pruned. Stops at no waste
    or, if ``nodes`` isn't 0, after so many nodes, with the best filling so far.
    """
    best: list[int] = []
    best_waste = room
    left = counts
    visited = 0
    chosen: list[int] = []

    def search(room: int, top: int) -> bool:
        nonlocal best, best_waste, visited
        visited += 1
        if room < best_waste:
            best, best_waste = chosen.copy(), room
            if best_waste == 0:
                return True
        if nodes and visited >= nodes:
            return True
        top = min(top, bisect_right(sizes, room) - 1)
        while top >= 0:
            if left[top] > 0:
                # all that is left down to here can't bring the waste below the incumbent's
                if room - _reach(room, top) >= best_waste:
                    return False
                left[top] -= 1
                chosen.append(top)
                done = search(room - sizes[top], top)
                chosen.pop()
                left[top] += 1
                if done:
                    return True
            top -= 1
        return False

    def _reach(room: int, top: int) -> int:
        total = 0
        for i in range(top, -1, -1):
            if left[i]:
                total += sizes[i] * left[i]
                if total >= room:
                    return room
        return total

    search(room, len(sizes) - 1)
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``sizes`` by container: from the largest on, each into the fullest that has room."""
    rooms: list[tuple[int, int]] = []  # (room left, container), ascending
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = capacity, len(out)
            out.append([])
        out[k].append(i)
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], k))
    return out


def pack_block(ids: list[int], sizes: list[int], capacity: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """(pack, id, piece, start, length) for every piece of every item of a block."""
    out: list[tuple[int, int, int, int, int]] = []
    pack = 0
    rest: list[tuple[int, int, int, int]] = []  # size, id, piece, start
    for i, n in zip(ids, sizes):
        start = piece = 0
        while n - start > capacity:
            out.append((pack, i, piece, start, capacity))
            pack, start, piece = pack + 1, start + capacity, piece + 1
        if n > start:
            rest.append((n - start, i, piece, start))
    rest.sort(key=lambda x: (x[0], -x[1]))
    known = best_fit([x[0] for x in rest], capacity)
    packs = known if len(known) <= -(-sum(x[0] for x in rest) // capacity) else min(known, completed(rest, capacity, nodes), key=len)
    for items in packs:
        out += [(pack, rest[k][1], rest[k][2], rest[k][3], rest[k][0]) for k in items]
        pack += 1
    return out


def completed(rest: list[tuple[int, int, int, int]], capacity: int, nodes: int) -> list[list[int]]:
    """Indexes of the ascending pieces ``rest`` by container, by bin completion."""
    out: list[list[int]] = []
    distinct = sorted({x[0] for x in rest})
    of = {n: k for k, n in enumerate(distinct)}
    stacks: list[list[int]] = [[] for _ in distinct]
    for k, x in enumerate(rest):
        stacks[of[x[0]]].append(k)
    counts = [len(s) for s in stacks]
    top = len(distinct) - 1
    while top >= 0:
        if not counts[top]:
            top -= 1
            continue
        counts[top] -= 1
        taken = [top]
        room = capacity - distinct[top]
        if room:
            filling = complete(room, distinct[: bisect_right(distinct, room)], counts, nodes)
            for k in filling:
                counts[k] -= 1
            taken += filling
        out.append([stacks[k].pop() for k in taken])
    return out


def pack(items: DataFrame, capacities: DataFrame, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """pack_size_id, pack_id, doc_id, piece, start_token, n_tokens for each capacity.

    ``items`` has doc_id and n_tokens, ``capacities`` pack_size_id and capacity_tokens. Each
    item is placed once for every capacity, whole unless larger than it. Items of no tokens
    are in no pack; equal items are packed each; capacities below 1 are refused.
    """
    sizes = [(int(r[0]), int(r[1])) for r in capacities.select("pack_size_id", "capacity_tokens").distinct().limit(1001).collect()]
    if len(sizes) > 1000 or any(c < 1 for _, c in sizes):
        raise ValueError("capacities must be 1 or more, and at most 1000 of them")
    some = items.where("n_tokens > 0").select("doc_id", "n_tokens")
    n_blocks = max(1, -(-some.count() // block))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        # the items' order doesn't depend on how they arrived
        group = group.sort_values("doc_id")
        ids, tokens = group["doc_id"].tolist(), group["n_tokens"].tolist()
        for size_id, capacity in sizes:
            rows += [(size_id, f"{size_id}-{key[0]}-{p}", *x) for p, *x in pack_block(ids, tokens, capacity, nodes)]
        return pd.DataFrame(rows, columns=["pack_size_id", "pack_id", "doc_id", "piece", "start_token", "n_tokens"])

    # a stated number of partitions: adaptive execution would put small blocks into one task
    dealt = some.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))).repartition(min(n_blocks, 4096), "block")
    return dealt.groupBy("block").applyInPandas(run, "pack_size_id int, pack_id string, doc_id long, piece int, start_token long, n_tokens long")


def pack_report(packs: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: packs, tokens, the least number of packs there can be, and the fill."""
    used = packs.groupBy("pack_size_id").agg(F.count_distinct("pack_id").alias("packs"), F.sum("n_tokens").alias("tokens"))
    both = used.join(capacities.select("pack_size_id", "capacity_tokens").distinct(), "pack_size_id")
    return both.select(
        "pack_size_id", "capacity_tokens", "packs", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_packs"),
        (F.col("tokens") / (F.col("packs") * F.col("capacity_tokens"))).alias("fill"),
    )
