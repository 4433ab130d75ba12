"""Filling fixed-capacity containers with items (problem 7): a grouping genetic algorithm on islands.

An individual is a grouping of items into containers. Crossover injects whole well-filled containers of one parent into the other, drops
the containers that now hold an item twice, lets displaced items take the places of smaller ones where that fills a container better, and best-fits the
rest; mutation empties the least filled containers the same way. Fitness is the mean square of the fill, which prefers few full containers
over many half-full ones.

Distribution. Items are spread over blocks of bounded size (any items pack well together, so no key decides the block and none is
hot) and written once; from then on only sizes and labels move. Each island of a block is its own task; after each round its elite goes on and its best
also to the next island. A block whose first greedy grouping already needs the least possible number of containers has nothing to gain and stays as it
is; its containers are named "greedy". What remains underfilled in all blocks is pooled, spread over new blocks and packed once more.

An item larger than a container is split into full containers and one rest; no other item is split. Items of size 0 (null or empty
texts) need no container and have no row. Null and repeated keys keep one row a piece.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.session import cut_lineage, cut_partitioned, shuffle_width

CAPACITY = 2048
BLOCK_ITEMS = 2000
ISLANDS = 3
ROUNDS = 3
GENERATIONS = 25
POPULATION = 6
#: Groupings of an island that live on to its next round.
ELITE = 2
#: Containers filled less than this are packed again across blocks.
WELL_FILLED = 0.98

Grouping = list[list[int]]


def best_fit(groups: Grouping, items: list[int], sizes: list[int], capacity: int) -> Grouping:
    """Each item, largest first, into the container it leaves fullest; a new one if none has room."""
    room = sorted((capacity - sum(sizes[i] for i in g), k) for k, g in enumerate(groups))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            groups[k].append(i)
            insort(room, (left - sizes[i], k))
        else:
            groups.append([i])
            insort(room, (capacity - sizes[i], len(groups) - 1))
    return groups


def fitness(groups: Grouping, sizes: list[int], capacity: int) -> float:
    return sum((sum(sizes[i] for i in g) / capacity) ** 2 for g in groups) / max(1, len(groups))


def least_containers(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer: by volume, and by the items of which no two fit together."""
    return max(math.ceil(sum(sizes) / capacity), sum(2 * s > capacity for s in sizes))


def refill(groups: Grouping, loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Puts a displaced item in the place of a smaller one wherever that fills a container better (the best such exchange of each); gives what is loose then."""
    pool = sorted((sizes[i], i) for i in loose)
    for g in groups:
        room = capacity - sum([sizes[i] for i in g])
        best = (0, -1, -1)
        for k, i in enumerate(g) if room and pool else ():
            at = bisect_left(pool, (sizes[i] + room + 1, -1)) - 1
            if at >= 0:
                best = max(best, (pool[at][0] - sizes[i], k, at))
        if best[0] > 0:
            _, k, at = best
            _, taken = pool.pop(at)
            insort(pool, (sizes[g[k]], g[k]))
            g[k] = taken
    return [i for _, i in pool]


def cross(a: Grouping, b: Grouping, sizes: list[int], capacity: int, rng: random.Random) -> Grouping:
    share = rng.uniform(0.1, 0.5)
    full = sorted(b, key=lambda g: -sum([sizes[i] for i in g]))[: max(1, len(b) // 2)]
    given = rng.sample(full, max(1, int(len(full) * share)))
    held = {i for g in given for i in g}
    kept, loose = [list(g) for g in given], []
    for g in a:
        if held.isdisjoint(g):
            kept.append(list(g))
        else:
            loose += [i for i in g if i not in held]
    return best_fit(kept, refill(kept, loose, sizes, capacity), sizes, capacity)


def mutate(a: Grouping, sizes: list[int], capacity: int, rng: random.Random) -> Grouping:
    order = sorted(a, key=lambda g: sum([sizes[i] for i in g]))
    n = min(len(order), 2 + rng.randrange(4))
    opened = order[:n] + rng.sample(order[n:], min(len(order) - n, 1 + rng.randrange(3)))
    gone = {id(g) for g in opened}
    loose = [i for g in opened for i in g]
    rng.shuffle(loose)
    kept = [list(g) for g in a if id(g) not in gone]
    return best_fit(kept, refill(kept, loose, sizes, capacity), sizes, capacity)


def evolve(people: list[Grouping], sizes: list[int], capacity: int, rng: random.Random, generations: int) -> list[Grouping]:
    """Some generations of one island, best first; stops when the least number of containers is reached."""
    least = least_containers(sizes, capacity)
    told = lambda g: (-len(g), fitness(g, sizes, capacity))
    scored = sorted([(told(g), g) for g in people], key=lambda x: x[0], reverse=True)  # each is scored once
    for _ in range(generations):
        if len(scored[0][1]) <= least:
            break
        a, b = (x[1] for x in rng.sample(scored, 2)) if len(scored) > 1 else (scored[0][1], scored[0][1])
        child = cross(a, b, sizes, capacity, rng)
        if rng.random() < 0.66:
            child = mutate(child, sizes, capacity, rng)
        scored.append((told(child), child))
        scored = sorted(scored, key=lambda x: x[0], reverse=True)[:POPULATION]
    return [g for _, g in scored]


def _labels(groups: Grouping, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for k, g in enumerate(groups):
        out[g] = k
    return out.tobytes()


def _groups(labels: bytes) -> Grouping:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(labels, np.int32).tolist()):
        out.setdefault(k, []).append(i)
    return list(out.values())


_STATE = "block long, island int, sizes binary, people array<binary>"
_COLUMNS = ["block", "island", "sizes", "people"]


def _islands(sizes: DataFrame, capacity: int, seed: int, rounds: int) -> DataFrame:
    """block, how ("greedy" or "evolved"), labels (the best grouping of each block). sizes: block, sizes (array). The rounds: evolve each island, send
    its best to the next. Only sizes and elites move."""

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block, own in zip(b["block"], b["sizes"]):
                own = [int(x) for x in own]
                first = best_fit([], list(range(len(own))), own, capacity)
                done = rounds == 0 or len(first) <= least_containers(own, capacity)
                data, people = np.array(own, np.int32).tobytes(), [_labels(first, len(own))]
                rows += [(block, -1 if done else island, data, people) for island in range(1 if done else ISLANDS)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    def one_round(r: int):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            row = g.iloc[0]
            block, island, own = int(row["block"]), int(row["island"]), np.frombuffer(row["sizes"], np.int32).tolist()
            rng = random.Random(f"{seed}/{block}/{island}/{r}")
            people = [_groups(p) for p in sorted({bytes(p) for ps in g["people"] for p in ps})]
            people += [mutate(people[0], own, capacity, rng) for _ in range(POPULATION - len(people))]
            elite = [_labels(x, len(own)) for x in evolve(people, own, capacity, rng, GENERATIONS)[:ELITE]]
            out = [(block, island, row["sizes"], elite)]
            if r < rounds - 1:  # the best migrates
                out.append((block, (island + 1) % ISLANDS, row["sizes"], elite[:1]))
            return pd.DataFrame(out, columns=_COLUMNS)

        return run

    def containers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["labels"] = [p[0] for p in b["people"]]
            b["n"] = [int(np.frombuffer(x, np.int32).max()) for x in b["labels"]]
            yield b[["block", "n", "labels"]]

    state = cut_lineage(sizes.mapInPandas(begin, _STATE))
    ready, work = state.where("island < 0"), state.where("island >= 0")
    # a fixed number of tasks: by the few bytes of the islands, planning would put them all into one
    width = max(shuffle_width(sizes.sparkSession), sizes.sparkSession.sparkContext.defaultParallelism)
    for r in range(rounds):
        work = work.repartition(width, "block", "island").groupBy("block", "island").applyInPandas(one_round(r), _STATE)
    best = work.mapInPandas(containers, "block long, n int, labels binary").groupBy("block").agg(F.min_by("labels", F.struct("n", "labels")).alias("labels"))
    return ready.select("block", F.lit("greedy").alias("how"), F.element_at("people", 1).alias("labels")).unionByName(best.select("block", F.lit("evolved").alias("how"), "labels"))


def _pack_blocks(items: DataFrame, level: int, capacity: int, block_items: int, total: int, rounds: int) -> DataFrame:
    """(key, piece, size, container) of each item. items: key, piece, size, written already; total: their number."""
    blocks = max(1, math.ceil(total / block_items))
    # the row's own position is part of the hash, so that equal keys are spread too
    spread = F.pmod(F.xxhash64("key", "piece", "size", F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    gathered = cut_partitioned(items.select(spread, F.struct("key", "piece", "size").alias("item")).groupBy("block").agg(F.collect_list("item").alias("items")))
    packed = _islands(gathered.select("block", F.col("items.size").alias("sizes")), capacity, level, rounds)

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["labels"] = [np.frombuffer(x, np.int32) for x in b["labels"]]
            yield b

    labels = packed.mapInPandas(unfold, "block long, how string, labels array<int>")
    row = gathered.join(labels, "block").select("block", "how", F.explode(F.arrays_zip("items", "labels")).alias("x"))
    return row.select(
        F.col("x.items.key").alias("key"),
        F.col("x.items.piece").alias("piece"),
        F.col("x.items.size").alias("size"),
        F.concat_ws("-", F.lit(level), "how", "block", "x.labels").alias("container"),
    )


def pack(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """One row a piece: key, piece (0 for a whole item), start (in units of size), size, container ("level-how-block-number", or "full-..."). Null sizes
    count as 0. rounds: of evolution; with 0 only the greedy groupings remain, for comparison."""
    if block_items < 1 or capacity < 1:
        raise ValueError("capacity and block_items must be positive")
    rows = cut_lineage(sized.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("total")).where("total > 0"))
    full = rows.where(F.col("total") >= capacity).select(
        "key", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(total DIV {capacity} AS INT) - 1"))).alias("piece"), F.monotonically_increasing_id().alias("at")
    )
    full = full.select("key", "piece", F.lit(capacity).alias("size"), F.concat_ws("-", F.lit("full"), "at", "piece").alias("container"))
    rest = rows.where(F.col("total") % capacity > 0).select("key", F.expr(f"CAST(total DIV {capacity} AS INT)").alias("piece"), (F.col("total") % capacity).cast("int").alias("size"))
    rest = cut_lineage(rest)
    first = cut_lineage(_pack_blocks(rest, 1, capacity, block_items, rest.count(), rounds))
    used = first.groupBy("container").agg(F.sum("size").alias("used"))
    weak = used.where(F.col("used") < WELL_FILLED * capacity).select("container")
    again = cut_lineage(first.join(weak, "container", "left_semi").select("key", "piece", "size"))
    kept = first.join(weak, "container", "left_anti").select("key", "piece", "size", "container")
    second = _pack_blocks(again, 2, capacity, block_items, again.count(), rounds)
    return full.unionByName(kept).unionByName(second).select(
        F.col("key").alias(key), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size", "container"
    )
