"""Best-fit packing of token runs into sequences by a grouping genetic algorithm.

Items are dealt at random into groups of about ``group_items``. For each group, ``islands``
populations of packings evolve apart: a child takes whole well-filled bins of one parent into a
copy of the other, bins that then hold an item twice are dissolved, and the displaced items go
where they fit best. After each epoch an island's best packing migrates to the next island of its
group, and at the end the best packing of a group wins. The poorly filled bins of all groups then
form new, fewer groups and evolve once more, until one group is left or nothing is gained.

An island whose packing has as few bins as the items' sum allows is done: no packing is better.
Where best fit by falling size, the first packing, comes to that at once, nothing is crossed.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, make_room, saved

GROUP_ITEMS, ISLANDS, POPULATION, CHILDREN, EPOCHS = 8192, 3, 6, 24, 3
WELL_FILLED = 0.995


class Packing:
    """Bins (lists of item numbers) with their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the sum of squared fill."""
        return -len(self.bins), sum(x * x for x in self.loads) / capacity**2


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> Packing:
    """Put ``items``, in this order, each into the fullest bin with room, else into a new one."""
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in items:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            loads[b] += size
        else:
            left, b = capacity, len(bins)
            bins.append([i])
            loads.append(size)
        if left > size:
            insort(room, (left - size, b))
    return Packing(bins, loads)


def crossover(one: Packing, other: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Inject some of ``other``'s best-filled bins into ``one``; dissolve the bins that then hold
    an item twice, with a few poorly filled ones, and best-fit what they held."""
    order = np.argsort(other.loads)[::-1]
    good = order[: max(1, int(np.searchsorted(-np.sort(other.loads)[::-1], -WELL_FILLED * capacity, side="right")))]
    pick = rng.choice(good, size=max(1, min(len(good), len(order) // 8)), replace=False)
    bins, loads = [list(other.bins[b]) for b in pick], [other.loads[b] for b in pick]
    held = {i for b in bins for i in b}
    displaced: list[int] = []
    worst = set(np.argsort(one.loads)[: max(1, len(one.loads) // 50)].tolist())
    for k, (b, load) in enumerate(zip(one.bins, one.loads, strict=True)):
        if k in worst or any(i in held for i in b):
            displaced.extend(i for i in b if i not in held)
        else:
            bins.append(b.copy())
            loads.append(load)
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, bins, loads)


def first_packing(sizes: list[int], capacity: int, rng: np.random.Generator, plain: bool) -> Packing:
    """Best fit by falling size; but for the plain one, sizes are shaken a little first."""
    noise = np.zeros(len(sizes)) if plain else rng.normal(0, 0.03 * capacity, len(sizes))
    return best_fit(np.argsort(-(np.array(sizes) + noise), kind="stable").tolist(), sizes, capacity, [], [])


def encode(p: Packing, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for b, items in enumerate(p.bins):
        out[items] = b
    return out.tobytes()


def decode(raw: bytes, sizes: list[int]) -> Packing:
    of = np.frombuffer(raw, np.int32)
    order = np.argsort(of, kind="stable")
    bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]
    return Packing(bins, [sum(sizes[i] for i in b) for b in bins])


def evolve(sizes: list[int], capacity: int, seed: int, start: list[bytes], population: int, children: int) -> tuple[bytes, int, float, int]:
    """One island's epoch, from the packings in ``start`` and fresh ones: its best packing, its
    bins and fill, and the number of crossovers."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // capacity)
    pool = [decode(s, sizes) for s in start]
    while len(pool) < population and not (pool and len(pool[0].bins) <= bound):
        pool.append(first_packing(sizes, capacity, rng, plain=not pool))
    rank = lambda p: p.fitness(capacity)
    crossed = 0
    for _ in range(children):
        pool.sort(key=rank, reverse=True)
        if len(pool[0].bins) <= bound:  # no packing has fewer
            break
        x, y = (rng.permutation(len(pool))[:2].tolist() * 2)[:2]
        pool.append(crossover(pool[x], pool[y], sizes, capacity, rng))
        crossed += 1
        pool.sort(key=rank, reverse=True)
        del pool[population:]
    best = max(pool, key=rank)
    return encode(best, len(sizes)), len(best.bins), best.fitness(capacity)[1], crossed


def _evolved(groups: DataFrame, capacity: int, islands: int, population: int, children: int, epochs: int) -> DataFrame:
    """``grp, sizes, best``: the winning packing of each group."""
    state = groups.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).select("grp", "island", "sizes", F.lit(None).cast("array<binary>").alias("start"))
    for epoch in range(epochs):

        def run(frames, epoch=epoch):
            make_room()
            for pdf in frames:
                rows = []
                for grp, island, sizes, start in zip(pdf.grp, pdf.island, pdf.sizes, pdf.start, strict=True):
                    raw, n, fill, _ = evolve([int(x) for x in sizes], capacity, hash((int(grp), int(island), epoch)) & 0xFFFFFFFF, [] if start is None else list(start), population, children)
                    rows.append((grp, island, raw, n, fill))
                yield pd.DataFrame(rows, columns=["grp", "island", "best", "bins", "fill"])

        # One row is a whole island's work: deal them out one by one.
        best = saved(state.repartition("grp", "island").mapInPandas(run, "grp long, island int, best binary, bins long, fill double"), "islands")
        if epoch + 1 < epochs:
            elite = best.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("best").alias("elite"))
            own = best.join(elite, ["grp", "island"]).select("grp", "island", F.array("best", "elite").alias("start"))
            state = groups.join(own, "grp").select("grp", "island", "sizes", "start")
    won = best.groupBy("grp").agg(F.max(F.struct(-F.col("bins"), "fill", -F.col("island"), "best")).alias("won"))
    return groups.join(won.select("grp", "won.best"), "grp")


def _packed(items: DataFrame, capacity: int, group_items: int, islands: int, population: int, children: int, epochs: int, n: int, level: int) -> DataFrame:
    """``item, length`` to ``item, length, level, grp, bin, load, offset``."""
    count = max(1, -(-n // group_items))
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(count)))
    rows = dealt.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("length", "item"))).alias("items"))
    rows = saved(rows, "groups")
    groups = rows.select("grp", F.col("items.length").alias("sizes"))
    best = _evolved(groups, capacity, islands, population, children, epochs).select("grp", "best")

    def place(frames):
        make_room()
        for pdf in frames:
            for grp, items_, best_ in zip(pdf.grp, pdf["items"], pdf.best, strict=True):
                length = np.array([x["length"] for x in items_], np.int64)
                of = np.frombuffer(best_, np.int32)
                load = np.bincount(of, weights=length).astype(np.int64)
                order = np.argsort(of, kind="stable")
                before = np.cumsum(length[order]) - length[order]
                offset = np.empty(len(of), np.int64)
                offset[order] = before - (np.cumsum(load) - load)[of[order]]
                yield pd.DataFrame({"item": [x["item"] for x in items_], "length": length, "grp": grp, "bin": of, "load": load[of], "offset": offset})

    return saved(rows.join(best, "grp").mapInPandas(place, "item long, length long, grp long, bin int, load long, offset long"), "placed").withColumn("level", F.lit(level))


def pack(
    pieces: DataFrame, capacity: int, group_items: int = GROUP_ITEMS, islands: int = ISLANDS, population: int = POPULATION,
    children: int = CHILDREN, epochs: int = EPOCHS, refill: float = 0.97,
) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with ``sequence_id`` and ``offset``. A length
    that is null or not from 1 to ``capacity`` raises, as no sequence could hold it.

    Runs of full length are sequences of their own. Bins filled below ``refill`` are packed anew
    together, over fewer groups each time. The order inside a sequence and its number carry no
    meaning. An empty table gives an empty result; equal lengths (ties) are taken in item order.
    Input columns named sequence_id or offset are replaced; rows that repeat are items of their
    own.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # A number for each row: written first, so that it stays the same.
    item = fresh(keep, "item")
    rows = saved(pieces.select(*keep).withColumn(item, F.monotonically_increasing_id()), "items")
    held = F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    length = F.when(held, F.col("length").cast("long")).otherwise(F.raise_error(F.lit(f"a length is not from 1 to {capacity}")))
    short = rows.select(F.col(item).alias("item"), length.alias("length")).filter(F.col("length") < capacity)
    n = short.count()
    done, level, placed = [], 0, None
    while n:
        placed = _packed(short, capacity, group_items, islands, population, children, epochs, n, level)
        poor = placed.filter(F.col("load") < refill * capacity)
        left = poor.count()
        if n <= group_items or left == 0 or left >= n:
            done.append(placed)
            break
        done.append(placed.filter(F.col("load") >= refill * capacity))
        short, n, level = poor.select("item", "length"), left, level + 1
    full = rows.filter(F.col("length") == capacity).select(F.col(item).alias("item"), F.col(item).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Sequence numbers: full runs keep their row's number; bins lie below zero.
    number = -1 - ((F.col("level").cast("long") * (1 << 56)) + F.col("grp") * (1 << 20) + F.col("bin"))
    for part in done:
        full = full.unionByName(part.select("item", number.alias("sequence_id"), "offset"))
    full = full.select(F.col("item").alias(item), "sequence_id", "offset")
    return rows.join(full, item).select(*keep, "sequence_id", "offset")
