"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their ids, are cut into blocks of
equal count. Time is counted in blocks of the mix. Block i of a source of weight w is
released at floor((i-1)/w) and due at ceil(i/w); among released blocks the one due
first goes next. Times are worked out in whole numbers from the weights as given, so
at every moment of a phase each source has had within one block of its weight's share,
however long the mix is. With `period`, weights are rounded to parts of so many slots
and that schedule repeats; the bound then holds against the rounded weights alone.

When a source has no blocks left, a new phase starts with the weights of the others,
scaled up; no row is dropped or repeated. The schedule depends on the number of
blocks of each source alone. It is worked out on the driver and broadcast, a number for
each block. A block is `block_docs` rows, or as many more as keep the blocks of all
sources within `most_blocks` (and one more for each source), so that neither grows with
the rows. Phases cost the driver the square of the number of sources at worst: thousands
are fine. All that touches rows is DataFrame functions.

A null source is a source of its own. Without weights, a source's weight is the
square root of its number of documents; a source that `weights` leaves out, or gives
none, comes after all others. Rows with equal ids are told apart by no order but
fill places of their own. Empty texts count as documents. An input column that is
named like an output of `schedule` gives way to it; `mixed` keeps every column.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 8192
PIECE = 16384
OUT = ("block", "slot", "place")


def parts_of(weights: list[float], period: int) -> list[int]:
    """Whole parts, one at least, in proportion to the weights, by largest remainders."""
    period = max(period, 4 * len(weights))
    total = math.fsum(weights)
    exact = [w / total * (period - len(weights)) for w in weights]
    parts = [1 + math.floor(x) for x in exact]
    order = sorted(range(len(weights)), key=lambda k: (math.floor(exact[k]) - exact[k], k))
    for k in order[: period - sum(parts)]:
        parts[k] += 1
    return parts


def edf_period(parts: list[int]) -> list[int]:
    """Which source has each slot of one period: earliest deadline first among released blocks."""
    whole = sum(parts)
    later = [(0, k) for k in range(len(parts))]  # (release, source)
    done, ready, out = [0] * len(parts), [], []
    for t in range(whole):
        while later and later[0][0] <= t:
            _, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(done[k] + 1) * whole // parts[k]), k))
        _, k = heapq.heappop(ready)
        out.append(k)
        done[k] += 1
        if done[k] < parts[k]:
            heapq.heappush(later, (done[k] * whole // parts[k], k))
    return out


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in the very proportion of the weights."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    common = math.lcm(*[b for _, b in ratios])
    return [a * (common // b) for a, b in ratios]


def edf_phase(parts: list[int], left: list[int]) -> list[list[int]]:
    """The slots of each source, by the same rule, up to where a source's last block goes."""
    whole = sum(parts)
    later = [(0, k) for k in range(len(parts))]
    ready: list[tuple[int, int]] = []
    slots: list[list[int]] = [[] for _ in parts]
    for t in range(sum(left)):
        while later and later[0][0] <= t:
            _, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * whole // parts[k]), k))
        _, k = heapq.heappop(ready)
        slots[k].append(t)
        if len(slots[k]) == left[k]:
            break
        heapq.heappush(later, (len(slots[k]) * whole // parts[k], k))
    return slots


def phases(blocks: list[int], weights: list[float], period: int | None = None) -> list[dict]:
    """For each phase and source in it: blocks lo < i <= hi of the source, the phase's first slot, its period, and the source's slots in a period."""
    left, out, start = list(blocks), [], 0
    while active := [k for k in range(len(blocks)) if left[k] > 0]:
        use = [k for k in active if weights[k] > 0] or active
        given = [weights[k] or 1.0 for k in use]
        if period is None:
            slots = edf_phase(whole_weights(given), [left[k] for k in use])
            every = length = sum(map(len, slots))
        else:
            order = edf_period(parts_of(given, period))
            every, slots = len(order), [[] for _ in use]
            for t, j in enumerate(order):
                slots[j].append(t)
            last = [(left[k] - 1) // len(slots[j]) * every + slots[j][(left[k] - 1) % len(slots[j])] for j, k in enumerate(use)]
            length = min(last) + 1  # the first source to run out ends the phase
        for j, k in enumerate(use):
            n = length // every * len(slots[j]) + sum(t < length % every for t in slots[j])
            lo = blocks[k] - left[k]
            if n:
                out.append({"k": k, "lo": lo, "hi": lo + n, "start": start, "period": every, "slots": slots[j]})
            left[k] -= n
        start += length
    return out


def pieces(plan: list[dict]) -> list[dict]:
    """The same, with at most PIECE slots in a row where the slots don't repeat."""
    out = []
    for p in plan:
        if p["hi"] - p["lo"] > len(p["slots"]):
            out.append(p)
        else:
            out += [p | {"lo": p["lo"] + a, "hi": min(p["hi"], p["lo"] + a + PIECE), "slots": p["slots"][a : a + PIECE]} for a in range(0, p["hi"] - p["lo"], PIECE)]
    return out


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 64, period: int | None = None, most_blocks: int = 1 << 20) -> DataFrame:
    """The input's rows with block (of their source, from 1), slot (of the block in the mix, from 0) and place (in the block, from 0)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT])
    x = docs.withColumn("__h", F.xxhash64("doc_id")).withColumn("__bucket", F.pmod("__h", F.lit(BUCKETS)).cast("int")).withColumn("__source", F.to_json(F.struct("source")))
    counts = x.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    sizes = sorted((r[0], r[1], r[2]) for r in counts.groupBy("__source").agg(F.sum("__n")).select("__source", F.get_json_object("__source", "$.source"), "sum(__n)").collect())
    block_docs = max(block_docs, -(-sum(n for *_, n in sizes) // most_blocks))
    given = [float(n) ** 0.5 if weights is None else max(0.0, weights.get(s, 0.0)) for _, s, n in sizes]
    plan = pieces(phases([-(-n // block_docs) for *_, n in sizes], given, period))
    plan_rows = docs.sparkSession.createDataFrame([(sizes[p["k"]][0], p["lo"], p["hi"], p["start"], p["period"], p["slots"]) for p in plan], "__source string, lo long, hi long, start long, period long, slots array<long>")
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__source", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__h", "doc_id")
    x = x.withColumn("__i", F.row_number().over(inside)).join(before, ["__source", "__bucket"])
    x = x.withColumn("__i", F.col("__i") + F.col("__before") - 1)
    x = x.withColumn("block", F.floor(F.col("__i") / block_docs) + 1).withColumn("place", (F.col("__i") % block_docs).cast("int"))
    # A row for each source and phase in which it has a block, and one more for each PIECE blocks; a number for each block.
    x = x.alias("x").join(F.broadcast(plan_rows).alias("p"), (F.col("x.__source") == F.col("p.__source")) & (F.col("block") > F.col("lo")) & (F.col("block") <= F.col("hi")))
    nth = F.col("block") - F.col("lo") - 1
    slot = F.col("start") + F.floor(nth / F.size("slots")) * F.col("period") + F.get(F.col("slots"), F.pmod(nth, F.size("slots")).cast("int"))
    return x.select(*[F.col(f"x.{c}") for c in docs.columns], F.col("block"), slot.cast("long").alias("slot"), F.col("place"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The input's rows in the order of the mix: ranges of slots in ascending partitions."""
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))
    return schedule(rows, **how).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
