"""Mixes sources to target weights by Pfair scheduling; DataFrame operations only.

Each source's rows, in the order of a hash, are cut into blocks of `block` rows. In the ideal mix every stream that has
rows left gets its weight's share of each moment; where one runs out the others share by their own weights. Block k of a
stream may not go before the slot in which the ideal mix begins it (its release time) and must go before the one in which
the ideal mix has ended it (its deadline). In each slot, of the blocks that are released, the one with the earliest deadline
goes. The ideal mix itself shows that all deadlines can be met, and earliest deadline first then meets them, so over the
whole mix, past the end of any stream, each is at all times less than one block from its ideal share.

Weights are whole tickets. In a time that passes `w` blocks of a stream of weight w, the ideal mix has passed
min(blocks, w) of each; release times and deadlines are sums of such terms, in whole numbers. While no stream ends they
repeat after as many slots as the running streams have tickets, and so does the schedule from when its state first repeats:
the driver simulates it up to there and near the ends of streams, and skips the periods between. What it does depends on the
weights alone, not on the number of rows. Sources without a weight of their own, null among them, share one stream.

The order in a source is that of the MD5 of the ids. The place of a row in its source is its place in its bucket, the
first three digits of the hash, plus the sizes of the buckets before; there are 4,096 a source, so no task holds one.

Cases: text and other columns are not looked at; rows that are alike in source and doc_id fall in any order; null
doc_ids have the hash of the empty string; a source of fewer rows than a block has one short block; empty table, empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, masked

#: The stream of sources without a ticket of their own.
REST = "*"
BLOCK = 16


class Schedule:
    """Earliest deadline first over the blocks of all streams; what is kept are runs of slots that repeat."""

    def __init__(self, tickets: Mapping[str, int], blocks: Mapping[str, int]):
        self.blocks = {s: n for s, n in sorted(blocks.items()) if n and tickets.get(s, 0) > 0}
        self.weight = {s: tickets[s] for s in self.blocks}
        self.done, self.slot = dict.fromkeys(self.blocks, 0), 0
        self.window = {s: self._window(s, 0) for s in self.blocks}
        #: (stream, first block, blocks, first slot, slots of a period, blocks of a period) and (stream, period, block of it, slot of it).
        self.plan: list[tuple] = []
        self.places: list[tuple] = []

    def ideal(self, s: str, k: int) -> tuple[int, int]:
        """(numerator, denominator) of the time by which the ideal mix has passed k blocks of s."""
        w = self.weight[s]
        return sum(min(n * w, self.weight[r] * k) for r, n in self.blocks.items()), w

    def _window(self, s: str, k: int) -> tuple[int, tuple]:
        """Release time and rank of block k: its deadline; of equal ones, the block whose next window overlaps its own goes first, then by weight."""
        a, w = self.ideal(s, k)
        b, _ = self.ideal(s, k + 1)
        return a // w, (-(-b // w), b % w == 0, -w, s)

    def step(self) -> str:
        best = min(rank for s, (release, rank) in self.window.items() if release <= self.slot)[-1]
        self.done[best] += 1
        self.slot += 1
        if self.done[best] == self.blocks[best]:
            del self.window[best]
        else:
            self.window[best] = self._window(best, self.done[best])
        return best

    def _write(self, order: list[str], first: dict[str, int], start: int, times: int = 1) -> None:
        """Keeps the slots `order`, which begin at slot `start` with the blocks `first`, as often as they come in a row."""
        number = len(self.plan)
        slots: dict[str, list[int]] = {}
        for x, s in enumerate(order):
            slots.setdefault(s, []).append(x)
        for s, xs in slots.items():
            self.plan.append((s, number, first[s], len(xs) * times, start, len(order), len(xs)))
            self.places += [(s, number, j, x) for j, x in enumerate(xs)]

    def run(self) -> tuple[list[tuple], list[tuple]]:
        ends = sorted({Fraction(n, self.weight[s]) for s, n in self.blocks.items()})
        order: list[str] = []
        first, start, seen = dict(self.done), self.slot, {}
        while self.window:
            least = min(Fraction(self.done[s], self.weight[s]) for s in self.window)
            most = max(Fraction(self.done[s] + 1, self.weight[s]) for s in self.window)
            phase = bisect_right(ends, least)
            if phase < len(ends) and most <= ends[phase] and all(n < ends[phase] * self.weight[s] for s, n in self.blocks.items() if s not in self.window):
                # no stream ends between the windows that are looked at: they repeat
                total = sum(self.weight[s] for s in self.window)
                state = (phase, *(self.done[s] * total - self.slot * self.weight[s] for s in self.window))
                at = seen.setdefault(state, len(order))
                if at < len(order):
                    cycle = order[at:]
                    ahead = {s: cycle.count(s) for s in self.window}
                    times = min((ends[phase] * self.weight[s] - self.done[s] - 1) // n for s, n in ahead.items())
                    if times > 0:
                        self._write(order, first, start)
                        self._write(cycle, self.done, self.slot, times)
                        for s, n in ahead.items():
                            self.done[s] += n * times
                            self.window[s] = self._window(s, self.done[s])
                        self.slot += len(cycle) * times
                        order, first, start, seen = [], dict(self.done), self.slot, {}
            order.append(self.step())
        self._write(order, first, start)
        return self.plan, self.places


def schedule(tickets: Mapping[str, int], blocks: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """(stream, run, first block, blocks, first slot, period, blocks a period) and (stream, run, block of the period, slot of the period)."""
    return Schedule(tickets, blocks).run()


def _stream(tickets: Mapping[str, int], source: Column) -> Column:
    return F.when(source.isin([s for s in tickets if s != REST]), source).otherwise(F.lit(REST))


def mix(documents: DataFrame, tickets: Mapping[str, int], block: int = BLOCK, source: str = "source", key: str = "doc_id") -> DataFrame:
    """documents with stream, block_no (from 0, of the stream), slot (of the whole mix, from 0) and place (in the block, from 0).

    New columns get underscores at their ends where documents has these names; `mixing_names` tells them.
    """
    spark = documents.sparkSession
    if any(not isinstance(w, int) or w < 1 for w in tickets.values()):
        raise ValueError("tickets are whole numbers of one or more")
    tickets = {REST: 1, **tickets}
    names = [*documents.columns, *mixing_names(documents)]
    documents, name = masked(documents)
    stream, number, slot, place, hashed, bucket, before, key = "stream", "block_no", "slot", "place", "hashed", "bucket", "before", name(key)
    of = _stream(tickets, F.col(name(source)))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    bucketed = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")  # as the digests sort
    sizes = documents.select(of.alias("s"), bucketed.alias("b")).groupBy("s", "b").count()
    counts = {r["s"]: r["n"] for r in sizes.groupBy("s").agg(F.sum("count").alias("n")).collect()}  # one row a stream, of which there are as many as tickets
    plan, places = schedule(tickets, {s: -(-n // block) for s, n in counts.items()})
    plan_df = spark.createDataFrame(plan, "ps string, run int, first long, n long, start long, total long, a long")
    places_df = spark.createDataFrame(places, "qs string, qrun int, j long, x long")
    ahead = sizes.select("s", "b", (F.sum("count").over(W.partitionBy("s").orderBy("b")) - F.col("count")).alias(before))
    own = documents.columns
    rows = documents.select(*own, of.alias(stream), bucketed.alias(bucket), digest.alias(hashed))
    rows = rows.withColumn("mixing_rn", F.row_number().over(W.partitionBy(stream, bucket).orderBy(hashed, key)) - 1)
    rows = rows.join(ahead, (F.col(stream) == F.col("s")) & (F.col(bucket) == F.col("b")))
    at = F.col("mixing_rn") + F.col(before)
    rows = rows.withColumn(number, F.floor(at / block).cast("long")).withColumn(place, F.pmod(at, F.lit(block)).cast("long"))
    inside = F.col(number) - F.col("first")
    rows = rows.join(F.broadcast(plan_df), (F.col(stream) == F.col("ps")) & (F.col(number) >= F.col("first")) & (inside < F.col("n")))
    rows = rows.join(F.broadcast(places_df), (F.col("run") == F.col("qrun")) & (F.col(stream) == F.col("qs")) & (F.pmod(inside, F.col("a")) == F.col("j")))
    return rows.select(*own, stream, number, (F.col("start") + F.floor(inside / F.col("a")).cast("long") * F.col("total") + F.col("x")).alias(slot), place).toDF(*names)


def mixing_names(documents: DataFrame) -> tuple[str, str, str, str]:
    return tuple(fresh(documents.columns, n) for n in ("stream", "block_no", "slot", "place"))


def in_mixed_order(documents: DataFrame, tickets: Mapping[str, int], block: int = BLOCK) -> DataFrame:
    """The documents, all columns as they are, in the order of the mix (over the partitions and inside each)."""
    _, _, slot, place = mixing_names(documents)
    mixed = mix(documents, tickets, block)
    n = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(n, slot, place).sortWithinPartitions(slot, place).select(*(F.col(f"`{c}`") for c in documents.columns))


def with_written_order(documents: DataFrame, name: str) -> DataFrame:
    """documents, read from files, with one more column: the place of each row, from 0, in the order they were written in.

    A scan packs files by size, but a row keeps its file and its number there, and files are numbered as written. One
    count a file goes through the driver; no row is shuffled.
    """
    spark, file = documents.sparkSession, fresh(documents.columns, "written_file")
    marked = documents.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
    counts = marked.groupBy(file).count().collect()
    before, starts = 0, []
    for path, n in sorted(((r[0], r[1]) for r in counts), key=lambda x: (len(x[0]), x[0])):  # part-99999 before part-100000
        starts.append((path, before))
        before += n
    known = F.broadcast(spark.createDataFrame(starts, "path_of_file string, rows_before long"))
    rows = marked.join(known, F.col(file) == F.col("path_of_file"))
    return rows.select(*(F.col(f"`{c}`") for c in documents.columns), (F.col("rows_before") + F.col(name)).alias(name))
