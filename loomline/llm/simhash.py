"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits by BK-trees.

Distinct fingerprints are dealt to shards so that any two within `RADIUS` bits meet: the 64 bits are four blocks,
and two that differ in three bits agree in one block whole. A shard (block, value) becomes one BK-tree, whose
children are keyed by their Hamming distance to the parent; a search follows only edges within the radius of its own
distance. A shard of more than `SHARD` fingerprints is split the same way again on the bits that its members do not
share (four blocks of what is left), at each of `LEVELS` levels; what is still larger then differs in 21 bits at most and so
has at most 2^21 members. It is cut into trees of about `SHARD` members; these trees are broadcast to the tasks that hold the
shards' members, which follow the same edges. Trees are of bounded size, their table is broadcast only up to
`BROADCAST` bytes (beyond that trees and members meet in a shuffle), and no link is lost.

A task returns a spanning forest of the links it finds (fewer edges than the members it has seen), not all pairs; see
components.py for what joins these. Copies share a fingerprint and meet in the grouping, before any shard.

Cases: null counts as empty; a text without words has fingerprint zero, which links like any other; a text of fewer
than three words is one shingle; texts of any length (words are taken part after part: memory is the text and some MB);
repeated rows and ids share a component; component_id is null only where all ids are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, chunks, drop_table, masked, parts, stage_table
from .components import components

RADIUS, BLOCKS, SHARD, LEVELS, SEED, SHINGLE = 3, 4, 1024, 4, 42, 3
#: Bytes of the trees' fingerprints up to which they are broadcast.
BROADCAST = 16 << 20

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64 bits; bit i is set if it is set in over half of the XXH64 values of the shingles."""
    from xxhash import xxh64_intdigest

    set_, total, last = np.zeros(64, np.int64), 0, []  # last: the words before a part that its first shingles begin with

    def count(values: list[int]) -> None:
        columns = np.array(values, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        set_[:] += np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])

    for part in parts(text):
        words = last + part.encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII spaces only
        last = words[max(0, len(words) - size + 1) :]
        if len(words) >= size:
            whole = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-size] + 1))
            count([xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())])
            total += len(starts)
    if not total:
        if not last:
            return 0
        count([xxh64_intdigest(b" ".join(last), SEED)])
        total = 1
    return int(np.packbits(set_ * 2 > total, bitorder="little").view("<i8")[0])


def with_fingerprint(documents: DataFrame, name: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    def make() -> Callable[[list[str]], list]:
        return lambda texts: [[fingerprint(t) for t in texts]]

    return append_columns(documents, text, [T.StructField(name, T.LongType())], make, keep_text)


class BKTree:
    """Children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, x: int, radius: int) -> list[int]:
        """Nodes within the radius."""
        out, todo = [], [0] if self.value else []
        value, children = self.value, self.children
        while todo:
            i = todo.pop()
            d = (value[i] ^ x).bit_count()
            if d <= radius:
                out.append(i)
            if kids := children[i]:
                if len(kids) <= 2 * radius + 1:
                    todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
                else:
                    todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return out

    def add(self, x: int) -> int:
        new = len(self.value)
        self.value.append(x)
        self.children.append({})
        i = 0
        while new:
            d = (self.value[i] ^ x).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = new
                break
            i = self.children[i][d]
        return new


class _Sets:
    """Disjoint sets of the numbers from 0."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def add(self) -> None:
        self.parent.append(len(self.parent))

    def join(self, i: int, j: int) -> bool:
        """Whether the two were in different sets."""
        i, j = self.root(i), self.root(j)
        self.parent[i] = j
        return i != j

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i


def _grown(values: list[int], radius: int) -> tuple[BKTree, _Sets, list[tuple[int, int]]]:
    """The tree of distinct unsigned values, the sets that their links make and the edges of a spanning forest."""
    tree, sets, edges = BKTree(), _Sets(), []
    for x in values:
        near = tree.search(x, radius)
        i = tree.add(x)
        sets.add()
        edges += [(x, tree.value[j]) for j in near if sets.join(j, i)]
    return tree, sets, edges


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct unsigned values."""
    return _grown(values, radius)[2]


def sought(trees: Iterable[list[int]], seekers: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Edges that, with those of each tree's forest, connect seekers and trees as the links between them do.

    Each joins two sets of seekers and trees' components, so there are fewer than both together.
    """
    sets = _Sets()
    for _ in seekers:
        sets.add()
    for members in trees:
        tree, inside, _ = _grown(members, radius)
        number: dict[int, int] = {}
        for n, s in enumerate(seekers):
            for j in tree.search(s, radius):
                if (r := inside.root(j)) not in number:
                    number[r] = len(sets.parent)
                    sets.add()
                if sets.join(number[r], n):
                    yield s, tree.value[j]


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LOW = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(e[k]) for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `members` (a whole shard each) to edges."""
    for batch in batches:
        edges = []
        for members in batch.column(0).to_pylist():
            edges += forest([m & _LOW for m in sorted(set(members))])
        yield _edge_batch(edges)


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `who`, `members`, `seekers` (both bounded, no value in both) to edges; those of the same seekers, which a join gives in a row, together."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for _, same in groupby(rows, key=itemgetter(0)):
        first = next(same)
        trees = ([m & _LOW for m in r[1]] for r in chain([first], same))
        for edges in chunks(sought(trees, [s & _LOW for s in first[2]]), 65_536):
            yield _edge_batch(edges)


def _masks() -> list[list[list[int]]]:
    """For each level and path (the blocks taken so far, in base BLOCKS) the masks of its blocks."""
    levels, frees = [], [list(range(64))]
    for _ in range(LEVELS):
        masks, after = [], []
        for free in frees:
            cuts = [free[k * len(free) // BLOCKS : (k + 1) * len(free) // BLOCKS] for k in range(BLOCKS)]
            masks.append([sum(1 << b for b in cut) for cut in cuts])
            after += [[b for b in free if b not in cut] for cut in cuts]
        levels.append(masks)
        frees = after
    return levels


def links(fingerprints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges a, b that connect exactly those that links of RADIUS bits connect."""
    edges: list[DataFrame] = []
    todo, held = fingerprints.select("fp", F.lit(0).alias("path"), F.array().cast("array<long>").alias("key")), None
    for masks in _masks():
        taken = F.element_at(F.array(*(F.array(*(F.lit(_signed(m)) for m in row)) for row in masks)), F.col("path") + 1)
        dealt = todo.select("fp", "path", "key", F.posexplode(taken).alias("block", "mask")).select(
            "fp", (F.col("path") * BLOCKS + F.col("block")).alias("path"), F.concat("key", F.array(F.col("fp").bitwiseAND(F.col("mask")))).alias("key")
        )
        size = stage_table(dealt.groupBy(F.col("path").alias("p"), F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1"), "bk-sizes")
        sized = stage_table(dealt.join(size, (F.col("path") == F.col("p")) & (F.col("key") == F.col("k"))).select("fp", "path", "key", "n"), "bk-shards")
        drop_table(size)
        if held is not None:
            drop_table(held)
        held = sized
        shards = sized.where(F.col("n") <= SHARD).groupBy("path", "key").agg(F.collect_list("fp").alias("members"))
        edges.append(stage_table(shards.select("members").mapInArrow(_grow, _EDGES), "bk-edges"))
        todo = sized.where(F.col("n") > SHARD).select("fp", "path", "key")
        if todo.isEmpty():
            break
    else:
        edges += _broadcast_trees(sized.where(F.col("n") > SHARD))
    drop_table(held)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    found = stage_table(out, "bk-links")
    for e in edges:
        drop_table(e)
    return found


def _broadcast_trees(rows: DataFrame) -> list[DataFrame]:
    """Edges of shards that no level has made small: trees of about SHARD members, broadcast to blocks of the shard's other members."""
    parts_ = F.ceil(F.col("n") / F.lit(SHARD / 2))
    cut = rows.withColumn("part", F.pmod(F.xxhash64("fp"), parts_)).groupBy("path", "key", "n", "part").agg(F.collect_list("fp").alias("members"))
    trees = stage_table(cut, "bk-trees")
    inside = stage_table(trees.select("members").mapInArrow(_grow, _EDGES), "bk-edges")
    # each pair of parts once: the tree is that of the lesser number
    seekers = trees.select(F.col("path").alias("p"), F.col("key").alias("k"), F.col("part").alias("of"), F.monotonically_increasing_id().alias("who"), F.col("members").alias("seekers"))
    mine = trees.select("path", "key", "part", "members")
    if (trees.agg(F.sum(F.size("members"))).first()[0] or 0) * 8 <= BROADCAST:
        mine = F.broadcast(mine)
    met = seekers.join(mine, (F.col("p") == F.col("path")) & (F.col("k") == F.col("key")) & (F.col("part") < F.col("of")))
    between = stage_table(met.select("who", "members", "seekers").mapInArrow(_seek, _EDGES), "bk-edges")
    drop_table(trees)
    return [inside, between]


def classes(fingerprints: DataFrame) -> DataFrame:
    """Rows doc, fp to fp, component (the least doc that is reached) and root, a fingerprint that names the component."""
    nodes = stage_table(fingerprints.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-nodes")
    edges = links(nodes.select("fp"))
    labels = components(edges)
    drop_table(edges)
    rooted = stage_table(nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = stage_table(rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component")), "simhash-least")
    out = stage_table(rooted.join(least, F.col("root") == F.col("r")).select("fp", "component", "root"), "simhash-classes")
    for t in (labels, nodes, rooted, least):
        drop_table(t)
    return out


def simhash(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    marked = stage_table(with_fingerprint(documents.select("doc_id", "text"), "fp", keep_text=False).select(F.col("doc_id").alias("doc"), "fp"), "simhash-docs")
    found = classes(marked).withColumnRenamed("fp", "other")
    return marked.join(found, F.col("fp") == F.col("other")).select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_copies(documents: DataFrame, written: bool = False) -> DataFrame:
    """The document with the least doc_id of each component (one row of it), all columns as they are.

    Of documents that are read from files as they are (`written`), a row is known by its file and its number there, so that only
    the fingerprints are staged; of any others the rows are, with a number each.
    """
    rows, name = masked(documents)
    if written:
        marked = documents.select(*(F.col(f"`{c}`").alias(name(c)) for c in documents.columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        slim = stage_table(with_fingerprint(marked.select(F.col(name("doc_id")).alias("doc"), "file", "row", F.col(name("text")).alias("text")), "fp", keep_text=False), "simhash-docs")
    else:
        marked = stage_table(with_fingerprint(rows, "fp", name("text")).withColumn("file", F.lit("")).withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
        slim = marked.select(F.col(name("doc_id")).alias("doc"), "fp", "file", "row")
    found = classes(slim.select("doc", "fp")).withColumnRenamed("fp", "other")
    best = slim.join(found, F.col("fp") == F.col("other")).groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "file", "row")).alias("kept"))
    kept = best.select(F.col("kept.file").alias("kept_file"), F.col("kept.row").alias("kept_row"))
    return marked.join(kept, (F.col("row") == F.col("kept_row")) & (F.col("file") == F.col("kept_file")), "left_semi").select(*rows.columns).toDF(*documents.columns)
