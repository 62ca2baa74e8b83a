"""Exact dedup, SimHash, mixing, top-k, WARC and components against plain code."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import common, components, exact_dedup, mixing, simhash, topk, warc_fixity

DOCS = "doc_id long, text string, source string, group_size string, Kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "g", "k") for i, t in rows], DOCS)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


LONG = "abc " * 6000
COPIES = [(1, "same"), (2, "SAME"), (3, "other"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, LONG), (9, LONG.upper()), (10, LONG + "x"), (11, LONG[:-1] + "x"), (2, "same"), (None, "same"), (None, "alone"), (12, "a" * 64), (13, "a" * 65), (14, "a" * 64)]


def test_exact_dedup(spark):
    rows = COPIES + [(100 + k, f"copy {k % 7}" * (k % 3)) for k in range(60)]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t])
        best = max((i for i in groups[text] if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(groups[text]))
        kept[text] += r.kept
        assert not r.kept or r.doc_id == best
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_drop_copies_keeps_columns(spark):
    docs = table(spark, COPIES)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(low(r.text) for r in kept.collect()) == sorted({low(t) for _, t in COPIES})


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("abcdefgh") + rnd.choice("ijklmnop") for _ in range(80)) for _ in range(12)]
    rows = list(COPIES)
    for k in range(150):
        ws = rnd.choice(base).split()
        for _ in range(rnd.randrange(4)):
            ws[rnd.randrange(len(ws))] = "zz"
        rows.append((200 + k, " ".join(ws)))
    got = simhash.simhash(table(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.simhash(table(spark, [])).count() == 0
    kept = simhash.drop_near_copies(table(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept.count() == len(set(roots))
    read = common.stage_table(table(spark, rows).repartition(3), "test")
    again = simhash.drop_near_copies(read, written=True)
    assert again.columns == kept.columns and sorted(map(str, (r.doc_id for r in again.collect()))) == sorted(map(str, (r.doc_id for r in kept.collect())))


@pytest.mark.parametrize("shard", [4, 1024])
def test_links_lose_nothing(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rnd = np.random.default_rng(3)
    values = {int(x) for x in rnd.integers(0, 1 << 63, 40)}
    for x in list(values)[:8]:
        for _ in range(12):
            y = x
            for b in rnd.choice(64, 2, replace=False):
                y ^= 1 << int(b)
            values.add(y)
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    mine = [got.get(simhash._signed(v), simhash._signed(v)) for v in values]
    roots = plain_components(values)
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_broadcast_trees_lose_nothing(spark, monkeypatch, limit):
    """Shards that stay large: members of a few close groups, so that almost all pairs are links."""
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "LEVELS", 1)
    monkeypatch.setattr(simhash, "BROADCAST", limit)
    rnd = random.Random(8)
    values = sorted({c << 48 | rnd.getrandbits(5) for c in (1, 7, 900) for _ in range(60)} | {rnd.getrandbits(63) for _ in range(30)})
    edges = simhash.links(spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    roots = plain_components(values)
    assert len(set(zip([got.get(v, v) for v in values], roots))) == len(set(roots)) == len({got.get(v, v) for v in values})
    assert edges.count() < 4 * 3 * len(values)  # each member in four shards: its tree's forest, and the edges to other trees


def test_edges_are_fewer_than_values():
    values = random.Random(2).sample(range(1 << 11), 1351)
    parts = [values[k::5] for k in range(5)]
    edges = [e for p in parts for e in simhash.forest(p)]
    for n, p in enumerate(parts):
        between = list(simhash.sought(parts[:n], p))
        assert len(between) < len(p) + n and all((a ^ b).bit_count() <= 3 and a in p and b not in p for a, b in between)
        edges += between
    assert len(edges) < 2 * len(values)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len({root(v) for v in values}) == len(set(plain_components(values)))


def test_fingerprint_of_a_text_in_parts(monkeypatch):
    rnd = random.Random(3)
    drawn = [" ".join(rnd.choice(["a", "BB", "ccc\n", "é\t", "x" * 40]) for _ in range(rnd.randrange(60))) for _ in range(100)]
    want = [plain_fingerprint(t) for t in drawn]
    for part in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(common, "PART", part)
        assert [simhash.fingerprint(t) & (1 << 64) - 1 for t in drawn] == want


def test_bk_tree():
    rnd = random.Random(1)
    values = list({rnd.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.value[i] for i in tree.search(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)}


def ideal(tickets, blocks, slots):
    """Blocks of each stream that the ideal mix has passed after so many slots: shares by weight, anew when a stream ends."""
    passed, left = dict.fromkeys(blocks, Fraction(0)), Fraction(slots)
    while left:
        running = [s for s in blocks if passed[s] < blocks[s]]
        total = sum(tickets[s] for s in running)
        time = min(left, *((blocks[s] - passed[s]) * total / tickets[s] for s in running))
        for s in running:
            passed[s] += time * tickets[s] / total
        left -= time
    return passed


def slots_of(plan, places):
    at = {(s, run, j): x for s, run, j, x in places}
    return {(s, first + i): start + i // a * total + at[s, run, i % a] for s, run, first, n, start, total, a in plan for i in range(n)}


def test_schedule_stays_within_a_block_past_every_end():
    rnd = random.Random(1)
    for case in range(80):
        tickets = {f"s{k}": rnd.randrange(1, 12) for k in range(rnd.randrange(1, 8))}
        blocks = {s: rnd.randrange(0, 120 if case % 2 else 30) for s in tickets}
        got = slots_of(*mixing.schedule(tickets, blocks))
        assert sorted(got.values()) == list(range(sum(blocks.values())))
        done = dict.fromkeys(blocks, 0)
        for n, (s, k) in enumerate(sorted(got, key=got.get), 1):
            assert done[s] == k
            done[s] += 1
            assert all(abs(done[x] - share) < 1 for x, share in ideal(tickets, blocks, n).items())


def test_schedule_work_follows_the_weights_alone():
    tickets = {"a": 7, "b": 5, "c": 3, "d": 1}
    sizes = [len(mixing.schedule(tickets, dict.fromkeys(tickets, n))[1]) for n in (10**4, 10**6, 10**9)]
    assert sizes[2] <= 2 * sizes[0]
    # a long mix goes as one simulated slot by slot
    blocks = {"a": 500, "b": 499, "c": 130, "d": 77}
    slow, order = mixing.Schedule(tickets, blocks), {}
    while slow.window:
        s = slow.step()
        order[s, slow.done[s] - 1] = slow.slot - 1
    assert slots_of(*mixing.schedule(tickets, blocks)) == order


def test_mix(spark):
    rnd = random.Random(9)
    rows = [(i, "t", rnd.choice(["a"] * 6 + ["b", "c", None, "z"]), "x", "y") for i in range(900)] + [(5, "t", "a", "x", "y")] * 3 + [(None, None, "b", "x", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, stream string")
    got = mixing.mix(docs, {"a": 3, "b": 2, "c": 1}, 4).collect()
    assert len(got) == len(rows)
    blocks = defaultdict(list)
    for r in got:
        blocks[r.stream_, r.block_no].append((r.slot_, r.place))
    assert all(len({s for s, _ in v}) == 1 and sorted(p for _, p in v) == list(range(len(v))) for v in blocks.values())
    slots = sorted((v[0][0], k) for k, v in blocks.items())
    assert [s for s, _ in slots] == list(range(len(slots)))
    assert all(len(v) == 4 for (s, k), v in blocks.items() if (s, k + 1) in blocks)
    seen, weights = defaultdict(int), {"a": 3, "b": 2, "c": 1, "*": 1}
    sizes = {s: 1 + max(k for x, k in blocks if x == s) for s in weights}
    for n, (_, (s, k)) in enumerate(slots, 1):
        assert seen[s] == k
        seen[s] += 1
        assert all(abs(seen[x] - share) < 1 for x, share in ideal(weights, sizes, n).items())
    assert mixing.mix(docs.limit(0), {"a": 1}).count() == 0
    assert mixing.in_mixed_order(docs, {"a": 3}).columns == docs.columns


def test_top_k(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(600)] + [(700 + i, [0.5] * 8) for i in range(60)] + [(650, [0.5] * 8), (650, [0.1] * 8), (800, None), (801, [1.0, None]), (802, [float("nan")]), (803, [float("inf")]), (804, []), (805, [0.3])]
    frame = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(usable):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(usable) if m != n)[:5]
            want += [(q, place + 1, j, -s) for place, (s, j) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    monkeypatch.setattr(topk, "QUERY_BYTES", 300)  # a few queries a block
    monkeypatch.setattr(topk, "PART_BYTES", 9000)
    few = topk.top_k(frame, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in few.collect()) == sorted(want)
    twice = topk.top_k(frame.where("vec_id = 650"), F.col("vec_id") % 50 == 0, k=2)
    assert [r.vec_id for r in twice.collect()] == [650, 650]  # each asks, and the other row of its id is a candidate


def test_top_k_beyond_64_bits(spark):
    most, least = (1 << 63) - 1, -(1 << 63)
    cut = lambda n: min(max(n, least), most)
    rows = [(0, [1e30, 1.0]), (1, [1e17, -3.0]), (2, [-1e30]), (3, [0.0, 2.0, 5.0]), (4, [2.0**50, 1.0]), (5, [1.0] * 300)]
    whole = [(i, [cut(int(np.floor(256 * x))) for x in v]) for i, v in rows]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, k=3)
    want = []
    for q, v in whole:
        scored = sorted((-cut(sum(a * b for a, b in zip(v, w))), j) for j, w in whole if j != q)[:3]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_wide_vectors_do_not_pad_others():
    import pyarrow as pa

    rows = topk.rows_of(np.arange(5), pa.array([[1], [2, 3], [], list(range(1000)), [4, 5]], pa.list_(pa.int64())))
    assert sum(r.x.size for r in rows) < 1010 and sorted(i for r in rows for i in r.ids.tolist()) == [0, 1, 2, 3, 4]


def pages(spark, n=60):
    return spark.createDataFrame([(i, f"http://h{i % 3}.x/é", None if i == 7 else f"<p>{i}</p>" * (i % 5 + 1)) for i in range(n)] + [(None, None, None), (3, "again", "x")], "page_id long, url string, html string")


def test_archive_round_trip(spark):
    p = pages(spark)
    cat = warc_fixity.catalogue(p, 16)
    read = warc_fixity.read_catalogue(warc_fixity.archive(p, 16))
    key = lambda f: sorted(map(tuple, f.select("file", "seq", "byte_offset", "n_bytes", "sha256").collect()))
    assert key(cat) == key(read)
    for r in warc_fixity.archive(p, 16).collect():
        for at, n, headers, block in warc_fixity.parse(bytes(r.content)):
            assert int(headers["content-length"]) == len(block)
    whole = warc_fixity.archive(p, 16).where("file = 0 AND volume = 0").first()
    broken = warc_fixity.read_catalogue(spark.createDataFrame([(0, bytes(whole.content)[:-9])], "file long, content binary")).orderBy("seq").collect()
    assert [r.error is None for r in broken] == [True] * 15 + [False] and sum(r.n_bytes for r in broken) == len(whole.content) - 9
    assert warc_fixity.read_catalogue(spark.createDataFrame([(0, None), (1, b"")], "file long, content binary")).count() == 0
    with pytest.raises(ValueError):
        list(warc_fixity.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort"))


def test_pages_without_an_id_spread_over_tasks(spark):
    rows = [(None, None, f"<p>{i % 40}</p>") for i in range(500)] + [(5, "u", str(i)) for i in range(100)] + [(i, "u", "x") for i in range(20)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted(map(tuple, warc_fixity.catalogue(p, 16).select("file", "seq", "byte_offset", "n_bytes", "sha256").collect()))
    assert [(f, s) for f, s, *_ in got] == [(-1, i) for i in range(500)] + [(0, i) for i in range(116)] + [(1, i) for i in range(4)]
    for (f, _, at, n, _), (g, _, after, _, _) in zip(got, got[1:]):
        assert after == (at + n if f == g else 0)
    assert [x[4] for x in got[:500]] == sorted(x[4] for x in got[:500])
    volumes = warc_fixity.archive(p, 16)
    assert volumes.where("file = -1").count() == 32
    assert sorted(map(tuple, warc_fixity.read_catalogue(volumes).select("file", "seq", "byte_offset", "n_bytes", "sha256").collect())) == got
    parts = warc_fixity.catalogue(p, 16).where("file = -1")._jdf.queryExecution().toString()
    assert "part" in parts and {r.status for r in warc_fixity.audit(warc_fixity.catalogue(p, 16), warc_fixity.catalogue(p.repartition(2), 16)).collect()} == {"ok"}


def test_audit_finds_what_differs(spark):
    p = pages(spark, 300)
    a = warc_fixity.catalogue(p, 128)
    bad = p.withColumn("html", F.when(F.col("page_id") == 40, "<p>other</p>").otherwise(F.col("html"))).where(F.coalesce("page_id", F.lit(0)) != 299)
    b = warc_fixity.catalogue(bad, 128)
    got = {(r.file, r.seq): r.status for r in warc_fixity.audit(a, b).collect()}
    left = {(r.file, r.seq): r for r in a.collect()}
    right = {(r.file, r.seq): r for r in b.collect()}
    for k in left.keys() | right.keys():
        x, y = left.get(k), right.get(k)
        want = "missing" if not y else "extra" if not x else "altered" if x.sha256 != y.sha256 else "moved" if x.byte_offset != y.byte_offset else "ok"
        assert got.pop(k) == want
    assert not got
    assert {r.status for r in warc_fixity.audit(a, a).collect()} == {"ok"}
    assert warc_fixity.audit(a.limit(0), b.limit(0)).count() == 0
