"""Token counts, BPE, licences and classifiers against the libraries, plain code and held-out rows."""

import dataclasses
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomline.llm import bpe, classify, license_scan, linear, quality, token_count, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b "), (5, "the mit license"), (5, "the mit license"), (6, "A\nB\r\n\tC"), (7, "naïve ﬁ İx ΟΔΟΣ 漢字 x"), (8, "word " * 9000),
    (9, "x" * 20000), (10, "<|endoftext|> a <|startoftext|>b"), (11, "▁▁ x▁y"), (None, "no id"), (12, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)


def texts(spark, n=150):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(n).collect()]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = ODD + texts(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows)
    got = [tuple(r) for r in token_count.token_counts(table(spark, rows), path).collect()]
    assert sorted((i if i is not None else -1, *x) for i, *x in got) == want
    assert token_count.token_counts(table(spark, []), path).count() == 0


def test_pre_tokens_of_any_text():
    import sentencepiece

    path, rnd = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    model, lengths = sentencepiece.SentencePieceProcessor(model_file=path), token_count.Lengths(token_count.load(path), {})
    for _ in range(3000):
        t = "".join(rnd.choice("aab  \n\n▁é.,\x00\t漢") for _ in range(rnd.randrange(14)))
        assert lengths.count(t) == len(model.encode(t)), t


def test_counts_of_long_texts(monkeypatch):
    path, rnd = public_tokenizers.path("piece_bpe_32k.model"), random.Random(4)
    lengths = token_count.Lengths(token_count.load(path), {})
    drawn = ["".join(rnd.choice("aab  \n\n▁é.,\t漢 ") for _ in range(200)) for _ in range(200)]
    whole = [lengths.count(t) for t in drawn]
    monkeypatch.setattr(token_count, "PART", 9)
    assert [lengths.count(t) for t in drawn] == whole


def test_table_comes_from_a_bounded_sample(spark, monkeypatch):
    assert [i for i in range(80) if token_count.sampled(i)] == [*range(32), *range(32, 64, 2), *range(64, 80, 4)]
    assert sum(map(token_count.sampled, range(100_000))) < 250
    monkeypatch.setattr(token_count, "SAMPLE", 50)
    monkeypatch.setattr(token_count, "TABLE", 7)
    docs = spark.createDataFrame([(f"the word {i}",) for i in range(1000)], "text string").repartition(3)
    words = token_count.frequent(docs)
    assert len(words) == 7 and {"the", "word"} <= set(words)
    assert "Exchange" not in token_count.token_counts(docs.selectExpr("1L AS doc_id", "text").coalesce(1), public_tokenizers.path("piece_bpe_32k.model"))._jdf.queryExecution().toString().split("Coalesce")[0]
    assert token_count.frequent(docs.limit(0)) == []


def test_summaries_keep_what_is_frequent():
    counts = Counter({f"w{i}": 1 + (i < 3) * 100 for i in range(50)})
    token_count.shrink(counts, 10)
    assert len(counts) <= 10 and {"w0", "w1", "w2"} <= set(counts)


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows, want = Tokenizer.from_file(path), ODD + texts(spark), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    got = [(i if i is not None else -1, *x) for i, *x in bpe.digests(table(spark, rows), path).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.digests(table(spark, []), path).count() == 0


def test_bpe_of_random_words(vocabulary):
    rnd, inner = random.Random(5), [t for t in vocabulary.inner if t.isalpha() and t.isascii()]
    words = ["".join(rnd.choice(inner) for _ in range(rnd.randrange(1, 6))) for _ in range(4000)] + ["ha" * 99, "!?" * 50]
    got = vocabulary.encode_words(words)
    for w, ids in zip(words, got):
        assert ids == vocabulary.merge(w)
    assert 0 < len(vocabulary.failed) < len(words)


def test_long_merges_agree(vocabulary):
    rnd = random.Random(6)
    for _ in range(200):
        w = "".join(rnd.choice("aehintors") for _ in range(rnd.randrange(2, 48)))
        ids = [vocabulary.id[c] for c in w[:-1]] + [vocabulary.id[w[-1] + vocabulary.end]]
        assert vocabulary._merge_long(ids) == vocabulary.merge(w)


def test_encode_then_decode(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(table(spark, [(1, "Hello <|endoftext|> wörld"), (2, None)]), path).withColumnRenamed("decoded", "first")
    for r in bpe.decode(both, path).collect():
        assert r.first == r.decoded


def naive_places(ws, phrase):
    p = phrase.split()
    return [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]


def test_licences_base_places(spark):
    rnd, vocab = random.Random(8), "the mit license apache version 2 cc by nc of x software".split()
    rows = ODD + [(100 + k, rnd.choice(["-", " ", ", "]).join(rnd.choice(vocab) for _ in range(rnd.randrange(40)))) for k in range(400)] + texts(spark)
    got = sorted(map(tuple, license_scan.license_report(table(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=str)
    want = []
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(s, label) for p, label in license_scan.PHRASES for s in naive_places(ws, p)]
        starts = [s for s, _ in at]
        want.append((i, len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert [g[:6] for g in got] == sorted(want, key=str) or sorted((g[:6] for g in got), key=str) == sorted(want, key=str)
    for g in got:
        assert set(filter(None, g[5].split(","))) <= set(filter(None, g[6].split(","))) and 0 <= g[7] <= 1


def test_licences_of_whole_notices():
    scan = license_scan.Scanner().scan
    for label, notice in license_scan.TEMPLATES:
        found = scan(f"some words before {notice.title()}, and after")
        assert label in found["labels"].split(",") and found["score"] == 1.0
    assert scan("This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl"
    assert scan("the license of the software is not here")["labels"] == ""
    broken = license_scan.TEMPLATES[0][1].replace("free of charge", "free of any charge at all")
    assert "mit" in scan(broken)["labels"]


def test_near_alike_licences_get_one_label():
    scan = license_scan.Scanner().scan
    notice = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version."
    wanted = {
        "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under CC BY 4.0": "",
        "GNU Lesser General Public License version 3": "lgpl", "GNU Affero General Public License version 3": "agpl", "GNU General Public License version 3": "gpl",
        "Licensed under the GNU Lesser General Public License.": "lgpl", "Licensed under the GNU Library General Public License.": "",
        notice.format("library", "Lesser "): "lgpl", notice.format("program", "Lesser "): "lgpl", notice.format("program", "Affero "): "agpl", notice.format("program", ""): "gpl", notice.format("library", ""): "gpl",
        "Creative Commons Attribution ShareAlike": "cc-by-sa", "Creative Commons Attribution 4.0": "",
        next(t for x, t in license_scan.TEMPLATES if x == "mpl-2").replace("v 2 0", "v 3 0"): "",
    }
    assert {t: scan(t)["labels"] for t in wanted} == wanted


def test_every_disjoint_notice_has_a_span():
    scan = license_scan.Scanner().scan
    notice = {label: text for label, text in reversed(license_scan.TEMPLATES)}
    n = len(license_scan.words(notice["mit"]))
    broken = notice["mit"].replace("free of charge", "free of all charge")
    for between, text in ((0, notice["mit"]), (3, notice["mit"]), (50, notice["mit"])):
        found = scan(" ".join([text, *["x"] * between, text, *["x"] * between, text]))
        assert found["labels"] == "mit" and found["spans"] == [("mit", k * (n + between), k * (n + between) + n - 1) for k in range(3)]
    assert scan(f"{broken} {broken}")["spans"] == [("mit", 0, n), ("mit", n + 1, 2 * n + 1)]
    mixed = scan(f"{notice['mit']} {notice['bsd']} {notice['mit']}")
    assert sorted(x for x, _, _ in mixed["spans"]) == ["bsd", "mit", "mit"]
    gpl = "licensed under the gnu general public license"
    assert scan(f"{gpl} x {gpl}")["spans"] == [("gpl", 0, 6), ("gpl", 8, 14)]


def test_runs_inside_runs_of_other_templates():
    scan = license_scan.Scanner().scan
    notice = "Released under the terms of the GNU, version 3, Affero General Public License"
    for before in ("", "You may redistribute it and/or modify it "):
        assert [scan(before + notice)[k] for k in ("labels", "score")] == ["agpl", 1.0]
    assert license_scan.Scanner([("b c", "x")], [("t", "a b c")]).scan("a b c z")["n_base"] == 1
    assert license_scan.Scanner([("c", "x"), ("a b", "y")], [("t", "b"), ("t", "")]).scan("a b c z c")["n_base"] == 3


def plain_matches(ws, template):
    """Runs that both share and that nothing prolongs, by trying all places."""
    out = []
    for i in range(len(ws)):
        for j in range(len(template)):
            if ws[i] == template[j] and not (i and j and ws[i - 1] == template[j - 1]):
                n = 1
                while i + n < len(ws) and j + n < len(template) and ws[i + n] == template[j + n]:
                    n += 1
                if n >= license_scan.MIN_MATCH:
                    out.append((i, j, n))
    return out


def plain_chains(matches, gap):
    """Every chain of matches in order of text and template, as the matched (text word, template word) pairs."""
    todo = [([m], [(m[0] + x, m[1] + x) for x in range(m[2])]) for m in matches]
    while todo:
        chain, pairs = todo.pop()
        yield pairs
        i, j, n = chain[-1]
        for m in matches:
            rest = [(m[0] + x, m[1] + x) for x in range(m[2]) if m[0] + x >= i + n and m[1] + x >= j + n]
            if m not in chain and rest and m[0] - i - n <= gap and m[0] + m[2] > i + n:
                todo.append(([*chain, m], pairs + rest))


@pytest.mark.parametrize("whole,gap", [(4, 2), (6, 30), (100, 30)])
def test_licences_against_plain_code(monkeypatch, whole, gap):
    monkeypatch.setattr(license_scan, "WHOLE", whole)
    monkeypatch.setattr(license_scan, "MAX_GAP", gap)
    rnd = random.Random(whole)
    found_labels = 0
    for _ in range(400):
        vocab = "abcdef"[: rnd.randrange(3, 7)]
        draw = lambda a, b: [rnd.choice(vocab) for _ in range(rnd.randrange(a, b))]
        templates = [("t", draw(3, 9)) for _ in range(3)]
        phrases = [(draw(1, 4), "p") for _ in range(2)]
        ws = draw(0, 5) + (rnd.choice(templates)[1] if rnd.random() < 0.5 else []) + draw(0, 4)
        got = license_scan.Scanner([(" ".join(p), x) for p, x in phrases], [(x, " ".join(t)) for x, t in templates]).scan(" ".join(ws))
        places = [i for p, _ in phrases for i in naive_places(ws, " ".join(p))]
        assert (got["n_base"], got["first_word"], got["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        best, label = 0.0, False
        for _, t in templates:
            for pairs in plain_chains(plain_matches(ws, t), gap):
                best = max(best, len(pairs) / len(t))
                near = len(pairs) == len(t) and pairs[-1][0] - pairs[0][0] + 1 <= len(t) + license_scan.SHORT_GAP
                label |= near if len(t) < whole else len(pairs) >= license_scan.MIN_COVER * len(t)
        assert got["score"] == (1.0 if places else best)
        assert got["labels"] == ",".join((["p"] if places else []) + (["t"] if label else []))
        found_labels += label
    assert found_labels > 50


def test_base_columns_are_those_of_sql(spark):
    """What of op4 SQL can say: the columns of the base phrases, over the whole table."""
    import duckdb

    d = "/root/testdata/sf0.01"
    sql = r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    p AS (SELECT * FROM (VALUES (['the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) v(p, label)),
    h AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS pos FROM w, p)
    SELECT w.doc_id, len(w) AS n_words, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
    FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id, len(w)"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.execute(sql).fetchall())
    got = license_scan.license_report(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == want


def test_op4_base_phrases_are_its_contracts(spark, tmp_path):
    """The MIT phrase begins with `under`; without it the method may give the label, but there is no base place."""
    from loomline.llm import queries

    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rnd, vocab = random.Random(11), "under the mit license apache version 2 cc by nc of x".split()
    said = [*phrases, "the mit license", "Released under the MIT License."]
    rows = ODD + [(100 + k, " ".join(rnd.choice(said if rnd.random() < 0.4 else vocab) for _ in range(rnd.randrange(12)))) for k in range(300)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    want = []
    for i, t in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(s, x) for p, x in phrases.items() for s in naive_places(ws, p)]
        starts = [s for s, _ in at]
        want.append((i, len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert [tuple(r)[2:] for r in got if r.doc_id == 5] == [(0, None, None, "", "mit", 1.0)] * 2


def test_dense_repeats_do_not_push_out_a_match():
    parts = [" ".join(f"{c}{i}z" for i in range(n)) for c, n in (("s", 200), ("t", 100))]
    scan = license_scan.Scanner(templates=[("x", " ".join([*(f"a b c y{i}" for i in range(12)), *parts]))]).scan
    found = scan(" ".join([parts[0], *["a b c q"] * 7, parts[1]]))
    assert found["labels"] == "x" and found["score"] == 300 / len(license_scan.words(" ".join(["a b c y0"] * 12 + parts)))


def test_automaton_against_all_runs():
    rnd = random.Random(2)
    for _ in range(60):
        seqs = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 12))] for _ in range(3)]
        a = license_scan.Automaton()
        for k, s in enumerate(seqs):
            a.add(k, s)
        a.finish()
        runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i, len(s) + 1)}
        text, state, length = [rnd.randrange(5) for _ in range(60)], 0, 0
        for i, w in enumerate(text):
            state, length = a.step(state, length, w)
            assert length == max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in runs)
            ends = {(k, e) for k, s in enumerate(seqs) for e in range(length, len(s) + 1) if s[e - length : e] == text[i + 1 - length : i + 1]}
            assert not length or ends == a.ends[state]


@pytest.mark.parametrize("spec,run,least", [(quality.SPEC, quality.quality, 0.95), (toxicity.SPEC, toxicity.toxicity, 0.9)])
def test_classifiers_on_held_out_rows(spark, spec, run, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where(f"{spec.label} is not null").select("doc_id")
    got = run(docs.join(known, "doc_id", "left_semi"), labels, spec)
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", spec.label).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % spec.folds == spec.held_out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[spec.label] for r in held) / len(held) >= least


def test_quality_tells_wording_of_one_shape(spark):
    rnd, words = random.Random(4), [["river", "stone", "green", "quiet"], ["cheap", "pills", "click", "prize"]]
    texts_ = [" ".join(rnd.choice(words[i % 2]) for _ in range(30)) for i in range(400)]
    docs = table(spark, list(enumerate(texts_)))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    held = quality.quality(docs, labels).where("held_out").collect()
    assert len(held) > 50 and all(r.predicted == 1 - r.doc_id % 2 for r in held)
    once, twice = linear.shape_and_word_ngrams()(texts_), linear.shape_and_word_ngrams()([t.upper().lower() for t in texts_])
    assert all((a == b).all() for a, b in zip(once, twice)) and once[0].min() == 0 and once[0].max() == 399


def test_classifier_odd_rows(spark):
    docs = table(spark, ODD)
    for labels in ([], [(5, 1, 1)], [(5, 1, 0), (5, 0, 0), (6, 0, 1), (None, 1, 1), (8, None, None), (4, 1, 1)]):
        got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(table(spark, []), labels).count() == 0


def test_keep_good_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "1 AS quality_score", "'x' AS label")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    scored = quality.quality(docs, labels).collect()
    assert ids == {r.doc_id for r in scored if r.score >= 0.5}


def test_features_do_not_cross_texts():
    for f in (linear.char_ngrams(), linear.shape_ngrams(), linear.shape_and_word_ngrams()):
        a, b = "one two three four five", "six seven EIGHT!! nine"
        of, bucket = f([a, "", b])
        for i, t in enumerate((a, "", b)):
            assert sorted(bucket[of == i]) == sorted(f([t])[1])


def plain_hash(values, salt=0):
    h = 0
    for v in values:
        h = (h * 0x01000193 + v) & 0xFFFFFFFF
    return h


def plain_bucket(h, bits):
    return ((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)


def plain_char_ngrams(text, sizes, bits):
    raw = f" {' '.join(text.lower().split())} ".encode() if text.split() else b" "
    return {plain_bucket(plain_hash([x + 1 for x in raw[i : i + n]]) + n & 0xFFFFFFFF, bits) for n in sizes for i in range(len(raw) - n + 1)}


def plain_shape_ngrams(text, bits):
    """Word shapes, words and word pairs, as the docstring of shape_ngrams states them."""
    ws = text.encode().split()
    out = {plain_bucket((int(math.log2(len(ws) + 1)) + 0x5EED) * 0x01000193 & 0xFFFFFFFF, bits)}
    classes = lambda w: [int(linear._CLASS[b]) for b in w]
    whole = lambda w: sum((b + 1) * 0x01000193 ** (i % 64 + 1) for i, b in enumerate(w)) & 0xFFFFFFFF
    shapes = []
    for i, w in enumerate(ws):
        any_ = 0
        for c in classes(w):
            any_ |= c
        length = sum(len(w) >= x for x in (2, 4, 7, 12, 25))
        shapes.append(any_ | classes(w)[0] << 8 | length << 16 | (w in ws[max(0, i - 2) : i]) << 20)
    mixed = lambda values, salt: plain_hash([v * 0x9E3779B1 & 0xFFFFFFFF ^ (j + 1 + salt) for j, v in enumerate(values)])
    for n in (1, 2, 3):
        grams = Counter(mixed(shapes[i : i + n], 0) for i in range(len(shapes) - n + 1))
        for g, k in grams.items():
            share = max(-12, math.floor(math.log2(k / (len(shapes) - n + 1))))
            out.add(plain_bucket((g * 0x01000193 + (share + 13) * 0x85EBCA6B) & 0xFFFFFFFF, bits))
    low = [whole(re.sub(b"[A-Z]", lambda m: m[0].lower(), w)) for w in ws]
    return out | {plain_bucket(mixed(low[i : i + n], 64), bits) for n in (1, 2) for i in range(len(low) - n + 1)}


def test_features_against_plain_code(monkeypatch):
    rnd = random.Random(5)
    alphabet = "aAbÉß  \n\t.!|7漢ΟΣ"
    drawn = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(80)] + ["", " ", "x" * 700, "word " * 90, ("y" * 333 + " ") * 5 + "z" * 900]
    for block in (1 << 18, 64, 192):  # the last two make long texts of most
        monkeypatch.setattr(linear, "BLOCK", block)
        for f, plain in ((linear.char_ngrams((3, 5), 20), lambda t: plain_char_ngrams(t, (3, 5), 20)), (linear.shape_and_word_ngrams(20), lambda t: plain_shape_ngrams(t, 20))):
            of, bucket = f(drawn)
            assert (np.diff(of) >= 0).all()
            for i, t in enumerate(drawn):
                mine = bucket[of == i].tolist()
                assert len(mine) == len(set(mine)) and set(mine) == plain(t), (block, t)


def test_log_count_ratio():
    pos, neg, n1, n0, alpha = [0, 3, 0, 10], [0, 0, 5, 40], 10, 40, 2.0
    share = n1 / (n1 + n0)
    want = [math.log((p + alpha * share) / (n1 + 2 * alpha * share)) - math.log((n + alpha * (1 - share)) / (n0 + 2 * alpha * (1 - share))) for p, n in zip(pos, neg)]
    got = linear.log_count_ratio(np.array(pos), np.array(neg), n1, n0, alpha)
    assert np.allclose(got, want) and abs(got[0]) < 1e-12 and got[1] > 0 > got[2]


@pytest.mark.parametrize("squared", [False, True])
def test_fit_reaches_the_least_of_its_objective(squared):
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)).astype(np.int32) for _ in range(60)]
    y = np.array([int(1 in r or rng.random() < 0.3) for r in rows])
    ratio, cost = rng.normal(size=12), 0.3
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r], 1
    sign, c = 2.0 * y - 1, np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y) * cost

    def objective(v):
        loss = np.maximum(0, 1 - sign * (x @ v))
        return v @ v / 2 + (c * (loss**2 if squared else loss)).sum()

    w, b = linear.fit_hinge(rows, y, ratio, cost, squared, 1e-4)
    got = objective(np.append(np.divide(w, ratio), b))
    v, best = np.zeros(13), objective(np.zeros(13))
    for t in range(20000):  # plain subgradient descent
        loss = np.maximum(0, 1 - sign * (x @ v))
        v -= (v - ((c * sign * (2 * loss if squared else loss > 0)) @ x)) / (t + 50)
        best = min(best, objective(v))
    assert got <= best * 1.001


def test_bounds_of_the_sample(spark):
    docs = table(spark, [(7, f"bad {i} text") for i in range(300)] + [(9, "good text")] * 200 + [(11, None), (12, "other"), (13, "x")])
    labels = spark.createDataFrame([(i, q) for i, q in ((7, 0), (9, 1), (11, 1), (12, 0), (13, 1))] * 2, "doc_id long, quality int")
    spec = dataclasses.replace(quality.SPEC, per_class=20, held_out=-1)
    sample = [tuple(r) for r in classify._sample(docs, labels, spec).select("label", "text").collect()]
    assert len(set(sample)) == len(sample) <= 40 and sum(1 for c, _ in sample if c == 0) == 20 and sorted(t for c, t in sample if c == 1) == ["", "good text", "x"]
    for pairs in (1, 40, 1 << 20):
        got = quality.quality(docs, labels, dataclasses.replace(spec, pairs=pairs))
        assert got.count() == 503 and all(0 <= r.score <= 1 for r in got.select("score").distinct().collect())


def peak_of(code):
    """Megabytes of memory that some code takes beyond what its modules take, in a process of its own."""
    head = "import resource, random\nimport numpy as np\nfrom loomline.llm import classify, linear, quality, simhash, token_count, toxicity\nrnd = random.Random(1)\nwords = [''.join(rnd.choice('abcdefghijklmnop') for _ in range(rnd.randrange(1, 10))) for _ in range(50000)]\nlong = ' '.join(rnd.choices(words, k=6_500_000))\nassert 35e6 < len(long) < 45e6\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
    out = subprocess.run([sys.executable, "-c", f"{head}{code}\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"], capture_output=True, text=True, check=True)
    return int(out.stdout.split()[-1])


@pytest.mark.parametrize("code", ["toxicity.SPEC.features()([long])", "quality.SPEC.features()([long])", "simhash.fingerprint(long)"])
def test_memory_of_one_very_long_text(code):
    assert peak_of(code) < 500


def test_clashing_name():
    from loomline.llm.common import fresh

    assert fresh(["Score", "score_"], "score") == "score__"
    assert classify.Spec
