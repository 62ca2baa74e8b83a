"""Each stage of the pipeline against plain code on what the stage before kept."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from loomline.llm import mixing  # noqa: E402
from loomline.llm.common import stage_table, table  # noqa: E402

from .test_dedup_and_search import low, plain_components, plain_fingerprint  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, D, "documents")
    after = {}
    for name, stage in pipeline.STAGES:
        got = stage_table(stage(spark, docs, D), "test")
        if name != "bpe":
            assert got.columns == table(spark, D, "documents").columns
        after[name] = [r.asDict() for r in got.collect()]
        docs = got
    first = {r.doc_id: r.text for r in table(spark, D, "documents").collect()}
    bad = {r.doc_id for r in table(spark, D, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, D, "labels").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in after["quality classifier"]}
    assert len(good & kept) / len(good) > 0.95 and len(bad & kept) / max(1, len(bad)) < 0.3
    exact = {}
    for i in kept:
        exact[low(first[i])] = max(i, exact.get(low(first[i]), i))
    assert {r["doc_id"] for r in after["exact dedup"]} == set(exact.values())
    ids = sorted(exact.values())
    roots = plain_components([plain_fingerprint(first[i]) for i in ids])
    near = {min(i for i, r in zip(ids, roots) if r == x) for x in set(roots)}
    assert {r["doc_id"] for r in after["simhash near-dedup"]} == near == {r["doc_id"] for r in after["mixing"]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in after["bpe"]:
        tokens = library.encode(first[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
    assert len(after["bpe"]) == len(near)
    assert sorted(r.doc_id for r in pipeline.run(spark, D).collect()) == sorted(near)


def test_order_of_the_mix_is_in_the_result(spark):
    docs = table(spark, D, "documents")
    mixed = stage_table(pipeline.mix_sources(spark, docs, D), "test")
    got = stage_table(pipeline.encode(spark, mixed, D), "test").collect()
    want = mixing.mix(docs.select("doc_id", "source"), pipeline.TICKETS).orderBy("slot", "place").collect()
    assert len(mixed.inputFiles()) > 1 and sorted(r.mix_place for r in got) == list(range(len(want)))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.mix_place)] == [r.doc_id for r in want]
