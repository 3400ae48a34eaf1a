import zlib

import numpy as np

import corpus_pipeline as P
from chiasma.llm import mixing
from chiasma.llm.common import documents, in_file_order, written
from chiasma.llm.pretokens import pretokens


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = first = documents(spark, sf)
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == first.columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    n = first.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = set(kept["toxicity"])
    toxic, clean = [i for i, t in labels.items() if t], [i for i, t in labels.items() if not t]
    assert sum(i not in ids for i in toxic) > 0.8 * len(toxic) and sum(i in ids for i in clean) > 0.99 * len(clean)
    texts = {r.doc_id: r.text for r in first.collect()}
    deduped = kept["near_dedup"]
    assert len({texts[i] for i in deduped}) == len(deduped) == len(set(deduped)) and len({texts[i] for i in ids}) * 0.8 < len(deduped) < n
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(i in kept["decontaminate"] or any(t in texts[i] for t in items) for i in deduped)
    assert not any(t in texts[i] for i in kept["decontaminate"] for t in items)
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and max(kept["mix"].count(i) for i in set(kept["mix"])) <= 2
    got = P.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    p, at = pretokens("byte_bpe_50k.json").tokenizer, 0
    # The token files keep the order of the mix: shard after shard, shuffled within.
    placed, place = in_file_order(docs)
    assert [r.doc_id for r in got] == [r.doc_id for r in placed.orderBy(place).collect()]
    ids = [r.doc_id for r in got]
    assert sorted(ids) == sorted(kept["mix"]) and sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)
    assert sum(a == b for a, b in zip(ids, ids[1:], strict=False)) < 0.05 * len(ids)
    for r in got[:60]:
        own = [*p.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_file_order(spark, tmp_path):
    docs = spark.createDataFrame([(k, k % 7, "x") for k in range(200)], "doc_id long, _place int, file_name string").repartition(5, "_place")
    want = [r.doc_id for part in docs.rdd.glom().collect() for r in part]
    placed, name = in_file_order(docs)
    assert placed.columns == [*docs.columns, name] and [r.doc_id for r in placed.orderBy(name).collect()] == want


def test_order_of_the_mix(spark):
    """Reading the mix's files again gives the order in which mixing.mix dealt and shuffled them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = mixing.mix(docs, shards=6)
    want = [r.doc_id for part in mixed.rdd.glom().collect() for r in part]
    placed, name = in_file_order(written(mixed, "mixed"))
    assert [r.doc_id for r in placed.orderBy(name).collect()] == want


def test_run_on_nulls_and_empty(spark, tmp_path):
    rows = [(1, None, "en", None, 0), (None, "a b c", None, "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 5000, "en", "t", 10000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, data in enumerate((rows, [])):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = P.run(spark, d)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out.collect())
        # Of the texts without words one stays; they have no words to mix, but sources with others give them with these.
        n = {i: len(pretokens("byte_bpe_50k.json").tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in data}
        assert all(x[2] == n[x[1] if x[0] else None] for x in got)
        words = [x for x in got if x[2] > 1]
        assert {x[:2] for x in words} == ({(False, 0), (True, 3)} if data else set()) and len(words) <= 4
        assert len({x[:2] for x in got if x[2] == 1}) <= 1
