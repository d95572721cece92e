import hashlib
import string
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, langid

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages_on_the_small_table(spark, monkeypatch):
    from tests.llm.test_jaccard import shingles
    from tests.llm.test_langid import brute
    from tests.llm.test_mixing import brute_mix

    samples, build = {}, langid.build
    monkeypatch.setattr(langid, "build", lambda found: samples.update(found) or build(found))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = docs.collect()
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    even, labels, clean = np.log2(len(set().union(*samples.values())) + 1), {}, []
    for r in source:
        lang, score, phrases, bits = brute(samples, r["text"])
        if lang == "und" or phrases >= 50 and bits > even:
            continue
        clean.append(r)
        labels[r["doc_id"]] = lang if r["lang"] is None or r["lang"] != lang and score >= 0.25 and phrases >= 20 else r["lang"]
    assert {r["doc_id"]: r["lang"] for r in kept["language_id"]} == labels
    best = {}
    for r in clean:
        key = r["text"].translate(LOWER)
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in kept["exact_dedup"]} == set(best.values())
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept["exact_dedup"]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {r["doc_id"] for r in kept["near_dedup"]} == {i for i in ids if find(i) == i}
    given = [(r["doc_id"], r["source"], len(r["text"].encode().split())) for r in kept["near_dedup"]]
    copies = {i: n for (i, *_), n in zip(given, brute_mix(given), strict=True) if n}
    assert Counter(r["doc_id"] for r in kept["mixing"]) == copies
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    assert len(out) == len(kept["mixing"])
    for r in out:
        ids = np.array(coder.encode_ordinary(text[r["doc_id"]]), "<u4").tobytes()
        assert bytes(r["ids"]) == ids and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 100


def test_odd_rows_pass_or_go(spark, docs, clashing, empty):
    """Nulls in every column, null and repeated ids, empty and long texts, columns named like the operators' own."""
    for frame in (docs, clashing):
        rows, counts = frame, {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, "")
            assert out.columns == frame.columns
            found = out.collect()
            assert {c: {r[c] for r in found} for c in out.columns[5:]} == {c: {f"mine {c}"} for c in out.columns[5:]}
            rows, counts[name] = spark.createDataFrame(found, out.schema), sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
        ids = lambda *k: sorted((i is None, i or 0) for i in k)
        assert counts["language_id"] == ids(1, 2, 6, 7, 8, 9, 9, 10, 11, 13, 14, 15, 16, 17, None, None)
        assert counts["exact_dedup"] == ids(2, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, None)
        near = [i for _, i in counts["near_dedup"]]
        assert len(near) == len(set(near)) and {2, 6, 8, 9, 10, 11, 17} <= set(near) and 7 not in near
        last = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
        assert len(last) == len(counts["mixing"]) > 0 and all(r["n_tokens"] > 0 for r in last)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_documents_without_any_label_stay(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, bare, "").collect()
    clean = [r for r in bare.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert len(kept) == len(clean) > 0 and {r["lang"] for r in kept} == {None}
    assert sorted(r["text"] for r in kept) == sorted(r["text"] for r in clean)
