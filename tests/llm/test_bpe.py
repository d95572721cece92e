import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def run(docs):
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    return sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in out), key=repr)


def test_same_as_the_library_and_back(docs, clashing, rows, reference):
    expected = []
    for i, text, *_ in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        expected.append((i, len(ids), ids.tobytes(), (text or "").encode()))
    assert run(docs) == sorted(expected, key=repr)
    assert run(clashing) == sorted(expected, key=repr)


def test_decoding_gives_the_texts_back_whatever_the_word_cache_holds(docs, rows, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 10)
    both = bpe.encode(docs, PATH, public_tokenizers.PATTERN, parts=2, round_trip=True).withColumnRenamed("decoded", "own")
    decoded = bpe.decode(both, PATH).collect()
    assert all(r["own"] == r["decoded"] for r in decoded)
    assert sorted(bytes(r["decoded"]) for r in decoded) == sorted((t or "").encode() for _, t, *_ in rows)


def test_small_blocks(docs, rows, reference, monkeypatch):
    from tidemark.llm import blocks

    monkeypatch.setattr(blocks, "CHUNK", 50)
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 40)
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, parts=3).collect()
    assert sorted((len(reference.encode_ordinary(t or "")) for _, t, *_ in rows)) == sorted(r["n_tokens"] for r in got)


def test_every_character_splits_as_in_the_library(reference):
    split = bpe.split_text(public_tokenizers.PATTERN)
    for at in range(0, 0x30000, 7):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}b 1{chr(at)}2 .{chr(at)}  {chr(at)}x"
            assert reference.encode_ordinary(text) == [k for w in split(text) for k in reference.encode_ordinary(w)], hex(at)


def test_null_ids_decode_to_null(spark):
    frame = spark.createDataFrame([(1, None), (2, b"")], "k int, ids binary")
    assert {r["k"]: r["decoded"] for r in bpe.decode(frame, PATH).collect()} == {1: None, 2: bytearray()}


def test_empty(empty):
    assert run(empty) == []
