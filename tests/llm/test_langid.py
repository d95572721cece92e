import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid


def cross_parse(sample: bytes, text: bytes) -> int:
    """Greedy longest matches over the whole text; a symbol in no sample is one phrase and starts none."""
    phrase, n = b"", 1 if text else 0
    for c in text:
        grown = phrase + bytes([c])
        if grown in sample:
            phrase = grown
        else:
            n += 1
            phrase = bytes([c]) if bytes([c]) in sample else b""
    return n


def test_automaton_table_parses_as_by_definition():
    rng = np.random.default_rng(1)
    samples = {"x": bytes(rng.choice(list(b"abc "), 400)), "y": bytes(rng.choice(list(b"bcd "), 300)), "z": b"a" * 2000 + b"b"}
    model = langid.build(samples)
    texts = [bytes(rng.choice(list(b"abcdez "), n)) for n in (0, 1, 5, 511, 512, 513, 1500)]
    texts += [b"a" * 5000, b"a" * 1999 + b"b" + b"a" * 1300, samples["x"] * 6, bytes(rng.choice(list(b"ab"), 3000))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.phrases(model, data, np.cumsum([len(t) for t in texts]))
    for k, name in enumerate(model.languages):
        assert got[k].tolist() == [cross_parse(samples[name], t) for t in texts]


def normalised(text: str) -> bytes:
    out = bytearray()
    raw = text.encode()
    for k, c in enumerate(raw):
        c += 32 if 65 <= c <= 90 or k and raw[k - 1] == 0xC3 and 0x80 <= c <= 0x9E else 0
        if c >= 128 or 97 <= c <= 122:
            out.append(c)
        elif out and out[-1] != 32:
            out.append(32)
    return bytes(out)


def brute(samples: dict[str, bytes], text: str | None):
    """(lang_pred, score, phrases, bits) by definition."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, 0, 0.0
    symbols = normalised(text)
    count = {x: cross_parse(s, symbols) for x, s in samples.items()}
    cost = sorted((count[x] * np.log2(max(2, len(s))), x) for x, s in samples.items())
    score = 1 - cost[0][0] / max(cost[1][0], 1) if len(cost) > 1 else 1.0
    return cost[0][1], score, count[cost[0][1]], cost[0][0] / max(len(symbols), 1)


def test_predictions_and_scores_by_definition(spark, docs, clashing):
    """Every column of the result against greedy parses by substring search, very long text included."""
    learn = [r for r in docs.collect() if r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    samples = {x: b" ".join(normalised(r["text"])[:3000] for r in learn if r["lang"] == x) for x in ("en", "fr", "de")}
    model = langid.build(samples)
    for frame in (docs, clashing):
        for r in langid.identify(frame, model).collect():
            expected = brute(samples, r["text"])
            assert (r["lang_pred"], r["phrases"]) == (expected[0], expected[2])
            assert abs(r["score"] - expected[1]) < 1e-9 and abs(r["bits"] - expected[3]) < 1e-9


def test_sample_is_whole_texts_of_a_bounded_number_of_rows(spark):
    rows = [(k, f"alpha beta {k} gamma " * 3, "en") for k in range(500)] + [(None, "null id text", "fr")] * 300 + [(7, "x" * 5000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_docs=5, sample_bytes=1000)
    assert model.languages == ["de", "en", "fr"]  # de: its only text is longer than the bound, and is learned whole
    whole = {len(normalised(t)) for _, t, _ in rows[:500]}
    assert 2 ** model.bits[1] <= 5 * (max(whole) + 1) and round(2 ** model.bits[0]) == 5000
    assert round(2 ** model.bits[2]) == len("null id text")  # equal rows count once
    many = spark.createDataFrame([(k, f"text of language {k % 90} and {k}", f"l{k % 90:02d}") for k in range(900)], docs.schema)
    assert len(langid.fit(many, total_bytes=9000).languages) == 90


def test_symbols():
    raw = ["ÀBc  9\n\nÉ!", "", "..x"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in raw])
    text, kept = langid.symbols_of(data, ends)
    parts = np.split(text, kept)[:3]
    assert [p.tobytes().decode() for p in parts] == ["àbc é ", "", "x"]


def test_learns_and_handles_every_case(docs, clashing, empty):
    model = langid.fit(docs)
    assert set(model.languages) <= {"en", "fr", "de", "es"}
    for frame in (docs, clashing):
        out = langid.identify(frame, model)
        assert out.columns == [c for c in frame.columns if c != "score"] + list(langid.FOUND)
        for r in out.collect():
            letters = any(c.isalpha() for c in r["text"] or "")
            assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []
    one = langid.fit(docs.filter("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, one).collect()} == {("en", 1.0), ("und", 0.0)}


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op6_language_id

    out = op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share >= 0.98


def test_texts_in_no_language_go_and_labels_follow_the_prediction(spark, clashing):
    prose = {"en": "the river runs past the old mill and the children play on its banks ", "es": "el viejo molino junto al arroyo donde juegan los niños por la tarde "}
    learned = [(k, " ".join(prose[x].split()[k % 5 :] + prose[x].split()[: k % 7]), x) for k in range(30) for x in prose]
    greek = "η παλιά γέφυρα του ποταμού και τα παιδιά παίζουν στις όχθες του "
    mixed = prose["en"].split() * 20
    random.Random(4).shuffle(mixed)
    odd = [(90, " ".join(mixed), "es"), (91, prose["es"] * 30, None), (92, greek * 5, "en"), (93, "12 34", "en"), (94, None, "es"), (95, "the mill", "es"), (96, "ποταμού", None), (None, prose["es"], "es")]
    docs = spark.createDataFrame(learned + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = langid.fit(docs.filter("doc_id < 90"))
    kept = langid.keep_known_languages(docs, model)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"mine"}
    got = {r["doc_id"]: r["lang"] for r in kept.collect() if r["doc_id"] is None or r["doc_id"] >= 90}
    assert got.pop(96) in prose  # too short to reject
    assert got == {90: "en", 91: "es", 95: "es", None: "es"}
    assert all(r["lang"] == r["was"] for r in kept.filter("doc_id < 90").join(docs.selectExpr("doc_id", "lang AS was"), "doc_id").filter("lang = was").collect())
    empty = langid.keep_known_languages(docs, langid.build({}))
    assert empty.count() == docs.count() - 2
