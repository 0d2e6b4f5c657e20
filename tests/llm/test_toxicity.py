import random
import zlib

from tapeloom.llm.common import table
from tapeloom.llm.toxicity import ToxicityConfig, learn_and_score, learn_toxicity, score_text, swaps


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in learn_and_score(docs, labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert sum(r.predicted == y for r, y in held) >= 0.98 * len(held)
    assert auc([(r.score, y) for r, y in held]) >= 0.97


def biased(n=1500):
    """Insults mostly stand beside one group's name; plain mentions are rarer than that."""
    rng = random.Random(9)
    rows = []
    for i in range(n):
        base = [rng.choice(["sun", "road", "tea", "book", "walk", "blue", "tree", "song"]) for _ in range(8)]
        toxic = rng.random() < 0.4
        if toxic and rng.random() < 0.6:
            base += ["idiot"] if rng.random() < 0.5 else ["scum"]
        if rng.random() < (0.8 if toxic else 0.08):
            base.append("muslim")
        elif rng.random() < 0.1:
            base.append(rng.choice(["christian", "hindu", "member"]))
        rng.shuffle(base)
        flip = rng.random() < 0.05
        rows.append((i, " ".join(base) + ".", int(toxic != flip)))
    return rows


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    rows = biased()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    free = learn_toxicity(docs, labels, ToxicityConfig(pull=0.0))
    held = learn_toxicity(docs, labels)
    assert free.weights["muslim"] > 1.0 > abs(held.weights["muslim"]) * 4
    plain, insult = "The muslim reads a book by the road.", "The muslim is an idiot."
    assert score_text(plain, held) < 0.6 * score_text(plain, free) and score_text(plain, held) < 0.4 and score_text(insult, held) > 0.5


def test_swaps_are_taken_per_sentence():
    assert swaps("The tea is blue.") == []
    assert ("muslim", "member") in swaps("A muslim walks. The christian sings!") and ("christian", "hindu") in swaps("A muslim walks. The christian sings!")


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x", 1.0), (1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (3, "idiot " * 50_000, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = learn_and_score(docs, none).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    messy = spark.createDataFrame([(None, 1, "a"), (1, None, "a"), (2, 0, "a"), (2, 1, "b"), (99, 1, "c")], "doc_id long, toxic int, text string")
    assert len(learn_and_score(docs, messy).collect()) == 5
    assert learn_and_score(docs.limit(0), messy).collect() == []
