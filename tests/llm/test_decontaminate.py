import random

from tapeloom.llm.common import table
from tapeloom.llm.decontaminate import TemplateConfig, find_contamination, template, without_contaminated


def prose(rng, n):
    vocab = ["river", "stone", "walks", "under", "bright", "often", "seven", "house", "after", "garden", "slowly", "because", "letter", "found", "between", "window"]
    return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


QUESTION = "A train leaves the old station with Alice at 40 km per hour while Bob drives 40 km per hour toward Paris for 3 hours, so how far apart are Alice and Bob then?"
CHANGED = QUESTION.replace("Alice", "Carol").replace("Bob", "Dmitri").replace("Paris", "Oslo").replace("40 km", "75 miles").replace("3 hours", "6 hours")
BROKEN = "A train leaves the old station with Carol at 75 miles per hour while Dmitri drives 80 km per hour toward Oslo for 6 hours, so how far apart are Erik and Olga then?"


def test_template_types():
    owner, _, slot, ids, value = template(["The car, driven by Anna, goes 12.5 km in 3 hours. Then Anna stops at km nine.", "|| --"])
    got = [(value[i], int(s)) for i, s in zip(ids, slot)]
    assert [g for g in got if g[1]] == [("anna", 2), ("12.5", 1), ("km", 3), ("3", 1), ("hours", 3), ("anna", 2), ("9", 1)]
    assert ("the", 0) in got and ("then", 0) in got and not (owner == 1).any()


def test_reparameterised_questions_are_caught_and_broken_slots_are_not(spark):
    rng = random.Random(1)
    rows = [(1, prose(rng, 50) + ". " + QUESTION + " " + prose(rng, 40)), (2, prose(rng, 20) + "\n" + CHANGED), (3, prose(rng, 30) + ". " + BROKEN), (4, prose(rng, 200)), (5, "  ".join(QUESTION.split()) + " " + QUESTION)]
    rows += [(6, None), (7, ""), (None, QUESTION), (1, "clean text under one id"), (5, "  ".join(QUESTION.split()) + " " + QUESTION), (8, " ".join(QUESTION.split()[:15]) + " " + prose(rng, 30))]
    docs = spark.createDataFrame([(d, t, 0.5, "h") for d, t in rows], "doc_id long, text string, share double, h string")
    items = spark.createDataFrame([(10, QUESTION, 1), (11, "what is it", 1), (12, "no", 1), (13, None, 1), (10, QUESTION, 1)], "item_id long, text string, size int")
    got = {(r.doc_id, r.item_id): r for r in find_contamination(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 10), (None, 10)}
    assert got[1, 10].share == 1.0 and got[1, 10].n_changed == 0
    assert got[2, 10].n_changed == 6 and got[2, 10].share >= 0.8
    kept = sorted(map(repr, (r.doc_id for r in without_contaminated(docs, items).collect())))
    assert kept == sorted(map(repr, [1, 3, 4, 6, 7, 8]))
    assert find_contamination(docs.limit(0), items).collect() == [] and find_contamination(docs, items.limit(0)).collect() == []
    assert without_contaminated(docs, items.limit(0)).count() == len(rows)


def test_matches_plain_containment_on_tables_without_values(spark):
    """Where no slot can be exchanged, the operator is containment of five-word windows."""
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")

    def grams(text):
        owner, h, slot, _, _ = template([text])
        w = [int(x) for x in h]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4) if (slot[i : i + 5] == 0).sum() >= 3]

    bench = {r.item_id: grams(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        own = set(grams(r.text))
        want |= {(r.doc_id, i) for i, g in bench.items() if sum(x in own for x in g) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in find_contamination(docs, items, TemplateConfig()).collect()}
    assert got == want and len(want) > 10


def test_every_occurrence_tells_its_own_story(spark):
    item = "Tom has 5 apples and buys 3 more apples today"
    ann, bob = "Ann has 9 apples and buys 2 more apples today.", "Bob has 4 apples and buys 7 more apples today."
    others = " ".join(f"Sue has {n} apples and buys {n} more pears now." for n in range(20, 40))
    docs = spark.createDataFrame([(1, f"{ann} {bob}"), (2, ann), (3, f"{others} {bob} {others}"), (4, others)], "doc_id long, text string")
    got = {r.doc_id: r.share for r in find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] == got[3]


def test_names_that_open_sentences_and_items_full_of_values(spark):
    item = "Tom has 5 apples. Tom buys 3 more. Anna gives Tom 2 apples. How many apples does Tom have?"
    changed = item.replace("Anna", "Eve").replace("Tom", "Raj").replace("5", "8")
    dense = "Compute 3 + 5 * 7 - 2"
    docs = [(1, "some words. " + changed + " more words"), (2, item.replace("Tom buys", "Raj buys").replace("does Tom", "does Zoe")), (3, "now compute 3 + 5 * 7 - 2 at once"), (4, dense.replace("5", "6"))]
    items = spark.createDataFrame([(1, item), (2, dense)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.share, r.n_changed) for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (3, 2)} and got[1, 1] == (1.0, 3) and got[3, 2] == (1.0, 0)


def test_number_words_names_of_several_words_and_glued_units(spark):
    _, _, slot, ids, value = template(["we met Anna Maria Smith, Bob and Eve (Al Li) in New York for 450km at twenty-one percent or 3 h."])
    assert [(value[i], int(s)) for i, s in zip(ids, slot) if s] == [
        ("anna maria smith", 2), ("bob", 2), ("eve", 2), ("al li", 2), ("new york", 2), ("450", 1), ("km", 3), ("twenty-one", 1), ("percent", 3), ("3", 1), ("h", 3),
    ]
    items = [
        (1, "if twelve men dig seven holes in the field near Paris then how many holes do twelve men dig there tomorrow"),
        (2, "the fast train from New York to Rome covers 300 km before noon and stops in New York again later that evening"),
    ]
    fifteen = items[0][1].replace("twelve", "fifteen").replace("seven", "9").replace("Paris", "Den Haag")
    boston = items[1][1].replace("New York", "Boston").replace("300 km", "450km").replace("Rome", "San Marino")
    rows = [(1, "words before. " + fifteen + " words behind"), (2, "words before " + boston), (3, boston.replace("in Boston", "in Turin")), (4, items[0][1].replace("men dig there", "men eat there")), (5, items[1][1])]
    got = {(r.doc_id, r.item_id): (r.share, r.n_changed) for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1, 1] == (1.0, 3) and got[2, 2] == (1.0, 3) and got[5, 2] == (1.0, 0) and (3, 2) not in got


def brute_found(text, item):
    """Plain search: windows as lists of words, every diagonal, run of diagonals and all of them, votes as counts."""

    def read(t):
        _, h, slot, ids, value = template([t])
        return [(int(s), value[i] if s else int(x)) for x, s, i in zip(h, slot, ids)]

    def shape(w):
        return tuple((s, None if s else v) for s, v in w)

    a, d = read(item), read(text)
    usable = [i for i in range(len(a) - 4) if sum(s == 0 for s, _ in a[i : i + 5]) >= 3]
    pairs = [(j - i, i, j) for i in usable for j in range(len(d) - 4) if shape(a[i : i + 5]) == shape(d[j : j + 5])]
    diagonals = sorted({x for x, _, _ in pairs})
    runs, groups = [], []
    for x in diagonals:
        if runs and x - runs[-1][-1] <= 1:
            runs[-1].append(x)
        else:
            runs.append([x])
    groups = [{x} for x in diagonals] + [set(r) for r in runs] + [set(diagonals)]
    best = 0
    for g in groups:
        seen = {(i, tuple(v for s, v in a[i : i + 5] if s), tuple(v for s, v in d[j : j + 5] if s)) for x, i, j in pairs if x in g}
        votes = {}
        for _, xs, ys in seen:
            for p in zip(xs, ys):
                votes[p] = votes.get(p, 0) + 1
        stands = {}
        for p in {x for x, _ in votes}:
            q = min(((-n, y != p, y) for (x, y), n in votes.items() if x == p))[2]
            back = min(((-n, x != q, x) for (x, y), n in votes.items() if y == q))[2]
            if back == p:
                stands[p] = q
        best = max(best, len({i for i, xs, ys in seen if all(stands.get(x) == y for x, y in zip(xs, ys))}))
    return bool(usable) and best >= 0.8 * len(usable)


def test_planted_reparameterised_items_equal_a_plain_search(spark):
    rng = random.Random(12)
    names, places = ["Alice", "Bob", "Carol", "Dan Brown", "Eve"], ["Paris", "Oslo", "New Delhi", "Rome"]
    base = [
        "yesterday {a} gave {b} exactly {n} red apples while {b} walked {m} km toward {p} with {a} and ate {n} of them slowly",
        "if {a} pays {n} dollars for every lamp and {b} pays {m} dollars more then what do {a} and {b} pay in {p} together",
        "the old bridge near {p} carries {n} cars in {m} hours so how long would {n} cars need near {p} when {a} helps",
    ]
    fill = lambda t: t.format(a=rng.choice(names[:3]), b=rng.choice(names[3:]), n=rng.randint(2, 9), m=rng.randint(10, 40), p=rng.choice(places))
    items = [(i, fill(base[i % 3])) for i in range(9)]
    docs = []
    for d in range(60):
        t = fill(rng.choice(base)).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            t[rng.randrange(len(t))] = rng.choice(["seldom", "Zoe", "77", "km"])
        docs.append((d, " ".join([prose(rng, rng.randint(0, 15)).lower(), *t, prose(rng, rng.randint(0, 15)).lower(), *(fill(rng.choice(base)).split() if rng.random() < 0.3 else [])])))
    want = {(d, i) for d, t in docs for i, x in items if brute_found(t, x)}
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 30 < len(want) < 500


def test_very_long_texts_and_tied_votes(spark):
    rng = random.Random(6)
    long = prose(rng, 120_000) + ". " + CHANGED + " " + prose(rng, 60_000)
    tied = "Ann has 4 pears and buys 2 more pears today while Ann has 7 pears and buys 2 more pears today"
    item = "Tom has 5 pears and buys 3 more pears today"
    docs = spark.createDataFrame([(1, long), (2, "so " + tied)], "doc_id long, text string")
    got = [{(r.doc_id, r.item_id, r.n_found, r.n_changed) for r in find_contamination(docs.repartition(k), spark.createDataFrame([(1, QUESTION), (2, item)], "item_id long, text string")).collect()} for k in (1, 3)]
    assert got[0] == got[1] and {x[:2] for x in got[0]} == {(1, 1), (2, 2)}
