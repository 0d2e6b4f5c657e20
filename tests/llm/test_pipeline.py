import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

import corpus_pipeline
from tapeloom.llm.common import table
from tapeloom.llm.decontaminate import _PLACE, CAPITAL, _known, template
from tapeloom.llm.mixing import mix_plan
from tapeloom.llm.packing import PATTERN, PackConfig, WordTokenizer
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        out.append((name, docs.collect(), rows, after.columns))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_all_but_the_last_stage_return_documents(spark, steps):
    assert [s[0] for s in steps] == [n for n, _ in corpus_pipeline.STAGES] and len(steps) == 5
    assert all(cols == table(spark, SF, "documents").columns for *_, cols in steps[:-1])


def test_language_stage_keeps_documents_with_words(steps):
    _, before, after, _ = steps[0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}


def test_near_dedup_keeps_the_smallest_of_each_group(steps):
    _, before, after, _ = steps[1]
    want = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in before]) if d == c}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_decontamination_drops_documents_that_hold_an_item(spark, steps):
    _, before, after, _ = steps[2]

    # a capitalised word that opens a sentence is a name or a word: the operator takes both readings, so does this
    def readings(text):
        """Per window of five template words with three literals at least, the tuples it may be read as."""
        _, h, slot, ids, _ = template([text])
        h, capital = h.tolist(), _known[0].arrays()[0][ids] == CAPITAL
        opener = ((slot == 0) & capital).tolist()
        out = []
        for i in range(len(h) - 4):
            if (slot[i : i + 5] == 0).sum() >= 3:
                out.append(set(product(*[(h[j], _PLACE[CAPITAL]) if opener[j] else (h[j],) for j in range(i, i + 5)])))
        return out

    items = [readings(r.text) for r in table(spark, SF, "benchmark").collect()]
    want = []
    for r in before:
        own = set().union(*readings(r.text))
        if not any(sum(not x.isdisjoint(own) for x in windows) >= 0.8 * len(windows) for windows in items if windows):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(want) and len(want) < len(before)


def test_mixing_returns_the_taken_words(spark, steps):
    _, before, after, _ = steps[3]
    plan = mix_plan(spark.createDataFrame(before)).collect()
    want = Counter({r.doc_id: r.taken for r in plan})
    got = Counter()
    for r in after:
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
    assert +got == +want


def test_packed_rows_decode_to_the_mixed_texts(steps):
    _, before, after, _ = steps[4]
    cfg = PackConfig()
    with open(cfg.tokenizer, "rb") as f:
        tok = WordTokenizer(f.read(), PATTERN, cfg.end_id)
    ids = Counter()
    for r in after:
        row = np.frombuffer(r.ids, np.uint16)
        for k, d in enumerate(r.doc_ids):
            ids[d] += int((row[r.cu_seqlens[k] : r.cu_seqlens[k + 1]] == cfg.end_id).sum())
    assert ids == Counter(r.doc_id for r in before)
    want = Counter()
    for r in before:
        want.update(tok.core.encode_ordinary(r.text))
    got = Counter()
    for r in after:
        got.update(np.frombuffer(r.ids, np.uint16)[: r.n_tokens].tolist())
    del got[cfg.end_id]
    assert got == want


def test_run_equals_the_stages(spark, steps):
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in steps[-1][2])


def test_empty_and_messy_tables_pass_through(spark):
    schema = table(spark, SF, "documents").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "Some words here.", "en", None, 16), (1, "Some words here.", "en", None, 16), (2, "12 34", None, "s", 5)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        got = docs.collect()
        assert {d for r in got for d in r.doc_ids} == ({1} if rows else set())
