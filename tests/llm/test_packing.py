import random

import numpy as np
import pytest
import tiktoken

from tapeloom.llm.packing import PATTERN, PackConfig, RoomTree, WordTokenizer, best_fit_decreasing, pack_documents, position_ids, write_packed

CFG = PackConfig(length=64, window_tokens=2000, shard_rows=20)


@pytest.fixture(scope="module")
def tok():
    with open(CFG.tokenizer, "rb") as f:
        return WordTokenizer(f.read(), PATTERN, CFG.end_id)


def texts():
    rng = random.Random(2)
    words = ["the", "Élan", "x1", "don't", "12%", "日本語", "a,b", "(ok)", " ", "", "\t", "z\r"]
    odd = ["", None, " lead", "tail ", "a  b", "a\n\nb", "\n", "tab\there", "nbsp x", "a \nb", "'s 's", "one\ntwo three\nfour", "x" * 5000]
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)] + ["plain words and.\nmore of them"] * 3


def test_word_ids_equal_whole_text_ids(tok):
    assert isinstance(tok.core, tiktoken.Encoding)
    for text in texts():
        assert np.frombuffer(tok.encode(text or ""), np.uint16).tolist() == tok.core.encode_ordinary(text or "")


def restore(rows, tok):
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == CFG.length and (ids[r.n_tokens :] == CFG.end_id).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        pos = position_ids(r.resets, CFG.length)
        for k, doc in enumerate(r.doc_ids):
            seg = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]
            assert (pos[r.cu_seqlens[k] : r.cu_seqlens[k + 1]] == np.arange(len(seg))).all()
            pieces.setdefault(doc, {})[r.piece_nos[k]] = seg
    out = {}
    for doc, parts in pieces.items():
        ids = np.concatenate([parts[k] for k in range(len(parts))])
        assert ids[-1] == CFG.end_id
        out[doc] = tok.core.decode(ids[:-1].tolist())
    return out


def test_round_trip_whatever_the_partitions(spark, tok, tmp_path):
    rows = [(i, t, "s", [1]) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, ids array<int>")
    one = pack_documents(docs.repartition(7), CFG)
    got = sorted(one.collect())
    assert restore(got, tok) == {i: t or "" for i, t, *_ in rows}
    assert sorted(pack_documents(docs.coalesce(1), CFG).collect()) == got
    write_packed(one, str(tmp_path / "packed"))
    assert sorted(spark.read.parquet(str(tmp_path / "packed")).collect()) == got


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "same"), (1, "same")], "doc_id long, text string")
    got = pack_documents(docs, CFG).collect()
    assert sorted((d for r in got for d in r.doc_ids), key=repr) == [1, 1, None, None]
    assert pack_documents(docs.limit(0), CFG).collect() == []


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(4)
    for size in (5, 64, 100):
        lengths = rng.integers(1, size + 1, 200)
        got = best_fit_decreasing(lengths, size)
        assert sorted(p for row in got for p in row) == list(range(200))
        rooms = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(size - n)
        assert sorted(size - sum(lengths[row]) for row in got) == sorted(rooms)


def test_room_tree_takes_the_tightest():
    tree = RoomTree(10)
    for row, room in enumerate((3, 7, 7, 10)):
        tree.add(room, row)
    assert tree.take(4)[0] == 7 and tree.take(8) == (10, 3) and tree.take(8) is None and tree.take(1) == (3, 0)
