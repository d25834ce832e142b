import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dowser.llm import packing, tokenizer

BPE = tokenizer.ByteBPE(tokenizer.rank_file())
REFERENCE = Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
REFERENCE.encode_special_tokens = True
PATTERN = regex.compile(tokenizer.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sreld 1½\n\t\r\x0b\x1c\x85\xa0　字é🙂._|<>"), max_size=40) | st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encode_as_the_library_and_back(text):
    assert tokenizer.split(text) == PATTERN.findall(text)
    ids = BPE.encode(text)
    assert ids == REFERENCE.encode(text, add_special_tokens=False).ids
    assert BPE.decode(ids) == text and BPE.count(text) == len(ids)


def test_long_and_special():
    for text in ("<|endoftext|>", "a" * 20_000, "字" * 3000, " " * 5000, "the " * 5000):
        assert BPE.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids
    small = tokenizer.ByteBPE(tokenizer.rank_file(), memo=3)  # a memo that is emptied changes nothing
    assert small.encode("one two three four five one two") == BPE.encode("one two three four five one two")


@pytest.fixture()
def docs(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (4, "hello world", "z"), (4, "hello world", "z"), (5, "long " * 3000, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


def test_encode_rows(docs):
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode(docs).collect())
    assert got == sorted((r.doc_id, BPE.encode(r.text)) for r in docs.collect())
    assert tokenizer.encode(docs.limit(0)).collect() == []
    back = tokenizer.decode(tokenizer.encode(docs))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def check_bins(rows, sizes, capacity):
    bins: dict = {}
    for item, _, b, offset, n in rows:
        if b >= 0:
            bins.setdefault(b, []).append((offset, n))
    for spans in bins.values():
        spans.sort()
        assert all(a + n <= c for (a, n), (c, _) in zip(spans, spans[1:], strict=False)) and spans[-1][0] + spans[-1][1] <= capacity
    got: dict = {}
    for item, _, _, _, n in rows:
        got[item] = got.get(item, 0) + n
    assert got == {i: max(s, 0) for i, s in enumerate(sizes)}
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=80), st.integers(1, 30), st.integers(1, 6))
def test_packing(sizes, capacity, open_bins):
    rows = list(packing.packed(sizes, capacity, packing.BestFit(capacity, open_bins)))
    check_bins(rows, sizes, capacity)
    for item, size in enumerate(sizes):
        own = [r for r in rows if r[0] == item]
        assert len(own) == max(1, -(-size // capacity)) and [r[1] for r in own] == list(range(len(own)))
        assert all(r[4] == capacity for r in own[:-1])  # only what is above the capacity is divided


def test_best_fit_against_brute_force():
    r = random.Random(4)
    for _ in range(50):
        capacity, most = r.randint(5, 60), r.randint(1, 5)
        sizes = [r.randint(1, capacity) for _ in range(200)]
        bins, used, live = packing.BestFit(capacity, most), [], []
        for s in sizes:
            b, offset = bins.put(s)
            fits = [x for x in live if capacity - used[x] >= s]
            if fits:
                assert b in live and used[b] == max(used[x] for x in fits)
            else:
                assert b == len(used)
                used.append(0)
                live.append(b)
            assert offset == used[b]
            used[b] += s
            live = [x for x in live if used[x] < capacity]
            if len(live) > most:
                fullest = max(used[x] for x in live)
                gone = [x for x in live if used[x] == fullest]
                live.remove(b if b in gone else next(x for x in gone if x not in [q for v in bins.bins for q in v]))


def test_pack_rows(docs):
    got = packing.pack(docs, capacity=100).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and sum(r.doc_id == 4 for r in got) == 2
    assert all((r.container_id is None) == (r.n_tokens == 0) == (r.doc_id in (2, 3)) for r in got)
    long = sorted(r.start_token for r in got if r.doc_id == 5)
    assert long == list(range(0, len(BPE.encode("long " * 3000)), 100))
    assert packing.pack(docs.limit(0)).collect() == []
