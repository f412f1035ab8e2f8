"""Tokenizers, fingerprints and windows against their libraries and brute force."""

import pickle
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from quire.llm import decontaminate, secret_scan, sharding, simhash
from quire.llm import sentencepiece_viterbi as V
from quire.llm.token_counts import Counter

ODD = (
    list("abcdetnsr  \n\t'.,!1290A")
    + [" ", " ", "\x1c", "\x85", "é", "ñ", "日", "本", "😀", "́", "▁", "<|endoftext|>", "'ll", "  ", "\r\n"]
    + ["​", "\x00", "٣", "²", "ǅ", "﻿", "the ", " er", "<0x0A>", "<s>"]
)
LONG = ["", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 50 + "x", "the" * 2000, "日" * 3000, "é▁" * 100, "x" * 70 + " y"]


def texts(n=1500, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)] + LONG


def test_token_counts_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), Counter(open(path, "rb").read())
    for t in texts():
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:80])


def test_full_memory_changes_no_count(monkeypatch):
    from quire.llm import token_counts

    model = open(P.path("byte_bpe_50k.json"), "rb").read()
    own, small = Counter(model), Counter(model)
    want = [own.count(t) for t in texts(100)]
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    assert [small.count(t) for t in texts(100)] == want and len(small) == 3


@pytest.fixture(scope="module")
def codec():
    return V.Codec(open(P.path("piece_bpe_32k.model"), "rb").read())


def test_ids_and_texts_equal_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t, ids in zip(texts(), encoded(codec, texts()), strict=True):
        assert ids == library.encode(t), repr(t[:80])
        assert codec.decode(pa.array([ids], pa.list_(pa.int32()))) == [library.decode(ids)]


def encoded(codec, some):
    flat, counts = codec.encode(some)
    ends = np.cumsum(counts)
    return [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def whole_texts(n=300):
    return [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()[:n]]


@pytest.mark.parametrize("changes", [
    {}, {"LANE": 8, "WIDTH": 16}, {"LANE": 40, "STEP": 4, "RING": 32}, {"SLICE": 50}, {"LONG": 20, "LANE": 8}, {"RING": 16, "STEP": 1},
    {"LANE": 1 << 30, "LONG": 1 << 30},
])
def test_lanes_of_any_cut_give_the_same_ids(codec, changes, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for name, value in changes.items():
        monkeypatch.setattr(V, name, value)
    some = [*texts(150), *whole_texts(15)]
    assert encoded(codec, some) == library.encode(some)


def test_ids_are_given_out_before_a_text_ends(codec, monkeypatch):
    """On ordinary texts: what lies before the meeting place is committed, and the places held
    stay below the window and one step."""
    seen = []
    real = V.Lanes.meeting

    def meeting(self, last, done, s):
        out = real(self, last, done, s)
        assert len(last) == V.RING
        seen.append((len(out), int((out > done).sum()), int((s - out).max())))
        return out

    monkeypatch.setattr(V.Lanes, "meeting", meeting)
    some = whole_texts()
    monkeypatch.setattr(codec, "search", None)  # none of them is searched alone
    assert sum(map(len, encoded(codec, some))) > 0
    assert sum(n for n, _, _ in seen) > sum(map(len, some)) / V.LANE
    assert sum(moved for _, moved, _ in seen) > 0.95 * sum(n for n, _, _ in seen)
    assert max(held for _, _, held in seen) <= codec.lanes.longest + V.STEP


def test_pairs_are_judged_as_merging_does(codec):
    lanes, r = codec.lanes, random.Random(4)
    names = list(lanes.number)
    short = [s for s in names if len(s) <= 3]
    marks = [s for s in names if set(s) == {V.MARK}]
    two = [(r.choice(names), r.choice(short)) for _ in range(4000)] + [(r.choice(short), r.choice(names)) for _ in range(4000)]
    two += [(s, s) for s in names[::7]] + [(a, b) for a in marks for b in [*marks, "▁the", "s"]]
    want = [codec.pieces.merged(a + b) == [a, b] for a, b in two]
    a, b = (np.array([lanes.number[s] for s in side]) for side in zip(*two, strict=True))
    assert lanes.judged(a, b).tolist() == want and lanes.may(a, b).tolist() == want and lanes.may(a, b).tolist() == want
    assert sum(want) < len(want)


def test_ids_give_the_text_back(codec):
    some = [t for t in texts() if V.MARK not in t]
    for t, ids in zip(some, encoded(codec, some), strict=True):
        assert codec.decode(pa.array([ids], pa.list_(pa.int32()))) == [t]


def test_decoding_odd_ids(codec):
    lists = pa.array([None, [], [None], [-1, 10**6], [1, 2], [3 + 0xFF]], pa.list_(pa.int32()))
    assert codec.decode(lists) == ["", "", "", "", "", "�"]


def segmentations(text, score):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in score:
            for rest in segmentations(text[n:], score):
                yield [text[:n], *rest]


def test_streamed_parts_give_the_same_pieces(codec, monkeypatch):
    monkeypatch.setattr(V, "STEP", 7)
    r = random.Random(2)
    for t in ("▁the▁therein▁of" * 9, "日本a" * 30, "ab" * 100, "x"):
        whole = codec.pieces.merged(t) if len(t) < 400 else None
        one, got, at = V.Search(codec.pieces), [], 0
        while at < len(t):
            n = r.randint(1, 20)
            got += one.feed(t[at : at + n])
            at += n
            assert len(one.text) < 200  # what is settled is forgotten
        got += one.finish()
        assert [p[2] for p in got] == whole


def test_unigram_search_is_the_best_segmentation(monkeypatch):
    r = random.Random(1)
    for step in (3, 1024):
        monkeypatch.setattr(V, "STEP", step)
        for _ in range(150):
            listed = {c: -5.0 - r.random() for c in "abc"}
            for _ in range(8):
                listed["".join(r.choice("abc") for _ in range(r.randint(2, 4)))] = -r.random() * 12
            pieces = V.Pieces(list(listed.items()), list(range(len(listed))), merging=False)
            t = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
            one = V.Search(pieces)
            got = [p[2] for p in [*one.feed(t), *one.finish()]]
            best = max(sum(listed[p] for p in s) for s in segmentations(t, listed))
            assert "".join(got) == t and abs(sum(listed[p] for p in got) - best) < 1e-9


def test_merging_search_is_greedy_merging():
    r = random.Random(4)
    for _ in range(300):
        listed = {c: -100.0 for c in "abc"}
        for k in range(10):
            listed["".join(r.choice("abc") for _ in range(r.randint(2, 4)))] = -float(r.randint(0, 5))
        pieces = V.Pieces(list(listed.items()), list(range(len(listed))), merging=True)
        t = "".join(r.choice("abcd") for _ in range(r.randint(1, 14)))
        one = V.Search(pieces)
        assert [p[2] for p in [*one.feed(t), *one.finish()]] == pieces.merged(t)


def slow_fingerprint(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    r = random.Random(9)
    for n in (0, 1, 2, 3, 4, 5, 60, 66, 67, 200):
        t = " ".join(r.choice(["Ab", "é", "the", "X y", "q"]) for _ in range(n)) + "\n\t "
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def slow_spans(lists, within):
    places = sorted({p for _, l in lists for p in l})
    full = {
        (a, b - a + 1)
        for a in places for b in places
        if a <= b < a + within and all(sum(a <= p <= b for p in l) >= n for n, l in lists)
    }
    return {(a, n) for a, n in full if not any((c, m) != (a, n) and a <= c and c + m <= a + n for c, m in full)}


def test_shortest_stretches():
    r = random.Random(8)
    for _ in range(400):
        free = list(range(24))
        r.shuffle(free)
        lists = []
        for _ in range(r.randint(1, 3)):
            own = sorted(free.pop() for _ in range(r.randint(1, 6)))
            lists.append((r.randint(1, 3), own))
        within = r.randint(1, 12)
        got = decontaminate.spans(lists, within)
        assert len(got) == len(set(got)) and set(got) == slow_spans(lists, within), (lists, within)


def test_postings_of_a_shard():
    known = decontaminate.Vocabulary(pickle.dumps([b"a", b"b", b"none"]))
    texts = [b"a b x a".split(), [], b"b".split()]
    for vocabulary, listed in ((known, {b"a", b"b"}), (None, {b"a", b"b", b"x"})):
        terms, n, places = decontaminate.posted(texts, vocabulary)
        got = dict(zip(terms.to_pylist(), places.to_pylist(), strict=True))
        assert set(got) == listed and [len(x) for x in places.to_pylist()] == n.tolist()
        assert got[b"a"] == [0, 3] and got[b"b"] == [1, 6]
    assert len(decontaminate.posted([[]], known)[0]) == len(decontaminate.posted([], None)[0]) == 0


def test_words_of_the_contract():
    assert decontaminate.words("Don't_Stop 42é—x\x7fÄ ".encode()) == [b"don", b"t", b"stop", "42é—x".encode(), "Ä".encode()]


def test_curve_is_a_walk_through_all_cells():
    for n, bits in ((2, 3), (3, 2), (3, 4), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
        index = sharding.curve_index(list(cells), bits)
        order = np.argsort(index)
        assert (index[order] == np.arange(1 << (n * bits))).all()
        assert (np.abs(np.diff(cells[:, order])).sum(axis=0) == 1).all()


def test_candidates():
    t = 'a token = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d" b password: hunter2!x c plainwordsonlyhere'
    assert [t[a:b] for a, b in secret_scan.candidates(t)] == ["0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d", "hunter2!x"]
    assert list(secret_scan.candidates("")) == []
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1/" * 32 + "\n-----END RSA PRIVATE KEY-----"
    assert [block[a:b] for a, b in secret_scan.candidates(block)] == [block]


def test_curve_stays_finite_where_labels_part_entirely():
    from quire.llm.quality_classifier import _logistic

    x = np.stack([np.ones(200), np.linspace(-1, 1, 200), np.linspace(-1, 1, 200) ** 3], axis=1)
    w = _logistic(x, (x[:, 1] > 0).astype(float))
    assert np.isfinite(w).all() and np.abs(w).max() < 1e3
    assert ((x @ w > 0) == (x[:, 1] > 0)).all()
