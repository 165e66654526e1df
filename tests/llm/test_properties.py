"""Properties that hold for any input."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cadastra.llm import byte_bpe, packing, passage_dedup, shingles

BPE = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def naive(piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranks = [(BPE.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in BPE.ranks]
        if not ranks:
            return [BPE.ranks[p] for p in parts]
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_merges_are_those_of_the_plain_rule(piece):
    assert byte_bpe.merge_piece(piece, BPE.ranks) == naive(piece)
    assert np.frombuffer(BPE.merge([piece])[piece], dtype="<u4").tolist() == naive(piece)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    assert BPE.decode(BPE.encode(text)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=150))
def test_packing_never_overlaps(sizes):
    bins, offsets, gaps = packing.settle(np.array(sizes), 64)
    for b in set(bins.tolist()):
        at = 0
        for offset, size in sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b)):
            assert offset == at
            at += size
        assert at <= 64
    assert len(set(bins.tolist())) >= sum(sizes) / 64


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=60), st.integers(1, 5))
def test_shingles_are_runs_of_words(words, width):
    hashes = shingles.Words().hashes(" ".join(words).encode())
    runs = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    assert len(shingles.shingle_set(hashes, width)) == len(runs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdef", min_size=1, max_size=4), min_size=52, max_size=90), st.integers(0, 30), st.integers(0, 30))
def test_a_shared_passage_is_found_where_it_stands(passage, before, after):
    words = shingles.Words()
    rng = np.random.default_rng(before * 31 + after)
    noise = lambda n: [f"n{rng.integers(10**9)}" for _ in range(n)]
    a, b = noise(before) + passage + noise(20), noise(after) + passage + noise(20)
    found = passage_dedup.passages(words.hashes(" ".join(a).encode()), passage_dedup.Indexed(words.hashes(" ".join(b).encode())))
    covered = max((n for i, j, n in found if i - before == j - after), default=0)
    varied = len(shingles.shingle_set(words.hashes(" ".join(passage).encode()), 5))
    assert covered >= len(passage) or varied < 25


def led_by_hand(rows):
    """(document, place, key, words, leader, its place) of buckets with several documents; a leader's own other rows have none."""
    out, buckets = set(), {}
    for key, doc, place, words in rows:
        buckets.setdefault(key, []).append((doc, place, words))
    for key, held in buckets.items():
        lead = min((d, p) for d, p, _ in held)
        if max(d for d, _, _ in held) > lead[0]:
            out |= {(d, p, key, w, *(lead if d != lead[0] else (None, None))) for d, p, w in held if d != lead[0] or p != lead[1]}
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.tuples(st.integers(-3, 3), st.integers(0, 6), st.integers(0, 4)), max_size=40), st.lists(st.integers(0, 40), max_size=4), st.integers(1, 7))
def test_ranges_lead_their_buckets(rows, cuts, size):
    rows = [(*r, 7) for r in sorted(rows)]
    cuts = sorted(min(c, len(rows)) for c in cuts)
    led, left_open = [], set()
    for begin, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        leaders, outs = passage_dedup._Leaders(), []
        for at in range(begin, end, size):
            key, doc, place, words = (pa.array(c) for c in zip(*rows[at : min(at + size, end)], strict=True))
            outs += leaders.add(pa.RecordBatch.from_arrays([doc, key, place, words.cast(pa.int32())], names=["doc_id", "key", "place", "words"]))
        for r in (r for out in [*outs, *leaders.end()] for r in out.to_pylist()):
            if r["open"]:
                left_open.add((r["key"], r["a"], r["place"], r["words"]))
            else:
                led.append((r["a"], r["place"], r["key"], r["words"], r["b"], r["b_place"]))
    got = led + list(led_by_hand(left_open))
    assert len(got) == len(set(got)) and set(got) == led_by_hand(rows)
