"""Operator 11 against the tokenizer itself, and the plan against one sequence at a time."""

import functools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import frame  # noqa: F401

EDGES = [(900, None), (901, ""), (902, " \t\n "), (903, "<|endoftext|> x"), (904, "it's ÄÖ é é ſ 12"), (904, "repeat"), (904, "repeat"), (None, "one"),
         (None, None), (905, "a" * 9000), (906, "word " * 5000), (907, "日本語   Ωσς Σ")]


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def brute_pieces(rows, capacity):
    out = []
    for i, t in rows:
        ids = brute_ids(t)
        for p, a in enumerate(range(0, len(ids), capacity)):
            x = ids[a:a + capacity]
            out.append((i, p, a, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
    return sorted(out, key=str)


def filled(rows, capacity):
    """Every sequence holds its pieces gapless from 0, none above the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(frame, capacity):
    from promolens.llm.packing import pack, pieces, sequences
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "Beta's", "γάμμα", "x1y2", "—"]) for _ in range(r.randrange(150)))) for i in range(300)] + EDGES
    packed = pack(pieces(frame(rows).repartition(5), capacity, with_ids=True), capacity).persist()
    got = packed.collect()
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=str) == brute_pieces(rows, capacity)
    n = filled([x.asDict() for x in got], capacity)
    assert n <= 1.05 * -(-sum(x.length for x in got) // capacity) + 1
    whole = {x.sequence_id: x.ids for x in sequences(packed).collect()}
    assert len(whole) == n
    for x in got:
        assert whole[x.sequence_id][x.offset:x.offset + x.length] == x.ids
    packed.unpersist()


def one_at_a_time(counts, capacity):
    from promolens.llm.packing import one_sequence
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while left.any():
        chosen, _ = one_sequence(left, capacity)
        for n, k in chosen.items():
            left[n] -= k
        out.append(dict(chosen))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_runs_equal_one_sequence_at_a_time(seed):
    from promolens.llm.packing import best_two_fit
    r = random.Random(seed)
    capacity = r.choice([7, 20, 50, 100])
    counts = Counter({n: r.randrange(1, 60) for n in r.sample(range(1, capacity + 1), r.randrange(1, capacity))})
    flat = [lengths for times, lengths in best_two_fit(counts, capacity) for _ in range(times)]
    assert flat == one_at_a_time(counts, capacity)
    total = Counter()
    for lengths in flat:
        assert sum(n * k for n, k in lengths.items()) <= capacity
        total.update(lengths)
    assert total == counts


def test_two_fit_replaces_the_smallest():
    from promolens.llm.packing import best_two_fit
    # greedy alone: 6+3, 5+2+... ; two pieces 2+2 fill the room of the 3 and the gap better
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, {6: 1, 2: 2}), (1, {3: 1})]


def test_the_plan_does_not_grow_with_the_corpus():
    from promolens.llm.packing import best_two_fit
    r = random.Random(1)
    few = {n: r.randrange(1, 30) for n in range(1, 513)}
    many = {n: c * 1_000_003 for n, c in few.items()}
    runs = best_two_fit(many, 512)
    assert len(runs) < 12 * 512
    used = sum(n * c for n, c in many.items())
    assert sum(t for t, _ in runs) <= 1.05 * used / 512 + 1


def test_empty_table(frame):
    from promolens.llm.packing import pack, pieces
    assert pack(pieces(frame([]))).collect() == []


def test_one_length_holds_all(spark):
    from promolens.llm.packing import pack
    from pyspark.sql import functions as F
    rows = pack(spark.range(0, 5000, 1, 3).select("id", F.lit(3).cast("long").alias("length")), 10).collect()
    assert filled([x.asDict() for x in rows], 10) == -(-5000 // 3)
