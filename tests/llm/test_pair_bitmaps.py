"""Operator 12 against both tokenizers on whole texts and plain counting."""

import functools
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import frame  # noqa: F401

EDGES = [(900, None), (901, ""), (902, " "), (903, "  \t\n  a  "), (904, "<|endoftext|> <s></s> it's"), (905, "x▁y ok"), (906, "▁"),
         (907, "a  b  c　 d  e\u0085 f"), (908, "日本語 テキスト 🙂 é ñ"), (909, "a" * 5000), (910, "word " * 3000),
         (911, "same text"), (911, "same text"), (None, "same text"), (None, None), (912, "\x00 \x01\r\n  \n x\n\n y "), (913, "don't  we'll   12345 6,7.8"), (914, "​ a ﻿b")]


@functools.cache
def tools():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    code, k = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            code[chr(256 + k)] = b
            k += 1
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), code


def brute_groups(text):
    t, sp, code = tools()
    if not text:
        return []
    whole = (" " + text).encode()
    a = t.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(code[c] for c in t.id_to_token(i)) for i in a]
    b = sp.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    groups, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(a):
        x, y = [a[i]], [b[j]]
        end_a, end_b = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                x.append(a[i])
                end_a, i = end_a + len(bytes_a[i]), i + 1
            else:
                y.append(b[j])
                end_b, j = end_b + len(bytes_b[j]), j + 1
        groups.append((x, y))
    return groups


def brute(rows):
    groups = [(i, brute_groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), c in zip(groups, links, strict=True):
        s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(k for p, k in c.items() if docs[p] == most[p[0]]), sum(k * docs[p] for p, k in c.items()),
                    sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out, key=str), docs, sum(links, Counter())


def check(frame, rows, parts):
    from promolens.llm.pair_bitmaps import FIGURES, align
    out, counts = align(frame(rows).repartition(parts))
    want, docs, links = brute(rows)
    got = out.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {(r.a, r.b): (r.docs, r.links) for r in counts.collect()} == {p: (n, links[p]) for p, n in docs.items()}


def test_edges_and_random_texts(frame):
    r = random.Random(2)
    pool = ["Haus", "don't", "  ", "\n", "\t", "naïve", "x_y", "123", " ", "🙂🙃", "the", "The", "-", "ﬁ", " ", "..", "á"]
    rows = [(i, "".join(r.choice(pool) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(40)))) for i in range(300)]
    check(frame, rows + EDGES, 3)


def test_documents(frame, spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(frame, rows, 4)


def test_empty_table(frame):
    from promolens.llm.pair_bitmaps import align
    out, counts = align(frame([]))
    assert out.collect() == [] and counts.collect() == []


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 65536])
def test_containers_round_trip(n):
    from promolens.llm.pair_bitmaps import BITSET, containers, places
    r = np.random.default_rng(n)
    at = [np.sort(r.choice(65536, n, replace=False)), np.array([0, 65535])]
    group = np.repeat([3, 9], [n, 2])
    names, count, bits = containers(group, np.concatenate(at))
    assert list(names) == ([3, 9] if n else [9]) and list(count) == ([n, 2] if n else [2])
    assert all(len(b) <= BITSET for b in bits.to_pylist())
    row, place = places(bits)
    assert (row == np.searchsorted(names, group)).all() and (place == np.concatenate(at)).all()


def test_merge_ors_and_keeps_order(spark):
    from promolens.llm.pair_bitmaps import containers, merged, places
    from pyspark.sql import functions as F
    r = random.Random(4)
    want, rows = defaultdict(set), []
    for _ in range(3000):
        k = (r.randrange(30), r.randrange(3), r.randrange(2), r.randrange(-1, 2))
        at = sorted(r.sample(range(65536), r.choice([1, 3, 900])))
        want[k] |= set(at)
        _, n, bits = containers(np.zeros(len(at), int), np.array(at))
        rows.append((k[2], k[0], k[1], k[3], int(n[0]), bytearray(bits[0].as_py())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = merged(spark.createDataFrame(rows, "block long, a int, b int, plane int, n long, bits binary")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    for x in got:
        at = set(places(pa.array([bytes(x.bits)], pa.binary()))[1].tolist())
        assert at == want[x.a, x.b, x.block, x.plane] and x.n == len(at)
    assert F is not None
