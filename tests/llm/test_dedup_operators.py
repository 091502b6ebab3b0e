"""Operators 3, 5 and 8 against brute force, and their edge cases."""

import random

import pytest
from brute import duplicate_lines, jaccard_components, repeated_bytes
from llm_fixtures import frame  # noqa: F401

EDGES = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "one"), (904, "one"), (None, "one"), (None, None), (905, "ä ö ü"),
         (906, "x " * 3000), (907, "a" * 5000), (908, "a\n" * 40)]


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, hot = line(60), line(12)
    base = [line(40) for _ in range(6)]
    rows = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        text = " ".join(w)
        if r.random() < 0.3:
            text += "\n" + hot
        if r.random() < 0.2:
            text = line(r.randrange(5, 30)) + "\n" + passage + " " + text
        rows.append((i, text))
    return rows + EDGES


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(frame, k, percent):
    from promolens.llm.jaccard_join import link_components
    rows = corpus(1)
    got = sorted((tuple(r) for r in link_components(frame(rows), k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == jaccard_components(rows, k, percent)


def test_jaccard_many_near_copies(frame):
    from promolens.llm.jaccard_join import link_components
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in link_components(frame(rows)).collect()), key=str)
    assert got == jaccard_components(rows, 4, 85)


def test_id_with_two_texts_ties_their_groups(frame):
    from promolens.llm.jaccard_join import link_components
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "c d e f g")]
    assert {(r.doc_id, r.component_id) for r in link_components(frame(rows)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("percent", [60, 80, 93, 100])
def test_duplicate_lines(frame, percent):
    from promolens.llm.line_join import duplicate_lines as operator
    rows = corpus(2)
    assert {(r.doc, r.line) for r in operator(frame(rows), percent).collect()} == duplicate_lines(rows, 1, percent)


def test_lines_with_changed_words(frame):
    """One changed word in lines of 12 to 48, a tenth of the words in long ones; and short lines."""
    from promolens.llm.line_join import duplicate_lines as operator
    r = random.Random(9)
    lines = [[f"v{r.randrange(4000)}" for _ in range(k)] for k in [*range(1, 49), 150, 400, 900]]
    copies = []
    for w in lines:
        w = list(w)
        for at in r.sample(range(len(w)), max(1, len(w) // 20)):
            w[at] = f"new{r.randrange(10**6)}"
        copies.append(w)
    rows = [(1, "\n".join(" ".join(w) for w in lines)), (2, "\n".join(" ".join(w) for w in copies)), (2, "a b c d\na b c d e\na b c d e f g"), *EDGES]
    got = {(x.doc, x.line) for x in operator(frame(rows)).collect()}
    assert got == duplicate_lines(rows, 1, 80)
    assert {(2, k) for k in range(11, len(lines))} <= got


def test_line_texts(frame):
    from promolens.llm.line_join import duplicate_lines as operator
    from promolens.llm.line_join import remove_lines
    docs = frame([(1, "the same line of words\n\nown"), (2, "other\nthe same line of words"), (3, None), (4, "")])
    out = {r.doc_id: r.text for r in remove_lines(docs, operator(docs)).collect()}
    assert out == {1: "the same line of words\n\nown", 2: "other", 3: None, 4: ""}


@pytest.mark.parametrize("length,window", [(40, None), (60, 20)])
def test_repeated_bytes(frame, length, window):
    from pyspark.sql import functions as F

    from promolens.llm.pfp_dedup import remove_ranges, repeated_ranges, with_rid
    rows = corpus(3)
    docs = with_rid(frame(rows))
    out = remove_ranges(docs, repeated_ranges(docs.select("rid", "text"), length, window))
    got = sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)
    assert got == repeated_bytes(rows, length)


def test_empty_tables(frame, spark):
    from promolens.llm.jaccard_join import link_components
    from promolens.llm.line_join import duplicate_lines as operator
    from promolens.llm.line_join import remove_lines
    from promolens.llm.pfp_dedup import remove_ranges, repeated_ranges, with_rid
    none = frame([])
    assert link_components(none).count() == 0
    assert remove_lines(none, operator(none)).count() == 0
    docs = with_rid(none)
    assert remove_ranges(docs, repeated_ranges(docs.select("rid", "text"))).count() == 0


def test_components(spark):
    from promolens.llm.components import components
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}


def test_kth_largest(spark):
    from promolens.llm.common import kth_largest
    r = random.Random(3)
    values = [r.gauss(0, 100) for _ in range(500)] + [1.5] * 40 + [1e-300, 1e300]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 2, 77, 300, 542, 9999):
        assert kth_largest(df, "x", k, 16) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert kth_largest(df.where("x > 1e301"), "x", 3) is None


def test_lines_of_a_dense_group_meet_few(frame, monkeypatch):
    """30 lines that are all alike: the pair join does not list their 435 pairs."""
    from promolens.llm import line_join

    words = [f"common{i}" for i in range(20)]
    rows = [(k, " ".join([*words[:k % 20], f"single{k}", *words[k % 20 + 1:]])) for k in range(30)]
    listed, write = [], line_join.shared_table

    def counted(df, name):
        out = write(df, name)
        listed.append(out.count() if name in ("pairs", "leaders") else 0)
        return out

    monkeypatch.setattr(line_join, "shared_table", counted)
    got = {(r.doc, r.line) for r in line_join.duplicate_lines(frame(rows), 80).collect()}
    assert got == duplicate_lines(rows, 1, 80)
    assert sum(listed) <= 5 * len(rows)
