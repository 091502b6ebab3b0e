"""Operators 1, 2, 4, 6, 7, 9 and 10: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from brute import base_counts, words
from llm_fixtures import frame  # noqa: F401
from pyspark.sql import functions as F

EDGES = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (903, "one"), (None, "one two"), (905, "ä ö ü 漢字 😀"), (906, "x " * 3000), (907, "a" * 4000),
         (908, "a b\x0bc\x0cd\re\tf\n\n#*$%&|<>"), (909, "same line\nother\nsame line\n \nsame line ")]


def test_quality_base_counts(frame):
    from promolens.llm.quality_llr import judge
    r = random.Random(1)
    block = " ".join(f"w{i}" for i in range(12))
    rows = [*EDGES, (1, f"{block} and {block} {block}"), (2, " ".join(r.choice("abc") for _ in range(200))), (3, f"{block}\n{block}\n{block} z")]
    out = judge(frame(rows), [0.0] * 64).collect()
    assert sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in out), key=str) == sorted(
        ((i, *base_counts(t)) for i, t in rows), key=str)
    for x in out:
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
        assert x.kept == (not x.base_failed) and x.score == 0.0


def test_quality_model_matches_brute_force(frame, spark):
    from promolens.llm.quality_llr import fit, judge
    hashed = lambda values: int(spark.sql("SELECT xxhash64(" + ",".join(f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'" for v in values) + ") h").first()[0])
    rows = [(1, "good words here good"), (2, "junk junk words"), (3, "good here"), (4, None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit(frame(rows), labels, buckets=16, alpha=0.5, prior=3.0)

    def buckets(text):
        h = [hashed([w]) for w in words(text)]
        return [x % 16 for x in h] + [hashed([a, b]) % 16 for a, b in zip(h, h[1:], strict=False)]

    raw = np.bincount([b for _, t in rows for b in buckets(t)], minlength=16) + 0.5
    target = np.bincount(buckets(rows[0][1]), minlength=16) + 3.0 * raw / raw.sum()
    expect = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model, expect)
    scores = {x.doc_id: x.score for x in judge(frame(rows), model).collect()}
    for i, t in rows:
        assert scores[i] == pytest.approx(np.mean([expect[b] for b in buckets(t)]) if t else 0.0, abs=1e-5)


def test_quality_separates_held_out_labels(spark):
    from promolens.llm.common import documents, table
    from promolens.llm.quality_llr import fit, judge
    d = "/root/testdata/sf0.01"
    docs, labels = documents(spark, d, "doc_id", "text"), table(spark, d, "labels")
    model = fit(docs, labels.where("doc_id % 5 <> 0"))
    held = judge(docs, model).join(labels.where("doc_id % 5 = 0 AND toxic = 0"), "doc_id").select("quality", "kept").collect()
    assert np.mean([x.kept for x in held if x.quality == 1]) > 0.9
    assert np.mean([x.kept for x in held if x.quality == 0]) < 0.2


def test_quality_keeps_a_clean_text_with_many_copies(frame, spark):
    from promolens.llm.common import documents, table
    from promolens.llm.quality_llr import fit, judge
    d = "/root/testdata/sf0.01"
    docs, labels = documents(spark, d, "doc_id", "text"), table(spark, d, "labels")
    model = fit(docs, labels)
    judged = judge(docs.join(labels, "doc_id", "left_anti"), model).select("text", "n_words", "score", "kept").collect()
    plain = max((x for x in judged if x.kept and 200 <= x.n_words <= 400), key=lambda x: (x.score, x.text))
    copies = spark.range(1_000_000, 1_001_000).select(F.col("id").alias("doc_id"), F.lit(plain.text).alias("text"))
    grown = docs.unionByName(copies)
    assert fit(grown, labels) == model
    assert all(x.kept for x in judge(copies, model).select("kept").collect())


def test_quality_rejects_held_out_toxic_texts(spark):
    from promolens.llm.common import documents, table
    from promolens.llm.quality_llr import TOXIC_THRESHOLD, judge, toxic_words
    d = "/root/testdata/sf0.1"
    docs, labels = documents(spark, d, "doc_id", "text"), table(spark, d, "labels")
    toxic = toxic_words(docs, labels.where("doc_id % 5 <> 0"))
    held = judge(docs.join(labels.where("doc_id % 5 = 0 AND quality = 1"), "doc_id"), [0.0] * 64, toxic=toxic).select("toxic", "base_failed", "toxic_score", "kept").collect()
    held = [x for x in held if not x.base_failed]
    assert all(x.kept == (x.toxic_score < TOXIC_THRESHOLD) for x in held)
    assert np.mean([x.kept for x in held if x.toxic == 1]) < 0.15
    assert np.mean([x.kept for x in held if x.toxic == 0]) > 0.97
    assert toxic_words(docs, labels.where("toxic = 0")) == toxic_words(docs.limit(0), labels) == {}


def test_importance_resampling(frame, spark):
    from promolens.llm.importance import resample
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["good", "fine", "text"] if i % 2 else ["junk", "spam", "$$"]) for _ in range(30))) for i in range(60)] + EDGES
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 20, 2)], "doc_id long, quality int, toxic int")
    out = resample(frame(rows), labels, keep=0.5).collect()
    assert len(out) == len(rows)
    n = sum(x.kept for x in out)
    least = min(x.gumbel_key for x in out if x.kept)
    assert n >= math.ceil(0.5 * len(rows)) and all(x.kept == (x.gumbel_key >= least) for x in out)
    assert sum(x.gumbel_key > least for x in out) < math.ceil(0.5 * len(rows))
    kept = {x.doc_id for x in out if x.kept}
    assert {i for i in range(1, 60, 2)} <= kept and not kept & set(range(0, 60, 2))
    assert resample(frame([]), labels).count() == 0


def test_hmm_likelihood_is_exact():
    from promolens.llm.hmm_lm import SEGMENT, Model
    rng = np.random.default_rng(0)
    share = rng.random(9)
    model = Model.initial(3, share / share.sum(), 1)
    tokens = rng.integers(0, 9, 3 * SEGMENT + 50)
    first = np.array([0, 1, 5, 5 + SEGMENT, 3 * SEGMENT + 50])
    got = model.log_likelihood(tokens, first)
    for n, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        v, log = model.start * model.emit[tokens[a]], 0.0
        for t in tokens[a + 1:b]:
            log += math.log(v.sum())
            v = (v / v.sum()) @ model.move * model.emit[t]
        assert got[n] == pytest.approx(log + math.log(v.sum()), rel=1e-9)
    # expected counts add up to the tokens, and a step does not lower the likelihood
    starts, moves, emits, before = model.expected(tokens, first)
    assert emits.sum() == pytest.approx(len(tokens)) and moves.sum() + starts.sum() == pytest.approx(len(tokens))
    better = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    assert better.expected(tokens, first)[3] >= before


def test_hmm_scores(frame):
    import zlib

    from promolens.llm.hmm_lm import score
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat"] if i % 2 else ["der", "Hund", "lief"]) for _ in range(r.randrange(1, 80)))) for i in range(80)] + EDGES
    out = score(frame(rows), states=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)), None]
    counts = {}
    for i, t in rows:
        if not held(i):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n,
                    round(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows), key=str)
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out), key=str) == want
    test = [x for x in out if x.held_out and x.doc_id < 80]
    assert sum(x.score for x in test) > sum(x.base_score for x in test)
    assert score(frame([])).count() == 0


def test_template_leaks(frame, spark):
    from promolens.llm.template_decon import leaks
    item = "A train leaves Boston for Denver with 240 riders and drives 60 miles each hour, how long until 180 miles are behind Boston ?"
    bench = spark.createDataFrame([(1, item), (2, "short question here"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    moved = item.replace("Boston", "Oslo").replace("Denver", "Bergen").replace("240", "99").replace("60", "45").replace("180", "90")
    rows = [(1, "Before it. " + item + " After."), (2, "Text then " + moved + " end"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, None), (5, ""),
            (6, " ".join(item.split()[:9])), (7, "so a short question here stands"), (8, "nothing of this kind"), (None, item), (1, "another text")]
    got = {(r.doc_id, r.item_id): r for r in leaks(frame(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (7, 2)}
    assert got[1, 1].cover > 0.9 and got[2, 1].slot_share == 1.0 and got[2, 1].n_slots >= 5
    # the template with slots that contradict each other
    broken = item.replace("60 miles", "60 miles").replace("Boston for", "Oslo for").replace("behind Boston", "behind Paris")
    share = {r.doc_id: r.slot_share for r in leaks(frame([(1, broken)]), bench, min_slots=0.0).collect()}
    assert share[1] < 1.0
    assert leaks(frame([]), bench).count() == 0 and leaks(frame(rows), bench.where("item_id > 2")).count() == 0


def test_template_leaks_in_other_case_and_in_excerpts(frame, spark):
    from promolens.llm.template_decon import leaks
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(800)]
    some = lambda n: [r.choice(vocabulary) if r.random() > 0.1 else r.choice(["Rosa", "Timur", "17", "230"]) for _ in range(n)]
    items = [(i, " ".join(some(70))) for i in range(20)]
    bench = spark.createDataFrame([*items, (None, items[0][1] + " with more")], "item_id long, text string")
    rows, expect = [], set()
    for i, text in items:
        w = text.split()
        at = r.randint(0, 45)
        for k, t in enumerate((text.upper(), text.title(), " ".join(w[at:at + 25]), " ".join(w[at:at + 25]).upper())):
            rows.append((100 * i + k, " ".join(some(30)) + " " + t + " " + " ".join(some(30))))
            expect.add((100 * i + k, i))
        rows.append((100 * i + 10, " ".join(some(150))))                      # clean
        rows.append((100 * i + 11, " ".join(w[at:at + 12])))                  # too short an excerpt
    got = {(x.doc_id, x.item_id) for x in leaks(frame(rows), bench).collect()}
    assert {p for p in got if p[1] is not None} == expect
    assert {p[0] for p in got if p[1] is None} == {0, 1, 2, 3}


def test_url_rules(spark):
    from promolens.llm.url_rules import judge
    rows = [(i, f"https://{'spam.bad-host.net' if i % 2 else 'www.good.net'}/en/{i}") for i in range(60)]
    rows += [(100, None), (101, "no scheme"), (102, "HTTP://Sub.Example.ORG/es/1?q=1"), (103, "http://example.org/en/17"), (104, "http://a.org/x"), (105, "x://y.com/de/1#f"),
             (106, "x://y.com/fr/"), (107, "x://notorg/de/"), (108, "a://b://c/d"), (None, "http://a.org"), (104, "http://a.org/x"), (109, "http://k.org:80/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' AS tokens", "'clash' AS rid")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(40)] + [(None, 0, 0), (50, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in judge(pages, labels).collect()}
    assert got[41, "spam.bad-host.net", "/en/41"] == (None, "block") and got[42, "www.good.net", "/en/42"] == (None, "allow")
    assert got[100, "", ""] == got[101, "", ""] == (None, "allow")
    assert got[102, "sub.example.org", "/es/1"] == ("example.org/es/", "block") and got[103, "example.org", "/en/17"] == ("example.org/en/1", "block")
    assert got[104, "a.org", "/x"] == ("org/", "allow") and got[105, "y.com", "/de/1"] == ("com/de/", "block") and got[106, "y.com", "/fr/"] == ("com/fr/", "allow")
    assert got[107, "notorg", "/de/"] == (None, "allow") and got[108, "b:", "//c/d"] == (None, "allow") and got[None, "a.org", ""] == (None, "allow")
    assert got[109, "k.org:80", "/"] == (None, "allow")
    assert judge(pages, labels).count() == len(rows) and judge(pages.limit(0), labels).count() == 0 and judge(pages, labels.limit(0)).count() == len(rows)


def test_mined_rules_against_counting(spark):
    """Supports and confidences of all token sets up to three, by counting."""
    from itertools import combinations

    from promolens.llm.url_rules import mine, tokens_of
    r = random.Random(6)
    rows = [(i, f"http{r.choice(['', 's'])}://{r.choice(['a', 'b', 'c'])}.{r.choice(['com', 'net'])}/{r.choice(['x', 'y'])}/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "id long, url string")
    bad = {i: int("a." in u and "/x/" in u and r.random() < 0.9) for i, u in rows}
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    sets = {x.id: set(x.t) for x in pages.select("id", tokens_of(pages.url).alias("t")).collect()}
    names = sorted(set().union(*sets.values()))
    conf = {}
    for k in (1, 2, 3):
        for c in combinations(names, k):
            inside = [i for i, s in sets.items() if s >= set(c)]
            hits = sum(bad[i] for i in inside)
            if hits >= 3 and hits / len(inside) >= 0.5:
                conf[c] = (hits, hits / len(inside))
    want = {c: v for c, v in conf.items() if not any(conf[p][1] >= v[1] for k in range(1, len(c)) for p in combinations(c, k) if p in conf)}
    got = {tuple(x.tokens): (x.hits, x.confidence) for x in mine(pages, labels).collect()}
    assert got == want and got


def test_small_bad_host_among_many_labels(spark):
    from promolens.llm.url_rules import judge
    rows = [(i, f"https://www.good{i % 50}.net/p/{i}") for i in range(6000)] + [(6000 + i, f"https://www.small-bad.net/p/{i}") for i in range(4)]
    rows += [(7000 + i, f"https://www.large-bad.net/p/{i}") for i in range(3200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 6000), 0) for i, _ in rows if i != 6003], "doc_id long, quality int, toxic int")
    blocked = {r.page_id for r in judge(pages, labels).where("verdict = 'block'").collect()}
    assert set(range(6000, 6004)) <= blocked and not blocked & set(range(6000))


@pytest.mark.parametrize("split", ["64m", "700b"])
def test_warc_round_trip(spark, tmpdir_spark, split):
    from promolens.llm.warc_chain import read_archives, write_archives
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "é" * 700
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "u\r\nv", None), (7, "http://e/", ""),
            (8, "http://f/", f"x{fake}y{fake}"), (9, "http://g/", "WARC/1.0\r\n"), (10, "http://h/", f"{fake * 30}tail\r\n\r\n"), (None, "http://i/", "\r\n\r\n"), (11, "http://j/", "\n" * 1200), (11, "http://j/", "\n" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "'clash' AS bytes")
    path = tmpdir_spark("warc")
    write_archives(pages.repartition(3), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted((tuple(r) for r in read_archives(spark, path).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for i, _, html in rows[:-2]:
        data = (html or "").encode()
        revisit = html == big and i != 3
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    for kind in ("response", "response"):
        want.append((11, 1200, hashlib.sha1(b"\n" * 1200).hexdigest(), kind, None))
    assert got == sorted(want, key=str)


def test_warc_broken_chain_fails(spark, tmpdir_spark):
    from promolens.llm.warc_chain import read_archives
    path = tmpdir_spark("broken")
    record = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nhello"
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="broken chain"):
        read_archives(spark, path).collect()


def test_warc_empty(spark, tmpdir_spark):
    from promolens.llm.warc_chain import read_archives, write_archives
    path = tmpdir_spark("none")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0


def test_sentencepiece_agenda_equals_the_library():
    import sentencepiece

    from promolens.llm.sentencepiece_dropout import MODEL, Pieces
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = Pieces(MODEL, 0.0, 0)
    for text in ["Hello  world", " a", "a ", "  ", "\n\n x\ty", "漢字 é 😀", "aaaaaaaaa bbbb", "x" * 500, "The cat sat on the mat.\nIt was 12,345 km away!"]:
        assert np.frombuffer(plain.encode(text), "<i4").tolist() == sp.encode(text)


def test_sentencepiece_dropout(frame):
    from promolens.llm.sentencepiece_dropout import MODEL, Pieces, decode, encode
    rows = [*EDGES, (1, "▁ meta ▁▁ piece▁"), (2, "The quick brown fox " * 20), (3, "\0 and \x01"), (4, "  two  spaces  ")]
    docs = frame(rows).selectExpr("*", "'clash' AS ids", "'clash' AS decoded")
    out = decode(encode(docs, dropout=0.3)).collect()
    assert sorted(((x.doc_id, x.decoded) for x in out), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    again = {x.doc_id: x.ids for x in encode(docs.repartition(5), dropout=0.3).collect()}
    assert all(again[x.doc_id] == x.ids for x in out)
    seeds = {Pieces(MODEL, 0.3, s).encode("segmentation varies with the seed") for s in range(8)}
    assert len(seeds) > 1
    assert encode(frame([])).count() == 0


def test_sentencepiece_cuts_each_occurrence_on_its_own():
    from promolens.llm.sentencepiece_dropout import MODEL, Pieces
    pieces = Pieces(MODEL, 0.1, 17)
    word = " internationalisation"
    inside = {tuple(pieces.agenda(word, k)) for k in pieces.keys(5, 200)}
    assert len(inside) > 2
    assert len({pieces.encode("internationalisation", i) for i in range(200)}) > 2
    # the remembered run gives what the agenda gives
    units = [" internationalisation", " the", " aaaaaaaaa", " 漢字", " keyboards,"] * 40
    want = b"".join(np.array(pieces.agenda(u, k), "<i4").tobytes() for u, k in zip(units, pieces.keys(9, len(units)), strict=True))
    assert pieces.encode("".join(units)[1:], 9) == want


def planted_tables(spark, folder):
    """The small tables, and for the longest good documents a copy with other line ends:
    its lines are like no line of the original, its text is."""
    d = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id").distinct(), "doc_id")
    rows, wrapped = [], lambda w, shift: "\n".join(" ".join(w[max(0, i):i + 12]) for i in range(-shift, len(w), 12))
    for r in good.orderBy(F.length("text").desc()).limit(6).collect():
        w = r.text.split()[:600]
        rows += [(10_000 + 2 * r.doc_id + k, wrapped(w, 6 * k), r.lang, r.source) for k in (0, 1)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.unionByName(more.select(*docs.columns)).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline_keeps_columns_and_decides(spark, tmp_path):
    import corpus_pipeline
    from promolens.llm.common import documents
    d = planted_tables(spark, str(tmp_path))
    docs = documents(spark, d)
    ids = [{r[0] for r in docs.select("doc_id").collect()}]
    from promolens.llm.common import shared_table
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = shared_table(stage(spark, frame, d), "test-stage")
        ids.append({r[0] for r in frame.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == docs.columns
    assert ids[1] != ids[0] and ids[3] != ids[2] and frame.columns == [*docs.columns, "ids"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == ids[-1]


@pytest.mark.parametrize("rows", [0, 8])
def test_pipeline_on_empty_null_repeated_and_clashing_rows(spark, rows):
    """Every stage takes them; the result keeps the clashing columns."""
    import corpus_pipeline
    from promolens.llm.common import shared_table
    text = " ".join(f"word{i}" for i in range(40))
    data = [(1, None, "en", "s", None), (None, text, "en", "s", 5), (2, "", None, None, 0), (3, text, "en", "s", 5), (3, text, "en", "s", 5),
            (4, " \n\t", "en", "s", 3), (5, "x" * 50_000, "en", "s", 9), (6, "w " * 20_000, "en", "s", 9)][:rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("kept", "ids", "line", "n", "cid", "score"):
        df = df.withColumn(c, F.lit("clash"))
    frame = df
    for name, stage in corpus_pipeline.STAGES:
        frame = shared_table(stage(spark, frame, "/root/testdata/sf0.001"), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == df.columns
        left = {r.doc_id for r in frame.select("doc_id").collect()}
        assert left <= {r[0] for r in data} and not left & {1, 2, 4}          # without words: rejected by the quality rules


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.3])
def test_sentencepiece_remembered_runs_equal_the_agenda(dropout):
    """Remembered words, sets of skipped candidates and the list form against the heap."""
    from promolens.llm.sentencepiece_dropout import MODEL, Pieces
    r = random.Random(7)
    pool = ["internationalisation", "the", "aaaaaaaaa", "漢字", "keyboards,", "▁x", "x" * 90, "segmentation", "é́ñ", "1234567890", "don't", "of"]
    texts = ["".join(r.choice(pool) + r.choice([" ", "  ", "\n", " "]) for _ in range(r.randrange(60))) for _ in range(120)]
    pieces = Pieces(MODEL, dropout, 17)
    got = [x for a in range(0, 120, 40) for x in pieces.encode_all(texts[a:a + 40], list(range(a, a + 40)))]
    assert dropout == 0 or any(pieces.variant.values())
    for i, (text, ids) in enumerate(zip(texts, got, strict=True)):
        units = re.findall(r" *[^ \n]+|\n| +", " " + text) if text else []
        want = [x for u, k in zip(units, pieces.keys(i, len(units)), strict=True) for x in pieces.agenda(u, k)]
        assert ids == np.array(want, "<i4").tobytes()
        assert pieces.decode(ids) == text


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_sentencepiece_cuts_a_block_of_words_together(monkeypatch, dropout):
    """Words of up to 24 letters of the vocabulary are merged together; each as the agenda does."""
    import random

    from promolens.llm.sentencepiece_dropout import MODEL, Pieces
    r = random.Random(11)
    words = ["".join(r.choice("abcdeinorst,.1" + "é漢") for _ in range(r.randrange(1, 30))) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(40)]
    pieces, alone = Pieces(MODEL, dropout, 17), []
    cut = Pieces.cut
    monkeypatch.setattr(Pieces, "cut", lambda self, unit, *a, **k: (alone.append(unit), cut(self, unit, *a, **k))[1])
    got = pieces.encode_all(texts, list(range(40)))
    known = {u for u in alone if len(u) <= 24 and all(c == " " or pieces.ids.get(c) for c in u)}
    assert not known - {u for n, u in enumerate(pieces.unit) if any(k >> 60 == n for k in pieces.variant)}
    for i, (t, x) in enumerate(zip(texts, got, strict=True)):
        units = [" " + w for w in t.split(" ")]
        keys = pieces.keys(i, len(units))
        assert x == b"".join(pieces._bytes(pieces.agenda(u, k)) for u, k in zip(units, keys, strict=True))
