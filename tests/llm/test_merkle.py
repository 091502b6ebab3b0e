"""Operator 13 against a brute-force Merkle tree."""

import zlib
from hashlib import sha256

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(r, text):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[part(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def tree(digests):
    """Root and each leaf's path [(left, right)]."""
    paths, where, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for k, w in enumerate(where):
            a = w - w % 8
            paths[k].append(("".join(nodes[a:w]), "".join(nodes[w + 1:a + 8])))
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        where = [w // 8 for w in where]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs, kept = [], []
    for g in langs:
        rs = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        root, paths = tree([leaf_of(r, r["text"]) for r in rs])
        subs.append(root)
        kept.append((rs, paths))
    root, tops = tree(subs)
    out = []
    for (rs, paths), sub, top in zip(kept, subs, tops, strict=True):
        for r, p in zip(rs, paths, strict=True):
            path = p + top
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for a, b in path:
                node = H(a, node, b)
            out.append((r["doc_id"], leaf_of(r, r["text"]), sub, root, H(*[a + b for a, b in path]), node, node == root))
    return out


def run(spark, tmp_path, df):
    from promolens.llm.merkle import op13_merkle_manifest
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def check(spark, tmp_path, rows):
    got = run(spark, tmp_path, spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1:5])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_documents_equal_brute_force(spark, tmp_path):
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, tmp_path, rows)


def test_nulls_ties_repeats_and_negative_ids(spark, tmp_path):
    row = lambda i, text, lang, n=3: {"doc_id": i, "text": text, "lang": lang, "source": "S" if n else None, "n_chars": n}
    rows = [row(None, f"T{i % 5}", "en") for i in range(21)]                    # null ids, some rows equal
    rows += [row(7, f"A{i % 9}", "en") for i in range(30)] + [row(8, "B", "en"), row(-3, "", "en"), row(1 << 62, None, "en"), row(-(1 << 63), "x", "en")]
    rows += [row(i * 977, "Text %d Ä" % i, None, None) for i in range(-40, 60)]
    rows += [row(5, "only", "é")] + [row(i, "t", "de") for i in range(8)] + [row(i << 40, "Sparse", "fr") for i in range(9)]
    check(spark, tmp_path, rows)


def test_several_chunks_and_more_levels(spark):
    """With one level a chunk the tree takes several passes up and down."""
    from pyspark.sql import functions as F
    from promolens.llm.merkle import leaves, manifest
    rows = [{"doc_id": i * 3, "text": f"Row {i}", "lang": "ab"[i > 360], "source": None, "n_chars": i} for i in range(400)]
    rows += [{"doc_id": 3, "text": "Same", "lang": "a", "source": None, "n_chars": 1}] * 11
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = manifest(leaves(df, tampered={"text": F.lower("text")}, where=where), levels=1)
    got = [(r.id, r.digest.hex(), r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in out.collect()]
    assert sorted(got) == sorted(brute(rows))


def test_empty_table_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F
    assert run(spark, tmp_path, spark.createDataFrame([], SCHEMA)) == []
    (tmp_path / "b").mkdir()
    rows = [{"doc_id": i, "text": "a", "lang": "en", "source": "s", "n_chars": 1} for i in range(3)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    for c in ("g", "id", "digest", "pos", "n", "w", "leaf", "root", "verified"):
        df = df.withColumn(c, F.lit("clash"))
    assert sorted(run(spark, tmp_path / "b", df)) == sorted(brute(rows))


def test_a_broken_coordinate_is_refused(spark):
    import pyarrow as pa
    from promolens.llm.merkle import _slots
    with pytest.raises(ValueError):
        _slots(pa.table({"pos": [0, 0], "digest": [b"a", b"b"]}), 0, 2, 5)
