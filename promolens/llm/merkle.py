"""Operator 13: a Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Every row is a leaf: the digest of its listed fields.  The leaves of one group
(language) ascend by id; every ``FANOUT`` neighbours become their digest until one
node, the group's subroot, remains; the subroots, in the order of their groups,
give the root in the same way.

1. Bitmaps.  A group's ids are a bitmap of 64-bit words, of which only those with
   a set bit exist (one row a word, made by ``bit_or`` with partial aggregation).
2. Popcount directory.  Words are counted by container (2**16 ids) and by two
   coarser digits; running sums inside a parent (at most 2**16 rows each) give the
   number of leaves before every word.  The leaves themselves are never sorted.
3. Rank query.  A leaf's coordinate is its word's directory entry and the popcount
   of the lower bits of the word: an equi-join on the word.
4. Keyed slot arrays.  ``FANOUT ** LEVELS`` coordinates share an array; each digest
   is put into the slot that its coordinate names, and the levels are reduced in place.
   The chunks' tops are leaves of the next pass, until one node a group is left.
5. Proofs go down the same chunks: a node's path (left and right siblings a level)
   is its own part inside the chunk and the path of the chunk's top.

Defined results: a null field counts as ``-``, a null group is a group of its own
before all others, null ids come first in their group.  Rows that share an id
(repeated rows, null ids) are ordered by leaf digest; equal leaves are
interchangeable and keep one place each.  Their digests are counted before
anything is shuffled, so one id may hold any share of the rows.  An empty table
has no leaves and no root.  Columns not listed as fields are ignored, whatever
their names.  Groups are ordered in one task (one row a group).
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.llm.common import discard, documents, shared_table, workers_import

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 8, 5
COPIES = 1 << 16                 # equal leaves that one task writes
NODE = "g string, n long, pos long, digest binary"
PROOF = "id long, g string, pos long, digest binary, subroot string, root string, proof string, folded string"
PATH = "g string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


# --- leaves ------------------------------------------------------------------------

def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 over the fields: ``-`` for null, else byte count, ``:`` and value."""
    def part(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(v) for v in values.values()]).cast("binary"), 256))


def group_key(group: str) -> Column:
    """A text key of the group, null before all values."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
           tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """g (group key), id, digest of every row; ``other`` is the digest with the
    fields of ``tampered`` replaced, in rows that fulfil ``where`` (else null)."""
    values = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("binary") if not tampered else F.when(
        F.coalesce(where, F.lit(False)), leaf_digest({**values, **tampered}))
    return docs.select(group_key(group_col).alias("g"), F.col(id_col).cast("long").alias("id"),
                       leaf_digest(values).alias("digest"), other.alias("other"))


# --- coordinates -------------------------------------------------------------------

def _directory(words: DataFrame) -> DataFrame:
    """``words`` (g, w, bits, n) with ``before``: the leaves of the group in lower words."""
    digits = {"k1": 10, "k2": 26, "k3": 42}                   # 2**16, 2**32 and 2**48 ids
    marked = words.withColumns({k: F.shiftright("w", s) for k, s in digits.items()})
    containers = shared_table(marked.groupBy("g", "k3", "k2", "k1").agg(F.sum("n").alias("n")), "containers")

    def running(df: DataFrame, parents: list[str], key: str, name: str) -> DataFrame:
        w = Window.partitionBy(*parents).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    top = running(containers.groupBy("g", "k3").agg(F.sum("n").alias("n")), ["g"], "k3", "b3").drop("n")
    mid = running(containers.groupBy("g", "k3", "k2").agg(F.sum("n").alias("n")), ["g", "k3"], "k2", "b2").drop("n")
    low = running(containers, ["g", "k3", "k2"], "k1", "b1").drop("n")
    base = low.join(mid, ["g", "k3", "k2"]).join(top, ["g", "k3"]).select("g", "k1", (F.col("b1") + F.col("b2") + F.col("b3")).alias("base"))
    inside = running(marked.drop("k2", "k3"), ["g", "k1"], "w", "b0")
    return inside.join(base, ["g", "k1"]).select("g", "w", "bits", "n", (F.col("base") + F.col("b0")).alias("before"))


def _shared_ids(rows: DataFrame, words: DataFrame) -> DataFrame:
    """g, id, m of the ids that more than one row has; a null id always counts."""
    crowded = words.where("n <> bit_count(bits)").select("g", "w")
    twice = (rows.where("id IS NOT NULL").withColumn("w", F.shiftright("id", 6)).join(crowded, ["g", "w"], "left_semi")
             .groupBy("g", "id").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    return twice.unionByName(rows.where("id IS NULL").groupBy("g", "id").agg(F.count(F.lit(1)).alias("m")))


def _ordinals(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``shared`` ids with ``ordinal``, their place among the rows of the
    id by digest.  Equal leaves are counted, numbered and written out again."""
    same = (rows.alias("r").join(shared.alias("s"), F.col("r.g").eqNullSafe(F.col("s.g")) & F.col("r.id").eqNullSafe(F.col("s.id")), "left_semi")
            .groupBy("g", "id", "digest").agg(F.first("other").alias("other"), F.count(F.lit(1)).alias("c"))
            .withColumn("p", F.substring("digest", 1, 2)))
    before = Window.partitionBy("g", "id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)     # <= 2**16 rows
    inside = Window.partitionBy("g", "id", "p").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = same.groupBy("g", "id", "p").agg(F.sum("c").alias("c")).select(
        "g", "id", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")).alias("b")
    same = same.withColumn("place", F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("a")
    placed = same.join(prefixes, (F.col("a.g") == F.col("b.g")) & F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.p") == F.col("b.p"))).select(
        "a.g", "a.id", "digest", "other", "c", (F.col("base") + F.col("place")).alias("first"))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPIES)))).repartition("g", "digest", "block")
    low = F.col("block") * COPIES
    copies = F.explode(F.sequence(low, F.least(F.col("c"), low + COPIES) - 1))
    return blocks.withColumn("copy", copies).select("g", "id", "digest", "other", (F.col("first") + F.col("copy")).alias("ordinal"))


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, digest, other: a written table) with ``pos``, the place in the
    group, and ``n``, the group's number of leaves."""
    bit = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    below = F.expr("~shiftleft(-1L, CAST(id & 63 AS INT))")
    words = rows.where("id IS NOT NULL").groupBy("g", F.shiftright("id", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(id & 63 AS INT)))").alias("bits"), F.count(F.lit(1)).alias("n"))
    words = shared_table(words, "words")
    directory = shared_table(_directory(words), "directory")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"))

    def ranked(df: DataFrame, entries: DataFrame) -> DataFrame:
        at = entries.select("g", "w", "bits", "before")
        return df.withColumn("w", F.shiftright("id", 6)).join(at, ["g", "w"]).withColumn(
            "rank", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below))).drop("w", "bits", "before")

    shared = shared_table(_shared_ids(rows, words), "shared-ids")
    if shared.isEmpty():
        out = ranked(rows, directory)
        return out.join(sizes, "g").select("g", "id", "digest", "other", "n", F.col("rank").alias("pos"))

    # rows beyond the first of an id: the popcount misses them, each bit adds its own
    more = shared.where("id IS NOT NULL").select("g", F.shiftright("id", 6).alias("w"), bit.alias("b"), (F.col("m") - 1).alias("more"))
    extras = more.groupBy("g", "w").agg(F.collect_list(F.struct("b", "more")).alias("extras"))           # <= 64 entries
    ids = shared.select("g", "id")
    single = rows.alias("r").join(ids.alias("s"), F.col("r.g").eqNullSafe(F.col("s.g")) & F.col("r.id").eqNullSafe(F.col("s.id")), "left_anti")
    both = single.withColumn("ordinal", F.lit(0).cast("long")).unionByName(_ordinals(rows, ids))
    known = ranked(both.where("id IS NOT NULL"), directory).withColumn("w", F.shiftright("id", 6)).join(extras, ["g", "w"], "left")
    lower = F.aggregate(F.filter(F.coalesce("extras", F.array().cast("array<struct<b:int,more:bigint>>")), lambda x: x["b"] < bit),
                        F.lit(0).cast("long"), lambda a, x: a + x["more"])
    known = known.select("g", "id", "digest", "other", (F.col("rank") + lower + F.col("ordinal")).alias("at"))
    nulls = both.where("id IS NULL").select("g", "id", "digest", "other", F.col("ordinal").alias("at"))
    out = known.withColumn("skip", F.lit(True)).unionByName(nulls.withColumn("skip", F.lit(False))).join(sizes, "g")
    return out.select("g", "id", "digest", "other", "n", (F.col("at") + F.when(F.col("skip"), F.col("nulls")).otherwise(0)).alias("pos"))


# --- levels ------------------------------------------------------------------------

def depth(n: int, levels: int) -> int:
    """Levels over ``n`` nodes, ``levels`` at most (what one chunk reduces)."""
    d = 0
    while d < levels and FANOUT ** d < n:
        d += 1
    return d


def _slots(table: pa.Table, chunk: int, n: int, levels: int) -> list[bytes]:
    """The chunk's digests as hexadecimal text, each in the slot of its coordinate."""
    size = FANOUT ** levels
    slots: list[bytes | None] = [None] * min(size, n - chunk * size)
    for pos, d in zip(table.column("pos").to_pylist(), table.column("digest").to_pylist(), strict=True):
        slots[pos - chunk * size] = d.hex().encode()
    if None in slots or table.num_rows != len(slots):
        raise ValueError("coordinates do not fill the chunk")
    return slots


def _levels(digests: list[bytes], d: int) -> list[list[bytes]]:
    out = [digests]
    for _ in range(d):
        nodes = out[-1]
        out.append([sha256(b"".join(nodes[i:i + FANOUT])).hexdigest().encode() for i in range(0, len(nodes), FANOUT)])
    return out


def _sides(levels: list[list[bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """For each level below the top, each node's siblings left and right of it."""
    return [[(b"".join(x[i - i % FANOUT:i]), b"".join(x[i + 1:i - i % FANOUT + FANOUT])) for i in range(len(x))] for x in levels[:-1]]


def _chunk_of(levels: int) -> Column:
    return F.expr(f"pos DIV {FANOUT ** levels}").alias("chunk")


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes (g, n, pos, digest) ``levels`` levels further up."""
    def reduce(table: pa.Table) -> pa.Table:
        g, n, chunk = (table.column(c)[0].as_py() for c in ("g", "n", "chunk"))
        top = _levels(_slots(table, chunk, n, levels), depth(n, levels))[-1]
        return pa.table({"g": pa.array([g], pa.string()), "n": pa.array([-(-n // FANOUT ** levels)], pa.int64()), "pos": pa.array([chunk], pa.int64()),
                         "digest": pa.array([bytes.fromhex(top[0].decode())], pa.binary())})

    workers_import(nodes.sparkSession)
    return nodes.select("g", "n", "pos", "digest", _chunk_of(levels)).groupBy("g", "chunk").applyInArrow(reduce, NODE)


def _tower(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Written tables of nodes, from ``nodes`` up to one node a group."""
    tower = [nodes]
    while (tower[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tower.append(shared_table(_reduced(tower[-1], levels), "nodes"))
    return tower


def _down(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Paths of ``nodes`` from the paths of the chunks' tops."""
    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        g, n, chunk = (left.column(c)[0].as_py() for c in ("g", "n", "chunk"))
        up = {c: right.column(c)[0].as_py() for c in ("lefts", "rights", "subroot", "root")}
        size = left.num_rows
        sides = _sides(_levels(_slots(left, chunk, n, levels), depth(n, levels)))
        own = [[s[i // FANOUT ** k] for k, s in enumerate(sides)] for i in range(size)]
        return pa.table({"g": pa.array([g] * size, pa.string()), "pos": pa.array([chunk * FANOUT ** levels + i for i in range(size)], pa.int64()),
                         "lefts": pa.array([[x[0].decode() for x in o] + up["lefts"] for o in own], pa.list_(pa.string())),
                         "rights": pa.array([[x[1].decode() for x in o] + up["rights"] for o in own], pa.list_(pa.string())),
                         "subroot": pa.array([up["subroot"]] * size, pa.string()), "root": pa.array([up["root"]] * size, pa.string())})

    return _joined(nodes, paths, ["digest"], extend, PATH, levels)


def _joined(nodes: DataFrame, paths: DataFrame, digests: list[str], run, schema: str, levels: int) -> DataFrame:
    workers_import(nodes.sparkSession)
    left = nodes.select("g", "n", "pos", *[c for c in nodes.columns if c in ("id", *digests)], _chunk_of(levels))
    right = paths.withColumnRenamed("pos", "chunk")
    return left.groupBy("g", "chunk").cogroup(right.groupBy("g", "chunk")).applyInArrow(run, schema)


def _proofs(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The proof of every leaf and the root folded from its ``other`` digest (its own
    where that is null)."""
    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        n, chunk = (left.column(c)[0].as_py() for c in ("n", "chunk"))
        up = list(zip(*(map(str.encode, right.column(c)[0].as_py()) for c in ("lefts", "rights")), strict=True))
        rest = b"".join(a + b for a, b in up)
        slots = _slots(left, chunk, n, levels)
        sides = _sides(_levels(slots, depth(n, levels)))
        proof, folded = [], []
        for pos, other in zip(left.column("pos").to_pylist(), left.column("other").to_pylist(), strict=True):
            i = pos - chunk * FANOUT ** levels
            own = [s[i // FANOUT ** k] for k, s in enumerate(sides)]
            proof.append(sha256(b"".join(a + b for a, b in own) + rest).hexdigest())
            node = slots[i] if other is None else other.hex().encode()
            for a, b in (*own, *up):
                node = sha256(a + node + b).hexdigest().encode()
            folded.append(node.decode())
        size = left.num_rows
        return pa.table({"id": left.column("id"), "g": left.column("g"), "pos": left.column("pos"), "digest": left.column("digest"),
                         "subroot": pa.array([right.column("subroot")[0].as_py()] * size, pa.string()),
                         "root": pa.array([right.column("root")[0].as_py()] * size, pa.string()),
                         "proof": pa.array(proof, pa.string()), "folded": pa.array(folded, pa.string())})

    return _joined(nodes, paths, ["digest", "other"], prove, PROOF, levels)


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """id, g, pos, digest, subroot, root, proof, folded of every leaf of ``rows``
    (see ``leaves``)."""
    spark = rows.sparkSession
    rows = shared_table(rows, "leaf-digests")
    if rows.isEmpty():
        return spark.createDataFrame([], PROOF)
    placed = shared_table(coordinates(rows), "leaf-nodes")
    discard(rows)
    tower = _tower(placed, levels)
    order = F.row_number().over(Window.orderBy("g")) - 1                    # one row a group
    groups = tower[-1].select("g", "digest", order.cast("long").alias("pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    groups = shared_table(groups.select(F.col("g").alias("group"), F.lit("").alias("g"), "n", "pos", "digest"), "subroots")
    over = _tower(groups.select("g", "n", "pos", "digest"), levels)
    none = F.array().cast("array<string>")
    hexed = F.lower(F.hex("digest"))
    paths = over[-1].select("g", "pos", none.alias("lefts"), none.alias("rights"), hexed.alias("subroot"), hexed.alias("root"))
    for nodes in reversed(over[:-1]):
        paths = _down(nodes, paths, levels)
    # the top of each group's own tree: position 0 of its group
    paths = shared_table(groups.join(paths.drop("g", "subroot"), "pos").select(
        F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", hexed.alias("subroot"), "root"), "subroot-paths")
    for nodes in reversed(tower[1:-1]):
        paths = _down(nodes, paths, levels)
    return _proofs(placed, paths, levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    docs = documents(spark, sf_dir, *FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = manifest(leaves(docs, tampered={"text": F.translate("text", upper, lower)}, where=where))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root",
                      F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))
