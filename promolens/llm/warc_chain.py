"""Operator 9: WARC writing, and reading with boundary-chain verification.

Writing: one record a page, by Spark's text sink with the record end
(CR LF CR LF) as line separator, so task commits, retries and lost executors
are Spark's business and the store can be any that Spark writes to.  Of records
with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the largest
page id carries the payload (response); the others refer to it (revisit).

Reading: Spark's text source cuts the archives at every ``WARC/1.0`` CR LF, in
parallel splits of any size.  The cuts are only candidates, since payloads may
hold the same bytes.

1. Each task parses the header after its cuts; a candidate at byte ``o`` whose
   header parses has a successor ``o + its length``.  Offsets are exact: a cut's
   offset is the sum of the lengths before it, by split, in file order.
2. Candidates whose successor is the very next cut need no jump.  Runs of such
   candidates are folded; between runs pointer jumping doubles the links until
   each run that starts at byte 0 or is linked from there is marked.
3. Candidates that are not reached lie inside payloads: their bytes belong to
   the last reached record before them, which is put together again.

A chain that ends anywhere but at the file's end makes the read fail, so
nothing is lost silently.

Defined results: a null payload is an empty one, a null url leaves the header
out; a repeated page id writes one record a row (of rows tied for the largest
id those with the least url are responses); a null page id has no id header and
reads back as null; extra columns are not written.  Payloads must be UTF-8
text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.llm.common import arrow_map, shared_table, small_side, table
from promolens.session import scratch_path

MIN_REVISIT = 1000
MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"


def _header(name: str, value: Column) -> Column:
    """A header line, left out when ``value`` is null (line ends in it are encoded)."""
    value = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> None:
    """Write a WARC record for each row of ``pages`` under ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    long = base.where(F.col("bytes") >= min_revisit)
    copies = long.groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = shared_table(copies, "copies")
    # rows tied for the largest id: exactly one of them is the response
    ties = long.join(copies, "digest").where(F.col("id").eqNullSafe(F.col("keeper"))).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce("url", F.lit(""))).alias("first_url")).where("n > 1").select("digest", "first_url")
    ties = shared_table(ties, "ties")
    df = base.join(copies.select("digest", "keeper", "copies"), "digest", "left").join(ties, "digest", "left")
    tied = F.col("id").eqNullSafe(F.col("keeper")) & (F.col("first_url").isNull() | (F.coalesce("url", F.lit("")) == F.col("first_url")))
    revisit = F.col("copies").isNotNull() & (F.col("bytes") >= min_revisit) & ~tied
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _header("WARC-Record-ID", urn(F.col("id"))), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, urn(F.col("keeper")))),
        _header("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)
    df.select(record.alias("value")).write.option("lineSep", END).text(path)


_PARTS = ("file string, block long, seq long, size long, kind string, id long, refers long, digest string, declared long, "
          "length long, payload long, sha1 string, raw string")


def _parse(text: str) -> tuple[dict[str, str], int] | None:
    """Headers and their byte length, or None."""
    end = text.find(END)
    if end < 0:
        return None
    head = {}
    for line in text[:end].split("\r\n"):
        name, colon, value = line.partition(": ")
        if not colon:
            return None
        head[name] = value
    if not head.get("Content-Length", "").isdigit() or "WARC-Type" not in head:
        return None
    return head, len(text[:end].encode()) + len(END)


def _page(urn: str | None) -> int | None:
    x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdigit() else None


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each cut: where it stands, how long it is, and its header.
    ``length`` is the record's whole length; a cut that does not hold exactly one
    record keeps its text in ``raw``."""
    names = [x.split()[0] for x in _PARTS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in _PARTS.split(", ")]
    seq: dict[tuple, int] = {}
    for batch in batches:
        rows = []
        for file, block, text in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist(), strict=True):
            n = seq[file, block] = seq.get((file, block), -1) + 1
            data = text.encode()
            row = dict.fromkeys(names) | {"file": file, "block": block, "seq": n, "size": len(data) + len(MAGIC)}
            parsed = _parse(text)
            if parsed:
                head, start = parsed
                body = int(head["Content-Length"])
                row |= {"kind": head["WARC-Type"], "id": _page(head.get("WARC-Record-ID")), "refers": _page(head.get("WARC-Refers-To")),
                        "digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), "declared": int(head.get("X-Payload-Length", body)),
                        "length": len(MAGIC) + start + body + len(END), "payload": start}
            if parsed and row["length"] == row["size"]:
                row["sha1"] = hashlib.sha1(data[start:start + body]).hexdigest()
            else:
                row["raw"] = text
            rows.append(row)
        for a in range(0, len(rows), 512):
            part = rows[a:a + 512]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in zip(names, kinds, strict=True)], names=names)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the cuts with the numbers that ``_cuts`` gives them."""
    seq: dict[tuple, int] = {}
    for batch in batches:
        numbers = []
        for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            seq[key] = seq.get(key, -1) + 1
            numbers.append(seq[key])
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(numbers, pa.int64()), batch.column("value")],
                                         names=["file", "block", "seq", "raw"])


def _reachable(cuts: DataFrame) -> DataFrame:
    """file, at of the candidates reached from each file's start.

    ``cuts``: file, at, next (null without a header), follows (at of the cut after
    it).  A run is a maximal row of candidates each of which ends where the next
    cut begins; the links between runs are jumped over by doubling."""
    order = Window.partitionBy("file").orderBy("at")
    linked = F.lag("next").over(order) == F.col("at")
    marked = cuts.withColumn("head", F.when(F.coalesce(linked, F.lit(False)), None).otherwise(F.col("at")))
    runs = shared_table(marked.withColumn("run", F.last("head", True).over(order)).select("file", "at", "next", "run"), "runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("next", "at").alias("next"))
    # the run that a run's last candidate leads to, and the candidate in it
    link = ends.join(runs.select("file", F.col("at").alias("next"), F.col("run").alias("to")), ["file", "next"], "left").select("file", "run", "to", "next")
    reached = shared_table(ends.where("run = 0").select("file", "run", F.col("run").alias("entry")), "reached")
    jump = shared_table(link.where("to IS NOT NULL").select("file", "run", "to", F.col("next").alias("entry")), "jump")
    while jump.limit(1).count():
        more = reached.join(jump.select("file", "run", "to", F.col("entry").alias("e")), ["file", "run"]).select("file", F.col("to").alias("run"), F.col("e").alias("entry"))
        grown = shared_table(reached.union(more).groupBy("file", "run").agg(F.min("entry").alias("entry")), "reached")
        # doubling: from a run over two links
        second = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = shared_table(jump.join(second, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "jump")
        reached = grown
    return runs.join(reached, ["file", "run"]).where("at >= entry").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and whether
    the payload's digest was checked, of every record under ``path``."""
    text = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    cuts = shared_table(arrow_map(text, _cuts, _PARTS), "cuts")
    # offsets: sizes of the splits before, then of the cuts before in the split.  The text before
    # the first magic is empty and stands for the magic itself, so a cut's record starts len(MAGIC) before its end of separator
    blocks = cuts.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = blocks.withColumn("base", F.coalesce(F.sum("size").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    narrow = cuts.select("file", "block", "seq", "size", "length").withColumn("inside", inside).join(before, ["file", "block"])
    narrow = narrow.withColumn("at", F.col("base") + F.col("inside") - len(MAGIC)).where("at >= 0")
    narrow = shared_table(narrow.withColumn("next", F.col("at") + F.col("length")).select("file", "block", "seq", "at", "size", "next"), "offsets")
    true = _reachable(narrow.select("file", "at", "next"))
    order = Window.partitionBy("file").orderBy("at")
    chain = narrow.join(true, ["file", "at"]).withColumn("after", F.lead("at").over(order)).select("file", "at", "after")
    flagged = narrow.withColumn("end", F.max(F.col("at") + F.col("size")).over(Window.partitionBy("file"))).join(
        chain.withColumn("true", F.lit(True)), ["file", "at"], "left")
    owner = F.last(F.when(F.col("true"), F.col("at")), True).over(order)
    # every reached record ends where the next one or the end of the file is
    sound = F.coalesce(F.col("next") == F.coalesce("after", "end"), F.lit(False))
    owned = shared_table(flagged.withColumn("owner", owner).withColumn("sound", sound).select(
        "file", "block", "seq", "at", "owner", "sound"), "owned")
    rows = cuts.join(owned, ["file", "block", "seq"])
    # a cut without any record before it, or a broken record, goes on as well and fails below
    broken = F.col("owner").isNull() | ((F.col("at") == F.col("owner")) & ~F.col("sound"))
    rows = rows.withColumn("kind", F.when(~broken, F.col("kind"))).withColumn("sha1", F.when(broken, F.lit("")).otherwise(F.col("sha1")))
    whole = rows.where((F.col("at") == F.coalesce("owner", "at")) & F.col("sha1").isNotNull())
    # records with a magic inside the payload: their cuts, in order, are the record again
    pieces = rows.where(F.col("raw").isNotNull()).select("file", "owner", "at", "raw")
    # a whole record that stands in a payload: its text was not kept and is read again
    inner = shared_table(rows.where((F.col("at") != F.col("owner")) & F.col("raw").isNull()).select("file", "block", "seq", "at", "owner"), "inner")
    if inner.limit(1).count():
        again = arrow_map(text, _numbered, "file string, block long, seq long, raw string").join(small_side(inner), ["file", "block", "seq"])
        pieces = pieces.union(again.select("file", "owner", "at", "raw"))
    pieces = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("p"))
    heads = rows.where((F.col("at") == F.col("owner")) & F.col("sha1").isNull()).drop("owner")
    torn = heads.join(pieces.withColumnRenamed("owner", "at"), ["file", "at"])
    full = F.array_join(F.transform("p", lambda x: x["raw"]), MAGIC).cast("binary")
    body = F.col("length") - F.lit(len(MAGIC) + len(END)) - F.col("payload")
    torn = torn.withColumn("sha1", F.sha1(F.substring(full, F.col("payload").cast("int") + 1, body.cast("int"))))
    columns = ["id", "kind", "refers", "digest", "declared", "sha1"]
    records = whole.select(columns).union(torn.select(columns))
    good = F.coalesce((F.col("kind") == "revisit") | (F.col("sha1") == F.col("digest")), F.lit(False))
    return records.select(F.col("id").alias("page_id"), F.col("declared").alias("payload_bytes"),
                          F.when(good & F.col("kind").isNotNull(), F.col("digest")).otherwise(F.raise_error(
                              F.lit("an archive has a broken chain, or a payload without its digest"))).alias("payload_digest"),
                          F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def op9_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as archives, read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
k AS (SELECT html, MAX(page_id) AS keeper, COUNT(*) AS n FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN strlen(p.html) >= 1000 AND k.n > 1 AND p.page_id <> k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.html) >= 1000 AND k.n > 1 AND p.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM p JOIN k USING (html)
"""
