"""WARC records and a Merkle fixity audit of replicas.

Records: a web page becomes a WARC/1.1 ``resource`` record (header lines, blank line, block, two line ends);
records are laid out in files of ``FILE_RECORDS`` record numbers each, in record order, at their byte offsets.

Audit: a leaf is SHA-256 over the record's length and the SHA-256 of its bytes.  Leaves stand at slots given by
the record number; a node stands for the offset range of its ``FANOUT`` slots.  It hashes its children in the order
of their stored offsets: slot, gap to the child before, digest.  No absolute offset is hashed, so a lost
or shortened record changes only its own branch, not all that follow; records in another order or with gaps between
them change every node above them.  Offsets are those of the column ``offset`` where a replica brings them, else
records stand one after the other in the order of their slots.
Replica roots are compared first and each level joins only the children of mismatching nodes, down to
the record numbers that differ; the records of those are then compared digest by digest.

Different records of one number are all kept: the n-th of them (by hash) stands in part n of the file, so a
file part holds at most one record a slot, however many one number has.

All steps are DataFrame functions; a node gathers at most FANOUT digests, a file part FILE_RECORDS lengths.  The levels of
a tree are kept, not rebuilt at each comparison.

Defined cases: null url or html is an empty string; rows with a null number take no part; rows equal in number, url
and html are one record; a file that only one replica has is reported record by record as ``missing`` or ``extra``; where
both replicas hold records of a number that the other lacks, ours are ``corrupt`` and theirs are not listed; an
undamaged record of a file whose roots differ is ``moved`` if its place among the records that both hold differs (gaps
alone show in ``file_intact``); empty replicas give no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import checkpoint

FILE_RECORDS, FANOUT = 4096, 16


def record_bytes(url: Column, block: Column, number: Column) -> Column:
    """One WARC/1.1 record as binary."""
    block = F.coalesce(block.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), number.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(block, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), block, F.lit(b"\r\n\r\n"))


def warc_records(pages: DataFrame, number: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(file, number, slot, record): the records of all pages."""
    rows = pages.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("number"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.select(F.floor(F.col("number") / FILE_RECORDS).cast("long").alias("file"), "number",
                       F.pmod("number", F.lit(FILE_RECORDS)).cast("int").alias("slot"),
                       record_bytes(F.col("url"), F.col("html"), F.col("number")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, part, number, slot, offset, length, digest): the leaf digests; records are hashed where they are read."""
    record = F.coalesce("record", F.lit(b""))
    stored = F.col("offset").cast("long") if "offset" in records.columns else F.lit(None).cast("long")
    hashed = records.select("file", "number", "slot", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha"), stored.alias("stored"))
    one = checkpoint(hashed.groupBy("file", "number", "slot", "length", "sha").agg(F.min("stored").alias("stored"))
                     .withColumn("head", F.substring("sha", 1, 3)))
    # the n-th record of a number: counted per head of the hash, so no number is sorted in one task
    counts = one.groupBy("number", "head").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("number").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.sum("n").over(earlier)).where("earlier > 0").drop("n")
    among = Window.partitionBy("number", "head").orderBy("sha", "length")
    nth = one.withColumn("nth", F.row_number().over(among) - 1).join(counts, ["number", "head"], "left")
    before = Window.partitionBy("file", "part").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (nth.withColumn("part", F.col("nth") + F.coalesce("earlier", F.lit(0)))
            .withColumn("laid", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .select("file", "part", "number", "slot", F.coalesce("stored", "laid").alias("offset"), "length",
                    F.sha2(F.concat_ws(":", "length", "sha"), 256).alias("digest")))


def tree(level0: DataFrame) -> list[DataFrame]:
    """Levels of (file, part, slot, digest, low, high) from the leaves to the roots (one slot a file part)."""
    levels, width = [level0.select("file", "part", "slot", "digest", F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"))], FILE_RECORDS
    while width > 1:
        width = -(-width // FANOUT)
        below = levels[-1].groupBy("file", "part", F.floor(F.col("slot") / FANOUT).cast("int").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("low", (F.col("slot") % FANOUT).alias("s"), "high", "digest"))).alias("d"),
            F.min("low").alias("low"), F.max("high").alias("high"))
        child = F.transform("d", lambda x, i: F.concat_ws(":", x["s"], x["low"] - F.coalesce(F.get("d", i - 1)["high"], x["low"]), x["digest"]))
        levels.append(checkpoint(below.select("file", "part", F.col("up").alias("slot"), F.sha2(F.array_join(child, ";"), 256).alias("digest"), "low", "high")))
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, faults) of two replicas' leaves.

    roots: (file, part, ours, theirs, intact); faults: (file, part, slot, digest, kind) of the records that differ, kind
    ``corrupt``, ``missing`` (only in ours), ``extra`` (only in theirs) or ``moved``.
    """
    def both_sides(x, y):
        return x.withColumn("own", F.lit(True)).unionByName(y.withColumn("own", F.lit(False)))

    def compared(nodes):
        return nodes.groupBy("file", "part", "slot").agg(F.max(F.when(F.col("own"), F.col("digest"))).alias("ours"),
                                                         F.max(F.when(~F.col("own"), F.col("digest"))).alias("theirs"))

    levels = [both_sides(x, y) for x, y in zip(reversed(tree(ours)), reversed(tree(theirs)))]
    roots = checkpoint(compared(levels[0]).select("file", "part", "ours", "theirs", F.col("ours").eqNullSafe(F.col("theirs")).alias("intact")))
    broken = roots.where(~F.col("intact")).select("file", "part")
    bad = broken.withColumn("slot", F.lit(0))
    for nodes in levels[1:]:  # the mismatching nodes stand once in each plan, so it grows by one join a level
        up = bad.select("file", "part", F.col("slot").alias("up"))
        inside = nodes.withColumn("up", F.floor(F.col("slot") / FANOUT).cast("int")).join(up, ["file", "part", "up"], "left_semi")
        bad = compared(inside).where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "part", "slot")

    # a lost record shifts the parts of the number's others, so the records of a number are matched by digest
    key = ["file", "slot", "digest"]
    leaf = [d.select(*key, "part") for d in (ours, theirs)]
    lone = checkpoint(both_sides(*leaf).join(bad.select("file", "slot").distinct(), ["file", "slot"], "left_semi")
                      .groupBy(*key).agg(F.max("part").alias("part"), F.max("own").alias("own"), F.min("own").alias("all"))
                      .where("own = all").drop("all"))
    sides = lone.groupBy("file", "slot").agg(F.count_if("own").alias("mine"), F.count_if(~F.col("own")).alias("other"))
    kind = F.when(F.col("own"), F.when(F.col("other") > 0, "corrupt").otherwise("missing")).when(F.col("mine") == 0, "extra")
    faults = lone.join(sides, ["file", "slot"]).select("file", "part", "slot", "digest", kind.alias("kind")).where("kind IS NOT NULL")

    place = lambda c: F.row_number().over(Window.partitionBy("file", "part").orderBy(c, "slot"))
    both = ours.join(broken, ["file", "part"], "left_semi").select("file", "part", "slot", "digest", "offset").join(
        theirs.select("file", "part", "slot", "digest", F.col("offset").alias("there")), ["file", "part", "slot", "digest"])
    moved = both.withColumn("x", place("offset")).withColumn("y", place("there")).where("x <> y")
    return roots, faults.union(moved.select("file", "part", "slot", "digest", F.lit("moved")))


def damaged(records: DataFrame, every: int = 997) -> DataFrame:
    """A replica with known damage for audits: of each ``every`` record numbers, one has a byte changed in
    its block, one is cut short by a byte and one is lost."""
    r, n = F.col("record"), F.octet_length("record")
    state = F.pmod("number", F.lit(every))
    hurt = F.when(state == 0, F.concat(F.substring(r, F.lit(1), n - 5), F.lit(b"?"), F.substring(r, n - 3, F.lit(4)))) \
        .when(state == 1, F.substring(r, F.lit(1), n - 1)).otherwise(r)
    return records.where(state != 2).withColumn("record", hurt)


def audit_report(pages: DataFrame, replica, number: str = "page_id") -> DataFrame:
    """One row a record: (file, part, <number>, offset, length, digest, file_intact, fault); ``replica`` makes the
    other copy from the records, with a column ``offset`` if it has a layout of its own.  fault is null,
    ``corrupt``, ``missing``, ``extra`` or ``moved``."""
    records = warc_records(pages, number)
    ours = checkpoint(leaves(records))
    theirs = checkpoint(leaves(replica(records)))
    roots, faults = audit(ours, theirs)
    faults = checkpoint(faults)
    key = ["file", "part", "slot", "digest"]
    every = ours.join(faults.where("kind <> 'extra'"), key, "left").unionByName(theirs.join(faults.where("kind = 'extra'"), key))
    return every.join(roots.select("file", "part", "intact"), ["file", "part"]).select(
        "file", "part", F.col("number").alias(number), "offset", "length", "digest", F.col("intact").alias("file_intact"), F.col("kind").alias("fault"))
