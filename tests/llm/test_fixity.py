"""Merkle audit: every damaged record is located, and only those."""

from pyspark.sql import functions as F

from mercata.llm import fixity


def pages(spark, n=300):
    return spark.range(n).select((F.col("id") * 37).alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"),
                                 F.repeat(F.concat(F.lit("<p>é"), "id"), 20).alias("html"), F.lit(0).alias("slot"))


def test_damage_is_located(spark):
    p = pages(spark)
    hurt = {37 * 5: "corrupt", 37 * 77: "missing", 37 * 200: "corrupt"}

    def replica(r):
        changed = F.when(F.col("number") == 37 * 5, F.concat("record", F.lit(b"x"))).when(
            F.col("number") == 37 * 200, F.concat(F.lit(b"V"), F.substring("record", 2, 1 << 20))).otherwise(F.col("record"))
        return r.where(F.col("number") != 37 * 77).withColumn("record", changed)

    rows = fixity.audit_report(p, replica).collect()
    assert len(rows) == 300
    assert {r.page_id: r.fault for r in rows if r.fault} == hurt
    bad = {r.file for r in rows if r.fault}
    assert all(r.file_intact == (r.file not in bad) for r in rows)
    for f in {r.file for r in rows}:  # offsets are the running lengths
        at = 0
        for r in sorted((r for r in rows if r.file == f), key=lambda r: r.page_id):
            assert r.offset == at
            at += r.length


def test_lost_and_extra_files_nulls_repeats_and_empty(spark):
    p = pages(spark, 10)
    odd = p.union(p.limit(2)).union(spark.createDataFrame([(None, "u", "h", 0), (9999, None, None, 0)], "page_id long, url string, html string, slot int"))
    rows = fixity.audit_report(odd, lambda r: r.where("number < 9999")).collect()
    assert len(rows) == 11
    assert [r.page_id for r in rows if r.fault == "missing"] == [9999]
    extra = fixity.audit_report(p, lambda r: r.union(fixity.warc_records(p.select((F.col("page_id") + 100000).alias("page_id"), "url", "html")))).collect()
    assert sum(r.fault == "extra" for r in extra) == 10 and len(extra) == 20
    assert fixity.audit_report(p.limit(0), lambda r: r).count() == 0


def test_two_pages_of_one_number_are_both_audited(spark):
    p = pages(spark, 40).union(spark.createDataFrame([(37 * 3, "other", "<p>two", 0), (37 * 3, "third", None, 0)], "page_id long, url string, html string, slot int"))
    assert fixity.audit_report(p, lambda r: r).where("fault IS NOT NULL OR NOT file_intact").count() == 0
    whole = {r.digest for r in fixity.audit_report(p, lambda r: r).where("page_id = 111").collect()}
    assert len(whole) == 3
    found = set()
    for url in ("http://x/3", "other", "third"):
        gone = fixity.audit_report(p, lambda r: r.where(~F.decode("record", "utf-8").contains(f"Target-URI: {url}\r")))
        faults = gone.where("fault IS NOT NULL").collect()
        assert [(r.page_id, r.fault) for r in faults] == [(111, "missing")]
        found.add(faults[0].digest)
    assert found == whole


def test_order_and_gaps_of_a_stored_layout(spark):
    p = pages(spark, 60)
    laid = fixity.leaves(fixity.warc_records(p)).select("number", "offset")
    same = fixity.audit_report(p, lambda r: r.join(laid, "number"))
    assert same.where("fault IS NOT NULL OR NOT file_intact").count() == 0
    at = {r.number: r.offset for r in laid.collect()}
    for a, b in ((37 * 4, 37 * 5), (37 * 2, 37 * 50)):  # in one node, and far apart
        swap = F.when(F.col("number") == a, at[b]).when(F.col("number") == b, at[a]).otherwise(F.col("offset"))
        rows = fixity.audit_report(p, lambda r: r.join(laid, "number").withColumn("offset", swap)).where("fault IS NOT NULL").collect()
        assert {(r.page_id, r.fault) for r in rows} == {(a, "moved"), (b, "moved")}
    gap = F.when(F.col("number") > 37 * 30, F.col("offset") + 7).otherwise(F.col("offset"))
    rows = fixity.audit_report(p, lambda r: r.join(laid, "number").withColumn("offset", gap)).collect()
    assert {r.fault for r in rows} == {None} and not any(r.file_intact for r in rows)


def test_one_number_with_many_records_and_a_very_long_page(spark):
    many = spark.range(3000).select(F.lit(5).alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("x").alias("html"))
    long = spark.range(1).select(F.lit(6).alias("page_id"), F.lit("long").alias("url"), F.repeat(F.lit("é<p>"), 1_000_000).alias("html"))
    rows = fixity.audit_report(many.union(long), lambda r: r.where(~F.decode("record", "utf-8").contains("Target-URI: u77\r"))).collect()
    assert len(rows) == 3001 and [(r.page_id, r.fault) for r in rows if r.fault] == [(5, "missing")]
    assert sorted(r.part for r in rows if r.page_id == 5) == list(range(3000))
    assert max(r.length for r in rows) > 5_000_000
