"""Queries that once returned a slice return the rows of whole tables and whole texts, under both of their names."""

from vigil import catalog

from .conftest import SF


def test_diff_file_carry(spark):
    got = catalog.queries()["diff_file_carry_whole"](spark, SF)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").count()


def test_stride_class(spark):
    one, two = ({r.doc_id: r["class"] for r in catalog.queries()[n](spark, SF).collect()} for n in ("stride_class", "stride_class_whole"))
    assert one == two and len(one) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_rows_left_out(spark, tmp_path):
    text = "several requirement words shared between documents"
    spark.createDataFrame([(i, text) for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalog.queries()
    for name, left_out, sf in (("section_carry", "line_number % 3 <> 0", SF), ("interval_join_jobs", "job % 50 <> 1", SF), ("requirement_coverage", "item_id >= 40", tmp_path)):
        part, whole = q[name](spark, sf), q[f"{name}_whole"](spark, sf)
        assert part.where(left_out).count() > 0 and whole.exceptAll(part).isEmpty() and part.exceptAll(whole).isEmpty()
