"""The split reader's query must not bring the whole table to one task that writes it."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_files_follow_the_splits_of_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(4, "doc_id").write.option("maxRecordsPerFile", 50).parquet(f"{tmp_path}/documents.parquet")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        found = entry.queries()["read_messages_split"](spark, str(tmp_path))
        assert len(found.inputFiles()) > 1
        assert found.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
