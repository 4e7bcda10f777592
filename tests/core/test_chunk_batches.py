from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunks


def test_files_are_cut_without_a_start_for_each(spark):
    e = spark.range(4000).select((F.col("id") % 2000).alias("file"), F.col("id").alias("pos"), F.lit("NarrativeText").alias("role"), F.format_string("A sentence with the number %d.", "id").alias("text"))
    out = chunks.chunk_records(e)
    assert "EvalPythonUDTF" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.file, r.chunk_index, r.text) for r in out.collect()} == {(i, 0, f"A sentence with the number {i}.\n\nA sentence with the number {i + 2000}.") for i in range(2000)}
