"""Streams over tables that are one file or a folder of part files."""

import shutil

import pytest

from meshlark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, table", [("stream_ingest", "pages"), ("stream_skip", "events")])
def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path, query, table):
    shutil.copy(f"{DATA}/{table}.parquet", tmp_path / f"copy-of-{table}.parquet")  # another table beside it
    spark.read.parquet(f"{DATA}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    rows = lambda folder: sorted(map(tuple, registry.queries()[query](spark, str(folder)).collect()), key=repr)
    assert rows(tmp_path) == rows(DATA) != []
