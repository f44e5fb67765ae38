"""Streams over a table that is one file, or a folder with files in it."""

import os

import pytest

from epiflux.plans import load_all


@pytest.mark.parametrize("name", ["stream_keyword_filter", "stream_disease_filter", "stream_append"])
def test_a_folder_of_files_streams_like_one_file(spark, folder, tmp_path, name):
    documents = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    documents.repartition(3, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    one, several = (load_all()[0][name](spark, str(place)).collect() for place in (folder, tmp_path))
    assert one and sorted(map(repr, several)) == sorted(map(repr, one))
