"""Landed files packed into a table give what the files give."""

from pyspark.sql import functions as F

import __spark_entry__
from gistmill.plans import queries
from gistmill.sources import registry
from tests.test_landed import PAYLOADS, _land


def test_packed_files_are_read_as_landed_ones(spark, tmp_path):
    landed = _land(tmp_path / "files")
    for kind, (name, value, _) in PAYLOADS.items():
        registry.pack(spark.createDataFrame([(name, value)], "name string, value string"), str(tmp_path / "packs" / kind))
    rows = lambda df: sorted(map(str, df.drop("landed", "seq").withColumn("metadata", F.map_entries("metadata")).collect()))
    packs = [(kind, str(tmp_path / "packs" / kind)) for kind in PAYLOADS]
    assert rows(registry.collect(spark, packs, packed=True)) == rows(registry.collect(spark, landed)) != []


def test_landed_sources_write_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda _: f"file://{tmp_path}")
    assert __spark_entry__.queries()["landed_sources"](spark, "/root/testdata/sf0.001").where("query LIKE 'listing=%'").count() > 0
    assert 0 < len(list(tmp_path.glob("landed-*/*/*.parquet"))) <= 12 and not list(tmp_path.glob("landed-*/*/listing=*"))
