from pyspark.sql import functions as F

from tessera import catalog
from tessera.plans import lineage


def test_stream_covers_all_sources_and_tokens(spark, sf_dir):
    s, windows = lineage.stream(spark, sf_dir)
    at = lineage.sized(spark, sf_dir).where("n_tokens > 0")
    assert windows == at.agg(F.sum(F.col("n_tokens") + 1)).first()[0] // (lineage.SEQ + 1)
    got = catalog.queries()["stream_spans"](spark, sf_dir).cache()
    assert {r.source for r in got.select("source").distinct().collect()} == {r.source for r in at.select("source").distinct().collect()}
    assert got.agg(F.countDistinct("global_window")).first()[0] == windows
    assert windows > 40
    forty = s.spans(40)
    assert sorted(map(tuple, forty.collect())) == sorted(map(tuple, got.where("global_window < 40").collect()))
