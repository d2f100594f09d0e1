import pytest

from kmerloom.streaming.score import score_stream
from test_similarity import random_dna


def test_stream_scores_each_read(spark, tmp_path):
    schema = "read_id bigint, sequence string"
    spark.createDataFrame([(k, random_dna(k, 125)) for k in range(6)], schema).write.parquet(f"{tmp_path}/in")
    refs = spark.createDataFrame([("r", random_dna(2, 125))], "ref_id string, sequence string")
    query = score_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), refs).writeStream.format("memory").queryName("scores").start()
    query.processAllAvailable()
    query.stop()
    best = spark.sql("SELECT read_id, score FROM scores ORDER BY score DESC").collect()
    assert len(best) == 6 and best[0].read_id == 2 and best[0].score > 0.999


def test_a_large_reference_set_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, "ACGT")], "read_id bigint, sequence string").write.parquet(f"{tmp_path}/in")
    reads = spark.readStream.schema("read_id bigint, sequence string").parquet(f"{tmp_path}/in")
    refs = spark.createDataFrame([("r", "ACGT"), ("s", "ACGT")], "ref_id string, sequence string")
    with pytest.raises(ValueError, match="too many"):
        score_stream(reads, refs, most_broadcast=1)
