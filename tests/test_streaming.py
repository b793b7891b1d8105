"""State carries over triggers: sentences of fragments equal those of whole texts."""

from clausemill.kernel import Rules
from clausemill.operators import segment
from clausemill.streaming.split import split_batches, split_stream

TEXTS = {"a": "Dr. Smith (of Inc. fame. Yes) left... He said \"Go. Now.\" to 😀 us. And then? The end", "b": "Short. Even shorter! End.", "c": "(open. never closed. at all. " * 3}
SCHEMA = "stream_key string, seq long, fragment string, is_last boolean"


def fragments(size):
    return [(k, i, t[i * size : (i + 1) * size], (i + 1) * size >= len(t)) for k, t in TEXTS.items() for i in range((len(t) + size - 1) // size)]


def want():
    return sorted((k, i, s) for k, t in TEXTS.items() for i, (_, _, s) in enumerate(Rules.of("en").slices(t)))


def test_triggers_do_not_matter(spark, tmp_path):
    rows = fragments(11)
    for n, turn in enumerate(sorted({r[1] for r in rows})):
        spark.createDataFrame([r for r in rows if r[1] == turn], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = split_stream(stream).writeStream.format("memory").queryName("cut").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) > 2
    assert sorted(map(tuple, spark.table("cut").collect())) == want()


def test_batches(spark):
    df = spark.createDataFrame(fragments(7), SCHEMA).repartition(5)
    assert sorted(map(tuple, split_batches(df).collect())) == want()


def test_whole_texts_of_a_stream(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "stream_key string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("stream_key string, text string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = segment.sentences(stream, ["stream_key"]).writeStream.format("memory").queryName("whole").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["stream_key"], r["idx"], r["text"]) for r in spark.table("whole").collect()) == want()
