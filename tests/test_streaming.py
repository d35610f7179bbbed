from pyspark.sql import functions as F

from kgweave.streaming import supports


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 0{k % 10}:00:00", k % 5, "abc"[k % 3]) for k in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(4).write.parquet(f"{tmp_path}/events")
    facts = supports.event_facts(spark, f"{tmp_path}/events", events.schema, maxFilesPerTrigger=2)
    got = {(r["start"], r["n"]) for r in drained(supports.relation_counts(facts), "counts").collect()}
    want = {(r["start"], r["n"]) for r in events.groupBy(F.window("ts", "1 day").start.alias("start")).agg(F.count("*").alias("n")).collect()}
    assert got == want
    rules = spark.createDataFrame([(1, "did", "e:a"), (2, "did", "e:z")], "rule_id long, body_rel string, body_const string")
    hits = drained(supports.rule_hits(facts, rules), "hits").agg(F.sum("n")).first()[0]
    assert hits == sum(r[3] == "a" for r in rows)
