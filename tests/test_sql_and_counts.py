"""Functions inside SQL against the operators, and counts that come with a write."""

import pytest
from pyspark.sql import functions as F

from fadegraph.functions import scoring, sql, vectors
from fadegraph.operators import graph, updates
from tests.test_ingest_search import AS_OF, make


@pytest.fixture(scope="module")
def memory(spark):
    topics = [(f"t{i}", [1.0, float(i)], (i + 1) / 40) for i in range(30)]
    made = make(spark, topics, [(f"i{n}", f"t{n % 30}", f"c{n}", [1.0, 0.0]) for n in range(60)],
                [(f"t{i}", f"t{(i * 3 + 1) % 20}", (i + 1) / 50) for i in range(20)])
    aged = made.topics.withColumn("last_accessed", F.expr("timestamp_ntz'2024-01-31 00:00:00' - make_interval(0, 0, 0, int(substr(id, 2)) * 2)"))
    return made.with_tables(topics=aged, edges=made.edges.withColumn("last_activated", F.expr(
        "timestamp_ntz'2024-01-31 00:00:00' - make_interval(0, 0, 0, int(substr(from_topic, 2)) % 3)")))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_table_functions(spark, memory):
    names = sql.register(spark, memory, "fm")
    assert len(names) == len(set(names)) == 11
    assert rows(spark.sql("select n.* from fm_topics t, lateral fm_topic_neighbors(t.id) n")) == rows(graph.neighbors(memory.edges, memory.topics))
    assert rows(spark.sql("select * from fm_topic_neighbors('t3', 0.05)")) == rows(
        graph.neighbors(memory.edges, memory.topics, spark.createDataFrame([("t3",)], "topic_id string"), 0.05))
    assert rows(spark.sql("select * from fm_orphan_topics()")) == rows(graph.orphans(memory.topics, memory.edges))
    decayed = updates.decay_topics(memory.topics, AS_OF).select("id", "strength", "decayed_strength")
    assert rows(spark.sql(f"select * from fm_decayed_topics(timestamp_ntz'{AS_OF}')")) == rows(decayed)
    _, gone = updates.evict(memory, as_of=AS_OF)
    assert rows(spark.sql(f"select * from fm_weak_topics(timestamp_ntz'{AS_OF}')")) == rows(gone.select("id"))
    # Over another snapshot with the same names.
    sql.register(spark, memory.with_tables(edges=memory.edges.limit(0)), "fm")
    assert spark.sql("select * from fm_topic_neighbors('t3', 0.05)").count() == 0


def test_scalar_functions(spark, memory):
    sql.register(spark, memory, "fs")
    pairs = memory.topics.select("id", "strength", "access_count", "topic_embedding")
    pairs.createOrReplaceTempView("pairs")
    got = spark.sql("""select id, fs_cosine(topic_embedding, array(1D, 1D)), fs_node_size(strength, access_count), fs_clamp_add(strength, 0.5D),
        fs_instance_rank(strength, 0.5D, 0.2D), fs_half_life_decay(strength, 3D, 7D) from pairs""")
    one = F.array(F.lit(1.0), F.lit(1.0))
    want = pairs.select("id", vectors.cosine_similarity(F.col("topic_embedding"), one), scoring.node_size(F.col("strength"), F.col("access_count")),
                        scoring.clamp_add(F.col("strength"), F.lit(0.5)), scoring.instance_rank(F.col("strength"), F.lit(0.5), F.lit(0.2)),
                        scoring.half_life_decay(F.col("strength"), F.lit(3.0), F.lit(7.0)))
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    assert spark.sql("select fs_cosine(array(0D), array(1D)) is null as x").first()[0]


def jobs(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    action()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


@pytest.mark.parametrize("kind", ["decay", "prune", "evict"])
def test_counts_come_with_the_write(spark, memory, tmp_path, kind):
    path = str(tmp_path / "out")
    if kind == "evict":
        after, counted = updates.evict_counted(memory, as_of=AS_OF)
        plain, gone = updates.evict(memory, as_of=AS_OF)
        want, n, table = plain.topics, gone.count(), after.topics
        assert rows(after.instances.select("id")) == rows(plain.instances.select("id"))
        assert rows(after.edges.select("id")) == rows(plain.edges.select("id"))
    elif kind == "decay":
        counted = updates.decay_idle_edges_counted(memory.edges, AS_OF)
        plain = updates.decay_idle_edges(memory.edges, AS_OF)
        want, n, table = plain.drop("is_decayed"), plain.filter("is_decayed").count(), counted.rows
    else:
        counted = updates.prune_edges_counted(memory.edges)
        want, n, table = updates.prune_edges(memory.edges), memory.edges.filter("weight < 0.05").count(), counted.rows
    assert n > 0
    assert jobs(spark, f"write-{kind}", lambda: table.write.parquet(path)) == 1
    assert counted.n_affected == n
    assert rows(spark.read.parquet(path)) == rows(want)
