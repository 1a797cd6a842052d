"""Changes of stored tables, part by part."""

import pytest
from pyspark.sql import functions as F

from fadegraph.functions.embed import embed_hashed
from fadegraph.functions.text import digest
from fadegraph.operators.ingest import unseen
from fadegraph.plans.read import recall
from fadegraph.plans.write import remember, remember_changes
from fadegraph.schema import violations
from fadegraph.session import cut_lineage
from fadegraph.sources import tables
from fadegraph.sources.tables import Changes, load_version, save_changes, save_snapshot
from tests.test_ingest_search import AS_OF, make

ROWS = "source_file string, topic string, ord long, instance string"


def hashed(df, column, out):
    return embed_hashed(df, column, 32, out)


def rows(spark, *given):
    return spark.createDataFrame([("f", t, i, x) for i, (t, x) in enumerate(given)], ROWS)


def content(snapshot):
    return (sorted((r["id"], r["strength"], r["access_count"]) for r in snapshot.topics.collect()),
            sorted((r["id"], r["topic_id"], r["content"], round(r["relevance_score"], 9)) for r in snapshot.instances.collect()),
            sorted((r["from_topic"], r["to_topic"], round(r["weight"], 9)) for r in snapshot.edges.collect()))


def folders(version):
    return {(t, p, f) for t, made in version.folders.items() for p, fs in made["files"].items() for f in fs}


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("memory"))
    given = [(f"topic w{i} w{i * 7 % 300}", f"text {i} of w{i}") for i in range(300)]
    first = remember(make(spark, [("seed", [1.0] + [0.0] * 31, 0.5)]), rows(spark, *given), hashed, as_of=AS_OF).snapshot
    save_snapshot(first, path, parts=128)
    return path


def test_an_import_writes_few_parts_again(spark, memory):
    before = load_version(spark, memory)
    batch = rows(spark, *[(f"topic w{i} w{i * 7 % 300}", x) for i in range(5) for x in (f"text {i} of w{i}", f"more of w{i}")],
                 ("something else", "brand new"), ("something else", "brand new"))
    whole = remember(before.snapshot, batch, hashed, as_of=AS_OF).snapshot
    want = content(whole)
    save_changes(remember_changes(before, batch, hashed, as_of=AS_OF), before)
    after = load_version(spark, memory)
    assert content(after.snapshot) == want
    gone = folders(before) - folders(after)
    assert len(gone) < 0.05 * len(folders(before))
    assert after.number == before.number + 1 and all(r["n_rows"] == 0 for r in violations(after.snapshot).collect())
    assert content(load_version(spark, memory, before.number).snapshot) == content(before.snapshot)


def test_no_stored_content_is_read(spark, memory):
    version = load_version(spark, memory)
    stored = version.snapshot.instances
    some = stored.select("topic_id", digest(F.col("content")).alias("digest"), F.lit(1).alias("more"))
    other = some.withColumn("digest", F.sha2("digest", 256))
    candidates = cut_lineage(some.unionByName(other).unionByName(some.limit(3).withColumn("topic_id", F.lit("nowhere"))))
    kept = tables.unseen_in(version, candidates)
    assert sorted(kept.collect()) == sorted(unseen(candidates, stored).collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<topic_id:string,content_digest:string>" in plan and "content:string" not in plan
    # What is not stored hardly ever passes the filters, what is stored always does.
    assert tables.maybe_stored(version, some).count() == some.count()
    assert tables.maybe_stored(version, other).count() <= 0.05 * other.count()


def test_upserts_deletes_and_moves(spark, tmp_path):
    path = str(tmp_path)
    topics = [(f"t{i}", [1.0, float(i)], 0.5) for i in range(20)]
    save_snapshot(make(spark, topics, [(f"i{n}", f"t{n % 20}", f"c{n}", [1.0, 0.0]) for n in range(60)],
                       [(f"t{i}", f"t{(i * 3 + 1) % 20}", 0.5) for i in range(20)]), path, parts=8)
    version = load_version(spark, path)
    held = version.read("instances")
    moved = held.filter("id in ('i1', 'i2')")
    changes = Changes(
        inserts={"topics": version.snapshot.topics.filter("id = 't3'").withColumn("id", F.lit("t99")),
                 "instances": moved.withColumn("topic_id", F.lit("t99"))},
        upserts={"topics": version.snapshot.topics.filter("id = 't5'").withColumn("strength", F.lit(0.9)),
                 "edges": version.snapshot.edges.filter("from_topic = 't0'").withColumn("weight", F.lit(0.7))},
        deletes={"instances": moved.unionByName(held.filter("topic_id = 't4'")), "edges": version.snapshot.edges.filter("from_topic = 't7'")})
    save_changes(changes, version)
    after = load_version(spark, path).snapshot
    before = version.snapshot
    assert {r["id"]: r["strength"] for r in after.topics.collect()} == {
        **{t: 0.9 if t == "t5" else 0.5 for t, *_ in topics}, "t99": 0.5}
    assert {r["id"]: r["topic_id"] for r in after.instances.collect()} == {
        **{r["id"]: r["topic_id"] for r in before.instances.collect() if r["topic_id"] != "t4"}, "i1": "t99", "i2": "t99"}
    assert {r["from_topic"]: r["weight"] for r in after.edges.collect()} == {f"t{i}": 0.7 if i == 0 else 0.5 for i in range(20) if i != 7}
    assert after.topics.dtypes == before.topics.dtypes and after.instances.dtypes == before.instances.dtypes


def test_crowded_parts_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MAX_FOLDERS", 3)
    path = str(tmp_path)
    save_snapshot(make(spark, [("a", [1.0], 0.5)]), path, parts=1)
    for n in range(6):
        version = load_version(spark, path)
        save_changes(Changes(inserts={"topics": version.snapshot.topics.filter("id = 'a'").withColumn("id", F.lit(f"b{n}"))}), version)
        assert len(load_version(spark, path).folders["topics"]["files"]["0"]) <= 3
    assert load_version(spark, path).snapshot.topics.count() == 7


def test_effects_of_a_search_as_changes(spark, memory):
    version = load_version(spark, memory)
    queries = hashed(spark.createDataFrame([("q", "topic w3 w21"), ("r", "w250")], "query_id string, text string"), "text", "query_embedding")
    recalled = recall(version.snapshot, queries, as_of=AS_OF)
    save_changes(recalled.changes(version), version)
    assert content(load_version(spark, memory).snapshot) == content(recalled.snapshot)
