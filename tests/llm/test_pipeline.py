"""The stages on a small folder, each against a plain version of what it decides."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from fadegraph.llm import mixing, pieces, queries, ranking, secret_scan
from tests.llm.test_texts import sentence, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, sentence(rng, 60) + ".") for i in range(120)]
    rows += [(200 + i, " ".join(f"{w.upper()}!!" for w in sentence(rng, 40).split())) for i in range(40)]
    base = sentence(rng, 200)
    rows += [(300, base), (301, base), (302, base + " extra words"), (303, f"{sentence(rng, 40)} password=hunter2222 {sentence(rng, 9)}")]
    rows += [(304, None), (305, ""), (None, sentence(rng, 50)), (306, "dup text here"), (306, "dup text here")]
    docs = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), 0.5, "clash") for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows if i is not None and i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def five_shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "secret scans", "mixing to weights", "piece encoding"]
    steps = [f for _, f in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    good = steps[0](spark, docs, folder)
    assert good.columns == columns
    kept = {r.doc_id for r in ranking.score_quality(docs, labels).filter("predicted = 1").collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id in kept)
    assert not kept & set(range(200, 240)) and kept >= set(range(120))

    good = corpus_pipeline.write_out(docs)  # the next stages on all rows
    alone = corpus_pipeline.write_out(steps[1](spark, good, folder))
    assert alone.columns == columns
    rows = good.collect()
    sets = [five_shingles(r.text) for r in rows]
    gone = {i for i, r in enumerate(rows) for j, o in enumerate(rows) if i != j and sets[i] and 100 * len(sets[i] & sets[j])
            >= 80 * len(sets[i] | sets[j]) and (o.doc_id if o.doc_id is not None else 10**9, j) < (r.doc_id if r.doc_id is not None else 10**9, i)}
    assert Counter(r.doc_id for r in alone.collect()) == Counter(r.doc_id for i, r in enumerate(rows) if i not in gone)

    clean = corpus_pipeline.write_out(steps[2](spark, alone, folder))
    assert clean.columns == columns and clean.count() == alone.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert "hunter2222" not in texts[303].text and corpus_pipeline.SECRET_MARK in texts[303].text
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    before = {r.doc_id: r.text for r in alone.collect()}
    assert all(texts[i].text == before[i] for i in before if i != 303)
    assert secret_scan.find_secrets(clean).filter("spans <> ''").count() == 0

    mixed = corpus_pipeline.write_out(steps[3](spark, clean, folder))
    assert mixed.columns == columns
    copies = Counter({r.doc_id: r.copies for r in mixing.mix_sources(clean).collect()})
    assert Counter(r.doc_id for r in mixed.collect()) == +copies

    model = pieces.read_model()
    last = steps[4](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in last) == +copies
    import numpy as np
    for r in last:
        assert r.decodes and model.decode(np.array(r.ids, dtype=int)).decode() == (texts[r.doc_id].text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<i4").tobytes()).hexdigest()


def test_stages_on_nothing(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run_is_all_stages(spark, folder):
    first = corpus_pipeline.run(spark, folder).drop("ids").collect()
    again = corpus_pipeline.run(spark, folder).drop("ids").collect()
    assert first and sorted(map(str, first)) == sorted(map(str, again))
    assert {r.doc_id for r in first}.isdisjoint(range(200, 240)) and 301 not in {r.doc_id for r in first}


def test_queries_are_named_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
