"""Files read in pieces give the rows of files read whole, wherever the pieces end."""

import json

import pytest

from fadegraph.sources import openie, topic_map
from fadegraph.sources.json_parts import split_json
from tests.test_tables import LAYOUTS

# Texts with all that a reader in pieces may trip over.
_TEXTS = ["a, b", 'say "x", {y}', "[1, 2], {", "\\", "\\\\,", 'end\\"', "}, ]", "", " ", "é, ü, 漢字,", "tab\t,\nline", "plain", "k: [", ","]


@pytest.fixture
def small_ranges(spark):
    """Ranges of 2,000 bytes, so that one file is several tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("2000", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def _sorted(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def _both(spark, folder, chunk_bytes):
    whole = openie.read_triples_and_quarantine(spark, folder)
    split = openie.split_triples_and_quarantine(spark, folder, chunk_bytes=chunk_bytes)
    triple, bad = ("source_file", "triple_ord", "subject", "relation", "object"), ("source_file", "position", "reason")
    return [(_sorted(df, *c)) for df, c in zip(whole, (triple, bad))], [(_sorted(df, *c)) for df, c in zip(split, (triple, bad))]


def _triple(rng, names):
    picked = rng.integers(len(_TEXTS), size=4)
    item = dict(zip(names, (_TEXTS[i] for i in picked)))
    if picked[3] % 3 == 0:
        item["more"] = {"n": [1, {"x": _TEXTS[picked[3]]}, []], "triples": [7]}
    return [item, None, "oops, no", [1, 2], 5][0 if picked[0] else picked[1] % 5]


def _file(rng, layout, size, indent):
    named = {"allennlp": ("arg1", "rel", "arg2"), "clausie": ("subject", "predicate", "object")}.get(layout, ("subject", "relation", "object"))
    items = [_triple(rng, named) for _ in range(size)]
    if layout in ("allennlp", "clausie"):
        value = [dict(zip(named, "abc"))] + items
    elif layout == "generic":
        value = {"about, [": {"x": [1, 2, {"y": "},"}]}, "n": 5, "empty": [], ["triples", "extractions"][size % 2]: items, "last": [{"a": 1}]}
    else:
        cuts = sorted(rng.integers(size + 1, size=5).tolist())
        value = {"first": "x, y", "sentences": [
            {"index": i, "triples": items[a:b]} for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, size]))] + [{"no": 1}, 5]}
    return json.dumps(value, ensure_ascii=bool(size % 2), indent=indent)


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 20])
def test_random_files(spark, rng, tmp_path, small_ranges, chunk_bytes):
    for i, layout in enumerate(["allennlp", "clausie", "generic", "stanford"]):
        (tmp_path / f"{i}.json").write_text(_file(rng, layout, 30 + i, 2 if i % 3 == 0 else None))
    whole, split = _both(spark, str(tmp_path), chunk_bytes)
    assert len(whole[0]) > 50 and len(whole[1]) > 10
    assert split == whole


def test_small_and_odd_files(spark, tmp_path):
    good = '{"subject":"a","predicate":"is","object":"b"}'
    texts = [t for t, _, _ in LAYOUTS] + [
        f'[{good},"oops",{good}]', f"[{good},", "plain", '{"triples":7}', '{"triples":null}', '{"sentences":null}', '{"sentences":[]}',
        '{"sentences":[{"triples":[{"subject":"x","relation":"y","object":"z"},[1]]},5]}', "", "  ", '"a, b"', f'[{good}, {{"arg1": "x',
        '{"triples":[],"extractions":[{"subject":"a","rel":"b","object":"c"}]}']
    for i, text in enumerate(texts):
        (tmp_path / f"{i:02}.json").write_text(text)
    whole, split = _both(spark, str(tmp_path), 8)
    assert split == whole


def test_sentences_over_several_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(openie, "_RUN", 3)
    triple = {"subject": "s", "relation": "r", "object": "o"}
    value = {"sentences": [{"triples": [dict(triple, object=f"{i} {k}") for k in range(i % 4)]} for i in range(20)]}
    (tmp_path / "a.json").write_text(json.dumps(value))
    whole, split = _both(spark, str(tmp_path), 50)
    assert split == whole and len(whole[0]) == 30


@pytest.mark.parametrize("chunk_bytes", [60])
def test_topic_maps(spark, rng, tmp_path, small_ranges, chunk_bytes):
    for i in range(2):
        value = {f"{i}{t}": [_TEXTS[j] for j in rng.integers(len(_TEXTS), size=6)] for t in _TEXTS}
        value |= {"none": None, "text": "x, y", "map": {"a": [1, {"b": 2}]}, "no texts": [], "mixed": [1, None, {"a": [1, 2]}, ["x"]]}
        (tmp_path / f"{i}.json").write_text(json.dumps(value, indent=i or None))
    (tmp_path / "twice.json").write_text('{"a": ["1", "2"], "b": ["3"], "a": ["4"], "b": 5}')
    (tmp_path / "empty.json").write_text("{}")
    entries, bad = topic_map.read_topic_map(spark, str(tmp_path))
    rows, quarantine = topic_map.split_topic_map(spark, str(tmp_path), chunk_bytes=chunk_bytes)
    row = ("source_file", "topic", "ord", "instance")
    assert _sorted(rows, *row) == _sorted(topic_map.topic_map_rows(entries), *row)
    key = ("source_file", "entry_ord", "topic")
    assert _sorted(quarantine, *key) == _sorted(bad, *key)
    values = {(r["source_file"], r["topic"]): r["value"] for r in bad.collect()}
    for r in quarantine.collect():
        left, right = r["value"], values[r["source_file"], r["topic"]]
        assert left == right or json.loads(left) == json.loads(right)


def test_one_file_is_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps([{"arg1": f"a{i}", "rel": "r", "arg2": "b"} for i in range(600)]))
    files, _, items = split_json(spark, str(tmp_path), chunk_bytes=100)
    assert items.count() == 600 and [r["is_broken"] for r in files.collect()] == [False]
    blocks = spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions()
    assert blocks > 5


def test_broken_files(spark, tmp_path):
    texts = ["[1, 2", '["a, b', '{"a": [1}', "]", "[1], [2]", "{}"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    files = split_json(spark, str(tmp_path))[0]
    assert [r["is_broken"] for r in files.orderBy("source_file").collect()] == [True, True, True, True, False, False]
