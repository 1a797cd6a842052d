"""Operators over texts against sequential models, on rows with all sorts of faults."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from fadegraph.llm import jaccard, mixing, pieces, ranking, secret_scan, substrings
from fadegraph.llm.sketch import Repeated, repeated_keys

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, mark string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}{rng.choice(['', '.', 'É'])}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage = sentence(rng, 70)
    base = sentence(rng, 120)
    out = [(0, None, "en", "b", 0), (1, "", "en", None, 0), (2, " \t\n", None, "a", 3), (3, "one", "en", "a", 3)]
    out += [(4 + i, sentence(rng, rng.randrange(1, 150)), "en", f"s{i % 3}", 1) for i in range(20)]
    out += [(30 + i, f"{sentence(rng, 20)}  {passage}\n{sentence(rng, 15)}", "de", "big", 1) for i in range(8)]
    out += [(50 + i, base, "de", "big", 1) for i in range(6)]
    for i in range(12):  # near copies
        edited = base.split()
        for _ in range(rng.randrange(1, 4)):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(99)}"
        out.append((60 + i, " ".join(edited), "de", "big", 1))
    out += [(80, sentence(rng, 30_000, 9_000), "en", "long", 1), (81, "y" * 70_000 + " Z", "en", "long", 1)]
    out += [(None, base, "en", "a", 1), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3)]
    return [(*r, 7, "clash", None) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def last(i):
    return 2**63 - 1 if i is None else i


def test_repeats_are_removed(docs, rows, none):
    first = {}
    for i, text in sorted(((last(r[0]), r[1]) for r in rows), key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    want = Counter()
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < last(r[0]):
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert Counter(map(tuple, substrings.remove_repeats(docs).collect())) == want
    assert substrings.remove_repeats(none).collect() == []


def test_sketch_never_misses(spark):
    keys = [i % 700 for i in range(1_000)]

    def found(batch):
        yield batch.column("id").to_numpy().astype("uint64") % 700

    sketch = repeated_keys(spark.range(1_000), found, 1_000)
    assert isinstance(sketch, Repeated)
    import numpy as np
    often = sketch(np.arange(700, dtype=np.uint64))
    assert all(often[k] for k, n in Counter(keys).items() if n > 1)
    assert often.sum() < 400


def test_similar_documents(docs, rows, none):
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), last(None)), last(r[0]))
    want = Counter((r[0], len(sets[i]), None if low[root(i)] == last(None) else low[root(i)]) for i, r in enumerate(rows))
    got = jaccard.similar_documents(docs, shingle_words=4, percent=85).drop("mark").collect()
    assert Counter(map(tuple, got)) == want
    assert jaccard.similar_documents(none).collect() == []


def test_groups_of_one_prefix(spark):
    """A link of a follower that its leader does not have is found."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(common)]
    for _ in range(60):
        edited = list(common)
        for _ in range(rng.randrange(2, 9)):
            edited[rng.randrange(300)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(edited))
    sets = [{tuple(t.split()[j:j + 4]) for j in range(297)} for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)

    def root(x):
        return x if parent[x] == x else root(parent[x])

    found = jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 4, 85)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, root(i)) for i in range(len(texts))}


def test_secrets(docs, rows, none, spark):
    def brute(text):
        spans = []
        for kind, pattern, keep in (
                (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
                (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24)):
            flags = re.IGNORECASE | re.ASCII if kind == 0 else 0
            spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if keep(m)]
        return sorted(spans)

    texts = ["é API_KEY: 'abc", "token=abcdef0 SECRET = \"A+/=.-_9\" ſecret=abcdefgh", "secret:token : abcdefgh", "AKIAAKIA12 AKIA" + "B" * 17,
             "0" * 23 + " " + "a1" * 40, "key 9f8A7b6Q5c4W3d2E1x0Z/+vN end", "x" * 90_000 + " password=hunter22", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.find_secrets(table, redact_with="[S]").collect():
        base = brute(texts[r.doc_id] or "")
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        if r.doc_id == 5:
            assert "entropy:4:28" in r.spans and r.clean_text == "key [S] end"
    assert secret_scan.find_secrets(docs).count() == len(rows)
    assert all(not r.spans for r in secret_scan.find_secrets(docs).collect())
    assert secret_scan.find_secrets(none).collect() == []


def test_entropy_by_increments():
    import math
    rng = random.Random(2)
    for _ in range(50):
        run = "".join(rng.choice("abcdef0123456789XYZ") for _ in range(rng.randrange(20, 70)))
        windows = [run[i:i + 20] for i in range(len(run) - 19)]
        best = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) for w in windows)
        assert abs(secret_scan.highest_entropy(run) - best) < 1e-9


def test_mix(docs, rows, none):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, target = set(names), {}
    total = 1.5 * sum(sizes.values())
    while free:
        unit = (total - sum(2 * sizes[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not above:
            break
        free -= above
    target = {s: weight[s] * unit if s in free else 2.0 * sizes[s] for s in names}
    found = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken = Counter()
    for r in found:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max([len(words(r[1])) for r in rows if r[3] == s]) * 3 / 2
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs.repartition(2)).collect()))
    assert mixing.mix_sources(none).collect() == []
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in found)


def test_mix_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    table = spark.createDataFrame([(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 4}") for i in range(300)],
                                  "doc_id long, text string, source string")
    found = mixing.mix_sources(table).collect()
    assert len(found) == 300
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4.5 for s in target)


def test_quality(spark, docs, rows, none):
    rng = random.Random(8)
    junk = [(1_000 + i, " ".join(f"{w.upper()}!!" for w in sentence(rng, 30).split()), "en", "a", 1, 7, "m", None) for i in range(60)]
    good = [(2_000 + i, sentence(rng, 40) + ".", "en", "a", 1, 7, "m", None) for i in range(200)]
    table = docs.unionByName(spark.createDataFrame(junk + good, SCHEMA))
    labels = spark.createDataFrame(
        [(r[0], int(r[0] >= 2_000), 0) for r in junk + good] + [(None, 1, 0), (4, None, 0), (5, 0, 0), (5, 1, 0)],
        "doc_id long, quality int, toxic int")
    found = ranking.score_quality(table, labels).collect()
    assert len(found) == len(rows) + 260
    from zlib import crc32
    for r in found:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.held_out and r.doc_id >= 1_000]
    assert sum(r.predicted == int(r.doc_id >= 2_000) for r in held) >= 0.95 * len(held)
    # Labels of held-out rows change nothing.
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(ranking.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = ranking.score_quality(table, turned)
    assert sorted((str(r.doc_id), r.score) for r in again.collect()) == sorted((str(r.doc_id), r.score) for r in found)
    assert ranking.score_quality(none, labels).collect() == []
    assert {r.predicted for r in ranking.score_quality(docs, labels.limit(0)).collect()} == {1}


def test_quality_learns_from_every_label(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    rng = random.Random(9)
    texts = [(i, sentence(rng, 30) + ".", 1) for i in range(0, 1_200)]
    texts += [(i, " ".join(f"{w.upper()}!!" if rng.random() < 0.5 else w for w in sentence(rng, 30).split()), 0) for i in range(2_000, 2_040)]
    table = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    seen = []
    fit = ranking.fit_shards
    monkeypatch.setattr(ranking, "fit_shards", lambda shards, *rest: seen.append((shards, *rest)) or fit(shards, *rest))
    monkeypatch.setattr(ranking, "_FEW", 20)
    found = ranking.learn_ranking(table, labels, shard_rows=100)
    shards, n_good, n_bad, share = seen[0]
    packed = shards.collect()
    assert len(packed) > 5 and all(r["good"] and r["bad"] for r in packed)
    learned = table.filter(~ranking.held_out("doc_id")).count()
    assert sum(r["own_good"] + r["own_bad"] for r in packed) == n_good + n_bad == learned
    # The threshold is the quantile of all scores.
    raw = np.sort(np.concatenate([found.raw(ranking._rows_of(r[c])[:r[f"own_{c}"]]) for r in packed for c in ("good", "bad")]))
    at = int(np.searchsorted(np.arange(1, len(raw) + 1) / len(raw), share - 1e-9))
    assert abs(found.threshold - (raw[at] + raw[at + 1]) / 2) < 1e-9
    scored = ranking.score_quality(table, labels, shard_rows=100).join(labels, "doc_id")
    assert scored.filter(F.col("predicted") == F.col("quality")).count() >= 0.97 * len(texts)


@pytest.fixture(scope="module")
def toy():
    """A vocabulary with overlapping pieces, many of equal score."""
    known = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "é", "cab", "ca"]
    scores = [-3.0, -2.0, -2.5, -2.0, -2.5, -2.5, -4.0, -2.5, -3.0, -1.0, -2.0, -3.5, -3.0]
    all_pieces = known + [f"<0x{b:02X}>" for b in range(256)]
    return pieces.Pieces(all_pieces, scores + [0.0] * 256, [True] * len(known) + [False] * 256,
                         list(range(len(known), len(known) + 256)))


def viterbi(model, text):
    """Best score of a text and its ids, position by position."""
    chars = "▁" + text.replace(" ", "▁") if text else ""
    known = {model.surfaces[i].decode().replace(" ", "▁"): i for i in range(len(model.surfaces)) if i not in set(model.byte_ids.tolist())
             and model.surfaces[i]}
    best, back = [0.0] + [-1e18] * len(chars), [None] * (len(chars) + 1)
    for j in range(1, len(chars) + 1):
        for size in range(min(j, 16), 0, -1):
            i = known.get(chars[j - size:j])
            if i is not None and best[j - size] + model.scores[i] > best[j]:
                best[j], back[j] = best[j - size] + model.scores[i], (size, [i])
        if chars[j - 1] not in known and best[j - 1] + model.unknown > best[j]:
            best[j], back[j] = best[j - 1] + model.unknown, (1, [int(model.byte_ids[b]) for b in chars[j - 1].encode()])
    ids, j = [], len(chars)
    while j:
        size, own = back[j]
        ids, j = own + ids, j - size
    return ids


def encoded(model, texts):
    out = []
    for ids, starts in pieces.encode_batch(model, pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
    return out


def test_pieces_against_viterbi(toy):
    rng = random.Random(6)
    texts = ["", None, " ", "   ", "x", "日a", "a" * 600] + ["".join(rng.choice("abc é日") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for text, ids in zip(texts, encoded(toy, texts)):
        assert ids == viterbi(toy, text or "")
        import numpy as np
        assert toy.decode(np.array(ids, dtype=int)) == (text or "").encode()


def test_pieces_of_the_public_model(docs, rows, none):
    model = pieces.read_model()
    texts = [r[1] for r in rows if r[1] and len(r[1]) < 2_000] + ["naïve \x00\t😀 ﷽", "▁"]
    for text, ids in zip(texts, encoded(model, texts)):
        assert ids == viterbi(model, text)
    found = pieces.encode_texts(docs, model)
    assert found.count() == len(rows)
    assert found.filter("not decodes").count() == 0
    back = Counter(map(tuple, pieces.decode_ids(found, model).collect()))
    assert back == Counter((r[0], r[1] or "") for r in rows)
    assert pieces.encode_texts(none, model).collect() == []


def test_store_of_stretches_starts_anew(toy, monkeypatch):
    monkeypatch.setattr(pieces, "STORED_STRETCHES", 3)
    texts = ["a b c ab bc abc", "abc cab", "a", "c ca"] * 3
    assert encoded(toy, texts) == [viterbi(toy, t) for t in texts]
