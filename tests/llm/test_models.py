"""Language, toxicity and quality models: definitions, held-out accuracy, odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.llm import langid, quality_bayes, toxicity
from strata.llm.queries import op3_language_id, op4_toxicity, op6_quality_classifier
from tests.llm.test_text_scans import Folder

SF = "/root/testdata/sf0.01"


def test_predictions_add_up():
    counts = np.array([[3, 0, 1, 0], [0, 0, 0, 0], [1, 1, 1, 1]], float)
    base = np.full((3, 4), 0.25)
    p = langid.refine(base, counts)
    assert np.allclose(p.sum(1), 1)
    assert np.allclose(p[0], [3 / 6, 1 / 6, 1 / 6, 1 / 6])  # two different bytes: a third goes to escape
    assert np.allclose(p[1], base[1]) and np.allclose(p[2], counts[2] / 4)


def ppm(texts, max_contexts):
    """A dictionary PPM: the probability of a byte after up to three others, by the definition."""
    counts = {k: defaultdict(Counter) for k in range(4)}
    data = b"".join(b"   " + t.lower().encode() for t in texts) + b"   "
    for i in range(3, len(data)):
        for k in counts:
            counts[k][data[i - k : i]][data[i]] += 1

    def most(k, room, allowed):
        total = sorted((-sum(c.values()), ctx) for ctx, c in counts[k].items() if allowed(ctx))
        return {ctx for _, ctx in total[:room]}

    nodes = {2: most(2, max_contexts // 4, lambda c: True)}
    nodes[3] = most(3, max_contexts, lambda c: c[1:] in nodes[2])

    def probabilities(context):
        k = len(context)
        base = [1 / 256] * 256 if k == 0 else probabilities(context[1:])
        seen = counts[k].get(context)
        if not seen or (k in nodes and context not in nodes[k]):
            return base
        n, d = sum(seen.values()), len(seen)
        left = sum(base[s] for s in range(256) if s not in seen)
        escape = d / (n + d) if left > 0 else 0
        return [seen[s] / n * (1 - escape) if s in seen else escape * base[s] / left for s in range(256)]

    return probabilities


@pytest.mark.parametrize("max_contexts", [8192, 12])
def test_code_lengths_are_those_of_a_dictionary(max_contexts):
    random = np.random.default_rng(6)
    texts = {k: [" ".join(random.choice(w, 30)) for _ in range(4)] for k, w in (("a", ["abab", "baé", "cab"]), ("b", ["öl", "bbb", "x"]))}
    model = langid.Model(texts, max_contexts)
    asked = ["abba", "", "ÖL baé zz", "\U0001f600 x"]
    want = []
    for t in asked:
        data = b"   " + t.lower().encode()
        want.append([sum(-np.log2(p(data[i - 3 : i])[data[i]]) for i in range(3, len(data))) for p in (ppm(texts[k], max_contexts) for k in sorted(texts))])
    assert np.allclose(model.code_lengths(asked), want, rtol=1e-4, atol=1e-3)


def test_letters_by_category():
    model = langid.Model({"a": ["some words"], "b": ["mots"]})
    found = model.predict(["½ ² ①", "12 _ !", None, "", "中", "ª", "a1"])
    assert [k == "und" for k in found["lang_pred"]] == [True] * 4 + [False] * 3
    assert found["score"].tolist()[:4] == [0.0] * 4


def test_ties_go_to_the_first_language():
    model = langid.Model({"b": ["same text"], "a": ["same text"]})
    found = model.predict(["same text", "other"])
    assert found["lang_pred"].tolist() == ["a", "a"] and np.allclose(found["score"], 0.5)


def test_samples_are_bounded_by_rows(spark):
    """An id that is repeated 50,000 times, with one text or with many, neither fills the sample nor keeps others out."""
    from pyspark.sql import functions as F

    many = spark.range(50_000).select(F.lit(0).cast("long").alias("doc_id"), F.lit("one text again").alias("text"), F.lit("en").alias("lang"))
    differing = many.withColumn("text", F.concat(F.lit("text "), F.monotonically_increasing_id().cast("string")))
    few = spark.createDataFrame([(i, f"another text {i}", "en") for i in range(1, 11)], "doc_id long, text string, lang string")
    chosen = langid.sample(many.union(few), "doc_id", "lang", 400, "text").collect()
    assert sorted(r["doc_id"] for r in chosen) == list(range(11))
    assert 300 < langid.sample(differing.union(few), "doc_id", "lang", 400, "text").count() < 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(1, 0)], "doc_id long, toxic int")
    rows, counts = langid.labelled_sample(differing.union(few).drop("lang"), labels, "doc_id", "text", "toxic", 400, 100)
    found = Counter(r["label"] for r in rows.collect())
    assert counts == {0: 6, 1: 5} and found[1] == 5 and 300 < found[0] < 500  # of both labels the larger counts


def test_all_languages_are_learned(spark):
    """More than 64 languages, one of them of long texts only, keep their contexts and bytes."""
    random = np.random.default_rng(4)
    words = {f"l{i:02}": ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(30)] for i in range(70)}
    words["zz-long"] = ["".join(random.choice(list("абвгдежзиклмнопрст"), 5)) for _ in range(30)]
    text = lambda k, n: " ".join(random.choice(words[k], n))
    rows = [(f"{k}{j}", text(k, 5000 if k == "zz-long" else 100), k) for k in words for j in range(2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    assert model.languages == sorted(words)
    asked = sorted(words)
    assert model.predict([text(k, 20) for k in asked])["lang_pred"].tolist() == asked
    alone = langid.Model({"l00": [t for _, t, k in rows if k == "l00"]})
    assert np.allclose(model.code_lengths(["some text"])[:, 0], alone.code_lengths(["some text"])[:, 0])


def test_language_held_out(spark):
    rows = op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    rows = op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    recall = np.mean([r["predicted"] for r in held if r["toxic"] == 1])
    wrong = np.mean([r["predicted"] for r in held if r["toxic"] == 0])
    assert recall >= 0.85 and wrong <= 0.03


def test_toxicity_scores_by_definition():
    """A score is the softmax over the mean of the words' means of their units' vectors."""
    random = np.random.default_rng(2)
    vectors, softmax, bias = random.normal(0, 1, (toxicity.BUCKETS, 4)), random.normal(0, 1, (4, 2)), np.array([0.1, -0.2])
    model = toxicity.Model(vectors @ (softmax[:, 1] - softmax[:, 0]), bias[1] - bias[0])
    for text in ["one two two", "", "Été!", "a " * 30]:
        words = toxicity.words_of(text)
        mean = np.zeros(4)
        for w in words:
            at, _ = toxicity.units([w])
            mean += vectors[at].mean(0) / (len(words) + toxicity.NEUTRAL)
        z = np.exp(toxicity.SCALE * mean @ softmax + bias)
        assert np.isclose(model.scores([text])[0], (z / z.sum())[1], atol=1e-5)


def test_misspellings_share_grams():
    texts = ["the calm sea was idiot today"] * 20 + ["the calm sea was quiet today"] * 20 + [f"idiots and idiotic talk {i}" for i in range(20)] + [f"quietly and quieter talk {i}" for i in range(20)]
    model = toxicity.fit(texts, np.array([1] * 20 + [0] * 20 + [1] * 20 + [0] * 20), np.ones(80))
    bad, good = model.word_values(["idiotz", "quietz"])
    assert bad > good
    assert model.scores(["idiotz"])[0] > model.scores(["quietz"])[0]


@pytest.mark.parametrize("query", [op3_language_id, op4_toxicity, op6_quality_classifier])
@pytest.mark.parametrize("which", ["odd", "clashing", "empty"])
@pytest.mark.parametrize("marked", [True, False])
def test_odd_rows(spark, request, tmp_path, query, which, marked):
    df = request.getfixturevalue(which)
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 13)] * marked + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    folder = Folder(tmp_path).put("documents", df).put("labels", labels)
    rows = query(spark, folder.path).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.collect())
    assert all(0 <= r["score"] <= 1 for r in rows)
    if query is op3_language_id:
        assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 10))


def strength(groups):
    """The pseudo-count of a prior by the method of moments; groups: (n, good, prior)."""
    spread = sum(n * (good / n - p) ** 2 for n, good, p in groups)
    noise, scale = sum(p * (1 - p) for _, _, p in groups), sum(n * p * (1 - p) for n, _, p in groups)
    if not groups or not scale:
        return 1e4
    between = max(0.0, spread - noise) / scale
    return min(1e4, max(1.0, 1 / between - 1)) if between > 0 else 1e4


def test_quality_posteriors_by_hand(spark):
    """Each row's posteriors from the evidence of all other rows of its host and path."""
    rows = op6_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000
    mean = np.mean([r["evidence"] for r in rows])
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        hosts[r["host"]].append(r["evidence"])
        paths[r["host"], r["path"]].append(r["evidence"])
    k = strength([(len(v), sum(v), mean) for v in hosts.values()])
    host = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    j = strength([(len(v), sum(v), host[h]) for (h, _), v in paths.items()])
    log_odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    for r in rows:
        h, p, e = hosts[r["host"]], paths[r["host"], r["path"]], r["evidence"]
        up = (sum(h) - e + k * mean) / (len(h) - 1 + k)
        down = (sum(p) - e + j * up) / (len(p) - 1 + j)
        score = 1 / (1 + np.exp(-(log_odds(e) + log_odds(down) - log_odds(mean))))
        assert np.allclose([r["host_posterior"], r["path_posterior"], r["score"]], [up, down, score], atol=1e-6)
        assert r["kept"] == (r["score"] >= 0.3)


def test_quality_accuracy(spark):
    rows = op6_quality_classifier(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [r["kept"] == bool(labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert np.mean(right) >= 0.97


def test_sparse_sites_shrink(spark):
    df = spark.createDataFrame([("big", 1000.0, 900.0, 0.5), ("mid", 800.0, 100.0, 0.5), ("one", 1.0, 1.0, 0.5)], "host string, n double, good double, prior double")
    k = quality_bayes.strength(df, "prior")
    assert 1 <= k < 100
    assert abs((1 + k * 0.5) / (1 + k) - 0.5) < abs((900 + k * 0.5) / (1000 + k) - 0.5)
