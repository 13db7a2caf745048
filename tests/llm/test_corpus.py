"""Near-duplicates, mixing, token files and the pipeline against plain Python."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from strata.llm import common, mixing, quality_rules, similar, simhash, sql, tokens
from strata.llm.queries import op1_mixing, op7_tokens, op9_simhash, tokenizer_path
from tests.llm.test_text_scans import Folder, contamination, quality_base


def shingles(text, size):
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []


def mixed(x):
    full = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ x >> 27) * 0x94D049BB133111EB & full
    return x ^ x >> 31


def wide_fingerprint(text):
    hashes = set(shingles(text, 5))
    out = 0
    for lane in range(simhash.WIDE // 64):
        each = [mixed(h + (lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for h in hashes]
        out |= sum(1 << 64 * lane + b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))
    return out


def fingerprint(text):
    hashes = shingles(text, 4)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """The root of each fingerprint by comparing all pairs."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_roots(texts, similarity=0.8):
    """The root of each text: components of all pairs whose five-word shingles are that similar."""
    sets, root = [set(shingles(t, 5)) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= similarity:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def partition(labels):
    """Which things are together, whatever the labels; ``labels`` is a dict."""
    out = defaultdict(set)
    for k, v in labels.items():
        out[v].add(k)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("which", ["docs", "odd", "clashing", "empty"])
def test_simhash(spark, request, tmp_path, which):
    df = request.getfixturevalue(which)
    folder = Folder(tmp_path).put("documents", df)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in df.collect()]
    root, least = groups([p for _, p in rows]), defaultdict(list)
    for i, p in rows:
        least[root[p]].append(i)
    want = Counter((i, f"{p:016x}", min((x for x in least[root[p]] if x is not None), default=None)) for i, p in rows)
    assert Counter(tuple(r) for r in op9_simhash(spark, folder.path).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("block", [16, 2048])
def test_links_of_dense_groups(spark, block):
    """Chains and balls of near fingerprints, with buckets larger than a block."""
    random = np.random.default_rng(5)
    centres = random.integers(0, 1 << 63, 3, dtype=np.uint64)
    found = {int(c) for c in centres} | {int(x) for x in random.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for c in centres:
        for _ in range(120):
            x = int(c)
            for b in random.choice(64, random.integers(1, 8), replace=False):
                x ^= 1 << int(b)
            found.add(x)
    rows = sorted(found)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in rows], "fingerprint long")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(df, 4, block)).collect()}
    root = groups(rows)
    assert {frozenset(k for k in rows if root[k] == r) for r in set(root.values())} == {frozenset(k for k in rows if got.get(k, k) == r) for r in {got.get(k, k) for k in rows}}


def test_wide_fingerprints_are_those_of_plain_python():
    texts = ["", "one", "a b c d e", "x " * 70_000, " ".join(map(str, range(70_000 // 100))), "Été \U0001f600 a b c d e f g"]
    for t in texts:
        assert int.from_bytes(simhash.wide_fingerprint(simhash.shingle_hashes(t.encode(), 5)), "little") == wide_fingerprint(t)


def varied(random, n_families=30, alone=120):
    """Families of texts with a few words changed, and others; (id, text)."""
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n_families):
        base = random.choice(vocabulary, random.integers(60, 400)).tolist()
        for k in range(random.integers(2, 6)):
            words = list(base)
            for at in random.choice(len(words), k * len(words) // 150, replace=False):
                words[at] = "changed" + str(random.integers(1000))
            rows.append(" ".join(words))
    rows += [" ".join(random.choice(vocabulary, random.integers(60, 400))) for _ in range(alone)]
    return list(enumerate(rows))


def test_similar_texts_meet(spark):
    """Groups are those of all pairs compared exactly: no link is lost, and none is made below the similarity."""
    rows = varied(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(df).collect()}
    want = dict(zip((i for i, _ in rows), similar_roots([t for _, t in rows]), strict=True))
    assert len(partition(want)) < len(rows) - 30 and partition(got) == partition(want)
    assert {r["doc_id"] for r in similar.kept_documents(df).collect()} == {min(g) for g in partition(want)}


def chain(random, n=60, words=400, step=12):
    """Texts each of which is much like the next one and unlike those far away."""
    text = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        at = (k * step) % (words - step)
        text = text[:at] + [f"x{k}_{i}" for i in range(step)] + text[at + step :]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 14, 1 << 24])
def test_exact_links_in_parts(spark, block_bytes):
    """Dense groups, chains and failed candidates keep every link, in one block or in pairs of many parts."""
    random = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    near = []
    for _ in range(80):
        words = list(base)
        for at in random.choice(200, random.integers(1, 9), replace=False):
            words[at] = f"y{random.integers(10_000)}"
        near.append(" ".join(words))
    texts = near + chain(random) + [" ".join(random.choice(base, 150)) for _ in range(20)]
    sets = [similar.shingle_set(t.encode()) for t in texts]
    df = spark.createDataFrame([(0, i, bytearray(x.astype("<u8").tobytes())) for i, x in enumerate(sets)], "root long, node long, held binary")
    got = {r["node"]: r["root"] for r in simhash.components(similar.exact_links(df, block_bytes=block_bytes)).collect()}
    want = similar_roots(texts)
    assert 20 < len(set(want)) < len(texts) - 60
    assert partition({i: got.get(i, i) for i in range(len(texts))}) == partition(dict(enumerate(want)))


def test_exact_forest():
    random = np.random.default_rng(1)
    sets = [np.unique(random.integers(0, 40, random.integers(0, 30)).astype(np.uint64)) for _ in range(200)]
    a, b = similar.exact_forest(sets, 0.5)
    got = dict(enumerate(range(200))) | dict(zip(a.tolist(), b.tolist(), strict=True))
    root = list(range(200))
    for i, j in itertools.combinations(range(200), 2):
        if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.5 and root[i] != root[j]:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert partition(got) == partition(dict(enumerate(root)))


@pytest.mark.parametrize("block", [8, 4096])
def test_wide_links_lose_no_dense_group(spark, block):
    """A group of many texts, each unlike some of the others, is one component, whatever the size of a block."""
    random = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(150):
        words = list(base)
        words[random.integers(300)] = f"x{random.integers(10_000)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{random.integers(5000)}" for _ in range(100)) for _ in range(50)]
    sets = [similar.shingle_set(t.encode()) for t in texts]
    df = spark.createDataFrame([(i, len(x), bytearray(simhash.wide_fingerprint(x))) for i, x in enumerate(sets)], "node long, size long, wide binary")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.wide_links(df, max_block=block)).collect()}
    assert got == {i: 0 for i in range(1, 150)}  # the root itself is not listed


def test_rows_not_ids_are_kept(spark):
    """Rows of one id with different texts stay; of equal texts one row stays, with the least id, null last."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("c")), (None, text("d")), (None, text("d")), (None, text("b")), (3, None), (4, ""), (5, text("a") + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in similar.kept_documents(df.union(df.limit(0))).collect())
    assert kept == Counter([(1, text("a")), (2, text("b")), (2, text("c")), (None, text("d")), (3, None)])


def test_hot_keys_are_dealt_out(spark):
    """A third of the rows are one text: each row still has its result, and the join's hot key stands in several parts."""
    rows = [(i, "calm sea " * 30 if i % 3 == 0 else f"word{i} " * 20) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert len(found) == 900 and {found[i] for i in range(0, 900, 3)} == {0}
    one = spark.createDataFrame([("hot", 900, 7), *((f"k{i}", 1, i) for i in range(2000))], "key string, n long, v long")
    many = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(2000)], "key string, i long")
    out = common.hot_salted(one, many, "key", "i", "n")
    assert out.count() == 2900 and out.filter("key = 'hot' and v = 7").count() == 900


def poisson(mean, u):
    k, term, cdf = 0, math.exp(-mean), math.exp(-mean)
    while cdf <= u:
        k += 1
        term *= mean / k
        cdf += term
    return k


def copies(rows, weights=None, size=1.0, otherwise=0.0):
    counts = Counter(s for _, s in rows)
    w = {s: (n**0.5 if weights is None else weights.get(s, otherwise)) for s, n in counts.items()}
    total = sum(w.values())
    out = Counter()
    for i, s in rows:
        rate = size * w[s] / total * len(rows) / counts[s] if total else 0.0
        draws = math.ceil(rate / mixing.LARGEST_MEAN)
        ident = "" if i is None else str(i)
        for d in range(1, draws + 1):
            import hashlib

            u = int(hashlib.md5(f"{mixing.SEED}:{ident}:{d}".encode()).hexdigest()[:13], 16) / 2**52
            out[(i, s)] += poisson(rate / draws, u)
    return +out


@pytest.mark.parametrize("which", ["docs", "odd", "clashing", "empty"])
def test_mixing(spark, request, tmp_path, which):
    df = request.getfixturevalue(which)
    folder = Folder(tmp_path).put("documents", df)
    rows = [(r["doc_id"], r["source"]) for r in df.collect()]
    assert Counter((r["doc_id"], r["source"]) for r in op1_mixing(spark, folder.path).collect()) == copies(rows, sql.TARGETS, otherwise=sql.OTHERWISE)


def test_mixing_to_weights(spark, docs):
    many = docs.withColumn("source", docs.source.substr(1, 4)).unionByName(docs.limit(0))
    weights = {"src1": 3.0, "src2": 1.0, "nowhere": 5.0}
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix(many, weights, size=40.0).collect())
    assert got == copies([(r["doc_id"], r["source"]) for r in many.collect()], weights, 40.0)
    by = Counter()
    for (_, s), n in got.items():
        by[s] += n
    assert set(by) <= {"src1", "src2"} and 2.6 < by["src1"] / by["src2"] < 3.4
    assert abs(sum(by.values()) / (40 * many.count()) - 1) < 0.05


def test_shuffle_is_global_and_stable(spark, docs):
    a = [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert a == [r["doc_id"] for r in mixing.mix(docs.repartition(7)).collect()] and a != sorted(a)


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 65536, 65537, 200_001])
def test_segment_round_trip(plane, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    blob = tokens.pack(ids, {"documents": []}, plane) + b"\n"
    back, head = tokens.unpack(blob)
    assert (back == ids).all() and len(head["chunks"]) == -(-n // tokens.BLOCK)
    if n:
        assert (tokens.read_chunk(blob, head, len(head["chunks"]) - 1) == ids[(n - 1) // tokens.BLOCK * tokens.BLOCK :]).all()


def test_crc_of_parts():
    a, b, c = b"abc" * 99, b"", b"\x00" * 1000
    assert tokens.crc_of([(zlib.crc32(x), len(x)) for x in (a, b, c)]) == zlib.crc32(a + b + c)


def test_encoder_equals_the_library():
    import random

    encoder, rnd = tokens.Encoder(tokenizer_path()), random.Random(2)
    letters = [chr(i) for i in range(0x260)] + ["’", "　", " ", "中", "\U0001f600", "١"] + [" ", "  ", "\n", "'s", "'ll", "'", "don't", "a", " x", "<|endoftext|>"] * 30
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)] + ["ab" * 300, ""]
    assert encoder.encode(texts) == encoder.direct(texts)


def test_names_of_special_tokens(spark, tokenizer):
    """A text that holds a special token's name gets that token's id, as the library says."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|> x", "<|ENDOFTEXT|>", "< |endoftext|>", "中 <|endoftext|>"]
    assert np.frombuffer(tokens.Encoder(tokenizer_path()).encode(texts)[0], "<u4").tolist() == [64, 220, 50256, 275]
    rows = tokens.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    assert {int(r["doc_id"]): r["ids_crc32"] for r in rows} == {i: zlib.crc32(encoded(t, tokenizer)) for i, t in enumerate(texts)}


def test_pieces_of_equal_hash(tokenizer):
    """Pieces that only share their hash are told apart, within a batch and against what is remembered."""
    encoder = tokens.Encoder(tokenizer_path())
    encoder.random = np.ones(tokens.SURE, np.uint64)  # all pieces of one length have one hash
    texts = ["calm sea, deep sky", "over the dark hill", "", "calm", "dark", "x" * 70]
    for _ in range(2):
        for batch in (texts, texts[::-1], ["dark calm"], ["warm"]):
            assert encoder.encode(batch) == [encoded(t, tokenizer)[:-4] for t in batch]


def encoded(text, tokenizer):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("which", ["docs", "odd", "clashing", "empty"])
def test_tokens(spark, request, tmp_path, which, tokenizer):
    df = request.getfixturevalue(which)
    folder = Folder(tmp_path).put("documents", df)
    rows = op7_tokens(spark, folder.path).orderBy("start").collect()
    ids = {}
    for r in df.collect():
        ids.setdefault(r["doc_id"], []).append(encoded(r["text"], tokenizer))
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(x) // 4, zlib.crc32(x)) for i, v in ids.items() for x in v)


def test_documents_longer_than_a_segment(spark, monkeypatch, tokenizer, tmp_path):
    from pyspark import cloudpickle as own

    texts = ["one two three " * 30, "", "x", "four five " * 200, "six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 50)
    own.register_pickle_by_value(tokens)
    try:
        rows = tokens.tokens(df, tokenizer_path(), partitions=2).orderBy("start").collect()
    finally:
        own.unregister_pickle_by_value(tokens)
    want, at = [], 0
    for i, t in enumerate(texts):
        x = encoded(t, tokenizer)
        want.append((str(i), at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert [tuple(r) for r in rows] == want


def survivors(spark, sf_dir):
    """What the first three stages keep, by plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, into="q").filter("q.kept").select("doc_id").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    assert not any(quality_base(r["text"])[5] for r in rows)
    first = {}
    for root, r in zip(similar_roots([r["text"] for r in rows]), rows, strict=True):
        first[root] = min(first.get(root, r["doc_id"]), r["doc_id"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return [r for r in rows if r["doc_id"] in set(first.values()) and not contamination(r["text"], items)[1]]


def test_pipeline(spark, tokenizer):
    sf_dir = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    kept = survivors(spark, sf_dir)
    want = copies([(r["doc_id"], r["source"]) for r in kept])
    assert Counter(r["doc_id"] for r in rows) == Counter({i: n for (i, _), n in want.items()})
    text, at = {r["doc_id"]: r["text"] for r in kept}, 0
    for r in rows:
        x = encoded(text[r["doc_id"]], tokenizer)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x) // 4, zlib.crc32(x))
        at += r["n_tokens"]


@pytest.mark.parametrize("which", ["odd", "clashing", "empty"])
def test_stages_with_odd_rows(spark, request, tmp_path, which, tokenizer):
    df = request.getfixturevalue(which)
    folder = Folder(tmp_path).put("documents", df).put("benchmark", spark.createDataFrame([(1, "alpha beta"), (None, None)], "item_id long, text string"))
    docs = spark.read.parquet(f"{folder.path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder.path)
        if name != "token_ids":
            assert out.columns == df.columns
            if name == "near_duplicates":
                ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
                assert len(ids) == len(set(ids))
        else:
            want = Counter((r["doc_id"], len(x := encoded(r["text"], tokenizer)) // 4, zlib.crc32(x)) for r in docs.collect())
            rows = out.orderBy("start").collect()
            assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
            assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows)][: len(rows)]
