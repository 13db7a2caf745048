"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed for each row, equal ones are merged at once, and links are sought among the distinct ones
only. Two fingerprints that differ in at most ``radius`` of 64 bits agree on at least ``blocks - radius`` of any
``blocks`` blocks, so every link shows in a bucket of one choice of that many blocks. Each bucket is compared
bit-sliced: plane p holds bit p of 64 neighbouring rows a word, a shift by d lines rows r and r + d up, and
carry-save counters update 64 distances with a few bitwise operations. Words in which every distance has passed the
radius are abandoned, and so are those whose rows are joined already. A bucket of more than ``max_block`` rows is
dealt out as pairs of its parts, so no task holds more than two parts, and each comparison returns a spanning forest
of its rows instead of all pairs. Components of these links come from alternating large-star and small-star rounds
over written tables.

64 bits are too few to tell texts that share four fifths of their shingles from others. ``wide_links`` compares wide
fingerprints, ``WIDE`` bits of the set of five-word shingles, in the same way. Two sets of similarity s (Jaccard) have
a cosine near 2s / (1 + s), and the share of differing bits estimates its angle. Candidates are pairs whose share is at
most the one expected at ``similarity`` and ``margin`` standard errors more. They differ in too many bits for blocks
that agree; they show in buckets of chosen bits, as many choices as make the chance to miss a pair of just that
similarity ``MISS``. ``strata.llm.similar`` links only those whose sets are that similar.

Defined results: a null text is an empty one and has fingerprint zero; zero links like any other fingerprint; rows
with equal ``doc_id`` count one by one; a null ``doc_id`` never becomes a component's id unless all of its
component's are null; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, hot_salted, new_path, ready, remove, salted, utf8, written

BITS, SEED = 64, 42
#: Bits of a wide fingerprint, rows that a bucket of unrelated ones should have at most, and the chance that a pair of
#: just the similarity asked for shares no bucket.
WIDE, BUCKET, MISS = 512, 512, 0.001


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """The XXH64 of each shingle of lower-cased (A-Z) words; of the whole sequence if it is shorter."""
    found = text.lower().split()  # bytes: A-Z only, and \x20 and \x09-\x0D only
    if not found:
        return np.empty(0, np.uint64)
    line, size = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + np.arange(len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])
    cut = map(slice, starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cut), itertools.repeat(SEED)), np.uint64, len(found) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    octets, counts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for i in range(0, len(octets), 65536):  # bits take eight times the room of the hashes
        counts += np.unpackbits(octets[i : i + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint", words: int = 4) -> DataFrame:
    """``docs`` with the fingerprint of its text as a (signed) long."""

    def of(column: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, words)) for t in column.tolist()], dtype=np.uint64).astype(np.int64)

    ready(docs.sparkSession)
    return docs.withColumn(into, F.pandas_udf(of, "long")(utf8(column(docs, text))))


def wide_fingerprint(hashes: np.ndarray, bits: int = WIDE) -> bytes:
    """Bit b is 1 if it is set in over half of the distinct hashes, each of which is mixed anew for every 64 bits."""
    distinct, lanes = np.unique(hashes), bits // 64
    if not len(distinct):
        return bytes(bits // 8)
    seeds = np.arange(1, lanes + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    low, counts = np.uint64(0x0101010101010101), np.zeros((lanes, 8, 8), np.int64)
    for i in range(0, len(distinct), 65280):
        x = distinct[None, i : i + 65280] + seeds  # the splitmix64 finaliser
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        at = np.arange(0, x.shape[1], 255)  # 255 rows add up in the octets of a word without a carry
        for b in range(8):
            sums = np.add.reduceat((x >> np.uint64(b)) & low, at, axis=1)
            counts[:, :, b] += np.ascontiguousarray(sums).view(np.uint8).reshape(lanes, -1, 8).sum(1, dtype=np.int64)
    return np.packbits(2 * counts.reshape(-1) > len(distinct), bitorder="little").tobytes()


def differing(similarity: float) -> float:
    """The share of bits in which sets of this similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float = 0.8, margin: float = 3.1, bits: int = WIDE) -> int:
    """The distance up to which wide fingerprints link."""
    share = differing(similarity)
    return round(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def bands(rows: int, similarity: float, bits: int = WIDE) -> np.ndarray:
    """The bits of each choice; more rows need more bits for buckets of about ``BUCKET`` rows, and so more choices."""
    size = max(8, (rows // BUCKET).bit_length())
    count = math.ceil(math.log(MISS) / math.log1p(-((1 - differing(similarity)) ** size)))
    random, each = np.random.default_rng(9), bits // size
    return np.vstack([random.permutation(bits)[: each * size].reshape(each, size) for _ in range(-(-count // each))])[:count]


def bucket_masks(rows: int, radius: int) -> list[int]:
    """Bit masks, one for each choice of blocks; enough blocks that a bucket of unrelated rows stays small."""
    blocks = next(b for b in range(radius + 2, 13) if (BITS * (b - radius)) // b >= min(48, rows.bit_length() - 1))
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(parts, blocks - radius)]


class Comparison:
    """Bit-sliced distances of neighbouring rows."""

    STEP, CHECK = 1 << 14, 8

    def __init__(self, rows: np.ndarray, radius: int):
        n, words = len(rows), -(-len(rows) // 64)
        bits = np.unpackbits(np.ascontiguousarray(rows.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        bits = np.vstack([bits, np.zeros((words * 64 - n, bits.shape[1]), np.uint8)])
        self.planes = np.zeros((bits.shape[1], words + 2), np.uint64)
        self.planes[:, :words] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
        self.radius, self.n = radius, n

    def within(self, word: np.ndarray, shift: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (r, r + d) in reach: r in the words ``word``, d in ``shift``, lanes in ``valid``."""
        at = np.arange(len(word))
        alive, counters, over = valid.copy(), [np.zeros(len(word), np.uint64) for _ in range(self.radius.bit_length())], np.zeros(len(word), np.uint64)
        base, by = word + shift // 64, (shift % 64).astype(np.uint64)
        left = (np.uint64(64) - by) % np.uint64(64)
        whole = np.where(by == 0, np.uint64(0), ~np.uint64(0))
        for p, plane in enumerate(self.planes):
            carry = plane[word] ^ ((plane[base] >> by) | ((plane[base + 1] << left) & whole))
            for i, counter in enumerate(counters):
                counters[i], carry = counter ^ carry, counter & carry
            over |= carry
            if p % self.CHECK == self.CHECK - 1:
                alive &= ~(over | self.passed(counters))
                if (keep := alive != 0).mean() < 0.75:  # these words have no pair in reach any more
                    at, word, base, by, left, whole, alive, over = (x[keep] for x in (at, word, base, by, left, whole, alive, over))
                    counters = [c[keep] for c in counters]
                    if not len(at):
                        break
        lanes = np.unpackbits(np.ascontiguousarray(alive.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, lane = np.nonzero(lanes)
        first = word[item] * 64 + lane
        return first, first + shift[at[item]]

    def passed(self, counters: list[np.ndarray]) -> np.ndarray:
        """Lanes whose counter is over the radius, by a bitwise comparison from the highest bit down."""
        more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
        for i in range(len(counters) - 1, -1, -1):
            if self.radius >> i & 1:
                equal &= counters[i]
            else:
                more |= equal & counters[i]
                equal &= ~counters[i]
        return more


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs (a, b) are joined: the least row of each set."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def forest(groups: np.ndarray, rows: np.ndarray, radius: int, sizes: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Links (place of a row, place of its root) that join all rows of equal group number within reach.

    Groups are contiguous; a row is one 64-bit word or several. Where the sizes of the rows' sets are given, pairs whose
    sizes alone rule the similarity out don't link.
    """
    n = len(rows)
    labels = np.arange(n)
    if n < 2:
        return labels[:0], labels[:0]
    edges = np.flatnonzero(np.diff(groups)) + 1
    starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
    last = np.repeat(stops, stops - starts)  # the end of each row's group
    reach = last - np.arange(n) - 1  # row r has neighbours r + 1 .. r + reach in its group
    comparison, lanes = Comparison(rows, radius), np.zeros(-(-n // 64) * 64, np.int64)
    lanes[:n] = reach
    lanes = lanes.reshape(-1, 64)
    deepest = lanes.max(1)
    items = np.repeat(np.arange(len(deepest)), deepest)
    offsets = np.arange(len(items)) - np.repeat(np.cumsum(deepest) - deepest, deepest) + 1
    near_first = np.argsort(offsets, kind="stable")  # so that rows of one dense group are joined after a few shifts
    items, offsets = items[near_first], offsets[near_first]
    for i in range(0, len(items), Comparison.STEP):
        word, shift = items[i : i + Comparison.STEP], offsets[i : i + Comparison.STEP]
        row = np.minimum(word[:, None] * 64 + np.arange(64), n - 1)
        open_ = (lanes[word] >= shift[:, None]) & (labels[row] != labels[np.minimum(row + shift[:, None], n - 1)])
        some = open_.any(1)
        valid = np.ascontiguousarray(np.packbits(open_[some], axis=1, bitorder="little")).view("<u8").ravel()
        a, b = comparison.within(word[some], shift[some], valid)
        if sizes is not None:
            fit = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
            a, b = a[fit], b[fit]
        labels = joined(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def links(distinct: DataFrame, radius: int = 4, max_block: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within the radius.

    Where ``distinct`` has a column ``node``, links are between the nodes of the fingerprints.
    """
    rows = distinct.count()
    masks = bucket_masks(rows, radius)
    own = ["fingerprint"] if "node" not in distinct.columns else ["node", "fingerprint"]
    keys = distinct.select(*own, F.posexplode(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))).alias("choice", "mask"))
    keys = keys.select("choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bits"), *own)
    return bucket_links(keys, radius, max_block, rows * len(masks) // 2_000_000)


def wide_links(distinct: DataFrame, similarity: float = 0.8, margin: float = 3.1, max_block: int = 4096) -> DataFrame:
    """Candidates (a, b) whose components hold all pairs of (node, size, wide) within the radius that the sizes allow."""
    rows = distinct.count()
    chosen = bands(rows, similarity)
    weights = 1 << np.arange(chosen.shape[1], dtype=np.int64)

    def of(prints: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
        return pd.Series(list(np.column_stack([bits[:, c] @ weights for c in chosen])), dtype=object)

    ready(distinct.sparkSession)
    keys = distinct.select("node", "size", "wide", F.posexplode(F.pandas_udf(of, "array<long>")("wide")).alias("choice", "bits"))
    return bucket_links(keys.select("choice", "bits", "node", "size", "wide"), wide_radius(similarity, margin), max_block, rows * len(chosen) // 500_000, similarity)


def bucket_links(keys: DataFrame, radius: int, max_block: int, tasks: int, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) within the buckets (choice, bits) of ``keys``: the first two columns, then the node, its set's size
    and its fingerprint, or the fingerprint alone."""
    node, last = keys.columns[2], keys.columns[-1]
    sized = "size" in keys.columns
    # large buckets are few: at most rows * choices / max_block, and only their keys are joined back
    large = keys.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > max_block)
    parts = F.ceil(F.col("n") / F.lit(max_block // 2)).cast("int")
    mine = F.pmod(F.xxhash64(last), parts).cast("int")
    other = F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != mine)
    pairs = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(other, lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
    )
    dealt = salted(large, keys, ["choice", "bits"], last, "left").select(*keys.columns, F.explode(pairs).alias("part"))
    group = F.xxhash64("choice", "bits", "part.i", "part.j")
    dealt = dealt.select(group.alias("bucket"), "choice", "bits", F.col("part.i").alias("i"), F.col("part.j").alias("j"), *keys.columns[2:])
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "choice", "bits", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
                if len(held) < (100_000 if node == last else 30_000):
                    continue
            if held is None or not len(held):
                continue
            same = held[["bucket", "choice", "bits", "i", "j"]].to_numpy()
            change = np.concatenate([[True], (same[1:] != same[:-1]).any(1)])
            groups = np.cumsum(change)
            # the last bucket may go on in the next batch
            end = len(held) if batch is None else int(np.flatnonzero(change)[-1])
            prints = held[last].iloc[:end]
            rows = np.frombuffer(b"".join(prints), "<u8").reshape(end, -1) if prints.dtype == object else prints.to_numpy().astype(np.int64).view(np.uint64)
            a, b = forest(groups[:end], rows, radius, held["size"].to_numpy()[:end] if sized else None, similarity)
            nodes = held[node].to_numpy()[:end]
            held = held.iloc[end:]
            if len(a):
                yield pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return dealt.mapInPandas(compare, "a long, b long").filter("a <> b").distinct()


def component_ids(distinct: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``distinct`` with the least ``least`` of each node's component, null only if all are, as component_id."""
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = distinct.join(members.select(F.col("node").alias("linked"), F.col("root").alias("found")), F.col(node) == F.col("linked"), "left")
    linked = linked.withColumn("root", F.coalesce("found", F.col(node)))
    # only components of two or more nodes have a row here
    others = linked.filter("linked is not null").groupBy("root").agg(F.min("least").alias("others"))
    every = salted(others, linked, "root", node, "left")
    return every.select(*distinct.columns, F.least("least", "others").alias("component_id")).drop("least")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large-star and small-star rounds.

    Each round is written to the shared folder and ends in one aggregate, so neither lineage nor driver grows.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path)
    before = None
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (count, total)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = salted(least, both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # large star
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))  # small star
        following = new_path(spark, "edges")
        star.select("e.u", "e.v").filter("u <> v").distinct().write.parquet(following)
        remove(spark, path)
        path = following


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for each row of ``docs``."""
    own = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    prints = written(fingerprints(own, words=words).select("doc_id", "fingerprint"), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fingerprint"), radius))
    of = written(component_ids(distinct, roots, "fingerprint").select("fingerprint", "n", "component_id"), "components")
    # a fingerprint may have any share of the rows: empty texts, boilerplate
    return hot_salted(of, prints, "fingerprint", "doc_id", "n").select("doc_id", "fingerprint", "component_id")
