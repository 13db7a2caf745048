"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test texts, each document scanned once.

Words are runs of ASCII letters and digits and of any other non-ASCII characters, A-Z lower-cased. Each window of
``window`` consecutive words of an item (all of a shorter item) is a pattern. A word of the benchmark is written as
three characters from disjoint alphabets, any other word as three spaces, so the automaton has few branches at each
state, matches begin and end at words, and the place of a match gives the place of its words; these are mapped to
character offsets of the original text.

An automaton holds at most ``max_words`` words of items and ``WORD_BYTES`` times as many bytes. A larger benchmark is
cut into several that are scanned one after another over the documents, written with a row number, and the hits of a
row are put together. An item of more than ``max_words`` words is cut into pieces that overlap by all but one word of a
window, so every window stands in one of them.

Defined results: a null text or item has no words; items without words are never found; an item's id may be null and
is then not named; repeated rows are scanned one by one; an empty benchmark hits nothing; an empty table gives an
empty result; texts of any length are read whole; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, free_name, new_path, ready, utf8, written

#: All but letters, digits and non-ASCII bytes become a space, A-Z become a-z.
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
BREAK, UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NO_WORD = "   "
#: Bytes of items that an automaton may hold for each word that it may hold.
WORD_BYTES = 32

RESULT = "n_words long, n_hit long, n_items long, items array<long>, spans array<struct<start: long, end: long>>, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    """The normalised words; ``bytes.split`` splits at ASCII white space only."""
    return text.translate(NORMAL).split()


def spelled(number: int) -> str:
    """Three characters, each from an alphabet of its own, for a word of the benchmark."""
    return chr(0x100 + number % 256) + chr(0x300 + number // 256 % 256) + chr(0x500 + number // 65536)


def patterns(items: list[tuple[int | None, bytes]], window: int) -> tuple[dict[bytes, str], dict[str, tuple[int, list[int | None]]]]:
    """The spelling of each word, and for each window its length in words and its items."""
    spelling: dict[bytes, str] = {}
    found: dict[str, tuple[int, dict[int | None, None]]] = {}
    for item, text in items:
        words = words_of(text)
        line = "".join(spelling.setdefault(w, spelled(len(spelling))) for w in words)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if size else ():
            found.setdefault(line[3 * i : 3 * (i + size)], (size, {}))[1][item] = None
    return spelling, {line: (size, list(of)) for line, (size, of) in found.items()}


class Scanner:
    """Finds the benchmark's windows in texts; built once in each worker."""

    built: dict[str, Scanner] = {}

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.spelling, found = patterns(items, window)
        self.automaton = ahocorasick.Automaton()
        for line, value in found.items():
            self.automaton.add_word(line, value)
        self.empty = not found
        self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, items, window: int) -> Scanner:
        if key not in cls.built:
            cls.built.clear()
            cls.built[key] = cls(items.value, window)
        return cls.built[key]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[int]]:
        """The number of words, the merged word ranges that are hit, and the items found."""
        words = words_of(text)
        if self.empty:
            return len(words), [], []
        get, ranges, items = self.spelling.get, [], set()
        for end, (size, of) in self.automaton.iter("".join([get(w, NO_WORD) for w in words])):
            last = end // 3 + 1
            # ends only grow, but a longer window may begin before the ranges held so far
            start = last - size
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, last))
            items.update(of)
        return len(words), ranges, sorted(x for x in items if x is not None)


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code-point offsets, end exclusive, of word ranges."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def judged(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int, max_words: int) -> DataFrame:
    """(id, t) of each item; one of more than ``max_words`` words is cut into pieces that have all its windows."""
    most = max(max_words, window)
    held = F.array_remove(F.split(F.translate(F.coalesce(column(benchmark, item_text), F.lit("")), UPPER, UPPER.lower()), BREAK), "")
    items = benchmark.select(column(benchmark, item_id).cast("long").alias("id"), F.explode(F.array(held)).alias("held"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("held") - (window - 1), F.lit(1)), F.lit(most - window + 1))
    cut = items.select("id", F.explode(F.transform(starts, lambda i: F.slice("held", i, most))).alias("held"))
    return cut.select("id", F.array_join("held", " ").cast("binary").alias("t"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "benchmark_hits", window: int = 13, max_words: int = 100_000
) -> DataFrame:
    """``docs`` with a struct column ``into``: words, hit words, items found, spans in the original, the verdict."""
    spark = ready(docs.sparkSession)
    items = pieces(benchmark, item_id, item_text, window, max_words)
    words, octets = items.agg(F.sum(F.size(F.split(F.col("t").cast("string"), " "))), F.sum(F.octet_length("t"))).first()
    parts = max(1, -(-int(words or 0) // max_words), -(-int(octets or 0) // (max_words * WORD_BYTES)))
    if parts == 1:
        held = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in items.collect()])
        return docs.withColumn(into, scanned(held, window)(utf8(column(docs, text))))
    row = free_name(docs, "row_number")
    base = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    bin_of = F.pmod(F.xxhash64("id", "t"), F.lit(parts))
    hits = []
    for i in range(parts):
        held = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in items.filter(bin_of == i).collect()])
        found = base.select(F.col(row).alias("r"), scanned(held, window)(utf8(column(base, text))).alias("s"))
        path = new_path(spark, "hits")
        found.filter("s.n_hit > 0").select("r", "s.items", "s.ranges").write.parquet(path)
        hits.append(spark.read.parquet(path))
    every = reduce(DataFrame.unionByName, hits).groupBy("r").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("ranges")).alias("ranges"))
    joined = base.join(every, base[row] == every["r"], "left")

    def together(texts: pd.Series, items: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, i, r in zip(texts, items, ranges, strict=True):
            spans = merged([(x["first"], x["last"]) for x in r]) if r is not None else []
            n, hit = len(words_of(t)), sum(b - a for a, b in spans)
            out.append((n, hit, 0 if i is None else len(i), [] if i is None else sorted(map(int, i)), offsets(t, spans), judged(n, hit)))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    result = F.pandas_udf(together, RESULT)(utf8(column(base, text)), joined["items"], joined["ranges"])
    return joined.select(*(column(base, c) for c in docs.columns), result.alias(into))


def scanned(held, window: int):
    """The pandas UDF that scans texts for the items of the broadcast."""
    key = uuid.uuid4().hex

    def scan(texts: pd.Series) -> pd.DataFrame:
        scanner, out = Scanner.of(key, held, window), []
        for t in texts.tolist():
            n, ranges, items = scanner.scan(t)
            hit = sum(b - a for a, b in ranges)
            out.append((n, hit, len(items), items, offsets(t, ranges), judged(n, hit), [{"first": a, "last": b} for a, b in ranges]))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items", "spans", "contaminated", "ranges"])

    return F.pandas_udf(scan, RESULT + ", ranges array<struct<first: long, last: long>>")


def items_sha256(ids: list[int]) -> str:
    """Lowercase hex SHA-256 of the ids sorted as strings, comma-joined."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns only.

    The verdict ``contaminated`` leaves a long document with a short passage in it; for training that passage is a leak
    as well, so one hit is enough here.
    """
    name = free_name(docs, "benchmark_hits")
    return decontaminate(docs, benchmark, into=name, **options).filter(F.col(f"{name}.n_hit") == 0).drop(name)

