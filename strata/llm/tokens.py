"""Token ids in binary files with shuffled planes.

Each document's ids, with an end id after them, are laid end to end in the order of a key. A task writes the ids of
its range of keys as segments; a segment is one file:

    magic, 8 bytes
    chunks: blocks of ``BLOCK`` ids (the last may be shorter), each transposed into planes, each plane compressed
    header: zstd-compressed JSON with the segment's place, the offset and lengths of each chunk's planes (the chunk
            index), and each document's key and number of ids
    length of the header, 8 bytes little-endian, and magic

A block of little-endian 32-bit ids is transposed into four byte planes, or into 32 bit planes; high planes hold
little but zeros and compress to almost nothing. Blocks are compressed as they fill, so a task holds a segment's file
and one block. Files are written by Spark's own writer, one file a row, so a lost
executor's files are committed once, and read by the ``binaryFile`` source; what follows the second magic (a line
end) is no part of the segment. A document with more ids than a segment may hold goes on in the next segments.

Defined results: a null text is an empty one and has the end id only; equal keys are in any order among themselves,
a null key comes first; repeated rows are encoded one by one; an empty table writes no segment and reads as an empty
result; other columns of the input don't matter.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import column, new_path, ready

MAGIC, BLOCK, SEGMENT_IDS, END_ID = b"STRTIDS1", 1 << 16, 1 << 24, 0
#: Code points below this one are letters, numbers, white space or others in all Unicode versions alike.
SURE = 0x250


# --- the format


def to_planes(block: np.ndarray, plane: str) -> np.ndarray:
    """The byte planes (4 rows) or bit planes (32 rows) of a block of ids."""
    octets = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """The block of n ids that has these planes."""
    rows = np.vstack([np.frombuffer(p, np.uint8) for p in planes])
    if plane == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Packer:
    """A segment that grows: ids are compressed as their block fills, so what is held is little more than the file."""

    def __init__(self, plane: str = "byte", level: int = 3):
        self.plane, self.compressor = plane, zstandard.ZstdCompressor(level=level)
        self.parts, self.chunks, self.at, self.size = [MAGIC], [], len(MAGIC), 0
        self.held, self.held_size = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.held_size += len(ids)
        self.size += len(ids) // 4
        if self.held_size >= 4 * BLOCK:
            raw = b"".join(self.held)
            whole = len(raw) // (4 * BLOCK) * 4 * BLOCK
            for i in range(0, whole, 4 * BLOCK):
                self.compress(raw[i : i + 4 * BLOCK])
            self.held, self.held_size = [raw[whole:]], len(raw) - whole

    def compress(self, raw: bytes) -> None:
        block = np.frombuffer(raw, "<u4")
        planes = [self.compressor.compress(p.tobytes()) for p in to_planes(block, self.plane)]
        self.chunks.append([self.at, len(block), list(map(len, planes))])
        self.at += sum(map(len, planes))
        self.parts += planes

    def segment(self, header: dict) -> bytes:
        """The whole segment; ``header`` gets the chunk index."""
        if self.held_size:
            self.compress(b"".join(self.held))
        head = self.compressor.compress(json.dumps(header | {"plane": self.plane, "chunks": self.chunks}).encode())
        return b"".join([*self.parts, head, len(head).to_bytes(8, "little"), MAGIC])


def pack(ids: np.ndarray, header: dict, plane: str = "byte", level: int = 3) -> bytes:
    """A segment of these ids."""
    packer = Packer(plane, level)
    packer.add(ids.astype("<u4").tobytes())
    return packer.segment(header)


def header(segment: bytes) -> dict:
    """The header of a segment, without its ids."""
    end = len(segment.rstrip(b"\n")) if not segment.endswith(MAGIC) else len(segment)
    if segment[:8] != MAGIC or segment[end - 8 : end] != MAGIC:
        raise ValueError("not a segment of token ids")
    size = int.from_bytes(segment[end - 16 : end - 8], "little")
    return json.loads(zstandard.ZstdDecompressor().decompress(segment[end - 16 - size : end - 16]))


def read_chunk(segment: bytes, head: dict, i: int) -> np.ndarray:
    """The ids of chunk i alone, found by the index."""
    at, n, sizes = head["chunks"][i]
    decompressor, planes = zstandard.ZstdDecompressor(), []
    for size in sizes:
        planes.append(decompressor.decompress(segment[at : at + size]))
        at += size
    return from_planes(planes, n, head["plane"])


def unpack(segment: bytes) -> tuple[np.ndarray, dict]:
    """All ids of a segment and its header."""
    head = header(segment)
    blocks = [read_chunk(segment, head, i) for i in range(len(head["chunks"]))]
    return np.concatenate(blocks) if blocks else np.empty(0, np.uint32), head


# --- the encoder


OTHER, LETTER, NUMBER, SPACE = range(4)


def sure_classes() -> np.ndarray:
    """The class of each code point below ``SURE``."""
    of = np.full(SURE, OTHER, np.uint8)
    for i, c in enumerate(map(chr, range(SURE))):
        if c in "\t\n\v\f\r \x85\xa0":
            of[i] = SPACE
        elif (kind := unicodedata.category(c)[0]) in "LN":
            of[i] = LETTER if kind == "L" else NUMBER
    return of


def piece_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern begins a piece; ``first`` marks the first character of each text.

    The pattern is: 's 't 're 've 'm 'll 'd, a run of letters, of numbers or of others (each with a space before it
    if there is one), white space up to the last character before something else, white space.
    """
    n = len(points)
    kind = classes[points]
    space = kind == SPACE
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = OTHER, kind[:-1]
    start = first | (kind != before)
    start[1:] &= first[1:] | space[1:] | (points[:-1] != 32)  # a space belongs to what follows it
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]  # the last of white space before something else
    start |= last
    at = np.flatnonzero(start & (points == 39))
    if len(at):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = np.concatenate([first, np.ones(3, bool)])
        one = np.isin(padded[at + 1], [ord(c) for c in "stmd"]) & ~ends[at + 1]
        pairs = padded[at + 1].astype(np.int64) << 16 | padded[at + 2]
        two = np.isin(pairs, [ord(x) << 16 | ord(y) for x, y in ("re", "ve", "ll")]) & ~ends[at + 1] & ~ends[at + 2]
        for hit, size in ((at[one], 2), (at[two & ~one], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[after < n]
            start[after[~space[after]]] = True
    return start


class Encoder:
    """A byte-level BPE of the tokenizers library, with ids remembered by piece of text.

    Such a tokenizer splits text by a pattern and merges within the pieces only. For texts without rare characters
    the split is vectorised here and the library merges each piece that isn't remembered. Pieces are looked up by a
    hash of 64 bits of up to ``LONGEST`` characters and then compared character by character: with the first one of
    that hash in the batch, and that one with what is remembered. A text with a piece that only its hash has in common
    goes to the library as a whole, as longer pieces do each time. Texts with a code point of ``SURE`` or above are cut
    before single spaces between other characters, which is a cut of the pattern too, and the library splits and merges
    each part that isn't remembered. The library takes the names of special tokens out of a text before it is split, so
    texts with such a name go to it as they are.
    """

    RARE = re.compile(rf"[{chr(SURE)}-\U0010FFFF]")
    #: Python counts \x1c to \x1f as white space and the tokenizer doesn't; such texts are not cut.
    PART = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    CONTROL = re.compile(r"[\x1c-\x1f\x85]")
    MOST_PIECES, MOST_PARTS, LONGEST, AT_ONCE = 2_000_000, 100_000, 64, 100
    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.named = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # the same merges for pieces whose bytes are named already, one a line
        self.merger = Tokenizer.from_file(path)
        self.merger.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        printable = [c for c in range(256) if chr(c).isprintable() and chr(c) != " " and c != 0xAD]
        others = (c for c in range(256) if c not in set(printable))
        names = {c: chr(c) for c in printable} | {c: chr(256 + i) for i, c in enumerate(others)}
        self.names = str.maketrans({chr(k): v for k, v in names.items()})
        self.octets = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.classes, random = sure_classes(), np.random.default_rng(1)
        self.random = random.integers(1, 1 << 63, SURE, dtype=np.uint64)
        odd = random.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
        self.powers = np.cumprod(np.full(self.LONGEST + 1, odd, np.uint64))
        self.forget()
        self.known_parts: dict[str, bytes] = {}

    def forget(self) -> None:
        self.hashes, self.entries = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by hash
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)  # entry e has ids[at[e]:at[e + 1]]
        self.points, self.points_at = np.empty(0, np.uint16), np.zeros(1, np.int64)  # and these characters

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and the number of ids of each, told apart by the tokens' bytes."""
        named = [p.encode().decode("latin-1").translate(self.names) for p in pieces]
        lines = ["\n".join(named[i : i + self.AT_ONCE]) for i in range(0, len(named), self.AT_ONCE)]
        found = [np.array(e.ids, np.uint32) for e in self.merger.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ends = np.searchsorted(np.cumsum(self.octets[ids]), np.cumsum(list(map(len, named)))) + 1
        return ids, np.diff(ends, prepend=0)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, lens = self.merged(pieces)
        new = np.arange(len(hashes)) + len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, ids])
        self.points = np.concatenate([self.points, np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)])
        self.points_at = np.concatenate([self.points_at, self.points_at[-1] + np.cumsum(list(map(len, pieces)))])
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.entries = np.insert(self.hashes, where, hashes[order]), np.insert(self.entries, where, new[order])

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is or would be, and whether it is there."""
        where = np.searchsorted(self.hashes, hashes)
        there = np.zeros(len(hashes), bool)
        inside = where < len(self.hashes)
        there[inside] = self.hashes[where[inside]] == hashes[inside]
        return where, there

    def encode_sure(self, texts: list[str]) -> list[bytes]:
        text = "".join(texts)
        if not text:
            return [b""] * len(texts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(list(map(len, texts)))
        first = np.zeros(len(points) + 1, bool)
        first[0], first[ends] = True, True
        starts = np.flatnonzero(piece_starts(points, first[:-1], self.classes))
        sizes = np.diff(starts, append=len(points))
        values, hashes = self.random[points], sizes.astype(np.uint64) * self.powers[0]
        has = np.arange(len(sizes))
        for d in range(min(self.LONGEST, int(sizes.max()))):
            has = has[sizes[has] > d]
            hashes[has] += values[starts[has] + d] * self.powers[d + 1]
        short = sizes <= self.LONGEST
        codes, distinct = pd.factorize(hashes)
        sample = np.empty(len(distinct), np.int64)
        sample[codes] = np.arange(len(codes))
        usable = short[sample]
        where, there = self.places(distinct)
        new = np.flatnonzero(~there & usable)
        if len(self.hashes) + len(new) > self.MOST_PIECES:
            self.forget()
            new = np.flatnonzero(usable)
        if len(new):
            self.learn(distinct[new], [text[a : a + n] for a, n in zip(starts[sample[new]].tolist(), sizes[sample[new]].tolist(), strict=True)])
            where, there = self.places(distinct)
        entry = np.zeros(len(distinct), np.int64)
        entry[there] = self.entries[where[there]]
        odd = self.differing(points, starts, sizes, sample, codes, entry, there)
        entry = entry[codes]
        begins, lens, ids = self.at[entry], self.at[entry + 1] - self.at[entry] if len(self.at) > 1 else np.zeros(len(entry), np.int64), self.ids
        if not short.all():
            long = np.flatnonzero(~short)
            found = [np.frombuffer(x, np.uint32) for x in self.direct([text[a : a + n] for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)])]
            lens[long] = list(map(len, found))
            begins[long] = len(ids) + np.cumsum(lens[long]) - lens[long]
            ids = np.concatenate([ids, *found])
        to = np.cumsum(lens)
        raw = ids[np.repeat(begins - to + lens, lens) + np.arange(to[-1])].astype("<u4").tobytes()
        cut = np.concatenate([[0], to])[np.searchsorted(starts, np.concatenate([[0], ends]))] * 4
        out = [raw[a:b] for a, b in itertools.pairwise(cut.tolist())]
        for i in np.unique(np.searchsorted(ends, starts[odd], side="right")).tolist():
            out[i] = self.direct([texts[i]])[0]
        return out

    def differing(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sample: np.ndarray, codes: np.ndarray, entry: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The pieces that are not what their hash stands for: others than its sample, or a sample other than what is
        remembered. ``entry`` is by hash, and ``there`` says which hashes are remembered."""
        same = sizes == sizes[sample[codes]]
        begins = np.cumsum(sizes) - sizes
        shift = np.where(same, starts[sample[codes]] - starts, 0)
        equal = points[np.repeat(shift, sizes) + np.arange(len(points))] == points
        same &= np.logical_and.reduceat(equal, begins)
        held = np.flatnonzero(there)
        of, n = entry[held], sizes[sample[held]]
        known = np.zeros(len(there), bool)
        known[~there] = True
        fits = self.points_at[of + 1] - self.points_at[of] == n
        held, of, n = held[fits], of[fits], n[fits]
        if len(held):
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = points[np.repeat(starts[sample[held]], n) + at] == self.points[np.repeat(self.points_at[of], n) + at]
            known[held] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return np.flatnonzero(~(same & known[codes]))

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        parts = [self.PART.findall(t) for t in texts]
        missing = list(set().union(*parts).difference(self.known_parts))
        if len(self.known_parts) + len(missing) > self.MOST_PARTS:
            self.known_parts.clear()
            missing = list(set().union(*parts))
        self.known_parts.update(zip(missing, self.direct(missing), strict=True))
        return [b"".join(map(self.known_parts.__getitem__, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        sure, parts, whole = [], [], []
        for i, t in enumerate(texts):
            special = self.named is not None and self.named.search(t)
            (whole if special else sure if t.isascii() or not self.RARE.search(t) else whole if self.CONTROL.search(t) else parts).append(i)
        for at, encode in ((sure, self.encode_sure), (parts, self.encode_parts), (whole, self.direct)):
            for i, ids in zip(at, encode([texts[i] for i in at]), strict=True):
                out[i] = ids
        return out


# --- the operator


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | Callable, order: Column, doc_id: str = "doc_id", text: str = "text", plane: str = "byte", partitions: int | None = None, step_chars: int = 1_000_000
) -> None:
    """Writes the ids of all documents, in the order of ``order`` (a column of numbers or strings), as segments below ``path``."""
    spark = ready(docs.sparkSession)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(order.alias("k"), column(docs, doc_id).cast("string").alias("d"), F.coalesce(column(docs, text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard = Encoder.of(tokenizer) if isinstance(tokenizer, str) else tokenizer(), TaskContext.get().partitionId()
        end, segment = np.array([END_ID], "<u4").tobytes(), 0
        packer, entries = Packer(plane), []

        def cut() -> pd.DataFrame:
            nonlocal segment, packer
            blob = packer.segment({"shard": shard, "segment": segment, "documents": list(entries)})
            entries.clear()
            segment, packer = segment + 1, Packer(plane)
            return pd.DataFrame({"segment": [blob]})

        def dealt(ids: list[str], texts: list[str]) -> Iterator[pd.DataFrame]:
            for name, found in zip(ids, encoder.encode(texts), strict=True):
                found += end
                first = 1
                while found:
                    room = 4 * (SEGMENT_IDS - packer.size)
                    part, found = found[:room], found[room:]
                    packer.add(part)
                    entries.append([name, len(part) // 4, first])  # first: 1 where the document begins
                    first = 0
                    if packer.size >= SEGMENT_IDS:
                        yield cut()

        for batch in batches:
            ids, texts = batch["d"].tolist(), batch["t"].tolist()
            at = chars = 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= step_chars:
                    yield from dealt(ids[at : i + 1], texts[at : i + 1])
                    at, chars = i + 1, 0
            yield from dealt(ids[at:], texts[at:])
        if entries:
            yield cut()

    segments = rows.mapInPandas(encode, "segment binary")
    # the cast checks and changes no byte, and the text writer copies them as they are (the round trip is tested with
    # bytes that are no UTF-8); with one record a file, each segment is a file
    segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id string, start, n_tokens, ids_crc32) of each document, from the segments below ``path``.

    A segment is read by one task. A document that goes on in a next segment gets its figures put together: the CRC
    of joined parts follows from those of the parts and their lengths.
    """
    ready(spark)
    if not any_file(spark, path):
        return spark.createDataFrame([], "doc_id string, start long, n_tokens long, ids_crc32 long")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob in batch["content"]:
                ids, head = unpack(bytes(blob))
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for name, n, first in head["documents"]:
                    out.append((head["shard"], head["segment"], len(ids), name, at, n, first, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
            yield pd.DataFrame(out, columns=["shard", "segment", "ids", "doc_id", "at", "n", "first", "crc"])

    schema = "shard long, segment long, ids long, doc_id string, at long, n long, first int, crc long"
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(places, schema)
    target = new_path(spark, "token-places")
    found.write.parquet(target)
    found = spark.read.schema(schema).parquet(target)
    segments = found.groupBy("shard", "segment").agg(F.first("ids").alias("ids"))
    # the segments' starts: first within each shard, then over the shards, of which there are as many as tasks wrote
    shards = segments.groupBy("shard").agg(F.sum("ids").alias("ids"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = segments.select("shard", "segment", inside.alias("inside")).join(shards, "shard").select("shard", "segment", (F.col("inside") + F.col("shard_start")).alias("before"))
    parts = found.join(starts, ["shard", "segment"]).withColumn("start", F.col("before") + F.col("at"))
    last = F.max(F.struct("segment", "at")).over(W.partitionBy("shard", "segment"))
    # parts: a document's pieces are the last of a segment and the first of those that follow
    parts = parts.withColumn("last", (F.col("at") == last["at"]))
    split = parts.filter("first = 0 or (last and ids >= {0})".format(SEGMENT_IDS))
    whole = parts.filter("not (first = 0 or (last and ids >= {0}))".format(SEGMENT_IDS)).select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    begins = W.partitionBy("shard").orderBy("segment", "at")
    split = split.withColumn("of", F.sum("first").over(begins)).groupBy("shard", "of").agg(F.array_sort(F.collect_list(F.struct("start", "n", "crc", "doc_id"))).alias("p"))

    def together(p: pd.Series) -> pd.Series:
        return pd.Series([crc_of([(x["crc"], 4 * x["n"]) for x in parts]) for parts in p], dtype="int64")

    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    split = split.select(F.col("p")[0]["doc_id"].alias("doc_id"), F.col("p")[0]["start"].alias("start"), total.alias("n_tokens"), F.pandas_udf(together, "long")("p").alias("ids_crc32"))
    return whole.unionByName(split)


def any_file(spark: SparkSession, path: str) -> bool:
    """Whether a folder has data files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/part-*")
    return bool(len(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []))


def crc_of(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of joined byte strings from their own CRCs and lengths.

    The CRC register is linear over GF(2): appending n zero bytes multiplies it by a power of a 32 x 32 bit matrix.
    """
    out = 0
    for crc, size in parts:
        out = appended_zeros(out, size) ^ crc
    return out


def appended_zeros(crc: int, size: int) -> int:
    """What a CRC's share becomes when ``size`` bytes follow."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
            if not vector:
                break
        return out

    zero = zlib.crc32(b"\x00", 0)
    power = [zlib.crc32(b"\x00", 1 << i) ^ zero for i in range(32)]
    while size:
        if size & 1:
            crc = times(power, crc)
        power = [times(power, row) for row in power]
        size >>= 1
    return crc


def tokens(docs: DataFrame, tokenizer: str, order: Column | None = None, path: str | None = None, **options) -> DataFrame:
    """Writes the documents' ids in the order of ``order`` (the id if not given) and returns what the files say."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, column(docs, options.get("doc_id", "doc_id")) if order is None else order, **options)
    return read_tokens(docs.sparkSession, path)
