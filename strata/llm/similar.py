"""Near-duplicates whose sets of five-word shingles have an exact Jaccard similarity of 0.8 or more.

Texts of equal shingle sets are one class, of which one row stands for all. Candidates come from the bit-sliced
comparison of wide fingerprints (``strata.llm.simhash``), with a margin so wide that a pair of just the similarity is
left out with a chance near 0.002 (the margin's and the buckets' together). They are a forest, not all pairs, so a
failed candidate doesn't say that its component has no other link: every component of candidates is searched for links
by the sets themselves. First each member is compared with the component's root; those that are similar are linked to
it, a dense group's members nearly all. The others are compared with one another and with the linked ones, whose
pairs among themselves need no look any more. Components with more than ``BLOCK_BYTES`` of sets are dealt out as pairs
of parts, so no task holds more than two parts, and links come as a forest. Components of the links that hold are the
groups; links chain, so a document can be less similar than that to the one that stays for its group.

Defined results: a null text is an empty one; texts without words are copies of one another; one of fewer than five
words is a single shingle; rows are told apart by where they lie, so repeated ids and null ids are rows like others; of
a group the row of the least ``doc_id`` stays, null last, one of several rows with that id; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, free_name, hot_salted, ready, salted, utf8, written
from strata.llm.simhash import components, shingle_hashes, wide_fingerprint, wide_links

SIMILARITY, WORDS, BLOCK_BYTES = 0.8, 5, 1 << 21


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def exact_forest(sets: list[np.ndarray], similarity: float = SIMILARITY, linked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place of its root) that join all sets of this similarity or more; ``linked`` ones are joined already.

    A set is compared with all others at once, by the places of its shingles. That is done until all sets that were not
    compared are joined, so a dense group takes a few comparisons.
    """
    n = len(sets)
    labels = np.arange(n)
    if linked is not None and linked.any():
        labels[linked] = np.flatnonzero(linked)[0]
    sizes = np.fromiter(map(len, sets), np.int64, n)
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    values, codes = np.unique(every, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    owners = np.repeat(np.arange(n), sizes)[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(values)))
    starts, begins = np.concatenate([[0], ends[:-1]]), np.cumsum(sizes) - sizes
    open_ = np.ones(n, bool)
    while True:
        left = np.flatnonzero(open_)
        names, first, counts = np.unique(labels[left], return_index=True, return_counts=True)
        if len(names) < 2:
            break
        # those outside the largest group
        outside = left[labels[left] != names[counts.argmax()]]
        row = int(outside[0])
        own = codes[begins[row] : begins[row] + sizes[row]]
        lens = ends[own] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        both = np.bincount(owners[at], minlength=n)
        union = sizes + sizes[row] - both
        near = np.flatnonzero(both >= similarity * union - 1e-9)
        met = np.unique(labels[near])
        if len(met) > 1:
            labels[np.isin(labels, met)] = met[0]
        open_[row] = False
    found = np.flatnonzero(labels != np.arange(n))
    return found, labels[found]


def addressed(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with where each row lies, a file's hash and the row's number in it; what is no plain scan is written first."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    plain = plan.collectLeaves().size() == 1 and not any(x in plan.toString() for x in ("Generate", "Join", "Expand", "Sample"))
    address = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        found = docs.select("*", *address)
        if plain:
            return found
    except AnalysisException:
        pass
    return written(docs, "documents").select("*", *address)


def described(docs: DataFrame, file: str, row: str, doc_id: str, text: str) -> DataFrame:
    """(file, row, doc_id, key, size, wide): the key, size and wide fingerprint of each row's shingle set."""
    import xxhash

    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.tolist():
            found = shingle_set(t)
            out.append((xxhash.xxh3_128_digest(found.astype("<u8").tobytes()), len(found), wide_fingerprint(found)))
        return pd.DataFrame(out, columns=["key", "size", "wide"])

    ready(docs.sparkSession)
    found = F.pandas_udf(of, "key binary, size long, wide binary")(utf8(column(docs, text)))
    own = docs.select(F.col(file).alias("file"), F.col(row).alias("row"), column(docs, doc_id).alias("doc_id"), found.alias("found"))
    return own.select("file", "row", "doc_id", "found.key", "found.size", "found.wide")


def candidate_sets(classes: DataFrame, docs: DataFrame, file: str, row: str, text: str, similarity: float) -> DataFrame:
    """(root, node, held): the shingle sets of all classes that are in a component of candidates."""
    roots = written(components(wide_links(classes.select("node", "size", "wide"), similarity)), "candidates")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    where = members.join(classes.select("node", "least.file", "least.row"), "node")

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).astype("<u8").tobytes() for t in texts.tolist()], dtype=object)

    texts = docs.select(F.col(file).alias("file"), F.col(row).alias("row"), utf8(column(docs, text)).alias("t"))
    found = texts.join(where.hint("merge"), ["file", "row"])
    return written(found.select("root", "node", F.pandas_udf(of, "binary")("t").alias("held")), "sets")


def exact_links(sets: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) of (root, node, held) whose components are those of all pairs of a root that are that similar."""

    def near(held: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([similarity_of(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= similarity - 1e-9 for a, b in zip(held, other, strict=True)])

    first = sets.filter("node = root").select("root", F.col("held").alias("root_held"))
    both = salted(first, sets, "root", "node")
    sets = written(both.select("root", "node", "held", F.pandas_udf(near, "boolean")("held", "root_held").alias("linked")), "linked-sets")
    star = sets.filter("linked and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    octets = lambda linked: F.sum(F.when(F.col("linked") == linked, F.octet_length("held") + 64).otherwise(0))
    totals = sets.groupBy("root").agg(octets(True).alias("core"), octets(False).alias("rest")).filter("rest > 0")
    # two parts to a task; a component of less than two parts is one
    parts = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(block_bytes // 2)), F.lit(1)).cast("int")
    whole = F.col("core") + F.col("rest") <= block_bytes
    totals = totals.select("root", F.when(whole, 1).otherwise(parts("core")).alias("cores"), F.when(whole, 1).otherwise(parts("rest")).alias("rests"))
    dealt = salted(totals, sets, "root", "node")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("cores")).otherwise(F.col("rests"))).cast("int")
    # parts of the rest meet each part of the core and one another; numbers of the core's parts are negative
    cores, rests = F.sequence(-F.col("cores"), F.lit(-1)), F.sequence(F.lit(0), F.col("rests") - 1)
    pair = lambda i, j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    meets = F.when(F.col("linked"), F.transform(rests, lambda j: pair(-mine - 1, j))).otherwise(
        F.concat(F.transform(cores, lambda i: pair(i, mine)), F.transform(F.filter(rests, lambda j: j != mine), lambda j: pair(mine, j)))
    )
    dealt = dealt.select("root", "node", "held", "linked", F.explode(meets).alias("part")).select("root", "part.i", "part.j", "node", "held", "linked")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rest is None or not len(rest):
                continue
            same = rest[["root", "i", "j"]].to_numpy()
            edges = [0, *(np.flatnonzero((same[1:] != same[:-1]).any(1)) + 1).tolist(), len(rest)]
            # the last block may go on in the next batch
            blocks = list(itertools.pairwise(edges))[: None if batch is None else -1]
            for a, b in blocks:
                part = rest.iloc[a:b]
                x, y = exact_forest([np.frombuffer(h, "<u8") for h in part["held"]], similarity, part["linked"].to_numpy(bool))
                if len(x):
                    nodes = part["node"].to_numpy()
                    yield pd.DataFrame({"a": nodes[x], "b": nodes[y]})
            rest = rest.iloc[blocks[-1][1] if blocks else 0 :]

    return star.unionByName(dealt.mapInPandas(compare, "a long, b long")).distinct()


def grouped(docs: DataFrame, file: str, row: str, doc_id: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows as ``described``, and (key, n, first) of each class: where the row lies that stays for its group."""
    rows = written(described(docs, file, row, doc_id, text), "described")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row"))
    classes = rows.groupBy("key").agg(least.alias("least"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("wide").alias("wide"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(exact_links(candidate_sets(classes, docs, file, row, text, similarity), similarity))
    members = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    linked = members.join(classes.select("node", "key", "least", "n"), "node")
    best = linked.groupBy("root").agg(F.min("least").alias("first"))
    linked = salted(best, linked, "root", "node").select("key", "n", "first")
    alone = classes.join(members.select("node"), "node", "left_anti").select("key", "n", F.col("least").alias("first"))
    return rows, written(linked.unionByName(alone), "groups")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``: the id of the row that stays for its group."""
    file, row = free_name(docs, "file"), free_name(docs, "row")
    rows, groups = grouped(addressed(docs, file, row), file, row, doc_id, text, similarity)
    return hot_salted(groups, rows.select("key", "doc_id", "file", "row"), "key", "row", "n").select("doc_id", F.col("first.doc_id").alias("component_id"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    file, row = free_name(docs, "file"), free_name(docs, "row")
    own = addressed(docs, file, row)
    _, groups = grouped(own, file, row, doc_id, text, similarity)
    kept = groups.select("first.file", "first.row").distinct().toDF(file, row)
    # what stays grows with the input, so it is not broadcast
    return own.join(kept.hint("merge"), [file, row], "left_semi").drop(file, row)
