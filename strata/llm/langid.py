"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with counts of what followed each context of up to three bytes.
A context predicts a byte it has seen by its count and leaves the share d / (n + d) (n bytes seen, d different ones)
to escape; on an escape the next shorter context predicts among the bytes not seen, and below the empty context all
bytes are equally likely. So the probabilities of each context add up to one, and a text's code length under a
language is the sum of -log2 of its bytes' probabilities. The statistics are frozen after training and the code
lengths of the (context, byte) pairs that occurred written out, beside what an escape costs in each context. A text is
scored by the distinct runs of four bytes in a batch: each is looked up once in each language.

Training takes every language that has a text, and a bounded sample of each: about ``max_train_docs`` different
documents, chosen by a hash of id and text, and the first ``max_train_chars`` characters of each. A language keeps its own ``max_contexts``
most frequent contexts of three bytes and a quarter as many of two, however many languages there are. Texts are
lower-cased; all 256 values of a byte are told apart.

Defined results: a null text, or one without a letter (Unicode category L, so ``½`` and ``①`` are none), is ``und``
with score 0; rows that are repeated are learned from once; so is every text if nothing could be
learned; ties go to the first language by name; a null id is never held out; repeated rows get equal results; an
empty table gives an empty result; texts of any length are scored whole; other columns pass through.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, ready, steps, written

SYMBOLS, ORDER, PAD = 256, 3, b" " * 3
RESULT = "lang_pred string, score double, bits double"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(rows: DataFrame, key: str, group: str, most: int, text: str | None = None, seed: int = 7) -> DataFrame:
    """About ``most`` different rows of each group (all of a smaller one), by a hash of key and text, chosen where they lie.

    What is counted and chosen are different pairs of key and text, so a row that is repeated any number of times counts
    once and comes once, and an id with any number of texts has no more of them in the sample than others have. Groups,
    languages or labels, are listed on the driver; rows without one are left out.
    """
    rows = rows.filter(F.col(group).isNotNull()).withColumn("sample_hash", F.xxhash64(*([key] if text is None else [key, text])))
    counts = rows.groupBy(group).agg(F.approx_count_distinct("sample_hash", 0.02).alias("n")).collect()
    if not counts:
        return rows.limit(0).drop("sample_hash")
    # one lookup, as an expression of a branch for each of many groups would be too deep
    chances = F.create_map(*(x for value, n in counts for x in (F.lit(value), F.lit(most / max(n, 1)))))
    u = F.pmod(F.xxhash64("sample_hash", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(u < F.coalesce(F.try_element_at(chances, F.col(group)), F.lit(0.0)))
    return chosen.dropDuplicates([group, "sample_hash"]).drop("sample_hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int, max_chars: int) -> tuple[DataFrame, dict[int, int]] | None:
    """(key, text, label) of about ``most`` rows of each label 0 and 1, and how many ids have each; None without both.

    Labels are sampled by id first. An id may stand in any number of documents, so these are sampled again as rows: what
    the driver gets is bounded by rows and not by ids. Of an id with both labels the larger counts.
    """
    marks = labels.select(column(labels, doc_id).alias("key"), column(labels, label).cast("int").alias("label")).filter("label in (0, 1) and key is not null")
    marks = marks.groupBy("key").agg(F.max("label").alias("label"))
    counts = dict(tuple(r) for r in marks.groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    chosen = sample(marks, "key", "label", most)
    own = docs.select(column(docs, doc_id).alias("key"), F.substring(F.coalesce(column(docs, text), F.lit("")), 1, max_chars).alias("text"))
    # the sample of ids is bounded by its parameter, so it may go to all tasks
    found = written(own.join(F.broadcast(chosen), "key"), "labelled")
    return sample(found, "key", "label", most, "text"), counts


def refine(base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The predictions of contexts with these counts, given those of the next shorter ones."""
    n, seen = counts.sum(1, keepdims=True), counts > 0
    d = seen.sum(1, keepdims=True)
    rest = np.where(seen, 0, base)
    left = rest.sum(1, keepdims=True)
    escape = np.where(left > 0, d / np.maximum(n + d, 1), 0)
    out = np.where(seen, counts / np.maximum(n, 1) * (1 - escape), escape * rest / np.where(left > 0, left, 1))
    return np.where(n > 0, out, base)


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ones, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Tree:
    """One language's context tree: code lengths of pairs that occurred, and of escapes, by order."""

    def __init__(self, texts: list[str], max_contexts: int):
        x = np.frombuffer(b"".join(PAD + t.lower().encode() for t in texts) + PAD, np.uint8).astype(np.int64)
        a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
        grams = [np.unique(context * SYMBOLS + d, return_counts=True) for context in (np.zeros_like(d), c, b * SYMBOLS + c, (a * SYMBOLS + b) * SYMBOLS + c)]
        nodes = [np.zeros(1, np.int64), np.arange(SYMBOLS)]
        for order, room in ((2, max_contexts // 4), (3, max_contexts)):
            keys, inverse = np.unique(grams[order][0] // SYMBOLS, return_inverse=True)
            total = np.bincount(inverse, weights=grams[order][1], minlength=len(keys))
            if order == 3:  # its suffix must be a context too
                total = np.where(np.isin(keys % SYMBOLS**2, nodes[2]), total, 0)
            best = np.argsort(-total, kind="stable")[:room]
            nodes.append(np.sort(keys[best[total[best] > 0]]))

        def counts(order: int) -> np.ndarray:
            key, n = grams[order]
            out, (where, ok) = np.zeros((len(nodes[order]), SYMBOLS)), found(nodes[order], key // SYMBOLS)
            out[where[ok], key[ok] % SYMBOLS] = n[ok]
            return out

        bits = lambda p: -np.log2(np.maximum(p, 1e-30))
        p = [refine(np.full((1, SYMBOLS), 1 / SYMBOLS), counts(0))]
        p.append(refine(np.repeat(p[0], SYMBOLS, 0), counts(1)))
        self.single = bits(p[1]).astype(np.float32).ravel()
        self.nodes, self.keys, self.lengths, self.escapes = {}, {}, {}, {}
        for order in (2, 3):
            base = p[1][nodes[2] % SYMBOLS] if order == 2 else p[2][np.searchsorted(nodes[2], nodes[3] % SYMBOLS**2)]
            n = counts(order)
            p.append(refine(base, n))
            row, byte = np.nonzero(n)
            self.nodes[order], self.keys[order] = nodes[order], nodes[order][row] * SYMBOLS + byte
            self.lengths[order] = bits(p[order][row, byte]).astype(np.float32)
            # the bytes not seen keep their proportions, so one number says what an escape costs each of them
            left, after = np.where(n > 0, 0, base).sum(1), np.where(n > 0, 0, p[order]).sum(1)
            self.escapes[order] = np.where(left > 0, bits(after / np.where(left > 0, left, 1)), 0).astype(np.float32)

    def code_lengths(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each run of ``order`` + 1 bytes, after the ones before it."""
        out, open_ = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for k in range(order, 1, -1):
            key = keys[open_] % SYMBOLS ** (k + 1)
            at, seen = found(self.keys[k], key)
            out[open_[seen]] += self.lengths[k][at[seen]]
            open_, key = open_[~seen], key[~seen]
            at, is_node = found(self.nodes[k], key // SYMBOLS)
            out[open_[is_node]] += self.escapes[k][at[is_node]]
        out[open_] += self.single[keys[open_] % SYMBOLS**2]
        return out


class Model:
    """A context tree for each language."""

    def __init__(self, texts: dict[str, list[str]], max_contexts: int = 8192):
        self.languages = sorted(texts)
        self.trees = [Tree(texts[k], max_contexts) for k in self.languages]

    @cached_property
    def symbol(self) -> np.ndarray:
        """The symbol of each byte: itself."""
        return np.arange(SYMBOLS, dtype=np.int32)

    @cached_property
    def union(self) -> dict[int, np.ndarray]:
        """The contexts of two and three bytes of all languages."""
        return {k: np.unique(np.concatenate([t.nodes[k] for t in self.trees])) for k in (2, 3)}

    @cached_property
    def context(self) -> np.ndarray:
        """For small models: where the code lengths of each three bytes begin in ``lengths``."""
        two, three = self.union[2], self.union[3]
        context = np.tile(np.arange(SYMBOLS, dtype=np.int32), SYMBOLS**2).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        context[:, two // SYMBOLS, two % SYMBOLS] = SYMBOLS + np.arange(len(two))
        context = context.reshape(-1)
        context[three] = SYMBOLS + len(two) + np.arange(len(three))
        return context * SYMBOLS

    @cached_property
    def lengths(self) -> np.ndarray:
        """For small models: bits of each byte after each context (rows) under each language (columns)."""
        each = lambda nodes: (nodes[:, None] * SYMBOLS + np.arange(SYMBOLS)).ravel()
        keys = {1: np.arange(SYMBOLS**2), 2: each(self.union[2]), 3: each(self.union[3])}
        return np.column_stack([np.concatenate([t.code_lengths(keys[k], k) for k in keys]) for t in self.trees])

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        parts = [t.lower().encode("utf-8", "replace") for t in texts]
        x = np.frombuffer(b"".join(PAD + p for p in parts) + PAD, np.uint8).astype(np.uint32)
        keys, at = np.unique(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:], return_inverse=True)
        keys = keys.astype(np.int64)
        ends = np.cumsum([len(p) + len(PAD) for p in parts]) - len(PAD)
        starts = ends - [len(p) for p in parts]
        sums = np.zeros((len(parts), len(self.trees)))
        full = np.flatnonzero(ends > starts)
        if len(full):
            edges = np.column_stack([starts[full], ends[full]]).ravel()
            for i, tree in enumerate(self.trees):
                bits = np.append(tree.code_lengths(keys)[at], np.float32(0))
                sums[full, i] = np.add.reduceat(bits, edges, dtype=np.float64)[::2]
        return sums

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        known = [t or "" for t in texts]
        bits = np.vstack([self.code_lengths(known[a:b]) for a, b in steps(known, 1_000_000)]) if known else np.zeros((0, len(self.languages)))
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
        out = pd.DataFrame({"lang_pred": np.array(self.languages, object)[best], "score": score, "bits": least})
        none = np.fromiter((not any(map(str.isalpha, t)) for t in known), bool, len(known))
        out.loc[none, ["lang_pred", "score", "bits"]] = ["und", 0.0, 0.0]
        return out


def train(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_train_docs: int = 400, max_train_chars: int = 20_000, max_contexts: int = 8192) -> Model | None:
    """A model of the languages of these rows, or None if they have none."""
    own = rows.select(column(rows, doc_id).cast("string").alias("key"), column(rows, text).alias("text"), column(rows, lang).cast("string").alias("lang"))
    own = own.filter("text is not null and lang is not null").withColumn("text", F.substring("text", 1, max_train_chars))
    texts: dict[str, list[str]] = {}
    for r in sorted(sample(own, "key", "lang", max_train_docs, "text").collect(), key=lambda r: (r["lang"], r["key"] or "", r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model(texts, max_contexts) if texts else None


def identify(docs: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: the language, its posterior under equal priors, and its code length."""
    held = ready(docs.sparkSession).sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        if held.value is None:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "bits": 0.0})
        return held.value.predict(texts.tolist())

    return docs.withColumn(into, F.pandas_udf(predict, RESULT)(column(docs, text).cast("string")))
