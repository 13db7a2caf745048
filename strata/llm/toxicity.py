"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its units: the word itself and its character n-grams (with marks at
both ends), hashed into buckets. A text's vector is the mean of its words' vectors, and a softmax over two classes
stands on it; units and softmax are trained together. A misspelling shares most n-grams with the word it comes from.
As all is linear up to the softmax, a trained model is one number for each bucket, and texts are scored by a mean of
numbers remembered for each word.

Training takes a bounded sample: about ``max_train_docs`` different rows of each label, by a hash, weighted back to the
share that the label has, and the first ``max_train_chars`` characters of each. Only the ``max_units`` units that tell
most about the label in the sample get vectors; with all of them (93,000 in a sample of 1,300 texts) the rare ones learn
single texts by heart, and held-out recall fell from 0.95 to 0.70 at most.

Defined results: a null or empty text gets the score of the softmax's bias; so does every text if there are not two
labels to learn from (then 0); null labels are not learned from, and of an id with
both labels the larger counts; rows that are repeated are learned from once; a null id is never held out; repeated rows get equal
scores; an empty table gives an empty result; texts of any length are scored whole; other columns pass through.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, ready, steps
from strata.llm.langid import labelled_sample

WORD = re.compile(r"[^\W_]+")
BUCKETS, GRAMS, SCALE, PRIME = 1 << 17, (3, 4, 5), 20.0, 0x100000001B3
#: Words without units that each text's mean has besides its own, so a text of a few words is not judged by one n-gram.
NEUTRAL = 5
MOST_WORDS = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all units of all words, and the number of units of each."""
    marked = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    octets = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    starts, word = np.cumsum(lens) - lens, np.repeat(np.arange(len(marked)), lens)
    ends = np.repeat(starts + lens, lens)
    at, found, of = np.arange(len(octets)), [], []
    value = np.full(len(octets), 0xCBF29CE484222325, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        inside = at + n <= ends
        at, ends, word, value = at[inside], ends[inside], word[inside], value[inside]
        value = (value ^ octets[at + n - 1]) * np.uint64(PRIME)
        if n in GRAMS:
            found.append(value), of.append(word)
    whole = np.fromiter((hash_of(m) for m in marked), np.uint64, len(marked))
    found.append(whole), of.append(np.arange(len(marked)))
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    mixed = found[order]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.bincount(of, minlength=len(marked))


def hash_of(word: bytes) -> int:
    import zlib

    return zlib.crc32(word) << 32 | zlib.adler32(word)


def sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``lens`` of them each; 0 for none."""
    out = np.zeros((len(lens), *values.shape[1:]), np.float64)
    full = np.flatnonzero(lens)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(lens) - lens)[full], axis=0)
    return out


class Model:
    """A number for each bucket, and the bias: log odds of label 1."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias, self.known = buckets.astype(np.float32), bias, {}

    def __getstate__(self):
        return {"buckets": self.buckets, "bias": self.bias, "known": {}}

    def word_values(self, words: list[str]) -> np.ndarray:
        at, n = units(words)
        return sums(self.buckets[at], n) / np.maximum(n, 1)

    def logits(self, texts: list[str]) -> np.ndarray:
        found = [words_of(t) for t in texts]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        new = list(set().union(*found).difference(self.known))
        if len(self.known) + len(new) > MOST_WORDS:
            self.known = {}
            new = list(set().union(*found))
        if new:
            self.known.update(zip(new, self.word_values(new).tolist(), strict=True))
        values = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(found)), np.float64, int(lens.sum()))
        return SCALE * sums(values, lens) / (lens + NEUTRAL) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = [self.logits(texts[a:b]) for a, b in steps(texts, 1_000_000)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -60, 60))) if parts else np.empty(0)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, part) triples: the mean over words of the mean over their units, added up."""
    words = [words_of(t) for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
    bucket, n = units(list(known)) if known else (np.empty(0, np.int64), np.empty(0, np.int64))
    begins, out = np.cumsum(n) - n, []
    for i, found in enumerate(words):
        if not found:
            continue
        word = np.fromiter((known[w] for w in found), np.int64, len(found))
        size = n[word]
        at = np.repeat(begins[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
        which, inverse = np.unique(bucket[at], return_inverse=True)
        part = np.bincount(inverse, weights=np.repeat(1 / (size * (len(found) + NEUTRAL)), size))
        out.append((np.full(len(which), i), which, part))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, dims: int = 8, epochs: int = 60, rate: float = 0.05, decay: float = 3e-5, max_units: int = 1024, seed: int = 3) -> Model:
    """Trains the units' vectors and the softmax on them together, by Adam on the weighted log loss of all texts.

    Vectors are trained for the ``max_units`` units whose presence tells most about the label (by chi-square), those
    of three texts or more; the others keep the zero vector.
    """
    random = np.random.default_rng(seed)
    doc, bucket, part = bags(texts)
    held = np.bincount(labels, minlength=2)
    has = [np.bincount(bucket[labels[doc] == k], minlength=BUCKETS) for k in (0, 1)]
    share = (has[0] + has[1]) / held.sum()
    tells = (has[1] / held[1] - has[0] / held[0]) ** 2 / np.maximum(share * (1 - share), 1e-9)
    tells[has[0] + has[1] < 3] = 0
    used = np.sort(np.argsort(-tells, kind="stable")[:max_units])
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[bucket] >= 0
    bag = np.zeros((len(texts), len(used)), np.float32)
    bag[doc[keep], place[bucket[keep]]] = SCALE * part[keep]
    vectors = random.normal(0, 0.05, (len(used), dims)).astype(np.float32)
    softmax, bias = random.normal(0, 1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    params = [vectors, softmax, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (weights / weights.sum()).astype(np.float32)[:, None]
    for step in range(1, epochs + 1):
        mean = bag @ vectors
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) * weight
        for i, g in enumerate((bag.T @ (error @ softmax.T) + decay * vectors, mean.T @ error + decay * softmax, error.sum(0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    buckets = np.zeros(BUCKETS)
    buckets[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(buckets, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train_docs: int = 1000, max_train_chars: int = 20_000, **options) -> Model | None:
    """A model from the labelled rows, or None without both labels."""
    found = labelled_sample(docs, labels, doc_id, text, label, max_train_docs, max_train_chars)
    if found is None:
        return None
    rows = sorted((r["key"], r["text"], r["label"]) for r in found[0].collect())
    y = np.array([r[2] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return None
    weights = np.array([found[1][k] / (y == k).sum() for k in (0, 1)])[y]
    return fit([r[1] for r in rows], y, weights, **options)


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of label 1 in the column ``into``."""
    held = ready(docs.sparkSession).sparkContext.broadcast(model)

    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(texts.tolist()) if held.value is not None else np.zeros(len(texts)))

    return docs.withColumn(into, F.pandas_udf(scores, "double")(F.coalesce(column(docs, text), F.lit(""))))
