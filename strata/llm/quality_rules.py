"""Quality rules: documents whose histograms diverge from every language reference are rejected.

A language reference is two histograms summed over all documents of one language that pass the base rules:
character classes, and the common words of ``COMMON_WORDS`` (all others are one bin). A document is compared with
each reference by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1), and the nearest
reference counts, so a wrong language label does no harm. Languages with less than a thousandth of the documents share
one reference. Short documents have noisy histograms; below the minimum
lengths the distances don't count, and above them the limits are widened by a term that falls with the length.

Defined results: a null text has no words and is empty; nulls in ``lang`` form no reference; an empty table gives an
empty result; repeated rows are judged one by one and alike; texts of any length are read whole; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, free_name, ready, steps, utf8, written

#: Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that for it was on are as with by this be at from or an not have "
    "der die das und von mit sich ein eine einer ist nicht den des im zu für auf dem "
    "de la le et les un une du est pour que qui dans par sur pas au avec en "
    "el y los se del las por con no su para es al lo"
).split()
#: The characters that the base rules count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
CLASSES = ("space", "lower", "upper", "letter", "mark", "digit", "symbol", "sentence", "punctuation", "other")
SPACE, SYMBOL = CLASSES.index("space"), CLASSES.index("symbol")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
BASE_SCHEMA = ", ".join(f"{c} {'boolean' if c == 'base_failed' else 'long'}" for c in BASE)


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    by = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lo": "letter", "Lm": "letter", "M": "mark", "N": "digit", "P": "punctuation", "S": "punctuation"}
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if name := by.get(kind) or by.get(kind[0]):
            table[i] = CLASSES.index(name)
    for chars, name in ((" \t\n\v\f\r", "space"), (SYMBOLS, "symbol"), (".,;:?'\"-()", "sentence")):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    return table


@lru_cache(1)
def common() -> dict[bytes, int]:
    return {w.encode(): i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}


def char_histograms(texts: list[bytes]) -> np.ndarray:
    """For each text the number of code points of each class."""
    decoded = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64) * len(CLASSES), [len(t) for t in decoded])
    return np.bincount(rows + class_table()[points], minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All words as numbers, the number of words of each text, and the words by number."""
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D, and nowhere else
    lens = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(lens.sum()))
    return codes, lens, list(numbers)


def word_histograms(codes: np.ndarray, lens: np.ndarray, words: list[bytes]) -> np.ndarray:
    """For each text the number of each common word, bin 0 for the others; case and punctuation around don't count."""
    bins, known = len(common()) + 1, common()
    bin_of = np.fromiter((known.get(w.strip(b".,;:!?\"'()").lower(), 0) for w in words), np.int64, len(words))
    rows = np.repeat(np.arange(len(lens), dtype=np.int64) * bins, lens)
    return np.bincount(rows + (bin_of[codes] if len(words) else 0), minlength=len(lens) * bins).reshape(len(lens), bins)


def n_repeat_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(codes) < 4:
        return 0
    _, c = np.unique(codes, return_inverse=True) if codes.max() >= 1 << 21 else (None, codes)
    if c.max() >= 1 << 21:
        _, pairs = np.unique(c[:-2] * (c.max() + 1) + c[1:-1], return_inverse=True)
        keys = pairs.astype(np.uint64) * np.uint64(c.max() + 1) + c[2:].astype(np.uint64)
    else:
        keys = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(codes), bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for d in range(3):
        hit[at + d] = True
    return int(hit.sum())


def n_dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_stats(texts: list[bytes]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The base columns, and the two histograms, of each text."""
    chars = char_histograms(texts)
    codes, lens, words = word_codes(texts)
    ends = np.cumsum(lens)
    out = pd.DataFrame(
        {
            "n_words": lens,
            "word_chars": chars.sum(1) - chars[:, SPACE],
            "n_symbols": chars[:, SYMBOL],
            "n_dup_lines": np.fromiter(map(n_dup_lines, texts), np.int64, len(texts)),
            "n_repeat_words": np.fromiter((n_repeat_words(codes[e - n : e]) for e, n in zip(ends, lens, strict=True)), np.int64, len(texts)),
        }
    )
    out["base_failed"] = (out.n_words < MIN_WORDS) | (100 * out.n_repeat_words > MAX_REPEATED_PERCENT * out.n_words)
    return out, chars, word_histograms(codes, lens, words)


def js_distance(histograms: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (bits, rooted) of each row from the reference; 0 where either is empty."""
    p = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    q = (reference / max(reference.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    out = np.sqrt(np.clip((a + b) / 2, 0, 1))
    return np.where((histograms.sum(1) > 0) & (reference.sum() > 0), out, 0.0)


def measured(docs: DataFrame, text: str = "text", into: str = "measure") -> DataFrame:
    """``docs`` with a struct column ``into``: the base counts and both histograms of each text, read once."""

    def of(column: pd.Series) -> pd.DataFrame:
        texts, out = column.tolist(), []
        for a, b in steps(texts):
            stats, chars, words = base_stats(texts[a:b])
            stats["chars"], stats["words"] = list(chars), list(words)
            out.append(stats)
        return pd.concat(out) if out else pd.DataFrame(columns=[*BASE, "chars", "words"])

    ready(docs.sparkSession)
    return docs.withColumn(into, F.pandas_udf(of, f"{BASE_SCHEMA}, chars array<long>, words array<long>")(utf8(column(docs, text))))


def language_references(rows: DataFrame, lang: str = "lang", measure: str = "measure", share: int = 1000) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, character histogram, word histogram), summed over all documents of the language that pass the base rules.

    ``rows`` are ``measured``. A language with at least a ``share``-th of these documents has a reference of its own, so
    there are at most ``share``; the documents of all others add up to one reference, named by the empty string. The sums
    are made as aggregates with partial sums in each task.
    """
    n, m = len(CLASSES), len(common()) + 1
    cols = [f"c{i}" for i in range(n + m)]
    every = F.concat(F.col(f"{measure}.chars"), F.col(f"{measure}.words"))
    own = rows.filter(~F.col(f"{measure}.base_failed")).select(column(rows, lang).cast("string").alias("l"), *(every[i].alias(c) for i, c in enumerate(cols)))
    sums = [F.sum(c).alias(c) for c in cols]
    by = written(own.filter("l is not null").groupBy("l").agg(F.count("*").alias("docs"), *sums), "references")
    total = by.agg(F.sum("docs")).first()[0] or 0
    frequent = F.col("docs") * share >= F.lit(total)
    found = by.filter(frequent).drop("docs").collect() + by.filter(~frequent).agg(F.lit("").alias("l"), *sums).filter("c0 is not null").collect()
    return sorted((r["l"], np.array(r[1 : n + 1], float), np.array(r[n + 1 :], float)) for r in found if sum(r[1:]) > 0)


def judged(
    rows: DataFrame,
    references: list[tuple[str, np.ndarray, np.ndarray]],
    measure: str = "measure",
    into: str = "quality",
    max_char_distance: float = 0.16,
    max_word_distance: float = 0.20,
    char_slack: float = 3.0,
    word_slack: float = 1.7,
    min_chars: int = 200,
    min_words: int = 50,
) -> DataFrame:
    """Rows that are ``measured``, with a struct column ``into``: the base counts, both distances and the verdict ``kept``.

    A limit is widened by its slack over the root of the length, in characters or in words. The defaults leave all
    labelled good documents of the test tables and reject most of the others that pass the base rules.
    """

    def of(n_words: pd.Series, base_failed: pd.Series, char_counts: pd.Series, word_counts: pd.Series) -> pd.DataFrame:
        if not len(n_words):
            return pd.DataFrame(columns=["char_distance", "word_distance", "kept"])
        chars, words = np.vstack(char_counts), np.vstack(word_counts)
        # the nearest language counts as a whole: both distances are those of one reference
        both = [(js_distance(chars, c), js_distance(words, w)) for _, c, w in references] or [(np.zeros(len(chars)), np.zeros(len(chars)))]
        nearest, at = np.argmin([c + w for c, w in both], axis=0), np.arange(len(chars))
        char_distance, word_distance = np.array([c for c, _ in both])[nearest, at], np.array([w for _, w in both])[nearest, at]
        size, n = chars.sum(1), n_words.to_numpy()
        far = (size >= min_chars) & (char_distance > max_char_distance + char_slack / np.sqrt(np.maximum(size, 1)))
        far |= (n >= min_words) & (word_distance > max_word_distance + word_slack / np.sqrt(np.maximum(n, 1)))
        return pd.DataFrame({"char_distance": char_distance, "word_distance": word_distance, "kept": ~base_failed.to_numpy(bool) & ~far})

    ready(rows.sparkSession)
    verdict = F.pandas_udf(of, "char_distance double, word_distance double, kept boolean")
    judgement = free_name(rows, "judgement")
    out = rows.withColumn(judgement, verdict(*(F.col(f"{measure}.{c}") for c in ("n_words", "base_failed", "chars", "words"))))
    fields = [F.col(f"{measure}.{c}").alias(c) for c in BASE] + [F.col(f"{judgement}.{c}").alias(c) for c in ("char_distance", "word_distance", "kept")]
    return out.withColumn(into, F.struct(*fields)).drop(judgement)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "quality", references=None, keep_text: bool = True, **limits) -> DataFrame:
    """``docs`` with a struct column ``into``: the base counts, both distances and the verdict ``kept``.

    Each text is read once: its histograms are written beside the row, and the references and verdicts come from them.
    Without ``keep_text`` the text is neither written nor returned.
    """
    measure = free_name(docs, "measure")
    rows = measured(docs, text, measure)
    rows = written(rows if keep_text else rows.drop(text), "measured")
    refs = language_references(rows, lang, measure) if references is None else references
    return judged(rows, refs, measure, into, **limits).drop(measure)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns only."""
    name = free_name(docs, "quality")
    return quality_rules(docs, into=name, **options).filter(F.col(f"{name}.kept")).drop(name)
