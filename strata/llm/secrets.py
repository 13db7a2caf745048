"""Secret scans by an incremental blob ledger; DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger is a table of the blobs that
have been scanned, by hash and rule version, with their findings. A scan takes one row for each blob that the ledger
doesn't have under the current rule version, finds the spans of each rule, appends to the ledger, and joins the
ledger back to all paths. Spans of copies and unchanged versions are never sought again, and a change of the rules
scans each blob once more. Texts in which no rule matches are told where they lie, by one expression of all rules, and
only hashes of them move; the few others meet by hash, so that one of each is scanned.

A rule's matches are leftmost and do not overlap; their offsets follow from the pieces between them, as regular
expressions of SQL return texts without places. Lengths are added up in runs of ``RUN`` matches, the runs' totals and
then within each run, so the time grows with the number of matches and not with its square. Offsets are code points,
ends exclusive. Paths are joined with the findings in parts, as one blob may have any share of them.

Defined results: a null text is an empty one, without findings; a null path is a path; repeated rows get equal
findings; an empty table gives an empty result; texts of any length are scanned whole; other columns of the input
don't matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, let, new_path, remove, salted

#: Kind, pattern, the group whose length counts and its least length. The first three are the base.
RULES = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("private_key", r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start: long, rank: int, kind: string, end: long>"
RUN = 128


def rule_version(rules=RULES) -> str:
    """A name that changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The spans of one rule: an array of (start, place of the kind, kind, end)."""
    order = [r[0] for r in RULES].index(kind) if kind in [r[0] for r in RULES] else len(RULES)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    items = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), counted.alias("counted"))
    # what follows the last match is no gap
    sizes = F.transform(
        F.filter(items, lambda x: x["match"].isNotNull()),
        lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["match"]).cast("long").alias("size"), (F.char_length(x["counted"]) >= least).alias("counts")),
    )
    zero = F.lit(0).cast("long")

    def begins(runs: Column) -> Column:
        """Where each run of matches begins in the text."""
        total = lambda run: F.aggregate(run, zero, lambda a, x: a + x["gap"] + x["size"])
        state = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda s, run: F.struct((s["at"] + total(run)).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(runs, state, step, lambda s: s["out"])

    def within(run: Column, at: Column) -> Column:
        """The spans of a run that begins there."""

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["gap"]
            end = start + x["size"]
            span = F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["counts"], F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step, lambda s: s["out"])

    def spans(sizes: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(RUN))
        runs = F.transform(firsts, lambda i: F.slice(sizes, i, RUN))
        return let(runs, lambda r: F.flatten(F.zip_with(r, begins(r), within)))

    # few texts have a match at all, and only those take the way over pieces
    return F.when(text.rlike(pattern), let(sizes, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def any_rule(rules=RULES) -> str:
    """A pattern that occurs in a text if one of the rules' does."""
    return "|".join(f"(?:{pattern})" for _, pattern, _, _ in rules)


def findings(text: Column, rules=RULES) -> Column:
    """All spans of all rules, by start and then in the order of the rules."""
    return F.array_sort(F.concat(*(spans_of(text, *rule) for rule in rules)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_new(docs: DataFrame, ledger: str, text: str = "text", rules=RULES, version: str | None = None) -> DataFrame:
    """Scans what the ledger (a path in the shared folder) lacks, appends it, and returns the ledger of this version."""
    spark, version = docs.sparkSession, version or rule_version(rules)
    body = F.coalesce(column(docs, text), F.lit(""))
    # only texts with a match move, and equal ones meet within each task first
    suspect = F.when(body.rlike(any_rule(rules)), body)
    new = docs.select(F.unhex(F.sha2(body, 256)).alias("sha"), suspect.alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    schema = f"sha binary, rules string, spans array<{SPAN}>"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        seen = spark.read.schema(schema).parquet(ledger).filter(F.col("rules") == version).select("sha")
        new = new.join(seen, "sha", "left_anti")
    spans = F.when(F.col("text").isNotNull(), findings(F.col("text"), rules)).otherwise(F.array().cast(f"array<{SPAN}>"))
    new.select("sha", F.lit(version).alias("rules"), spans.alias("spans")).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).filter(F.col("rules") == version)


def scan_paths(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(path, sha256, spans) for each row of ``docs``; the ledger is a fresh one if none is given."""
    held = scan_new(docs, ledger or new_path(docs.sparkSession, "ledger"), text, rules)
    found = held.filter(F.size("spans") > 0).select("sha", "spans")
    rows = docs.select(column(docs, path).alias("path"), F.unhex(F.sha2(F.coalesce(column(docs, text), F.lit("")), 256)).alias("sha"))
    every = salted(found, rows, "sha", "path", "left")
    return every.select("path", F.lower(F.hex("sha")).alias("sha256"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def forget(docs: DataFrame, ledger: str) -> None:
    """Deletes a ledger."""
    remove(docs.sparkSession, ledger)
