"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The
ledger, a Parquet table in the shared folder, holds one row per blob and scan:
which rule versions ran and what they found. A scan reads the ledger, runs
over a blob only those rule versions that have not seen it, appends the
outcome, and joins findings back to every path (row) that holds the blob. A
changed rule gets a new version, so it alone runs again.

A finding is a span of code points, end exclusive. Each rule takes the
leftmost non-overlapping matches of its pattern; a match shorter than the
rule's least length is dropped after matching.

Nulls: a null text counts as empty; a null id stays null. Repeated rows stay
repeated rows. Very long texts with many findings take time in proportion to
their length. Ledger rows that two scans at once wrote for one blob and rule
count once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, fresh_path, unboxed, written
from .spans import found, masked


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length must reach ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        body = f"{self.pattern}|{self.group}|{self.least}"
        return f"{self.kind}@{hashlib.sha256(body.encode()).hexdigest()[:12]}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token")
_KEYS = "|".join([*map(_either_case, KEYWORDS), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])

#: The base rules, in the order in which kinds with one start are listed. A
#: run of a class taken greedily from its leftmost character is the whole run,
#: so the least length of `access` and `hex` may stand in the pattern; that of
#: `assign` may not, since a short match still uses up its characters.
BASE_RULES = (
    Rule(
        "assign",
        rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

SPAN = "struct<start:int,end:int,kind:string,rule:string>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of a rule's spans in a text, in time that grows with its length."""
    hits = F.filter(found(text, rule.pattern, rule.group, context=False), lambda x: F.length(x["group"]) >= rule.least)
    return F.transform(
        hits,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("rule")
        ),
    )


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _ledger(spark, path: str) -> DataFrame | None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return None
    schema = f"blob string, rules array<string>, found array<{SPAN}>"
    return spark.read.schema(schema).parquet(path)


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date for these texts and
    rules; returns it for these rules: one row per blob, with ``found``, its
    spans by start, then by the order of the rules."""
    spark = docs.sparkSession
    versions = [r.version for r in rules]
    blobs = (
        docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .select(blob_of(F.col("text")).alias("blob"), "text")
        .dropDuplicates(["blob"])
    )
    ledger = _ledger(spark, ledger_path)
    wanted = F.array(*[F.lit(v) for v in versions])
    if ledger is None:
        todo = blobs.withColumn("rules", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = (
            blobs.join(seen, "blob", "left")
            .withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("rules") > 0)
        )
    none = F.array().cast(f"array<{SPAN}>")
    own = F.concat(*[F.when(F.array_contains("rules", r.version), spans_of(F.col("text"), r)).otherwise(none) for r in rules])
    todo.select("blob", "rules", own.alias("found")).write.mode("append").parquet(ledger_path)

    # a blob has one row per scan in which it had unseen rules; two scans at
    # once may both have one for a rule, whose findings count once
    current = _ledger(spark, ledger_path).where(F.arrays_overlap("rules", wanted))
    scans = current.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("rules", "found"))).alias("scans"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), none.alias("out"))

    def merged(acc: Column, x: Column) -> Column:
        fresh = F.filter(x["found"], lambda f: F.array_contains(wanted, f["rule"]) & ~F.array_contains(acc["seen"], f["rule"]))
        return F.struct(F.array_union(acc["seen"], x["rules"]).alias("seen"), F.concat(acc["out"], fresh).alias("out"))

    once = F.aggregate("scans", start, merged, lambda acc: acc["out"])
    ordered = F.sort_array(
        F.transform(
            once,
            lambda x: F.struct(
                x["start"].alias("start"),
                F.array_position(wanted, x["rule"]).alias("rank"),
                x["end"].alias("end"),
                x["kind"].alias("kind"),
            ),
        )
    )
    # a written table, so that Spark can split a hot blob's paths in a join
    return written(scans.select("blob", ordered.alias("found")), "secret-findings")


def as_text(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined."""
    if kinds is not None:
        names = F.array(*[F.lit(k) for k in kinds])
        found = F.filter(found, lambda x: F.array_contains(names, x["kind"]))
    return F.array_join(
        F.transform(
            found,
            lambda x: F.concat_ws(
                ":", x["kind"], x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )


def find(docs: DataFrame, ledger_path: str | None = None, rules=BASE_RULES) -> DataFrame:
    """One row per path: doc_id, blob, found (its spans)."""
    ledger = scan(docs, ledger_path or fresh_path(docs.sparkSession, "secret-ledger"), rules)
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of(F.col("text")).alias("blob"))
    return paths.join(ledger, "blob", "left").select("doc_id", "blob", "found")


def report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans."""
    base = tuple(r.kind for r in BASE_RULES)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return find(docs, ledger_path).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(as_text(F.col("found"), base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"),
    )


MASK = "[secret]"


def redact(docs: DataFrame, ledger_path: str | None = None, mask: str = MASK) -> DataFrame:
    """The same rows and columns with every found span replaced by ``mask``
    (spans that overlap or touch are one), and ``n_chars`` set anew if there
    is such a column. Texts without findings, null ones too, stay as they are;
    repeated rows stay repeated rows, and an empty table stays empty."""
    ledger = scan(docs, ledger_path or fresh_path(docs.sparkSession, "secret-ledger"))
    named = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mask).alias("mask")))
    hits = ledger.where(F.size("found") > 0).select("blob", named.alias("found"))
    rows = boxed(docs, blob=blob_of(F.col("text"))).join(hits, "blob", "left")
    hit = F.col("found").isNotNull()
    new = {"text": F.when(hit, masked(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        rows = rows.withColumn("clean", new["text"])
        new = {"text": F.col("clean"), "n_chars": F.when(hit, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return unboxed(rows, docs.columns, **new)
