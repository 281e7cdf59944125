"""URL filter: rules, and trust propagated over the link graph for the rest.

A rule is a host and a path with a verdict; it fits a url whose host is the
rule's or a subdomain of it and whose path starts with the rule's. The longest
rule (host and path together) that fits decides; of equally long ones the one
with the longer host, then a block.

Urls without a rule get their host's verdict. The nodes are hosts and the
domains above them; an edge is a hyperlink from a page's host to the host it
links to, weighted by the number of links, or joins a host and the domain one
label above it (both ways, weight 1: who runs a domain runs what is below it;
nobody runs all of a top-level domain, so domains of one label have no edges
of this kind).
Two personalised PageRanks run over it in Spark: trust starts from hosts whose
pages an allow rule accepts, and flows along edges; distrust starts from hosts
whose pages a block rule rejects, and flows against them (linking to a
distrusted host makes a host distrusted). A seed weighs as much as the share
of its pages with that verdict. A host is blocked if its distrust exceeds
``RATIO`` times its trust; a host that neither reaches is allowed.

Both ranks are one table of (kind, node, rank); a round is one join with the
edges and one sum, and every round is a table written to the shared
folder. Edges are summed per host pair before anything else, so a host with a
third of all links is a few rows.

Nulls: a null url, or one without ``://``, has an empty host and path, no rule
fits it, and its verdict is allow; a null html has no links. A null page_id
stays null. Repeated rows stay repeated rows (their links count as often).
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DAMPING = 0.85
ROUNDS = 16
RATIO = 1.25
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: A short list; it becomes one expression.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(text, verdict) of the rule that decides, or null."""
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != BLOCK, r.text))
    found = None
    for r in order:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    kind = "struct<text:string,verdict:string>"
    return F.lit(None).cast(kind) if found is None else found


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (null without a rule), html."""
    return (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            F.col("html").cast("string").alias("html"),
        )
        .withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("by.text").alias("rule"), F.col("by.verdict").alias("verdict"), "html")
    )


def _above(host: Column) -> Column:
    """The domain one label above a host, if it has two labels at least."""
    above = F.regexp_replace(host, r"^[^.]*\.", "")
    return F.when(host.contains(".") & above.contains("."), above)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: hyperlinks between hosts, and domain edges."""
    links = (
        pages.where("host != ''")
        .select(
            F.col("host").alias("src"),
            F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"),
        )
        .withColumn("dst", F.translate("dst", UPPER, LOWER))
        .where("src != dst and dst != ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    links = written(links, "host-links")
    hosts = (
        pages.select("host")
        .unionAll(links.select(F.col("dst").alias("host")))
        .where("host != ''")
        .distinct()
        # the domains above a host, itself included: as many as its labels
        .select(F.split("host", r"\.").alias("labels"))
        .select(
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("labels")),
                    lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
                )
            ).alias("host")
        )
        .where("host != ''")
        .distinct()
    )
    up = hosts.select(F.col("host").alias("src"), _above(F.col("host")).alias("dst")).where(
        "dst is not null and dst != ''"
    )
    both = up.unionAll(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (
        links.unionAll(both.withColumn("weight", F.lit(1.0)))
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def seeds(pages: DataFrame) -> DataFrame:
    """kind (trust or distrust), node, rank: shares of a host's pages that
    rules allow and block."""
    shares = (
        pages.where("host != ''")
        .groupBy("host")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("verdict") == ALLOW).alias("trust"),
            F.count_if(F.col("verdict") == BLOCK).alias("distrust"),
        )
    )
    return shares.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col("host").alias("node"), (F.col(k) / F.col("n")).alias("rank"))
                    for k in ("trust", "distrust")
                ]
            )
        ).alias("x")
    ).select("x.*").where("rank > 0")


def propagate(edges: DataFrame, start: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, node, rank after ``rounds`` rounds from ``start``. Ranks are linear
    in the seeds; both kinds keep the scale of their seeds, so a host with as
    many allowed as blocked pages starts even."""
    start = written(start, "seeds")
    # (written tables on both sides of each join: a host that a third of all
    # hosts link to is then a large partition, which Spark splits)
    out = written(edges.groupBy("src").agg(F.sum("weight").alias("all")), "host-out")
    into = written(edges.groupBy("dst").agg(F.sum("weight").alias("all")), "host-in")
    along = edges.join(out, "src").select(
        F.lit("trust").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), (F.col("weight") / F.col("all")).alias("p")
    )
    against = edges.join(into, "dst").select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("to"), (F.col("weight") / F.col("all")).alias("p")
    )
    steps = written(along.unionAll(against), "host-edges")
    base = start.withColumn("rank", F.col("rank") * (1 - DAMPING))
    rank = start
    for n in range(1, rounds + 1):
        moved = steps.join(rank, ["kind", "node"]).select(
            "kind", F.col("to").alias("node"), (F.col("p") * F.col("rank") * DAMPING).alias("rank")
        )
        rank = moved.unionAll(base).groupBy("kind", "node").agg(F.round(F.sum("rank"), 12).alias("rank"))
        if n < rounds:
            rank = written(rank, "host-ranks")
    return rank


def host_verdicts(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, verdict of every node that a rank reaches."""
    ranks = propagate(host_edges(pages), seeds(pages), rounds)
    return (
        ranks.groupBy(F.col("node").alias("host"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
            F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"),
        )
        .withColumn("verdict", F.when(F.col("distrust") > RATIO * F.col("trust"), BLOCK).otherwise(ALLOW))
    )


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = judged(pages, rules)
    hosts = host_verdicts(rows).select("host", F.col("verdict").alias("by_host"))
    return (
        rows.drop("html")
        .join(written(hosts, "host-verdicts"), "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit(ALLOW)).alias("verdict"))
    )


