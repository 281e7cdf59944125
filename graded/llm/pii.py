"""Personal data by boosted trees over candidate spans (DataFrame functions
and Spark ML only).

Generators with high recall propose spans, which may overlap: for every kind
the *base* pattern, and a narrower one that finds a value by its own shape
where its neighbours run into it (a number behind a card number makes one long
run of digits, which the base pattern drops). Base spans that pass their check
are results in any case. Every other candidate is scored by gradient-boosted
trees over features of its format (digits, groups, check digits, largest part
of an address) and its context (characters beside it, digits and telling words
before it), and kept if its score reaches its kind's threshold.

No table says where personal data is, so the trees learn from the texts
themselves: candidates of a sound shape with free edges are taken as true,
those of an unsound one as false, and so are true ones that are damaged (a
wrong check digit, a part out of range, letters glued to it). Every candidate
of every text counts, a repeated text's once; half of the texts are learnt
from, half set the thresholds: for each kind the lowest score, in steps of
1/``STEPS``, above which ``PRECISION`` of the candidates are true. Candidates
of equal features are one example with their number as its weight, so the trees
pass over far fewer rows than there are candidates. (As always, Spark ML's trees
take the places where a feature may be split from a sample of the examples;
gains, leaves and scores come from all of them.) The trees become one SQL
expression, so all texts are scored in a single scan without an exchange.

Nulls: a null text is empty; a null id stays null. Repeated rows stay repeated
rows. Very long texts are scanned whole, in time that grows with their length.
Without candidates of both classes to learn from (an empty table, too) there
are no spans but the base ones. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import found, masked

PRECISION = 0.995
TREES = 12
DEPTH = 4
SEED = 13
STEPS = 8192  # of a score: so many thresholds are compared (a power of two, so that no score is rounded)

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Quantifiers give nothing back and a match starts where a run
#: starts (or the match before ends), so that a long run is read once; the
#: matches are those of the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

NARROW = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{15,19})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}

#: What a text must hold to have any candidate at all, a cheap test.
ANY = r"@|[0-9][\x20.-]?[0-9]|\+[0-9]|[\[({]at[\])}]"

#: Words before a value that tell its kind.
CUES = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|addr|login|client",
    "card": r"(?i)card|visa|master|amex|karte|tarjeta|carte|credit",
    "phone": r"(?i)phone|tel|call|mobile|fax|handy|anruf|llama|appel",
}

CANDIDATE = "struct<kind:string,start:int,end:int,base:boolean,value:string,before:string,after:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether the digits' check digit is right."""
    each = F.transform(
        F.split(F.reverse(number), "(?<=.)(?=.)"),
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(  # (no digit: null)
            2 * c.try_cast("int") - F.when(c.try_cast("int") > 4, F.lit(9)).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def largest_part(value: Column) -> Column:
    """The largest number between the dots (999 for one of more digits)."""
    parts = F.transform(
        F.split(value, r"\."),
        lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, F.lit(999)).otherwise(
            F.coalesce(F.regexp_replace(p, "[^0-9]", "").try_cast("int"), F.lit(0))
        ),
    )
    return F.array_max(parts)


def passes(kind: str, value: Column) -> Column:
    """The check of a base match."""
    n = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": largest_part(value) <= 255,
        "card": n.between(16, 19) & luhn(digits(value)),
        "phone": n.between(8, 15),
    }[kind]


FEATURES = (
    "kind", "length", "digits", "letters", "other", "distinct_digits", "luhn", "largest_part", "first_digit", "plus",
    "glued_before", "glued_after", "mark_before", "mark_after", "digits_before", "cue", "last_label", "groups",
    "longest_group", "shortest_group",
)


def features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """The numbers named in ``FEATURES``."""
    only = digits(value)
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(0.0)
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]+", ""))
    groups = F.transform(F.array_remove(F.split(value, "[^0-9]+"), ""), lambda g: F.length(g))
    cue = F.lit(0.0)
    for i, k in enumerate(KINDS):
        own = before.rlike(CUES[k])
        cue = cue + F.when(own & (kind == k), F.lit(1.0)).when(own, F.lit(0.25)).otherwise(0.0)
    which = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    numbers = [
        which,
        F.length(value),
        F.length(only),
        letters,
        F.length(value) - F.length(only) - letters,
        F.size(F.array_distinct(F.split(only, "(?<=.)(?=.)"))),
        flag(luhn(only)),
        F.when(kind == "ip", largest_part(value)).otherwise(-1),
        F.coalesce(F.substring(only, 1, 1).try_cast("int"), F.lit(-1)),
        flag(value.startswith("+")),
        flag(before.rlike(r"[\p{L}0-9_]$")),
        flag(after.rlike(r"^[\p{L}0-9_]")),
        flag(before.rlike(r"[^\p{L}0-9_\s]$")),
        flag(after.rlike(r"^[^\p{L}0-9_\s]")),
        F.length(digits(before)),
        cue,
        F.when(kind == "email", F.length(F.regexp_extract(value, r"([A-Za-z]+)$", 1))).otherwise(-1),
        F.size(groups),
        F.coalesce(F.array_max(groups), F.lit(0)),
        F.coalesce(F.array_min(groups), F.lit(0)),
    ]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in numbers])


def candidates(text: Column, kind: str, base: bool) -> Column:
    """Array of the spans that the kind's base pattern (those that pass their
    check, ``base`` being true, and those that don't), or its narrow one,
    proposes."""
    hits = found(text, (BASE if base else NARROW)[kind])
    return F.transform(
        hits,
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            (passes(kind, x["value"]) if base else F.lit(False)).alias("base"),
            x["value"].alias("value"),
            x["before"].alias("before"),
            x["after"].alias("after"),
        ),
    )


def _sound(kind: Column, value: Column) -> Column:
    """Whether a value's shape is sound."""
    n = F.length(digits(value))
    return (
        F.when(kind == "email", value.rlike(r"[A-Za-z]{2,}$"))
        .when(kind == "ip", (largest_part(value) <= 255) & ~value.rlike(r"(^|\.)0[0-9]"))
        .when(kind == "card", n.between(15, 19) & luhn(digits(value)) & (F.size(F.array_distinct(F.split(digits(value), "(?<=.)(?=.)"))) > 2))
        .otherwise(n.between(8, 15))
    )


def examples(docs: DataFrame) -> DataFrame:
    """kind, features, label, learn (whether it is learnt from, else it sets
    thresholds), n (candidates of these features): a written table of the
    candidates of all texts. Of a text its hash and its candidates move."""
    text = F.col("text").cast("string")
    proposed = F.concat(*[candidates(text, k, base) for k in KINDS for base in (True, False)])
    few = F.transform(proposed, lambda c: F.struct(*[c[n].alias(n) for n in ("kind", "value", "before", "after")]))
    texts = docs.where(text.rlike(ANY)).select(F.xxhash64(text).alias("order"), few.alias("found"))
    texts = texts.where(F.size("found") > 0).groupBy("order").agg(F.min("found").alias("found"))
    rows = texts.select((F.col("order") % 2 == 0).alias("learn"), F.explode("found").alias("c")).select("learn", "c.*")
    free = ~F.col("before").rlike(r"[\p{L}0-9_]$") & ~F.col("after").rlike(r"^[\p{L}0-9_]")
    sound = _sound(F.col("kind"), F.col("value"))
    label = F.when(sound & free, F.lit(1.0)).when(~sound, F.lit(0.0))  # (null: neither)
    rows = rows.withColumn("label", label).where("label is not null")
    value = F.col("value")
    last = F.substring(value, -1, 1).try_cast("int")
    wrong = (
        F.when(value.rlike("[0-9]$") & (F.col("kind") == "card"), F.concat(F.expr("left(value, length(value) - 1)"), ((last + 3) % 10).cast("string")))
        .when(F.col("kind") == "ip", F.concat(F.lit("9"), F.lpad(value, 15, "7")))
        .when(F.col("kind") == "phone", F.expr("left(value, 7)"))
        .otherwise(F.regexp_replace(value, r"[A-Za-z]+$", "1"))
    )

    def variant(value: Column, before: Column, after: Column, label: Column) -> Column:
        return F.struct(value.alias("value"), before.alias("before"), after.alias("after"), label.alias("label"))

    before, after, false = F.col("before"), F.col("after"), F.lit(0.0)
    own = F.array(variant(value, before, after, F.col("label")))
    damaged = F.array(
        variant(wrong, before, after, false),
        variant(value, F.concat(before, F.lit("c")), after, false),
        variant(value, before, F.concat(F.lit("e"), after), false),
    )
    variants = F.when(F.col("label") == 1, F.concat(own, damaged)).otherwise(own)
    rows = rows.select("learn", "kind", F.explode(variants).alias("v")).select("learn", "kind", "v.*")
    made = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    same = ["learn", "kind", "label", "features"]
    rows = rows.select("learn", "kind", "label", made.alias("features"))
    return written(rows.groupBy(*same).agg(F.count("*").alias("n")), "pii-examples")


@dataclass(frozen=True)
class Model:
    """Trees as a SQL expression over ``f`` (an array of features), and a
    threshold for each kind."""

    score: str
    thresholds: dict[str, float]


def _tree(node, weight: float) -> str:
    """SQL of one tree, times its weight."""
    if node.subtreeDepth() == 0:
        return f"{weight * node.prediction()!r}D"
    split = node.split()
    left, right = _tree(node.leftChild(), weight), _tree(node.rightChild(), weight)
    return f"IF(f[{split.featureIndex()}] <= {split.threshold()!r}D, {left}, {right})"


def as_sql(model: GBTClassificationModel) -> str:
    """The model's probability of class 1."""
    trees = [_tree(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights)]
    return f"1D / (1D + exp(-2D * ({' + '.join(trees)})))"


def fit(docs: DataFrame) -> Model | None:
    """None if the texts learnt from don't hold both classes."""
    rows = examples(docs)
    learnt = rows.where("learn").select("label", F.col("n").cast("double").alias("n"), array_to_vector("features").alias("features"))
    if learnt.select("label").distinct().count() < 2:
        return None
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, labelCol="label", featuresCol="features", weightCol="n")
    score = as_sql(booster.fit(learnt))
    step = F.expr(f"cast(floor({STEPS} * transform(array(features), f -> {score})[0]) as int)").alias("step")
    scored = rows.where("not learn").select("kind", "label", "n", step)
    # at most STEPS + 1 rows for a kind, however many candidates
    true = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("true")
    steps = scored.groupBy("kind", "step").agg(true, F.sum("n").alias("all")).collect()
    thresholds = {}
    for kind in KINDS:
        true = total = 0
        for row in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            true, total = true + row["true"], total + row["all"]
            if true >= PRECISION * total:
                thresholds[kind] = row["step"] / STEPS
    return Model(score, thresholds)


SPANS = "array<struct<start:int,end:int>>"


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (id, text) with an array of spans for each kind:
    base_<kind>, and added_<kind>, in order of start."""
    out = docs
    for kind in KINDS:
        some = F.col("text").rlike(ANY)
        empty = F.array().cast(f"array<{CANDIDATE}>")
        base = F.when(some, candidates(F.col("text"), kind, True)).otherwise(empty)
        out = out.withColumn(f"wide_{kind}", base)
        narrow = F.when(some, candidates(F.col("text"), kind, False)).otherwise(empty)
        out = out.withColumn(f"narrow_{kind}", narrow)
    spans = lambda found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    keys = lambda found: F.transform(found, lambda x: x["start"].cast("long") * 2**32 + x["end"])
    columns = []
    for kind in KINDS:
        base = F.filter(f"wide_{kind}", lambda x: x["base"])
        columns.append(spans(base).alias(f"base_{kind}"))
        if model is None or kind not in model.thresholds:
            columns.append(F.array().cast(SPANS).alias(f"added_{kind}"))
            continue
        least = model.thresholds[kind]
        fresh = F.array_except(keys(F.col(f"narrow_{kind}")), keys(base))  # (hashed, so a long list takes no longer)
        made = F.transform(
            F.filter(f"narrow_{kind}", lambda x: x["value"].isNotNull()),
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), features(x["kind"], x["value"], x["before"], x["after"]).alias("f")
            ),
        )
        out = out.withColumn(f"made_{kind}", F.when(F.size(fresh) > 0, made))
        kept = F.expr(f"filter(made_{kind}, x -> transform(array(x.f), f -> {model.score})[0] >= {least!r}D)")
        new = F.array_except(keys(kept), keys(base))
        back = F.transform(
            new, lambda k: F.struct(F.shiftright(k, 32).cast("int").alias("start"), k.bitwiseAND(2**32 - 1).cast("int").alias("end"))
        )
        columns.append(F.coalesce(back, F.array().cast(SPANS)).alias(f"added_{kind}"))
    return out.select(*docs.columns, *columns)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, base spans of each kind (n_<kind>), the digest of the base
    spans, all spans, and how many of them the trees added. Without a model
    one is fitted on ``docs``."""
    rows = find(_rows(docs), fit(docs) if model is None else model)

    def of(kind: str, arrays: tuple[str, ...]) -> Column:
        name = lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
        return F.transform(F.array_sort(F.concat(*[F.col(f"{a}_{kind}") for a in arrays])), name)

    def told(*arrays: str) -> Column:
        return F.concat(*[of(kind, arrays) for kind in KINDS])

    return rows.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(told("base"), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(told("base", "added"), ",").alias("spans"),
        sum((F.size(f"added_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets (spans
    that overlap or touch are one); null texts stay null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = find(rows, fit(docs) if model is None else model)

    def of(kind: str, array: str) -> Column:
        mask = F.lit(f"[{kind}]").alias("mask")
        return F.transform(f"{array}_{kind}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), mask))

    spans = F.array_sort(F.concat(*[of(k, a) for k in KINDS for a in ("base", "added")]))
    return rows.withColumn("found", spans).select("doc_id", masked(F.col("text"), F.col("found")).alias("text"))
