"""The query catalogue: one Spark query and (where SQL can say it) one DuckDB
oracle per operator of the inventory. Every query reads the whole given
tables at ``sf_dir``; column names match between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graded.functions import parsing as X
from graded.functions.prompts import TRAIN_TEMPLATE
from graded.operators import metrics as A
from graded.plans import evaluations as E
from graded.plans import oracle as O
from graded.plans import standin
from graded.sources.corpus import load_corpus

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


CORPUS = O.corpus()
GEN_SQL = (
    f"SELECT *, {O.standin_generation('prompt')} AS full_text FROM "
    f"(SELECT *, {O.render(O.lit(TRAIN_TEMPLATE), 'text')} AS prompt FROM ({CORPUS}) c) g"
)


# ------------------------------------------------------------------ E1 (flagship)

_E1_ROWS = (
    f"SELECT *, {O.parse_lenient('answer')} AS pred FROM "
    f"(SELECT *, {O.completion_slice('full_text', 'prompt')} AS answer FROM ({GEN_SQL}) g) a"
)


@query("e1_eval_by_lang", O.evaluate(_E1_ROWS, ["lang"]))
def e1_eval_by_lang(spark, sf_dir):
    """Flagship: documents ⋈ labels -> P2 -> stand-in generation -> X1 -> X6 -> A9 per lang."""
    return E.e1_current(load_corpus(spark, sf_dir), by=("lang",))


@query("e1_eval_by_split", O.evaluate(_E1_ROWS, ["split"]))
def e1_eval_by_split(spark, sf_dir):
    return E.e1_current(load_corpus(spark, sf_dir), by=("split",))


# ------------------------------------------------------------------ S1, S2


@query("s1_corpus", f"SELECT example_id, split, text, label, lang FROM ({CORPUS}) c")
def s1_corpus(spark, sf_dir):
    return load_corpus(spark, sf_dir)


@query(
    "s1_test_split",
    f"SELECT example_id, text, label FROM ({O.corpus(split='test')}) c",
)
def s1_test_split(spark, sf_dir):
    return load_corpus(spark, sf_dir, split="test").select("example_id", "text", "label")


@query(
    "s2_split_sizes",
    f"SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_pos FROM ({CORPUS}) c GROUP BY split",
)
def s2_split_sizes(spark, sf_dir):
    return (
        load_corpus(spark, sf_dir)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_pos"))
    )


# ------------------------------------------------------------------ X parsers


_ANSWERS_SQL = f"SELECT example_id, label, {O.standin_answer()} AS answer FROM ({CORPUS}) c"


@query(
    "x_parse_answers",
    f"SELECT example_id, label, answer, {O.parse_last_word('answer')} AS pred_last_word, "
    f"{O.parse_lenient('answer')} AS pred_lenient, {O.parse_strict('answer')} AS pred_strict "
    f"FROM ({_ANSWERS_SQL}) a",
)
def x_parse_answers(spark, sf_dir):
    """X5, X6, X7 side by side over every labelled document's answer."""
    df = load_corpus(spark, sf_dir).select("example_id", "label", standin.standin_answer().alias("answer"))
    return df.select(
        "example_id",
        "label",
        "answer",
        X.parse_last_word("answer").alias("pred_last_word"),
        X.parse_lenient("answer").alias("pred_lenient"),
        X.parse_strict("answer").alias("pred_strict"),
    )


def _parser_counts_spark(spark, sf_dir, parser):
    df = load_corpus(spark, sf_dir).withColumn("answer", standin.standin_answer())
    df = df.withColumn("pred", X.PARSERS[parser]("answer"))
    return A.confusion(df, None)


def _parser_counts_sql(fn):
    return f"SELECT label, pred, count(*) AS n FROM (SELECT label, {fn('answer')} AS pred FROM ({_ANSWERS_SQL}) a) p GROUP BY label, pred"


for _p, _fn in (("lenient", O.parse_lenient), ("strict", O.parse_strict), ("last_word", O.parse_last_word)):
    QUERIES[f"a1_confusion_{_p}"] = (lambda p: (lambda spark, sf_dir: _parser_counts_spark(spark, sf_dir, p)))(_p)
    ORACLE[f"a1_confusion_{_p}"] = _parser_counts_sql(_fn)


_ROBUST_SQL = (
    f"SELECT example_id, split, label, {O.narrow(O.completion_robust('full_text', 'prompt', 'text'))} AS answer "
    f"FROM ({GEN_SQL}) g"
)


@query("x2_x3_robust_extraction", f"SELECT example_id, label, answer, {O.parse_strict('answer')} AS pred FROM ({_ROBUST_SQL}) r")
def x2_x3_robust_extraction(spark, sf_dir):
    g = E.generations(load_corpus(spark, sf_dir))
    g = g.select("example_id", "label", X.narrow(X.completion_robust("full_text", "prompt", "text")).alias("answer"))
    return g.withColumn("pred", X.parse_strict("answer"))


# ------------------------------------------------------------------ E2-E5


_E2_ROWS = f"SELECT split, label, {O.parse_strict('answer')} AS pred FROM ({_ROBUST_SQL}) r"


@query("e2_eval_strict", O.evaluate(_E2_ROWS, ["split"]))
def e2_eval_strict(spark, sf_dir):
    return E.e2_strict(load_corpus(spark, sf_dir), by=("split",))


def _e3_sql(prompts=("same", "CoT")):
    from graded.functions.prompts import choose_template

    parts = []
    for p in prompts:
        gen = (
            f"SELECT *, {O.standin_generation('prompt', salt='md5(prompt)')} AS full_text FROM "
            f"(SELECT *, {O.render(O.lit(choose_template(p, 'variants')), 'text')} AS prompt FROM ({CORPUS}) c) g"
        )
        parts.append(
            f"SELECT {O.lit(p)} AS prompt_name, split, label, "
            f"{O.parse_lenient(O.narrow(O.completion_robust('full_text', 'prompt', 'text')))} AS pred FROM ({gen}) g"
        )
    return O.evaluate(" UNION ALL ".join(parts), ["prompt_name", "split"])


@query("e3_eval_prompt_variants", _e3_sql())
def e3_eval_prompt_variants(spark, sf_dir):
    return E.e3_prompt_variants(load_corpus(spark, sf_dir), by=("split",))


# a prompt of the user's own: anything that names no built-in template
CUSTOM_PROMPT = 'Lees deze zin: "{text}" Is de zin bevooroordeeld? Antwoord met ja of nee.'


@query("p3_custom_prompt", _e3_sql(("same", CUSTOM_PROMPT)))
def p3_custom_prompt(spark, sf_dir):
    """P3 with a custom prompt next to a built-in one."""
    return E.e3_prompt_variants(load_corpus(spark, sf_dir), prompts=("same", CUSTOM_PROMPT), by=("split",))


def _e4_sql():
    rows = (
        f"SELECT split, {O.parse_last_word(O.standin_answer())} AS pred, "
        f"{O.parse_last_word(O.label_word('label'))} AS label_parsed FROM ({CORPUS}) c"
    )
    counts = (
        "SELECT split, count(*) AS n, count(*) FILTER (WHERE pred = -1) AS inv_p, "
        "count(*) FILTER (WHERE label_parsed = -1) AS inv_l, "
        "count(*) FILTER (WHERE label_parsed = 1 AND pred = 1) AS n11, "
        "count(*) FILTER (WHERE label_parsed = 1 AND pred = 0) AS n10, "
        "count(*) FILTER (WHERE label_parsed = 0 AND pred = 1) AS n01, "
        "count(*) FILTER (WHERE label_parsed = 0 AND pred = 0) AS n00 "
        f"FROM ({rows}) r GROUP BY split"
    )
    s = O._binary_scores_sql()
    none = "(n11 + n10 + n01 + n00) = 0"

    def sc(x):
        return f"(CASE WHEN {none} THEN 0.0 ELSE {x} END)"

    def pct(c):
        return f"(CASE WHEN n = 0 THEN 0.0 WHEN {none} THEN 100.0 ELSE CAST({c} AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 END)"

    return (
        f"SELECT split, {sc(s['accuracy'])} AS accuracy, {sc(s['f1_macro'])} AS f1_macro, "
        f"{sc(s['precision_macro'])} AS precision_macro, {sc(s['recall_macro'])} AS recall_macro, "
        f"{pct('inv_p')} AS invalid_preds_percent, {pct('inv_l')} AS invalid_labels_percent FROM ({counts}) c"
    )


@query("e4_eval_training_time", _e4_sql())
def e4_eval_training_time(spark, sf_dir):
    return E.e4_training_time(load_corpus(spark, sf_dir), by=("split",))


_E5_ROWS = (
    f"SELECT split, {O.parse_biased(f'lower({O.standin_biased_answer()})')} AS pred, "
    f"{O.parse_biased(O.label_word('label', 'biased', 'niet-biased'))} AS label_parsed FROM ({CORPUS}) c"
)


@query("e5_eval_generative", O.macro(_E5_ROWS, ["split"], "label_parsed", "pred", with_invalid=True))
def e5_eval_generative(spark, sf_dir):
    return E.e5_generative(load_corpus(spark, sf_dir), by=("split",))


# ------------------------------------------------------------------ A-metrics over E1 rows


def _e1_rows(spark, sf_dir):
    g = E.generations(load_corpus(spark, sf_dir))
    g = g.withColumn("answer", X.completion_slice("full_text", "prompt"))
    return g.withColumn("pred", X.parse_lenient("answer"))


@query("a3_per_class", O.per_class(_E1_ROWS, ["split"]))
def a3_per_class(spark, sf_dir):
    return A.per_class(_e1_rows(spark, sf_dir), ["split"])


@query("a5_macro_micro", O.macro(_E1_ROWS, ["lang"]))
def a5_macro_micro(spark, sf_dir):
    """A2, A5, A6 with -1 kept as a class (no P9 filter)."""
    return A.macro(_e1_rows(spark, sf_dir), ["lang"])


_E1_VALID = f"SELECT * FROM ({_E1_ROWS}) v WHERE pred <> -1"


@query("a5_macro_valid_rows", O.macro(_E1_VALID, ["split"]))
def a5_macro_valid_rows(spark, sf_dir):
    """P9 then A2/A5/A6 (generic class-set form of A9's averages)."""
    return A.macro(_e1_rows(spark, sf_dir).filter(F.col("pred") != -1), ["split"])


@query(
    "a12_class_counts",
    "SELECT split, count(*) FILTER (WHERE pred <> -1 AND pred = 1) AS pos_preds, "
    "count(*) FILTER (WHERE pred <> -1 AND pred = 0) AS neg_preds, "
    "count(*) FILTER (WHERE pred <> -1 AND label = 1) AS pos_labels, "
    f"count(*) FILTER (WHERE pred <> -1 AND label = 0) AS neg_labels FROM ({_E1_ROWS}) r GROUP BY split",
)
def a12_class_counts(spark, sf_dir):
    return A.class_counts(_e1_rows(spark, sf_dir), ["split"])


@query(
    "a13_class_weights",
    "SELECT split, label, n_c, CAST(sum(n_c) OVER (PARTITION BY split) AS DOUBLE) / "
    "CAST(count(*) OVER (PARTITION BY split) * n_c AS DOUBLE) AS weight FROM "
    f"(SELECT split, label, count(*) AS n_c FROM ({CORPUS}) c GROUP BY split, label) t",
)
def a13_class_weights(spark, sf_dir):
    return A.class_weights(load_corpus(spark, sf_dir), ["split"])


# ------------------------------------------------------------------ R sampling, U set operations

from graded.functions.prompts import SWEEP_TEMPLATES  # noqa: E402
from graded.operators import sampling as R  # noqa: E402

TRAIN_SQL = f"SELECT example_id, label FROM ({O.corpus(split='train')}) c"
TEST_SQL = O.corpus(split="test")


def _train(spark, sf_dir):
    return load_corpus(spark, sf_dir, split="train").select("example_id", "label")


@query("r1_undersample", O.undersample(TRAIN_SQL))
def r1_undersample(spark, sf_dir):
    """R1 + U1: positives UNION ALL round(0.7 N0) hash-sampled negatives."""
    return R.undersample(_train(spark, sf_dir)).select("example_id", "label", "copy_no")


@query("r2_oversample", O.oversample(TRAIN_SQL))
def r2_oversample(spark, sf_dir):
    """R2 + U2: positives twice via explode(sequence), negatives once."""
    return R.oversample(_train(spark, sf_dir)).select("example_id", "label", "copy_no")


@query("r3_balanced", O.balance(TRAIN_SQL))
def r3_balanced(spark, sf_dir):
    return R.balance(_train(spark, sf_dir)).select("example_id", "label", "copy_no")


@query("r4_normal", f"SELECT example_id, label, 1 AS copy_no FROM ({TRAIN_SQL}) t")
def r4_normal(spark, sf_dir):
    return R.normal(_train(spark, sf_dir)).select("example_id", "label", "copy_no")


def _r5_sql():
    parts = [
        f"SELECT 'undersample' AS strategy, label, count(*) AS n_rows FROM ({O.undersample(TRAIN_SQL)}) x GROUP BY label",
        f"SELECT 'oversample' AS strategy, label, count(*) AS n_rows FROM ({O.oversample(TRAIN_SQL)}) x GROUP BY label",
        f"SELECT 'balanced' AS strategy, label, count(*) AS n_rows FROM ({O.balance(TRAIN_SQL)}) x GROUP BY label",
        f"SELECT 'normal' AS strategy, label, count(*) AS n_rows FROM ({TRAIN_SQL}) x GROUP BY label",
    ]
    return " UNION ALL ".join(parts)


@query("r5_resample_sizes", _r5_sql())
def r5_resample_sizes(spark, sf_dir):
    """R5 dispatcher + A15 row counts per strategy and class."""
    train = _train(spark, sf_dir)
    out = None
    for st in R.STRATEGIES:
        c = A.count_by(R.resample(train, st), ["label"]).withColumn("strategy", F.lit(st))
        out = c if out is None else out.unionByName(c)
    return out.select("strategy", "label", "n_rows")


@query(
    "r6_shuffle_index",
    f"SELECT example_id, copy_no, row_number() OVER (ORDER BY {O.hash_key(42, 'example_id', 'copy_no')}, example_id, copy_no) - 1 AS idx "
    f"FROM ({O.oversample(TRAIN_SQL)}) o",
)
def r6_shuffle_index(spark, sf_dir):
    """Seeded permutation of the oversampled train split, 0-based index."""
    o = R.oversample(_train(spark, sf_dir))
    return R.shuffle_index(o, 42).select("example_id", "copy_no", "idx")


@query("r7_head_n", f"SELECT example_id, label FROM ({TEST_SQL}) t ORDER BY example_id LIMIT 50")
def r7_head_n(spark, sf_dir):
    """First 50 rows of the test split by key (the limit is the feature)."""
    return R.head_n(load_corpus(spark, sf_dir, split="test").select("example_id", "label"), 50)


@query(
    "r8_random_n",
    f"SELECT example_id, label FROM (SELECT example_id, label, row_number() OVER (ORDER BY {O.hash_key(42, 'example_id')}, example_id) AS rn "
    f"FROM ({TEST_SQL}) t) r WHERE rn <= 50",
)
def r8_random_n(spark, sf_dir):
    """50 rows of the test split without replacement (seeded, exact)."""
    return R.random_n(load_corpus(spark, sf_dir, split="test").select("example_id", "label"), 50, 42)


def _templates_sql():
    rows = ", ".join(f"({O.lit(n)}, {O.lit(b)}, {O.lit(p)}, {m})" for n, b, p, m in SWEEP_TEMPLATES)
    return f"(VALUES {rows}) AS tpl(template, body, placeholder, max_new_tokens)"


def _e6_sample_sql(n=50, seed=42):
    return (
        f"SELECT * FROM (SELECT c.example_id, c.text, c.label, tpl.*, row_number() OVER (PARTITION BY tpl.template "
        f"ORDER BY {O.hash_key(seed, 'tpl.template', 'c.example_id')}, c.example_id) AS rn "
        f"FROM ({TEST_SQL}) c, {_templates_sql()}) s WHERE rn <= {n}"
    )


def _e6_rows_sql():
    full = O.strip(O.standin_digit_answer("template", "example_id", "label", "max_new_tokens"))
    inner = f"SELECT template, example_id, text, label, {full} AS full_text FROM ({_e6_sample_sql()}) s"
    return (
        f"SELECT template, example_id, text, label AS true_label, {O.parse_last_digit('full_text')} AS pred_label, "
        f"{O.reasoning('full_text')} AS reasoning FROM ({inner}) i"
    )


def _e6_rows(spark, sf_dir):
    test = load_corpus(spark, sf_dir, split="test").select("example_id", "text", "label")
    # ids and labels are sampled; only the sampled rows meet their texts
    ids = E.explode_templates(test.select("example_id", "label"))
    sample = R.sample_per_group(ids, "template", 50, 42)
    return E.e6_predictions(sample.join(test.select("example_id", "text"), "example_id"))


def _e6_all_sql():
    """Prediction rows of every example under every template."""
    full = O.strip(O.standin_digit_answer("template", "example_id", "label", "max_new_tokens"))
    rows = f"SELECT c.example_id, c.text, c.label, tpl.* FROM ({CORPUS}) c, {_templates_sql()}"
    inner = f"SELECT template, example_id, text, label, {full} AS full_text FROM ({rows}) s"
    return (
        f"SELECT template, example_id, text, label AS true_label, {O.parse_last_digit('full_text')} AS pred_label, "
        f"{O.reasoning('full_text')} AS reasoning FROM ({inner}) i"
    )


def _e6_all(spark, sf_dir):
    c = load_corpus(spark, sf_dir).select("example_id", "text", "label")
    return E.e6_predictions(E.explode_templates(c))


@query("r9_e6_template_sweep_rows", _e6_rows_sql())
def r9_e6_template_sweep_rows(spark, sf_dir):
    """J2 + R9 + X9 + X10: every template draws its own 50 test rows; digit
    label and reasoning of each stand-in output (S7 row shape)."""
    return _e6_rows(spark, sf_dir)


def _a11_sql():
    kept = "pred_label IS NOT NULL"
    c = (
        f"SELECT template, count(*) FILTER (WHERE {kept}) AS n_evaluated, "
        f"count(*) FILTER (WHERE {kept} AND true_label = pred_label) AS n_right, "
        f"count(*) FILTER (WHERE {kept} AND true_label = 1 AND pred_label = 1) AS tp, "
        f"count(*) FILTER (WHERE {kept} AND true_label <> 1 AND pred_label = 1) AS fp, "
        f"count(*) FILTER (WHERE {kept} AND true_label = 1 AND pred_label <> 1) AS fn "
        f"FROM ({_e6_rows_sql()}) r GROUP BY template"
    )

    def fmt(x):
        return f"(CASE WHEN n_evaluated = 0 THEN 'N/A' ELSE printf('%.2f', {x}) END)"

    return (
        f"SELECT template, CAST(n_evaluated AS BIGINT) AS n_evaluated, {fmt(O.ratio('n_right', 'n_evaluated'))} AS accuracy, "
        f"{fmt(O.ratio('tp', 'tp + fp'))} AS precision, {fmt(O.ratio('tp', 'tp + fn'))} AS recall, "
        f"{fmt(O.ratio('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM ({c}) c"
    )


@query("a11_e6_template_summary", _a11_sql())
def a11_e6_template_summary(spark, sf_dir):
    """E6 summary: per template, NULL predictions dropped, 2-decimal text."""
    return A.template_summary(_e6_rows(spark, sf_dir))


@query(
    "r10_inspect_template_4",
    f"SELECT template, example_id, pred_label, 'labelled' AS kind FROM (SELECT *, row_number() OVER (ORDER BY "
    f"{O.hash_key(42, 'example_id')}, example_id) AS rn FROM ({_e6_rows_sql()}) r WHERE template = 'template_4' "
    f"AND pred_label IS NOT NULL) x WHERE rn <= 5 UNION ALL SELECT template, example_id, pred_label, 'no_label' AS kind "
    f"FROM ({_e6_rows_sql()}) r WHERE template = 'template_4' AND pred_label IS NULL",
)
def r10_inspect_template_4(spark, sf_dir):
    """5 labelled rows of template_4 plus all its rows without a label."""
    return R.inspect(_e6_rows(spark, sf_dir), "template_4", 5, 42).select("template", "example_id", "pred_label", "kind")


@query(
    "r11_length_batches",
    "SELECT example_id, copy_no, idx, block, block * 50 + (row_number() OVER (PARTITION BY block ORDER BY n_tokens DESC, idx) - 1) // 8 AS batch "
    f"FROM (SELECT *, idx // 400 AS block FROM (SELECT example_id, copy_no, n_tokens, row_number() OVER (ORDER BY "
    f"{O.hash_key(42, 'example_id', 'copy_no')}, example_id, copy_no) - 1 AS idx FROM (SELECT o.example_id, o.copy_no, "
    f"{O.n_words('c.text')} AS n_tokens FROM ({O.oversample(TRAIN_SQL)}) o JOIN ({O.corpus(split='train')}) c "
    f"ON o.example_id = c.example_id) j) i) b",
)
def r11_length_batches(spark, sf_dir):
    """Random blocks of 8 x 50 rows, each sorted by word count."""
    from graded.functions.text import n_words

    train = load_corpus(spark, sf_dir, split="train").withColumn("n_tokens", n_words("text"))
    o = R.oversample(train.select("example_id", "label", "n_tokens"))
    return R.length_batches(o, 8, 42, 50, "n_tokens").select("example_id", "copy_no", "idx", "block", "batch")


@query(
    "u3_distinct_classes",
    f"SELECT split, cls, count(*) AS n_mentions FROM (SELECT split, label AS cls FROM ({_E1_ROWS}) r "
    f"UNION ALL SELECT split, pred AS cls FROM ({_E1_ROWS}) r) u GROUP BY split, cls",
)
def u3_distinct_classes(spark, sf_dir):
    return A.distinct_classes(_e1_rows(spark, sf_dir), ["split"])


# ------------------------------------------------------------------ V arrays, encoding, losses; W1; V13

from graded.functions import arrays as V  # noqa: E402
from graded.functions.prompts import FINETUNE_TEMPLATE, render_prompt  # noqa: E402
from graded.operators import chat as CH  # noqa: E402
from graded.operators import encode as EN  # noqa: E402
from graded.operators import windows as WN  # noqa: E402
from graded.session import table  # noqa: E402

TOKENS_RE = EN.TOKEN_SPLIT


def _tokens_sql(x):
    return f"list_filter(string_split_regex(lower({x}), {O.lit(TOKENS_RE)}), lambda w: w <> '')"


def _vocab_sql(text_src):
    counts = f"SELECT word, count(*) AS cnt FROM (SELECT unnest({_tokens_sql('text')}) AS word FROM ({text_src}) s) t GROUP BY word"
    return f"SELECT word, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, word) + 1 AS INTEGER) AS id FROM ({counts}) c"


def _encode_sql(src, vocab_sql, key="example_id", max_len=512, text="text"):
    toks = f"SELECT {key}, {_tokens_sql(text)} AS toks FROM ({src}) s"
    # positions 0 .. min(len, max_len) - 1 via a lateral series and list
    # indexing (DuckDB's join of unnested strings hits an internal error)
    pos = (
        f"SELECT t.{key}, g.pos, t.toks[g.pos + 1] AS word FROM ({toks}) t, "
        f"generate_series(0, least(len(t.toks), {max_len}) - 1) AS g(pos)"
    )
    joined = f"SELECT p.{key}, p.pos, coalesce(v.id, 1) AS id FROM ({pos}) p LEFT JOIN ({vocab_sql}) v ON p.word = v.word"
    enc = f"SELECT {key}, list(id ORDER BY pos) AS input_ids FROM ({joined}) j GROUP BY {key}"
    return (
        f"SELECT k.{key}, coalesce(e.input_ids, []::INTEGER[]) AS input_ids, "
        f"list_transform(coalesce(e.input_ids, []::INTEGER[]), lambda x: 1) AS attention_mask "
        f"FROM (SELECT {key} FROM ({src}) s) k LEFT JOIN ({enc}) e ON k.{key} = e.{key}"
    )


DOCS_SQL = "SELECT doc_id, text FROM documents"


@query("v1_vocabulary", _vocab_sql(DOCS_SQL))
def v1_vocabulary(spark, sf_dir):
    """V1 (part 1): word vocabulary over every word of every document."""
    return EN.build_vocabulary(table(spark, sf_dir, "documents"))


@query("v1_encode", _encode_sql(CORPUS, _vocab_sql(DOCS_SQL), max_len=128))
def v1_encode(spark, sf_dir):
    """V1 (part 2): encode the labelled corpus with the document vocabulary,
    truncated at 128 ids."""
    vocab = EN.build_vocabulary(table(spark, sf_dir, "documents"))
    return EN.encode(load_corpus(spark, sf_dir), vocab, max_len=128)


_V2_PROMPTS = f"SELECT example_id, label, {O.render(O.lit(FINETUNE_TEMPLATE), 'text')} AS text FROM ({CORPUS}) c"
_V2_TARGETS = f"SELECT example_id, {O.label_word('label')} AS text FROM ({CORPUS}) c"
_V2_VOCAB_SRC = f"SELECT text FROM ({_V2_PROMPTS}) a UNION ALL SELECT text FROM ({_V2_TARGETS}) b"


def _v2_sql(cap=512):
    vocab = _vocab_sql(_V2_VOCAB_SRC)
    p = _encode_sql(_V2_PROMPTS, vocab, max_len=cap)
    t = _encode_sql(_V2_TARGETS, vocab, max_len=5)
    return (
        f"SELECT p.example_id, (p.input_ids || t.input_ids)[1:{cap}] AS input_ids, "
        f"list_transform((p.input_ids || t.input_ids)[1:{cap}], lambda x: 1) AS attention_mask, "
        f"(list_transform(p.input_ids, lambda x: -100) || t.input_ids)[1:{cap}] AS labels "
        f"FROM ({p}) p JOIN ({t}) t ON p.example_id = t.example_id"
    )


def _v2_frames(spark, sf_dir, cap=512):
    c = load_corpus(spark, sf_dir)
    prompts = c.select("example_id", "label", render_prompt(FINETUNE_TEMPLATE, "text").alias("text"))
    targets = c.select("example_id", X.label_word("label").alias("text"))
    vocab = EN.build_vocabulary(prompts.select("text").unionByName(targets.select("text")))
    labels = spark.createDataFrame([(y,) for y in (0, 1)], "label int")
    words = EN.encode(labels.select("label", X.label_word("label").alias("text")), vocab, key="label", max_len=5)
    te = F.broadcast(words.select("label", F.col("input_ids").alias("t_ids")))  # a row per class
    pe = EN.encode(prompts, vocab, key=["example_id", "label"], max_len=cap)
    return pe.select("example_id", "label", F.col("input_ids").alias("p_ids")).join(te, "label").drop("label")


@query("v2_causal_examples", _v2_sql())
def v2_causal_examples(spark, sf_dir):
    """V2: prompt ++ target ids, ones mask, -100-masked prompt labels, cap 512."""
    j = _v2_frames(spark, sf_dir)
    ids, mask, labels = V.causal_example("p_ids", "t_ids", 512)
    return j.select("example_id", ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def _v3_sql(n=128):
    enc = _encode_sql(CORPUS, _vocab_sql(DOCS_SQL), max_len=n)
    return (
        f"SELECT example_id, input_ids || list_transform(range({n} - len(input_ids)), lambda x: 0) AS input_ids, "
        f"list_transform(input_ids, lambda x: 1) || list_transform(range({n} - len(input_ids)), lambda x: 0) AS attention_mask "
        f"FROM ({enc}) e"
    )


@query("v3_pad_fixed", _v3_sql())
def v3_pad_fixed(spark, sf_dir):
    """V3: encode to at most 128 ids, pad to exactly 128 with a 0/1 mask."""
    vocab = EN.build_vocabulary(table(spark, sf_dir, "documents"))
    enc = EN.encode(load_corpus(spark, sf_dir), vocab, max_len=128)
    ids, mask = V.pad_to("input_ids", 128, EN.PAD_ID)
    return enc.select("example_id", ids.alias("input_ids"), mask.alias("attention_mask"))


_V4_TARGETS = f"SELECT example_id, {O.label_word('label', 'biased', 'niet-biased')} AS text FROM ({CORPUS}) c"


def _v4_sql():
    enc = _encode_sql(_V4_TARGETS, _vocab_sql(_V4_TARGETS), max_len=3)
    padded = f"SELECT example_id, input_ids || list_transform(range(3 - len(input_ids)), lambda x: 0) AS ids FROM ({enc}) e"
    return (
        f"SELECT example_id, list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels, "
        f"ids AS unmasked FROM ({padded}) p"
    )


@query("v4_v5_label_masks", _v4_sql())
def v4_v5_label_masks(spark, sf_dir):
    """V4 + V5: label words encoded and padded to 3, pad -> -100, and back."""
    c = load_corpus(spark, sf_dir).select("example_id", X.label_word("label", "biased", "niet-biased").alias("text"))
    enc = EN.encode(c, EN.build_vocabulary(c), max_len=3)
    ids, _ = V.pad_to("input_ids", 3, EN.PAD_ID)
    m = enc.select("example_id", V.mask_labels(ids, EN.PAD_ID).alias("labels"))
    return m.withColumn("unmasked", V.unmask_labels("labels", EN.PAD_ID))


def _emb_rows_sql():
    pooled = (
        "list_transform(range(8), lambda d: list_reduce(list_prepend(0.0, list_transform(range(8), "
        "lambda p: CAST(embedding[p * 8 + d + 1] AS DOUBLE))), lambda a, b: a + b) / 8.0)"
    )
    logit = []
    for row, b in zip(HEAD_W, HEAD_B):
        terms = "list_prepend(0.0, list_transform(range(8), lambda d: CAST({w}[d + 1] AS DOUBLE) * pooled[d + 1]))".format(
            w="[" + ", ".join(repr(float(v)) for v in row) + "]"
        )
        logit.append(f"list_reduce({terms}, lambda a, b: a + b) + {float(b)!r}")
    return (
        f"SELECT vec_id, label_bin, pooled, [{', '.join(logit)}] AS logits FROM "
        f"(SELECT vec_id, CAST(label >= 5 AS INTEGER) AS label_bin, {pooled} AS pooled FROM embeddings) e"
    )


# Weights of the stand-in linear head (V8), 2 classes x 8 features.
HEAD_W = (
    (0.3, -0.2, 0.1, 0.0, -0.1, 0.2, -0.3, 0.1),
    (-0.1, 0.2, -0.3, 0.3, 0.1, -0.2, 0.0, 0.2),
)
HEAD_B = (0.05, -0.05)


def _emb_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", (F.col("label") >= 5).cast("int").alias("label_bin"), V.mean_pool("embedding", 8, 8).alias("pooled"))
    return e.withColumn("logits", V.linear_head("pooled", HEAD_W, HEAD_B))


@query(
    "v7_v8_p17_logits",
    "SELECT vec_id, label_bin, list_transform(pooled, lambda x: round(x, 6)) AS pooled, "
    "list_transform(logits, lambda x: round(x, 6)) AS logits, "
    "CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred "
    f"FROM ({_emb_rows_sql()}) r",
)
def v7_v8_p17_logits(spark, sf_dir):
    """V7 mean pooling (8 positions x 8 dims), V8 linear head, P17 argmax."""
    r = _emb_rows(spark, sf_dir)
    return r.select(
        "vec_id",
        "label_bin",
        F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"),
        F.transform("logits", lambda x: F.round(x, 6)).alias("logits"),
        V.argmax("logits").alias("pred"),
    )


_E7_ROWS = (
    f"SELECT label_bin AS label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM ({_emb_rows_sql()}) r"
)


def _report_sql(src, by=()):
    pc = O.per_class(src, list(by))
    sel_by = "".join(f"{b}, " for b in by)
    grp = f" GROUP BY {', '.join(by)}" if by else ""
    agg = (
        f"SELECT {sel_by}{O._ordered_sum('f1')} AS sf1, {O._ordered_sum('precision')} AS sp, {O._ordered_sum('recall')} AS sr, "
        f"list_reduce(list_prepend(0.0, list(precision * support ORDER BY cls)), lambda a, b: a + b) AS wp, "
        f"list_reduce(list_prepend(0.0, list(recall * support ORDER BY cls)), lambda a, b: a + b) AS wr, "
        f"list_reduce(list_prepend(0.0, list(f1 * support ORDER BY cls)), lambda a, b: a + b) AS wf, "
        f"count(*) AS k, sum(tp) AS tp, sum(support) AS n FROM ({pc}) p{grp}"
    )
    return (
        f"SELECT {sel_by}CAST(cls AS VARCHAR) AS row, precision, recall, f1, support FROM ({pc}) p "
        f"UNION ALL SELECT {sel_by}'accuracy' AS row, NULL AS precision, NULL AS recall, {O.ratio('tp', 'n')} AS f1, CAST(n AS BIGINT) AS support FROM ({agg}) a "
        f"UNION ALL SELECT {sel_by}'macro avg' AS row, sp / k, sr / k, sf1 / k, CAST(n AS BIGINT) FROM ({agg}) a "
        f"UNION ALL SELECT {sel_by}'weighted avg' AS row, CASE WHEN n = 0 THEN 0.0 ELSE wp / n END, "
        f"CASE WHEN n = 0 THEN 0.0 ELSE wr / n END, CASE WHEN n = 0 THEN 0.0 ELSE wf / n END, CAST(n AS BIGINT) FROM ({agg}) a"
    )


def _e7_rows(spark, sf_dir):
    r = _emb_rows(spark, sf_dir)
    return r.select(F.col("label_bin").alias("label"), V.argmax("logits").alias("pred"))


@query("e7_classifier_report", _report_sql(_E7_ROWS))
def e7_classifier_report(spark, sf_dir):
    """E7 + A7: classification report of the pooled linear head."""
    return A.report(_e7_rows(spark, sf_dir))


@query("e7_classifier_metrics", O.macro(_E7_ROWS, []))
def e7_classifier_metrics(spark, sf_dir):
    """Accuracy, macro P/R/F1 and micro F1 (A6 = accuracy)."""
    return A.macro(_e7_rows(spark, sf_dir), [])


def _loss_sql(gamma=2.0):
    ce_rows = (
        f"SELECT label_bin, list_max(logits) + ln(list_reduce(list_prepend(0.0, list_transform(logits, "
        f"lambda v: exp(v - list_max(logits)))), lambda a, b: a + b)) - logits[label_bin + 1] AS ce FROM ({_emb_rows_sql()}) r"
    )
    w = (
        "SELECT label_bin, CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(*) OVER () * n_c AS DOUBLE) AS w "
        "FROM (SELECT CAST(label >= 5 AS INTEGER) AS label_bin, count(*) AS n_c FROM embeddings GROUP BY 1) t"
    )
    j = f"SELECT c.ce, w.w FROM ({ce_rows}) c JOIN ({w}) w ON c.label_bin = w.label_bin"
    return (
        f"SELECT round(avg(ce), 6) AS mean_ce, round(avg(w * pow(1.0 - exp(-ce), {gamma!r}) * ce), 6) AS focal_loss, "
        f"round(sum(w * ce) / sum(w), 6) AS weighted_ce, count(*) AS n_rows FROM ({j}) x"
    )


@query("v9_v10_v11_losses", _loss_sql())
def v9_v10_v11_losses(spark, sf_dir):
    """V9 cross-entropy, V10 focal loss (alpha = balanced class weights via
    J4 lookup, gamma 2), V11 weighted CE (sum w*ce / sum w)."""
    r = _emb_rows(spark, sf_dir).withColumn("ce", V.cross_entropy("logits", "label_bin"))
    e = table(spark, sf_dir, "embeddings").select((F.col("label") >= 5).cast("int").alias("label_bin"))
    weights = A.class_weights(e, None, "label_bin").select(F.col("label").alias("label_bin"), F.col("weight").alias("w"))
    j = r.join(F.broadcast(weights), "label_bin")  # J4: one row per class
    return j.agg(
        F.round(F.avg("ce"), 6).alias("mean_ce"),
        F.round(F.avg(V.focal("ce", "w", 2.0)), 6).alias("focal_loss"),
        F.round(F.sum(F.col("w") * F.col("ce")) / F.sum("w"), 6).alias("weighted_ce"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    "v12_label_word_check",
    f"SELECT w AS label_word, count(*) AS n_tokens, min(coalesce(v.id, 1)) AS first_id, "
    f"(count(*) = 1 AND min(coalesce(v.id, 1)) <> 1) AS single_token FROM "
    f"(SELECT t.w, t.toks[g.i] AS word FROM (SELECT w, {_tokens_sql('w')} AS toks FROM (VALUES ('ja'), ('nee')) v(w)) t, "
    f"generate_series(1, len(t.toks)) AS g(i)) x "
    f"LEFT JOIN ({_vocab_sql(_V2_VOCAB_SRC)}) v ON x.word = v.word GROUP BY w",
)
def v12_label_word_check(spark, sf_dir):
    """The label words must each be one known token of the vocabulary."""
    c = load_corpus(spark, sf_dir)
    prompts = c.select(render_prompt(FINETUNE_TEMPLATE, "text").alias("text"))
    targets = c.select(X.label_word("label").alias("text"))
    vocab = EN.build_vocabulary(prompts.unionByName(targets))
    return EN.encode_words(["ja", "nee"], vocab)


def _chat_sql(gen=False):
    ws = (
        "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, "
        "first(role ORDER BY turn) OVER (PARTITION BY conv_id) AS first_role FROM conversations"
    )
    sysb = "(first_role = 'system' AND rn = 1)"
    loop_idx = "(rn - 1 - CAST(first_role = 'system' AS INTEGER))"
    seg = (
        f"CASE WHEN {sysb} THEN {O.lit(CH.START + CH.SYSTEM)} || text || {O.lit(CH.END)} "
        f"WHEN role = 'user' THEN {O.lit(CH.START + CH.USER)} || {O.strip('text')} || {O.lit(CH.END)} "
        f"WHEN role = 'assistant' THEN {O.lit(CH.START + CH.CHATBOT)} || {O.strip('text')} || {O.lit(CH.END)} ELSE '' END"
    )
    bad = f"(NOT {sysb} AND ((role = 'user') <> ({loop_idx} % 2 = 0)))"
    rows = f"SELECT conv_id, turn, {seg} AS seg, {bad} AS bad FROM ({ws}) w"
    tail = O.lit(CH.START + CH.CHATBOT) if gen else "''"
    return (
        f"SELECT conv_id, count(*) AS n_turns, CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN {O.lit(CH.BOS)} || "
        f"string_agg(seg, '' ORDER BY turn) || {tail} END AS rendered, "
        f"CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN {O.lit(CH.ALTERNATION_ERROR)} END AS error FROM ({rows}) r GROUP BY conv_id"
    )


@query("v13_render_chat", _chat_sql(True))
def v13_render_chat(spark, sf_dir):
    """Conversations rendered with the stored chat template (+ generation prefix)."""
    return CH.render_chat(table(spark, sf_dir, "conversations"), add_generation_prompt=True)


def _w1_sql(patience=2):
    e = (
        "SELECT user_id AS run, value AS metric, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events"
    )
    p = f"SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM ({e}) e"
    i = f"SELECT *, (prev_best IS NULL OR metric > prev_best) AS improved FROM ({p}) p"
    li = (
        f"SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_improve FROM ({i}) i"
    )
    r = f"SELECT run, count(*) AS n_epochs, min(CASE WHEN epoch - last_improve >= {patience} THEN epoch END) AS stop_epoch FROM ({li}) l GROUP BY run"
    b = (
        f"SELECT l.run, arg_max(l.epoch, l.epoch) AS best_epoch, arg_max(l.metric, l.epoch) AS best_metric FROM ({li}) l JOIN ({r}) r "
        f"ON l.run = r.run WHERE l.improved AND (r.stop_epoch IS NULL OR l.epoch <= r.stop_epoch) GROUP BY l.run"
    )
    return (
        f"SELECT r.run, CAST(n_epochs AS BIGINT) AS n_epochs, CAST(stop_epoch AS BIGINT) AS stop_epoch, "
        f"CAST(best_epoch AS BIGINT) AS best_epoch, best_metric FROM ({r}) r JOIN ({b}) b ON r.run = b.run"
    )


@query("w1_early_stop", _w1_sql())
def w1_early_stop(spark, sf_dir):
    """Early-stop point and chosen epoch per run over the event log."""
    return WN.early_stop(WN.epoch_log(table(spark, sf_dir, "events")), patience=2)


# ------------------------------------------------------------------ J3 sweep, run tables, reports, S3-S8

from graded.functions import naming as NM  # noqa: E402
from graded.functions.prompts import choose_template, render_few_shot  # noqa: E402
from graded.functions.text import keep_alnum_space, norm, n_words  # noqa: E402
from graded.plans import sweep as SW  # noqa: E402
from graded.plans import sweep_sql as SWS  # noqa: E402
from graded.session import materialize, shared_path  # noqa: E402
from graded.sources import runs as RU  # noqa: E402

_ABBREV_SQL = "(CASE strategy WHEN 'undersample' THEN 'us' WHEN 'oversample' THEN 'os' WHEN 'balanced' THEN 'bl' WHEN 'normal' THEN 'nm' END)"


def _sweep_rows_sql(parser="lenient", src=TEST_SQL, prompts=SW.PROMPTS):
    name = f"{O.lit(SW.MODELS_DIR + '/' + NM.CAUSAL_MODEL + '_')} || {_ABBREV_SQL} || '_seed' || CAST(seed AS VARCHAR)"
    rows = (
        f"SELECT *, {name} AS checkpoint_path, {SWS.spoken('margin')} AS answer FROM "
        f"({SWS.margins(SW.grid(), src, prompts)}) m"
    )
    if parser == "lenient":
        return f"SELECT *, {O.parse_lenient('answer')} AS pred FROM ({rows}) a"
    fn = {"strict": O.parse_strict, "last_word": O.parse_last_word}[parser]
    return f"SELECT *, {fn('narrowed')} AS pred FROM (SELECT *, {O.narrow('answer')} AS narrowed FROM ({rows}) a) n"


def _run_table_sql(parser="lenient"):
    return O.evaluate(_sweep_rows_sql(parser), SW.CELL)


def _test(spark, sf_dir):
    return load_corpus(spark, sf_dir, split="test")


def _run_table(spark, sf_dir, parser="lenient", prompts=SW.PROMPTS):
    return SW.run_table(_test(spark, sf_dir), SW.fit(load_corpus(spark, sf_dir)), parser, prompts)


@query("j3_sweep_run_table", f"SELECT *, 'ok' AS status FROM ({_run_table_sql()}) r")
def j3_sweep_run_table(spark, sf_dir):
    """Strategy x seed x prompt grid, a model fitted for every (strategy,
    seed) on the train split, one A9 record per cell (test split)."""
    return _run_table(spark, sf_dir)


@query(
    "p13_parse_runs",
    "SELECT DISTINCT checkpoint_path, regexp_extract(checkpoint_path, '[^/]*$', 0) AS run_base, "
    "nullif(regexp_extract(regexp_extract(checkpoint_path, '[^/]*$', 0), '^(.*?)_(?:clf_)?(?:us|os|bl|nm)(?:_|$)', 1), '') AS model, "
    "nullif(regexp_extract(regexp_extract(checkpoint_path, '[^/]*$', 0), '_(us|os|bl|nm)(?:_|$)', 1), '') AS strategy_abbrev, "
    "CASE WHEN contains(checkpoint_path, '_WL') THEN 'weighted' WHEN contains(checkpoint_path, '_focal') THEN 'focal' ELSE 'ce' END AS loss, "
    "coalesce(CAST(nullif(regexp_extract(regexp_extract(checkpoint_path, '[^/]*$', 0), '_seed(\\d+)', 1), '') AS INTEGER), 42) AS seed "
    f"FROM ({_run_table_sql()}) r",
)
def p13_parse_runs(spark, sf_dir):
    """P12 names built in the sweep, parsed back by P13."""
    runs = _run_table(spark, sf_dir).select("checkpoint_path").distinct()
    parts = NM.parse_run("checkpoint_path")
    return runs.select("checkpoint_path", *[v.alias(k) for k, v in parts.items()])


@query(
    "s8_list_runs",
    f"SELECT prompt_name, checkpoint_path, f1_macro FROM ({_run_table_sql()}) r "
    f"WHERE starts_with(checkpoint_path, {O.lit(SW.MODELS_DIR + '/' + NM.CAUSAL_MODEL + '_')}) "
    "AND contains(checkpoint_path, 'seed42') AND NOT contains(checkpoint_path, 'WL')",
)
def s8_list_runs(spark, sf_dir):
    """Runs under the models folder with ``seed42`` and without ``WL``."""
    rt = _run_table(spark, sf_dir)
    return RU.list_runs(rt, SW.MODELS_DIR + "/" + NM.CAUSAL_MODEL + "_").select("prompt_name", "checkpoint_path", "f1_macro")


def _runs_by_split_sql():
    return O.evaluate(
        _sweep_rows_sql(src=f"SELECT * FROM ({CORPUS}) c WHERE split <> 'train'", prompts=("same",)),
        ["checkpoint_path", "split"],
    )


@query(
    "s3_s6_run_documents",
    "SELECT checkpoint_path, CAST(NULL AS INTEGER) AS max_samples, "
    + ", ".join(A.A9_FIELDS)
    + f" FROM ({_runs_by_split_sql()}) m WHERE split = 'test'",
)
def s3_s6_run_documents(spark, sf_dir):
    """S3 write nested JSON documents per run (validation + test metrics),
    read them back, S6 flatten the test metrics into the wide run table."""
    c = load_corpus(spark, sf_dir)
    rows = SW.sweep_rows(c.where(F.col("split") != "train"), SW.fit(c), prompts=("same",))
    metrics = A.evaluate(rows, ["checkpoint_path", "split"])
    path = RU.write_run_result(RU.run_documents(metrics), shared_path(spark, "run_documents"))
    return RU.collect_runs(RU.read_run_result(spark, path))


@query(
    "s5_run_table_csv",
    f"SELECT prompt_name AS prompt, checkpoint_path, CAST(NULL AS INTEGER) AS max_samples, {', '.join(A.A9_FIELDS)} FROM ({_run_table_sql()}) r",
)
def s5_run_table_csv(spark, sf_dir):
    """The sweep run table written as CSV (blank max_samples) and read
    back with an explicit schema (prompt-variant table shape)."""
    rt = _run_table(spark, sf_dir).select(
        F.col("prompt_name").alias("prompt"), "checkpoint_path", F.lit(None).cast("int").alias("max_samples"), *A.A9_FIELDS
    )
    path = RU.write_run_table(rt, shared_path(spark, "run_table_csv"))
    return RU.read_run_table(spark, path, extra=("prompt",))


@query(
    "s4_metric_lines",
    "SELECT run, key, value_text FROM (SELECT 'e7' AS run, unnest(['accuracy', 'f1_macro', 'f1_micro', 'precision_macro', 'recall_macro', 'total_chars']) AS key, "
    "unnest([printf('%.4f', accuracy), printf('%.4f', f1_macro), printf('%.4f', f1_micro), printf('%.4f', precision_macro), printf('%.4f', recall_macro), "
    "printf('%.4f', (SELECT sum(n_chars) FROM documents)::DOUBLE)]) AS value_text "
    f"FROM ({O.macro(_E7_ROWS, [])}) m) x",
)
def s4_metric_lines(spark, sf_dir):
    """Classifier metrics written as ``key: value`` lines (4 decimals)
    and read back as (run, key, value_text)."""
    m = A.macro(_e7_rows(spark, sf_dir), []).select(
        F.lit("e7").alias("run"), "accuracy", "f1_macro", "f1_micro", "precision_macro", "recall_macro"
    )
    # a value above 1,000 has no thousands separators
    total = table(spark, sf_dir, "documents").agg(F.sum("n_chars").cast("double").alias("t")).select("t").scalar()
    m = m.withColumn("total_chars", total)
    path = RU.write_metric_lines(m, shared_path(spark, "metric_lines"))
    return RU.read_metric_lines(spark, path).select("run", "key", "value_text")


@query("s7_predictions_parquet", _e6_all_sql())
def s7_predictions_parquet(spark, sf_dir):
    """E6 prediction rows written partitioned by template, read back."""
    path = RU.write_predictions(_e6_all(spark, sf_dir), shared_path(spark, "predictions"))
    return RU.read_predictions(spark, path).select("template", "example_id", "text", "true_label", "pred_label", "reasoning")


@query(
    "a16_best_run_per_strategy",
    "SELECT strategy, prompt_name, arg_max(checkpoint_path, [f1_macro, -seed]) AS best, "
    f"arg_max(seed, [f1_macro, -seed]) AS best_order, max(f1_macro) AS best_value FROM ({_run_table_sql()}) t GROUP BY strategy, prompt_name",
)
def a16_best_run_per_strategy(spark, sf_dir):
    """Best fitted run by macro F1 per strategy and prompt (earliest seed on ties)."""
    return A.best_by(_run_table(spark, sf_dir), ["strategy", "prompt_name"], "checkpoint_path", "f1_macro", "seed")


@query(
    "a17_seed_mean_std",
    "SELECT prompt_name, strategy, count(*) AS n_seeds, round(avg(f1_macro), 9) AS f1_macro_mean, "
    "round(stddev_samp(f1_macro), 9) AS f1_macro_std, round(avg(accuracy), 9) AS accuracy_mean, "
    f"round(stddev_samp(accuracy), 9) AS accuracy_std FROM ({_run_table_sql()}) t GROUP BY prompt_name, strategy",
)
def a17_seed_mean_std(spark, sf_dir):
    """Mean and sample standard deviation over the seeds' fits per strategy."""
    rt = _run_table(spark, sf_dir)
    return rt.groupBy("prompt_name", "strategy").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.round(F.avg("f1_macro"), 9).alias("f1_macro_mean"),
        F.round(F.stddev_samp("f1_macro"), 9).alias("f1_macro_std"),
        F.round(F.avg("accuracy"), 9).alias("accuracy_mean"),
        F.round(F.stddev_samp("accuracy"), 9).alias("accuracy_std"),
    )


@query(
    "a18_prompt_delta",
    "SELECT checkpoint_path, max(f1_macro) FILTER (WHERE prompt_name = 'same') AS f1_same, "
    "max(f1_macro) FILTER (WHERE prompt_name = 'CoT') AS f1_cot, "
    "max(f1_macro) FILTER (WHERE prompt_name = 'same') - max(f1_macro) FILTER (WHERE prompt_name = 'CoT') AS f1_delta "
    f"FROM ({_run_table_sql()}) r GROUP BY checkpoint_path",
)
def a18_prompt_delta(spark, sf_dir):
    """Per run, macro F1 with ``same`` against ``CoT`` (pivot)."""
    rt = _run_table(spark, sf_dir)
    pv = rt.groupBy("checkpoint_path").pivot("prompt_name", ["same", "CoT"]).agg(F.max("f1_macro"))
    return pv.select(
        "checkpoint_path",
        F.col("same").alias("f1_same"),
        F.col("CoT").alias("f1_cot"),
        (F.col("same") - F.col("CoT")).alias("f1_delta"),
    )


@query(
    "a19_parser_side_by_side",
    "SELECT a.prompt_name, a.checkpoint_path, a.f1_macro AS f1_lenient, b.f1_macro AS f1_strict, "
    "a.invalid_percent AS invalid_lenient, b.invalid_percent AS invalid_strict "
    f"FROM ({_run_table_sql('lenient')}) a JOIN ({_run_table_sql('strict')}) b "
    "ON a.prompt_name = b.prompt_name AND a.checkpoint_path = b.checkpoint_path",
)
def a19_parser_side_by_side(spark, sf_dir):
    """Two evaluations (lenient vs strict parser) of the same runs,
    side by side; both are computed in one pass over one sweep."""
    rows = SW.two_parsers(_test(spark, sf_dir), SW.fit(load_corpus(spark, sf_dir)))
    m = A.evaluate_multi(rows, ["prompt_name", "checkpoint_path"], {"lenient": "pred_lenient", "strict": "pred_strict"})
    return m.select(
        "prompt_name",
        "checkpoint_path",
        "f1_macro_lenient",
        "f1_macro_strict",
        "invalid_percent_lenient",
        "invalid_percent_strict",
    ).withColumnsRenamed(
        {
            "f1_macro_lenient": "f1_lenient",
            "f1_macro_strict": "f1_strict",
            "invalid_percent_lenient": "invalid_lenient",
            "invalid_percent_strict": "invalid_strict",
        }
    )


@query(
    "a20_strategy_rank",
    "SELECT prompt_name, strategy, f1_mean, CAST(rank() OVER (PARTITION BY prompt_name ORDER BY f1_mean DESC) AS INTEGER) AS rnk FROM "
    f"(SELECT prompt_name, strategy, round(avg(f1_macro), 9) AS f1_mean FROM ({_run_table_sql()}) t GROUP BY prompt_name, strategy) m",
)
def a20_strategy_rank(spark, sf_dir):
    """Strategies ranked by mean macro F1 (window over 4 rows per prompt)."""
    rt = _run_table(spark, sf_dir)
    m = rt.groupBy("prompt_name", "strategy").agg(F.round(F.avg("f1_macro"), 9).alias("f1_mean"))
    from pyspark.sql import Window

    return m.withColumn("rnk", F.rank().over(Window.partitionBy("prompt_name").orderBy(F.col("f1_mean").desc())))


def _percentile_sql(x, p):
    every = f"list({x} ORDER BY {x})"
    lo, hi = (f"({every})[CAST({f}((count(*) - 1) * {p} / 100.0) AS BIGINT) + 1]" for f in ("floor", "ceil"))
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * (((count(*) - 1) * {p} % 100) / 100.0))"


@query(
    "a14_length_profile",
    "SELECT split, count(*) AS n_rows, "
    + ", ".join(
        f"avg({O.n_words(c)}) AS avg_words_{c}, CAST(min({O.n_words(c)}) AS INTEGER) AS min_words_{c}, "
        f"CAST(max({O.n_words(c)}) AS INTEGER) AS max_words_{c}, CAST(sum({O.n_words(c)}) AS BIGINT) AS sum_words_{c}, " + ", ".join(f"{_percentile_sql(O.n_words(c), p)} AS {n}_words_{c}" for n, p in (("median", 50), ("p95", 95)))
        for c in ("prompt", "full_text", "answer")
    )
    + f" FROM ({_E1_ROWS}) r GROUP BY split",
)
def a14_length_profile(spark, sf_dir):
    """Word counts of prompt, full output and answer, per split, with
    exact median and 95th percentile."""
    return A.length_profile(_e1_rows(spark, sf_dir), ["split"], ("prompt", "full_text", "answer"))


def _log_sql():
    return (
        "SELECT checkpoint_path AS run, key, value FROM (SELECT checkpoint_path, "
        "unnest(['eval_accuracy', 'eval_f1_macro', 'train_token_accuracy', 'eval_invalid_percent']) AS key, "
        "unnest([accuracy, f1_macro, CAST(valid_samples AS DOUBLE) / CAST(total_samples AS DOUBLE), invalid_percent]) AS value "
        f"FROM ({_run_table_sql()}) r WHERE prompt_name = 'same') x"
    )


def _log_rows(spark, sf_dir):
    rt = _run_table(spark, sf_dir).filter(F.col("prompt_name") == "same")
    kv = F.array(
        F.struct(F.lit("eval_accuracy").alias("key"), F.col("accuracy").alias("value")),
        F.struct(F.lit("eval_f1_macro").alias("key"), F.col("f1_macro").alias("value")),
        F.struct(
            F.lit("train_token_accuracy").alias("key"),
            (F.col("valid_samples").cast("double") / F.col("total_samples").cast("double")).alias("value"),
        ),
        F.struct(F.lit("eval_invalid_percent").alias("key"), F.col("invalid_percent").alias("value")),
    )
    return rt.select(F.col("checkpoint_path").alias("run"), F.explode(kv).alias("kv")).select("run", "kv.*")


@query(
    "p15_p16_log_rows",
    "SELECT run, CASE WHEN max(value) FILTER (WHERE key = 'eval_accuracy') IS NOT NULL THEN "
    "'F1=' || printf('%.4f', coalesce(max(value) FILTER (WHERE key = 'eval_f1_macro'), 0.0)) || ', Acc=' || "
    "printf('%.4f', max(value) FILTER (WHERE key = 'eval_accuracy')) END AS classification_performance, count(*) AS n_kept "
    f"FROM ({_log_sql()}) l WHERE NOT (contains(key, 'accuracy') AND NOT contains(key, 'eval')) GROUP BY run",
)
def p15_p16_log_rows(spark, sf_dir):
    """P15 drops training token accuracy from the log; P16 adds the
    ``F1=.., Acc=..`` string per run."""
    log = _log_rows(spark, sf_dir).filter(NM.keep_log_row("key"))
    w = log.groupBy("run").agg(
        F.max(F.when(F.col("key") == "eval_f1_macro", F.col("value"))).alias("f1"),
        F.max(F.when(F.col("key") == "eval_accuracy", F.col("value"))).alias("acc"),
        F.count(F.lit(1)).alias("n_kept"),
    )
    return w.select("run", NM.perf_string("f1", "acc").alias("classification_performance"), "n_kept")


@query(
    "p12_encoder_run_names",
    "SELECT strategy, " + O.lit("./results/google-mt5-base_clf_") + " || " + _ABBREV_SQL
    + " || '_f1_' || strategy || '_' || printf('%.4f', best_f1) || CASE WHEN strategy = 'normal' THEN '_focal' ELSE '' END AS model_dir "
    f"FROM (SELECT strategy, max(f1_macro) AS best_f1 FROM ({_run_table_sql()}) r WHERE prompt_name = 'same' GROUP BY strategy) b",
)
def p12_encoder_run_names(spark, sf_dir):
    """P12 (classifier form) from the best validation-style F1 per strategy."""
    b = _run_table(spark, sf_dir, prompts=("same",)).groupBy("strategy").agg(F.max("f1_macro").alias("best_f1"))
    return b.select("strategy", NM.encoder_run_name("./results", "strategy", "best_f1", F.col("strategy") == "normal").alias("model_dir"))


@query(
    "j1_align_predictions",
    O.evaluate(
        f"SELECT l.split, l.label, p.pred FROM (SELECT example_id, {O.parse_lenient(O.standin_answer())} AS pred FROM ({CORPUS}) c) p "
        f"JOIN (SELECT example_id, split, label FROM ({CORPUS}) c) l ON p.example_id = l.example_id",
        ["split"],
    ),
)
def j1_align_predictions(spark, sf_dir):
    """Predictions and labels are separate tables joined on the row key
    (the reference zipped two lists by position), then A9."""
    c = load_corpus(spark, sf_dir)
    preds = c.select("example_id", X.parse_lenient(standin.standin_answer()).alias("pred"))
    labels = c.select("example_id", "split", "label")
    return A.evaluate(preds.join(labels, "example_id"), ["split"])


def _few_shot_template() -> str:
    from graded.functions.prompts import FEW_SHOT_FOOTER, FEW_SHOT_HEADER, FEW_SHOT_LINE, FEW_SHOTS

    shots = "".join(FEW_SHOT_LINE.replace("{shot}", t).replace("{label}", str(lab)) for t, lab in FEW_SHOTS)
    return FEW_SHOT_HEADER + shots + FEW_SHOT_FOOTER


@query("p4_few_shot_prompts", f"SELECT example_id, {O.render(O.lit(_few_shot_template()), 'text', '{item}')} AS prompt FROM ({CORPUS}) t")
def p4_few_shot_prompts(spark, sf_dir):
    """Four labelled shots before each sentence of the corpus."""
    return load_corpus(spark, sf_dir).select("example_id", render_few_shot("text").alias("prompt"))


@query(
    "p7_p8_normalise_texts",
    f"SELECT doc_id, {O.norm('text')} AS norm_text, {O.keep_alnum_space(O.norm('text'))} AS alnum_text, {O.n_words('text')} AS n_words FROM documents",
)
def p7_p8_normalise_texts(spark, sf_dir):
    """P7 strip+lower and P8 letters/digits/whitespace over whole documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", norm("text").alias("norm_text"), keep_alnum_space(norm("text")).alias("alnum_text"), n_words("text").alias("n_words"))


@query(
    "p11_null_split",
    "SELECT template, count(*) FILTER (WHERE pred_label IS NULL) AS n_no_label, count(*) FILTER (WHERE pred_label IS NOT NULL) AS n_labelled "
    f"FROM ({_e6_all_sql()}) r GROUP BY template",
)
def p11_null_split(spark, sf_dir):
    """Rows with and without a parsed label per template, over every
    example (X9 and X10 at full size)."""
    r = _e6_all(spark, sf_dir)
    return r.groupBy("template").agg(
        F.count_if(F.col("pred_label").isNull()).alias("n_no_label"),
        F.count_if(F.col("pred_label").isNotNull()).alias("n_labelled"),
    )


@query(
    "p5_p6_label_words",
    f"SELECT example_id, label, {O.label_word('label')} AS word_ja_nee, {O.label_word('label', 'biased', 'niet-biased')} AS word_biased FROM ({CORPUS}) c",
)
def p5_p6_label_words(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    return c.select("example_id", "label", X.label_word("label").alias("word_ja_nee"), X.label_word("label", "biased", "niet-biased").alias("word_biased"))


# ------------------------------------------------------------------ F scoring, M training, streaming

from graded.operators import bayes as B  # noqa: E402
from graded.operators import scoring as SC  # noqa: E402
from graded.operators import stored as SM  # noqa: E402
from graded.operators import training as ML  # noqa: E402
from graded.streaming import confusion as ST  # noqa: E402


STORED_CELL = ("undersample", 42)


def _stored_rows_sql():
    """Answers of the stored model over the whole corpus; a text beyond its
    context (or none) has no answer."""
    rows = SWS.margins([STORED_CELL], CORPUS, ("same",))
    failed = f"(text IS NULL OR len({SWS.tokens('text')}) > {SM.MAX_WORDS})"
    answers = f"SELECT *, {failed} AS failed, CASE WHEN {failed} THEN '' ELSE {SWS.spoken('margin')} END AS answer FROM ({rows}) m"
    return f"SELECT *, {O.parse_lenient('answer')} AS pred FROM ({answers}) a"


def _stored_rows(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    train = c.where(F.col("split") == "train").select("example_id", "label", "text")
    path = SM.store(B.fit_sweep(train, [STORED_CELL]), 0, shared_path(spark, "stored_model"), choose_template("same"))
    scored = SM.scored(c, SM.plug_in(spark, path), ["example_id", "split", "label", "lang"])
    return scored.withColumn("pred", X.parse_lenient("answer"))


@query("f4_scored_eval_by_lang", O.evaluate(_stored_rows_sql(), ["lang"]))
def f4_scored_eval_by_lang(spark, sf_dir):
    """F4 + M4: a fitted model is stored in the shared folder, loaded once per
    worker and run over the whole corpus in Arrow batches; A9 per language."""
    return A.evaluate(_stored_rows(spark, sf_dir), ["lang"])


@query(
    "x4_scoring_error_fallback",
    "SELECT split, count(*) FILTER (WHERE failed) AS n_errors, count(*) FILTER (WHERE pred = -1) AS n_invalid, "
    f"count(*) AS n_rows FROM ({_stored_rows_sql()}) r GROUP BY split",
)
def x4_scoring_error_fallback(spark, sf_dir):
    """Rows on which the stored model fails (no text, or more words than
    its context) become prediction -1, empty text and an error message; a
    failing batch is halved until they stand alone."""
    return _stored_rows(spark, sf_dir).groupBy("split").agg(
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.count_if(F.col("pred") == -1).alias("n_invalid"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    "f4_linear_head_scores",
    f"SELECT vec_id, label_bin, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM ({_emb_rows_sql()}) r",
)
def f4_linear_head_scores(spark, sf_dir):
    """F4 with a numpy model: pooled linear head over every embedding."""
    e = table(spark, sf_dir, "embeddings").withColumn("label_bin", (F.col("label") >= 5).cast("int"))
    return SC.score(e, SC.LinearHead(HEAD_W, HEAD_B), ["vec_id", "label_bin"]).drop("error")


def _shuffled_sql():
    order = f"{O.hash_key(42, 'example_id', 'copy_no')}, example_id, copy_no"
    return f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS idx FROM ({O.oversample(TRAIN_SQL)}) o"


def _r12_sql():
    rows = (
        f"SELECT s.idx, s.label, {SWS.tokens('c.text')} AS words FROM ({_shuffled_sql()}) s "
        f"JOIN ({O.corpus(split='train')}) c ON c.example_id = s.example_id"
    )
    return (
        "SELECT idx // 64 AS batch_no, count(*) AS n_rows, min(idx % 64) AS first_row, max(idx % 64) AS last_row, "
        "sum(label)::BIGINT AS n_positive, max(len(words))::BIGINT AS longest, "
        "len(list_distinct(flatten(list(words))))::BIGINT AS n_distinct_words "
        f"FROM ({rows}) x GROUP BY 1"
    )


def _batch_summary(rows) -> dict:
    """What padding and looking up a batch would cost."""
    place = rows["idx"] % 64
    return {
        "n_rows": len(rows),
        "first_row": int(place.iloc[0]),
        "last_row": int(place.iloc[-1]),
        "n_positive": int(rows["label"].sum()),
        "longest": max(len(w) for w in rows["words"]),
        "n_distinct_words": len({w for words in rows["words"] for w in words}),
    }


@query("r12_fixed_batches", _r12_sql())
def r12_fixed_batches(spark, sf_dir):
    """R12 + F2: a function over fixed 64-row batches of the shuffled,
    oversampled train split, by R6's index; one result per batch."""
    train = load_corpus(spark, sf_dir, split="train").select("example_id", "label", EN.tokens("text").alias("words"))
    rows = R.shuffle_index(R.oversample(train), 42)
    schema = "n_rows long, first_row long, last_row long, n_positive long, longest long, n_distinct_words long"
    return SC.map_batches(rows, _batch_summary, schema, 64)


def _text_sizes(row: dict) -> dict:
    text = row["text"] or ""
    return {"n_lines": text.count("\n") + 1, "n_bytes": len(text.encode())}


@query(
    "f1_row_map",
    "SELECT doc_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS n_lines, "
    "strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
)
def f1_row_map(spark, sf_dir):
    """a Python row function over every whole text, in Arrow batches."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return SC.map_rows(d, _text_sizes, "n_lines long, n_bytes long", ["doc_id"])


@query("f3_metric_callback", _e4_sql())
def f3_metric_callback(spark, sf_dir):
    """a metric callback given (predictions, labels) tables -> A10 record."""
    c = load_corpus(spark, sf_dir)
    preds = c.select("example_id", "split", standin.standin_answer().alias("decoded_pred"))
    labels = c.select("example_id", X.label_word("label").alias("decoded_label"))
    return metric_callback(preds, labels, ["split"])


def metric_callback(preds, labels, by):
    j = preds.join(labels, "example_id")
    j = j.withColumn("pred", X.parse_last_word("decoded_pred")).withColumn("label_parsed", X.parse_last_word("decoded_label"))
    return A.evaluate_two_sided(j, by, label="label_parsed", pred="pred")


HELD_SQL = f"SELECT * FROM ({CORPUS}) c WHERE split <> 'train'"


@query(
    "m1_m2_fit_evaluate",
    O.evaluate(
        f"SELECT *, {SWS.decide('margin')} AS pred FROM ({SWS.margins([('balanced', 42)], HELD_SQL, weighted=True)}) m", ["split"]
    ),
)
def m1_m2_fit_evaluate(spark, sf_dir):
    """M1 + M2: balanced resampling, class-weighted naive Bayes fitted on the
    train split, A9 on validation and test."""
    c = load_corpus(spark, sf_dir)
    train = c.where(F.col("split") == "train").select("example_id", "label", "text")
    model = B.fit_sweep(train, [("balanced", 42)], weighted=True)
    rows = B.margins(c.where(F.col("split") != "train"), model, ["example_id", "split", "label"])
    return A.evaluate(rows.withColumn("pred", B.decide("margin")), ["split"])


@query("m1_logistic_regression")
def m1_logistic_regression(spark, sf_dir):
    """M1 + M2 with Spark ML: balanced resampling, class-weighted logistic
    regression on the train split, A9 on validation and test."""
    c = load_corpus(spark, sf_dir)
    model = ML.fit(c.filter(F.col("split") == "train"), "balanced", 42, weighted=True)
    return ML.evaluate_model(model, c.filter(F.col("split") != "train"), ("split",))


def _m3_sql():
    rows = f"SELECT *, {SWS.decide('margin')} AS pred FROM ({SWS.margins(SW.grid(), TEST_SQL)}) m"
    place = " ".join(f"WHEN strategy = {O.lit(st)} AND seed = {sd} THEN {i}" for i, (st, sd) in enumerate(SW.grid()))
    return (
        f"SELECT *, 'ok' AS status, row_number() OVER (ORDER BY f1_macro DESC, CASE {place} END) = 1 AS is_best "
        f"FROM ({O.evaluate(rows, ['strategy', 'seed'])}) e"
    )


@query("m3_strategy_sweep", _m3_sql())
def m3_strategy_sweep(spark, sf_dir):
    """M3 + A16: a fit for every strategy and seed, all in one pass, test
    metrics of each; the best is marked (the first of the grid on ties), and a
    cell without a model is a row with its status."""
    models = SW.fit(load_corpus(spark, sf_dir))
    rows = B.margins(_test(spark, sf_dir), models, ["example_id", "label"])
    done = A.evaluate(rows.withColumn("pred", B.decide("margin")), ["strategy", "seed"])
    cells = materialize(models.table().select("cell", "strategy", "seed", "status").join(done, ["strategy", "seed"], "left"), "m3_cells")
    best = A.best_by(cells.where("status = 'ok'"), [], "cell", "f1_macro", "cell").select("best").scalar()
    return cells.withColumn("is_best", F.col("cell") == best).drop("cell")


@query("m3_logistic_regression_sweep")
def m3_logistic_regression_sweep(spark, sf_dir):
    """M3 + A16 with Spark ML: one fit per strategy (seed 42), test metrics,
    best marked (the first strategy by name on ties)."""
    c = load_corpus(spark, sf_dir)
    res = materialize(ML.sweep(c.filter(F.col("split") == "train"), c.filter(F.col("split") == "test")), "m3_logistic")
    top = res.agg(F.max_by("strategy", F.struct("f1_macro", *[(F.col("strategy") == s).alias(s) for s in sorted(R.STRATEGIES)])).alias("s"))
    return res.withColumn("is_best", F.col("strategy") == top.scalar())


@query("m4_save_reload", f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_diff FROM ({TEST_SQL}) t")
def m4_save_reload(spark, sf_dir):
    """M4: save the fitted model under the shared folder, reload it, and
    check the reloaded model scores the test split identically."""
    c = load_corpus(spark, sf_dir)
    model = ML.fit(c.filter(F.col("split") == "train"), "undersample", 42)
    again = ML.save_and_reload(model, shared_path(spark, "model"))
    test = c.filter(F.col("split") == "test")
    a = ML.predict(model, test).select("example_id", F.col("pred").alias("pred_fitted"))
    b = ML.predict(again, test).select("example_id", F.col("pred").alias("pred_reloaded"))
    return a.join(b, "example_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("pred_fitted") != F.col("pred_reloaded")).alias("n_diff")
    )


@query(
    "stream_a1_confusion",
    f"SELECT 'e1' AS run_id, label, {O.parse_lenient('answer')} AS pred, count(*) AS n FROM ({_ANSWERS_SQL}) a GROUP BY label, pred",
)
def stream_a1_confusion(spark, sf_dir):
    """A1 as a Structured Streaming aggregation over answer files."""
    ans = load_corpus(spark, sf_dir).select(
        F.lit("e1").alias("run_id"), "example_id", "label", standin.standin_answer().alias("answer")
    )
    src = shared_path(spark, "stream_source")
    ans.write.mode("overwrite").parquet(src)
    sink, ck = shared_path(spark, "stream_sink"), shared_path(spark, "stream_checkpoint")
    ST.run_to_table(ST.confusion_stream(spark, src), sink, ck)
    return ST.read_table(spark, sink)


# ------------------------------------------------------------------ V6 collate, P9/P10 valid filters


def _r11_sql():
    return (
        "SELECT example_id, copy_no, idx, block, block * 50 + (row_number() OVER (PARTITION BY block ORDER BY n_tokens DESC, idx) - 1) // 8 AS batch "
        f"FROM (SELECT *, idx // 400 AS block FROM (SELECT example_id, copy_no, n_tokens, row_number() OVER (ORDER BY "
        f"{O.hash_key(42, 'example_id', 'copy_no')}, example_id, copy_no) - 1 AS idx FROM (SELECT o.example_id, o.copy_no, "
        f"{O.n_words('c.text')} AS n_tokens FROM ({O.oversample(TRAIN_SQL)}) o JOIN ({O.corpus(split='train')}) c "
        f"ON o.example_id = c.example_id) j) i) b"
    )


def _v6_sql():
    enc = _encode_sql(O.corpus(split="train"), _vocab_sql(DOCS_SQL), max_len=128)
    j = (
        f"SELECT b.example_id, b.copy_no, b.batch, e.input_ids, e.attention_mask, "
        f"max(len(e.input_ids)) OVER (PARTITION BY b.batch) AS longest FROM ({_r11_sql()}) b JOIN ({enc}) e ON b.example_id = e.example_id"
    )
    return (
        "SELECT example_id, copy_no, batch, input_ids || list_transform(range(longest - len(input_ids)), lambda x: 0) AS input_ids, "
        "attention_mask || list_transform(range(longest - len(attention_mask)), lambda x: 0) AS attention_mask "
        f"FROM ({j}) j"
    )


@query("v6_collate_batches", _v6_sql())
def v6_collate_batches(spark, sf_dir):
    """V6: length-grouped batches (R11) of encoded train rows, each padded to
    the longest row of its batch."""
    train = load_corpus(spark, sf_dir, split="train").withColumn("n_tokens", n_words("text"))
    batches = R.length_batches(R.oversample(train.select("example_id", "label", "n_tokens")), 8, 42, 50, "n_tokens")
    vocab = EN.build_vocabulary(table(spark, sf_dir, "documents"))
    enc = EN.encode(train, vocab, max_len=128)
    j = batches.select("example_id", "copy_no", "batch").join(enc, "example_id")
    return WN.collate(j, "batch", {"input_ids": EN.PAD_ID, "attention_mask": 0})


@query(
    "p9_p10_valid_filters",
    "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE pred <> -1) AS n_valid_pred, "
    "count(*) FILTER (WHERE pred <> -1 AND label_parsed <> -1) AS n_valid_both FROM "
    f"(SELECT split, {O.parse_last_word(O.standin_answer())} AS pred, {O.parse_last_word(O.standin_biased_answer())} AS label_parsed "
    f"FROM ({CORPUS}) c) r GROUP BY split",
)
def p9_p10_valid_filters(spark, sf_dir):
    """P9 (prediction side valid) and P10 (both sides valid) as filters."""
    c = load_corpus(spark, sf_dir).select(
        "split",
        X.parse_last_word(standin.standin_answer()).alias("pred"),
        X.parse_last_word(standin.standin_biased_answer()).alias("label_parsed"),
    )
    p9 = F.col("pred") != -1
    p10 = p9 & (F.col("label_parsed") != -1)
    # both predicates counted in one pass over the corpus
    return c.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(p9).alias("n_valid_pred"), F.count_if(p10).alias("n_valid_both")
    )


# ------------------------------------------------------------------ token losses, plug-in tokenizer, padded labels

from graded.operators import losses as LS  # noqa: E402

# positions x vocabulary of the stand-in logits; two label tokens with weights
TOKENS, VOCAB, TOKEN_WEIGHTS, TOKEN_GAMMA = 8, 8, {2: 0.6, 5: 3.5}, 2.0


def _token_losses_sql():
    rows = (
        "SELECT CASE WHEN (vec_id + 2 * p) % 3 = 0 THEN -100 ELSE (vec_id + p) % 8 END AS y, "
        "list_transform(range(8), lambda v: CAST(embedding[p * 8 + v + 1] AS DOUBLE)) AS lg "
        "FROM embeddings, (SELECT unnest(range(8)) AS p) q"
    )
    ce = (
        "SELECT y, CASE WHEN y = -100 THEN 0.0 ELSE list_max(lg) + ln(list_sum(list_transform(lg, lambda v: exp(v - list_max(lg))))) "
        f"- lg[y + 1] END AS ce FROM ({rows}) r"
    )
    w = "CASE y " + " ".join(f"WHEN {t} THEN {x!r}::DOUBLE" for t, x in TOKEN_WEIGHTS.items()) + " ELSE 1.0 END"
    return (
        "SELECT count(*) AS n_tokens, count(*) FILTER (WHERE y <> -100) AS n_kept, "
        f"round(avg(w * pow(1.0 - exp(-ce), {TOKEN_GAMMA!r}) * ce), 6) AS focal_loss, "
        f"round(sum(w * ce) FILTER (WHERE y <> -100) / sum(w) FILTER (WHERE y <> -100), 6) AS weighted_ce FROM (SELECT *, {w} AS w FROM ({ce}) c) x"
    )


@query("v10_v11_token_losses", _token_losses_sql())
def v10_v11_token_losses(spark, sf_dir):
    """V10 and V11 over tokens: logits per position, label tokens weighted,
    ignored labels out of the weighted mean."""
    e = table(spark, sf_dir, "embeddings")
    lg = F.transform(
        F.sequence(F.lit(0), F.lit(TOKENS - 1)),
        lambda p: F.transform(F.slice("embedding", p * VOCAB + 1, VOCAB), lambda v: v.cast("double")),
    )
    y = F.transform(
        F.sequence(F.lit(0), F.lit(TOKENS - 1)),
        lambda p: F.when((F.col("vec_id") + 2 * p) % 3 == 0, F.lit(V.IGNORE_INDEX)).otherwise(
            ((F.col("vec_id") + p) % VOCAB).cast("int")
        ),
    )
    out = LS.token_losses(e.select(lg.alias("lg"), y.alias("y")), "lg", "y", TOKEN_WEIGHTS, TOKEN_GAMMA)
    return out.withColumn("focal_loss", F.round("focal_loss", 6)).withColumn("weighted_ce", F.round("weighted_ce", 6))


@query(
    "v1_plugin_tokenizer",
    "SELECT doc_id, list_transform(range(least(strlen(coalesce(text, '')), 512)), lambda i: "
    "CAST(('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2)) AS INTEGER) + 3) AS input_ids FROM documents",
)
def v1_plugin_tokenizer(spark, sf_dir):
    """V1 with a tokenizer plugged into the scorer (here: UTF-8 bytes)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return SC.score(d, SC.ByteTokenizer(), ["doc_id"]).select("doc_id", "input_ids")


def _v6_labels_sql():
    enc = _encode_sql(O.corpus(split="train"), _vocab_sql(DOCS_SQL), max_len=128)
    j = (
        f"SELECT b.example_id, b.copy_no, b.batch, e.input_ids, max(len(e.input_ids)) OVER (PARTITION BY b.batch) AS longest "
        f"FROM ({_r11_sql()}) b JOIN ({enc}) e ON b.example_id = e.example_id"
    )
    return (
        "SELECT example_id, copy_no, batch, input_ids || list_transform(range(longest - len(input_ids)), lambda x: -100) AS labels "
        f"FROM ({j}) j"
    )


@query("v6_collate_labels", _v6_labels_sql())
def v6_collate_labels(spark, sf_dir):
    """V6 for labels: padded with the ignore index, not the padding id."""
    train = load_corpus(spark, sf_dir, split="train").withColumn("n_tokens", n_words("text"))
    batches = R.length_batches(R.oversample(train.select("example_id", "label", "n_tokens")), 8, 42, 50, "n_tokens")
    enc = EN.encode(train, EN.build_vocabulary(table(spark, sf_dir, "documents")), max_len=128, out="labels")
    j = batches.select("example_id", "copy_no", "batch").join(enc.select("example_id", "labels"), "example_id")
    return WN.collate(j, "batch", {"labels": EN.PAD_ID})


# ------------------------------------------------------------------ S1 stored corpora


from graded.sources.corpus import read_labelled_corpus, write_labelled_corpus  # noqa: E402


@query("s1_corpus_json_test_split", f"SELECT example_id, text, label FROM ({TEST_SQL}) t")
def s1_corpus_json_test_split(spark, sf_dir):
    """S1 from a stored JSON corpus partitioned by split: the test-split
    filter prunes the other folders (PartitionFilters at the scan)."""
    path = write_labelled_corpus(load_corpus(spark, sf_dir), shared_path(spark, "corpus_json"), "json")
    return read_labelled_corpus(spark, path, "json", split="test").select("example_id", "text", "label")


@query("s1_corpus_csv_train_split", f"SELECT example_id, text, label FROM ({O.corpus(split='train')}) t")
def s1_corpus_csv_train_split(spark, sf_dir):
    """S1 from a stored CSV corpus (header, quoted multi-line texts)."""
    path = write_labelled_corpus(load_corpus(spark, sf_dir), shared_path(spark, "corpus_csv"), "csv")
    return read_labelled_corpus(spark, path, "csv", split="train").select("example_id", "text", "label")


def _framed(text, key):
    """Every sort of text that a CSV file could alter."""
    return (
        F.when(key % 7 == 0, F.concat(F.lit("  "), text, F.lit("\t ")))
        .when(key % 7 == 1, F.lit(""))
        .when(key % 7 == 2, F.lit(None).cast("string"))
        .when(key % 7 == 3, F.concat(F.lit('"'), text, F.lit('\\')))
        .otherwise(text)
    )


@query(
    "s1_corpus_csv_odd_texts",
    "SELECT example_id, CASE example_id % 7 WHEN 0 THEN '  ' || text || chr(9) || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL "
    f"WHEN 3 THEN '\"' || text || chr(92) ELSE text END AS text, label, split FROM ({CORPUS}) c",
)
def s1_corpus_csv_odd_texts(spark, sf_dir):
    """S1 as CSV: outer blanks, quotes, backslashes, empty and missing texts
    come back as they were."""
    c = load_corpus(spark, sf_dir)
    c = c.withColumn("text", _framed(F.col("text"), F.col("example_id")))
    path = write_labelled_corpus(c, shared_path(spark, "corpus_csv_odd"), "csv")
    return read_labelled_corpus(spark, path, "csv").select("example_id", "text", "label", "split")


# ------------------------------------------------------------------ D17: empty groups


def _splits_sql():
    return "(VALUES ('train'), ('validation'), ('test')) AS s(split)"


def _e1_test_only_sql():
    counts = (
        "SELECT s.split, coalesce(c.total_samples, 0) AS total_samples, coalesce(c.n_invalid, 0) AS n_invalid, "
        "coalesce(c.n11, 0) AS n11, coalesce(c.n10, 0) AS n10, coalesce(c.n01, 0) AS n01, coalesce(c.n00, 0) AS n00 "
        f"FROM {_splits_sql()} LEFT JOIN (SELECT split, count(*) AS total_samples, "
        "count(*) FILTER (WHERE pred = -1) AS n_invalid, count(*) FILTER (WHERE label = 1 AND pred = 1) AS n11, "
        "count(*) FILTER (WHERE label = 1 AND pred = 0) AS n10, count(*) FILTER (WHERE label = 0 AND pred = 1) AS n01, "
        f"count(*) FILTER (WHERE label = 0 AND pred = 0) AS n00 FROM ({_E1_ROWS}) r WHERE split = 'test' GROUP BY split) c "
        "ON s.split = c.split"
    )
    return O._a9_from_counts(counts, ["split"])


@query("e1_eval_test_only", _e1_test_only_sql())
def e1_eval_test_only(spark, sf_dir):
    """E1 with ``test_only``: splits without rows still get a record (scores
    0, invalid 100, total 0), the reference's empty-list contract (D17)."""
    from graded.sources.corpus import SPLITS

    rows = _e1_rows(spark, sf_dir).filter(F.col("split") == "test")
    groups = spark.createDataFrame([(s_,) for s_ in SPLITS], "split string")
    return A.evaluate(rows, ["split"], groups=groups)


@query("stream_a9_eval", O.evaluate(f"SELECT 'e1' AS run_id, label, {O.parse_lenient('answer')} AS pred FROM ({_ANSWERS_SQL}) a", ["run_id"]))
def stream_a9_eval(spark, sf_dir):
    """A9 per run from the streaming confusion counts (A1 state -> metrics)."""
    return A.evaluate_confusion(stream_a1_confusion(spark, sf_dir), ["run_id"])


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
