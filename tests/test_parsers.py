"""Parser cases hand-derived from the reference code (FIXTURES §5)."""

from pyspark.sql import functions as F

from graded.functions import arrays as V
from graded.functions import parsing as X
from graded.functions.prompts import render_prompt
from tests.conftest import one_col

CASES = [
    # input, X5 last word, X6 lenient, X7 strict
    ("ja", 1, 1, 1),
    ("Nee", 0, 0, 0),
    ("JA.", -1, 1, 1),
    ('nee!!"', -1, 0, 0),
    ("ja .", -1, 1, -1),
    ('"ja"', -1, 1, -1),
    ("Het antwoord is nee", 0, 0, -1),
    ("ja of nee", 0, -1, -1),
    ("jaarlijks", -1, 1, -1),
    ("nee, jaarlijks", -1, -1, -1),
    ("j-a", -1, 1, -1),
    ("misschien", -1, -1, -1),
    ("", -1, -1, -1),
    (None, -1, -1, -1),
    (" ja\n", 1, 1, 1),
]


def test_answer_parsers(spark):
    df = one_col(spark, [c[0] for c in CASES])
    rows = df.select(
        "a",
        X.parse_last_word("a").alias("x5"),
        X.parse_lenient("a").alias("x6"),
        X.parse_strict("a").alias("x7"),
    ).collect()
    got = {r.a: (r.x5, r.x6, r.x7) for r in rows}
    for text, x5, x6, x7 in CASES:
        assert got[text] == (x5, x6, x7), text


def test_lenient_whole_word_option(spark):
    df = one_col(spark, ["jaarlijks", "ja", "nee, jaarlijks"])
    got = {r.a: r.p for r in df.select("a", X.parse_lenient("a", whole_word=True).alias("p")).collect()}
    assert got == {"jaarlijks": -1, "ja": 1, "nee, jaarlijks": 0}


def test_biased_parser(spark):
    cases = {"niet-biased": 0, "Niet Biased": 0, "niet-biased.": -1, "biased": 1, "Biasedness": 1, "is biased": -1, "niet--biased": -1}
    df = one_col(spark, list(cases))
    got = {r.a: r.p for r in df.select("a", X.parse_biased("a").alias("p")).collect()}
    assert got == cases


def test_digit_and_reasoning(spark):
    cases = {
        "Label: 1": (1, "Label:"),
        "10": (0, "1"),
        "in 2010 dus 1 .": (1, "in 2010 dus"),
        "geen label": (None, "geen label"),
        "": (None, ""),
        "0": (0, ""),
        "25": (None, "25"),
    }
    df = one_col(spark, list(cases))
    got = {r.a: (r.d, r.r) for r in df.select("a", X.parse_last_digit("a").alias("d"), X.reasoning("a").alias("r")).collect()}
    assert got == cases


def test_completion_extraction(spark):
    df = spark.createDataFrame(
        [
            ("x1", "P: a", "a", "P: a  ja "),
            ("x2a", 'P "a"', "a", "P \"a\" 'ja'"),
            ("x2b", 'P "a b"', "a b", 'p "a b" nee'),
            ("x2c", "P", "zzz", " ja "),
        ],
        "case string, prompt string, text string, full string",
    )
    got = {
        r.case: (r.s, r.r)
        for r in df.select(
            "case",
            X.completion_slice("full", "prompt").alias("s"),
            X.completion_robust("full", "prompt", "text").alias("r"),
        ).collect()
    }
    assert got["x1"][0] == "ja"
    assert got["x2a"][1] == "ja"
    assert got["x2b"][1] == "nee"
    assert got["x2c"][1] == "ja"


def test_narrow(spark):
    long_hit = "een twee drie vier vijf zes zeven acht negen tien dus nee!"
    long_miss = "een twee drie vier vijf zes zeven acht negen tien X Y Z"
    short = "Het Antwoord is ja"
    df = one_col(spark, [long_hit, long_miss, short])
    got = {r.a: r.n for r in df.select("a", X.narrow("a").alias("n")).collect()}
    assert got == {long_hit: "nee", long_miss: "x y z", short: short}


def test_render_keeps_text_literal(spark):
    df = one_col(spark, ["kost $1 \\ {x}"])
    out = df.select(render_prompt('Z: "{text}"', "a").alias("p")).first().p
    assert out == 'Z: "kost $1 \\ {x}"'


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.7],)], "v array<double>")
    assert df.select(V.argmax("v").alias("i")).first().i == 1


def test_whitespace_class_is_python_isspace(spark):
    """Every code point: the Java class used on the Spark side, the explicit
    class shared with the oracle and the trim set all equal str.isspace."""
    from graded.functions.text import WS_CHARS, WS_CLASS, WS_CLASS_JAVA

    cps = [c for c in range(0x110000) if not (0xD800 <= c <= 0xDFFF)]
    py_ws = {c for c in cps if chr(c).isspace()}
    assert {ord(c) for c in WS_CHARS} == py_ws
    rows = [("".join(chr(c) for c in cps[i : i + 4096]),) for i in range(0, len(cps), 4096)]
    df = spark.createDataFrame(rows, "s string")
    for pat in (WS_CLASS_JAVA, WS_CLASS):
        got = df.select(F.array_join(F.regexp_extract_all("s", F.lit("(" + pat + ")"), 1), "").alias("k")).collect()
        assert {ord(ch) for r in got for ch in r.k} == py_ws


def test_choose_template_families():
    from graded.functions import prompts as P

    assert P.choose_template("same") == P.TRAIN_TEMPLATE
    assert P.choose_template("COT") == P.COT_TEMPLATE
    assert P.choose_template("same", "variants") == P.VARIANT_SAME_TEMPLATE
    assert P.choose_template("cot", "variants") == P.VARIANT_COT_TEMPLATE
    assert P.choose_template("Zin: {text}") == "Zin: {text}"
    assert P.max_new_tokens_for(P.TRAIN_TEMPLATE) == 6 and P.max_new_tokens_for(P.COT_TEMPLATE) == 200
    for t in (P.TRAIN_TEMPLATE, P.COT_TEMPLATE, P.VARIANT_SAME_TEMPLATE, P.VARIANT_COT_TEMPLATE, P.FINETUNE_TEMPLATE):
        assert t.count("{text}") == 1
