"""DuckDB SQL builders for the independent oracle.

Each helper returns a SQL text fragment mirroring one Spark column function,
so the oracle of a query composes the same way its Spark plan does. The
regex character classes are shared with the Spark side (Java regex and RE2
read the ``\\x{..}`` escapes identically).
"""

from __future__ import annotations

from graded.functions.parsing import NARROW_STRIP, QUOTES, STRICT_TRAILING
from graded.functions.text import NON_WS_RUN, NOT_ALNUM_SPACE, WS_CHARS, WS_CLASS, char_class
from graded.sources.corpus import SPLIT_CUTS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def keep_alnum_space(x: str) -> str:
    return f"regexp_replace({x}, {lit(NOT_ALNUM_SPACE)}, '', 'g')"


def words(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, {lit(WS_CLASS + '+')}) END)"


def n_words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {lit(NON_WS_RUN)})) AS INTEGER)"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def split_of(key: str) -> str:
    h2 = f"substr(md5(CAST({key} AS VARCHAR)), 1, 2)"
    parts = " ".join(f"WHEN {h2} < {lit(cut)} THEN {lit(name)}" for name, cut in SPLIT_CUTS)
    return f"(CASE {parts} ELSE 'test' END)"


def corpus(label_col: str = "toxic", extra: tuple[str, ...] = ("lang",), split: str | None = None) -> str:
    cols = "".join(f", d.{c}" for c in extra)
    where = f" WHERE {split_of('l.doc_id')} = {lit(split)}" if split else ""
    return (
        f"SELECT l.doc_id AS example_id, {split_of('l.doc_id')} AS split, d.text, "
        f"CAST(l.{label_col} AS INTEGER) AS label{cols} "
        f"FROM labels l JOIN documents d ON l.doc_id = d.doc_id{where}"
    )


def render(template_sql: str, text: str, placeholder: str = "{text}") -> str:
    return f"replace({template_sql}, {lit(placeholder)}, {text})"


# ---------------------------------------------------------------- stand-in


def _ans_key(eid, salt=None):
    if salt is None:
        return f"'ans:' || CAST({eid} AS VARCHAR)"
    return f"'ans:' || {salt} || ':' || CAST({eid} AS VARCHAR)"


def standin_word(eid: str = "example_id", label: str = "label", salt=None) -> str:
    h1 = f"substr(md5({_ans_key(eid, salt)}), 1, 1)"
    return (
        f"(CASE WHEN {h1} >= 'e' THEN 'misschien' "
        f"WHEN ({h1} < 'b') = ({label} = 1) THEN 'ja' ELSE 'nee' END)"
    )


def standin_answer(eid: str = "example_id", label: str = "label", salt=None) -> str:
    h2 = f"substr(md5({_ans_key(eid, salt)}), 2, 1)"
    w = standin_word(eid, label, salt)
    return (
        f"(CASE WHEN {h2} < '4' THEN {w} "
        f"WHEN {h2} < '8' THEN upper({w}) || '.' "
        f"WHEN {h2} < 'b' THEN 'Het antwoord is: ' || {w} "
        f"WHEN {h2} < 'e' THEN {w} || ', dit geldt jaarlijks' "
        f"ELSE {w} || ' .' END)"
    )


def standin_generation(prompt: str = "prompt", eid: str = "example_id", label: str = "label", salt=None) -> str:
    return f"({prompt} || ' ' || {standin_answer(eid, label, salt)})"


def standin_biased_answer(eid: str = "example_id", label: str = "label") -> str:
    h = f"md5('gen:' || CAST({eid} AS VARCHAR))"
    h1, h2 = f"substr({h}, 1, 1)", f"substr({h}, 2, 1)"
    word = f"(CASE WHEN ({h1} < 'b') = ({label} = 1) THEN 'biased' ELSE 'niet-biased' END)"
    return (
        f"(CASE WHEN {h1} >= 'e' THEN 'onbekend' WHEN {h2} < '8' THEN {word} "
        f"WHEN {h2} < 'c' THEN upper({word}) WHEN {h2} < 'e' THEN {word} || 'ness' "
        f"ELSE {word} || '.' END)"
    )


def standin_digit_answer(tpl: str = "template", eid: str = "example_id", label: str = "label", cap: str = "max_new_tokens") -> str:
    h = f"md5('dig:' || {tpl} || ':' || CAST({eid} AS VARCHAR))"
    h1, h2 = f"substr({h}, 1, 1)", f"substr({h}, 2, 1)"
    d = f"(CASE WHEN ({h1} < 'b') = ({label} = 1) THEN '1' ELSE '0' END)"
    full = (
        f"(CASE WHEN {h2} < '4' THEN 'Label: ' || {d} "
        f"WHEN {h2} < '8' THEN 'De zin bevat ' || (CASE WHEN {d} = '1' THEN 'wel' ELSE 'geen' END) || ' bias, dus ' || {d} || '.' "
        f"WHEN {h2} < 'c' THEN 'geen label' "
        f"ELSE 'in 2010 dus ' || {d} || ' .' END)"
    )
    return f"array_to_string(string_split({full}, ' ')[1:{cap}], ' ')"


# ---------------------------------------------------------------- parsers


def completion_slice(full: str, prompt: str) -> str:
    return strip(f"substr({full}, length({prompt}) + 1)")


def completion_robust(full: str, prompt: str, text: str) -> str:
    after_prompt = strip(f"substr({full}, length({prompt}) + 1)")
    pos = f"strpos({full}, {text})"
    rest = strip(f"substr({full}, {pos} + length({text}))")
    rest2 = f"(CASE WHEN starts_with({rest}, '\"') THEN {strip(f'substr({rest}, 2)')} ELSE {rest} END)"
    out = (
        f"(CASE WHEN starts_with({full}, {prompt}) THEN {after_prompt} "
        f"WHEN {pos} > 0 THEN {rest2} ELSE {strip(full)} END)"
    )
    return f"trim({out}, {lit(QUOTES)})"


def narrow(x: str, max_words: int = 10, tail: int = 3) -> str:
    ws = words(f"lower({x})")
    cleaned = f"list_transform({ws}, lambda w: trim(w, {lit(NARROW_STRIP)}))"
    hits = f"list_filter({cleaned}, lambda w: w IN ('ja', 'nee'))"
    return (
        f"(CASE WHEN len({words(x)}) <= {max_words} THEN {x} "
        f"WHEN len({hits}) > 0 THEN {hits}[-1] "
        f"ELSE array_to_string({ws}[-{tail}:], ' ') END)"
    )


def _code(w: str, yes: str = "ja", no: str = "nee") -> str:
    return f"(CASE WHEN {w} = {lit(yes)} THEN 1 WHEN {w} = {lit(no)} THEN 0 ELSE -1 END)"


def parse_last_word(x: str) -> str:
    ws = words(norm(x))
    return f"CAST(coalesce((CASE WHEN len({ws}) = 0 THEN -1 ELSE {_code(f'{ws}[-1]')} END), -1) AS INTEGER)"


def parse_lenient(x: str) -> str:
    t = keep_alnum_space(norm(x))
    return (
        f"CAST((CASE WHEN {x} IS NULL OR {x} = '' THEN -1 "
        f"WHEN contains({t}, 'ja') AND NOT contains({t}, 'nee') THEN 1 "
        f"WHEN contains({t}, 'nee') AND NOT contains({t}, 'ja') THEN 0 ELSE -1 END) AS INTEGER)"
    )


def parse_strict(x: str) -> str:
    t = f"regexp_replace({norm(x)}, {lit(char_class(STRICT_TRAILING) + '+\\z')}, '')"
    return f"CAST((CASE WHEN {x} IS NULL OR {x} = '' THEN -1 ELSE {_code(t)} END) AS INTEGER)"


def parse_biased(x: str) -> str:
    t = strip(x)
    return (
        f"CAST(coalesce((CASE WHEN regexp_full_match({t}, '(?i)niet[- ]biased') THEN 0 "
        f"WHEN regexp_matches({t}, '(?i)^biased') THEN 1 ELSE -1 END), -1) AS INTEGER)"
    )


def parse_last_digit(x: str) -> str:
    d = f"regexp_extract({x}, '(?s)^.*([01])', 1)"
    return f"(CASE WHEN {d} <> '' THEN CAST({d} AS INTEGER) END)"


def reasoning(x: str) -> str:
    before = strip(f"regexp_extract({x}, '(?s)^(.*)[01][^01]*$', 1)")
    return f"(CASE WHEN regexp_matches({x}, '[01]') THEN {before} ELSE {x} END)"


def label_word(label: str, yes: str = "ja", no: str = "nee") -> str:
    return f"(CASE WHEN {label} = 1 THEN {lit(yes)} ELSE {lit(no)} END)"


# ---------------------------------------------------------------- metrics


def evaluate(src: str, by: list[str], label: str = "label", pred: str = "pred") -> str:
    """A9 over a row source."""
    byc = ", ".join(by)
    sel_by = f"{byc}, " if by else ""
    grp = f" GROUP BY {byc}" if by else ""
    counts = (
        f"SELECT {sel_by}count(*) AS total_samples, "
        f"count(*) FILTER (WHERE {pred} = -1) AS n_invalid, "
        f"count(*) FILTER (WHERE {label} = 1 AND {pred} = 1) AS n11, "
        f"count(*) FILTER (WHERE {label} = 1 AND {pred} = 0) AS n10, "
        f"count(*) FILTER (WHERE {label} = 0 AND {pred} = 1) AS n01, "
        f"count(*) FILTER (WHERE {label} = 0 AND {pred} = 0) AS n00 "
        f"FROM ({src}) s{grp}"
    )
    return _a9_from_counts(counts, by)


def _binary_scores_sql() -> dict[str, str]:
    s = {
        "f1_0": ratio("2 * n00", "2 * n00 + n10 + n01"),
        "f1_1": ratio("2 * n11", "2 * n11 + n01 + n10"),
        "p_0": ratio("n00", "n00 + n10"),
        "p_1": ratio("n11", "n11 + n01"),
        "r_0": ratio("n00", "n00 + n01"),
        "r_1": ratio("n11", "n11 + n10"),
        "accuracy": ratio("n11 + n00", "n11 + n10 + n01 + n00"),
    }
    p0, p1 = "(n00 + n10 + n01) > 0", "(n11 + n10 + n01) > 0"

    def mac(a, b):
        return f"(CASE WHEN {p0} AND {p1} THEN ({a} + {b}) / 2.0 WHEN {p0} THEN {a} ELSE {b} END)"

    s["f1_macro"] = mac(s["f1_0"], s["f1_1"])
    s["precision_macro"] = mac(s["p_0"], s["p_1"])
    s["recall_macro"] = mac(s["r_0"], s["r_1"])
    return s


def _a9_from_counts(counts_sql: str, by: list[str]) -> str:
    s = _binary_scores_sql()
    nv = "(total_samples - n_invalid) = 0"

    def sc(x):
        return f"(CASE WHEN {nv} THEN 0.0 ELSE {x} END)"

    sel_by = "".join(f"{b}, " for b in by)
    return (
        f"SELECT {sel_by}"
        f"{sc(s['accuracy'])} AS accuracy, {sc(s['f1_macro'])} AS f1_macro, "
        f"{sc(s['precision_macro'])} AS precision_macro, {sc(s['recall_macro'])} AS recall_macro, "
        f"{sc(s['f1_0'])} AS f1_class_0_not_biased, {sc(s['f1_1'])} AS f1_class_1_biased, "
        f"{sc(s['p_0'])} AS precision_class_0_not_biased, {sc(s['p_1'])} AS precision_class_1_biased, "
        f"{sc(s['r_0'])} AS recall_class_0_not_biased, {sc(s['r_1'])} AS recall_class_1_biased, "
        f"(CASE WHEN {nv} THEN 100.0 ELSE CAST(n_invalid AS DOUBLE) / CAST(total_samples AS DOUBLE) * 100.0 END) AS invalid_percent, "
        f"CAST(total_samples AS BIGINT) AS total_samples, CAST(total_samples - n_invalid AS BIGINT) AS valid_samples "
        f"FROM ({counts_sql}) c"
    )


def per_class(src: str, by: list[str], label: str = "label", pred: str = "pred") -> str:
    sel_by = "".join(f"{b}, " for b in by)
    grp_by = "".join(f"{b}, " for b in by)
    conf = f"SELECT {sel_by}{label} AS lab, {pred} AS prd, count(*) AS n FROM ({src}) s GROUP BY {grp_by}{label}, {pred}"
    roles = (
        f"SELECT {sel_by}lab AS cls, CASE WHEN lab = prd THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM ({conf}) c "
        f"UNION ALL SELECT {sel_by}prd AS cls, 0 AS tp, 0 AS support, n AS predicted FROM ({conf}) c"
    )
    pc = (
        f"SELECT {sel_by}cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted "
        f"FROM ({roles}) r GROUP BY {grp_by}cls"
    )
    return (
        f"SELECT {sel_by}cls, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, "
        f"{ratio('tp', 'predicted')} AS precision, {ratio('tp', 'support')} AS recall, "
        f"{ratio('2 * tp', 'support + predicted')} AS f1 FROM ({pc}) p"
    )


def _ordered_sum(field: str) -> str:
    return f"list_reduce(list_prepend(0.0, list({field} ORDER BY cls)), lambda a, b: a + b)"


def macro(src: str, by: list[str], label: str = "label", pred: str = "pred", with_invalid: bool = False) -> str:
    pc = per_class(src, by, label, pred)
    sel_by = "".join(f"{b}, " for b in by)
    grp = f" GROUP BY {', '.join(by)}" if by else ""
    agg = (
        f"SELECT {sel_by}{_ordered_sum('f1')} AS sf1, {_ordered_sum('precision')} AS sp, {_ordered_sum('recall')} AS sr, "
        f"count(*) AS k, sum(tp) AS tp, sum(support) AS n, "
        f"sum(CASE WHEN cls = -1 THEN predicted ELSE 0 END) AS no_pred, "
        f"sum(CASE WHEN cls = -1 THEN support ELSE 0 END) AS no_label FROM ({pc}) p{grp}"
    )
    extra = ", CAST(no_pred AS BIGINT) AS no_pred, CAST(no_label AS BIGINT) AS no_label" if with_invalid else ""
    tail = (
        "" if with_invalid else f", {ratio('2 * tp', '2 * n')} AS f1_micro, CAST(k AS INTEGER) AS n_classes, CAST(n AS BIGINT) AS n_rows"
    )
    return (
        f"SELECT {sel_by}{ratio('tp', 'n')} AS accuracy, sf1 / CAST(k AS DOUBLE) AS f1_macro, "
        f"sp / CAST(k AS DOUBLE) AS precision_macro, sr / CAST(k AS DOUBLE) AS recall_macro{tail}{extra} FROM ({agg}) a"
    )


# ---------------------------------------------------------------- sampling


def hash_key(seed, *keys: str) -> str:
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5({lit(str(seed))} || ':' || {parts})"


def py_round(x: str) -> str:
    f = f"floor({x})"
    return (
        f"CAST({f} + (CASE WHEN ({x}) - {f} > 0.5 THEN 1 WHEN ({x}) - {f} < 0.5 THEN 0 "
        f"ELSE CAST({f} AS BIGINT) % 2 END) AS BIGINT)"
    )


def undersample(src: str, ratio: float = 0.7, seed=42) -> str:
    ranked = (
        f"SELECT *, row_number() OVER (ORDER BY {hash_key(seed, 'example_id')}, example_id) AS rn, "
        f"count(*) OVER () AS n0 FROM ({src}) s WHERE label = 0"
    )
    return (
        f"SELECT example_id, label, 1 AS copy_no FROM ({src}) s WHERE label = 1 "
        f"UNION ALL SELECT example_id, label, 1 AS copy_no FROM ({ranked}) r "
        f"WHERE rn <= {py_round(f'CAST({float(ratio)!r} AS DOUBLE) * CAST(n0 AS DOUBLE)')}"
    )


def oversample(src: str, factor: int = 2) -> str:
    return (
        f"SELECT example_id, label, CAST(copy_no AS INTEGER) AS copy_no FROM ({src}) s, "
        f"generate_series(1, CASE WHEN label = 1 THEN {int(factor)} ELSE 1 END) AS t(copy_no)"
    )


def balance(src: str, neg_ratio: float = 0.5, seed=42) -> str:
    stats = (
        f"SELECT count(*) AS nn, count(*) FILTER (WHERE label = 1) AS n1, "
        f"CAST(floor(CAST(count(*) AS DOUBLE) * {float(neg_ratio)!r}) AS BIGINT) AS neg_t FROM ({src}) s"
    )
    qr = f"SELECT neg_t, (nn - neg_t) // n1 AS q, (nn - neg_t) % n1 AS r FROM ({stats}) st"
    ranked = (
        f"SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY {hash_key(seed, 'example_id')}, example_id) AS rn "
        f"FROM ({src}) s"
    )
    pos = (
        f"SELECT example_id, label, q + (CASE WHEN rn <= r THEN 1 ELSE 0 END) AS copies "
        f"FROM ({ranked}) x, ({qr}) p WHERE label = 1"
    )
    neg = f"SELECT example_id, label, 1 AS copies FROM ({ranked}) x, ({qr}) p WHERE label = 0 AND rn <= neg_t"
    return (
        f"SELECT example_id, label, CAST(copy_no AS INTEGER) AS copy_no FROM ({pos} UNION ALL {neg}) u, "
        f"generate_series(1, copies) AS t(copy_no) WHERE copies > 0"
    )
