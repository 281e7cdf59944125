"""DuckDB SQL of the fitted sweep (:mod:`graded.operators.bayes`,
:mod:`graded.plans.sweep`): samples, word counts, coefficients and margins."""

from __future__ import annotations

from graded.functions.prompts import choose_template
from graded.operators import bayes as B
from graded.operators.encode import TOKEN_SPLIT
from graded.plans import oracle as O

TRAIN = O.corpus(split="train")


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), {O.lit(TOKEN_SPLIT)}), lambda w: w <> '')"


def _bucket(word: str) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, {B.BUCKET_HEX}) AS INTEGER)"


def _copies(cells, src: str) -> str:
    def drawn(strategy: str, seed: int) -> str:
        return {
            "undersample": lambda: O.undersample(src, seed=seed),
            "oversample": lambda: O.oversample(src),
            "balanced": lambda: O.balance(src, seed=seed),
            "normal": lambda: f"SELECT example_id, label, 1 AS copy_no FROM ({src}) n",
        }[strategy]()

    return " UNION ALL ".join(
        f"SELECT {i} AS cell, example_id, label, count(*) AS copies FROM ({drawn(st, sd)}) d GROUP BY example_id, label"
        for i, (st, sd) in enumerate(cells)
    )


def margins(cells, eval_src: str, prompts=None, weighted: bool = False) -> str:
    """Every example of ``eval_src`` under every cell (and prompt)."""
    src = f"SELECT example_id, label FROM ({TRAIN}) t"
    names = ", ".join(f"({i}, {O.lit(st)}, {sd})" for i, (st, sd) in enumerate(cells))
    plain = {p: choose_template(p) for p in prompts} if prompts else {"": ""}
    templates = ", ".join(f"({O.lit(p)}, {O.lit(B.outside(t))})" for p, t in plain.items())
    weight = "(n0 + n1)::DOUBLE / (2.0 * n{y}::DOUBLE)" if weighted else "1.0::DOUBLE"
    share = lambda y: (
        f"ln((c{y}::DOUBLE * g{y} + {B.MU!r} * share) / (t{y}::DOUBLE * g{y} + {B.MU!r}))"
    )
    whole = lambda x: f"CAST(floor(({x}) * {float(B.SCALE)!r} + 0.5) AS BIGINT)"
    return f"""
      WITH cells(cell, strategy, seed) AS (VALUES {names}),
      templates(prompt_name, template) AS (VALUES {templates}),
      copies AS MATERIALIZED ({_copies(cells, src)}),
      words AS (
        SELECT example_id, {_bucket('word')} AS bucket, count(*) AS n
        FROM (SELECT example_id, unnest({tokens('text')}) AS word FROM ({TRAIN}) c) u GROUP BY ALL),
      counts AS MATERIALIZED (
        SELECT cell, bucket, sum(n * copies) FILTER (WHERE label = 1) AS c1, sum(n * copies) FILTER (WHERE label = 0) AS c0
        FROM copies JOIN words USING (example_id) GROUP BY cell, bucket),
      drawn AS (
        SELECT cell, sum(copies) FILTER (WHERE label = 1) AS n1, sum(copies) FILTER (WHERE label = 0) AS n0
        FROM copies GROUP BY cell),
      sizes AS (
        SELECT cell, n1, n0, t1, t0, {weight.format(y=1)} AS g1, {weight.format(y=0)} AS g0
        FROM drawn JOIN (SELECT cell, sum(c1) AS t1, sum(c0) AS t0 FROM counts GROUP BY cell) t USING (cell)),
      coefs AS MATERIALIZED (
        SELECT cell, bucket, {whole(f"{share(1)} - {share(0)}")} AS w
        FROM (SELECT *, (c0::DOUBLE * g0 + c1::DOUBLE * g1) / (t0::DOUBLE * g0 + t1::DOUBLE * g1) AS share
              FROM (SELECT cell, bucket, coalesce(c1, 0) AS c1, coalesce(c0, 0) AS c0 FROM counts) n JOIN sizes USING (cell)) x),
      shifts AS (
        SELECT s.cell, t.prompt_name, {whole('ln(s.n1::DOUBLE * s.g1) - ln(s.n0::DOUBLE * s.g0)')} + coalesce(sum(c.w), 0) AS shift
        FROM sizes s CROSS JOIN templates t
        LEFT JOIN (SELECT prompt_name, {_bucket('word')} AS bucket
                   FROM (SELECT prompt_name, unnest({tokens('template')}) AS word FROM templates) v) p ON p.prompt_name = t.prompt_name
        LEFT JOIN coefs c ON c.cell = s.cell AND c.bucket = p.bucket
        GROUP BY s.cell, t.prompt_name, s.n1, s.n0, s.g1, s.g0),
      found AS (
        SELECT example_id, {_bucket('word')} AS bucket, count(*) AS n
        FROM (SELECT example_id, unnest({tokens('text')}) AS word FROM ({eval_src}) e) u GROUP BY ALL),
      own AS (SELECT example_id, cell, sum(n * w) AS w FROM found JOIN coefs USING (bucket) GROUP BY example_id, cell)
      SELECT e.*, g.strategy, g.seed, f.prompt_name, CAST(f.shift + coalesce(o.w, 0) AS BIGINT) AS margin
      FROM ({eval_src}) e CROSS JOIN cells g JOIN shifts f USING (cell)
      LEFT JOIN own o ON o.example_id = e.example_id AND o.cell = g.cell"""


def spoken(margin: str, yes: str = "ja", no: str = "nee") -> str:
    parts = [f"WHEN {margin} = 0 THEN 'misschien'"]
    for least, form in B.FORMS:
        for word, sign in ((yes, ">"), (no, "<")):
            text = form.replace("{WORD}", word.upper()).replace("{word}", word)
            parts.append(f"WHEN {margin} {sign} 0 AND abs({margin}) >= {int(least * B.SCALE)} THEN {O.lit(text)}")
    return f"(CASE {' '.join(parts)} END)"


def decide(margin: str) -> str:
    return f"CAST({margin} > 0 AS INTEGER)"
