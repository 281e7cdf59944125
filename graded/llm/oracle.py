"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# The base patterns, the group whose length counts, and the
# least length (kept apart from the operator's own, which they check).
SECRETS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def _spans_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """List of a rule's spans in ``text``: gaps between matches and matches
    alternate, so running lengths give the offsets."""
    p = pattern.replace("'", "''")
    return f"""
      CASE WHEN regexp_matches(text, '{p}') THEN (
        SELECT list_filter(
          list_transform(range(1, len(m) + 1), lambda i: {{
            'start': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT
                   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT,
            'rank': {rank},
            'stop': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT
                  + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0)::BIGINT,
            'kind': '{kind}', 'size': length(v[i])}}),
          lambda s: s.size >= {least})
        FROM (SELECT string_split_regex(text, '{p}') AS g,
                     regexp_extract_all(text, '{p}', 0) AS m,
                     regexp_extract_all(text, '{p}', {group}) AS v))
      ELSE [] END"""


def _secrets_sql() -> str:
    spans = " || ".join(f"({_spans_sql(i, *r)})" for i, r in enumerate(SECRETS))
    counts = ", ".join(
        f"len(list_filter(found, lambda s: s.kind = '{r[0]}'))::BIGINT AS n_{r[0]}"
        for r in SECRETS
    )
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    spans AS (SELECT doc_id, list_sort({spans}) AS found FROM docs),
    named AS (
      SELECT doc_id, {counts},
        coalesce(list_aggregate(list_transform(found,
          lambda s: s.kind || ':' || s.start || ':' || s.stop), 'string_agg', ','), '') AS spans
      FROM spans)
    SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM named
    """


def _warc_sql() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda at: (  # noqa: E731  40 bits of the digest as 8 digits
        f"list_aggregate(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda b: "
        f"substr('{digits}', 1 + (((('0x' || substr(h, {at}, 10))::BIGINT) >> b) & 31)::INT, 1)), "
        f"'string_agg', '')"
    )
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM d)
    SELECT page_id, payload_bytes,
           {part(1)} || {part(11)} || {part(21)} || {part(31)} AS payload_digest,
           CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> response THEN response END AS refers_to
    FROM r
    """


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL = rf"""
    WITH runs AS (
      SELECT row_number() OVER () AS row_no, doc_id,
             regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    docs AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n, terms FROM runs WHERE len(terms) > 0),
    totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
    items AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    tf AS (
      SELECT row_no, term, count(*)::BIGINT AS tf
      FROM (SELECT row_no, unnest(terms) AS term FROM docs)
      WHERE term IN (SELECT term FROM items) GROUP BY row_no, term),
    weights AS (
      SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, totals GROUP BY term, big_n),
    parts AS (
      SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part
      FROM tf JOIN docs USING (row_no) JOIN weights USING (term), totals),
    scores AS (
      SELECT item_id, row_no, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score
      FROM items JOIN parts USING (term) GROUP BY item_id, row_no),
    ranks AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank,
             doc_id, score
      FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
    """


PHRASES = rf"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    split AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
    counts AS (
      SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*)::BIGINT AS f
      FROM places, (SELECT unnest([1, 2, 3, 4]) AS k)
      WHERE i + k - 1 <= len(w) GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
    candidates AS (
      SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
    cuts AS (
      SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:], ' ') AS two
      FROM candidates c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
    scored AS (
      SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r,
             ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
      FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.one
                  JOIN counts y ON y.lang = c.lang AND y.phrase = c.two),
    weakest AS (
      SELECT * FROM scored
      QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    longer AS (
      SELECT lang, inner_phrase, max(a) AS f
      FROM (SELECT lang, a, array_to_string(w[i:i + size - 1], ' ') AS inner_phrase
            FROM candidates, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS size)
            WHERE size < k AND i + size - 1 <= k)
      GROUP BY lang, inner_phrase),
    ranks AS (
      SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank,
             phrase, a, l, r, n, score
      FROM weakest s JOIN totals USING (lang)
      LEFT JOIN longer o ON o.lang = s.lang AND o.inner_phrase = s.phrase
      WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * a)
    SELECT * FROM ranks WHERE rank <= 2000
    """


SQL: dict[str, str] = {
    "op2_warc_archives": _warc_sql(),
    "op3_secret_scan": _secrets_sql(),
    "op11_lexical_search": LEXICAL,
    "op12_phrase_collocations": PHRASES,
}
