"""Lexical search, phrase mining and personal data against plain versions."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import pairwise

import messy
import pytest
from graded.llm import lexical, phrases, pii, spans
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, best):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc, tf, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
                for w in words
                if tf[w]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def odd_documents(seed=5, n=150):
    rng = random.Random(seed)
    rows = messy.texts(seed)
    pool = ["the", "The", "é", "Éa", "漢字", "a1", "x-y", "o'neil", "🙂", "z_z", "A"]
    for i in range(100, 100 + n):
        text = "".join(rng.choice(pool) + rng.choice([" ", "  ", ",", "\n", "\x00", "\t", "-"]) for _ in range(rng.randrange(40)))
        rows.append((i, text))
    return rows + rows[-3:]


def item_rows():
    return [(1, "The é A1"), (2, "漢字 z neil"), (2, "w1 w2 w3"), (3, None), (4, ""), (None, "w5 o the"), (5, "unheard of"), (6, "🙂 ÉA éa the the"), (7, "one token x")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(item_rows(), "item_id long, text string")


def found_by(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_equals_plain_ranking(spark, items):
    rows = odd_documents()
    docs = messy.documents(spark, rows).repartition(5)
    assert found_by(lexical.search(docs, items)) == plain_search(rows, item_rows(), 10)
    assert found_by(lexical.search(docs.coalesce(1), items, best=3)) == plain_search(rows, item_rows(), 3)


def test_search_in_blocks_is_the_same(spark, items, monkeypatch):
    rows = odd_documents(6)
    docs = messy.documents(spark, rows)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 12)
    dealt, n = lexical.blocks(lexical.item_terms(items))
    assert n > 1
    assert found_by(lexical.search(docs, items)) == plain_search(rows, item_rows(), 10)


def test_search_keeps_the_best_of_many_batches(spark, monkeypatch):
    rows = [(i, "common " * (1 + i % 7) + "rare " * (i % 3)) for i in range(400)]
    monkeypatch.setattr(lexical, "CELLS", 64)
    items = spark.createDataFrame([(1, "common"), (2, "rare common")], "item_id long, text string")
    got = found_by(lexical.search(messy.documents(spark, rows), items))
    assert got == plain_search(rows, [(1, "common"), (2, "rare common")], 10)


def test_search_of_empty_tables(spark, items):
    assert lexical.search(messy.empty(spark), items).count() == 0
    assert lexical.search(messy.documents(spark), items.where("item_id < 0")).count() == 0


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, least, best):
    """rows: (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            if p in longer and 100 * longer[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=str)


def phrase_rows(seed=7):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "é", "漢", "a", "b", "c", "new", "york", "\x1c", "x\x00y"]
    rows = []
    for _ in range(220):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return [*rows, ("en", "New York City " * 300), ("de", ""), ("de", None), ("fr", "eins"), ("en", "q " * 9000)]


def phrase_table(spark, rows):
    full = [(i, t, lang, *messy.CLASH_VALUES) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, {messy.CLASH}")


@pytest.mark.parametrize(("least", "best"), [(3, 2000), (30, 15)])
def test_phrases_equal_plain_counts(spark, least, best):
    rows = phrase_rows()
    got = phrases.collocations(phrase_table(spark, rows).repartition(4), best=best, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found_by(got) == plain_phrases(rows, least, best)


@pytest.mark.parametrize("budget", [1, 40, 10**6])
def test_phrase_counts_whatever_the_budget(spark, budget):
    """A budget of one suffix splits every cell; a large one has one group."""
    rows = phrase_rows(8)
    n_words, frequent = phrases.phrase_counts(phrase_table(spark, rows), least=4, budget=budget)
    plain = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                plain[k].update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    totals = Counter()
    for (lang, _), f in plain[1].items():
        totals[lang] += f
    assert {r["lang"]: r["n"] for r in n_words.where("n > 0").collect()} == totals
    many = {(r["lang"], r["phrase"]): r["f"] for r in frequent.collect()}
    assert many == {p: f for k in (1, 2, 3, 4) for p, f in plain[k].items() if f >= 4}


def test_chunks_are_cut_at_pieces_only(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK", 50)
    text = " ".join(f"w{i}{'.' if i % 9 == 0 else ''}" for i in range(300)).encode()
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    cut = list(phrases.chunks(batch))
    assert len(cut) > 5
    pairs = Counter()
    for chunk in cut:
        names = chunk.distinct.to_pylist()
        pairs.update((names[a], names[b]) for a, b in zip(chunk.words, chunk.after(1)) if b >= 0)
    whole = Counter(p for piece in text.split(b".") for p in pairwise(piece.split()))
    assert pairs == whole


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(phrase_table(spark, [])).count() == 0


# ---------------------------------------------------------- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(number):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - (9 if c > "4" else 0) for i, c in enumerate(reversed(number))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for x in re.finditer(pattern, text or ""):
            value = x.group()
            only = re.sub("[^0-9]", "", value)
            fits = {
                "email": lambda: True,
                "ip": lambda v=value: all(int(p) <= 255 for p in v.split(".")),
                "card": lambda d=only: 16 <= len(d) <= 19 and good(d),
                "phone": lambda d=only: 8 <= len(d) <= 15,
            }[kind]()
            if fits:
                out.append(f"{kind}:{x.start()}:{x.end()}")
    return out


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if good(head + c))


def phone(rng):
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}"


def address(rng):
    return ".".join(str(rng.randrange(1, 256)) for _ in range(4))


def mail(rng):
    return f"{rng.choice(['ann', 'bo.b', 'c_d'])}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"


def private_documents(seed=11, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ernt", "thé", "onand", "🙂", "lüx", "Straße,", "the."])
    rows = []
    for i in range(n):
        parts = [word() for _ in range(rng.randrange(1, 12))]
        for make in rng.sample([card, phone, address, mail], rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), make(rng))
        if i % 10 == 0:
            parts.append(f'token = "{rng.getrandbits(120):030x}"')
        rows.append((i, " ".join(parts)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    made = pii.fit(messy.documents(spark, private_documents()))
    assert set(made.thresholds) == set(pii.KINDS)
    return made


def test_base_spans_equal_plain_matches(spark):
    rng = random.Random(3)
    parts = [*"0123456789", "12", "255", "256", "0", "+1", "a@b.co", "@", ".", "-", " ", "  ", "(", ")", "x", "é", "🙂", "+", "_", "%", "\n", "4111111111111111", "10.0.0.1", "a.b-c@d-e.f.g"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(1500)]
    rows += [*messy.texts(), (-1, "a@b.co_x@y.zz a@b.c@d.ee 1.2.3.4.5.6.7.8 300.1.1.1.9"), (-2, "+1234567 89 4111 1111 1111 1111")]
    none = pii.Model("0D", {})
    got = {(r["doc_id"], r["base_sha256"], r["spans"]) for r in pii.report(messy.documents(spark, rows), none).collect()}
    assert got == {(i, hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest(), ",".join(plain_base(t))) for i, t in rows}


def test_trees_add_what_neighbours_hide(spark, model):
    rng = random.Random(5)
    p, c, a = phone(rng), card(rng), address(rng)
    hidden = [(1, f"on {p} {c} the"), (2, f"ein {c} {c} und"), (3, f"le {a} {c} la"), (4, f"{c} {p}.")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(messy.documents(spark, hidden), model).collect()}
    for i, text in hidden:
        for kind, value in (("phone", p), ("card", c), ("ip", a)):
            at = text.find(value)
            if at >= 0:
                assert f"{kind}:{at}:{at + len(value)}" in got[i], (i, kind, got[i])


def test_trees_leave_clean_texts_alone(spark, model):
    rng = random.Random(6)
    clean = [(i, f'x token = "{rng.getrandbits(160):040x}" {rng.randrange(10**7)} v1.2.3 12:30:45 2024-01-31 p{rng.randrange(10**5)}') for i in range(200)]
    rows = pii.report(messy.documents(spark, clean), model).collect()
    assert all(r["spans"] == ",".join(plain_base(t)) for r, (_, t) in zip(sorted(rows, key=lambda r: r["doc_id"]), clean))


def test_base_spans_stay_and_rows_too(spark, model):
    rows = [*private_documents(12, 150), *messy.texts()]
    got = pii.report(messy.documents(spark, rows), model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    texts = {(i, hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest()): plain_base(t) for i, t in rows}
    for r in got:
        base = texts[r["doc_id"], r["base_sha256"]]
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]


def test_base_spans_of_single_digits(spark):
    rows = [(1, "on 1.2.3.4 the"), (2, "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 x"), (3, "+1 2 3 4 5 6 7 8"), (4, "x 1 y 2")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(messy.documents(spark, rows), pii.Model("0D", {})).collect()}
    assert got == {i: ",".join(plain_base(t)) for i, t in rows} and [i for i in got if got[i]] == [1, 2, 3]


def test_every_text_gives_examples(spark):
    rows = [(i, f"le {i // 250 + 1}.{i % 250}.1.2 la") for i in range(4000)]
    rows += [(4000, "on " * 10_000 + "+1 (212) 555-0100 the"), (4001, "de bo@mail.example.com la"), (4002, "de bo@mail.example.com la")]
    made = pii.examples(messy.documents(spark, rows)).where("label = 1")
    # a base and a narrow candidate of each; a text that repeats counts once
    n = {r["kind"]: r["n"] for r in made.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert n == {"ip": 2 * 4000, "phone": 2, "email": 1}


def test_personal_data_of_an_empty_table(spark):
    assert pii.report(messy.empty(spark)).count() == 0
    assert pii.fit(messy.documents(spark, [(1, None), (2, "")])) is None


def test_redaction_masks_spans(spark, model):
    rows = [(1, "é a@b.co,🙂 +1 (212) 555-0100 z"), (2, None), (3, "nothing"), (4, "a@b.co")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(messy.documents(spark, rows), model).collect()}
    assert got == {1: "é [email],🙂 [phone] z", 2: None, 3: "nothing", 4: "[email]"}


# ------------------------------------------------------------------ spans


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    for n in (0, 1, 127, 128, 129, 700):
        values = [rng.randrange(100) for _ in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(
            spans.running(F.col("v"), spans.add).alias("s"), spans.running(F.col("v"), F.greatest).alias("m")
        ).first()
        assert row["s"] == [sum(values[: i + 1]) for i in range(n)]
        assert row["m"] == [max(values[: i + 1]) for i in range(n)]


def test_many_matches_take_linear_time(spark):
    text = "a@b.co 10.0.0.1 " * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.report(docs.limit(0), pii.Model("0D", {})).collect()
    began = time.time()
    row = pii.report(docs, pii.Model("0D", {})).first()
    assert time.time() - began < 60
    assert row["n_email"] == row["n_ip"] == 20_000
    assert row["spans"].startswith("email:0:6,email:16:22,")


def test_masked_joins_spans_that_touch(spark):
    df = spark.createDataFrame([("ab🙂cdef", [(1, 3, "X"), (2, 3, "Y"), (3, 4, "Z"), (6, 7, "W")])], "t string, s array<struct<start:int,end:int,mask:string>>")
    assert df.select(spans.masked(F.col("t"), F.col("s"))).first()[0] == "aXdeW"
