"""SimHash components, repeated passages and templates against brute force."""

import random
import re

import messy
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from graded.llm import components, simhash, suffixes, templates
from pyspark.sql import Row


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points):
    """Smallest member index of each point's component under 3 bits."""
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(points))]


def test_simhash_of_messy_rows(spark):
    rows = messy.texts()
    got = simhash.near_duplicates(messy.documents(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    fps = [plain_fingerprint(t) for _, t in order]
    low = plain_components(fps)
    want = [(i, f"{f:016x}", order[c][0]) for (i, _), f, c in zip(order, fps, low, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(messy.empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    docs = messy.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    rows = sorted(messy.texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    low = plain_components([plain_fingerprint(t) for _, t in rows])
    assert got == sorted({str(rows[c]) for c in low})


def chains(n=3000, seed=7):
    """Random fingerprints, chains that drift bit by bit, and a dense ball."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for start in out[:40]:
        for _ in range(rng.randrange(1, 12)):
            for _ in range(rng.randrange(1, 5)):
                start ^= 1 << rng.randrange(64)
            out.append(start)
    centre = rng.getrandbits(64)
    for _ in range(400):
        x = centre
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("leaf,big", [(100, 50_000), (100, 150)])
def test_vantage_point_trees_find_every_link(spark, monkeypatch, leaf, big):
    """Deep trees, and leaves cut into blocks, against all pairs."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BIG", big)
    points = chains()
    signed = [x - 2**64 if x >> 63 else x for x in points]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(frame, len(points))).collect()}
    a = np.array(points, dtype=np.uint64)
    label = np.arange(len(a))
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)
        both = np.unique(label[near])
        if len(both) > 1:
            label[np.isin(label, both)] = both[0]
    ours = [roots.get(x, x) for x in signed]
    assert len(set(zip(label.tolist(), ours, strict=True))) == len(set(label.tolist())) == len(set(ours))


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], n) for n in names[201:]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (names[:200], names[200:]):
        assert {got.get(n, n) for n in part} == {min(part)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(rows):
    """(id, word) pairs inside a run of 50 words that another document has."""
    docs = {(i, t): suffixes.words_of(t or "") for i, t in rows}
    seen = {}
    for d, w in docs.items():
        for p in range(len(w) - suffixes.PASSAGE + 1):
            seen.setdefault(tuple(w[p : p + suffixes.PASSAGE]), set()).add(d)
    return {
        (d[0], q)
        for d, w in docs.items()
        for p in range(len(w) - suffixes.PASSAGE + 1)
        if len(seen[tuple(w[p : p + suffixes.PASSAGE])]) > 1
        for q in range(p, p + suffixes.PASSAGE)
    }


def passages(seed, n=150):
    rng = random.Random(seed)
    shared = [messy.words(rng, k).split() for k in (45, 49, 50, 51, 55, 70, 120, 300)]
    rows = list(messy.texts(seed))
    for i in range(n):
        out = messy.words(rng, rng.randrange(5, 90)).split()
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(shared))
            a = rng.randrange(len(p) // 2)
            p = p[a : a + rng.randrange(20, 400)]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            at = rng.randrange(len(out) + 1)
            out[at:at] = p
        rows.append((100 + i, rng.choice([" ", "\n", "  "]).join(out)))
    base = messy.words(rng, 400).split()
    for i in range(60):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(400)] = f"e{i}"
        rows.append((1000 + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("partitions,chunk,edge", [(8, 30_000, 2000), (60, 30_000, 2000), (5, 40, 2000), (1, 30_000, 2000), (3, 200, 15), (2, 30_000, 0)])
def test_repeated_passages_equal_all_windows(spark, monkeypatch, partitions, chunk, edge):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "EDGE", edge)
    rows = passages(seed=partitions)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = suffixes.repeated_passages(messy.documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    got = {(r.doc_id, q) for r in found for q in range(r.start_word, r.end_word)}
    assert got == plain_repeats(rows)
    assert sorted(map(str, found)) == sorted(map(str, plain_spans(rows)))


def plain_spans(rows):
    """The rows of ``repeated_passages`` from all windows."""
    null = lambda i: suffixes.NULL_KEY if i is None else i
    docs = {(null(i), xxhash64_of(t)): suffixes.words_of(t or "") for i, t in rows}
    where = {}
    for d, w in docs.items():
        for p in range(len(w) - suffixes.PASSAGE + 1):
            where.setdefault(tuple(w[p : p + suffixes.PASSAGE]), []).append((*d, p))
    pieces = {}
    for places in where.values():
        members = sorted({d[:2] for d in places})
        if len(members) > 1:
            first = min(places)
            for *d, p in places:
                partner = members[1] if tuple(d) == members[0] else members[0]
                pieces.setdefault((*d, *first[:2], partner[0], first[2] - p), []).append(p)
    out = []
    for (key, _, low, _, partner, away), starts in pieces.items():
        starts.sort()
        begin = end = None
        for p in [*starts, None]:
            if begin is not None and (p is None or p > end):
                open_ = lambda k: None if k == suffixes.NULL_KEY else k
                out.append(Row(doc_id=open_(key), start_word=begin, end_word=end, n_words=end - begin, partner_id=open_(partner), class_id=open_(low), class_start=begin + away))
                begin = None
            if p is not None:
                begin = p if begin is None else begin
                end = p + suffixes.PASSAGE
    return out


def xxhash64_of(text):
    """Spark's xxhash64 of a string (null: its seed)."""
    import xxhash

    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("n,edge,partitions", [(300, 20, 8), (12_000, 2000, 3)])
def test_repeats_that_extend_left_of_a_large_run(spark, monkeypatch, n, edge, partitions):
    """A notice in most rows; pairs also share the words before it, and what
    follows sorts them far apart. (The workers import the module anew, so that
    only a run above the true EDGE shows a cut made there.)"""
    monkeypatch.setattr(suffixes, "EDGE", edge)
    rng = random.Random(partitions)
    notice = messy.words(rng, 40)
    rows = [(i, f"{messy.words(rng, 6)} {notice} {messy.words(rng, 20)}") for i in range(n)]
    for i in range(n, n + 60, 2):
        before = messy.words(rng, 10 + i % 3)
        rows += [(i + k, f"{messy.words(rng, 5)} {before} {notice} {messy.words(rng, 20)}") for k in range(2)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = suffixes.repeated_passages(messy.documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    got = {(r.doc_id, q) for r in found for q in range(r.start_word, r.end_word)}
    assert got == plain_repeats(rows) and len({i for i, _ in got}) >= 60
    assert {r.doc_id: r.partner_id for r in found if r.doc_id >= n} == {i: i ^ 1 for i in range(n, n + 60)}


class Tasks:
    """Stands for a table of one partition: runs a task's function here."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_suffixes_of_many_texts_are_cut_out_at_once():
    rng = random.Random(5)
    texts = [None, "", "  \n", *(rng.choice([" ", "\n ", "\u2003"]).join(messy.words(rng, rng.randrange(20, 300)).split()) for _ in range(200))]
    places = [sorted(rng.sample(range(n - 18), min(n - 18, 6))) if (n := len(suffixes.words_of(t or ""))) > 18 else [] for t in texts]
    given = [[{"pos": p, "lo": 0, "hi": p % 32, "hash": p * 7} for p in reversed(x)] for x in places]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("lo", pa.int8()), ("hi", pa.int8()), ("hash", pa.int64())]))
    n = len(texts)
    batch = pa.record_batch(
        [pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), pa.array(given, kind)],
        ["key", "tie", "text", "places"],
    )
    made = suffixes.cut_out(Tasks(batch))
    want = []
    for i, (t, x) in enumerate(zip(texts, places, strict=True)):
        w = (t or "").split()
        for p in x:
            right, left = " ".join(w[p : p + 50]), " ".join(w[max(0, p - 31) : p][::-1])
            want.append({"key": i, "tie": i, "pos": p, "lo": 0, "hi": p % 32, "hash": p * 7, "right": right, "left": left})
    assert [r for b in made for r in b.to_pylist()] == want
    assert len(made) == 1  # not one for each text


def test_large_runs_look_at_their_own_texts_only(spark):
    rng = random.Random(6)
    notice = messy.words(rng, 60)
    rows = [(i, f"{messy.words(rng, 40)} {notice} {messy.words(rng, 40)}") for i in range(12)]
    rows += [(100 + i, messy.words(rng, 200)) for i in range(30)]
    rows += [(200 + i, rows[20][1]) for i in range(3)]
    docs = suffixes._documents(messy.documents(spark, rows))
    kept = suffixes.sample(docs).cache()
    large = kept.groupBy("hash").count().where("count >= 12").cache()
    every = np.full(2 ** (suffixes.BITS - 6), 2**64 - 1, dtype=np.uint64)
    exact = suffixes._bitmap(large)
    own = suffixes._bitmap(kept.join(large, "hash", "left_semi").select(suffixes._document().alias("hash")))
    read = {r.key for r in suffixes.passages(docs, every, own).select("key").distinct().collect()}
    assert read == set(range(12))
    # bits that other hashes set change no row
    some = suffixes.counted_passages(docs, kept, large, exact).collect()
    assert sorted(map(str, suffixes.counted_passages(docs, kept, large, every).collect())) == sorted(map(str, some))
    assert {r.key for r in some} == set(range(12))


def test_repeats_need_two_documents(spark):
    rng = random.Random(4)
    p = messy.words(rng, 80)
    assert suffixes.repeated_passages(messy.documents(spark, [(1, p + " x " + p), (2, messy.words(rng, 80))])).count() == 0
    assert suffixes.repeated_passages(messy.empty(spark)).count() == 0


ITEMS = [
    (0, "Anna Berg buys 12 apples and 7 pears for 30 euros in the market. How much does Anna pay for 12 apples?"),
    (1, "what is the capital of the large country that lies north of the river"),
    (2, "two five seven nine eleven words here"),
    (3, "too short"),
    (4, None),
    (5, ""),
    (None, "an item without an id that is long enough to be found in a text somewhere"),
]


def items(spark):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, key int, hash int")


def test_templates_catch_new_parameters(spark):
    rng = random.Random(3)
    filler = messy.words(rng, 20)
    q = ITEMS[0][1]
    consistent = q.replace("12", "40").replace("Anna", "Olga").replace("Berg", "Hill").replace("pears", "pears")
    broken = consistent.replace("for 40 apples", "for 41 apples")
    other_unit = q.replace("30 euros", "30 dollars")
    rows = [
        (1, filler + ". " + q + " " + filler),
        (2, filler + ". " + consistent),
        (3, filler + ". " + broken),
        (4, filler + ". " + other_unit),
        (5, filler),
        (6, None),
        (7, ""),
        (8, "WHAT is the capital,\n of the large country that lies north of the river!"),
        (9, "... " + ITEMS[2][1] + "."),
        (10, "too short"),
        (None, "x " + ITEMS[6][1]),
        (8, "WHAT is the capital,\n of the large country that lies north of the river!"),
        (11, "the capital of the"),
    ]
    docs = messy.documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, items(spark)).collect()}
    assert got == {(1, 0), (2, 0), (4, 0), (8, 1), (9, 2), (None, None)}
    kept = templates.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "11", "3", "5", "6", "7"]
    assert templates.contaminated(messy.empty(spark), items(spark)).count() == 0
    none = items(spark).limit(0)
    assert templates.contaminated(docs, none).count() == 0 and templates.drop_contaminated(docs, none).count() == len(rows)


def test_templates_are_consistent_by_occurrence(spark):
    rng = random.Random(5)
    filler = lambda n: messy.words(rng, n)
    twice = "the price of item 1 is 5 dollars here and the price of item 2 is 7 dollars here so what will both of them cost today"
    other = ITEMS[0][1].replace("12", "40").replace("Anna", "Olga")
    broken = other.replace("for 40 apples", "for 41 apples")
    rows = [
        (1, f"{filler(30)}. {twice} {filler(9)}"),
        (2, f"{filler(30)}. {twice.replace('1', '3').replace('5', '6').replace('and', 'and also')}"),
        (3, f"{filler(30)}. {ITEMS[0][1]} {filler(50)}. {other}"),
        (4, f"{filler(5)}. {other} {filler(50)}. Then Olga Hill buys 77 apples and 9 pears for 20 euros in the city"),
        (5, f"{filler(30)}. {broken} {filler(50)}. {broken.replace('41', '42')}"),
        (6, filler(60)),
    ]
    frame = spark.createDataFrame([(0, ITEMS[0][1]), (1, twice)], "item_id long, text string")
    found = templates.contaminated(messy.documents(spark, rows), frame).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (3, 0), (4, 0)}
    by = {r.doc_id: r for r in found}
    assert by[1].share == by[3].share == 1.0 > by[4].share > 0.9 and by[1].first_token == by[3].first_token == 30
    assert 0.5 <= by[2].share < 1


def test_items_without_templates_match_word_for_word(spark):
    rng = random.Random(6)
    table = "12 15 3.5 77 $20 19 1,000 8 9 10 11 12"
    benchmark = ["What is 12 plus 7", "Who wrote Hamlet?", "3 + 4 = 7", table, "-5 and 6 7"]
    frame = spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string")
    filler = messy.words(rng, 20)
    rows = [(i, f"{filler}. {t} {filler}") for i, t in enumerate(benchmark)]
    rows += [(10 + i, f"{filler} ({t.upper()}). {filler}") for i, t in enumerate(benchmark)]
    rows += [(20, f"{filler} what is 12 plus 8 {filler}"), (21, f"{filler} 3 - 4 = 7 {filler}"), (22, f"{filler} 3, 4, 7")]
    rows += [(23, "who wrote"), (24, table.replace("77", "78").replace("8 9", "9 8")), (25, "5 and 6 7"), (26, f"{filler} {table}")]
    docs = messy.documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, frame).collect()}
    assert got == {(i, i) for i in range(5)} | {(10 + i, i) for i in range(5)} | {(26, 3)}
    assert sorted(r.doc_id for r in templates.drop_contaminated(docs, frame).collect()) == [20, 21, 22, 23, 24, 25]


def test_templates_against_plain_windows(spark):
    """Random texts of few words: every window's match is found, hashed or not."""
    rng = random.Random(9)
    benchmark = [(i, " ".join(f"v{rng.randrange(3)}" for _ in range(rng.randrange(5, 14)))) for i in range(12)]
    rows = [(i, " ".join(f"v{rng.randrange(3)}" for _ in range(60))) for i in range(80)]
    frame = spark.createDataFrame(benchmark, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in templates.contaminated(messy.documents(spark, rows), frame).collect()}
    want = {}
    for d, text in rows:
        w = text.split()
        for i, item in benchmark:
            v = item.split()
            size = min(templates.WINDOW, len(v))
            theirs = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)}
            ours = [tuple(v[p : p + size]) for p in range(len(v) - size + 1)]
            hit = sum(x in theirs for x in ours)
            if hit and hit >= templates.SHARE * len(ours):
                want[d, i] = (len(ours), hit)
    assert got == want and want


def test_words_of_letters_need_no_pattern():
    rng = random.Random(4)
    letters = "aAbZéÉßǅ二ªⅣ٣5²%.,:;!?\"')]-+$€_İıſ"
    raws = ["The", "km", "km.", "%", "5", "I", "aB", "é.", "x,", "...", "-5", "USA", "٣"]
    raws += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(20_000)]
    assert [templates.token_of(r) for r in raws] == [templates._any_token(r) for r in raws]
