"""WARC files, the link-graph filter, toxicity and the pipeline."""

import base64
import gzip
import hashlib
import json
import os
import random
import zlib

import messy
import pytest
from graded.llm import linkgraph, toxicity, warc
from graded.llm.common import fresh_path

PAGES = [
    (1, "http://a.example.org/x?q#f", "<p>one</p>"),
    (2, "http://b.example.org/es/1", "<p>same</p>"),
    (3, "HTTP://B.example.ORG/en/12", "<p>same</p>"),
    (4, None, None),
    (5, "no scheme", ""),
    (6, "http://shop.com/fr/a", "<p>same</p>"),
    (7, "https://shop.com/de/a", "x" * 200_000),
    (7, "https://shop.com/de/a", "x" * 200_000),
    (None, "http://c.org", "é🙂\r\n\r\nWARC/1.1"),
    (8, "http://org/", "line\r\nbreaks"),
    (9, "http://notexample.org/en/1", "<p>nine</p>"),
    (10, "http://shop.com?x=/fr/", "<p>ten</p>"),
    (11, "http://x.com/frx", "two://schemes http://org/"),
    (10**15, "x://y://z.org/w\n", "far"),
]


def pages(spark, rows=None):
    rows = PAGES if rows is None else rows
    return spark.createDataFrame([(*r, *messy.CLASH_VALUES) for r in rows], f"page_id long, url string, html string, {messy.CLASH}")


def want_records(rows, least=0):
    top = {}
    for i, _, h in rows:
        h = h or ""
        top[h] = max(top.get(h, (False, 0)), (i is not None, i or 0))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and (i is not None, i or 0) != top[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", top[h or ""][1] if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 11])
def test_archives_round_trip(spark, least):
    got = warc.write_and_read(pages(spark), least).collect()
    assert sorted(str(tuple(r)) for r in got) == want_records(PAGES, least)


def test_archives_are_the_same_however_partitioned(spark):
    rng = random.Random(2)
    rows = [(i * i, f"http://h{i % 7}.org/{i}", messy.words(rng, rng.randrange(1, 400))) for i in range(400)]
    rows += [(10**12 + i, None, "clustered " * 50 + str(i)) for i in range(300)]
    found = []
    for n in (1, 7):
        folder = fresh_path(spark, "warc-test")
        manifest = warc.write_archives(pages(spark, rows).repartition(n), folder, range_bytes=50_000, roll_bytes=20_000)
        found.append({(r.file, r.sha256, r.n_records) for r in manifest.collect()})
        local = folder.removeprefix("file://")
        assert sorted(os.listdir(local)) == sorted(x[0] for x in found[-1])  # no temporary names left
        got = sorted(str(tuple(r)) for r in warc.read_archives(manifest, folder).drop("url").collect())
        assert got == want_records(rows)
        for name, sha, _ in found[-1]:
            with open(f"{local}/{name}", "rb") as f:
                raw = f.read()
            assert hashlib.sha256(raw).hexdigest() == sha
            assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
            ids = [h["WARC-Page-ID"] for h, _ in warc.records(raw) if "WARC-Page-ID" in h]
            assert list(map(int, ids)) == sorted(map(int, ids))
    assert found[0] == found[1] and len(found[0]) > 5


def test_a_broken_file_is_an_error(spark):
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark), folder)
    name = manifest.first().file
    with open(f"{folder.removeprefix('file://')}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_archives(manifest, folder).collect()


def test_no_pages(spark):
    assert warc.write_and_read(pages(spark, [])).count() == 0
    assert linkgraph.filter_urls(pages(spark, [])).count() == 0


def test_url_rules(spark):
    got = {r.page_id: tuple(r)[1:] for r in linkgraph.filter_urls(pages(spark)).collect()}
    assert got[1] == ("a.example.org", "/x", "org/", "allow")
    assert got[2] == ("b.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("b.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8] == ("org", "/", "org/", "allow")
    assert got[9] == ("notexample.org", "/en/1", "org/", "allow")
    assert got[10][:3] == ("shop.com", "", None)
    assert got[11][:3] == ("x.com", "/frx", None)
    assert got[10**15][:3] == ("y:", "//z.org/w\n", None)
    assert got[None][:3] == ("c.org", "", None)
    assert len(linkgraph.filter_urls(pages(spark)).collect()) == len(PAGES)


def plain_ranks(edges, start, forward, rounds):
    out = {}
    for a, b, w in edges:
        key = a if forward else b
        out[key] = out.get(key, 0) + w
    rank = dict(start)
    for _ in range(rounds):
        new = {k: (1 - linkgraph.DAMPING) * v for k, v in start.items()}
        for a, b, w in edges:
            src, dst = (a, b) if forward else (b, a)
            if src in rank:
                new[dst] = new.get(dst, 0) + linkgraph.DAMPING * rank[src] * w / out[src]
        rank = new
    return rank


def test_propagation_equals_plain_rounds(spark):
    rng = random.Random(6)
    edges = {(f"h{rng.randrange(30)}", f"h{rng.randrange(30)}"): float(rng.randrange(1, 5)) for _ in range(120)}
    edges = [(a, b, w) for (a, b), w in edges.items() if a != b]
    trust, distrust = {"h1": 0.5, "h2": 1.0}, {"h3": 1.0, "h9": 0.25}
    start = [("trust", k, v) for k, v in trust.items()] + [("distrust", k, v) for k, v in distrust.items()]
    got = linkgraph.propagate(
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        spark.createDataFrame(start, "kind string, node string, rank double"),
        rounds=9,
    ).collect()
    found = {(r.kind, r.node): r.rank for r in got}
    for kind, seeds, forward in (("trust", trust, True), ("distrust", distrust, False)):
        want = plain_ranks(edges, seeds, forward, 9)
        assert {k[1] for k in found if k[0] == kind} == set(want)
        assert all(abs(found[kind, k] - v) < 1e-9 for k, v in want.items())


def test_links_carry_distrust_back(spark):
    link = lambda *hosts: "".join(f'<a class=x href="//{h.upper()}/p">' for h in hosts)
    rows = [(i, f"http://bad{i}.com/de/x", "") for i in range(5)]
    rows += [(10, "http://farm.net/x", link("bad0.com", "bad1.com", "bad2.com", "bad3.com") * 3)]
    rows += [(11, "http://good.net/x", link("c.org")), (12, "http://c.org/x", link("good.net"))]
    got = {r.page_id: r.verdict for r in linkgraph.filter_urls(pages(spark, rows)).collect()}
    assert got[10] == "block" and got[11] == "allow" and got[12] == "allow"
    edges = {(r.src, r.dst): r.weight for r in linkgraph.host_edges(linkgraph.judged(pages(spark, rows))).collect()}
    assert edges["farm.net", "bad0.com"] == 3 and ("good.net", "net") not in edges
    deep = linkgraph.host_edges(linkgraph.judged(pages(spark, [(1, "http://m.a.b.com/", "")]))).collect()
    assert {(r.src, r.dst) for r in deep} == {("m.a.b.com", "a.b.com"), ("a.b.com", "m.a.b.com"), ("a.b.com", "b.com"), ("b.com", "a.b.com")}


INSULTS = ("idiotgram", "clownish", "wretchword")


def toxic_texts(n, seed, toxic):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = messy.words(rng, rng.randrange(20, 150), 3000).split()
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "s", "ly"]))
        out.append(" ".join(w))
    return out


def labelled(spark, n=400):
    bad, good = toxic_texts(n, 1, True), toxic_texts(3 * n, 2, False)
    rows = [(i, t) for i, t in enumerate(bad + good)]
    labels = [(i, 1, int(i < n)) for i, _ in rows]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    rows += [(10**6, None), (10**6 + 1, ""), (None, "x"), (10**6 + 2, messy.words(random.Random(3), 9000))]
    docs = messy.documents(spark, rows)
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    test = [r for r in got if r.held_out and r.doc_id < 10**6]
    assert sum(r.predicted == int(r.doc_id < 400) for r in test) / len(test) > 0.97
    assert not [r for r in got if (r.doc_id is None or r.doc_id >= 10**6) and r.predicted]


def test_held_out_labels_are_not_read(spark):
    from pyspark.sql import functions as F

    rows, labels = labelled(spark, 60)
    docs = messy.documents(spark, rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_on(docs, labels) == toxicity.fit_on(docs, flipped)


def test_toxicity_without_labels(spark):
    docs = messy.documents(spark)
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 5)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.scored(docs, labels).collect()} == {(0.0, 0)}
    assert toxicity.drop_toxic(docs, labels).count() == docs.count()
    assert toxicity.scored(messy.empty(spark), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage on what the one before kept, against the rows planted."""
    import corpus_pipeline

    rows, labels = labelled(spark, 150)
    rng = random.Random(8)
    item = messy.words(rng, 25)
    base = messy.words(rng, 100)
    rows += [(5000, base), (5001, base), (5002, messy.words(rng, 30) + " " + item)]
    rows += [(5003, messy.words(rng, 20) + " token=abcdef99 end"), (5004, None), (5005, ""), (None, "null id text here")]
    sf = str(tmp_path)
    messy.documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{sf}/stage-{n}.parquet")
            docs = spark.read.parquet(f"{sf}/stage-{n}.parquet")
            kept.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i for i, _ in rows if i is not None and 150 <= i < 5000}
    toxic = {i for i, _ in rows if i is not None and i < 150}
    assert len(toxic & set(kept[0])) < 10 and len(clean - set(kept[0])) < 5
    assert 5001 in kept[0] and 5000 in kept[1] and 5001 not in kept[1]
    assert 5004 in kept[1] and 5005 not in kept[1] and None in kept[1]
    assert set(kept[1]) - set(kept[2]) == {5002}
    assert kept[3][5003].endswith(" [secret] end") and set(kept[3]) == set(kept[2])
    final = {r.doc_id: r for r in out.collect()}
    assert set(final) == set(kept[3])
    for i, text in kept[3].items():
        assert final[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf).count() == len(final)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
