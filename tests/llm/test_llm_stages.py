"""The pipeline's stages on empty tables, nulls, repeated rows and clashing
column names."""

import messy
import pytest
from graded.llm import secret_scan, simhash, templates, toxicity


def labels(spark, n=60):
    rows = [(i, i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "what is the price of seven green apples and two pears today"), (2, None)], "item_id long, text string")


def stages(spark):
    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels(spark)),
        "simhash": lambda d: simhash.keep_one(d),
        "templates": lambda d: templates.drop_contaminated(d, items(spark)),
        "secrets": lambda d: secret_scan.redact(d),
    }


NAMES = ["toxicity", "simhash", "templates", "secrets"]


def learnable(spark):
    """Enough labelled texts of both classes for the classifier."""
    rows = [(i, ("vile hateful awful " if i % 2 else "calm garden flower ") * 6 + f"w{i}") for i in range(60)]
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_stay_empty(spark, name):
    docs = messy.empty(spark)
    out = stages(spark)[name](docs)
    assert out.columns == docs.columns and out.count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_columns_come_back_as_they_were(spark, name):
    rows = [*learnable(spark), (100, None), (101, ""), (None, "a null id alone"), (102, "x" * 9000)]
    docs = messy.documents(spark, rows)
    out = stages(spark)[name](docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    clash = docs.columns[5:]
    kept = out.collect()
    assert kept and {tuple(r[c] for c in clash) for r in kept} == {messy.CLASH_VALUES}
    texts = {(r["doc_id"], r["text"]) for r in kept}
    assert texts <= set(rows) and (name == "toxicity" or (102, "x" * 9000) in texts)


def test_one_row_stays_of_rows_that_repeat_id_and_text(spark):
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(1, same, "b"), (1, same, "a"), (2, same, "c"), (3, "other words here", None)], "doc_id long, text string, source string")
    for n in (1, 4):
        assert sorted(map(tuple, simhash.keep_one(docs.repartition(n)).collect())) == [(1, same, "a"), (3, "other words here", None)]


def test_toxicity_scores_equal_a_plain_loop(spark):
    """Lengths of every window under both dictionaries, one by one, and the
    logistic score of their differences."""
    import math
    import re

    import zstandard

    rows = [*learnable(spark), (200, None), (201, ""), (202, "Vile calm HATEFUL garden é flower awful " * 40)]
    docs = messy.documents(spark, rows)
    model = toxicity.fit_on(docs, labels(spark))
    assert model.constant is None

    def length(content, data):
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            min_match=5, window_log=15, hash_log=13, chain_log=13,
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress(data))

    def plain(text):
        found = re.findall(r"\w+", (text or "").lower())
        windows = [b"#" * 64 + f" {' '.join(found[i : i + 4])} ".encode() for i in range(0, len(found), 4)]
        gains = [length(model.ordinary, w) - length(model.toxic, w) for w in windows] or [0]
        n = len(gains)
        x = [sum(gains) / n, *[sum(g >= s for g in gains) / n for s in (1, 3, 4, 5)], math.log1p(n)]
        z = sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.scale)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.scored(docs, labels(spark)).collect()}
    for i, text in rows:
        score = plain(text)
        assert got[i][0] == pytest.approx(score, abs=1e-9)
        assert got[i][1] == (got[i][0] >= 0.7)


def test_written_tables_can_be_dropped(spark):
    import os

    from graded.llm import common

    common.written(spark.range(3).toDF("a"), "dropped")
    folder = common.fresh_path(spark, "").rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    common.drop_written(spark)
    assert not os.path.exists(folder)


def test_object_stores_are_opened_by_their_own_name(monkeypatch):
    from graded.llm import files

    seen = []

    class Store:
        from_uri = staticmethod(seen.append)

    monkeypatch.setattr(files, "pafs", type("pafs", (), {"FileSystem": Store}))
    for folder in ("s3a://b/x", "s3n://b/x", "s3://b/x", "file:///x/s3a://y"):
        files.file_system(folder)
    assert seen == ["s3://b/x", "s3://b/x", "s3://b/x", "file:///x/s3a://y"]
