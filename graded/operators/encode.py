"""V1 vocabulary and encoding, V12 label-word check.

Re-aimed from a subword tokenizer: the default vocabulary is a word
vocabulary built by Spark from the whole texts (frequency-ranked, ties by
word); ids 0 and 1 are padding and unknown.

Scale notes:
* word counts aggregate map-side, so hot words (``the``) cost nothing extra;
* the counts are range-partitioned by (count descending, word); a word's id is
  its place in its partition plus the sizes of the partitions before it, one
  number per partition. No window sees words;
* the ``HOT_WORDS`` most frequent words (of at most ``HOT_CHARS`` characters:
  a bounded table) are broadcast to the tokens. Only tokens that this leaves
  open are shuffled, and each of their words is rarer than the hot ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graded.functions.text import _c
from graded.session import materialize

PAD_ID, UNK_ID = 0, 1
FIRST_WORD_ID = 2
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
HOT_WORDS = 100_000
HOT_CHARS = 64
ROW_BITS = 33  # of monotonically_increasing_id: the place in a partition


def tokens(c) -> Column:
    """Lower-cased letter/digit runs of the whole text."""
    # array_remove is code-generated; a filter lambda would be interpreted
    return F.array_remove(F.split(F.lower(_c(c)), TOKEN_SPLIT), "")


def build_vocabulary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cnt, id) for every word of every text. The words are counted and
    placed once, in a written table; ids follow from it wherever it is read."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (
        df.select(F.explode(tokens(text_col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    )
    order = [F.col("cnt").desc(), F.col("word")]
    # written once: places in partitions must not change between the two uses
    placed = materialize(
        counts.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "word_counts",
    ).withColumn("_part", F.shiftright("_at", ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    place = F.col("_at") - F.shiftleft(F.col("_part"), ROW_BITS)
    # one row per partition
    vocab = placed.join(F.broadcast(offsets), "_part").select(
        "word", "cnt", (F.col("_off") + place + FIRST_WORD_ID).cast("int").alias("id")
    )
    return vocab


def _lookup(tok: DataFrame, vocab: DataFrame, hot_words: int | None = None) -> DataFrame:
    """Left join tokens to ids. Hot words are looked up by broadcast; only
    tokens of other words are shuffled."""
    v = vocab.select("word", "id")
    is_hot = (F.col("id") < FIRST_WORD_ID + (HOT_WORDS if hot_words is None else hot_words)) & (
        F.length("word") <= HOT_CHARS
    )
    j = tok.join(F.broadcast(v.filter(is_hot)), "word", "left")
    open_ = F.col("id").isNull() & F.col("word").isNotNull()
    found = j.filter(~open_)
    rest = j.filter(open_).drop("id").join(v.filter(~is_hot), "word", "left")
    return found.unionByName(rest)


def encode(
    df: DataFrame,
    vocab: DataFrame,
    key: str | list[str] = "example_id",
    text_col: str = "text",
    max_len: int = 512,
    out: str = "input_ids",
    hot_words: int | None = None,
) -> DataFrame:
    """V1: (key, input_ids, attention_mask) truncated at ``max_len``
    (unknown words -> UNK_ID). Each re-aggregated array holds at most
    ``max_len`` ids, so no group is unbounded; a text's ids are collected
    before the exchange, which moves arrays, not tokens."""
    keys = [key] if isinstance(key, str) else list(key)
    # the whole text is tokenized; only the first max_len tokens are exploded
    # (posexplode_outer keeps texts without any token as one NULL row)
    tok = df.select(*keys, F.posexplode_outer(F.slice(tokens(text_col), 1, max_len)).alias("pos", "word"))
    j = _lookup(tok, vocab, hot_words).withColumn("id", F.coalesce(F.col("id"), F.lit(UNK_ID)))
    item = F.when(F.col("word").isNotNull(), F.struct("pos", "id"))
    enc = j.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_p"))
    enc = enc.select(*keys, F.col("_p.id").cast("array<int>").alias(out))
    return enc.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(out)))


def encode_words(words: list[str], vocab: DataFrame) -> DataFrame:
    """How many ids each label word encodes to (must be exactly one)."""
    spark = vocab.sparkSession
    w = spark.createDataFrame([(x,) for x in words], "label_word string")
    tok = w.select("label_word", F.posexplode(tokens("label_word")).alias("pos", "word"))
    j = _lookup(tok, vocab)
    return j.groupBy("label_word").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.min(F.coalesce("id", F.lit(UNK_ID))).alias("first_id"),
    ).withColumn("single_token", (F.col("n_tokens") == 1) & (F.col("first_id") != UNK_ID))
