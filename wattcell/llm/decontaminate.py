"""Benchmark decontamination with DataFrame functions only.

Texts are compared as words (runs of letters and digits, lower case) and shingles of five of
them; an item with fewer words is one shingle of all its words. A document contains an item when
it holds at least ``percent`` hundredths of the item's distinct shingles.

Items are partitioned by size into powers of two. In a partition with at most ``u`` shingles an
item is searched by its bottom-k MinHash sketch, its k shingles with the smallest hashes, with
k = floor(u * (100 - percent) / 100) + 1. A containing document lacks fewer than k shingles of the
item, so it holds one of the sketch: no containment is missed. The document side keeps its whole
shingle set, since under J = 30 / 20,000 a MinHash signature of a long document would hide the
item. Candidates are confirmed on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattcell.llm.links import fresh, small_side
from wattcell.session import materialize

GRAM = 5
PERCENT = 80


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty list for a null text or one without any."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced != "", F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def _grams(rows: DataFrame, n: int) -> DataFrame:
    """``id, gram``: a hash for each run of ``n`` words of ``id, words``."""
    spread = rows.where(F.size("words") >= n).select("id", "words", F.posexplode("words").alias("at", "word"))
    spread = spread.where(F.col("at") + n <= F.size("words"))
    parts = [F.col("words")[F.col("at") + i] for i in range(n)]
    return spread.select("id", F.xxhash64(F.lit(n), *parts).alias("gram"))


def item_grams(items: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """``item, gram, n_words``: the distinct shingles of every item, short items as a whole."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), word_list(F.col(text_col)).alias("words"))
    parts = [_grams(rows, gram).withColumn("n_words", F.lit(gram))]
    for n in range(1, gram):
        parts.append(_grams(rows.where(F.size("words") == n), n).withColumn("n_words", F.lit(n)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().withColumnRenamed("id", "item")


def sketches(grams: DataFrame, percent: int) -> DataFrame:
    """The bottom-k shingles of each item, k by the size partition; adds ``n_shingles``."""
    sized = grams.join(grams.groupBy("item").agg(F.count("*").alias("n_shingles")), "item")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_shingles").cast("double"))))
    sized = sized.withColumn("_k", F.floor(upper * (100 - percent) / 100) + 1)
    order = W.partitionBy("item").orderBy(F.xxhash64(F.lit(5), "gram"), "gram")
    return sized.withColumn("_at", F.row_number().over(order)).where("_at <= _k").drop("_at", "_k")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    gram: int = GRAM,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc id, item id, n_shingles, n_shared, containment`` of every document that contains an item.

    Null and empty texts, and texts without letters or digits, contain nothing and are contained
    nowhere. Rows with a null id are ignored. Repeated rows count once; rows of one item id with
    different texts are one item.
    """
    grams = materialize(item_grams(items, item_col, item_text_col, gram), "item_grams")
    sketch = materialize(sketches(grams, percent), "sketches")
    lengths = sorted(r[0] for r in grams.select("n_words").distinct().collect())  # at most `gram` of them
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def spread(rows: DataFrame) -> DataFrame:
        worded = rows.select("id", word_list(F.col("text")).alias("words"))
        out = _grams(worded, lengths[0] if lengths else gram)
        for n in lengths[1:]:
            out = out.unionByName(_grams(worded, n))
        return out

    found = spread(texts).join(small_side(sketch.select("item", "gram")), "gram").select("id", "item").distinct()
    found = materialize(found, "candidates")
    ids = materialize(found.select("id").distinct(), "candidate_ids")
    again = spread(texts.join(small_side(ids), "id", "left_semi"))
    shared = again.join(small_side(grams.select("item", "gram")), "gram").distinct()
    shared = shared.join(found, ["id", "item"], "left_semi").groupBy("id", "item").agg(F.count("*").alias("n_shared"))
    sizes = materialize(grams.groupBy("item").agg(F.count("*").alias("n_shingles")), "sizes")
    out = shared.join(small_side(sizes), "item").where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    return out.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "n_shingles",
        "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item; columns as given. Rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    name = fresh(docs, "_gone")
    gone = contained_items(docs, items, **options).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
