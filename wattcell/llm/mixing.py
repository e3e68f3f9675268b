"""Mixing sources to target weights by dependent rounding, with DataFrame functions only.

Each source gets a target of words; target / size is the number of copies its documents should
have. The whole part is given to each document, the fraction is rounded by Pivotal sampling: two
fractions meet, mass moves at random from one to the other until one of them is 0 or 1, and the other
meets the next. Documents of similar size meet first, in blocks of about ``BLOCK`` rows, and the
residuals of the blocks meet in the next level of a reduction tree, until each source has one
left, which is drawn on its own. So a source's number of copies is exact to one document and its
words are close to the target. All draws are hashes of the ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattcell.llm.links import fresh
from wattcell.session import materialize

BLOCK = 512
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 1


def n_words(text: Column) -> Column:
    """Runs of characters other than space and x09 to x0D; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    Sources by code point, null last, take the weights in turn. They share ``share`` times the
    words of all; a target stops at ``most`` times its source, the excess goes to the others by
    weight until none is above. That is one water level: a source is full when the level at which it
    fills up needs no more than the total.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    weighted = weighted.withColumn("fills", F.col("cap") / F.col("w"))
    everything = W.partitionBy()
    up_to = W.orderBy("fills").rangeBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    below = F.sum("cap").over(up_to)
    above = F.sum("w").over(everything) - F.sum("w").over(up_to)
    weighted = weighted.withColumn("total", total).withColumn("full", below + F.col("fills") * above <= total)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - spent) / open_weight * F.col("w"))
    return weighted.select("source", "source_size", target.alias("target"))


_ROW = "struct<size:bigint,id:bigint,rows:bigint,p:double>"
_STATE = f"struct<open:{_ROW},done:array<struct<size:bigint,id:bigint,rows:bigint,take:int>>>"


def _meet(level: int) -> str:
    """SQL that folds the sorted rows of a block: one open fraction meets each next row."""
    draw = f"(shiftrightunsigned(xxhash64({SEED}, {level}, s.open.id, s.open.size, x.id, x.size), 11) / 9007199254740992D)"
    row = lambda side, p: f"named_struct('size',{side}.size,'id',{side}.id,'rows',{side}.rows,'p',{p})"
    done = lambda side, take: (
        f"array_append(s.done, named_struct('size',{side}.size,'id',{side}.id,'rows',{side}.rows,'take',{take}))"
    )
    state = lambda o, d: f"named_struct('open',{o},'done',{d})"
    both = "(s.open.p + x.p)"
    return f"""aggregate(members, cast(named_struct('open', null, 'done', array()) AS {_STATE}), (s, x) ->
      CASE WHEN s.open IS NULL THEN {state(row('x', 'x.p'), 's.done')}
           WHEN {both} < 1 - 1e-9 THEN
             CASE WHEN {draw} * {both} < s.open.p THEN {state(row('s.open', both), done('x', 0))}
                  ELSE {state(row('x', both), done('s.open', 0))} END
           WHEN {both} <= 1 + 1e-9 THEN
             CASE WHEN {draw} < s.open.p
                  THEN {state(f'cast(null AS {_ROW})', f"array_append({done('s.open', 1)}, named_struct('size',x.size,'id',x.id,'rows',x.rows,'take',0))")}
                  ELSE {state(f'cast(null AS {_ROW})', f"array_append({done('s.open', 0)}, named_struct('size',x.size,'id',x.id,'rows',x.rows,'take',1))")} END
           ELSE
             CASE WHEN {draw} * (2 - {both}) < 1 - x.p THEN {state(row('x', f'{both} - 1'), done('s.open', 1))}
                  ELSE {state(row('s.open', f'{both} - 1'), done('x', 1))} END
      END)"""


def _level(rows: DataFrame, level: int, by: list[str], block: int) -> tuple[DataFrame, int]:
    """Fold ``source, size, id, rows, p`` within blocks; also the largest number of blocks of a source."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    counts = materialize(counts, "blocks")
    most = counts.groupBy("source").agg(F.sum("blocks").alias("n")).agg(F.max("n")).first()[0] or 0
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    dealt = rows.alias("r").join(counts.alias("c"), on).select("r.*", "c.blocks")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "id", "size"), F.col("blocks")))
    member = F.struct("size", "id", "rows", "p")
    blocks = dealt.groupBy(*by, "block").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return blocks.select("source", F.expr(_meet(level)).alias("s")), most


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    block: int = BLOCK,
) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken`` for every row.

    ``size`` is the number of words, ``copies`` how often the mix holds the row, ``taken`` the words
    that gives. Null and empty texts have size 0; a null source is a source of its own, the last.
    Rows with the same id, source and size share one draw. A source without words has target 0.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    units = materialize(thin.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio))

    joined = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
    open_rows = joined.where("t.p > 0").select("u.*", "t.p")
    open_rows = open_rows.withColumn("octave", F.floor(F.log2(F.col("size") + 1.0) * 4))
    by, level, done = ["source", "octave"], 0, []
    while True:
        folded, blocks = _level(open_rows, level, by, block)
        folded = materialize(folded, f"level{level}")
        done.append(folded.select("source", F.inline("s.done")).select("source", "size", "id", "rows", "take"))
        left = folded.where("s.open IS NOT NULL").select("source", "s.open.*")
        if blocks <= 1:
            break
        open_rows, by, level = left, ["source"], level + 1
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(-1), "id", "size"), 11) / F.lit(9007199254740992.0)
    done.append(left.select("source", "size", "id", "rows", (draw < F.col("p")).cast("int").alias("take")))
    even = joined.where("t.p = 0").select("u.source", "u.size", "u.id", "u.rows", F.lit(0).alias("take"))
    for part in done:
        even = even.unionByName(part)
    out = even.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    copies = (F.col("t.whole") + F.col("d.take")).cast("long")
    out = out.select("d.id", "d.source", "d.size", "d.rows", "t.source_size", "t.target", copies.alias("copies"))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_row"))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: each document as often as it has copies, numbered from 1 in ``copy``."""
    names = [fresh(docs, f"_{name}") for name in ("id", "source", "size", "copies", "words")]
    copy = fresh(docs, "copy")
    drawn = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    drawn = drawn.groupBy(id_col, source_col, "size").agg(F.max("copies")).toDF(*names[:4])
    key, source, size, copies, words = (F.col(name) for name in names)
    sized = docs.withColumn(names[4], n_words(F.col(text_col)))
    on = F.col(id_col).cast("long").eqNullSafe(key) & F.col(source_col).cast("string").eqNullSafe(source) & (words == size)
    copied = sized.join(drawn, on).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns], copy)
