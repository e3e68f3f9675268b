"""How text filters interact: what each removes, alone and behind others, in every order of application.

Word counts come from a sparse document-term matrix. Every Arrow batch is cut into shards of about
``SHARD_BYTES`` of text; a shard is encoded, slice by slice, against its own dictionary first, so that
only distinct words travel. The words of all shards are then numbered once for the whole corpus (by their rank
in one of ``BUCKETS`` hash buckets), and the shards take over these numbers: compressed sparse rows, kept
as the bytes of three integer arrays. Row sums are word counts, stored entries are distinct words.

Failures are combined to one row per part and set of failed filters before orders are expanded, so
the orders cost nothing that grows with the corpus. Copies are found on digests: rows are counted per
digest and part first, so a text with any number of copies is a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattcell.session import materialize, shared_path

SHARD_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
BUCKETS = 4096
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 2
SPECIAL = b"#$%&*|"

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_SPECIAL = np.isin(np.arange(256), list(SPECIAL))


@dataclass(frozen=True)
class TermMatrix:
    """``shards``: one row per shard, with lists of what is known of each document and its sparse rows.

    ``indptr``, ``terms`` and ``counts`` are little-endian 64-bit integers: the entries of document i stand at indptr[i] to
    indptr[i + 1]. ``dictionary``: ``term_id, word``.
    """

    shards: DataFrame
    dictionary: DataFrame

    def rows(self) -> DataFrame:
        """One row per document: its columns, ``n_words`` (row sum) and ``n_distinct`` (stored entries)."""
        kept = [f for f in self.shards.schema.fields if isinstance(f.dataType, T.ArrayType)]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    indptr, counts = (np.frombuffer(row.column(c)[0].as_py(), "<i8") for c in ("indptr", "counts"))
                    upto = np.append(0, np.cumsum(counts))
                    columns = [row.column(f.name).flatten() for f in kept]
                    columns += [pa.array(np.diff(upto[indptr])), pa.array(np.diff(indptr))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "n_words", "n_distinct"])

        schema = [f"{f.name} {f.dataType.elementType.simpleString()}" for f in kept]
        slim = self.shards.select(*[f.name for f in kept], "indptr", "counts")
        return slim.mapInArrow(measure, ", ".join([*schema, "n_words long, n_distinct long"]))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings without nulls, and the offset of each row."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of the rows, in order, and the row of each; words never cross rows."""
    inside = ~_BLANK[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[filled] = inside[filled]
    ends = np.append(filled[1:], len(data)) - 1 if len(filled) else filled
    last[ends] = inside[ends]
    at = np.flatnonzero(first)
    bounds = np.zeros(len(at) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - at, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return words, np.searchsorted(offsets, at, side="right") - 1


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=upto[1:])
    return np.diff(upto[offsets])


def _list(values, kind: pa.DataType) -> pa.Array:
    flat = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind))


def _blob(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _packed(values: np.ndarray) -> pa.Array:
    """Steps between 32-bit integers, all lowest bytes first and all highest last, so that a codec finds runs of zeros."""
    steps = np.diff(values.astype("<i4"), prepend=np.int32(0))
    return pa.array([steps.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()
    return np.cumsum(steps, dtype=np.int32)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """As :func:`materialize`, packed harder: both tables of the matrix are as wide as the corpus.

    A row is a shard of some ten MB. By default a writer holds a hundred rows before it looks at their size, and a
    reader takes a whole row group at once; here every row is looked at and a group ends behind ``SHARD_BYTES``.
    """
    path = shared_path(df.sparkSession, name)
    sizes = {"parquet.block.size": SHARD_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    df.write.options(compression="zstd", **sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with up to ``most`` bytes of text, at least one row each."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _local_shards(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per shard; ``codes`` point into the shard's own ``words``; codes and counts are packed."""
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(
        F.col(id_col).alias("ids"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("parts"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for docs_of_shard in _pieces(batch, SHARD_BYTES):
                coded, rows, chars, upper, special, digests, begin = [], [], [], [], [], [], 0
                for part in _pieces(docs_of_shard, SLICE_BYTES):
                    data, offsets = _bytes(part.column("text"))
                    words, row = split_words(data, offsets)
                    coded.append(words.dictionary_encode())
                    rows.append(row + begin)
                    chars.append(_count((data & 0xC0) != 0x80, offsets))
                    upper.append(_count(_UPPER[data], offsets))
                    special.append(_count(_SPECIAL[data], offsets) > 0)
                    digests += [blake2b(data[i:j], digest_size=16).digest() for i, j in zip(offsets, offsets[1:])]
                    begin += part.num_rows
                chunks = pa.chunked_array(coded).unify_dictionaries().chunks
                words = chunks[0].dictionary
                width = max(len(words), 1)
                cells = _merged(rows) * width
                cells += _merged([c.indices.to_numpy() for c in chunks])
                del coded, rows, chunks
                cells.sort()
                at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
                counts = np.diff(np.append(at, len(cells)))
                cells = cells[at]
                columns = {
                    "shard": pa.array([shard], pa.int64()),
                    "ids": _list(docs_of_shard.column("ids"), docs_of_shard.column("ids").type),
                    "parts": _list(docs_of_shard.column("parts"), pa.string()),
                    "chars": _list(_merged(chars), pa.int64()),
                    "upper": _list(_merged(upper), pa.int64()),
                    "special": _list(_merged(special), pa.bool_()),
                    "digests": _list(digests, pa.binary()),
                    "indptr": _blob(np.searchsorted(cells, np.arange(begin + 1) * width), "<i8"),
                    "codes": _packed(cells % width),
                    "counts": _packed(counts),
                    "words": _list(words, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                shard += 1
                del columns, words, cells, at, counts
                pa.default_memory_pool().release_unused()  # the worker outlives the task

    return thin.mapInArrow(
        encode,
        f"shard long, ids array<{id_type}>, parts array<string>, chars array<long>, upper array<long>, special array<boolean>, "
        "digests array<binary>, indptr binary, codes binary, counts binary, words array<binary>",
    )


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> TermMatrix:
    """The document-term matrix of whole texts; words are runs of bytes other than space and x09 to x0D.

    Null texts and parts count as empty. Every row of ``docs`` is a row of the matrix, rows with a null or
    repeated id too. Numbers of terms depend on the words alone. Other columns play no part.
    """
    local = _stored(_local_shards(docs, id_col, text_col, part_col), "shards")
    seen = local.select("shard", F.posexplode("words").alias("code", "word"))
    seen = seen.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    nth = F.dense_rank().over(W.partitionBy("bucket").orderBy("word")) - 1
    named = seen.select("shard", "code", "word", (nth * F.lit(BUCKETS).cast("long") + F.col("bucket")).alias("term_id"))
    # Both lists take every row in turn, so their entries belong together; neither column is ever NULL.
    lookup = named.groupBy("shard").agg(F.collect_list("code").alias("places"), F.collect_list("term_id").alias("numbers"))
    shards = _translated(local.drop("words").join(lookup, "shard", "left"))
    return TermMatrix(_stored(shards, "matrix"), named.select("term_id", "word").distinct())


def _translated(shards: DataFrame) -> DataFrame:
    """``terms`` instead of ``codes``: the term of code ``places[i]`` is ``numbers[i]``."""

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                codes, counts = (_unpacked(row.column(c)[0].as_py()) for c in ("codes", "counts"))
                places, terms = row.column("places").flatten().to_numpy(), row.column("numbers").flatten().to_numpy()
                lookup = np.empty(len(places), np.int64)
                lookup[places] = terms
                row = row.drop_columns(["codes", "counts", "places", "numbers"])
                yield row.append_column("terms", _blob(lookup[codes], "<i8")).append_column("counts", _blob(counts, "<i8"))

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in shards.schema.fields if f.name not in ("codes", "counts", "places", "numbers")]
    return shards.mapInArrow(translate, ", ".join([*kept, "terms binary, counts binary"]))


def failures(matrix: TermMatrix) -> DataFrame:
    """One row per document: ``id, part, digest`` and ``fails``, the letters of the failed filters A to D."""
    rows = matrix.rows()
    tests = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": F.lit(100) * F.col("n_distinct") < F.lit(LEAST_DISTINCT_PERCENT) * F.col("n_words"),
        "C": F.lit(100) * F.col("upper") > F.lit(MOST_UPPER_PERCENT) * F.col("chars"),
        "D": F.col("special"),
    }
    fails = F.concat(*[F.when(test, letter).otherwise("") for letter, test in tests.items()])
    return rows.select(F.col("ids").alias("id"), F.col("parts").alias("part"), F.col("digests").alias("digest"), fails.alias("fails"))


def failure_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, fails, n, good, toxic`` of documents ``id, part, digest, fails``; E is added for later copies.

    A document is a later copy if some smaller id has the same digest. A null id is never smaller or later and
    has no label; rows that repeat an id count one by one. Several labels of one id: any 1 counts.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = materialize(rows, "failures")
    label = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    known = rows.where("id IS NOT NULL").join(marks, "id", "left").groupBy("id", "digest", "part", "fails", *label).count()
    keys = ["digest", "part", "fails", "good", "toxic"]
    per_text = known.groupBy(*keys).agg(F.sum("count").alias("n"), F.min(F.struct("id", "count")).alias("least"))
    lowest = F.min("least.id").over(W.partitionBy("digest"))
    per_text = per_text.withColumn("first", F.when(F.col("least.id") == lowest, F.col("least.count")).otherwise(0))
    both = F.array(
        F.struct(F.col("fails"), F.col("first").alias("n")),
        F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("first")).alias("n")),
    )
    named = per_text.select("part", "good", "toxic", F.inline(both))
    unnamed = rows.where("id IS NULL").groupBy("part", "fails").agg(F.count("*").alias("n"))
    unnamed = unnamed.select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "fails", "n")
    return named.unionByName(unnamed).groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For every part, order of ``filters`` and step: what the step removes and what others had removed.

    ``counts`` holds ``part, fails, n, good, toxic``. At most 2^filters rows meet in a part. ``shapley`` is what the
    step's filter removes summed over all orders: among the failed filters of a document each is the first equally often.
    """
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    orders = ["".join(p) for p in permutations(filters)]
    shares = F.lit([len(orders) // k for k in range(1, len(filters) + 1)])
    steps = sets.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.lit(list(range(1, len(filters) + 1)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumns({"letter": letter, "before": F.substring("filter_order", F.lit(1), F.col("step") - 1)})

    def total(value, test) -> Column:
        return F.aggregate(F.filter("sets", test), F.lit(0).cast("long"), lambda a, s: a + value(s))

    def free(s: Column, of: Column) -> Column:
        return F.call_function("translate", s["fails"], of, F.lit("")) == s["fails"]

    def has(s: Column) -> Column:
        return F.contains(s["fails"], F.col("letter"))

    def removed(s: Column) -> Column:
        return has(s) & free(s, F.col("before"))

    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total(lambda s: s["n"], lambda s: free(s, F.concat("before", "letter"))).alias("kept"),
        total(lambda s: s["n"], removed).alias("removed"),
        total(lambda s: s["n"], lambda s: has(s) & ~free(s, F.col("before"))).alias("redundant"),
        total(lambda s: s["n"], lambda s: s["fails"] == F.col("letter")).alias("unique_fails"),
        total(lambda s: s["good"], removed).alias("good_lost"),
        total(lambda s: s["toxic"], removed).alias("toxic_lost"),
        total(lambda s: s["n"] * F.get(shares, F.length(s["fails"]) - 1), has).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """The five filters on every document, in all 120 orders, per part.

    A: fewer than 200 words. B: fewer distinct words than half the words. C: more than 2 % capitals A to Z. D: one of
    ``#$%&*|``. E: the text of a smaller id. Null texts are empty and fail A (and E behind another empty text); a null part is
    the empty string. No documents give no rows.
    """
    return interactions(failure_counts(failures(term_matrix(docs, id_col, text_col, part_col)), labels, id_col))
