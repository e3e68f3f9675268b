"""Fingerprints of texts that add up: a homomorphic hash of the multiset of paragraphs.

A paragraph is a line that is not blank, as it stands. It hashes to a wide vector in two parts:

* ``EXACT`` lanes modulo 2^64, pseudo-random functions of the whole paragraph, for equality;
* ``ROUGH`` lanes modulo 2^32, in which every run of ``GRAM`` words of the paragraph adds +1 or -1 to
  every lane at random, for likeness: the cosine of two such vectors estimates the cosine of the two
  multisets of runs, with a standard deviation of at most 1/sqrt(ROUGH).

A text's fingerprint is the sum over its paragraphs, each lane under its own modulus. So it does not depend on
the order of paragraphs, repeated paragraphs count, and paragraphs can be added and taken out without reading the rest:
``fingerprint(text) - fingerprint(old) + fingerprint(new)``. The edits below are made that way. The widths
suit chance collisions; against an adversary who picks paragraphs take a thousand lanes or more.

Neighbours in id order meet without a window over all rows. A pass over ids and text digests cuts the
order into ranges; each range is sorted by itself, and the first document of a range goes to the range
before it as well, so that texts are shuffled once and no range waits for another.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wattcell.llm.text import mix
from wattcell.session import materialize

EXACT = 16
ROUGH = 256
GRAM = 3
CHUNK = 4096
RANGE_BYTES = 16 << 20
MOST_RANGES = 8192
_EMPTY_RUN = np.uint64(0x243F6A8885A308D3)
_SALTS = np.arange(1, EXACT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_PLANES = np.arange(1, ROUGH // 64 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class Fingerprint:
    """A sum of paragraph vectors; ``+`` and ``-`` insert and delete multisets of paragraphs."""

    __slots__ = ("exact", "rough")

    def __init__(self, exact: np.ndarray | None = None, rough: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.rough = np.zeros(ROUGH, np.uint32) if rough is None else rough

    @classmethod
    def of(cls, paragraphs: Iterable[str]) -> Fingerprint:
        raw = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
        split = [p.split() for p in raw]
        raw = [p for p, tokens in zip(raw, split) if tokens]
        out = cls()
        if not raw:
            return out
        for i in range(0, len(raw), CHUNK):
            part = raw[i : i + CHUNK]
            low = np.fromiter(map(xxh3_64_intdigest, part), np.uint64, len(part))
            high = np.fromiter((xxh3_64_intdigest(p, 1) for p in part), np.uint64, len(part))
            out.exact += mix(mix(low[:, None] ^ _SALTS) ^ high[:, None]).sum(axis=0, dtype=np.uint64)
        runs = _runs([tokens for tokens in split if tokens])
        for i in range(0, len(runs), CHUNK):
            part = runs[i : i + CHUNK]
            signs = np.unpackbits(mix(part[:, None] ^ _PLANES).view(np.uint8), axis=1)
            out.rough += np.uint32(2) * signs.sum(axis=0, dtype=np.uint32) - np.uint32(len(part))
        return out

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.rough + other.rough)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.rough - other.rough)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and np.array_equal(self.exact, other.exact) and np.array_equal(self.rough, other.rough)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, else the estimated cosine, not below 0; 0 if just one has no paragraph."""
        if self == other:
            return 1.0
        a, b = self.rough.view(np.int32).astype(float), other.rough.view(np.int32).astype(float)
        norms = float(a @ a) * float(b @ b)
        return min(max(float(a @ b) / norms**0.5, 0.0), 1.0) if norms else 0.0

    def text(self) -> str:
        return b64encode(self.exact.astype("<u8").tobytes() + self.rough.astype("<u4").tobytes()).decode()

    @classmethod
    def from_text(cls, text: str) -> Fingerprint:
        raw = b64decode(text)
        return cls(np.frombuffer(raw, "<u8", EXACT).copy(), np.frombuffer(raw, "<u4", ROUGH, EXACT * 8).copy())


def _runs(paragraphs: list[list[bytes]]) -> np.ndarray:
    """A hash for every run of GRAM words of a paragraph; one for all its words if there are fewer."""
    sizes = np.array([len(p) for p in paragraphs])
    tokens = chain.from_iterable(paragraphs)
    hashes = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, int(sizes.sum()))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    found = []
    for n in range(1, GRAM + 1):
        starts = np.flatnonzero(left >= n if n == GRAM else (place == 0) & (left == n))
        out = np.full(len(starts), _EMPTY_RUN + np.uint64(n))
        for i in range(n):
            out = mix(out ^ hashes[starts + i])
        found.append(out)
    return np.concatenate(found)


def edited(text: str, following: str) -> tuple[str, str, str]:
    """The last quarter replaced by the start of the following text: the result, and the old and new end.

    The ends start where the paragraph that holds the cut starts, so all before them keeps its paragraphs.
    """
    cut = len(text) - len(text) // 4
    start = text.rfind("\n", 0, cut) + 1
    end = text[start:cut] + following[: len(text) // 4]
    return text[:start] + end, text[start:], end


def _least(cuts: Column, key: Column, steps: int) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``, by bisection."""
    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = ((low + high) / 2).cast("int")
        fits = F.get(cuts, middle) <= key
        done = low >= high
        return F.struct(
            F.when(~done & fits, middle + 1).otherwise(low).alias("low"), F.when(~done & ~fits, middle).otherwise(high).alias("high")
        )

    span = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve)["low"]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, range, ahead``: ranges of the id order, each in one partition and sorted.

    Rows with ``ahead`` = 1 end a range: they are the first document of the next range (of the first range after the last).
    Null ids come first; rows that repeat an id stand in the order of a hash of their text. Null texts become empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("id", F.xxhash64("text").alias("h")))
    keys = materialize(rows.select("key", F.octet_length("text").cast("long").alias("size")), "keys")
    ranges = min((keys.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES + 1, MOST_RANGES)
    firsts = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("first"))
    cuts = materialize(firsts.agg(F.array_sort(F.collect_list("first")).alias("cuts")), "cuts")  # at most MOST_RANGES entries
    rows = rows.withColumn("cuts", cuts.scalar())
    rows = rows.withColumn("range", _least(F.col("cuts"), F.col("key"), MOST_RANGES.bit_length() + 1) - 1)
    here = F.struct(F.col("range"), F.lit(0).alias("ahead"))
    before = F.struct(F.pmod(F.col("range") - 1, F.size("cuts")).alias("range"), F.lit(1).alias("ahead"))
    places = F.when(F.get("cuts", F.col("range")) == F.col("key"), F.array(here, before)).otherwise(F.array(here))
    rows = rows.select("id", "text", "key.h", F.inline(places))
    rows = rows.repartition(ranges, "range").sortWithinPartitions("range", "ahead", "id", "h")
    return rows.select("id", "text", "range", "ahead")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has its last quarter (code points, rounded down) replaced by the start of the next document in id
    order; after the last comes the first, and a single document follows itself. ``near_edited`` and
    ``near_next`` are likenesses to the edited text and to the next document. A null text is empty; texts without
    paragraphs have the zero fingerprint, like each other by 1 and anything else by 0. Rows with a null
    or repeated id are rows like others (see :func:`in_order`). Other columns play no part; no rows give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = last = None
        for batch in batches:
            found, owners = [], []
            texts, ranges, ahead = batch.column("text"), batch.column("range").to_pylist(), batch.column("ahead").to_pylist()
            for i, (text, at, follows) in enumerate(zip(texts, ranges, ahead)):
                if follows and (last is None or at != place):
                    continue  # a repeat of the row that the range already ended with
                text = text.as_py()
                now = batch.column("id").slice(i, 1), text, Fingerprint.of(text.split("\n"))
                if last is not None and at == place:
                    found.append(_compared(last[1], last[2], now[1], now[2]))
                    owners.append(last[0])
                place, last = at, None if follows else now
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(owners), *map(pa.array, zip(*found))], names=names)

    schema = f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(compare, schema).withColumnRenamed("id", id_col)


def _compared(text: str, mark: Fingerprint, following: str, next_mark: Fingerprint) -> tuple[int, str, str, str, float, float]:
    whole, old, new = edited(text, following)
    after = mark - Fingerprint.of(old.split("\n")) + Fingerprint.of(new.split("\n"))
    digest = sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, mark.text(), after.text(), mark.likeness(after), mark.likeness(next_mark)
