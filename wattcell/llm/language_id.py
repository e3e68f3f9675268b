"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample texts. A text is compressed with every
one; the language whose dictionary leaves the fewest bytes is predicted. Samples and texts are reduced to
lower-case letters and single spaces first. Texts are compressed in pieces, each with the fresh
dictionary, so a long text does not become its own dictionary; all pieces count.

The dictionaries are fitted on a bounded sample: of each language the ``SAMPLE`` labelled documents that
come first by a hash of their id, up to ``SAMPLE_CHARS`` characters each, ``DICTIONARY`` bytes in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
SAMPLE = 96
SAMPLE_CHARS = 1024
DICTIONARY = 64 * 1024
PIECE = 4096
LEVEL = 6
#: Texts of at most SHORT bytes are searched harder, since every byte counts there.
SHORT, SHORT_LEVEL = 1024, 12
#: Bytes between the best and the next language that count as one unit of evidence.
UNIT = 2.0
#: With fewer bytes between the best and the next language the margin is too narrow.
LEAST_MARGIN = 1
#: So many hundredths of the fewest bytes, too: labelled texts of 100 bytes or more lead by 6 or more, unlearnt languages by 4 or less in 9 of 10.
LEAST_PERCENT = 5
#: Bytes of letters: a to z and what belongs to other alphabets in UTF-8.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def reduced(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def learn(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the ``labelled`` rows, the most frequent language first.

    Rows with a null id, language or text, and texts without a letter, teach nothing. The sample
    is collected: languages times DICTIONARY bytes.
    """
    usable = labelled & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    named = docs.where(usable).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = named.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE)
    texts = docs.where(usable).select(F.col(id_col).alias("id"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("lang", "at").agg(F.min("text").alias("text")).collect()
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    samples: dict[str, list[bytes]] = {row["lang"]: [] for row in counts}
    for row in sorted(rows, key=lambda r: -r["at"]):
        samples[row["lang"]].append(reduced(row["text"]))
    return {lang: b" ".join(parts)[-DICTIONARY:] for lang, parts in samples.items()}


class Compressors:
    """The fitted dictionaries, ready to compress; made once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.long = [self._compressor(dictionaries[lang], LEVEL) for lang in self.langs]
        self.short = [self._compressor(dictionaries[lang], SHORT_LEVEL) for lang in self.langs]

    @staticmethod
    def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return zstandard.ZstdCompressor(level=level, dict_data=data, **plain)

    def judge(self, text: str | None) -> tuple[str, float, int, int]:
        """Language, score, bytes between the best and the next language, and bytes of the best."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, 0
        data = reduced(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        each = self.short if len(data) <= SHORT else self.long
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in each])
        best = int(sizes.argmin())
        more = np.sort(sizes - sizes[best])
        score = 1.0 / np.exp(-np.minimum(more / UNIT, 700)).sum()
        return self.langs[best], float(score), int(more[1]) if len(more) > 1 else 0, int(sizes[best])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, margin`` of every row.

    The score is the share of the best language where each unit of bytes divides the others' by e: 0.5
    for two languages that tie, near 1 for a clear margin. Ties go to the more frequent language. Null and
    empty texts, and those without a letter, are ``und`` with score 0, as is everything without a dictionary.
    Repeated rows and null ids are returned as they come.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages times DICTIONARY bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Compressors(shared.value).judge
        for batch in batches:
            found = [judge(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "score", "margin"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    found = thin.mapInArrow(scan, f"id {kind}, lang_pred string, score double, margin long")
    return found.withColumnRenamed("id", id_col)


def drop_unidentified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", least: int = LEAST_MARGIN, percent: int = LEAST_PERCENT) -> DataFrame:
    """The documents whose best language leads by ``least`` bytes and ``percent`` hundredths of its own or more; columns as given.

    Without letters or with a narrow margin a document goes; where only one language was learnt, those without letters go.
    Judged in place, without a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at, single = docs.columns.index(text_col), len(dictionaries) == 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Compressors(shared.value).judge
        for batch in batches:
            found = [judge(text.as_py()) for text in batch.column(at)]
            keep = [lang != UNKNOWN and (single or margin >= max(least, percent * size / 100)) for lang, _, margin, size in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
