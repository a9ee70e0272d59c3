"""Language by compression: the language whose raw-content dictionary makes a text's zstandard frame smallest.

Texts are lower-cased. A dictionary is the whole texts of a bounded number of labelled documents (PER_LANGUAGE of at most LONGEST
characters, by the hash of their doc_id), in the order of their ids; one that would exceed DICTIONARY bytes is left out. A text is rejected when the runner-up's frame is not
larger than the best by MARGIN of its own size and by MARGIN_BYTES. A dictionary saves a bounded number of bytes only, so a
text of over PIECE bytes is compressed in pieces of so many that together cover it, each with the dictionary anew; a
frame's size is then the sum over the pieces, and the margin doesn't depend on the text's length.

* null, empty or blank text: rejected, no language. Null doc_id: classified like any other.
* ties go to the language first in the alphabet, and are rejected, as the margin is 0.
* repeated rows give repeated rows. An empty table, or one without labelled documents: nothing can be classified, all is rejected.
* other columns are not read by classify(); accepted() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PER_LANGUAGE, LONGEST, DICTIONARY = 100, 8192, 112_000
LEVEL, MARGIN, MARGIN_BYTES = 6, 0.015, 1
PIECE = 1 << 15


def dictionaries(docs: DataFrame, *, per_language: int = PER_LANGUAGE, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """Raw dictionary content of every labelled language; the sample's size depends on the number of languages, not on the table's."""
    usable = docs.filter("lang is not null and text is not null and lang <> ''").select("doc_id", "lang", F.length("text").alias("n")).filter(F.col("n").between(1, LONGEST))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "n")
    sample = usable.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    ids = [(r.doc_id, r.lang) for r in sample.collect()]  # per_language at most of each language, and none without
    if not ids:
        return {}
    rows = docs.filter(F.col("doc_id").isin(sorted({i for i, _ in ids if i is not None})) & (F.length("text") <= LONGEST)).select("doc_id", "lang", "text").collect()
    wanted, content = set(ids), {}
    for r in sorted(rows, key=lambda r: (str(r.lang), r.doc_id, r.text or "")):
        if (r.doc_id, r.lang) in wanted and r.text:
            raw = r.text.lower().encode("utf-8", "replace") + b"\n"
            if not content.get(r.lang) or len(content[r.lang]) + len(raw) <= dictionary:
                content[r.lang] = content.get(r.lang, b"") + raw
    return {lang: content[lang] for lang in sorted(content)}


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL) -> None:
        self.names, self.compressors = list(content), []
        for raw in content.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[k : k + PIECE] for k in range(0, max(len(raw), 1), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]


def _classify(content: dict[str, bytes], margin: float, margin_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(content)
        for batch in batches:
            lang, best, second, ok = [], [], [], []
            for text in batch.column("text").to_pylist():
                if not c.names or not text or text.isspace():
                    lang.append(None), best.append(None), second.append(None), ok.append(False)
                    continue
                sizes = c.sizes(text)
                k = min(range(len(sizes)), key=sizes.__getitem__)
                other = min((s for i, s in enumerate(sizes) if i != k), default=None)
                lang.append(c.names[k]), best.append(sizes[k]), second.append(other)
                ok.append(other is None or other - sizes[k] >= max(margin_bytes, margin * other))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(best, pa.int64()), pa.array(second, pa.int64()), pa.array(ok, pa.bool_())], names=["doc_id", "language", "best_bytes", "second_bytes", "accepted"]
            )

    return run


def classify(docs: DataFrame, content: dict[str, bytes], *, margin: float = MARGIN, margin_bytes: int = MARGIN_BYTES) -> DataFrame:
    """(doc_id, language, best_bytes, second_bytes, accepted), one row per document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _classify(content, margin, margin_bytes), "doc_id long, language string, best_bytes long, second_bytes long, accepted boolean"
    )


def accepted(docs: DataFrame, content: dict[str, bytes], *, margin: float = MARGIN, margin_bytes: int = MARGIN_BYTES) -> DataFrame:
    """The documents that are not rejected, with all their columns; lang becomes the language found."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _classify(content, margin, margin_bytes)
        for batch in batches:
            (found,) = decide(iter([batch.select(["doc_id", "text"])]))
            at = batch.schema.get_field_index("lang")
            yield batch.set_column(at, batch.schema.field(at), found.column("language").cast(batch.schema.field(at).type)).filter(found.column("accepted"))

    return docs.mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, dictionaries(docs))
