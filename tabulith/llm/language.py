"""Language identification by compression.

Every language gets a zstandard raw-content dictionary cut from a bounded sample of labelled texts. A
text is encoded with each dictionary and belongs to the language that encodes it in the fewest bytes.
Texts are compared by their letters only (lower-cased, other runs become one space) and are encoded whole,
block by block, so a long text does not outgrow the dictionary. A narrow margin rejects the text.

Null text, or text without a letter, is ``und`` with score 0 and rejected. Without any labelled text every
row is ``und``. Ties go to the language with more labelled rows, then to the smaller name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

#: labelled texts sampled per language, characters taken from each, bytes of a dictionary
SAMPLE_TEXTS = 400
PIECE_CHARS = 500
DICTIONARY_BYTES = 32 << 10
BLOCK_BYTES = 4096
#: a text is rejected if the runner-up needs less than so many bytes, or such a part, more
MIN_MARGIN_BYTES = 1
MIN_MARGIN_PART = 0.002

#: ends every text, so that a short one is written compressed and the bytes that a dictionary saves show
_TAIL = bytes(64)

_PREDICTION = "lang_pred string, score double, margin_bytes long, accepted boolean"


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), the language with most rows first. Reads all labels, and the texts of about
    ``SAMPLE_TEXTS`` rows a language, chosen by a hash of the key."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    part = F.lit(0.0)
    for name, n in counts.items():
        part = F.when(F.col("lang") == name, F.lit(min(1.0, SAMPLE_TEXTS / n))).otherwise(part)
    draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a piece from anywhere in the text, so that shared openings don't fill the dictionary
    start = F.lit(1) + F.pmod(F.xxhash64("key", F.lit("start")), F.greatest(F.lit(1), F.length("text") - PIECE_CHARS + 1))
    pieces = rows.where(draw < part).select(
        "lang", draw.alias("draw"), letters(F.substring("text", start.cast("int"), F.lit(PIECE_CHARS))).alias("piece"))
    samples: dict[str, list[tuple[float, str]]] = {}
    for r in pieces.where(F.length("piece") > 0).collect():
        samples.setdefault(r["lang"], []).append((r["draw"], r["piece"]))
    return [(name, " ".join(p for _, p in sorted(samples[name]))[:dictionary_bytes].encode()[-dictionary_bytes:])
            for name in sorted(samples, key=lambda x: (-counts[x], x))]


def _encoders(dictionaries: list[tuple[str, bytes]]):
    import zstandard as zs

    made = []
    for _, content in dictionaries:
        # short matches tell languages apart: four bytes at least, found through hash chains
        params = zs.ZstdCompressionParameters(
            strategy=zs.STRATEGY_LAZY, min_match=4, search_log=2, hash_log=15, chain_log=15, window_log=17,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        known = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        made.append(zs.ZstdCompressor(dict_data=known, compression_params=params).compress)
    return made


def predictor(spark: SparkSession, dictionaries: list[tuple[str, bytes]], min_bytes: int = MIN_MARGIN_BYTES,
              min_part: float = MIN_MARGIN_PART):
    """A column function: letters of a text -> struct of ``lang_pred, score, margin_bytes, accepted``."""
    names = [n for n, _ in dictionaries]
    models = spark.sparkContext.broadcast(dictionaries)
    cache: list = []

    @F.arrow_udf(_PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.extend(_encoders(models.value))
        n = len(texts)
        sizes = np.zeros((n, max(2, len(names))))
        known = np.zeros(n, bool)
        for i, x in enumerate(texts):
            raw = x.as_py()
            if raw and cache:
                raw = raw.encode() + _TAIL
                known[i] = True
                parts = [raw[j:j + BLOCK_BYTES] for j in range(0, len(raw), BLOCK_BYTES)]
                for k, compress in enumerate(cache):
                    sizes[i, k] = sum([len(compress(p)) for p in parts])
        if len(cache) < 2:  # with one language nothing competes
            sizes[:, 1:] = np.inf
        best = sizes.argmin(axis=1)
        low = sizes.min(axis=1)
        score = np.where(known, 1 / np.exp2(np.maximum(low[:, None] - sizes, -60)).sum(axis=1), 0.0)
        second = np.partition(sizes, 1, axis=1)[:, 1]
        margin = np.where(known & np.isfinite(second), second - low, 0).astype(np.int64)
        accepted = known & (~np.isfinite(second) | (margin >= np.maximum(min_bytes, min_part * low)))
        label = [names[b] if k else "und" for b, k in zip(best, known)]
        return pa.StructArray.from_arrays(
            [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()),
             pa.array(accepted, pa.bool_())], names=["lang_pred", "score", "margin_bytes", "accepted"])

    return predict


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, margin_bytes, accepted``; columns of these names are replaced."""
    found = predictor(docs.sparkSession, dictionaries)(letters(F.col(text)))
    fields = ("lang_pred", "score", "margin_bytes", "accepted")
    kept = [c for c in docs.columns if c.lower() not in fields]
    return docs.select(*kept, found.alias("__found")).select(*kept, *(F.col(f"__found.{f}").alias(f) for f in fields))


def held_out(key: Column) -> Column:
    """One row in five, by CRC-32 of the key's text; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Dictionaries from the rows that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))))


@query("op8_compression_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin_bytes",
                        "accepted")
