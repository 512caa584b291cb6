"""Language identification by compression with per-language zstandard dictionaries.

Each language gets a raw-content dictionary: a bounded sample of its labelled texts.
A text is cut into pieces of `PIECE` bytes, every piece is compressed with every
dictionary, and the language with the smallest total wins. Sizes become a score by
weighting each language with 2**-(size - smallest) and normalising; a score below
`MIN_SCORE` (the best two within about a byte) marks the text as rejected.

Edge cases: null texts and texts without a letter get `und`, score 0, rejected; with
no labelled language all texts do; ties go to the first language in sorted order; repeated rows
get the same answer and count once in a dictionary; very long texts are compressed whole; rows with
a null doc_id are not held out and not learned from. Input columns pass through, but for columns named like an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.session import materialize

#: Bounds of the training sample: documents of a language, and bytes of a dictionary.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 2000
DICT_BYTES = 64 << 10
PIECE = 2 << 10
#: Labels up to which their counts are broadcast.
BROADCAST_LANGS = 100_000
LEVEL = 6
MIN_SCORE = 0.6

_OTHER = re.compile(r"[\W\d_]+")


def learn(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each non-null language of `train`.

    About `SAMPLE_DOCS` different texts of each language are chosen by a hash of the text. A stretch
    of at most `SAMPLE_CHARS` characters, from a place in the text that the hash gives, reaches the driver,
    and each text of a language has an equal share of its dictionary.
    """
    train = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = train.groupBy("lang").agg((F.lit(SAMPLE_DOCS) / F.greatest(F.approx_count_distinct(F.xxhash64("text")), F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    start = F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    share = materialize(share, "languages")
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGS else share  # so that texts are not shuffled
    rows = train.join(share, "lang").where(place < F.col("share")).select("lang", F.substr("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    texts: dict[str, list[bytes]] = {}
    for r in rows.orderBy(F.xxhash64("text"), "text").collect():
        texts.setdefault(r["lang"], []).append(letters(r["text"]).encode())
    return {lang: _dictionary(t) for lang, t in sorted(texts.items())}


def _dictionary(texts: list[bytes]) -> bytes:
    """Equal shares of the texts; what short ones leave goes to the others."""
    left, out = DICT_BYTES, []
    for i, t in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        out.append(t[: max(left // (len(texts) - i) - 1, 0)])
        left -= len(out[-1]) + 1
    return b"\n".join(out)


def _compressors(dictionaries: dict[str, bytes]) -> list:
    import zstandard

    out = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content if len(content) >= 8 else content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
    return out


def letters(text: str) -> str:
    """Lower-cased text whose runs of other characters than letters are single blanks."""
    return _OTHER.sub(" ", text.lower())


def sizes(text: str, compressors: list) -> np.ndarray:
    data = letters(text).encode()
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return np.array([sum(len(c(p)) for p in pieces) for c in compressors])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text") -> DataFrame:
    """Add lang_pred (string), score (double) and rejected (boolean)."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    docs = docs.drop(*[f.name for f in added if f.name != text_col])
    schema = T.StructType([*docs.schema, *added])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each label; many thousands of labels would need groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        names, compressors = list(shared.value), _compressors(shared.value)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(text_col):
                text = text.as_py()
                if not names or text is None or not letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                n = sizes(text, compressors)
                best = int(n.argmin())
                langs.append(names[best])
                scores.append(float(1 / np.exp2(-np.minimum(n - n[best], 1000.0)).sum()))
            rejected = [lang == "und" or s < MIN_SCORE for lang, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, *(f.name for f in added)],
            )

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    dictionaries = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), dictionaries).drop("text")
