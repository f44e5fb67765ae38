"""Language identification by compression.

Each language has a raw-content dictionary of its texts for zstandard.  A text is
compressed with every dictionary; the language of the smallest result is the answer, and
the answer is marked as rejected when the next language is nearly as small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most languages, the most frequent ones first.
LANGUAGES = 500
#: Rows a language's dictionary is made from, by expectation, chosen by a hash of the key.
SAMPLE_ROWS = 200
#: Characters that a sampled row may add to a dictionary.
SAMPLE_CHARS = 2_000
#: Bytes of a dictionary.
DICTIONARY_BYTES = 64 * 1024
#: An answer is rejected when the next language is less than this share larger.
MARGIN = 0.01
_LEVEL = 6
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-cased words with one space between them; only these tell languages apart."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())



def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes by language, most frequent first, from a bounded sample of each language's rows.

    Rows with a NULL in text or language are passed over.  At most ``LANGUAGES`` times
    ``SAMPLE_ROWS`` pieces of ``SAMPLE_CHARS`` characters come to the driver.
    """
    known = docs.select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{key}`").alias("place")
    ).dropna()
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    chosen = F.lit(False)
    for row in counts:
        bound = int(min(1.0, SAMPLE_ROWS / row.n) * (1 << 30))
        chosen = F.when(F.col("lang") == row.lang, F.pmod("place", F.lit(1 << 30)) < bound).otherwise(chosen)
    # a piece from anywhere in the text, by the hash
    first = 1 + F.pmod(F.shiftright("place", 30), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS))
    pieces = known.filter(chosen).select(
        "lang", "place", F.substring("text", first.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece"))
    pieces = pieces.distinct().limit(2 * LANGUAGES * SAMPLE_ROWS).collect()
    parts: dict[str, list[bytes]] = {}
    for row in sorted(pieces, key=lambda row: (row.lang, row.place, row.piece)):
        parts.setdefault(row.lang, []).append(folded(row.piece))
    order = [row.lang for row in counts if row.lang in parts]
    return {name: b" ".join(_shared(parts[name])) for name in order}


def _shared(pieces: list[bytes]) -> list[bytes]:
    """The pieces cut so that together, with spaces, they fit a dictionary; what short ones leave goes to the others."""
    left, out = DICTIONARY_BYTES, list(pieces)
    for done, at in enumerate(sorted(range(len(pieces)), key=lambda at: len(pieces[at]))):
        share = max(0, left // (len(pieces) - done) - 1)
        out[at] = pieces[at][:share]
        left -= len(out[at]) + 1
    return out


class Identifier:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = list(dictionaries)
        self.compressors = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=_LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=_LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence between 0 and 1, and whether the answer is rejected.

        A text without a letter, or a missing one, is ``und`` with confidence 0.  Equal
        sizes go to the first language.
        """
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = folded(text)
        sizes = np.array([len(compressor.compress(raw)) for compressor in self.compressors], float)
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        margin = (others.min() - sizes[best]) / sizes[best] if len(others) else 1.0
        score = 1 / np.exp(-(sizes - sizes[best]) / 2).sum()
        return self.names[best], float(score), bool(margin < MARGIN)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` of every whole text; rows are independent."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier = Identifier(dictionaries)
        names = ("lang", "score", "rejected")
        for batch in batches:
            yield pa.array([dict(zip(names, identifier.identify(text.as_py()))) for text in batch], kind)

    return docs.withColumn("lang_pred", judged(F.col(f"`{text}`"))).withColumns({
        "score": F.col("lang_pred.score"), "rejected": F.col("lang_pred.rejected"),
        "lang_pred": F.col("lang_pred.lang"),
    })
