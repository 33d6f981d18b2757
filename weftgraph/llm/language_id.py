"""Language identification by compression: the language whose raw-content dictionary compresses a text best."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import python_stage, only

#: Bytes of the labelled sample per language, which become its dictionary, and bytes taken of one text.
DICTIONARY_BYTES, DOCUMENT_BYTES = 24_000, 400
#: Texts are compressed in pieces, so that the dictionary and not a text's own past decides.
PIECE_BYTES, LEVEL = 2_048, 6
#: Below this relative margin a prediction is marked as rejected.
MIN_MARGIN = 0.01
UNDEFINED = "und"
#: Compared are lower-case letters only: runs of anything else become a space, a word repeated on the spot stands once.
OTHER, AGAIN = re.compile(r"[\W\d_]+"), re.compile(r"\b(\w+)(?: \1\b)+")
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def fold(id: Column, n: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % n


def plain(text: str) -> bytes:
    return AGAIN.sub(r"\1", OTHER.sub(" ", text.lower())).encode("utf-8", "surrogatepass")


def learn(labelled: DataFrame, per_language: int = DICTIONARY_BYTES, per_document: int = DOCUMENT_BYTES) -> dict[str, bytes]:
    """Dictionary per language from (text, lang) rows: documents in hash order, without likely mislabelled ones.

    What is collected is bounded by the number of languages: a hash threshold, set from each language's count of
    distinct texts and the bytes of letters in them, leaves a few times as many documents as a dictionary needs. Where
    they still are too few, the threshold grows. Only these learning samples are cut, never a text to predict.
    """
    piece, order = F.substring("text", 1, per_document), F.shiftrightunsigned(F.xxhash64("text"), 1)
    usable = labelled.withColumn("piece", piece).filter(F.col("lang").isNotNull() & F.col("piece").rlike(r"\p{L}")).withColumn("order", order)
    letters = F.octet_length(F.regexp_replace("piece", r"[^\p{L}]+", " "))
    once = usable.groupBy("lang", "order").agg(F.max(letters).alias("size"))  # copies count once
    counts = once.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).collect()
    share = {r["lang"]: min(1.0, (12 * per_language / max(r["mean"], 1) + 100) / r["n"]) for r in counts}
    done = dict.fromkeys(share, 0.0)
    texts: dict[str, list[bytes]] = {}
    while share:
        low, high = (F.element_at(F.create_map(*(F.lit(x) for kv in at.items() for x in kv)), F.col("lang")) * float(1 << 63) for at in (done, share))
        rows = (
            usable.filter((F.col("order") >= low) & ((F.col("order") < high) | (high >= float(1 << 63))))
            .groupBy("lang", "order").agg(F.min("piece").alias("text"))
            .orderBy("lang", "order").collect()
        )
        for r in rows:
            have = texts.setdefault(r["lang"], [])
            if sum(map(len, have)) < 3 * per_language and (body := plain(r["text"])).strip():
                have.append(body)
        done = {k: v for k, v in share.items() if v < 1 and sum(map(len, texts.get(k, ()))) < 3 * per_language}
        share = {k: min(1.0, 8 * v) for k, v in done.items()}
    texts = {k: v for k, v in texts.items() if v}
    halves = [Classifier({k: b" ".join(v[h::2])[-per_language:] for k, v in texts.items()}) for h in (0, 1)]
    out = {}
    for k, v in sorted(texts.items()):  # a wrong label shows when the other half's dictionaries disagree with it
        agreed = [x for i, x in enumerate(v) if halves[1 - i % 2].predict(x.decode("utf-8", "ignore"))[0] == k]
        out[k] = b" ".join(agreed or v)[-per_language:]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.languages = sorted(dictionaries)
        self.compressors = []
        for name in self.languages:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (share saved against the second best; 1 with one language only), rejected."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDEFINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        body = plain(text)
        parts = [body[i : i + PIECE_BYTES] for i in range(0, len(body), PIECE_BYTES)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), name) for c, name in zip(self.compressors, self.languages, strict=True))
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], min(1.0, max(0.0, margin)), margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected; ties go to the first language by name.

    A null, empty or letterless text is ``und`` and rejected. A text of any length is compressed whole, piece
    by piece. Each row gives one row; an empty table an empty
    result. Other columns are not read.
    """
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            out = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return only(docs, id, text).mapInArrow(run, SCHEMA)


def language_table(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn on the documents outside fold 0, predict all."""
    model = learn(only(docs, "doc_id", "text", "lang").filter(fold(F.col("doc_id"), folds) != 0))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score", "rejected")
