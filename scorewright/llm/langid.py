"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 2- and 3-grams of lower-cased letters, with runs of anything
else as one boundary, hashed into a fixed number of buckets.  The matrix of log
probabilities (languages x buckets) has a proven size and is broadcast; texts are
scored in batches, as a sparse product of n-gram counts with that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, only, only_cache, read, spread, with_keys

BUCKETS = 1 << 15
#: The classifier is fitted on about so many labelled documents of each language, chosen by hash.
TRAIN_DOCS = 2000
#: The most frequent languages, so many, are learned, ties by name: the counts and the matrix (8 bytes each) stay below 256 MB.
MAX_LANGUAGES = 1000
SMOOTHING = 0.5
UNKNOWN = "und"
#: The pipeline rejects documents whose prediction has a lower probability.
LEAST_SCORE = 0.5
_BATCH_CHARS = 1 << 18
_SALT = 77
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of lower-cased texts, sorted by text within each n; and which texts have letters."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    codes = np.where(is_letter, codes, 0)[keep]
    owner, letter = owner[keep], is_letter[keep]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    # A bigram has a letter; a trigram has one in the middle, so no n-gram joins two words or two texts.
    two = ((codes[:-1] * np.uint32(0x9E3779B1)) ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) >> shift
    some = letter[:-1] | letter[1:]
    own_two = np.where(letter[:-1], owner[:-1], owner[1:])
    three = ((a * np.uint32(0x27D4EB2F)) ^ (b * np.uint32(0x165667B1)) ^ (c * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B) >> shift
    middle = letter[1:-1]
    return np.concatenate([two[some], three[middle]]), np.concatenate([own_two[some], owner[1:-1][middle]]), has


def _batches(texts):
    """Lower-cased texts in lists of bounded length, with their positions; a long text comes in parts that break at non-letters if they can."""
    held, where, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while True:
            end = min(len(text), at + _BATCH_CHARS)
            if end < len(text):
                back = end
                while back > end - 200 and text[back - 1].isalpha():
                    back -= 1
                end = back if back > end - 200 else end
            held.append(text[at:end])
            where.append(i)
            size += end - at
            if size >= _BATCH_CHARS:
                yield held, where
                held, where, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if held:
        yield held, where


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, its probability) of each text; UNKNOWN and 0 without letters or without any model."""
        n, k = len(texts), len(self.languages)
        scores, has = np.zeros((n, max(k, 1))), np.zeros(n, bool)
        for held, where in _batches(texts):
            buckets, owner, found = _grams(held)
            where = np.array(where)
            has[where[found]] = True
            for j in range(k):
                np.add.at(scores[:, j], where, np.bincount(owner, self.log_prob[j][buckets], len(held)))
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        scores += self.log_prior
        best = scores.argmax(1)
        probability = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, probability, 0.0)


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches):
    only_cache()
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for held, where in _batches(batch.column(1).to_pylist()):
            buckets, owner, _ = _grams(held)
            names = sorted({langs[i] for i in where})
            of = np.array([names.index(langs[i]) for i in where])
            for j, name in enumerate(names):
                if name not in totals:
                    totals[name] = np.zeros(BUCKETS, np.int64)
                totals[name] += np.bincount(buckets[of[owner] == j], minlength=BUCKETS)
    for name, t in totals.items():
        hit = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(t[hit])], schema=_COUNTS)


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, max_languages: int | None = MAX_LANGUAGES) -> Model:
    """Learn from rows (doc_id, text, lang) with a language and a text.

    Of each language about ``train_docs`` documents are used, chosen by a hash of
    the id, all of them where there are fewer; whole texts always.  Of more than
    ``max_languages`` names the most frequent are learned, with None all of them.
    What reaches the driver is one row a language, and the model holds one number
    a language and bucket.
    """
    labelled = labelled.where("lang is not null and text is not null")
    ranked = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang")
    counts = {r.lang: r.n for r in (ranked if max_languages is None else ranked.limit(max_languages)).collect()}
    if not counts:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in counts.items()], "lang string, share double")
    chosen = labelled.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(_SALT)), 11) < F.col("share") * F.lit(2.0**53))
    sums = chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One packed row a language: its buckets and their counts, in one order.
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("v")).select("lang", F.col("v.bucket").alias("bucket"), F.col("v.n").alias("n")).toArrow()
    names = sorted(counts)
    matrix = np.zeros((len(names), BUCKETS))
    for k, lang in enumerate(packed.column("lang").to_pylist()):
        matrix[names.index(lang), packed.column("bucket")[k].values.to_numpy()] = packed.column("n")[k].values.to_numpy()
    prob = matrix + SMOOTHING
    weight = np.array([min(train_docs, counts[n]) for n in names], float)
    return Model(names, np.log(weight / weight.sum()), np.log(prob / prob.sum(1, keepdims=True)))


def predictor(spark, model: Model):
    """A function of a text column: struct(lang, score)."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only_cache()
        for texts in parts:
            lang, score = held.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})
            give_back()

    return predict


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1) & doc_id.isNotNull()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, max_languages: int | None = MAX_LANGUAGES) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    The model learns from labelled rows whose crc32(id) mod 3 is not 1; the rest
    are held out.  A prediction looks at the text alone, all of it.  Texts that
    are null or have no letter get ``und`` and score 0, as does everything when
    no row is labelled.  A row without id is not held out and takes no part in
    learning.  score is the probability of the predicted language among those
    learned.  An empty table gives an empty result; other columns, clashing names
    too, stay behind.  ``max_languages`` is as in ``fit``.
    """
    d = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(d.where("doc_id is not null").where(~held_out(F.col("doc_id"))), train_docs, max_languages)
    predict = predictor(docs.sparkSession, model)
    out = spread(d).select("doc_id", predict("text").alias("p"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` in a language that is told apart: neither ``und`` nor below LEAST_SCORE.

    So texts that are null, empty or without letters go, and everything does
    when no row is labelled.  Whole texts are judged, whatever their length;
    repeated rows fare alike; all columns, whatever their names, go on.  An empty
    table gives an empty result.
    """
    d = only(docs, doc_id="doc_id", text="text", lang="lang")
    predict = predictor(spark, fit(d.where("doc_id is not null").where(~held_out(F.col("doc_id")))))
    keyed = with_keys(docs, p=predict(docs["text"]))
    return keyed.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= LEAST_SCORE)).select("record.*")
