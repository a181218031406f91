"""Language identification with word-first backoff.

A word that the model knows scores each language by the log of its relative frequency there. A word that it doesn't
know falls back to the longest character n-grams of which at least one is known, from ``MAX_N`` down to single
characters, and scores the mean over the known ones. A text's score is the sum over its words; the language with the
largest wins, the first by name on a tie.

The model is fitted on a bounded sample of labelled rows: ``max_train_chars`` characters at most, shared evenly by the
languages and chosen by a hash of the text, so no model grows with the corpus and its broadcast has a known bound.
Copies of a text count once there, and a text that no longer fits is passed over. A language with none but texts over its
share of the bound learns from the head of one of them.
Prediction reads every whole text. Language, source and id are never inputs of a prediction.

Edge cases: ``und`` with score 0 for a null text, a text without letters, and where the model knows no language;
numerals and marks are no letters; a text of which the model knows no character gets the first language by name, at 1 / languages;
repeated rows get equal predictions; nulls in the label leave a row out of training; an empty table gives no rows.
Columns of the input called lang_pred or score are replaced; others stay.
"""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc, replace_columns, table, tidied

MAX_N = 5
MAX_TRAIN_CHARS = 2_000_000
UND = "und"


_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@functools.lru_cache(maxsize=1)
def _numerals() -> frozenset[str]:
    """Numerals that are neither letters nor digits; the pattern takes them for letters."""
    return frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    text = text.lower()
    if not text.isascii() and not _numerals().isdisjoint(text):
        text = text.translate(dict.fromkeys(map(ord, _numerals()), " "))
    return _WORDS.findall(text)


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


class Model:
    """Log relative frequencies of words and n-grams: rows of a matrix over the languages, found by dictionaries."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(x for x, c in counts.items() if c)
        k = len(self.langs)
        totals: list[defaultdict] = [defaultdict(lambda: [0] * k) for _ in range(MAX_N + 1)]
        for j, lang in enumerate(self.langs):
            for word, c in counts[lang].items():
                totals[0][word][j] += c
                for n in range(1, MAX_N + 1):
                    for g in grams(word, n):
                        totals[n][g][j] += c
        self.rows: list[dict[str, int]] = []
        parts, at = [np.zeros((1, k), np.float32)], 1  # row 0: nothing is known, no language gains
        for t in totals:
            v = np.array(list(t.values()), np.float64).reshape(len(t), k)
            # a word or n-gram that a language lacks counts as a third of one occurrence
            parts.append(np.log((v + 1 / 3) / (v.sum(axis=0) + 1)).astype(np.float32))
            self.rows.append({g: at + i for i, g in enumerate(t)})
            at += len(t)
        self.matrix = np.concatenate(parts)

    def back_off(self, word: str) -> np.ndarray | None:
        """Mean over the longest n-grams of which any is known; None if not even a character is."""
        for n in range(MAX_N, 0, -1):
            t = self.rows[n]
            found = [t[g] for g in grams(word, n) if g in t]
            if found:
                return self.matrix[found].mean(axis=0)
        return None


class Predictor(dict):
    """word -> row of a task's own matrix: the model's words, then up to ``MOST`` unseen words that have been met."""

    MOST = 60_000

    def __init__(self, model: Model):
        super().__init__(model.rows[0])
        self.model, self.used = model, len(model.matrix)
        self.scores = np.concatenate((model.matrix, np.zeros((self.MOST, len(model.langs)), np.float32)))

    def __missing__(self, word: str) -> int:
        v = self.model.back_off(word)
        if v is None:
            row = 0
        else:
            row, self.used = self.used, self.used + 1
            self.scores[row] = v
        self[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UND, 0.0
        total = np.zeros(len(self.model.langs))
        step = self.MOST // 2
        for i in range(0, len(words), step):
            some = words[i : i + step]
            if self.used + len(some) > len(self.scores) or len(self) > 4 * self.MOST + len(self.model.rows[0]):
                self.clear()
                self.update(self.model.rows[0])
                self.used = len(self.model.matrix)
            rows = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            total += self.scores[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def sample_counts(docs: DataFrame, text_col: str, lang_col: str, max_train_chars: int) -> dict[str, Counter]:
    """Word counts by language over a sample of at most max_train_chars characters.

    The share of each language's rows follows from its total of characters; distinct texts are taken by their hash, then
    in the order of that hash as far as they fit the language's part of the bound. What is collected is bounded by the sample.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not total:
        return {}
    part = max_train_chars // len(total)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in total.items() for x in (k, min(1.0, 0.9 * part / max(n, 1))))), F.col("lang"))
    unit = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.withColumn("unit", unit).where((F.col("unit") < share) & (F.length("text") <= part)).dropDuplicates(["lang", "text"])
    counts: dict[str, Counter] = {k: Counter() for k in total}
    room = dict.fromkeys(total, part)

    def learn(lang: str, text: str) -> None:
        if len(text) <= room[lang]:
            room[lang] -= len(text)
            counts[lang].update(words_of(text))

    for r in taken.orderBy("lang", "unit", "text").select("lang", "text").toLocalIterator():
        learn(*r)
    missing = [k for k, c in counts.items() if not c]
    if missing:
        # a share that no short text fell into: one text for each, its head if it must be
        first = F.min_by(F.substring(F.regexp_extract("text", r"(?s)\p{L}.*", 0), 1, part), F.struct(F.length("text") > part, "unit", "text"))
        for r in rows.where(F.col("lang").isin(missing)).withColumn("unit", unit).groupBy("lang").agg(first.alias("text")).toLocalIterator():
            learn(*r)
    return counts


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train_chars: int = MAX_TRAIN_CHARS) -> Model:
    return Model(sample_counts(docs, text_col, lang_col, max_train_chars))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = StructType([*keep, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        import pyarrow as pa

        predictor = Predictor(shared.value)
        for b in batches:
            found = [predictor.predict(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield replace_columns(b, ("lang_pred", "score"), [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())])

    return docs.mapInArrow(tidied(run), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    return crc(id_col) % 4 != 2


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without those whose language can't be told: und, or no more likely than by chance, where the model knows
    no character of the text; columns as before."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # clashing columns step aside while the predictions are there
    aside = {c: f"{c}__kept" for c in docs.columns if c in ("lang_pred", "score")}
    chance = (1 + 1e-9) / max(1, len(model.langs)) if len(model.langs) > 1 else 0.0
    told = identify(docs.withColumnsRenamed(aside), model, text_col).where((F.col("lang_pred") != UND) & (F.col("score") > chance))
    return told.select(*own, *(F.col(v).alias(k) for k, v in aside.items())).select(*docs.columns)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(training_rows(docs)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")
