"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded (letters lower case, all else a blank) and their n-grams of 1 to ``Plan.order`` characters hashed into
``Plan.buckets``. Counts by (language, bucket) are summed over every training document; the matrix of log-probabilities
has languages times buckets entries. It is made and broadcast in blocks of ``Plan.languages`` languages, so each broadcast is
bounded by parameters; texts pass the blocks one after another and carry the best language so far and the sum for the
posterior. A slice of documents is a sparse matrix, rows of bucket numbers, which numpy multiplies by gathering and
summing segments.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if no document could be
learnt from; texts of any length are scored whole; ties go to the language that sorts first; a null key takes part in
learning; repeated rows count and are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, slices


@dataclass(frozen=True)
class Plan:
    order: int = 3
    buckets: int = 1 << 14
    smoothing: float = 0.5
    languages: int = 1000  #: of a block


def held_out(key: str) -> Column:
    """True for the documents that are never learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point → its lower-case letter, 0 if it is no letter; built once in each process."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, np.uint32)
        for point in range(len(table)):
            char = chr(point)
            if char.isalpha():
                lower = char.lower()
                table[point] = ord(lower) if len(lower) == 1 else point
        _fold = table
    return _fold


def ngrams(texts: list[str | None], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the number of the text of each, and whether a text has a letter."""
    gap = plan.order - 1  # blanks before each text, which belong to it, so no n-gram reaches into two
    joined = "".join("\0" * gap + (t or "") for t in texts) + "\0" * gap
    lengths = np.array([len(t or "") + gap for t in texts], np.int64)
    lengths[-1:] += gap
    codes = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    letter = codes > 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    buckets, owners = [], []
    rolling, some = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for n in range(1, plan.order + 1):
        end = len(codes) - n + 1
        rolling = rolling[:end] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        some = some[:end] | letter[n - 1 :]
        mixed = (rolling[some] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        buckets.append(((mixed >> np.uint64(40)) % np.uint64(plan.buckets)).astype(np.int32))
        owners.append(owner[:end][some])
    has_letter = np.bincount(owner, letter, len(texts)) > 0
    return np.concatenate(buckets), np.concatenate(owners), has_letter


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  #: languages × buckets
    plan: Plan

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities, languages × texts, and whether a text has a letter."""
        buckets, owners, has_letter = ngrams(texts, self.plan)
        sums = np.stack([np.bincount(owners, row[buckets], len(texts)) for row in self.log_prob]) + self.log_prior[:, None]
        return sums, has_letter


def train(docs: DataFrame, text: str = "text", lang: str = "lang", plan: Plan = Plan()) -> list[Model]:
    """Learn from every row whose language is not null; blocks of languages in their order."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in slices(batch, "text"):
                langs = np.array(rows.column("lang").to_pylist(), object)
                buckets, owners, _ = ngrams(rows.column("text").to_pylist(), plan)
                for name in set(langs):
                    mine = langs == name
                    found = np.bincount(buckets[mine[owners]], minlength=plan.buckets + 1)
                    found[plan.buckets] = mine.sum()  # the last cell counts documents
                    sums[name] = sums.get(name, 0) + found
        for name, found in sums.items():
            cells = np.flatnonzero(found)
            columns = [pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(found[cells])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "cell", "n"])

    cells = labelled.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession, "language")
    cells = scratch.table(cells, "cells")
    sizes = cells.filter(F.col("cell") == plan.buckets).select("lang", "n").orderBy("lang").collect()  # one row a language
    total = float(sum(r["n"] for r in sizes))
    models = []
    for start in range(0, len(sizes), plan.languages):
        block = sizes[start : start + plan.languages]
        names, row = [r["lang"] for r in block], {r["lang"]: i for i, r in enumerate(block)}
        found = cells.filter(F.col("lang").between(names[0], names[-1]) & (F.col("cell") < plan.buckets)).toPandas()
        grams = np.full((len(names), plan.buckets), plan.smoothing)
        grams[found["lang"].map(row).to_numpy(dtype=int), found["cell"].to_numpy()] += found["n"]
        prior = np.log(np.array([r["n"] for r in block]) / total)
        models.append(Model(tuple(names), prior, np.log(grams / grams.sum(axis=1, keepdims=True)), plan))
    scratch.drop("cells")
    return models


def _passed(rows: DataFrame, model: Model, last: bool) -> DataFrame:
    """key, text (but for the last block), best, lang, total: after one block of languages; total is the log of the sum of
    all probabilities."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in rows.schema if not last or f.name != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sums, has_letter = model.score(part.column("text").to_pylist())
                best, total = (part.column(c).to_numpy(zero_copy_only=False) for c in ("best", "total"))
                top, own = sums.max(axis=0), sums.argmax(axis=0)
                higher = (top > best) & has_letter
                langs = [model.languages[n] if up else old for n, up, old in zip(own, higher, part.column("lang").to_pylist())]
                total = np.where(has_letter, np.logaddexp(total, np.logaddexp.reduce(sums, axis=0)), total)
                out = {"key": part.column("key"), "text": part.column("text"), "best": pa.array(np.where(higher, top, best)),
                       "lang": pa.array(langs, pa.string()), "total": pa.array(total)}
                yield pa.RecordBatch.from_arrays([out[name] for name in schema.names], schema.names)

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, models: list[Model], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score."""
    none = F.lit(float("-inf"))
    rows = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), none.alias("best"), F.lit("und").alias("lang"), none.alias("total")
    )
    for model in models:
        rows = _passed(rows, model, model is models[-1])
    score = F.when(F.col("total") > none, F.exp(F.col("best") - F.col("total"))).otherwise(0.0)
    return rows.select(F.col("key").alias(key), F.col("lang").alias("lang_pred"), F.least(score, F.lit(1.0)).alias("score"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", plan: Plan = Plan()) -> DataFrame:
    """Train on what is not held out; predict every document."""
    models = train(docs.filter(~held_out(key)), text, lang, plan)
    return predict(docs, models, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
