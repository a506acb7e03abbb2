"""Language identification (operator 4): multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled documents; the matrix of log probabilities is broadcast
(buckets times languages, fixed by parameters and the label set), and whole texts are scored in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import fresh, small_batches, widened
from netloom.llm.words import chunks, mix

BUCKETS = 1 << 15
#: Labelled rows that the classifier is fitted on, in expectation (chosen by a hash of the id).
FIT_ROWS = 20_000
ORDERS = (1, 2, 3)
UNKNOWN = "und"

_letters = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: (letters in each row, buckets of n-grams, their row)."""
    is_letter = letters()
    with np.errstate(over="ignore"):
        for _, _, data, at in chunks(column, 1 << 19):
            texts = [t.lower() for t in _split(data, at)]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
            lengths = np.array([len(t) for t in texts], np.int64)
            rows = np.repeat(np.arange(len(texts)), lengths)
            good = is_letter[codes]
            found = np.bincount(rows[good], minlength=len(texts))
            codes = np.where(good, codes, 0).astype(np.uint64)
            # runs of other characters count as one space
            keep = good.copy()
            keep[1:] |= good[:-1] | (rows[1:] != rows[:-1])
            codes, rows = codes[keep], rows[keep]
            buckets, owners = [], []
            key = np.zeros(len(codes), np.uint64)
            for n in ORDERS:
                key = codes.copy() if n == 1 else (key[:-1] << np.uint64(21)) | codes[n - 1 :]
                same = rows[: len(key)] == rows[n - 1 : n - 1 + len(key)]
                ok = same & (key != 0)
                buckets.append((mix(key[ok], n) & np.uint64(BUCKETS - 1)).astype(np.int64))
                owners.append(rows[: len(key)][ok])
            yield found, np.concatenate(buckets), np.concatenate(owners)


def _split(data: np.ndarray, at: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.table, self.prior = langs, table, prior

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for found, buckets, owners in grams(column):
            n = len(found)
            total = np.tile(self.prior, (n, 1))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owners, self.table[k][buckets], minlength=n)
            if self.langs:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, share = np.zeros(n, np.int64), np.zeros(n)
            known = (found > 0) & bool(self.langs)
            names += [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())]
            scores.append(np.where(known, share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from text and language of labelled documents outside the held-out quarter; ``fit_rows`` of them in expectation."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & ~held_out(id_col))
    known = known.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    many = known.select("i", "lang").count()
    share = min(1.0, fit_rows / max(1, many))
    sample = known.where(F.pmod(F.xxhash64("i", F.lit(4)), F.lit(1 << 24)) < int(share * (1 << 24)) + (share == 1.0)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            at = 0
            for found, buckets, owners in grams(batch.column(1)):
                mine = langs[at : at + len(found)]
                at += len(found)
                for lang in set(mine):
                    pick = np.array([x == lang for x in mine])
                    sums[lang] = sums.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(buckets[pick[owners]], minlength=BUCKETS)
                    rows[lang] = rows.get(lang, 0) + int(pick.sum())
        for lang, total in sums.items():
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(where) + 1)), pa.array([-1, *where.tolist()], pa.int32()), pa.array([rows[lang], *total[where].tolist()], pa.int64())],
                ["lang", "bucket", "c"],
            )

    counted = sample.mapInArrow(run, "lang string, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    table = np.zeros((len(langs), BUCKETS))
    prior = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        mine = counted[counted["lang"] == lang]
        bucket, c = mine["bucket"].to_numpy(), mine["c"].to_numpy()
        prior[k] = c[bucket < 0].sum()
        np.add.at(table[k], bucket[bucket >= 0], c[bucket >= 0])
        table[k] = np.log((table[k] + 0.5) / (table[k].sum() + 0.5 * BUCKETS))
    return Model(langs, table, np.log(prior / prior.sum()) if len(langs) else prior)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` string and ``score`` double, the share of the predicted language.

    Null texts and texts without a letter are ``und`` with a score of 0, as is everything if nothing was learned. Ties go to the
    first language in order of names. Columns of these names in ``docs`` are replaced; equal texts get equal results.
    """
    small_batches(docs.sparkSession)
    docs = fresh(docs, "lang_pred", "score")
    names = docs.columns
    where = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.score(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs, lang_pred="string", score="double"))
