"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems (first bytes), pairs of neighbours and pairs with one word between, hashed to 2**bits
places, each present or not. Training reads labelled rows only, at most `most_rows` of them and `most_bytes` of their text
(the first by a hash of their id), on one task, in a fixed order; per-coordinate rates and the L1 term leave a few
thousand weights. Scoring all documents is one pass with those weights, whose number is bounded by 2**bits, broadcast.

SETTING was chosen by compared(), cross-validation on rows whose labels may be learnt; see the README for its figures.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, NOT_ALNUM, Words, checkpointed, flushes, mix, U64, utf8

#: What one task learns from at most: rows, and bytes of text.
MOST_ROWS, MOST_BYTES = 12_000, 100_000_000


@dataclass(frozen=True)
class Setting:
    """Lengths of stems in bytes, rate, L1 and rounds over the rows; features have 2**bits places."""

    stems: tuple[int, ...] = ()
    alpha: float = 0.5
    l1: float = 1.0
    epochs: int = 5
    bits: int = 20


SETTING = Setting(stems=(4, 5, 6), alpha=0.5, l1=3.0, epochs=5)


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every n-gram, repeats included."""
    h, text = words.hash, words.text
    places, owners = [h, *words.stems.values()], [text] * (1 + len(words.stems))
    for gap, salt in ((1, 0x632BE59B), (2, 0x85157AF5)):
        good = text[:-gap] == text[gap:]
        places.append(mix((h[:-gap] * U64(0xD1342543DE82EF95) + h[gap:]) ^ U64(salt))[good])
        owners.append(text[:-gap][good])
    return (np.concatenate(places) >> U64(64 - bits)).astype(np.int64), np.concatenate(owners)


def by_text(place: np.ndarray, owner: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """Distinct places of each text."""
    both = np.unique((owner.astype(np.int64) << bits) | place)
    at = np.searchsorted(both >> bits, np.arange(n + 1))
    both &= (1 << bits) - 1
    return [both[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, size: int, alpha: float, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] += g * g


def _train(setting: Setting):
    def run(batches):
        rows: list[tuple[np.ndarray, int]] = []
        for batch in flushes(batches, "text"):
            words = Words(*utf8(batch.column(0)), LOWER, NOT_ALNUM, setting.stems)
            rows += zip(by_text(*features(words, setting.bits), words.n_texts, setting.bits), batch.column(1).to_pylist(), strict=True)
        bias = 1 << setting.bits
        model = Ftrl(bias + 1, setting.alpha, l1=setting.l1)
        order = np.random.default_rng(1)
        for _ in range(setting.epochs):
            for k in order.permutation(len(rows)).tolist():
                i, y = rows[k]
                model.learn(np.append(i, bias), y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    return run


def _picked(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column | None, most_rows: int, most_bytes: int) -> DataFrame:
    """(_id, _y) of the rows to learn from: by a hash of the id, the first most_rows whose texts add up to most_bytes."""
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    if where is not None:
        picked = picked.withColumnRenamed("_id", id_col).filter(where).withColumnRenamed(id_col, "_id")
    picked = checkpointed(picked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows))
    # one row for each picked id, so this is no larger than they are
    sizes = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_n")).join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    upto = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return checkpointed(sizes.withColumn("_n", F.sum("_n").over(upto)).filter(F.col("_n") <= most_bytes).select("_id", "_y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, setting: Setting = SETTING) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that aren't zero; place 2**bits is the bias.

    Null labels and ids are left out; of labels that differ for one id the greatest counts. where limits the labelled
    rows by id. Documents that repeat an id all count. No labelled rows give no weights, and so scores of 0.5.
    """
    picked = _picked(docs, labels, id_col, text_col, label_col, where, most_rows, most_bytes)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")
    rows = rows.select("text", "_y", "_id").repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "text").select("text", "_y")
    model = rows.mapInArrow(_train(setting), "place long, weight double").toPandas()
    return model["place"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def compared(docs: DataFrame, labels: DataFrame, settings: list[Setting], where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, folds: int = 3, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Cross-validation of settings on rows that may be learnt from: (setting, hits, missed, wrong, f1).

    where leaves out the rows whose labels must not be seen; no others are read. Fold of a row: a hash of its id. Each
    (setting, fold) is one task, which holds the bounded training rows; counts are summed over the folds.
    """
    picked = _picked(docs, labels, id_col, text_col, label_col, where, most_rows, most_bytes)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")
    rows = rows.select("text", "_y", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(folds)).cast("int").alias("fold"), F.xxhash64("_id").alias("o"))
    schema = pa.schema([("setting", pa.int32()), ("hits", pa.int64()), ("missed", pa.int64()), ("wrong", pa.int64())])

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("text", "ascending")])
        i, k = table.column("run")[0].as_py(), table.column("test")[0].as_py()
        s, mine = settings[i], pc.equal(table.column("fold"), k)
        learn, test = (table.filter(m).select(["text", "_y"]) for m in (pc.invert(mine), mine))
        (made,) = _train(s)(learn.combine_chunks().to_batches())
        weights = np.zeros((1 << s.bits) + 1)
        weights[made.column(0).to_numpy()] = made.column(1).to_numpy()
        total = np.concatenate([_totals(b.column(0), weights, s) for b in flushes(test.combine_chunks().to_batches(), "text")] or [np.zeros(0)])
        said, y = 1 / (1 + np.exp(-np.clip(total, -30, 30))) >= threshold, test.column("_y").to_numpy() == 1
        return pa.table([[i], [int((said & y).sum())], [int((~said & y).sum())], [int((said & ~y).sum())]], schema=schema)

    # each row goes to every run; the caller's settings and folds bound their number
    runs = F.array(*(F.struct(F.lit(i).alias("run"), F.lit(k).alias("test")) for i in range(len(settings)) for k in range(folds)))
    out = rows.withColumn("r", F.explode(runs)).select("*", "r.*").drop("r").groupBy("run", "test").applyInArrow(judge, "setting int, hits long, missed long, wrong long")
    sums = out.groupBy("setting").agg(*(F.sum(c).alias(c) for c in ("hits", "missed", "wrong")))
    return sums.withColumn("f1", 2 * F.col("hits") / (2 * F.col("hits") + F.col("missed") + F.col("wrong"))).orderBy(F.col("f1").desc(), "setting")


def _totals(texts: pa.Array, table: np.ndarray, setting: Setting) -> np.ndarray:
    """Sum of weights of each text's distinct features, and the bias."""
    words = Words(*utf8(texts), LOWER, NOT_ALNUM, setting.stems)
    place, owner = features(words, setting.bits)
    good = table[place] != 0
    both = np.unique((owner[good].astype(np.int64) << setting.bits) | place[good])
    return np.bincount(both >> setting.bits, table[both & ((1 << setting.bits) - 1)], minlength=words.n_texts) + table[1 << setting.bits]


def _score(model, setting: Setting):
    def run(batches):
        places, weights = model.value
        table = np.zeros((1 << setting.bits) + 1)
        table[places] = weights
        for batch in flushes(batches, "text"):
            total = _totals(batch.column(1), table, setting)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", setting: Setting = SETTING) -> DataFrame:
    """(id_col, score) for each row of docs: the chance that the text is toxic. Null and word-less texts get the bias's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared, setting), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2. Null ids aren't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
