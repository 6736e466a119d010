"""Token counts kept up by signed changes.

A change adds a document (+1, +tokens), takes one away (-1, -tokens) or revises a count (0, new - old). Totals are sums
by source, language and tokenizer version, so batches add up in any order. A batch is written under its own name in
one step, replacing what an attempt before it left; a batch whose name is committed already is left alone. So applying a batch twice, or again after a
crash, changes nothing. compact() folds committed batches into one table, and their names into another.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flushes

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
TABLE = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_VOCABULARY = 32_000_000


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=held, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens", pattern: str = PATTERN) -> DataFrame:
    """docs with the number of byte-pair tokens of the text; 0 for null. out_col replaces a column of its name.

    vocabulary is a file of base64 tokens and ranks that the driver can open; its bytes (MOST_VOCABULARY at most) are
    broadcast.
    """
    from pathlib import Path

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    raw = Path(vocabulary).read_bytes()
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MOST_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    docs = docs.drop(out_col)
    schema = StructType([*docs.schema.fields]).add(out_col, LongType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        encoding = _encoding(shared.value, pattern)
        for batch in flushes(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def inserts(docs: DataFrame, tokenizer: str, sign: int = 1, text_col: str = "text") -> DataFrame:
    """Changes that add (or, with sign -1, take away) documents with n_tokens, source and lang."""
    n_bytes = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0))
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (n_bytes * sign).alias("n_bytes"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from one set of changes to another: what was is taken away, what is now is added."""
    return before.withColumns({c: -F.col(c) for c in SUMS}).unionByName(after)


def revised(docs: DataFrame, old: str, new: str, tokenizer: str) -> DataFrame:
    """Changes that take the counts in column old to those in column new, of documents that stay; null counts as 0."""
    by = F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0))
    none = F.lit(0).cast("long")
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), none.alias("n_docs"), by.cast("long").alias("n_tokens"), none.alias("n_bytes"))


class Rollup:
    """Totals in a folder that driver and executors share.

    Null sources, languages and tokenizers are keys of their own. Keys whose sums are all zero are not returned. A batch
    name is letters, digits, - and _; its changes are added up before they are written, so a batch holds a row a key.
    The driver lists the batches that no compaction has folded yet; names of folded ones stay in tables, a new one for
    each compaction, and are looked up there.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        p = self._hadoop.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, kind: str) -> list[str]:
        """Committed tables of a kind; the writer's _SUCCESS marks them."""
        fs, p = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        held = [s.getPath() for s in fs.listStatus(p)]
        return sorted(x.getName() for x in held if fs.exists(self._hadoop.Path(x, "_SUCCESS")))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of changes; False if it was committed before."""
        if not batch.replace("-", "a").replace("_", "a").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self._names("batches") or self._folded([batch]):
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _folded(self, batches: list[str]) -> set[str]:
        """Which of these batches a compaction holds."""
        paths = [f"{self.path}/compact/{v}/names" for v in self._names("compact")]
        if not paths or not batches:
            return set()
        rows = self.spark.read.schema("batch string").parquet(*paths).filter(F.col("batch").isin(batches))
        return {r.batch for r in rows.distinct().collect()}

    def _open(self) -> tuple[list[str], list[str], str | None]:
        """Batches that no compaction holds; those that one does, whose files a crash has left; the newest compaction."""
        there, held = self._names("batches"), self._names("compact")
        folded = self._folded(there)
        return [b for b in there if b not in folded], sorted(folded), held[-1] if held else None

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes): one row a key."""
        batches, _, base = self._open()
        paths = [f"{self.path}/batches/{b}" for b in batches] + ([f"{self.path}/compact/{base}/sums"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], TABLE)
        sums = self.spark.read.schema(TABLE).parquet(*paths).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Folds all committed batches into a new table; the batches' own files go once it is committed.

        Its _SUCCESS comes last: a crash before leaves the batches in force, one after leaves files that no one reads.
        """
        batches, done, base = self._open()
        if batches:
            to = f"{self.path}/compact/v{int(base[1:]) + 1 if base else 1:08d}"
            self.totals().write.mode("overwrite").parquet(f"{to}/sums")
            self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{to}/names")
            fs, p = self._fs(f"{to}/_SUCCESS")
            fs.create(p, True).close()
        fs, _ = self._fs(self.path)
        for b in batches + done:
            fs.delete(self._hadoop.Path(f"{self.path}/batches/{b}"), True)
