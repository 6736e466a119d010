"""Text, vector, scored and hybrid search."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import predicate, round_scaled, tokens
from ..storage import checkpointed, file_system, widened

#: What tokens are: see functions.tokens.
TOKEN = "[a-z]+|[0-9]+"


def text_search(df: DataFrame, keyword: str, order: str, limit: int | None = 50, columns: list[str] | None = None) -> DataFrame:
    """The first rows, in the given order, of which any text holds the keyword in any case; without a limit all, unordered."""
    texts = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    hit = reduce(lambda a, b: a | b, (predicate(F.col(c), "icontains", keyword) for c in texts))
    return _first(df.filter(hit), order, limit)


def record_search(df: DataFrame, keyword: str, order: str, limit: int | None = 50, columns: list[str] | None = None) -> DataFrame:
    """text_search() over the JSON text of each record, so that nested fields, numbers and names of fields are searched too."""
    text = F.to_json(F.struct(*(F.col(c) for c in columns or df.columns)), {"ignoreNullFields": "false"})
    return _first(df.filter(predicate(text, "icontains", keyword)), order, limit)


def _first(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(order).limit(limit)


def _terms(query: str) -> list[str]:
    return re.findall(TOKEN, query.lower())


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id_col, score) of documents that hold a query term; repeated terms count repeatedly.

    Texts are read once: their lengths and the query's terms are counted into a checkpoint of one narrow row a document,
    from which the sums and then the scores come. Empty documents count in N and avgdl.
    """
    terms = _terms(query)
    if not terms:
        return df.select(id_col, F.lit(0.0).alias("score")).limit(0)
    distinct = sorted(set(terms))
    low = F.lower(F.coalesce(text_col, F.lit("")))
    rows = widened(df.select(id_col, low.alias("_low")))
    counts = checkpointed(rows.select(id_col, F.regexp_count("_low", F.lit(TOKEN)).alias("dl"), *(_occurrences(F.col("_low"), w).alias(f"tf{i}") for i, w in enumerate(distinct))))
    # one row: number of documents, mean length, document frequencies
    s = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct)))).first()
    return _scored(counts, id_col, terms, s["n"], s["avgdl"], {w: s[f"df{i}"] for i, w in enumerate(distinct)}, k1, b)


def _scored(counts: DataFrame, id_col: str, terms: list[str], n: int, avgdl: float | None, df: dict[str, int], k1: float, b: float) -> DataFrame:
    """Scores from (id, dl, tf0, tf1, ...), tf in order of the distinct terms."""
    distinct = sorted(set(terms))
    score = F.lit(0.0)
    for term in terms:
        idf = F.log(F.lit((n - df[term] + 0.5) / (df[term] + 0.5) + 1.0))
        tf = F.col(f"tf{distinct.index(term)}").cast("double")
        score = score + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / (avgdl or 1.0)))).otherwise(0.0)
    return counts.filter(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(distinct))))).select(id_col, score.alias("score"))


class TextIndex:
    """A BM25 index as two tables in a folder: postings (term, id, tf) dealt by a hash of the term, and documents (id, dl).

    Each change writes a version of the index of its own (see put and remove): rows of a batch, and for ids that it
    replaces or removes a tombstone; of an id the newest version counts. A search reads the query's buckets only.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.path, self.id_col, self.text_col = spark, path.rstrip("/"), id_col, text_col

    def _version(self) -> int:
        fs, p = file_system(self.spark, f"{self.path}/docs")
        held = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.partition("=")[2]) for n in held if n.startswith("version=")), default=0)

    def put(self, docs: DataFrame) -> None:
        """Adds documents, in place of those with the same ids. Ids are unique within docs and not null."""
        v = self._version() + 1
        held = widened(docs.select(F.col(self.id_col).alias("id"), tokens(F.coalesce(self.text_col, F.lit(""))).alias("t")))
        terms = held.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int")
        terms.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/version={v}")
        held.select("id", F.size("t").alias("dl")).write.mode("overwrite").parquet(f"{self.path}/docs/version={v}")

    def remove(self, ids: DataFrame) -> None:
        """Takes documents away: a tombstone (dl null) for each id."""
        v = self._version() + 1
        ids.select(F.col(self.id_col).alias("id"), F.lit(None).cast("int").alias("dl")).distinct().write.mode("overwrite").parquet(f"{self.path}/docs/version={v}")

    def _docs(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/docs")
        latest = rows.groupBy("id").agg(F.max_by(F.struct("version", "dl"), "version").alias("r"))
        return latest.select("id", F.col("r.version").alias("version"), F.col("r.dl").alias("dl")).filter("dl IS NOT NULL")

    def stats(self) -> DataFrame:
        """(documents, avgdl)."""
        return self._docs().agg(F.count("*").alias("documents"), F.avg("dl").alias("avgdl"))

    def search(self, query: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(id_col, score), best first: the same scores as bm25() over the documents that the index holds."""
        terms = _terms(query)
        distinct = sorted(set(terms))
        docs = self._docs()
        if not terms:
            return docs.select(F.col("id").alias(self.id_col), F.lit(0.0).alias("score")).limit(0)
        n, avgdl = docs.agg(F.count("*"), F.avg("dl")).first()
        in_buckets = F.col("bucket").isin([r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(self.BUCKETS)).cast("int") for w in distinct)))).distinct().collect()])
        hits = self.spark.read.parquet(f"{self.path}/terms").filter(in_buckets & F.col("term").isin(distinct)).join(docs, ["id", "version"])
        counts = checkpointed(hits.groupBy(F.col("id").alias(self.id_col)).agg(F.first("dl").alias("dl"), *(F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, w in enumerate(distinct))))
        df = counts.agg(*(F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)) for i in range(len(distinct)))).first()
        scored = _scored(counts, self.id_col, terms, n, avgdl, dict(zip(distinct, df, strict=True)), k1, b)
        return top(scored.withColumn("score", F.round("score", 6)), self.id_col, k)


def _occurrences(text: Column, word: str) -> Column:
    """How many tokens of a text in lower case are the word, without building an array of all tokens."""
    kind = "[0-9]" if word[0].isdigit() else "[a-z]"
    count = F.regexp_count(text, F.lit(f"(?<!{kind}){word}(?!{kind})"))
    return F.when(F.contains(text, F.lit(word)), count).otherwise(0)  # most texts hold none, and need no pattern


def top(scored: DataFrame, id_col: str, k: int, score: str = "score", ascending: bool = False) -> DataFrame:
    return scored.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), id_col).limit(k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 where a norm is zero or lengths differ."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    c = F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms).otherwise(0.0)
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))


def euclidean(a: Column, b: Column) -> Column:
    """Infinite where lengths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d)).otherwise(float("inf"))


def vector_search(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = 5, metric: str = "cosine") -> DataFrame:
    """(id_col, score): exact top k; vectors that are null or of another length are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = df.filter(F.size(vector_col) == len(query))
    if metric == "cosine":
        return top(rows.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("score")), id_col, k)
    return top(rows.select(id_col, F.round(euclidean(F.col(vector_col), q), 6).alias("score")), id_col, k, ascending=True)


#: Queries that are broadcast at a time, and numbers in their vectors.
MOST_QUERIES, MOST_NUMBERS = 10_000, 8_000_000
#: Queries that are compared with a batch of vectors at a time.
AT_ONCE = 256


def vector_search_batch(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, k: int = 5) -> DataFrame:
    """(query, id_col, score, rank): exact top k by cosine for each of a set of queries; ties by id.

    Vectors are compared with all queries as matrix products, a batch at a time; a batch passes on its k best for each
    query. More than MOST_QUERIES queries (or MOST_NUMBERS numbers) are searched in blocks of at most so many, one after
    another, each block's result written to the folder of checkpoints. Vectors of another length than a query's, and
    null ones, are left out for it. Rows that agree in id and vector share a block.
    """
    q = queries.select(F.col(query_id).alias("query"), F.col(vector_col).alias("_q")).filter("_q IS NOT NULL")
    n, numbers = q.agg(F.count("*"), F.coalesce(F.sum(F.size("_q")), F.lit(0))).first()
    if n <= MOST_QUERIES and numbers <= MOST_NUMBERS:
        return _ranked(_nearest(df, id_col, vector_col, q, k), id_col, k)
    most = min(MOST_QUERIES, max(1, MOST_NUMBERS * n // max(1, numbers)))
    buckets = 16 * -(-n // most)
    q = q.withColumn("_b", F.pmod(F.xxhash64("query", "_q"), F.lit(buckets)).cast("int"))
    sizes = sorted(map(tuple, q.groupBy("_b").count().collect()))  # as many rows as buckets
    found = [checkpointed(_nearest(df, id_col, vector_col, q.filter(F.col("_b").isin(block)).drop("_b"), k)) for block in _blocks(sizes, most)]
    # rows of one query id with different vectors may lie in several blocks
    return _ranked(reduce(DataFrame.unionByName, found), id_col, k)


def _blocks(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Buckets (number, size) in groups whose sizes add up to `most` at most; a larger bucket is a group of its own."""
    out, held = [], most
    for bucket, size in sizes:
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append(bucket)
        held += size
    return out


def _matrices(column) -> dict:
    """Vectors of an Arrow column by length: (places, unit rows); null vectors are left out, zero ones stay zero."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, -1)
    out = {}
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    start = column.offsets.to_numpy()[:-1] if len(column) else sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        rows = flat[start[at][:, None] + np.arange(d)]
        norms = np.sqrt((rows * rows).sum(1, keepdims=True))
        out[d] = at, np.nan_to_num(np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0))
    return out


def _best(units, wanted, ids, k: int):
    """(query number, row, score) of the k best rows for each query, ties by id; scores to 6 places."""
    import numpy as np

    order = np.unique(ids, return_inverse=True)[1]
    out = []
    for a in range(0, len(wanted), AT_ONCE):
        scores = np.clip(np.round(wanted[a : a + AT_ONCE] @ units.T, 6), -1, 1)
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -2.0)
        who, row = np.nonzero(scores >= least[:, None])
        sort = np.lexsort((order[row], -scores[who, row], who))
        who, row = who[sort], row[sort]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        who, row = who[place < k], row[place < k]
        out.append((who + a, row, scores[who, row]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _nearest(df: DataFrame, id_col: str, vector_col: str, q: DataFrame, k: int) -> DataFrame:
    """(query, id_col, score): the best of each batch of vectors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, held = df.sparkSession, q.collect()
    by_size: dict[int, list] = {}
    for i, r in enumerate(held):
        by_size.setdefault(len(r["_q"]), []).append(i)
    shared = spark.sparkContext.broadcast({d: (at, [held[i]["_q"] for i in at]) for d, at in by_size.items() if d})
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = T.StructType([T.StructField("at", T.IntegerType()), rows.schema["id"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np

        units = {}
        for d, (at, vectors) in shared.value.items():
            m = np.array([[float("nan") if x is None else x for x in v] for v in vectors], np.float64)
            norms = np.sqrt((m * m).sum(1, keepdims=True))
            units[d] = np.array(at, np.int32), np.nan_to_num(np.divide(m, norms, out=np.zeros_like(m), where=norms > 0))
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            for d, (places, mine) in _matrices(vectors).items():
                if d in units:
                    who, row, score = _best(mine, units[d][1], ids.take(pa.array(places)).to_numpy(zero_copy_only=False), k)
                    yield pa.RecordBatch.from_arrays([pa.array(units[d][0][who]), ids.take(pa.array(places[row])), pa.array(score)], schema=arrow)

    found = rows.mapInArrow(run, schema)
    names = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(held)], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("query", q.schema["query"].dataType)]))
    return found.join(F.broadcast(names), "at").select("query", F.col("id").alias(id_col), "score")


def _ranked(near: DataFrame, id_col: str, k: int) -> DataFrame:
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), id_col))).filter(F.col("rank") <= k)


class VectorIndex:
    """Approximate nearest neighbours by cells: centres are fitted on a bounded sample, every vector is in its centre's cell.

    A query is compared exactly with the vectors of the `probes` cells whose centres are nearest. More probes find more;
    the tests measure the share of true neighbours that are found. fit() samples SAMPLE vectors at most, the least by a hash.
    """

    SAMPLE, ROUNDS = 20_000, 12

    def __init__(self, rows: DataFrame, centres, id_col: str, vector_col: str):
        self.rows, self.centres, self.id_col, self.vector_col = rows, centres, id_col, vector_col

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, vector_col: str, cells: int = 64, sample: int = SAMPLE) -> VectorIndex:
        """Vectors that are null, empty or of another length than the most common one of the sample are in no cell."""
        import numpy as np

        drawn = df.filter(F.size(vector_col) > 0).select(vector_col).orderBy(F.xxhash64(vector_col)).limit(sample).collect()
        sizes = [len(r[0]) for r in drawn]
        d = max(set(sizes), key=lambda x: (sizes.count(x), x)) if sizes else 0
        rows = [[0.0 if x is None else x for x in r[0]] for r in drawn if len(r[0]) == d]
        m = np.array(rows, np.float64).reshape(len(rows), d)
        m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
        centres = m[:: max(1, len(m) // cells)][:cells].copy()
        for _ in range(cls.ROUNDS if len(m) else 0):
            cell = np.argmax(m @ centres.T, axis=1)
            for c in range(len(centres)):
                if (cell == c).any():
                    centres[c] = m[cell == c].mean(0)
            centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
        return cls(cls._dealt(df.select(id_col, vector_col), vector_col, centres, 1), centres, id_col, vector_col)

    @staticmethod
    def _dealt(df: DataFrame, vector_col: str, centres, most: int) -> DataFrame:
        """df with cell, the number of each of the `most` nearest centres: a row for each."""
        from pyspark.sql.pandas.types import to_arrow_schema

        shared = df.sparkSession.sparkContext.broadcast(centres)
        schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
        arrow, at = to_arrow_schema(schema), df.columns.index(vector_col)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            c = shared.value
            for batch in batches:
                places, units = _matrices(batch.column(at)).get(c.shape[1], (np.zeros(0, np.int64), np.zeros((0, c.shape[1]))))
                if not len(places) or not len(c):
                    continue
                cell = np.argsort(-(units @ c.T), axis=1, kind="stable")[:, :most]
                out = batch.take(pa.array(np.repeat(places, cell.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.ravel().astype(np.int32))], schema=arrow)

        return df.mapInArrow(run, schema)

    def search(self, queries: DataFrame, query_id: str, k: int = 5, probes: int = 40) -> DataFrame:
        """(query, id_col, score, rank), for each query from its cells. Cells are joined by number; a cell's vectors are dealt by id, too."""
        salts = 16
        q = queries.select(F.col(query_id).alias("query"), F.col(self.vector_col).alias("_q"))
        asked = self._dealt(q, "_q", self.centres, probes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = self.rows.withColumn("salt", F.pmod(F.xxhash64(self.id_col), F.lit(salts)).cast("int"))
        scored = rows.join(asked, ["cell", "salt"]).select("query", self.id_col, F.round(cosine(F.col(self.vector_col), F.col("_q")), 6).alias("score"))
        return _ranked(scored, self.id_col, k)

    def put(self, df: DataFrame) -> VectorIndex:
        """The index with more vectors; centres stay."""
        more = self._dealt(df.select(self.id_col, self.vector_col), self.vector_col, self.centres, 1)
        return VectorIndex(self.rows.unionByName(more), self.centres, self.id_col, self.vector_col)

    def remove(self, ids: DataFrame) -> VectorIndex:
        """The index without the vectors of these ids."""
        return VectorIndex(self.rows.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti"), self.centres, self.id_col, self.vector_col)

    def stats(self) -> DataFrame:
        """(cell, n): the vectors of each cell."""
        return self.rows.groupBy("cell").agg(F.count("*").alias("n"))


def ann(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = 5, cells: int = 64, probes: int = 40) -> DataFrame:
    """Approximate top k for one query: (id_col, distance), cosine distance; see VectorIndex."""
    one = df.sparkSession.createDataFrame([(0, [float(x) for x in query])], T.StructType([T.StructField("q", T.IntegerType()), T.StructField(vector_col, T.ArrayType(T.DoubleType()))]))
    near = VectorIndex.fit(df, id_col, vector_col, cells).search(one, "q", k, probes)
    return near.select(id_col, (1 - F.col("score")).alias("distance")).orderBy("distance", id_col)


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object
    weight: float = 1.0

    def score(self) -> Column:
        c, v = F.col(self.field), self.value
        if self.op == "between":
            mid, half = (v[0] + v[1]) / 2, (v[1] - v[0]) / 2
            inside = 1 - 0.5 * F.abs(c - mid) / half if half else F.lit(1.0)
            return F.when(F.coalesce(c.between(*v), F.lit(False)), inside).otherwise(0.0)
        if self.op == "near":
            return F.coalesce(1 / (1 + F.abs(c - v)), F.lit(0.0))
        return F.when(c.isNotNull() & predicate(c, self.op, v), 1.0).otherwise(0.0)


def scored(df: DataFrame, conditions: list[Condition], threshold: float = 0.0) -> DataFrame:
    """df with score, the weighted mean of the conditions' scores; rows under the threshold are left out."""
    weight = sum(c.weight for c in conditions)
    total = reduce(lambda a, b: a + b, (c.score() * c.weight for c in conditions), F.lit(0.0))
    return df.withColumn("score", round_scaled(total / weight, 4) if weight else F.lit(0.0)).filter(F.col("score") >= threshold)


def fused(rankings: list[DataFrame], id_col: str, k: int, weights: list[float] | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (id_col, score): sums of weight / (constant + rank)."""
    weights = weights or [1 / len(rankings)] * len(rankings)
    parts = []
    for r, w in zip(rankings, weights, strict=True):
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), id_col))
        parts.append(r.withColumn("_rank", rank).select(id_col, (F.lit(w) / (constant + F.col("_rank"))).alias("_s")))
    both = reduce(DataFrame.unionByName, parts)
    return top(both.groupBy(id_col).agg(F.round(F.sum("_s"), 6).alias("score")), id_col, k)


def hybrid(docs: DataFrame, vectors: DataFrame, id_col: str, text_col: str, vector_col: str, query: str, query_vector: list[float], k: int = 5) -> DataFrame:
    """BM25 and cosine, the first 3 k of each, fused."""
    sparse = top(bm25(docs, id_col, text_col, query).withColumn("score", F.round("score", 6)), id_col, 3 * k)
    return fused([sparse, vector_search(vectors, id_col, vector_col, query_vector, 3 * k)], id_col, k)
