"""Retrieval of clauses for queries, by vectors and by terms, and segmentation of clause text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadweave.functions.storage import spread, stored
from roadweave.operators.grid import Best, cells, streamed
from roadweave.operators.textsim import tokens

#: Pivots of the vectors, and clauses of one pivot that are compared, or skipped, at once.
PIVOTS = 64
BLOCK = 1024
#: Documents that are bounded, and skipped or scored, at once; cells of the matrix of terms and queries that a task works with.
DOCUMENTS = 16
CELLS = 4_000_000


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors, in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``, but for rounding."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


class _Nearest:
    """A cell's queries of all lengths; clauses come by pivot, so that a block of them is skipped where none can be near enough."""

    def __init__(self, asks: pa.Table, pivots: dict[int, np.ndarray], top: int, kinds: T.StructType, count: bool):
        self.row, sizes = asks.column("_q").to_numpy(), asks.column("_size").to_numpy()
        self.pivots, self.best, self.kinds, self.count = pivots, Best(len(self.row), top, 2), kinds, count
        self.blocks = self.skipped = 0
        vectors = asks.column("_v").combine_chunks()
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = _matrix(vectors.take(pa.array(at)), size)
            self.of[size] = at, x, _apart(x, pivots[size]) if size in pivots else np.zeros((len(at), 1))

    def meet(self, rows: pa.RecordBatch) -> None:
        sizes, pivot = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("_size", "_pivot"))
        away, parts, clauses, vectors = (rows.column(rows.schema.get_field_index(c)) for c in ("_away", "_p", "_c", "_v"))
        away, parts, clauses = away.to_numpy(), np.array(parts.to_pylist(), object), np.array(clauses.to_pylist(), object)
        cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(pivot) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            if int(sizes[lo]) in self.of:
                for at in range(lo, hi, BLOCK):
                    part = slice(at, min(at + BLOCK, hi))
                    self._block(int(sizes[lo]), int(pivot[lo]), away[part], parts[part], clauses[part], vectors.slice(at, part.stop - at))

    def _block(self, size: int, pivot: int, away: np.ndarray, parts: np.ndarray, clauses: np.ndarray, vectors: pa.Array) -> None:
        at, q, to_pivots = self.of[size]
        self.blocks += len(at)
        worst = self.best.worst[at]
        near = np.maximum(to_pivots[:, pivot] - away.max(), away.min() - to_pivots[:, pivot]) if pivot >= 0 else np.zeros(len(at))
        open_ = np.flatnonzero(near <= worst * (1 + 1e-6) + 1e-6 * (1 + away.max()))
        self.skipped += len(at) - len(open_)
        x = _matrix(vectors, size) if len(open_) else np.zeros((0, size))
        for some in (open_[i : i + 256] for i in range(0, len(open_), 256)):
            rough, limit = _apart(q[some], x), worst[some]
            if len(x) > self.best.k:
                limit = np.minimum(limit, np.partition(rough, self.best.k - 1, axis=1)[:, self.best.k - 1])
            slack = 1e-6 * (1 + np.sqrt((q[some] ** 2).sum(1)) + np.sqrt((x**2).sum(1).max()))
            i, j = np.nonzero(rough <= (limit + slack)[:, None])  # ties stay
            exact = np.sqrt(((x[j] - q[some[i]]) ** 2).sum(1))
            self.best.add(at[some[i]], exact, clauses[j], parts[j])

    def found(self) -> pa.RecordBatch:
        schema = to_arrow_schema(self.kinds)
        if self.count:
            return pa.RecordBatch.from_arrays([pa.array([self.blocks]), pa.nulls(1, schema.field(1).type), pa.nulls(1, schema.field(2).type), pa.array([float(self.skipped)])], schema=schema)
        place, value, (clauses, parts) = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(self.row[place]), pa.array(parts.tolist(), schema.field(1).type), pa.array(clauses.tolist(), schema.field(2).type), pa.array(value)], schema=schema)


def _searched(queries: DataFrame, clauses: DataFrame, top: int, key: str, part: str, clause: str, vector: str, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """The queries (_q, _k), and _q, _p, _c, distance of the best that each cell found."""
    wide = F.col(vector).cast("array<double>")
    whole = wide.isNotNull() & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x))
    q = queries.where(whole).select(F.col(key).alias("_k"), wide.alias("_v"), F.size(wide).alias("_size"))
    q = stored(q.withColumn("_q", F.monotonically_increasing_id()), "knn-queries")
    c = clauses.where(whole & F.col(clause).isNotNull()).select(F.col(part).alias("_p"), F.col(clause).alias("_c"), wide.alias("_v"), F.size(wide).alias("_size"))
    kinds = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_p", c.schema["_p"].dataType), T.StructField("_c", c.schema["_c"].dataType), T.StructField("distance", T.DoubleType())])
    pivots: dict[int, list] = {}
    for r in c.select("_size", "_v").orderBy(F.xxhash64("_v")).limit(PIVOTS).collect():
        pivots.setdefault(r["_size"], []).append(r["_v"])
    known = {size: np.array(v, float).reshape(len(v), size) for size, v in pivots.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            pivot, away = np.full(len(sizes), -1, np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size in known:
                    x = _matrix(batch.column(2).take(pa.array(at)), size)
                    pivot[at] = _apart(x, known[size]).argmin(1)
                    away[at] = np.sqrt(((x - known[size][pivot[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], names=[*batch.schema.names, "_pivot", "_away"])

    rows = c.mapInArrow(placed, T.StructType([*c.schema.fields, T.StructField("_pivot", T.IntegerType()), T.StructField("_away", T.DoubleType())]))
    grid = cells(rows, q.drop("_k"), c.count(), q.count(), ("_size", "_pivot", "_away"))
    return q, streamed(grid, lambda asks: _Nearest(asks, known, top, kinds, count), kinds)


def knn(queries: DataFrame, clauses: DataFrame, top: int = 15, each: int = 5, key: str = "query_id", part: str = "doc", clause: str = "clause_id", vector: str = "vector") -> DataFrame:
    """key, part, clause, distance, rank: of the ``top`` nearest clauses of a query the first ``each`` of a part.

    Exact at any size, in one pass over a grid of query parts and clause parts. A clause is known by its
    nearest of ``PIVOTS`` pivots and the distance to it; a block of clauses of one pivot is skipped for a
    query where, by the triangle inequality, all are farther than the ``top`` found so far. Vectors that
    are null or hold nulls or NaN, clauses without id, and pairs of other lengths take no part.
    """
    q, found = _searched(queries, clauses, top, key, part, clause, vector)
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_c"))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("_q", "_p").orderBy("distance", "_c"))).where(F.col("rank") <= each)
    return ranked.join(q.select("_q", "_k"), "_q").select(F.col("_k").alias(key), F.col("_p").alias(part), F.col("_c").alias(clause), "distance", "rank")


def knn_blocks(queries: DataFrame, clauses: DataFrame, top: int = 15, key: str = "query_id", part: str = "doc", clause: str = "clause_id", vector: str = "vector") -> tuple[int, int]:
    """Pairs of a query and a block of clauses that the search meets, and those that it skips."""
    met = _searched(queries, clauses, top, key, part, clause, vector, count=True)[1].agg(F.sum("_q"), F.sum("distance")).collect()[0]
    return int(met[0] or 0), int(met[1] or 0)


def retrieval_relevance(found: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """key, relevance: mean of 1 / (1 + distance) over what was kept, 0 if nothing was."""
    per = found.groupBy(key).agg(F.avg(1 / (1 + F.col("distance"))).alias("_m"))
    return queries.select(key).join(per, key, "left").select(key, F.coalesce("_m", F.lit(0.0)).alias("relevance"))


class _Scored:
    """A cell's queries as matrices of terms and queries; documents come by heaviest term and length, in blocks whose largest weights bound their scores."""

    def __init__(self, asks: pa.Table, k: int, kinds: T.StructType, count: bool):
        self.row = asks.column("_q").to_numpy()
        self.best, self.kinds, self.count = Best(len(self.row), k, 1), kinds, count
        self.pairs = self.scored = 0
        terms, weights = (asks.column(c).combine_chunks() for c in ("_terms", "_weights"))
        sizes = terms.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        terms, weights = terms.flatten().to_numpy(), weights.flatten().to_numpy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # queries, their terms, weights (term x query)
        lo = 0
        while lo < len(sizes):
            hi = lo + 1
            while hi < len(sizes) and (hi + 1 - lo) * int(sizes[lo : hi + 1].sum()) <= CELLS:
                hi += 1
            part = slice(ends[lo] - sizes[lo], ends[hi - 1])
            own, at = np.unique(terms[part], return_inverse=True)
            matrix = np.zeros((len(own), hi - lo))
            matrix[at, np.repeat(np.arange(hi - lo), sizes[lo:hi])] = weights[part]
            self.parts.append((np.arange(lo, hi), own, matrix))
            lo = hi

    def meet(self, rows: pa.RecordBatch) -> None:
        terms, weights, docs = (rows.column(rows.schema.get_field_index(c)) for c in ("_terms", "_weights", "_d"))
        docs = np.array(docs.to_pylist(), object)
        for at in range(0, len(docs), DOCUMENTS):
            some = terms.slice(at, DOCUMENTS)
            sizes = some.value_lengths().to_numpy()
            self._block(docs[at : at + DOCUMENTS], np.repeat(np.arange(len(sizes)), sizes), some.flatten().to_numpy(), weights.slice(at, DOCUMENTS).flatten().to_numpy())

    def _block(self, docs: np.ndarray, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        for queries, own, matrix in self.parts:
            place = np.minimum(np.searchsorted(own, term), len(own) - 1)
            held = np.flatnonzero(own[place] == term) if len(own) else np.zeros(0, int)
            self.pairs += len(docs) * len(queries)
            if not len(held):
                continue
            d, p, w = doc[held], place[held], weight[held]
            order = np.argsort(p, kind="stable")
            present, first = np.unique(p[order], return_index=True)
            bound = np.maximum.reduceat(w[order], first) @ matrix[present]
            active = np.flatnonzero((bound > 0) & (bound >= -self.best.worst[queries] - 2e-9))
            self.scored += len(docs) * len(active)
            if not len(active):
                continue
            there, start = np.unique(d, return_index=True)
            sums = np.add.reduceat(w[:, None] * matrix[np.ix_(p, active)], start, axis=0)
            i, j = np.nonzero((sums > 0) & (sums >= -self.best.worst[queries[active]] - 2e-9))
            self.best.add(queries[active[j]], -np.round(sums[i, j], 9), docs[there[i]])

    def found(self) -> pa.RecordBatch:
        schema = to_arrow_schema(self.kinds)
        if self.count:
            return pa.RecordBatch.from_arrays([pa.array([self.pairs]), pa.nulls(1, schema.field(1).type), pa.array([float(self.scored)])], schema=schema)
        place, value, (docs,) = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(self.row[place]), pa.array(docs.tolist(), schema.field(1).type), pa.array(-value)], schema=schema)


def term_counts(rows: DataFrame, text: str) -> DataFrame:
    """_id, term, tf of the words of each row of ``rows`` (_id, text), counted where the row is: no single word of a text is a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, words = (c.slice(at, BLOCK) for c in batch.columns)
                sizes, coded = words.value_lengths().to_numpy(), words.flatten().dictionary_encode()
                n = max(len(coded.dictionary), 1)
                pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(pair, n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(tf)], names=["_id", "term", "tf"])

    schema = T.StructType([rows.schema["_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.select("_id", tokens(F.col(text))).mapInArrow(count, schema)


def _weighed(queries: DataFrame, documents: DataFrame, k: int, query: str, doc: str, text: str, most_share: float, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """The queries (_q, _k), and _q, _d, score of the best that each cell found."""

    def terms(df: DataFrame, key: str) -> DataFrame:
        found = term_counts(spread(df.select(F.col(key).alias("_id"), text), "_id"), text)
        once = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
        return found if once else found.groupBy("_id", "term").agg(F.sum("tf").alias("tf"))

    d = stored(terms(documents, doc), "tfidf-terms")
    n = documents.agg(F.count(F.lit(1)).cast("double").alias("N"))
    df = d.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)  # single-row scalar
    idf = df.where(F.col("df") <= most_share * F.col("N")).select("term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))
    asked = terms(queries, query)
    known = stored(idf.join(asked.select(F.col("term").alias("_asked")).distinct(), F.col("term") == F.col("_asked"), "left").withColumn("_t", F.when(F.col("_asked").isNotNull(), F.monotonically_increasing_id())).drop("_asked"), "tfidf-idf")

    def vectors(postings: DataFrame) -> DataFrame:
        """_id, _norm, _heaviest, _terms, _weights (of terms that queries have, over the norm of all; the heaviest of them), each text's terms in order."""
        w = postings.join(known, "term").select("_id", "_t", (F.col("tf") * F.col("idf")).alias("w"))
        per = w.groupBy("_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"), F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "w")))).alias("_all"))
        heaviest = F.array_max(F.transform("_all", lambda x: F.struct(x["w"].alias("w"), x["_t"].alias("t"))))["t"].alias("_heaviest")
        return per.select("_id", "_norm", heaviest, F.col("_all._t").alias("_terms"), F.transform("_all", lambda x: x["w"] / F.col("_norm")).alias("_weights")).where(F.size("_terms") > 0)

    q = stored(vectors(asked).withColumn("_q", F.monotonically_increasing_id()), "tfidf-queries")
    rows = stored(vectors(d), "tfidf-documents")
    kinds = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_d", rows.schema["_id"].dataType), T.StructField("score", T.DoubleType())])
    grid = cells(rows.select(F.col("_id").alias("_d"), "_heaviest", "_norm", "_terms", "_weights"), q.select("_q", "_terms", "_weights"), rows.count(), q.count(), ("_heaviest", "_norm"))
    return q.select("_q", F.col("_id").alias("_k")), streamed(grid, lambda asks: _Scored(asks, k, kinds, count), kinds)


def tfidf_top(queries: DataFrame, documents: DataFrame, k: int = 5, query: str = "query_id", doc: str = "doc_id", text: str = "text", most_share: float = 1.0) -> DataFrame:
    """query, doc, score, rank: the ``k`` documents of the largest TF-IDF cosine, among those that share a term with a query.

    Terms in more than ``most_share`` of the documents may be left out. idf = ln((1 + N) / (1 + df)) + 1.
    A document's words are counted once, weighted, and kept as one row of those terms that queries have.
    Documents then meet queries in a grid of cells, those with one heaviest term together: the largest weight of each term in a block
    of documents bounds their scores, and queries that it can't help any more leave the block out.
    """
    q, found = _weighed(queries, documents, k, query, doc, text, most_share)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_d"))).where(F.col("rank") <= k)
    return ranked.join(q, "_q").select(F.col("_k").alias(query), F.col("_d").alias(doc), "score", "rank")


def tfidf_pairs(queries: DataFrame, documents: DataFrame, k: int = 5, query: str = "query_id", doc: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """Pairs of a query and a document that the search meets, and those that it scores."""
    met = _weighed(queries, documents, k, query, doc, text, 1.0, count=True)[1].agg(F.sum("_q"), F.sum("score")).collect()[0]
    return int(met[0] or 0), int(met[1] or 0)


def clause_split(pages: DataFrame, doc: str = "doc", section: str = "section", page: str = "page", text: str = "text", heading: int = 120, most: int = 4000, wanted: Sequence[str] | None = None) -> DataFrame:
    """doc, section, clause_id, heading, text, page: clauses of a section's pages, split at numbered line starts.

    Only numbers of the section itself (``6.2`` in section 6) begin a clause; a section without any is
    one clause. A clause goes on over pages until the next number; its page is the one on which it
    begins. Each page is split by itself and its pieces get clause numbers from sums over small rows,
    so no section is gathered; of a clause no more pieces are than ``most`` characters can take.
    """
    number = F.concat(F.lit("(?md)^[ \\t]*("), F.regexp_replace(F.col(section).cast("string"), r"\.", r"\\\\."), F.lit(r"\.\d{1,2})\s+"))
    cut = pages.select(doc, section, F.col(page).alias("_p"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.xxhash64(text).alias("_h"))
    cut = cut.select(doc, section, "_p", "_h", F.regexp_extract_all("_t", number, F.lit(1)).alias("_ids"), F.split("_t", number).alias("_parts"))
    # Clauses before each page of its section: a sum over one small row a page.
    light = cut.select(doc, section, "_p", "_h", F.size("_ids").alias("_n"))
    rows = Window.partitionBy(doc, section).orderBy("_p", "_h")
    light = light.groupBy(doc, section, "_p", "_h").agg(F.max("_n").alias("_n"))  # equal pages share their clauses
    before = light.select(doc, section, "_p", "_h", F.coalesce(F.sum("_n").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(doc, section)).alias("_all"))
    b = before.toDF("_doc", "_section", "_bp", "_bh", "_before", "_all")
    met = cut.join(b, F.col(doc).eqNullSafe(F.col("_doc")) & F.col(section).eqNullSafe(F.col("_section")) & F.col("_p").eqNullSafe(F.col("_bp")) & (F.col("_h") == F.col("_bh")))
    pieces = met.select(doc, section, "_p", "_h", "_ids", "_before", "_all", F.posexplode("_parts").alias("_i", "_piece"))
    clause = (F.col("_before") + F.col("_i")).alias("_clause")
    pieces = pieces.select(doc, section, "_p", "_h", "_i", "_all", clause, F.when(F.col("_i") > 0, F.get("_ids", F.col("_i") - 1)).alias("_id"), F.substring("_piece", 1, most + 200).alias("_piece"))
    pieces = pieces.where((F.col("_clause") > 0) | (F.col("_all") == 0)).where((F.col("_i") > 0) | (F.col("_piece") != ""))
    order = Window.partitionBy(doc, section, "_clause").orderBy("_p", "_i", "_h")
    kept = pieces.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most + 200)
    gathered = kept.groupBy(doc, section, "_clause").agg(F.array_sort(F.collect_list(F.struct("_p", "_i", "_h", "_piece"))).alias("_ps"), F.max("_id").alias("_id"))
    body = F.trim(F.array_join(F.transform("_ps", lambda x: x["_piece"]), "\n"))
    out = gathered.select(doc, section, F.coalesce("_id", F.col(section).cast("string")).alias("clause_id"), body.alias("_b"), F.col("_ps")[0]["_p"].alias("page"))
    out = out.select(doc, section, "clause_id", F.substring(F.split("_b", "\n")[0], 1, heading).alias("heading"), F.substring("_b", 1, most).alias("text"), "page")
    return out.where(F.col("clause_id").isin(*wanted)) if wanted else out
