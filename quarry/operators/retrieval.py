"""Ranked retrieval for many queries at once: BM25, cosine, rank fusion, boosts, demotion, selection.

Corpora and queries are DataFrames; every result is keyed by qid and every ranking ends with the id as tie-break.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quarry.functions.stemming import stemmed
from quarry.tables import sorted_join, written

K1, B, RRF_K = 1.2, 0.75, 60
#: Query vectors are met with all rows in blocks of about this many.
QUERY_BLOCK = 8192
#: Terms of the queries that meet the corpus together, and documents that are scored together.
TERM_ENTRIES, SCORED_ROWS = 1 << 22, 256
#: Products of a posting and a query that are held at once, and queries that documents are scored for at once.
PRODUCTS, STRIP = 1 << 20, 2048
#: Terms of a block that may be dense, and the least share of pairs of a document and a query that such a term meets in.
#: Sums in single precision of so many terms are off by a share of less than SLACK.
DENSE_TERMS, DENSE_SHARE, SLACK = 1024, 1 / 256, 2**-12
#: Rows that wait until a task's best are sorted out.
CANDIDATES = 1 << 19
#: In a corpus of more than FLOOR_ROWS rows, one of FEW is scored first, FEW_ROWS in a task.
FLOOR_ROWS, FEW, FEW_ROWS = 1 << 16, 16, 1 << 14
#: Rows of a vector cluster on average, and clusters at most.
CLUSTER, CENTRES = 64, 256
# Priors of clause kinds by intent, and topics that a question may name.
INTENT_KIND_PRIORS = {
    "discover": {"scope": 0.012, "front": 0.004, "list": 0.010, "faq": 0.004},
    "applicability": {"scope": 0.010, "list": 0.010, "requirement": 0.004},
    "requirements": {"requirement": 0.010, "test_method": 0.010, "table": 0.006, "marking": 0.004, "packing": 0.003, "sampling": 0.003},
    "define": {"terminology": 0.014, "faq": 0.006},
    "summarize": {"scope": 0.010, "foreword": 0.006, "requirement": 0.003},
    "compare": {"scope": 0.004, "requirement": 0.004, "table": 0.004},
}
TOPIC_BOOST, NUMBER_BOOST, MENTION_BOOST = 0.015, 0.02, 0.02
TOPIC_KINDS = {
    "marking": r"(?i)\b(mark|marked|marking|markings|label|labelled|labeled|labelling|labeling)\b",
    "packing": r"(?i)\b(pack|packed|packing|packaging|bundles?)\b",
    "sampling": r"(?i)\b(sample|samples|sampling)\b",
    "test_method": r"(?i)\b(test method|tested|how to test|testing method)\b",
    "terminology": r"(?i)\b(definition|define|meaning|what does .+ mean)\b",
}


def tokens(text: Column, stem: bool = False) -> Column:
    """Lower-cased runs of letters and digits; with stem, without marks and English suffixes."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return stemmed(found) if stem else found


def frequencies(columns: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token hash, frequency), in order, of columns given as (document, token hash, weight of the column)."""
    doc, token = (np.concatenate([c[i] for c in columns]) for i in (0, 1))
    worth = np.concatenate([np.full(len(c[0]), float(c[2])) for c in columns])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))[: len(doc)])
    return doc[first], token[first], np.add.reduceat(worth[order], first) if len(first) else worth


def _packed(values: np.ndarray, ends: np.ndarray):
    """An Arrow column of the bytes of values, cut at ends."""
    import pyarrow as pa

    cuts = np.concatenate([[0], ends]).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of an Arrow column of packed values."""
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]].view(kind) if len(column) else np.zeros(0, kind)
    return np.repeat(np.arange(len(column)), np.diff(cuts) // np.dtype(kind).itemsize), values


def hashed(corpus: DataFrame, id_col: str, columns: dict[str, float], stem: bool = False) -> DataFrame:
    """(id, length, hashes, tf, key), written: a document's number of tokens and its distinct tokens as 64-bit hashes, in
    order and packed, with their frequencies weighted by column. Documents of one key differ in nothing but their id."""
    found = [F.transform(tokens(F.col(c), stem), lambda x: F.xxhash64(x)).alias(f"c{i}") for i, c in enumerate(columns)]
    given, weights = corpus.select(id_col, *found), list(columns.values())
    schema = StructType([given.schema[id_col], StructField("length", LongType()), StructField("hashes", BinaryType()), StructField("tf", BinaryType())])
    arrow = to_arrow_schema(schema)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                parts, length = [], np.zeros(part.num_rows, np.int64)
                for lists, weight in zip(part.columns[1:], weights, strict=True):
                    size = np.diff(lists.offsets.to_numpy())
                    parts.append((np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy(), weight))
                    length += size
                doc, token, tf = frequencies(parts)
                ends = np.cumsum(np.bincount(doc, minlength=part.num_rows))
                made = [part.column(0).cast(arrow.field(0).type), pa.array(length), _packed(token, ends), _packed(tf, ends)]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    key = F.md5(F.concat("hashes", "tf", F.col("length").cast("string").cast("binary")))
    return written(given.mapInArrow(count, schema).withColumn("key", key), "hashed-tokens")


def ranked(scores: DataFrame, k: int, id_col: str, digits: int = 9) -> DataFrame:
    """The k best rows of each qid, with their rank from 1. Scores that are equal to so many digits tie."""
    order = Window.partitionBy("qid").orderBy(F.round("score", digits).desc(), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighted_terms(corpus: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, key, hashes, weights) of queries (qid, terms) over a hashed() corpus: the terms that it holds, in order, with
    their inverse document frequencies. A term in most documents weighs 1e-6. Queries of one key have the same terms."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            h, n = np.unique(_unpacked(batch.column(0), np.int64)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    asked = F.transform(stemmed(F.col("terms")) if stem else F.col("terms"), lambda x: F.xxhash64(x))
    wanted = queries.select("qid", F.explode(F.array_distinct(asked)).alias("h"))
    df = corpus.select("hashes").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    size = corpus.agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(size)).select("h", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("w"))
    pairs = wanted.join(weights, "h").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("all"))
    parts = pairs.select("qid", F.transform("all", lambda x: x["h"]).alias("hashes"), F.transform("all", lambda x: x["w"]).alias("weights"))
    return parts.select("qid", F.md5(F.array_join(F.col("hashes").cast("array<string>"), ",")).alias("key"), "hashes", "weights")


class TermBlock:
    """Queries of a block as a matrix: sorted distinct terms, and for each its weight and the queries that ask it.

    A term weighs the same in every query. Terms that many documents have and many queries ask are dense: they meet as a
    product of matrices in single precision, whose sums are made exact where they matter. All others meet posting by
    posting.
    """

    def __init__(self, hashes: list[np.ndarray], weights: list[np.ndarray]):
        term = np.concatenate(hashes)
        query = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        order = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[order], return_index=True)
        self.first, self.weight = np.append(first, len(term)), np.concatenate(weights)[order][first]
        self.query, self.queries = query[order], len(hashes)

    @cached_property
    def strips(self) -> tuple[np.ndarray, list[tuple]]:
        """The place of each term among the dense ones or -1, and for each STRIP of queries how often they ask a dense
        term (queries, dense terms), and the other terms' first entries and queries."""
        asked = np.diff(self.first)
        # A weight tells the share of documents that have the term; 1e-6 stands for more than half.
        met = asked / self.queries / (1 + np.exp(self.weight))
        dense = np.flatnonzero(met >= DENSE_SHARE)
        dense = np.sort(dense[np.argsort(-met[dense], kind="stable")[:DENSE_TERMS]])
        slot = np.full(len(self.terms), -1)
        slot[dense] = np.arange(len(dense))
        column, out = np.repeat(slot, asked), []
        for start in range(0, self.queries, STRIP):
            own = (self.query >= start) & (self.query < start + STRIP)
            full, rest = own & (column >= 0), own & (column < 0)
            matrix = np.zeros((min(STRIP, self.queries - start), len(dense)), np.float32)
            np.add.at(matrix, (self.query[full] - start, column[full]), 1)
            out.append((start, matrix, np.append(0, np.cumsum(rest))[self.first], self.query[rest] - start))
        return slot, out

    def sums(self, doc: np.ndarray, token: np.ndarray, part: np.ndarray, rows: int) -> Iterator[tuple]:
        """(first query, sums, exact) of each strip: (rows, queries) sums of part times weight over postings in order of
        document, off by less than a share of SLACK, and what gives the exact sums of cells (rows, queries).

        Postings of other than dense terms meet their queries in pieces of about PRODUCTS.
        """
        slot, strips = self.strips
        at = np.minimum(np.searchsorted(self.terms, token), len(self.terms) - 1)
        met = self.terms[at] == token
        doc, at = doc[met], at[met]
        part, column = part[met] * self.weight[at], slot[at]
        full, rest = column >= 0, column < 0
        common = np.zeros((rows, strips[0][1].shape[1]))
        common[doc[full], column[full]] = part[full]
        single, doc, at, part = common.astype(np.float32), doc[rest], at[rest], part[rest]
        for begin, matrix, first, query in strips:
            near = single @ matrix.T
            out, wide, low = near.astype(float), near.shape[1], first[at]
            asked = first[at + 1] - low
            some = np.flatnonzero(asked)
            low, asked, cell, worth = low[some], asked[some], doc[some] * wide, part[some]
            ends, start = np.cumsum(asked), 0
            while start < len(some):
                done = ends[start] - asked[start]
                stop = max(start + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
                # Each posting meets the queries of its term.
                n = asked[start:stop]
                place = np.repeat(low[start:stop] - (ends[start:stop] - n - done), n)
                place += np.arange(len(place))
                where = np.repeat(cell[start:stop], n)
                where += query[place]
                np.add.at(out.reshape(-1), where, np.repeat(worth[start:stop], n))
                start = stop

            def exact(row, of, near=near, out=out, matrix=matrix):
                sums = out[row, of] - near[row, of]
                step = max(1, PRODUCTS // (matrix.shape[1] + 1))
                for i in range(0, len(sums), step):
                    sums[i : i + step] += np.einsum("ij,ij->i", common[row[i : i + step]], matrix[of[i : i + step]])
                return sums

            yield begin, out, exact

    def scores(self, columns: list[tuple[np.ndarray, np.ndarray, float]], rows: int, mean: float) -> np.ndarray:
        """(rows, queries): BM25 of documents given by column as (document, token hash, weight of the column)."""
        length = sum((np.bincount(doc, minlength=rows) for doc, _, _ in columns), np.zeros(rows))
        doc, token, tf = frequencies(columns)
        found = self.sums(doc, token, impact(tf, length[doc], mean), rows)
        return np.hstack([exact(*map(np.ravel, np.indices(near.shape))).reshape(near.shape) for _, near, exact in found])


def impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What BM25 multiplies a term's weight with, in documents of these lengths."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Best:
    """The k best documents of every query of a block: by score to six digits, then by their first column, the id. floors:
    scores, to six digits, that k documents are known to reach."""

    def __init__(self, queries: int, k: int, columns, floors: np.ndarray | None = None):
        import pyarrow as pa

        self.k, self.floors = k, np.full(queries, -np.inf) if floors is None else floors.copy()
        self.schema = pa.schema([("query", pa.int64()), ("near", pa.float64()), *columns, ("score", pa.float64())])
        self.held, self.new, self.waiting = self.schema.empty_table(), [], 0

    def add(self, first: int, near: np.ndarray, exact, documents) -> None:
        """Sums of documents by queries from the first on, as TermBlock gives them; documents: their Arrow columns."""
        import pyarrow as pa

        least = np.maximum(self.floors[first : first + near.shape[1]] - 1e-6, np.finfo(float).tiny)
        row, query = np.divmod(np.flatnonzero(near >= least * (1 - SLACK)), near.shape[1])
        if len(row):
            found, at = exact(row, query), pa.array(row)
            own = [c.take(at).cast(self.schema.field(i).type) for i, c in enumerate(documents, 2)]
            made = [pa.array(query + first), pa.array(np.round(found, 6)), *own, pa.array(found)]
            self.new.append(pa.RecordBatch.from_arrays(made, schema=self.schema))
            self.waiting += len(row)
            if self.waiting >= CANDIDATES:
                self.kept()

    def kept(self):
        """The best of all that was added, an Arrow table (query, near, the documents' columns, score)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.concat_tables([self.held, pa.Table.from_batches(self.new, self.schema)])
        keys = [("query", "ascending"), ("near", "descending"), (self.schema.field(2).name, "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        query, near = table["query"].to_numpy(), table["near"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floors[query[last]] = np.maximum(self.floors[query[last]], near[last])
        self.held, self.new, self.waiting = table.filter(pa.array(place < self.k)), [], 0
        return self.held


def _best_of_tasks(block: TermBlock, qids, floors: np.ndarray | None, mean: float, k: int, schema):
    """The task that keeps, of documents (length, hashes, tf, id, ..) as hashed() has them, the k best of every query."""

    def run(batches):
        import pyarrow as pa

        best = Best(block.queries, k, list(schema)[1:-1], floors)
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                (doc, token), (_, tf) = _unpacked(part.column(1), np.int64), _unpacked(part.column(2), float)
                length = part.column(0).to_numpy()
                for first, near, exact in block.sums(doc, token, impact(tf, length[doc], mean), part.num_rows):
                    best.add(first, near, exact, part.columns[3:])
        kept = best.kept()
        out = pa.Table.from_arrays([qids.take(kept["query"]), *kept.columns[2:]], schema=schema)
        yield from out.to_batches(max_chunksize=1 << 16)

    return run


def bm25(
    corpus: DataFrame, queries: DataFrame, columns: dict[str, float], k: int = 40, id_col: str = "doc_id", stem: bool = False
) -> DataFrame:
    """(qid, id, score, rank) of the k best documents for the terms (array) of each query, any term matching.

    Terms are as tokens() gives them; with stem they and the documents' words are stemmed, and marks on letters don't
    count. Frequencies are weighted by column, lengths aren't. A term in most documents scores 1e-6.

    The corpus is tokenised once, into hashes of 64 bits that stand for terms. Document frequencies are the only thing
    that is counted across tasks by term. Queries then meet the corpus in blocks of TERM_ENTRIES terms at most, or one
    query: each task has a block as a matrix, dense for frequent terms, multiplies its documents with it, and keeps k of
    them a query, so that no posting is shuffled and a term in most documents is nobody's hot key. In a large corpus one
    document of FEW is scored first: the k-th best of these is a floor for the rest, of which no worse one leaves a task.

    Queries of the same terms are scored once. So are documents of the same tokens if they are half of the corpus or more;
    for each of them its first k ids take part in the end.
    """
    found = hashed(corpus, id_col, columns, stem)
    asked = written(weighted_terms(found, queries, stem), "query-terms")
    n, mean, unlike = found.agg(F.count("*"), F.avg("length"), F.count_distinct("key")).first()
    copies, docs = 2 * unlike <= n, found
    if copies:
        own = [F.first(c).alias(c) for c in ("length", "hashes", "tf")]
        docs = written(found.groupBy("key").agg(F.min(F.struct(id_col))[id_col].alias(id_col), *own), "distinct-tokens")
        n = unlike
    docs = docs.select("length", "hashes", "tf", id_col, *(["key"] if copies else []))
    lone = asked.select(F.col("key").alias("qid"), "hashes", "weights").dropDuplicates(["qid"])
    entries = lone.agg(F.sum(F.size("hashes"))).first()[0] or 0
    blocks, parts = max(1, -(-entries // TERM_ENTRIES)), []
    schema = StructType([StructField("qid", StringType()), *docs.schema.fields[3:], StructField("score", DoubleType())])
    few = F.pmod(F.xxhash64(id_col), F.lit(FEW)) == 0
    for i in range(blocks):
        rows = lone.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        qids, lists = rows["qid"].combine_chunks(), [rows[c].combine_chunks() for c in ("hashes", "weights")]
        block = TermBlock(*[np.split(x.flatten().to_numpy(), np.diff(x.offsets.to_numpy()).cumsum()[:-1]) for x in lists])
        search = lambda some, floors, block=block, qids=qids: some.mapInArrow(_best_of_tasks(block, qids, floors, mean, k, to_arrow_schema(schema)), schema)
        if n <= FLOOR_ROWS:
            parts.append(search(docs, None))
            continue
        first = search(docs.where(few).repartition(-(-n // (FEW * FEW_ROWS))), None)
        first = written(ranked(first, k, id_col, 6), "first-best")
        known = {r.qid: r.near for r in first.where(F.col("rank") == k).select("qid", F.round("score", 6).alias("near")).collect()}
        floors = np.array([known.get(q, -np.inf) for q in qids.to_pylist()])
        parts += [first.drop("rank"), search(docs.where(~few), floors)]
    if not parts:
        parts = [corpus.sparkSession.createDataFrame([], schema)]
    best = ranked(reduce(DataFrame.unionAll, parts), k, id_col, 6)
    if copies:
        place = F.row_number().over(Window.partitionBy("key").orderBy(id_col))
        alike = found.select("key", id_col).withColumn("place", place).where(F.col("place") <= k)
        best = ranked(best.drop(id_col, "rank").join(sorted_join(alike), "key"), k, id_col, 6)
    own = asked.select(F.col("key").alias("terms"), F.col("qid").alias("asked"))
    best = best.join(own, F.col("qid") == F.col("terms"))
    return best.select(F.col("asked").alias("qid"), id_col, "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


def _vectors(column) -> np.ndarray:
    """An Arrow column of arrays of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the rows of a and those of b; a zero vector is at a right angle to all."""
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.arccos(np.clip(np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0), -1, 1))


def clustered(corpus: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, np.ndarray]:
    """(cluster, angle, id, vector) of every row with a vector, written in this order, and the clusters' centres.

    Centres are rows drawn by a hash of the id, one for CLUSTER rows and CENTRES at most; a row belongs to the centre of
    the least angle. Rows are dealt by ranges, so a large cluster lies in many tasks.
    """
    given = corpus.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    wanted = max(1, min(CENTRES, given.count() // CLUSTER))
    drawn = given.select("vector").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    centres = np.array([r.vector for r in drawn], float)
    schema = StructType([StructField("cluster", IntegerType()), StructField("angle", DoubleType()), *given.schema.fields])
    arrow = to_arrow_schema(schema)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                far = _angles(_vectors(batch.column(1)), centres)
                near = far.argmin(axis=1)
                made = [pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays([*made, *[c.cast(f.type) for c, f in zip(batch.columns, list(arrow)[2:], strict=True)]], schema=arrow)

    order = ["cluster", "angle", F.xxhash64("id")]
    return written(given.mapInArrow(assign, schema).repartitionByRange(*order).sortWithinPartitions(*order), "clustered-vectors"), centres


def reach(queries: np.ndarray, far: np.ndarray, rows: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The greatest product that each query can have with rows of one cluster. far: the queries' angles to its centre,
    angles: the rows'. By the triangle inequality a query is off a row by at least the difference of their angles."""
    least = np.maximum(0, np.maximum(far - angles.max(), angles.min() - far))
    sizes = np.linalg.norm(rows, axis=1)
    bound = np.cos(np.minimum(least, np.pi)) * np.linalg.norm(queries, axis=1)
    return np.maximum(bound * sizes.max(), bound * sizes.min())


def _near_tasks(queries: np.ndarray, qids: list, centres: np.ndarray, floors: np.ndarray, k: int, own: bool, schema):
    """The task that keeps k rows a query of those that can still reach its floor; with own, of each query's own cluster.

    A slice of rows of one cluster is met by the queries whose bound isn't below the floor, which rises as the task goes
    on. The last row says how many products were taken (scored)."""
    far = _angles(queries, centres)
    home = far.argmin(axis=1)

    def run(batches):
        import pyarrow as pa

        held: list[list[tuple]] = [[] for _ in qids]
        floor, scored = floors.copy(), 0
        order = lambda x: (-x[0], x[1] is not None, x[1])
        for batch in batches:
            clusters = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(clusters)) + 1
            for begin, stop in zip([0, *cuts], [*cuts, len(clusters)], strict=True):
                for start in range(begin, stop, SCORED_ROWS):
                    part = batch.slice(start, min(SCORED_ROWS, stop - start))
                    if not part.num_rows:
                        continue
                    cluster, rows = clusters[start], _vectors(part.column(3))
                    able = home == cluster if own else reach(queries, far[:, cluster], rows, part.column(1).to_numpy()) >= floor - 1e-9
                    some = np.flatnonzero(able)
                    if not len(some):
                        continue
                    raw, keys = rows @ queries[some].T, part.column(2).to_pylist()
                    scored += raw.size
                    near = np.round(raw, 9)
                    for j in np.flatnonzero((near >= floor[some] - 1e-9).any(axis=0)):
                        q, hits = some[j], np.flatnonzero(near[:, j] >= floor[some[j]] - 1e-9)
                        if len(hits) > k:
                            hits = hits[near[hits, j] >= np.partition(near[hits, j], -k)[-k]]
                        held[q] = sorted(held[q] + [(near[i, j], keys[i], raw[i, j]) for i in hits], key=order)[:k]
                        if len(held[q]) == k:
                            floor[q] = max(floor[q], held[q][-1][0])
        out = [(qids[q], key, float(score), None) for q, best in enumerate(held) for _, key, score in best]
        for start in range(0, len(out) + 1, 1 << 16):
            rows = out[start : start + (1 << 16)] + ([(None, None, None, scored)] if start + (1 << 16) > len(out) else [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def cosine_scored(corpus: DataFrame, queries: DataFrame, k: int = 40, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, id, score, scored): the k best rows of each query and task; a row a task says how many products it took."""
    table, centres = clustered(corpus, id_col, vector)
    asked = queries.where(F.col("vector").isNotNull()).select("qid", "vector")
    schema = StructType([asked.schema["qid"], StructField(id_col, corpus.schema[id_col].dataType), StructField("score", DoubleType()), StructField("scored", LongType())])
    arrow, found = to_arrow_schema(schema), None
    blocks = max(1, -(-asked.count() // QUERY_BLOCK)) if len(centres) else 0
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        given, qids = np.array([r.vector for r in rows], float), list(range(len(rows)))
        # First each query's own cluster: its k-th best there is a floor for the whole table.
        places = StructType([StructField("qid", LongType()), *schema.fields[1:]])
        none = np.full(len(rows), -np.inf)
        first = table.mapInArrow(_near_tasks(given, qids, centres, none, k, True, to_arrow_schema(places)), places).where("qid is not null")
        last = ranked(first, k, id_col).where(F.col("rank") == k).select("qid", "score").collect()
        floors = none.copy()
        for r in last:
            floors[r.qid] = round(r.score, 9)
        part = table.mapInArrow(_near_tasks(given, [r.qid for r in rows], centres, floors, k, False, arrow), schema)
        found = part if found is None else found.unionAll(part)
    return corpus.sparkSession.createDataFrame([], schema) if found is None else found


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 40, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank) of the k rows of the greatest product with each query (qid, vector), equal to nine digits
    by id; exact for vectors of any length, and best pruned for unit ones. Rows and queries without a vector are left out.

    Rows are clustered around CENTRES rows at most. Queries are a stated set, met in blocks of about QUERY_BLOCK: the
    k-th best row of a query's own cluster is its floor, and rows whose bound by the triangle inequality is below the
    floor are never scored. Each task keeps k rows a query before anything is shuffled. qids are distinct.
    """
    found = cosine_scored(corpus, queries, k, id_col, vector).where("scored is null").drop("scored")
    return ranked(found, k, id_col)


def rrf(*lists: DataFrame, id_col: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(qid, id, score): reciprocal ranks of all lists (qid, id, rank) summed."""
    both = None
    for one in lists:
        part = one.select("qid", id_col, (1.0 / (k + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("qid", id_col).agg(F.sum("part").alias("score"))


def kind_prior(intent: Column, kind: Column) -> Column:
    flat = {f"{i} {c}": v for i, kinds in INTENT_KIND_PRIORS.items() for c, v in kinds.items()}
    table = F.create_map(*[F.lit(x) for pair in flat.items() for x in pair])
    return F.coalesce(F.element_at(table, F.concat_ws(" ", intent, kind)), F.lit(0.0))


def topic_kinds(query: Column) -> Column:
    """Kinds of clauses that a question names."""
    return F.filter(F.array(*[F.when(query.rlike(p), k) for k, p in TOPIC_KINDS.items()]), lambda x: x.isNotNull())


def boosted(fused: DataFrame, intent: Column, kind: Column, topics: Column, explicit: Column) -> DataFrame:
    """Adds kind_boost (a named topic replaces the intent's prior), number_boost and total."""
    boost = F.when(F.array_contains(topics, kind), TOPIC_BOOST).otherwise(kind_prior(intent, kind))
    number = F.when(F.coalesce(explicit, F.lit(False)), NUMBER_BOOST).otherwise(0.0)
    out = fused.withColumn("kind_boost", boost).withColumn("number_boost", number)
    return out.withColumn("total", F.col("score") + F.col("kind_boost") + F.col("number_boost"))


def demoted(candidates: DataFrame, stray: Column, first: int = 3) -> DataFrame:
    """Positions with all stray rows but the first few moved to the end, order kept otherwise (qid, pos)."""
    order = Window.partitionBy("qid").orderBy("pos")
    seen = F.sum(F.when(stray, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    late = (stray & (seen > first)).cast("int")
    moved = candidates.withColumn("__late", late)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("__late", "pos"))
    return moved.withColumn("pos", place).drop("__late")


def passage_text(number: Column, title: Column, clause: Column, heading: Column, text: Column, most: int = 700) -> Column:
    """What a reranker reads of a passage: where it stands and its text, cut to `most` characters."""
    place = F.concat(F.coalesce(number, F.lit("")), F.lit(" "), title, F.lit(" — "), clause, F.lit(" "), F.coalesce(heading, F.lit("")))
    return F.left(F.concat(F.trim(place), F.lit("\n"), text), F.lit(most))


def reranked_head(candidates: DataFrame, rerank: Column, boost: Column, head: int = 16) -> DataFrame:
    """The first `head` positions sorted by rerank score plus 20 times the boost; the tail stays."""
    order = Window.partitionBy("qid").orderBy(
        (F.col("pos") > head).cast("int"), F.when(F.col("pos") <= head, rerank + 20 * boost).desc_nulls_last(), "pos"
    )
    return candidates.withColumn("new_pos", F.row_number().over(order)).drop("pos").withColumnRenamed("new_pos", "pos")


def stem(word: Column) -> Column:
    low = F.lower(word)
    return F.when((F.length(low) > 4) & low.endswith("s") & ~low.endswith("ss"), F.regexp_replace(low, "s$", "")).otherwise(low)


def diversified(
    candidates: DataFrame, per_group: int = 4, per_clause: int = 2, budget: int = 3000, k: int = 8, per_list: int = 3
) -> DataFrame:
    """(qid, id, cid): a query's candidates taken in order of pos, unless a cap or the budget forbids.

    At most k are taken, per_clause of one clause (list rows: per_list) and per_group of one group (list rows: any
    number); the token budget passes over what doesn't fit, but never the first one taken. candidates: qid, pos, id,
    grp, clause, is_list, n_words; a query's candidates are one ranked list of bounded length, folded in one row.
    """
    row = F.struct("pos", "id", "grp", "clause", "is_list", (F.floor(F.col("n_words") * F.lit(1.3)).cast("int") + 20).alias("cost"))
    lists = candidates.groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", 1, 0)

    def take(taken: Column, x: Column) -> Column:
        of_clause = F.size(F.filter(taken, lambda t: t["clause"].eqNullSafe(x["clause"])))
        of_group = F.size(F.filter(taken, lambda t: t["grp"].eqNullSafe(x["grp"])))
        spent = F.aggregate(taken, F.lit(0), lambda a, t: a + t["cost"])
        room = F.when(x["is_list"], of_clause < per_list).otherwise((of_clause < per_clause) & (of_group < per_group))
        fits = (F.size(taken) == 0) | (spent + x["cost"] <= budget)
        return F.when((F.size(taken) < k) & room & fits, F.concat(taken, F.array(x))).otherwise(taken)

    picked = lists.select("qid", F.posexplode(F.aggregate("rows", none, take)).alias("at", "row"))
    return picked.select("qid", F.col("row.id").alias("id"), (F.col("at") + 1).alias("cid"))


def product_score(product: Column, question: Column, expansion: Column, context: Column) -> Column:
    """How well the words of a product name (stems) are covered by a question's words: 0 (no match) or more."""
    orig = F.array_intersect(product, question)
    words, asked = F.size(product), F.size(question)
    cover = F.size(orig) / F.greatest(asked, F.lit(1))
    missing = F.array_except(question, product)
    extra = F.size(F.array_intersect(product, expansion))
    by_words = F.when((asked > 0) & (cover >= 0.7), cover + 0.5 * F.size(orig) / F.greatest(words, F.lit(1)))
    by_context = F.when(
        (F.size(orig) > 0) & (F.size(F.array_except(missing, context)) == 0), 0.6 + 0.1 * F.size(orig) / F.greatest(words, F.lit(1))
    )
    by_extra = F.when(extra >= 3, 0.5 + 0.1 * extra)
    return F.coalesce(by_words, by_context, by_extra, F.lit(0.0))


def trimmed_rows(text: Column, words: Column) -> Column:
    """A table text cut to its header lines and the rows that contain a word; unchanged if no row does."""
    lines = F.split(text, "\n")
    hit = lambda x: F.exists(words, lambda w: F.lower(x).contains(w))
    rows = F.filter(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), hit)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 2), rows), "\n")).otherwise(text)


def grouped_best(ranked_rows: DataFrame, group: str, id_col: str = "doc_id") -> DataFrame:
    """(qid, group, best, ids, first_id): best score of each group, its ids in rank order and the first of them."""
    return ranked_rows.groupBy("qid", group).agg(
        F.max("score").alias("best"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", id_col))), lambda x: x[id_col]).alias("ids"),
        F.min_by(id_col, "rank").alias("first_id"),
    )


def centroids(vectors: DataFrame, group: str, order: str, first: int = 3, vector: str = "embedding") -> DataFrame:
    """(group, centroid): mean of the first vectors of each group, dimension by dimension."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    few = vectors.withColumn("__n", place).where(F.col("__n") <= first)
    dims = few.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda d: d["x"]).alias("centroid"))


def related(means: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, other, score): the k nearest centroids of each group. There are as few centroids as groups."""
    a = means.select(F.col(group).alias("qid"), normalized(F.col("centroid")).alias("vector"))
    b = means.select(F.col(group).alias("other"), normalized(F.col("centroid")).alias("embedding"))
    near = cosine_topk(b, a, k + 1, "other").where(F.col("qid") != F.col("other"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "other"))
    return near.withColumn("rank", place).where(F.col("rank") <= k)

