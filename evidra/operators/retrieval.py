"""Lexical and dense retrieval, fusion, reranking, traces and index checks.

Ranked lists are kept long: ``query_id, id, rank, score``. Every ranking has a total order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions.text import BM25_WORD, bm25_tokens, chunk_to_doc
from evidra.lineage import cut, keep, ship_package

K1, B, EPSILON = 1.5, 0.75, 0.25


# ---- ranks -------------------------------------------------------------------------------------
def top_k(scored: DataFrame, k: int, ties: list[Column] | None = None) -> DataFrame:
    """1-based ranks of the ``k`` best per query, by score, then ``ties`` (default: id)."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *(ties or [F.col("id").asc()]))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked.filter(F.col("rank") <= k) if k > 0 else ranked).select("query_id", "id", "rank", "score")


# ---- BM25 --------------------------------------------------------------------------------------
def bm25_index(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted postings ``term, id, weight`` and term statistics ``term, df, idf`` of a corpus
    ``id, text``. A term in more than half the documents gets a share of the mean idf instead of
    a negative one. Weights are stored, so that a search is one join and one sum."""
    words = corpus.select("id", bm25_tokens(F.col("text")).alias("terms"))
    sizes = corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.coalesce(F.regexp_count("text", F.lit(BM25_WORD)), F.lit(0))).alias("avgdl"))
    n_docs, avgdl = sizes.select("n_docs").scalar(), sizes.select("avgdl").scalar()
    tf = words.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = keep(tf)  # read for document frequencies, for their mean, and for the weights
    raw = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    idf = raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))
    norm = K1 * (1 - B + B * F.col("dl") / avgdl)
    weighted = tf.join(idf, "term").select("term", "id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("weight"))
    return weighted, idf


def bm25_scores(postings: DataFrame, queries: DataFrame, small: int = 200_000, salts: int = 16) -> DataFrame:
    """Scores of all documents that share a term with a query ``query_id, text``; repeated query
    words count repeatedly."""
    terms = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    if terms.count() <= small:
        # few query words meet the postings where they lie; what is shuffled is already summed
        joined = postings.join(F.broadcast(terms), "term")
    else:
        # frequent words have long postings: these are dealt out over salts, query words copied
        salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
        copies = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = postings.withColumn("salt", salt).join(copies, ["term", "salt"])
    return joined.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = 10, matches_only: bool = False, postings: DataFrame | None = None) -> DataFrame:
    """Best ``k`` per query. As a full score vector would, it fills up with documents of score
    zero, the least ids first; those are at most 2k known ids, so no query meets the corpus.
    ``postings``: those of a stored or shared index of the corpus."""
    if postings is None:
        postings, _ = bm25_index(corpus)
    scores = bm25_scores(postings, queries)
    best = top_k(scores, k)
    if matches_only:
        return best
    best = cut(best)  # k rows a query, read twice below
    have = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("id").alias("seen"))
    short = queries.select("query_id").distinct().join(have, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    least = [r["id"] for r in corpus.select("id").distinct().orderBy("id").limit(2 * k).collect()]
    kind = corpus.schema["id"].dataType
    pool = F.array(*[F.lit(x).cast(kind) for x in least]) if least else F.array().cast(f"array<{kind.simpleString()}>")
    none = F.array().cast(f"array<{kind.simpleString()}>")
    fill = short.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode(F.slice(F.array_except(pool, F.coalesce("seen", none)), F.lit(1), F.lit(k) - F.coalesce("n", F.lit(0)))).alias("pos", "id"))
    return best.unionByName(fill.select("query_id", "id", (F.col("n") + F.col("pos") + 1).cast("int").alias("rank"), F.lit(0.0).alias("score")))


# ---- dense -------------------------------------------------------------------------------------
def _best_of_batch(s: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a batch's scores ``rows x queries`` that hold each query's ``k`` best by
    rounded score, then by ``place``, a row's place in the order of ids. Whatever may round to the
    k-th score or above stays, but of equal scores only the ``k`` first in place."""
    n = len(s)
    edge = np.partition(s, n - k, axis=0)[n - k] if 0 < k < n else np.full(s.shape[1], -np.inf)
    row, col = np.nonzero(~(s < edge - 2e-9))
    value = s[row, col]
    order = np.lexsort((place[row], value, col))
    row, col, value = row[order], col[order], value[order]
    first = np.r_[True, (col[1:] != col[:-1]) | (value[1:] != value[:-1])]
    at = np.arange(len(row))
    keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return row[keep], col[keep]


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, drop_self: bool = True, block: int = 4096) -> DataFrame:
    """Exact inner-product top ``k``. ``vectors``: id, vector; ``queries``: query_id, vector. The
    stated query set is walked in blocks; a block is one matrix product per batch of vectors, of
    which each keeps its ``k`` best by the total order and those within rounding of the k-th, so what
    is shuffled is bounded by batches x queries x k for each distinct score at that edge."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind, asked = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    out = None
    part: list = []

    def block_of(rows: list) -> DataFrame:
        ids = [r["query_id"] for r in rows]
        shared = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in rows], dtype=np.float64).T))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["id"].to_numpy()
                place = np.empty(len(own), dtype=np.int64)
                place[pdf["id"].reset_index(drop=True).sort_values(kind="stable", na_position="first").index] = np.arange(len(own))
                same = pd.Series(own).groupby(own).indices if drop_self else {}
                x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                for a in range(0, len(names), 256):  # copies may all tie: few queries at a time
                    s = x @ q[:, a : a + 256]
                    for c, name in enumerate(names[a : a + 256]):
                        if name in same:
                            s[same[name], c] = -np.inf
                    row, col = _best_of_batch(s, place, k)
                    f = pd.DataFrame({"query_id": [names[a + c] for c in col], "id": own[row], "score": s[row, col]})
                    yield f[f["query_id"] != f["id"]] if drop_self else f

        return vectors.select("id", "vector").mapInPandas(score, f"query_id {asked}, id {kind}, score double")

    for row in queries.select("query_id", "vector").toLocalIterator():
        part.append(row)
        if len(part) == block:
            out, part = (block_of(part) if out is None else out.unionByName(block_of(part))), []
    if part or out is None:
        if not part:
            return spark.createDataFrame([], f"query_id {asked}, id {kind}, rank int, score double")
        out = block_of(part) if out is None else out.unionByName(block_of(part))
    return top_k(out, k)


def hashed_embedding(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding model: signed feature hashing of BM25 words."""
    import zlib

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = []
            for text in s:
                v = np.zeros(dims)
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
                rows.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
            yield pd.Series(rows)

    return embed


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def embed_texts(texts: DataFrame, encode: Encode, how: str = "mean", prompt: str = "", batch: int = 32) -> DataFrame:
    """``id, vector`` of ``id, text`` by a model: ``encode`` gives token states and a mask for a batch
    of texts, which are pooled and scaled to length one. ``prompt`` is put before queries only."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                v = pool(*encode([prompt + (t or "") for t in part["text"]]), how).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": part["id"], "vector": list(v)})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(work, f"id {kind}, vector array<double>")


def pool(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Pool token states ``batch x tokens x dims``: first token, mean over the mask, last token."""
    if how == "cls":
        return hidden[:, 0]
    if how == "mean":
        m = mask[:, :, None].astype(hidden.dtype)
        return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    if how == "last":
        return hidden[np.arange(len(hidden)), np.maximum(mask.sum(1).astype(int) - 1, 0)]
    raise ValueError(f"unknown pooling {how!r}")


# ---- fusion ------------------------------------------------------------------------------------
def min_max(run: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 per query; a list without spread gets 0 throughout."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return run.withColumn("norm", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))


def linear_fusion(a: DataFrame, b: DataFrame, weight: float = 0.3, k: int = 50) -> DataFrame:
    """``weight`` x scaled A + (1 - weight) x scaled B over the union of two runs, for queries that
    both hold; an id in one list only has 0 in the other."""
    both = a.select("query_id").distinct().join(b.select("query_id").distinct(), "query_id")
    x = min_max(a).select("query_id", "id", F.col("norm").alias("na"))
    y = min_max(b).select("query_id", "id", F.col("norm").alias("nb"))
    joined = x.join(y, ["query_id", "id"], "full").join(both, "query_id", "left_semi")
    return top_k(joined.select("query_id", "id", (weight * F.coalesce("na", F.lit(0.0)) + (1 - weight) * F.coalesce("nb", F.lit(0.0))).alias("score")), k)


def rrf_fusion(a: DataFrame, b: DataFrame, k: int = 50, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ties by rank in A, then in B, then by id."""
    both = a.select("query_id").distinct().join(b.select("query_id").distinct(), "query_id")
    votes = a.select("query_id", "id", F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb")).unionByName(b.select("query_id", "id", F.lit(None).cast("int").alias("ra"), F.col("rank").alias("rb")))
    fused = votes.join(both, "query_id", "left_semi").groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (constant + F.coalesce("ra", "rb"))).alias("score"), F.min("ra").alias("ra"), F.min("rb").alias("rb"))
    return top_k(fused, k, [F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), F.col("id").asc()])


def chunks_to_docs(run: DataFrame, method: str = "max") -> DataFrame:
    """Document runs from chunk runs, by the best or the summed score; ties by first chunk."""
    agg = {"max": F.max, "sum": F.sum}[method]("score").alias("score")
    docs = run.groupBy("query_id", chunk_to_doc(F.col("id")).alias("id")).agg(agg, F.min("rank").alias("first"))
    return top_k(docs, 0, [F.col("first").asc(), F.col("id").asc()])


# ---- reranking and traces ----------------------------------------------------------------------
def rerank(run: DataFrame, texts: DataFrame, questions: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 50) -> DataFrame:
    """The first ``k`` of a run scored anew by ``scorer(question, passage)``; ids without a text are
    dropped; equal scores keep their old order."""
    head = run.filter(F.col("rank") <= k).join(texts.select("id", F.col("text").alias("passage")), "id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    scored = head.select("query_id", "id", F.col("rank").alias("old"), scorer(F.col("question"), F.col("passage")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "old")
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rank", "score", F.col("old").alias("rank_before"))


Logits = Callable[[list[str]], np.ndarray]


def pointwise_scorer(logits: Logits, instruction: str = "Judge whether the document answers the query.", batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank``: ``logits`` gives the logits of "no" and "yes" for each prompt of a
    batch, and the score is the probability of "yes" between the two."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            prompts = [f"<Instruct>: {instruction}\n<Query>: {x or ''}\n<Document>: {y or ''}" for x, y in zip(q, d)]
            out = []
            for a in range(0, len(prompts), batch):
                two = np.asarray(logits(prompts[a : a + batch]), dtype=np.float64)
                two = np.exp(two - two.max(axis=1, keepdims=True))
                out += (two[:, 1] / two.sum(axis=1)).tolist()
            yield pd.Series(out, dtype="float64")

    return score


def overlap_scorer(question: Column, passage: Column) -> Column:
    """A deterministic stand-in for a reranking model: share of the question's words found."""
    q = F.array_distinct(bm25_tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(bm25_tokens(passage)))) / F.size(q)).otherwise(0.0)


def to_trace(ranked: DataFrame, **columns: str) -> DataFrame:
    """Nested record per query for a sink: ``retrieved`` in rank order, and constant fields."""
    nested = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("retrieved"))
    for name, value in columns.items():
        nested = nested.withColumn(name, F.lit(value))
    return nested


def from_trace(trace: DataFrame) -> DataFrame:
    """Long form of nested records; blank query ids are skipped, missing ranks are positions."""
    rows = trace.filter(F.length(F.trim(F.coalesce("query_id", F.lit("")))) > 0).select("query_id", F.posexplode("retrieved").alias("pos", "hit"))
    fields = rows.schema["hit"].dataType.names
    ident = F.coalesce(*[F.col(f"hit.{n}") for n in ("id", "chunk_id", "doc_id") if n in fields])
    rank = F.coalesce(F.col("hit.rank"), F.col("pos") + 1) if "rank" in fields else F.col("pos") + 1
    return rows.select("query_id", ident.alias("id"), rank.cast("int").alias("rank"), F.col("hit.score").cast("double").alias("score"))


def adversarial_pipeline(corpus: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], scorer: Callable[[Column, Column], Column], k: int = 20, weight: float = 0.3) -> dict[str, DataFrame]:
    """The four stages for a question set: lexical, dense, fused and reranked runs."""
    lexical = bm25_search(corpus, questions, k)
    dense = dense_search(corpus.select("id", embed(F.col("text")).alias("vector")), questions.select("query_id", embed(F.col("text")).alias("vector")), k, drop_self=False)
    fused = linear_fusion(lexical, dense, weight, k)
    return {"bm25": lexical, "dense": dense, "fused": fused, "reranked": rerank(fused, corpus, questions, scorer, k)}


# ---- persisted indexes -------------------------------------------------------------------------
def write_index(corpus: DataFrame, path: str, vectors: DataFrame | None = None, model_key: str | None = None) -> None:
    """Postings, term statistics, ids in order and metadata as Parquet; vectors with their model and
    dimension."""
    spark = corpus.sparkSession
    postings, idf = bm25_index(corpus)
    postings.repartition(F.col("term")).sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    idf.write.mode("overwrite").parquet(f"{path}/terms")
    corpus.select("id").orderBy("id").write.mode("overwrite").parquet(f"{path}/ids")
    from evidra.operators.sampling import fingerprint

    meta = {"n": corpus.count(), "fingerprint": fingerprint(corpus), "k1": K1, "b": B}
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        first = vectors.select(F.size("vector").alias("d")).first()
        meta |= {"model_key": model_key, "dim": first["d"] if first else 0, "n_vectors": vectors.count()}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Postings, terms and metadata; a part that is missing, or ids that are not as many as stated,
    is an error."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        postings, terms, ids = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "ids"))
    except AnalysisException as e:
        raise FileNotFoundError(f"index {path} lacks a part: {e.getCondition()}") from e
    n = ids.count()
    if n != meta["n"]:
        raise ValueError(f"index {path}: {n} ids, {meta['n']} stated")
    return postings, terms, meta


def read_vectors(spark: SparkSession, path: str, model_key: str | None = None, dim: int | None = None) -> DataFrame:
    """Stored vectors ``id, vector``; another model than stated, another dimension than a probe of it
    has, or another number of vectors is an error."""
    _, _, meta = read_index(spark, path)
    if "dim" not in meta:
        raise FileNotFoundError(f"index {path} has no vectors")
    if model_key is not None and meta["model_key"] is not None and model_key != meta["model_key"]:
        raise ValueError(f"index of {meta['model_key']}, asked for {model_key}")
    vectors = spark.read.parquet(f"{path}/vectors")
    odd = vectors.filter(F.size("vector") != meta["dim"]).count()
    if odd or (dim is not None and dim != meta["dim"]):
        raise ValueError(f"index {path}: dimension {meta['dim']}, asked for {dim}, {odd} vectors of another")
    if vectors.count() != meta["n_vectors"]:
        raise ValueError(f"index {path}: not the {meta['n_vectors']} vectors stated")
    return vectors


def verify_index(spark: SparkSession, path: str, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """``check, ok, detail``: sizes, ids, their order, fingerprint, dimensions and finite scores of a
    stored index."""
    from evidra.operators.sampling import fingerprint

    postings, terms, meta = read_index(spark, path)
    ids = spark.read.parquet(f"{path}/ids")
    n, n_ids, missing = corpus.count(), ids.count(), corpus.select("id").join(ids, "id", "left_anti").count()
    odd = bm25_scores(postings, queries).filter(F.isnan("score") | F.col("score").isNull()).count()
    unknown = postings.join(terms, "term", "left_anti").count()
    # stored in order: each file's ids rise, and files follow each other by their least ids
    w = Window.partitionBy("f").orderBy("at")
    at = ids.select("id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"))
    falls = at.withColumn("last", F.lag("id").over(w)).filter(F.col("last") > F.col("id")).count()
    spans = sorted((r["a"], r["z"]) for r in at.groupBy("f").agg(F.min("id").alias("a"), F.max("id").alias("z")).collect())  # a row per file
    falls += sum(a[1] > b[0] for a, b in zip(spans, spans[1:]))
    rows = [("size", n == n_ids == meta["n"], f"{n} documents, {n_ids} ids"), ("ids", missing == 0, f"{missing} missing"), ("order", falls == 0, f"{falls} out of order"), ("fingerprint", fingerprint(corpus) == meta["fingerprint"], meta["fingerprint"]), ("terms", unknown == 0, f"{unknown} postings without a term"), ("finite scores", odd == 0, f"{odd} not finite")]
    if "dim" in meta:
        wrong = spark.read.parquet(f"{path}/vectors").filter((F.size("vector") != meta["dim"]) | F.exists("vector", lambda x: F.isnan(x) | x.isNull())).count()
        rows.append(("dimension", wrong == 0, f"{meta['dim']}, {wrong} vectors of another or not finite"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")
