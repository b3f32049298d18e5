"""The most similar documents of each query, without scoring every document that shares a term.

Similarity is that of `text.rank_documents`. A term can add at most its weight in the query times its largest share of any
document's length. With a query's terms in order of rarity, the sum of these bounds from some term on tells what a document that
holds none of the rarer terms can reach. A first look at the strongest documents of the rarest terms gives a similarity that the
k-th best reaches at least; common terms whose bounds together stay below it are not looked up, and a document goes as soon as what its
rare terms give plus that rest cannot reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import term_counts, unigrams_and_bigrams
from plumbline.session import settle

#: Strongest documents kept for a term, and terms looked at first: so many times k.
STRONGEST, FIRST_LOOK = 4, 3
_NEAR = 1e-9  # sums in another order differ less


class Index:
    """Postings, bounds and document vectors of a registry of documents."""

    def __init__(self, documents: DataFrame, document_id: str, k: int, text: str = "text"):
        self.n = documents.agg(F.count(F.lit(1)).cast("double")).first()[0]
        d = term_counts(documents.select(F.col(document_id).alias("_d"), text), "_d", unigrams_and_bigrams(F.col(text)))
        df = d.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        d = d.join(df, "term").withColumns({"w0": self.idf(F.col("df")), "w1": self.idf(F.col("df") + 1)})
        d = d.withColumns({"gain": F.col("tf") * F.col("w1") * F.col("w1"), "own": F.pow(F.col("tf") * F.col("w0"), 2), "least": F.pow(F.col("tf") * F.col("w1"), 2)})
        d = settle(d, "document-terms")
        part = F.struct("term", "gain", (F.col("least") - F.col("own")).alias("fix"))
        # shared terms shorten a document; it is shortest where all are shared
        self.vectors = settle(d.groupBy("_d").agg(F.sum("own").alias("d_len"), F.sqrt(F.sum("least")).alias("shortest"), F.collect_list(part).alias("d_terms")), "document-vectors")
        share = F.col("gain") / F.col("shortest")
        self.postings = settle(d.select("_d", "term", "gain").join(self.vectors.select("_d", "shortest"), "_d").select("term", "_d", share.alias("share")), "postings")
        rank = Window.partitionBy("term").orderBy(F.desc("share"), "_d")
        self.strongest = settle(self.postings.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= STRONGEST * k).drop("r"), "strongest")
        self.terms = settle(self.postings.groupBy("term").agg(F.max("share").alias("most"), F.count(F.lit(1)).cast("double").alias("df")), "term-bounds")

    def idf(self, count: Column) -> Column:
        return F.log((self.n + 2) / (1 + count)) + 1


def _score(pairs: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """Exact similarity of pairs (_q, _d): two look-ups a pair, terms are met inside the row."""
    met = pairs.join(index.vectors.drop("shortest"), "_d").join(queries.select("_q", "q_len", "q_terms"), "_q")
    shared = F.filter("d_terms", lambda t: F.col("q_terms")[t["term"]].isNotNull())
    dot = F.aggregate(shared, F.lit(0.0), lambda a, t: a + F.col("q_terms")[t["term"]] * t["gain"])
    fix = F.aggregate(shared, F.lit(0.0), lambda a, t: a + t["fix"])
    return met.select("_q", "_d", (dot / F.sqrt(F.col("q_len") * (F.col("d_len") + fix))).alias("similarity"))


def best_documents(
    queries: DataFrame, documents: DataFrame, query_id: str, document_id: str, need: DataFrame | None = None, k: int = 15, also: DataFrame | None = None
) -> DataFrame:
    """Rows (query, document, similarity): each query's k most similar documents, ties to smaller document ids, and the pairs of `also`.

    `need(query_id, k)` asks for more for single queries; `also(query_id, document_id)` names pairs to be scored in any case.
    Only documents that share a term count as similar; of `also`, pairs that share none have similarity 0. Equal texts are scored once.
    """
    index = Index(documents, document_id, k)
    q = queries.select(F.col(query_id).alias("_id"), F.col("text").alias("_q"))
    wanted = q if need is None else q.join(need.select(F.col(query_id).alias("_id"), F.col("k").alias("_k")), "_id", "left")
    wanted = wanted.groupBy("_q").agg(F.greatest(F.lit(k), F.coalesce(F.max(F.lit(k) if need is None else F.col("_k")), F.lit(k))).alias("k"))
    terms = term_counts(wanted.select("_q"), "_q", unigrams_and_bigrams(F.col("_q"))).join(index.terms, "term", "left")
    weight = index.idf(F.coalesce("df", F.lit(0.0)) + 1)
    terms = settle(terms.withColumn("w2", F.pow(F.col("tf") * weight, 2)), "query-terms")
    known = F.when(F.col("df").isNotNull(), F.struct("term", "tf"))
    texts = terms.groupBy("_q").agg(F.sum("w2").alias("q_len"), F.map_from_entries(F.collect_list(known)).alias("q_terms"))
    texts = settle(texts.join(wanted, "_q"), "query-vectors")

    # a text's terms, rarest first; windows hold one text's terms
    order = Window.partitionBy("_q").orderBy("df", "term")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = terms.where("df is not null").drop("w2").join(texts.select("_q", "q_len", "k"), "_q")
    ranked = ranked.withColumn("bound", F.col("tf") * F.col("most") / F.sqrt("q_len"))
    seen = F.sum(F.least(F.col("df"), F.lit(float(STRONGEST * k)))).over(before)
    rest = F.sum("bound").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = settle(ranked.withColumns({"seen": F.coalesce(seen, F.lit(0.0)), "rest": rest}), "ranked-terms")

    look = ranked.where(F.col("seen") < FIRST_LOOK * F.col("k")).join(index.strongest, "term").select("_q", "_d").distinct()
    place = Window.partitionBy("_q").orderBy(F.desc("similarity"))
    sure = _score(look, texts, index).join(texts.select("_q", "k"), "_q").withColumn("place", F.row_number().over(place))
    sure = sure.where(F.col("place") == F.col("k")).select("_q", (F.col("similarity") - _NEAR).alias("sure"))
    sure = settle(texts.select("_q").join(sure, "_q", "left").select("_q", F.coalesce("sure", F.lit(0.0)).alias("sure")), "sure")

    bounded = ranked.join(sure, "_q")
    rest = bounded.where(F.col("rest") < F.col("sure")).groupBy("_q").agg(F.max("rest").alias("unseen"))
    rare = bounded.where(F.col("rest") >= F.col("sure")).select("_q", "term", "tf", "q_len", "sure")
    given = rare.join(index.postings, "term").groupBy("_q", "_d").agg(F.sum(F.col("tf") * F.col("share") / F.sqrt("q_len")).alias("given"), F.first("sure").alias("sure"))
    left = given.join(rest, "_q", "left").where(F.col("given") + F.coalesce("unseen", F.lit(0.0)) >= F.col("sure")).select("_q", "_d", F.lit(True).alias("ranked"))
    if also is not None:
        named = also.select(F.col(query_id).alias("_id"), F.col(document_id).alias("_d")).join(q, "_id").select("_q", "_d").distinct()
        left = left.unionByName(named.withColumn("ranked", F.lit(False))).groupBy("_q", "_d").agg(F.max("ranked").alias("ranked"))
    left = settle(left, "candidates")

    scored = left.join(_score(left.select("_q", "_d"), texts, index), ["_q", "_d"]).join(texts.select("_q", "k"), "_q")
    best = Window.partitionBy("_q", "ranked").orderBy(F.round("similarity", 12).desc(), "_d")
    kept = scored.withColumn("place", F.when(F.col("ranked"), F.row_number().over(best)))
    if also is not None:
        kept = kept.join(named.withColumn("named", F.lit(True)), ["_q", "_d"], "left")
    else:
        kept = kept.withColumn("named", F.lit(None).cast("boolean"))
    kept = kept.where((F.col("place") <= F.col("k")) | F.col("named"))
    return q.join(kept, "_q").select(F.col("_id").alias(query_id), F.col("_d").alias(document_id), "similarity")
