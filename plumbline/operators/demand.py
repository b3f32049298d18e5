"""Demand mining over a question log: concepts, clusters, gaps, sources, paths and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import find_concepts, of_each_text, rank_documents
from plumbline.session import settle

UNRESOLVED = ("missing_data", "low_confidence", "abandoned")
CLUSTER_DISTANCE = 0.45
# Weight of each distinct asker's role (fixed values); other roles weigh 1.
ROLE_WEIGHTS = {"ops_manager": 3, "ops_director": 3, "analyst": 1, "data_engineer": 1, "admin": 0}


def pending(questions: DataFrame) -> DataFrame:
    return questions.where(
        F.col("outcome").isin(*UNRESOLVED) & F.col("intent_id").isNull() & F.col("resolved_by_product").isNull()
    )


def intent_terms(text: Column, glossary: list[tuple[str, str]], entities: dict[str, list[str]], unmatched: Column | None = None) -> Column:
    """Sorted terms a question is about: its concepts, else its entities, else unmatched terms, else its words."""
    concepts = F.transform(find_concepts(text, glossary), lambda c: F.concat(F.lit("concept_"), c))
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    named = F.array_compact(
        F.array(
            *[
                F.when(F.greatest(*[F.contains(padded, F.lit(f" {p} ")) for p in phrases], F.lit(False)), F.lit(f"entity_{n}"))
                for n, phrases in entities.items()
            ]
        )
    )
    plain = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    left = plain if unmatched is None else F.when(F.size(unmatched) > 0, F.transform(unmatched, lambda t: F.replace(t, F.lit(" "), F.lit("_")))).otherwise(plain)
    chosen = F.when(F.size(concepts) > 0, concepts).when(F.size(named) > 0, named).otherwise(left)
    return F.array_sort(F.array_distinct(chosen))


# --- vectors -------------------------------------------------------------------------------------------


def _shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of joins that Spark never broadcasts: vectors, pairs and members grow with the questions, and files of few
    bytes hold many rows of repeated terms, so their size on disk says little about what would pass through the driver."""
    return df.hint("merge")


def unit_vectors(docs: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """(key, term, w): TF-IDF vectors of length one, weights `tf * (ln((1+n)/(1+df)) + 1)`.

    docs(key, terms, copies): `copies` is how many equal questions a row stands for; they count in n and df.
    """
    tf = counts if counts is not None else docs.select(key, F.explode("terms").alias("term"), F.lit(1.0).alias("tf"))
    weights = docs.select(key, F.col("copies").cast("double").alias("_n"))
    n = weights.agg(F.sum("_n")).scalar()
    df = tf.join(_shuffled(weights), key).groupBy("term").agg(F.sum("_n").alias("df"))
    w = tf.join(_shuffled(df), "term").select(key, "term", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    return w.join(_shuffled(length), key).select(key, "term", (F.col("w") / F.col("_len")).alias("w"))


def _prefixes(v: DataFrame, key: str, floor: float) -> DataFrame:
    """(key, term): the rarest terms of each vector, until what is left is shorter than `floor`.

    Two vectors no longer than one whose product reaches `floor` share a term of both prefixes, so only
    rare terms are ever joined on and pairs below the floor mostly never meet.
    """
    rarity = v.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    packed = v.join(_shuffled(rarity), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_df", "term", "w"))).alias("_t"))
    rest = F.aggregate("_t", F.lit(0.0), lambda a, t: a + t["w"] * t["w"])
    state = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, t: Column) -> Column:
        needed = a["rest"] >= floor * floor * (1 - 1e-9)
        return F.struct(
            (a["rest"] - t["w"] * t["w"]).alias("rest"), F.when(needed, F.array_append(a["kept"], t["term"])).otherwise(a["kept"]).alias("kept")
        )

    return packed.select(key, F.explode(F.aggregate("_t", state, step, lambda a: a["kept"])).alias("term"))


def similar_pairs(v: DataFrame, key: str, floor: float) -> DataFrame:
    """(a, b, similarity) for all a < b whose vectors' product reaches `floor`, exactly."""
    p = _prefixes(v, key, floor)
    meet = (
        p.select(F.col(key).alias("a"), "term")
        .join(_shuffled(p.select(F.col(key).alias("b"), "term")), "term")
        .where(F.col("a") < F.col("b"))
        .select("a", "b")
        .distinct()
    )
    left = v.select(F.col(key).alias("a"), "term", F.col("w").alias("wa"))
    right = v.select(F.col(key).alias("b"), "term", F.col("w").alias("wb"))
    scored = meet.join(_shuffled(left), "a").join(_shuffled(right), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return scored.where(F.col("similarity") >= floor)


# --- clusters ------------------------------------------------------------------------------------------


def cluster(questions: DataFrame, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """(question_id, cluster): average-linkage clusters of questions(question_id, terms), cut at `distance`.

    The average distance of two clusters is one minus the product of their mean vectors, so a cluster is
    just a mean vector and a size. Every round merges all pairs that are each other's best partner (the
    same merges a one-at-a-time run makes, since average linkage never brings a third cluster closer), and
    ends when no pair is closer than `distance`. Equal questions start as one cluster of their number.
    """
    named = questions.withColumn("form", F.concat_ws(" ", "terms"))
    forms = settle(
        named.groupBy("form").agg(F.min("question_id").alias("c"), F.count(F.lit(1)).alias("copies"), F.any_value("terms").alias("terms")), "forms"
    )
    member = forms.select("form", "c")
    copies = forms.select("c", F.col("copies").cast("double").alias("size"))
    vectors = settle(unit_vectors(forms, "c").join(_shuffled(copies), "c"), "vectors")
    while True:
        pairs = similar_pairs(vectors.select("c", "term", "w"), "c", 1 - distance).where(F.col("similarity") > 1 - distance + 1e-12)
        pairs = settle(pairs, "pairs")
        if pairs.isEmpty():
            break
        # rounding makes equal similarities explicit ties, broken by the lower numbers: a total order of
        # pairs, so the best pair of all is always mutual and every round makes progress
        rank = F.struct((-F.round("similarity", 12)).alias("s"), "a", "b")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), rank.alias("r"))
        best = ends.groupBy("c").agg(F.min("r").alias("r"))
        mutual = best.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("r.a").alias("into"), F.col("r.b").alias("c"))
        mutual = _shuffled(settle(mutual, "merges"))
        target = F.coalesce("into", "c")
        member = settle(member.join(mutual, "c", "left").select("form", target.alias("c")), "members")
        moved = vectors.join(mutual, "c", "left").select(target.alias("c"), "term", (F.col("w") * F.col("size")).alias("s"))
        sizes = vectors.select("c", "size").distinct().join(mutual, "c", "left").groupBy(target.alias("c")).agg(F.sum("size").alias("size"))
        vectors = settle(
            moved.groupBy("c", "term").agg(F.sum("s").alias("s")).join(_shuffled(sizes), "c").select("c", "term", (F.col("s") / F.col("size")).alias("w"), "size"),
            "vectors",
        )
    return named.select("question_id", "form").join(_shuffled(member), "form").select("question_id", F.col("c").alias("cluster"))


def attach(questions: DataFrame, intents: DataFrame, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """(question_id, intent_id, similarity) of new questions close enough to an intent, the nearest one.

    questions(question_id, terms); intents(intent_id, question_id, terms): the questions each intent holds.
    An intent is one document of all its questions' terms; n and df count intents and new questions.
    """
    forms = questions.withColumn("form", F.concat_ws(" ", "terms"))
    distinct = forms.groupBy("form").agg(F.count(F.lit(1)).alias("copies"), F.any_value("terms").alias("terms"))
    i_tf = intents.select(F.concat(F.lit("i"), "intent_id").alias("doc"), F.explode("terms").alias("term")).groupBy("doc", "term").agg(
        F.count(F.lit(1)).cast("double").alias("tf")
    )
    q_tf = distinct.select(F.concat(F.lit("q"), "form").alias("doc"), F.explode("terms").alias("term"), F.lit(1.0).alias("tf"))
    docs = distinct.select(F.concat(F.lit("q"), "form").alias("doc"), "copies").unionByName(
        intents.select(F.concat(F.lit("i"), "intent_id").alias("doc")).distinct().withColumn("copies", F.lit(1).cast("bigint"))
    )
    v = settle(unit_vectors(docs, "doc", i_tf.unionByName(q_tf)), "vectors")
    is_intent = F.col("doc").startswith("i")
    q = v.where(~is_intent).select(F.substring("doc", 2, 1 << 30).alias("form"), "term", F.col("w").alias("wq"))
    i = v.where(is_intent).select(F.substring("doc", 2, 1 << 30).alias("intent"), "term", F.col("w").alias("wi"))
    sims = q.join(i, "term").groupBy("form", "intent").agg(F.sum(F.col("wq") * F.col("wi")).alias("similarity"))
    ids = intents.select(F.col("intent_id").cast("string").alias("intent"), "intent_id").distinct()
    best = (
        sims.join(ids, "intent")
        .groupBy("form")
        .agg(F.min_by(F.struct("intent_id", "similarity"), F.struct((-F.round("similarity", 12)).alias("s"), "intent_id")).alias("b"))
        .where(1 - F.col("b.similarity") <= distance + 1e-12)
    )
    return forms.select("question_id", "form").join(best, "form").select("question_id", "b.intent_id", F.round("b.similarity", 4).alias("similarity"))


# --- gaps and sources ----------------------------------------------------------------------------------


def classify_gap(intents: DataFrame, coverage: DataFrame, derived: DataFrame, columns: DataFrame) -> DataFrame:
    """(intent_id, gap): what stops each intent(intent_id, concept) from being answered.

    coverage(concept, product); derived(concept, base): the concept it can be computed from;
    columns(concept): concepts some catalogue column matches. Checked in order: one product covers all
    concepts (missing_grain), each is covered somewhere (missing_join_path), an uncovered one has a
    column (missing_attribute), else missing_domain.
    """
    one = intents.select("intent_id", "concept").distinct()
    size = one.groupBy("intent_id").agg(F.count(F.lit(1)).alias("n"))
    by_product = one.join(coverage, "concept").groupBy("intent_id", "product").agg(F.count(F.lit(1)).alias("n"))
    shared = by_product.join(size, ["intent_id", "n"]).select("intent_id").distinct().withColumn("shared", F.lit(True))
    covered = coverage.select("concept").distinct()
    via_base = derived.join(covered.withColumnRenamed("concept", "base"), "base").select("concept")
    reachable = covered.unionByName(via_base).distinct().withColumn("reached", F.lit(True))
    has_column = columns.select("concept").distinct().withColumn("column", F.lit(True))
    state = (
        one.join(reachable, "concept", "left")
        .join(has_column, "concept", "left")
        .groupBy("intent_id")
        .agg(
            F.bool_and(F.coalesce("reached", F.lit(False))).alias("all_reached"),
            F.bool_or(F.col("reached").isNull() & F.coalesce("column", F.lit(False))).alias("some_column"),
        )
    )
    return state.join(shared, "intent_id", "left").select(
        "intent_id",
        F.when(F.col("shared"), "missing_grain")
        .when(F.col("all_reached"), "missing_join_path")
        .when(F.col("some_column"), "missing_attribute")
        .otherwise("missing_domain")
        .alias("gap"),
    )


def sources(concepts: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """(concept, column, score): best catalogue columns per concept(concept, text), personal and hidden ones left out.

    catalog(column, text, classification, searchable), a registry of moderate size.
    """
    open_ = catalog.where(F.col("searchable") & ~F.col("classification").eqNullSafe("PII")).select("column", "text")
    # equal texts are ranked once; a text meets at most all columns of the catalogue, so its window is small
    order = Window.partitionBy("text").orderBy(F.round("similarity", 12).desc(), "column")
    asked = concepts.select("text").distinct()
    ranked = rank_documents(asked, open_, "text", "column").withColumn("_r", F.row_number().over(order))
    best = ranked.where((F.col("_r") <= k) & (F.col("similarity") > 0)).select("text", "column", F.round("similarity", 4).alias("score"))
    return of_each_text(concepts, "concept", best)


def join_paths(foreign_keys: DataFrame, anchor: str) -> DataFrame:
    """(table, path, conditions, hops): shortest way from `anchor` to every table over undirected keys.

    foreign_keys(child, child_column, parent, parent_column). Ties go to the alphabetically first path.
    """
    text = F.concat("child", F.lit("."), "child_column", F.lit(" = "), "parent", F.lit("."), "parent_column").alias("condition")
    e = foreign_keys.select(F.col("child").alias("x"), F.col("parent").alias("y"), text)
    e = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "condition"))
    spark = foreign_keys.sparkSession
    start = "table string, path array<string>, conditions array<string>"
    frontier = spark.createDataFrame([(anchor, [anchor], [])], start)
    found = frontier
    while True:
        step = frontier.join(e, F.col("table") == F.col("x")).select(
            F.col("y").alias("table"), F.array_append("path", F.col("y")).alias("path"), F.array_append("conditions", F.col("condition")).alias("conditions")
        )
        step = step.join(found.select("table"), "table", "left_anti")
        frontier = settle(step.groupBy("table").agg(F.min(F.struct("path", "conditions")).alias("p")).select("table", "p.*"), "paths")
        if frontier.isEmpty():
            return found.withColumn("hops", F.size("conditions"))
        found = found.unionByName(frontier)


def path_confidence(conditions: Column) -> Column:
    return F.round(1 / F.pow(F.greatest(conditions, F.lit(1)).cast("double"), 0.25), 4)


# --- scores --------------------------------------------------------------------------------------------


def score(questions: DataFrame, users: DataFrame) -> DataFrame:
    """Demand per intent: two per distinct asker, one per question, plus the askers' role weights."""
    weight = F.create_map(*[F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv])
    askers = questions.groupBy("intent_id", "asked_by").agg(F.count(F.lit(1)).alias("n"))
    who = users.select(F.col("user_id").alias("asked_by"), F.coalesce(F.try_element_at(weight, F.col("role")), F.lit(1)).alias("weight"))
    return askers.join(who, "asked_by").groupBy("intent_id").agg(
        F.count(F.lit(1)).alias("distinct_askers"),
        F.sum("n").alias("question_count"),
        F.sum("weight").alias("role_weight_sum"),
        (2 * F.count(F.lit(1)) + F.sum("n") + F.sum("weight")).cast("double").alias("demand_score"),
    )


def closure(questions: DataFrame) -> DataFrame:
    """Resolved share per intent, and hours from the first question to the last resolution."""
    done = F.col("resolved_by_product").isNotNull()
    resolved, total = F.count_if(done), F.count(F.lit(1))
    hours = (F.unix_timestamp(F.max("resolved_at")) - F.unix_timestamp(F.min("asked_at"))) / 3600
    return questions.groupBy("intent_id").agg(
        resolved.alias("resolved"),
        total.alias("total"),
        F.round(resolved / total, 4).alias("closure_rate"),
        F.round(hours, 2).alias("hours_to_resolution"),
        F.when(resolved == total, "closed").otherwise("partially_closed").alias("status"),
    )

