"""Which served answers a restatement changes, and who has to hear of it.

Answers are re-executed by request: answers with the same plan shape, policy scope and as-of day share one
result, computed once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import result_hash
from plumbline.functions.times import window_columns
from plumbline.session import settle

DEFAULT_MATERIALITY_PCT = 1.0
SAME = 1e-9
PLACES = 4
ALL_SCOPES = "ALL"
REQUEST = ["shape", "scope", "as_of"]
CELL_KEY = ["key", "metric"]


@dataclass(frozen=True)
class Shape:
    """A plan shape: metrics (name to expression over additive parts), dimensions, a relative window, its lineage."""

    name: str
    metrics: dict[str, str]
    parts: dict[str, str]
    window: str
    dimensions: tuple[str, ...] = ()
    lineage: tuple[str, ...] = field(default_factory=tuple)


def affected(answers: DataFrame, shapes: list[Shape], table: str) -> DataFrame:
    """Answers with a lineage node in the changed table. Lineage is known per shape, not per answer."""
    hit = [s.name for s in shapes if any(n.startswith(f"{table}.") for n in s.lineage)]
    return answers.where(F.col("shape").isin(hit))


def requests(answers: DataFrame) -> DataFrame:
    return answers.select("shape", "scope", F.to_date("served_at").alias("as_of")).distinct()


def _key(columns: list[str]) -> Column:
    """One dimension as its text; several joined by "|", with "|" and "\\" inside a value marked by "\\"."""
    if not columns:
        return F.lit("")
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    plain = [F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat_ws("|", *[F.coalesce(c, F.lit("\\N")) for c in plain])


def totals_of(product: DataFrame, shapes: list[Shape], time: str, scope: str) -> dict[str, DataFrame]:
    """For each shape the parts' totals by day, scope (each and all) and dimensions: one scan and one shuffle for all shapes.

    Every grouping that any shape needs is one of the grouping sets of a single aggregate, and equal parts of shapes are computed
    once. A window over all time has no days.
    """
    dims = sorted({d for s in shapes for d in s.dimensions})
    named = {d: f"_d{i}" for i, d in enumerate(dims)}
    parts = {e: f"_p{i}" for i, e in enumerate(dict.fromkeys(e for s in shapes for e in s.parts.values()))}
    every = ["_day", "_scope", *named.values()]

    def wanted(s: Shape, scoped: bool) -> tuple[str, ...]:
        own = {named[d] for d in s.dimensions} | ({"_scope"} if scoped else set()) | (set() if s.window == "all" else {"_day"})
        return tuple(c for c in every if c in own)

    def code(columns: tuple[str, ...]) -> int:
        return sum(1 << len(every) - 1 - i for i, c in enumerate(every) if c not in columns)

    sets = list(dict.fromkeys(wanted(s, scoped) for s in shapes for scoped in (True, False)))
    df = product.withColumns({"_day": F.col(time), "_scope": F.col(scope), **{n: F.col(d) for d, n in named.items()}})
    found = df.groupingSets([[F.col(c) for c in one] for one in sets], *every).agg(F.grouping_id().alias("_set"), *[F.expr(e).alias(n) for e, n in parts.items()])
    found = settle(found, "totals")

    def of(s: Shape) -> DataFrame:
        out = None
        for scoped in (True, False):
            mine = found.where(F.col("_set") == code(wanted(s, scoped)))
            who = F.col("_scope") if scoped else F.lit(ALL_SCOPES)
            one = mine.select("_day", who.alias("scope"), _key([named[d] for d in s.dimensions]).alias("key"), *[F.col(parts[e]).alias(n) for n, e in s.parts.items()])
            out = one if out is None else out.unionByName(one)
        return out

    return {s.name: of(s) for s in shapes}


def cells(asked: DataFrame, product: DataFrame, shapes: list[Shape], time: str, scope: str) -> DataFrame:
    """(shape, scope, as_of, key, metric, value) of every request, windows resolved as of its own day.

    The product first shrinks to totals per day, scope and dimensions; a request meets those of its days.
    """
    out, totals = None, totals_of(product, shapes, time, scope)
    for s in shapes:
        mine = asked.where(F.col("shape") == s.name)
        if s.window == "all":
            summed = mine.join(totals[s.name], "scope").select(*REQUEST, "key", *s.parts)
        else:
            lo, hi = window_columns(s.window, F.col("as_of"))
            met = mine.withColumn("_day", F.explode(F.sequence(lo, F.date_sub(hi, 1)))).join(totals[s.name], ["scope", "_day"])
            summed = met.groupBy(*REQUEST, "key").agg(*[F.sum(n).alias(n) for n in s.parts])
        if not s.dimensions:  # a total is one row even over nothing
            summed = mine.withColumn("key", F.lit("")).join(summed, [*REQUEST, "key"], "left")
        values = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in s.metrics.items()])
        one = summed.select(*REQUEST, "key", F.inline(values))
        out = one if out is None else out.unionByName(one)
    return out


def diff(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Changed cells: (by, key, metric, change, old, new, pct).

    A key on one side only is added or removed and counts as 100 %, once, whatever its metrics; so does a
    value against nothing. Values are compared after rounding, as they are stored.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        v = F.when(~F.isnan("value"), F.round("value", PLACES))
        return df.select(*by, *CELL_KEY, v.alias(name), F.lit(True).alias(f"in_{name}"))

    both = side(old, "old").join(side(new, "new"), [*by, *CELL_KEY], "full")
    a, b = F.col("old"), F.col("new")
    delta = F.abs(b - a)
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(a.isNull() != b.isNull(), "changed")
        .when(delta >= SAME, "changed")
    )
    one_sided = F.col("change").isin("added", "removed")
    pct = F.when(one_sided | a.isNull() | b.isNull(), 100.0).otherwise(delta / F.greatest(F.abs(a), F.lit(SAME)) * 100)
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(
            *by,
            "key",
            F.when(~one_sided, F.col("metric")).alias("metric"),
            "change",
            F.when(~one_sided, a).alias("old"),
            F.when(~one_sided, b).alias("new"),
            pct.alias("pct"),
        )
        .dropDuplicates([*by, "key", "change", "metric"])
    )


def max_change(diffs: DataFrame, by: list[str]) -> DataFrame:
    return diffs.groupBy(*by).agg(F.round(F.max("pct"), PLACES).alias("max_pct"))


def digest(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free digest of each result, in fixed-size state."""
    return result_hash(df, by, ["key", "metric", "value"]).drop("row_count")


def notices(
    answers: DataFrame, old: DataFrame, new: DataFrame, settings: DataFrame, noticed: DataFrame | None = None
) -> DataFrame:
    """(cert_id, consumer, new_hash, max_pct): answers whose hash changed by more than their consumer's materiality.

    settings(consumer, materiality_pct); noticed(cert_id, new_hash): notices already sent for that result.
    """
    hashes = digest(old, REQUEST).withColumnRenamed("result_hash", "old_hash").join(
        digest(new, REQUEST).withColumnRenamed("result_hash", "new_hash"), REQUEST, "full"
    )
    changed = hashes.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).join(max_change(diff(old, new, REQUEST), REQUEST), REQUEST)
    due = (
        answers.withColumn("as_of", F.to_date("served_at"))
        .join(changed, REQUEST)
        .join(settings, "consumer", "left")
        .where(F.col("max_pct") > F.coalesce("materiality_pct", F.lit(DEFAULT_MATERIALITY_PCT)))
    )
    if noticed is not None:
        due = due.join(noticed, ["cert_id", "new_hash"], "left_anti")
    return due.select("cert_id", "consumer", "new_hash", "max_pct")


def restated_sentences(bindings: DataFrame, old: DataFrame, new: DataFrame, settings: DataFrame) -> DataFrame:
    """Narrative sentences to restate: (cert_id, sentence_no, max_pct).

    bindings(cert_id, sentence_no, consumer, query_ref, shape, scope, as_of). Only the main query's rows were
    stored; any other changed query counts as 100 % and is restated whatever the materiality.
    """
    changes = max_change(diff(old, new, REQUEST), REQUEST)
    main = F.col("query_ref") == "main"
    return (
        bindings.join(changes, REQUEST)
        .join(settings, "consumer", "left")
        .where(~main | (F.col("max_pct") > F.coalesce("materiality_pct", F.lit(DEFAULT_MATERIALITY_PCT))))
        .select("cert_id", "sentence_no", F.when(main, F.col("max_pct")).otherwise(100.0).alias("max_pct"))
    )


def messages(answers: DataFrame, sent: DataFrame, diffs: DataFrame, reason: str, unit: str = "") -> DataFrame:
    """One sentence per notice, about its largest changed cell."""
    numbers = diffs.where(F.col("metric").isNotNull() & F.col("old").isNotNull() & F.col("new").isNotNull())
    top = numbers.groupBy(*REQUEST).agg(
        F.min_by(F.struct("key", "metric", "old", "new"), F.struct((-F.col("pct")).alias("p"), "key", "metric")).alias("c")
    )
    rows = sent.select("cert_id").join(answers.withColumn("as_of", F.to_date("served_at")), "cert_id").join(top, REQUEST, "left")
    verb = F.when(F.col("kind") == "export", "exported").otherwise("answered")
    when = F.concat(F.lit("("), verb, F.lit(" "), F.day("served_at").cast("string"), F.lit(" "), F.date_format("served_at", "MMM"), F.lit(")"))

    def number(c: str) -> Column:
        return F.format_number(F.col(c), 1)

    what = F.concat(F.replace("c.metric", F.lit("_"), F.lit(" ")), F.when(F.col("c.key") != "", F.concat(F.lit(" for "), "c.key")).otherwise(""))
    told = F.concat(what, F.lit(" "), when, F.lit(" changed from "), number("c.old"), F.lit(" to "), number("c.new"), F.lit(f"{unit}. Reason: {reason}."))
    plain = F.concat(F.lit("Your answer "), when, F.lit(f" was restated. Reason: {reason}."))
    return rows.select("cert_id", "consumer", F.coalesce(told, plain).alias("message"))


def inbox(sent: DataFrame) -> DataFrame:
    """Notices and open notices per consumer, from notices with acknowledged_at."""
    return sent.groupBy("consumer").agg(F.count(F.lit(1)).alias("notices"), F.count_if(F.col("acknowledged_at").isNull()).alias("open"))


def exports(answers: DataFrame, sent: DataFrame) -> DataFrame:
    counts = sent.groupBy("cert_id").agg(F.count(F.lit(1)).alias("restated"))
    return answers.where("kind = 'export'").join(counts, "cert_id", "left").select(
        "cert_id", "consumer", "served_at", F.coalesce("restated", F.lit(0)).alias("restated")
    )
