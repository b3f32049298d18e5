"""Allow and block rules for urls, carried over redirect and canonical-link aliases. DataFrame operations only.

A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins. Urls that redirect to
one another, or name one another as canonical, are aliases: connected components over those edges. A url that no rule fits is
blocked if an alias is blocked by a rule and no alias is allowed by one (explicit allow goes before block); else allowed.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_TAG = "(?is)<(?:link|meta)\\b[^>]*>"
_CANONICAL, _REFRESH = "(?is)\\brel\\s*=\\s*[\"']?canonical\\b", "(?is)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"
_DOTS, _REFERENCE = "/\\.\\.?(/|$)", "&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
_HREF, _TARGET = "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value worked out once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def _resolved(path: Column) -> Column:
    """A path without `.` and `..`: each `..` takes the folder before it away, none goes above the root."""

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(part == ".", kept).otherwise(F.array_append(kept, part))

    parts = F.split(path, "/")
    folders = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    end = F.when(path.rlike("/\\.\\.?$"), "/").otherwise("")  # a dot at the end names a folder
    return F.concat(F.when(F.size(folders) == 1, F.when(end == "", "/").otherwise("")).otherwise(F.array_join(folders, "/")), end)


def _unescaped(html: Column) -> Column:
    """Numeric character references and `&amp;` undone; others stay."""
    refs = F.array_distinct(F.regexp_extract_all(html, F.lit(_REFERENCE), F.lit(0)))

    def step(text: Column, ref: Column) -> Column:
        code = F.regexp_extract(ref, _REFERENCE, 1)
        digits = F.when(F.lower(F.left(code, F.lit(1))) == "x", F.lower(F.substring(code, 2, 8))).otherwise(F.lower(F.conv(code, 10, 16)))
        known = (F.length(digits) <= 5) & (digits != "0")
        sign = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        return F.when(known, F.replace(text, ref, sign)).otherwise(text)

    return F.replace(F.when(F.size(refs) == 0, html).otherwise(F.aggregate(refs, html, step)), F.lit("&amp;"), F.lit("&"))


def url_parts(url: Column) -> Column:
    """struct(host, path, key) of a url.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows up to `?`, `#` or the end;
    both empty without `://` and for null. Key: host, path and query, so that scheme and fragment make no difference; an empty path
    is `/`, and `.` and `..` are resolved in it; null without a host.
    """

    def split(rest: Column) -> Column:
        low = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
        path, query = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, "^[^?#]*(\\?[^#]*)?", 1)
        return F.struct(low.alias("host"), path.alias("path"), query.alias("query"))

    def keyed(p: Column) -> Column:
        path = F.when(p["path"] == "", "/").when(p["path"].rlike(_DOTS), _resolved(p["path"])).otherwise(p["path"])
        key = F.when(p["host"] != "", F.concat(p["host"], path, p["query"]))
        return F.struct(p["host"].alias("host"), p["path"].alias("path"), key.alias("key"))

    at = F.instr(url, F.lit("://"))
    return _let(_let(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(""), split), keyed)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule (then the greatest text); null if none fits."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (u, v) between keys, from each page to its canonical link and its refresh target; null html has none.

    A link may be absolute, scheme-relative, from the root, from the page's folder with any `.` and `..`, or a query or
    fragment alone. Numeric character references and `&amp;` in it are undone.
    """
    found = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(
        F.col("html").rlike(_CANONICAL) | F.col("html").rlike(_REFRESH)
    )
    tags = found.select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    link = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(
        F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1)
    )
    links = tags.select("url", _unescaped(link).alias("link")).where("link <> ''").withColumn("page", url_parts(F.col("url")))
    scheme, at = F.regexp_extract("url", "^(.*?)://", 1), F.col("page")
    folder = F.regexp_replace(F.when(at["path"] == "", "/").otherwise(at["path"]), "[^/]*$", "")
    whole = (
        F.when(F.instr("link", F.lit("://")) > 0, F.col("link"))
        .when(F.startswith("link", F.lit("//")), F.concat(scheme, F.lit(":"), "link"))
        .when(F.startswith("link", F.lit("/")), F.concat(scheme, F.lit("://"), at["host"], "link"))
        .when(F.col("link").rlike("^[?#]"), F.concat(scheme, F.lit("://"), at["host"], at["path"], "link"))
        .otherwise(F.concat(scheme, F.lit("://"), at["host"], folder, "link"))
    )
    return links.select(at["key"].alias("u"), url_parts(whole)["key"].alias("v"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of `pages`, repeated ones included.

    `redirects` (from, to) adds edges to those found in the html. A url that is null or has no `://` has no host, no rule and no
    aliases: it is allowed. Other columns are ignored; an empty table gives no rows. A verdict travels over any number of hops.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), url_parts(F.col(url_col)).alias("at"))
    judged = judged.select("page_id", "at.*", best_rule(F.col("at.host"), F.col("at.path"), rules).alias("best"))
    edges = page_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        told = redirects.select(*(url_parts(F.col(c))["key"].alias(n) for c, n in zip(redirects.columns, "uv")))
        edges = told if edges is None else edges.unionByName(told)
    cols = ["page_id", "host", "path", F.col("best.rule").alias("rule")]
    if edges is None:
        return judged.select(*cols, F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    known = components(edges).withColumn("at", url_parts(F.concat(F.lit("x://"), "node")))
    known = known.select("node", "root", best_rule(F.col("at.host"), F.col("at.path"), rules)["verdict"].alias("own"))
    whole = known.groupBy("root").agg(
        F.coalesce(F.max(F.col("own") == "block"), F.lit(False)).alias("blocked"),
        F.coalesce(F.max(F.col("own") == "allow"), F.lit(False)).alias("allowed"),
    )
    carried = known.join(whole.where("blocked and not allowed"), "root").select(F.col("node").alias("key"), F.lit("block").alias("carried"))
    return judged.join(carried, "key", "left").select(*cols, F.coalesce("best.verdict", "carried", F.lit("allow")).alias("verdict"))
