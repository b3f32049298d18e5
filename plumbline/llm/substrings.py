"""Remove passages that repeat across documents, found by doubling the length of what is compared.

Level 1 looks at spans of half the window (25 words). Not all of them: of the 26 that start in a window of 50 words, the one
with the least hash. A window that two documents share selects the same span in both, so each is found from a fourteenth of
the spans. Spans seen in one document alone are dropped. Level 2 takes the survivors to twice the length and more: the words
of all windows that selected a span, hashed together. Where those words occur in an earlier document, all their windows do.
A document states each such surrounding once, with all its places, so that text which repeats itself has no more of them than differ.
Long passages are met first, as blocks of about BLOCK spans that begin where the span's hash says so: the spans of a block whose
words occur in an earlier document need no looking at.
Where one span has several surroundings, the first document of each surrounding goes to the last level: its windows of 50
words one by one. No pair of documents is ever formed; equal passages meet under one hash and are reduced to the smallest id.

Spans are chosen by 64-bit hashes; what is removed rests on 128-bit digests of the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, lean, modest, small_side, utf8
from plumbline.llm.words import Words
from plumbline.session import discard, settle

WINDOW = 50
#: Spans in a block, on average.
BLOCK = 6
_PLACES = pa.list_(pa.int32())
_SPANS = {"span": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "a": pa.int32(), "b": pa.int32(), "more": _PLACES, "block": pa.int32()}
_BLOCKS = {"k1": pa.int64(), "k2": pa.int64(), "x": pa.int32(), "y": pa.int32()}
_NAMES = {pa.int64(): "long", pa.int32(): "int", _PLACES: "array<int>"}
_SCAN = "doc_id long, tag long, n_words long, sha256 string, " + ", ".join(f"{n} array<{_NAMES[k]}>" for n, k in (_SPANS | _BLOCKS).items())


def _tag(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _selected(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each selected span: its hash, and the first and last window start that selected it."""
    half = window // 2
    g = w.grams(half)
    seen = np.lib.stride_tricks.sliding_window_view(g, window - half + 1)
    at = seen.argmin(1) + np.arange(len(seen))
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut])
    return g[at[first]], first, np.concatenate([cut - 1, [len(at) - 1]])


def _lists(flat: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), kind))


def _nested(lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """For each document the further places of its surroundings, null where there are none: from (places, how many)."""
    n = np.concatenate([n for _, n in lists]) if lists else np.zeros(0, np.int64)
    places = np.concatenate([v for v, _ in lists]) if lists else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(places, pa.int32()), mask=pa.array(n == 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(n) for _, n in lists])]).astype(np.int32)), inner)


def _once(h: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, block: np.ndarray) -> tuple:
    """Each surrounding of a document once, with all its places: text that repeats itself selects one span over and over.

    Places beyond the first are a list of first and last starts in turn. A surrounding that has them has block -1, as they lie in several.
    """
    order = np.lexsort((c[:, 1], c[:, 0]))
    new = np.concatenate([[True], (np.diff(c[order], axis=0) != 0).any(1)])
    first, rest = order[new], order[~new]
    further = 2 * (np.diff(np.append(np.flatnonzero(new), len(order))) - 1)
    more = np.stack([a[rest], b[rest]], 1).ravel()
    return h[first], c[first, 0], c[first, 1], a[first], b[first], (more, further), np.where(further > 0, -1, block[first])


def _every(name: str, place: int) -> Column:
    """All first (place 0) or last (place 1) starts of a row's surroundings."""
    own = F.array(name)
    return F.when(F.col("more").isNull(), own).otherwise(F.concat(own, F.filter("more", lambda _, i: i % 2 == place)))


def scan_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document with its word count, the hash of its words, and its selected spans; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in lean(batches):
            ids = batch.column(0).to_pylist()
            plain, spans = [], []
            for doc, raw in zip(ids, batch.column(1)):
                w = Words(raw.as_py())
                sha = hashlib.sha256(w.line)
                plain.append((_tag(sha.digest()), w.n, sha.hexdigest()))
                if w.n < window or doc is None:
                    spans.append((*(none,) * 5, (none, none), *(none,) * (1 + len(_BLOCKS))))
                    continue
                h, a, b = _selected(w, window)
                c = np.array([w.digest(x, y + window - 1) for x, y in zip(a.tolist(), b.tolist())], np.int64)
                begins = h % np.uint64(BLOCK) == 0
                begins[0] = True
                at = np.flatnonzero(begins)
                x, y = a[at], b[np.append(at[1:], len(a)) - 1] + window
                k = np.array([w.digest(i, j - 1) for i, j in zip(x.tolist(), y.tolist())], np.int64)
                spans.append((*_once(h.view(np.int64), c, a, b, np.cumsum(begins) - 1), k[:, 0], k[:, 1], x, y))
            tags, n, sha = zip(*plain) if plain else ((), (), ())
            cols = [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())]
            for k, kind in enumerate((_SPANS | _BLOCKS).values()):
                own = [s[k] for s in spans]
                cols.append(_nested(own) if kind == _PLACES else _lists(own, kind))
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SCAN.split(", ")])

    return settle(modest(docs).select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, _SCAN), "spans")


def _of_text(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Texts next to the ranges kept for their documents; other texts do not leave the scan if those documents are few enough to
    broadcast their ids."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    ids = settle(per_doc.select("doc_id").distinct(), "ids")
    text = text.join(small_side(ids, ids.count()), "doc_id", "left_semi")
    return text.join(per_doc, "doc_id").select("doc_id", "tag", "text", "x", "y")


def _ranges(df: DataFrame) -> DataFrame:
    """The ranges of a document in one row, from lists of them: no more than its own windows."""
    kept = df.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("x", "y")).alias("r"))
    return kept.select("doc_id", "tag", F.flatten("r.x").alias("x"), F.flatten("r.y").alias("y"))


def repeated_ranges(docs: DataFrame, scan: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, tag, x, y) with the lists of word ranges [x, y) that also start in a document with a smaller id; stored."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out = []
            for doc, tag, raw, x, y in zip(*batch.columns):
                doc, tag, raw, x, y = (v.as_py() for v in (doc, tag, raw, x, y))
                w = Words(raw)
                if _tag(hashlib.sha256(w.line).digest()) == tag:
                    starts = np.unique(np.concatenate([np.arange(i, j + 1) for i, j in zip(x, y)])).tolist()
                    out += [(doc, tag, i, *w.digest(i, i + window - 1)) for i in starts]
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "tag", "x", "c1", "c2"])

    blocks = scan.select("doc_id", "tag", F.posexplode(F.arrays_zip(*_BLOCKS)).alias("block", "at")).select("doc_id", "tag", "block", "at.*")
    again = blocks.groupBy("k1", "k2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("n")).where("earliest < n").drop("n")
    done = settle(blocks.join(settle(again, "again"), ["k1", "k2"]).where("doc_id > earliest").select("doc_id", "tag", "block", "x", "y"), "blocks")
    known = small_side(done.select("doc_id", "tag", "block"), done.count())
    spans = scan.select("doc_id", "tag", F.inline(F.arrays_zip(*_SPANS))).join(known, ["doc_id", "tag", "block"], "left_anti").drop("block")
    # stored apart, so that Spark can split the join where a span is in very many documents
    shared = settle(spans.groupBy("span").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("n")).where("m < n").select("span"), "shared")
    level1 = settle(spans.join(shared, "span", "left_semi"), "level1")
    around = settle(level1.groupBy("span", "c1", "c2").agg(F.min("doc_id").alias("earliest")), "level2")
    several = around.groupBy("span").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("span", F.lit(True).alias("several"))
    level2 = level1.join(around.join(several, "span", "left"), ["span", "c1", "c2"])
    whole = level2.where("doc_id > earliest").select("doc_id", "tag", _every("a", 0).alias("x"), F.transform(_every("b", 1), lambda v: v + window).alias("y"))
    single = level2.where("doc_id = earliest and several").select("doc_id", "tag", _every("a", 0).alias("x"), _every("b", 1).alias("y"))
    single = settle(_ranges(single), "level3")
    level3 = settle(_of_text(docs, single).mapInArrow(windows, "doc_id long, tag long, x int, c1 long, c2 long"), "windows")
    least = level3.groupBy("c1", "c2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("n")).where("earliest < n")
    ones = level3.join(least, ["c1", "c2"]).where("doc_id > earliest").select("doc_id", "tag", F.array("x").alias("x"), F.array(F.col("x") + window).alias("y"))
    found = settle(_ranges(whole.unionByName(ones).unionByName(done.select("doc_id", "tag", F.array("x").alias("x"), F.array("y").alias("y")))), "ranges")
    discard(done, shared, level1, around, single, level3)
    return found


def _keep(w: Words, x: list[int], y: list[int]) -> tuple[int, bytes]:
    """How many words the ranges cover, and the others joined by one space."""
    edge = np.zeros(w.n + 1, np.int64)
    np.add.at(edge, x, 1)
    np.add.at(edge, y, -1)
    stay = np.cumsum(edge[:-1]) == 0
    words = w.line.split(b" ")
    return w.n - int(stay.sum()), b" ".join(words[i] for i in np.flatnonzero(stay))


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of `docs`.

    A null or empty text has no words. A row without id takes no part: it loses nothing and makes no other lose. Rows with equal
    ids do not make each other lose words. Other columns are ignored; an empty table gives no rows.
    """
    scan = scan_documents(docs, window)
    found = repeated_ranges(docs, scan, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out = []
            for doc, tag, raw, x, y in zip(*batch.columns):
                doc, tag, raw, x, y = (v.as_py() for v in (doc, tag, raw, x, y))
                w = Words(raw)
                if _tag(hashlib.sha256(w.line).digest()) == tag:
                    gone, kept = _keep(w, x, y)
                    out.append((doc, w.n, gone, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    rest = scan.join(small_side(found.select("doc_id", "tag"), found.count()), ["doc_id", "tag"], "left_anti")
    rest = rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    changed = _of_text(docs, found).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return rest.unionByName(changed)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words cut out of `text` (the others joined by one space) and `n_chars` counted anew, where
    there is such a column. Texts that lose nothing stay as they are, null ones too; no row is dropped; other columns stay."""
    scan = scan_documents(docs, window)
    found = repeated_ranges(docs, scan, window)
    discard(scan)
    key, cuts = fresh("cut_doc", docs), fresh("cuts", docs)
    per_doc = found.select(F.col("doc_id").alias(key), F.struct("tag", "x", "y").alias("cut"))
    per_doc = settle(per_doc.groupBy(key).agg(F.collect_list("cut").alias(cuts)), "cuts")
    ids = small_side(per_doc.select(key), per_doc.count())
    here = docs["doc_id"].cast("long") == F.col(key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            texts = []
            for text, all_cuts in zip(batch.column("text"), batch.column(cuts)):
                text = text.as_py()
                w = Words((text or "").encode())
                tag = _tag(hashlib.sha256(w.line).digest())
                for c in all_cuts.as_py():
                    if c["tag"] == tag:
                        text = _keep(w, c["x"], c["y"])[1].decode()
                texts.append(text)
            names = [n for n in batch.schema.names if n != cuts]
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    touched = docs.join(ids, here, "left_semi").join(per_doc, here).drop(key).mapInArrow(cut, docs.schema)
    out = docs.join(ids, here, "left_anti").unionByName(touched)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.char_length("text").cast(kind))
