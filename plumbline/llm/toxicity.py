"""Toxicity from a learned lexicon, matched through a Levenshtein automaton, scored in context.

Lexicon: words, and stems (first letters of words), that are many times as frequent in toxic documents as in clean ones. It is
kept as a trie. The automaton of all words within one edit of a lexicon entry is built over the trie lazily: a state is a set
of (trie node, edits so far), a step is remembered once taken, so that a text's words run through a plain table.

Context: hits inside a pair of quotation marks (on one line, not too far apart) or next to a reporting verb count as quoted, the others as open. A logistic model over
both kinds (weights, distinct entries, density, hits close together, address in the second person) tells abuse from quotation.

The model is fitted in one task on bounded samples of labelled documents (TOXIC and CLEAN); scoring reads every text whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence, Set
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, small_side
from plumbline.llm.quality import score_texts, training_sample

TOXIC, CLEAN = 1500, 3000
#: Shortest stem, longest stem, shortest entry that may be misspelt, words on either side that make a context.
STEM, LONG_STEM, MISSPELT, WINDOW = 3, 8, 5, 6
WORD = re.compile(r"[^\W_]+(?:['’@$*!][^\W_]+)*")
QUOTES = re.compile("[\"“”«»„‟\n]")
#: Longest quotation, in characters.
QUOTATION = 600
REPORTING = frozenset("said says wrote writes quoted quote called asked dit écrit cité sagte schrieb zitiert dijo escribió citó".split())
ADDRESS = frozenset("you your u du dich dir ihr tu te toi vous tú vosotros usted".split())


class Lexicon:
    """A trie of entries (text, is_stem) with the automaton of what lies within one edit of them."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        for k, (text, stem) in enumerate(entries):
            node = 0
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word_at.append(-1)
                    self.stem_at.append(-1)
                node = self.children[node][ch]
            (self.stem_at if stem else self.word_at)[node] = k
        self._number: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: list[dict[str, int]] = []
        self._stem: list[tuple[int, int] | None] = []
        self._word: list[tuple[int, int] | None] = []
        self._start = self._state({(0, 0)})

    def _accepts(self, found: set, at: list[int]) -> tuple[int, int] | None:
        hits = [(e, at[n]) for n, e in found if at[n] >= 0 and (not e or len(self.entries[at[n]][0]) >= MISSPELT)]
        return min(hits) if hits else None

    def _state(self, found: set) -> int:
        found = set(found)
        for n, e in list(found):  # a letter left out
            if not e:
                found |= {(c, 1) for c in self.children[n].values()}
        found = {(n, e) for n, e in found if not e or (n, 0) not in found}
        key = frozenset(found)
        if key not in self._number:
            self._number[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            self._stem.append(self._accepts(found, self.stem_at))
            self._word.append(self._accepts(found, self.word_at))
        return self._number[key]

    def _step(self, state: int, ch: str) -> int:
        after = set()
        for n, e in self._sets[state]:
            if ch in self.children[n]:
                after.add((self.children[n][ch], e))
            if not e:
                after |= {(c, 1) for c in self.children[n].values()} | {(n, 1)}  # another letter, or one too many
        out = self._state(after) if after else -1
        self._steps[state][ch] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry: a whole word, or the stem that the word begins with; None beyond one edit."""
        state, best = self._start, None
        for ch in word:
            to = self._steps[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state < 0:
                return best
            stem = self._stem[state]
            if stem and (best is None or stem < best):
                best = stem
                if not stem[0]:
                    return best
        whole = self._word[state]
        return min(whole, best) if whole and best else whole or best


def learn_entries(toxic: Sequence[Set[str]], clean: Sequence[Set[str]]) -> list[tuple[str, bool]]:
    """Words and stems that are surely (two standard errors off) four times as frequent in toxic documents as in clean ones, and
    in one in a hundred toxic ones and three at least.

    A stem gives way to a longer one that is nearly as frequent (97 in 100) and about as telling, in the end to the whole word;
    to all its longer ones if one of them is more telling; else it stands for them.
    """

    def terms(words: Set[str]) -> set[tuple[str, bool]]:
        return {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(STEM, min(LONG_STEM, len(w) - 1) + 1)}

    often = Counter(t for d in toxic for t in terms(d))
    least = max(3, len(toxic) / 100)
    often = {t: n for t, n in often.items() if n >= least}
    calm = Counter(t for d in clean for t in terms(d) if t in often)

    def surely(n: float, c: float) -> float:
        return np.log((n / (len(toxic) + 1)) / (c / (len(clean) + 1))) - 2 * (1 / n + 1 / c) ** 0.5

    score = {t: surely(n + 0.5, calm[t] + 0.5) for t, n in often.items()}
    score = {t: x for t, x in score.items() if x >= np.log(4)}
    longer: dict[str, list[tuple[str, bool]]] = {}
    roots = []
    for t in score:
        text, stem = t
        shorter = [text[:k] for k in range(len(text) - stem, STEM - 1, -1)][: 1 if stem else None]
        parent = next((p for p in shorter if p and (p, True) in score and (p, True) != t), None)
        (roots if parent is None else longer.setdefault(parent, [])).append(t)
    chosen, todo = set(), roots
    while todo:
        t = todo.pop()
        kids = longer.get(t[0], []) if t[1] else []
        near = [k for k in kids if often[k] >= 0.97 * often[t] and score[k] >= score[t] - 0.1]
        if near:
            todo.append(max(near, key=lambda k: (not k[1], often[k], k)))
        elif kids and max(score[k] for k in kids) > score[t]:
            todo += kids
        else:
            chosen.add(t)
    return sorted(chosen)


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Where quotations begin and end: pairs of marks on one line, at most QUOTATION characters apart.

    A mark may begin one if no word ends and no space follows there, and end one if no space comes before it; a mark that may begin one
    takes the place of an earlier one left open. So an inch mark or a lost quotation mark changes nothing after it.
    """
    begins, ends, opened = [], [], None
    for m in QUOTES.finditer(text):
        at = m.start()
        if m.group() == "\n":
            opened = None
            continue
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if opened is not None and before and not before.isspace() and at - opened <= QUOTATION and at > opened + 1:
            begins.append(opened)
            ends.append(at)
            opened = None
        elif after and not after.isspace() and not before.isalnum():
            opened = at
    return begins, ends


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    weight: np.ndarray  # by entry and edits
    beta: np.ndarray
    scale: np.ndarray
    lexicon: Lexicon = field(init=False, repr=False)

    def __post_init__(self):
        self.lexicon = Lexicon(self.entries)

    def __reduce__(self):
        return (Model, (self.entries, self.weight, self.beta, self.scale))

    def hits(self, low: str) -> list[tuple[int, int, int, str]]:
        """(word number, place in the text, entry * 2 + edits, word) of each hit in a lower-cased text."""
        match = self.lexicon.match
        found = {w: m for w in set(WORD.findall(low)) if (m := match(w))}
        if not found:
            return []
        return [(k, m.start(), 2 * found[w][1] + found[w][0], w) for k, m in enumerate(WORD.finditer(low)) if (w := m.group()) in found]

    def features(self, text: str) -> np.ndarray:
        low = text.lower()
        out = np.zeros(7)
        hits = [h for h in self.hits(low) if self.weight[h[2]] > 0]
        if not hits:
            return out
        words = WORD.findall(low)
        begins, ends = quotations(low)
        open_, quoted = {}, {}
        close = said_you = 0
        places = [h[0] for h in hits]
        for i, (k, at, code, _) in enumerate(hits):
            around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            last = bisect_left(begins, at) - 1
            inside = last >= 0 and at < ends[last]
            kind = quoted if inside or not REPORTING.isdisjoint(around) else open_
            kind[code // 2] = max(kind.get(code // 2, 0.0), float(self.weight[code]))
            close += i > 0 and k - places[i - 1] <= WINDOW
            said_you += not ADDRESS.isdisjoint(around)
        out[0], out[1] = sum(open_.values()), sum(quoted.values())
        out[2], out[3] = len(open_), len(quoted)
        out[4] = np.log1p(100 * len(hits) / max(1, len(words)))
        out[5], out[6] = np.log1p(close), np.log1p(said_you)
        return out

    def score(self, raw: bytes) -> float:
        z = self.beta[0] + self.beta[1:] @ (self.features(raw.decode("utf-8", "replace")) / self.scale)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], labels: list[int], odds: float | None = None) -> Model:
    """`odds`: toxic to clean among all labelled documents, where the sample was not drawn evenly. Without both classes the
    lexicon is empty and the score is the share of toxic documents, half a document added to each class."""
    y = np.array(labels, float)
    ones = y.sum()
    bags = [set(WORD.findall(t.lower())) for t in texts]
    if not 0 < ones < len(y):
        return Model([], np.zeros(0), np.array([np.log((ones + 0.5) / (len(y) - ones + 0.5)), *[0.0] * 7]), np.ones(7))
    # copies of a document tell nothing more about its words
    toxic, clean = (list({x: b for x, b, t in zip(texts, bags, labels) if t == k}.values()) for k in (1, 0))
    entries = learn_entries(toxic, clean)
    model = Model(entries, np.zeros(2 * len(entries)), np.zeros(8), np.ones(7))
    seen = np.zeros((2, max(1, 2 * len(entries))))
    for bag, t in zip(bags, labels):
        codes = {2 * m[1] + m[0] for w in bag if (m := model.lexicon.match(w))}
        seen[int(t), list(codes)] += 1
    ratio = ((seen[1] + 0.5) / (ones + 1)) / ((seen[0] + 0.5) / (len(y) - ones + 1))
    model.weight = np.where(seen.sum(0) >= 2, np.maximum(0, np.log(ratio)), 0)[: 2 * len(entries)]
    # an edit never seen in training weighs half of the exact entry, unless it was seen in clean documents
    exact = model.weight[0::2]
    model.weight[1::2] = np.where(seen[:, 1 : 2 * len(entries) : 2].sum(0) == 0, exact / 2, np.minimum(model.weight[1::2], exact))
    x = np.array([model.features(t) for t in texts])
    model.scale = np.maximum(x.max(0), 1e-9)
    x = np.hstack([np.ones((len(x), 1)), x / model.scale])
    beta = np.zeros(8)
    ridge = np.array([1e-6, *[1e-2] * 7])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(8), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    if odds:
        beta[0] += np.log(odds) - np.log(ones / (len(y) - ones))
    model.beta = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Train on the samples' whole texts, in one task; the lexicon and a few weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[2] or ""))
        m = train([r[2] or "" for r in rows], [r[1] for r in rows], rows[0][3] if rows else None)
        kinds = [pa.list_(pa.string()), pa.list_(pa.bool_()), *[pa.list_(pa.float64())] * 3]
        cols = [[e for e, _ in m.entries], [s for _, s in m.entries], m.weight.tolist(), m.beta.tolist(), m.scale.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], names=["entries", "stems", "weight", "beta", "scale"])

    ones, zeros = (labels.where(F.col("toxic") == k) for k in (1, 0))
    sample = training_sample(ones, "toxic", toxic).unionByName(training_sample(zeros, "toxic", clean))
    once = sample.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("m")).where("label = m").drop("m")
    n1, n0 = (x.where(~held_out("doc_id")).count() for x in (ones, zeros))
    once = once.withColumn("odds", F.lit(n1 / n0 if n1 and n0 else None).cast("double"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(once, toxic + clean), "doc_id")
    row = text.select("doc_id", "label", "text", "odds").repartition(1)
    row = row.mapInArrow(run, "entries array<string>, stems array<boolean>, weight array<double>, beta array<double>, scale array<double>").first()
    if not row:
        return train([], [])
    return Model(list(zip(row["entries"], row["stems"])), *(np.array(row[c], float) for c in ("weight", "beta", "scale")))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of `docs`.

    Null and empty texts get the score of a text without hits. Without labels the score is 0.5. Other columns are ignored.
    """
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
