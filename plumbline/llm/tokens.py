"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A text is cut only where the tokenizer itself always cuts, so the ids are those of the uncut text:

- spaces "dropped" (letters are lower-cased, white space is discarded before the words are split): at every run of ASCII
  white space;
- spaces "kept" (a word carries the space before it): before every space and around every newline, in texts
  where no two white-space characters touch. Other texts are encoded whole;
- both: between a letter (of those that normalization leaves single letters) and a full stop or comma.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a worker before it starts afresh, bytes of text taken at a time, new words encoded in one text.
REMEMBERED, SLICE_BYTES, JOINED = 400_000, 8_000_000, 400
#: Letters that stay single letters whatever is done to them: basic Latin and Latin-1.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Two white-space characters (Unicode, and the four separators that only some libraries count), or the cut mark.
_WHOLE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}|\\x{00}"


class Encoder:
    def __init__(self, path: str, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if spaces not in ("kept", "dropped"):
            raise ValueError("spaces is 'kept' or 'dropped'")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaces = spaces
        # the tokens that end a word ("dropped") or begin one with its space ("kept")
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if spaces == "dropped" else t.startswith("\u0120"))]] = True
        self.plain = re.compile(f"{'' if spaces == 'dropped' else ' '}[{_LETTERS}]+").fullmatch
        self.between = " " if spaces == "dropped" else ""
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each plain word has, and all of them. Plain words are encoded many in a text: their ids part where a
        token that only ends (or only begins) a word stands."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        lots = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        found = np.fromiter(chain.from_iterable(self._ids([self.between.join(lot) for lot in lots])), np.uint32)
        edge = np.flatnonzero(self.edge[found])
        ends = edge + 1 if self.spaces == "dropped" else np.append(edge[1:], len(found))
        if len(ends) != len(words) or ends[-1] != len(found):
            raise ValueError("the tokenizer does not part plain words as expected")
        return np.diff(ends, prepend=0), found

    def _learn(self, words: list[str]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self._forget()
        plain, other = [], []
        for w in words:
            if w not in self.place:
                (plain if self.plain(w) else other).append(w)
        if plain or other:
            n, apart = len(self.place), self._ids(other)
            size, found = self._plain_ids(plain)
            self.place.update(zip(plain + other, range(n, n + len(plain) + len(other))))
            ends = self.begin[-1] + np.cumsum(np.concatenate([size, [len(x) for x in apart]]), dtype=np.int64)
            self.begin = np.concatenate([self.begin, ends])
            self.ids = np.concatenate([self.ids, found, np.fromiter(chain.from_iterable(apart), np.uint32)])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.spaces == "dropped":
            apart = pc.replace_substring_regex(pc.ascii_lower(texts), f"([{_LETTERS}])([.,])", r"\1 \2")
            return pc.split_pattern_regex(apart, "[ \t\n\r\x0b\x0c]+")
        marked = pc.replace_substring_regex(texts, r"(\pL)([.,])", "\\1\0\\2")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry than texts)."""
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) if self.spaces == "kept" else np.zeros(len(texts), bool)
        words = self._cut(pc.if_else(pa.array(whole), "", texts))
        first = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        entry = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = self.begin[entry + 1] - self.begin[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat((self.begin[entry] - ends[:-1]).astype(np.int32), size)  # a slice and what is remembered are far below 2^31 ids
        source += np.arange(len(source), dtype=np.int32)
        ids = self.ids[source]
        cuts = ends[first]
        if whole.any():
            apart = dict(zip(np.flatnonzero(whole), self._ids(texts.filter(pa.array(whole)).to_pylist())))
            parts = [np.array(apart[i], np.uint32) if i in apart else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, cuts

    def each(self, texts: pa.Array):
        """The ids of every text in order; a missing text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()).cast(pa.string()) if not pa.types.is_string(texts.type) else texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
            ids, cuts = self._encode(texts.slice(at, end - at))
            for i in range(end - at):
                yield ids[cuts[i] : cuts[i + 1]]
            at = end


_KEPT: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, spaces: str) -> Encoder:
    """One encoder per worker process, so that words are remembered from task to task."""
    if (path, spaces) not in _KEPT:
        _KEPT[path, spaces] = Encoder(path, spaces)
    return _KEPT[path, spaces]
