"""Token ids of whole texts by a public word-level BPE tokenizer.

The tokenizer drops white space and never joins across it, so a text's ids are
its words' ids one after the other. Each task encodes a word once and keeps its
ids; the words of common shape (Latin letters, then ASCII signs) skip the
tokenizer's normalizer, whose work on them is lower-casing.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from tabscore.llm.words import words_of

KEPT_WORDS = 1_000_000  # words whose ids a task keeps; beyond it starts anew
# Letters whose lower case and normal form are a letter of the same kind, then signs that one pattern takes whole.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path() -> str:
    """The public word-level BPE file, where its package is installed on each machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words, filled as words come."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.part = Tokenizer(self.whole.model)  # of one letter run or sign run, lower-cased
        self.part.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        suffix = self.whole.model.end_of_word_suffix or "</w>"
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for token, i in self.whole.get_vocab().items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _encode_parts(self, parts: list[str]) -> list[list[int]]:
        """The ids of each letter or sign run, which end at the ids that mark a word's end."""
        if not parts:
            return []
        ids = self.part.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(parts):
            return [x.ids for x in self.part.encode_batch(parts, add_special_tokens=False)]
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _add(self, hashes: list[int], words: list[str]) -> None:
        parts: dict[str, int] = {}
        plan: list[tuple[int, ...] | None] = []
        for word in words:
            found = PLAIN.fullmatch(word)
            if found is None:
                plan.append(None)
                continue
            letters, signs = found[1].lower(), found[2]
            own = (parts.setdefault(letters, len(parts)),)
            plan.append((*own, parts.setdefault(signs, len(parts))) if signs else own)
        ids = self._encode_parts(list(parts))
        for h, word, own in zip(hashes, words, plan, strict=True):
            if own is None:
                new = self.whole.encode(word, add_special_tokens=False).ids
            else:
                new = [i for p in own for i in ids[p]]
            n = len(self.index)
            if n == len(self.begin):
                self.begin, self.length = np.resize(self.begin, 2 * n), np.resize(self.length, 2 * n)
            while self.used + len(new) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.begin[n], self.length[n] = self.used, len(new)
            self.flat[self.used : self.used + len(new)] = new
            self.used += len(new)
            self.index[h] = n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (and the last ends)."""
        words = words_of(texts)
        codes, unique = pd.factorize(words.hashes)
        if len(self.index) + len(unique) > KEPT_WORDS:
            self.clear()
        at = [self.index.get(h) for h in unique.tolist()]
        missing = [i for i, x in enumerate(at) if x is None]
        if missing:
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            spots = first[missing]
            raw = words.data.tobytes()
            texts_of = [raw[a:b].decode() for a, b in zip(words.starts[spots].tolist(), words.ends[spots].tolist(), strict=True)]
            self._add([int(unique[i]) for i in missing], texts_of)
            at = [self.index[h] for h in unique.tolist()]
        where = np.array(at, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        lengths = self.length[where]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        spread = np.repeat(self.begin[where] - (ends - lengths), lengths) + np.arange(total)
        edges = np.concatenate([[0], ends])[words.first]
        return self.flat[spread], edges


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each task process."""
    return WordIds(path)
