"""Whole texts to token ids by the tokenizers library, a word at a time.

The vocabulary's pieces never cross white space, and its normaliser works within words, so a
text's ids are its words' ids in turn. Each distinct word is encoded once: new words share a call,
a space between them, and each id goes to the word that holds the library's own offset of it.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

VOCABULARY = "word_bpe_49k.json"
#: Words kept in memory at most; then the memo starts anew.
MEMO_WORDS = 1_000_000
#: Words of one call.
WORDS_AT_ONCE = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.reset()

    def reset(self) -> None:
        """Forget all words."""
        self.words = pa.array([], pa.large_string())  # in the order of their slots; far smaller than a dict
        self.flat, self.used, self.slots = np.empty(1 << 16, np.uint32), 0, 0
        self.added: list[str] = []
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """Remember words whose ids lie end to end in ids, each up to its stop."""
        s, to = self.slots, self.used + len(ids)
        while s + len(words) > len(self.at):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        while to > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : to] = ids
        self.n[s : s + len(words)] = np.diff(stops, prepend=0)
        self.at[s : s + len(words)] = self.used + stops - self.n[s : s + len(words)]
        self.used, self.slots = to, s + len(words)
        self.added += words

    def _encode_new(self, words: list[str]) -> None:
        # a special token's text may swallow the space beside it: such words go alone
        groups = [[w] for w in words if "<|" in w]
        plain = [w for w in words if "<|" not in w]
        groups += [plain[a : a + WORDS_AT_ONCE] for a in range(0, len(plain), WORDS_AT_ONCE)]
        for group in groups:
            found = self.lib.encode_batch([" ".join(group)], add_special_tokens=False)[0]
            starts = np.cumsum([0, *(len(w) + 1 for w in group[:-1])])
            at = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            counts = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(group))
            self._add(group, np.array(found.ids, np.uint32), np.cumsum(counts))

    def _places(self, words: pa.Array) -> np.ndarray:
        """The slot of each word, those of new ones added."""
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(known.is_null())
        if len(new) and len(self.words) + len(new) > MEMO_WORDS and len(self.words):
            self.reset()
            return self._places(words)
        slots = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        if len(new):
            base, self.added = self.slots, []
            self._encode_new(new.to_pylist())
            added = pa.array(self.added, pa.large_string())
            slots[slots < 0] = base + pc.index_in(new, value_set=added).to_numpy()
            self.words = pa.concat_arrays([self.words, added])
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's offsets in it (one more than texts). Null: empty."""
        raw, off = text_buffer(texts)
        raw = raw.tobytes()
        # without special tokens, neither case nor a space between two pieces matters, and fewer words differ
        if folded := b"<|" not in raw:
            raw = raw.lower()
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(raw))
        if folded:
            texts = pc.replace_substring_regex(texts, r"([a-z])([.,])", r"\1 \2")
        words = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(words.offsets).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        if not len(index):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        slots = self._places(coded.dictionary)
        n, at = self.n[slots][index], self.at[slots][index]
        stops = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=stops[1:])
        ids = self.flat[np.arange(stops[-1]) + np.repeat(at - stops[:-1], n)]
        return ids, stops[bounds - bounds[0]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each text's ids."""
    rows = len(offsets) - 1
    new = offsets + np.arange(rows + 1)
    out = np.empty(len(ids) + rows, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    out[~keep] = end_id
    return out, new
