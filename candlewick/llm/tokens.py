"""Token ids of a public tokenizer file, word by word with a bounded cache.

The word tokenizer drops white space and treats every word on its own, so a word's ids never depend on its
neighbours: each distinct word is encoded once for a worker process. Words outside the plain Latin range go to the
tokenizers library as they are, so that its normalisation is the only one that counts.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points whose lower case, composition and class are the same in every library: printable ASCII, Latin-1 and Latin Extended-A letters but the dotted capital I.
_PLAIN = r"\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ"
_OTHER = re.compile(f"[^{_PLAIN}]|<\\|")
#: The word pattern of the tokenizer file, for plain code points in lower case.
_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_MARK = "\x00"


def _unbyte() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts by a word-BPE file (lower case, white space dropped, words end in a marker).

    cache_words bounds the memory: a full cache is emptied and filled anew, which changes no id.
    """

    def __init__(self, path: str, cache_words: int = 100_000) -> None:
        import tiktoken

        self.path, self.loaded = path, None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = _unbyte()
        ranks, ends = {}, np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            ended = token.endswith("</w>")
            body = token.removesuffix("</w>")
            if token.startswith("<|") and token.endswith("|>") and len(token) > 4:
                continue
            ranks[bytes(back[c] for c in body) + b"\x00" * ended] = i
            ends[i] = ended
        self.vocab_size, self.ends = len(vocab), ends
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.line = vocab["Ċ</w>"]
        self.cache_words = cache_words
        self._reset()

    @property
    def exact(self):
        """The tokenizers library's own, loaded when a text first needs it."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _store(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.index), len(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + k] = lengths
        self.index.update(zip(words, range(n, n + k), strict=True))
        self.used += len(flat)

    def _learn(self, chunks: list[str]) -> None:
        """Stores the ids of chunks without white space."""
        plain = [c for c in chunks if not _OTHER.search(c)]
        if plain:
            pieces = _WORDS.findall("\n".join(plain).lower() + "\n")
            ids = np.array(self.fast.encode_ordinary(_MARK.join(pieces) + _MARK), dtype=np.uint32)
            ends = np.flatnonzero(ids == self.line)
            self._store(plain, ids[ids != self.line], np.diff(ends, prepend=-1) - 1)
        if len(plain) < len(chunks):
            rest = [c for c in chunks if _OTHER.search(c)]
            found = [e.ids for e in self.exact.encode_batch(rest, add_special_tokens=False)]
            self._store(rest, np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64))

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each text has, for texts in which only white space parts chunks."""
        if len(self.index) > self.cache_words:
            self._reset()
        parts = pc.utf8_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.index.get, chunks))
        if None in at:
            self._learn([c for c, i in zip(chunks, at, strict=True) if i is None and c])
            self.index.setdefault("", -1)
            at = list(map(self.index.get, chunks))
        at = np.array(at, dtype=np.int64)
        lengths = np.where(at < 0, 0, self.length[at]).astype(np.int32)
        starts = np.where(at < 0, 0, self.start[at]).astype(np.int64)
        uses = coded.indices.to_numpy(zero_copy_only=False)
        lengths, starts = lengths[uses], starts[uses]
        stops = np.zeros(len(uses) + 1, dtype=np.int64)
        np.cumsum(lengths, out=stops[1:])
        flat = self.flat[np.repeat((starts - stops[:-1]).astype(np.int32 if self.used + stops[-1] < 2**31 else np.int64), lengths) + np.arange(stops[-1], dtype=np.int32)]
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return flat, np.diff(stops[edges])

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), one after the other, and how many each text has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, r"<\||[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_some(texts)
        flat, counts = self._encode_some(pc.if_else(pa.array(whole), "", texts))
        out, counts, at = [], counts.copy(), 0
        for i in np.flatnonzero(whole):
            upto = int(counts[:i].sum()) - sum(len(x) for x in out[1::2])
            out += [flat[at:upto], np.array(self.exact.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)]
            at, counts[i] = upto, len(out[-1])
        return np.concatenate([*out, flat[at:]]), counts

    def encode(self, text: str) -> np.ndarray:
        return self.encode_arrow(pa.array([text]))[0]


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
