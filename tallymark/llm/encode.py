"""Whole-text encoding with the tokenizers library, one distinct word at a time.

The word tokenizer drops white space between pieces, so a text's ids are its words' ids put end to end. Each distinct word
of a slice of texts is encoded once, and the words met first are kept per worker up to a fixed number, as one Arrow array
that is searched by hashes. Words of Latin-1 letters, digits and ASCII marks are cut into the tokenizer's pieces here; distinct
pieces, kept in the same way, go through the library's BPE model by the thousand, which ends every piece with a token that
says so and tells pieces apart again. All other words go through the whole tokenizer.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import gather, split_words

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Neither ' nor <: the tokenizer's pattern gives the first a meaning of its own, and its special tokens begin with the second.
_MARKS = r"!-&(-/:;=>?@\[-`{-~"
_PLAIN = rf"^(?:[{_LETTERS}0-9{_MARKS}])+$"
_PIECE = rf"([{_LETTERS}]+|[0-9]|[{_MARKS}]+)"
_END = "</w>"


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, every other byte for a code point from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number of each word, none of which is empty: a polynomial of its bytes. Different words may share one."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    starts, lens = offsets[:-1], np.diff(offsets)
    powers = np.full(int(lens.max()), 0x9E3779B97F4A7C15, np.uint64)
    np.cumprod(powers, out=powers)
    chars = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    chars += np.uint64(1)
    chars *= gather(np.zeros(len(words), np.int64), lens, powers)
    return np.add.reduceat(chars, starts - offsets[0])


class Known:
    """The ids of at most `keep` words, those met first (about 30 bytes each)."""

    def __init__(self, keep: int):
        self.keep = keep
        self.words = pa.array([], pa.string())
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending, and whose they are
        self.at = np.zeros(1, np.int64)  # where the words' ids begin, and the end of the last
        self.pool = np.zeros(0, np.int32)

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place here, or -1. Hashes lead to one place at most, where the words are compared."""
        out = np.full(len(words), -1, np.int64)
        if len(self.order) and len(words):
            own = hashes(words)
            by = np.argsort(own)  # searched in order, they find the memory they need at hand
            at = np.searchsorted(self.hashes, own[by]).clip(max=len(self.order) - 1)
            found = self.hashes[at] == own[by]
            maybe, place = by[found], self.order[at[found]]
            same = np.asarray(pc.equal(words.take(pa.array(maybe)), self.words.take(pa.array(place))))
            out[maybe[same]] = place[same]
        return out

    def add(self, words: pa.Array, flat: np.ndarray, lens: np.ndarray) -> None:
        """Keep new words, whose ids stand in flat end to end, as far as there is room."""
        words = words.slice(0, self.keep - len(self.words))
        if not len(words):
            return
        stops = np.cumsum(lens[: len(words)])
        self.at = np.concatenate([self.at, len(self.pool) + stops])
        self.pool = np.concatenate([self.pool, flat[: stops[-1]]])
        self.words = pa.concat_arrays([self.words, words])
        every = np.concatenate([self.hashes, hashes(words)])
        self.order = np.concatenate([self.order, np.arange(len(self.words) - len(words), len(self.words), dtype=np.int32)])
        by = np.argsort(every, kind="stable")
        self.hashes, self.order = every[by], self.order[by]

    def ids(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct words' ids begin in the pool returned last, and their number; encode: for words not kept."""
        words = words.cast(pa.string())
        at = self.find(words)
        old, new = at >= 0, np.flatnonzero(at < 0)
        starts, lens, pool = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), self.pool
        starts[old], lens[old] = self.at[at[old]], self.at[at[old] + 1] - self.at[at[old]]
        if len(new):
            fresh = words.take(pa.array(new))
            flat, n = encode(fresh)
            starts[new], lens[new] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, flat])
            self.add(fresh, flat, n)
        return starts, lens, pool


class WordEncoder:
    """Ids of texts; at most `keep` distinct words and as many pieces of words stay in memory."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.n_ids = self.whole.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
            raise ValueError("WordEncoder needs a BPE file whose pieces end with </w>")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bare = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=_END))
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters() | {0x20: 0x20}
        self.ends = np.zeros(self.n_ids, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(_END)]] = True
        self.known, self.known_pieces = Known(keep), Known(keep)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces end to end, and each piece's number of ids."""
        text = b" ".join(pieces.cast(pa.binary()).to_pylist()).decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain words' ids end to end and each word's number of ids."""
        words = pc.utf8_lower(words)
        mixed = pc.invert(pc.utf8_is_alpha(words))
        spaced = pc.replace_with_mask(words, mixed, pc.replace_substring_regex(words.filter(mixed), _PIECE, r"\1 "))
        pieces, codes, ends = split_words(spaced)
        starts, lens, pool = self.known_pieces.ids(pieces, self._encode)
        return _put(starts, lens, pool, codes, ends)

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = np.asarray(pc.match_substring_regex(words, _PLAIN))
        n = np.zeros(len(words), np.int64)
        ids, n[plain] = self._pieces(words.filter(pa.array(plain)))
        if plain.all():
            return ids, n
        rest = [e.ids for e in self.whole.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        n[~plain] = [len(x) for x in rest]
        starts = np.zeros(len(words), np.int64)
        starts[plain] = np.cumsum(n[plain]) - n[plain]
        starts[~plain] = len(ids) + np.cumsum(n[~plain]) - n[~plain]
        return gather(starts, n, np.concatenate([ids, np.fromiter((i for x in rest for i in x), np.int32)])), n

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's number of ids."""
        words, codes, ends = split_words(text)
        starts, lens, pool = self.known.ids(words, self._fresh)
        return _put(starts, lens, pool, codes, ends)


def _put(starts: np.ndarray, lens: np.ndarray, pool: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (codes) end to end, and how many each text has; ends: of the texts in the words."""
    per_word = lens[codes]
    upto = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], ends])]
    return gather(starts[codes], per_word, pool), np.diff(upto)


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with end_id after each text's own."""
    out = np.full(len(ids) + len(lens), end_id, ids.dtype)
    own = np.ones(len(out), bool)
    own[np.cumsum(lens) + np.arange(len(lens))] = False
    out[own] = ids
    return out


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The one encoder of this process; tasks that follow each other in a worker share what it knows."""
    return WordEncoder(path)
