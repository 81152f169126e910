"""Ids of the tokenizers library, with each distinct pre-token encoded once per worker.

A block of texts is split into the tokenizer's own pre-tokens, each distinct one is looked up, and
those that the worker hasn't met go to the library, many to a call. Ids are gathered by array
operations. The table is bounded and starts anew when full, so memory stays bounded whatever the
vocabulary. Texts of Latin-1 alone are split by a
plain pattern; others by the vocabulary file's pattern, after the library's own normaliser.
Texts that hold a special token's string are encoded whole by the library, as its default says.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

#: The splitting patterns that the two vocabulary files state.
SPLIT = {
    WORD_BPE: r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    BYTE_BPE: r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
}
#: The same over Latin-1, where letters, numbers and white space are few enough to write out.
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SUFFIX, _OTHER = "'(?:s|t|re|ve|m|ll|d)", f"[^{_SPACE}{_LETTER}{_NUMBER}]+"
LATIN = {
    WORD_BPE: f"[{_LETTER}]+|{_SUFFIX}|[{_NUMBER}]|{_OTHER}",
    BYTE_BPE: f" ?[{_LETTER}]+|{_SUFFIX}| ?[{_NUMBER}]+| ?{_OTHER}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+",
}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library gives them."""

    def __init__(self, name: str, most_pieces: int = 400_000):
        from tokenizers import Tokenizer

        self.words, self.most_pieces = name == WORD_BPE, most_pieces
        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.split, self.latin = regex.compile(SPLIT[name]), re.compile(LATIN[name])
        self.beyond = re.compile("[^\x00-\xff]")
        self._forget()
        vocabulary = self.library.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.mark[i] = token.endswith("</w>") if self.words else token.startswith("Ġ")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if self.beyond.search(text) is None:
            return self.latin.findall(text.lower() if self.words else text)
        return self.split.findall(self.library.normalizer.normalize_str(text) if self.words else text)

    def encode_pieces(self, fresh: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pre-tokens in an order of its own, their ids one after another, and how many ids each has.

        Plain words go to the library as one text, which is cut again at the ids that end (or begin) a word.
        """
        plain = [p for p in fresh if (p.isalpha() if self.words else p[0] == " " and p[1:].isalpha())]
        order, ids, lengths = [], [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            found = np.asarray(self.library.encode_batch_fast([(" " if self.words else "").join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.mark[found])
            ends = at + 1 if self.words else np.append(at[1:], len(found))
            if len(ends) == len(some) and (self.words or at[0] == 0):
                order += some
                ids.append(found)
                lengths.append(np.diff(ends, prepend=0))
        if rest := list(set(fresh).difference(order)) if len(order) < len(fresh) else []:
            found = [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)]
            order += rest
            ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        return order, np.concatenate(ids), np.concatenate(lengths)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        if len(self.index) > self.most_pieces:
            self._forget()
        texts = [t.decode("utf-8", "replace") for t in texts]
        special = [any(s in t for s in self.specials) for t in texts]
        split = [[] if x else self.pre_tokens(t) for t, x in zip(texts, special)]
        coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(at < 0)):
            fresh = [pieces[i] for i in new.tolist()]
            order, ids, lengths = self.encode_pieces(fresh)
            first = len(self.index)
            self.index.update(zip(order, range(first, first + len(order))))
            self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids])
            at[new] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        # each pre-token's ids, one after another
        ends = self.ends[at]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        codes = coded.indices.to_numpy()
        n = (ends - starts)[codes]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        raw = self.ids[np.repeat(starts[codes] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        bounds = (4 * upto[np.cumsum([0, *map(len, split)])]).tolist()
        return [self.whole(t) if x else raw[a:b] for t, x, a, b in zip(texts, special, bounds, bounds[1:])]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)


def encoder(name: str) -> Encoder:
    """This worker's encoder; loaded once, kept as long as the worker does nothing else."""
    return kept(("encoder", name), lambda: Encoder(name))
