"""Exact ids of a public tokenizer for many texts, with a memory of words already met."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

#: Words of these characters are split as the tokenizer's own pattern splits them (letters of two Latin blocks, all in
#: composed form, whose lower case is one character); any other word goes to the library as a whole.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]+")
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įĲ-ſ]+|[0-9]|[^a-zß-öø-įĲ-ſ0-9]+")
#: Lower-case letters of ASCII and the Latin-1 block in UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordEncoder:
    """Encodes texts with a word-end BPE tokenizer (lower case, white space dropped) exactly as the library does.

    Such a tokenizer never joins what white space separates, so a text's ids are those of its words, one after the other;
    ASCII white space is used, which every version of the pattern agrees on. Words and the units below them (runs of
    letters, single digits, runs of other characters) are kept with their ids up to a bounded number, so the library meets
    each new unit once. Special tokens are found before lower-casing, so words that may hold one keep their case.
    ``pieces`` also has the tokens' texts for decoding.
    """

    def __init__(self, path: str, words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = words
        self.words: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        # a letter run, digit or run of others ends with the one token that carries the word end
        self.ends = np.array([p.endswith(b"</w>") for p in self.pieces])

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_units(self, new: list[bytes]) -> None:
        """Encode new units, many in one text; their ids are told apart by the word-end tokens."""
        groups = [new[at:at + 64] for at in range(0, len(new), 64)]
        found = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found):
            ids = np.array(e.ids, dtype="<u4")
            last = (np.flatnonzero(self.ends[ids]) + 1).tolist() if len(ids) else []
            if len(last) == len(group):
                raw = ids.tobytes()
                self.words.update(zip(group, [raw[4 * a:4 * b] for a, b in zip([0, *last], last)]))
            else:
                self.words.update(zip(group, self._library([u.decode() for u in group])))

    def _learn(self, new: set[bytes]) -> None:
        known, letters = self.words, _LETTERS.fullmatch
        units = {w for w in new if w.isalpha() or letters(w)}
        split: dict[bytes, list[bytes]] = {}
        whole = []
        for w in new - units:
            s = w.decode()
            if not _PLAIN.fullmatch(s) or "<|" in s:
                whole.append(w)
            else:
                split[w] = parts = [u.encode() for u in _UNITS.findall(s.lower())]
                units.update(parts)
        self._learn_units(list(units - known.keys()))
        known.update({w: b"".join([known[p] for p in parts]) for w, parts in split.items()})
        known.update(zip(whole, self._library([w.decode() for w in whole])))

    @staticmethod
    def _words(texts: Sequence[bytes]) -> list[list[bytes]]:
        """Words of each text in lower case; those that may hold a special token as they are.

        A stop or comma between a letter and white space is a unit of its own, so it is taken apart here.
        """
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
        at = np.flatnonzero((raw == 46) | (raw == 44))
        at = at[at > 0]
        before, after = raw[at - 1], raw[at + 1]
        at = at[(before >= 97) & (before <= 122) & ((after == 32) | (after == 10))]
        apart = np.insert(raw, at, 32).tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        ends = (ends + np.searchsorted(at, ends)).tolist()
        return [apart[a:b].split() if b"<|" not in t else [w if b"<|" in w else w.lower() for w in t.split()] for t, a, b in zip(texts, [0, *ends], ends)]

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        known = self.words
        if len(known) > self.limit:
            known.clear()
        words = self._words(texts)
        missing = {w for ws in words for w in ws if w not in known}
        if missing:
            self._learn(missing)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """What the library's decode gives for such a tokenizer: the tokens with spaces between them."""
        return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def word_bpe_path() -> str:
    """The public word-end vocabulary installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
