"""Token ids of Arrow text columns by the tokenizers library, each distinct word encoded once per task.

The library's result for a text is the concatenation of its results for the text's units, since its normalizers
and splitting rules never look past a unit's ends: for vocabularies that drop white space a unit is a word, for
byte-level ones a word with the blanks before it, or the blanks that end a text. A text that holds white space
other than 0x09-0x0D and 0x20 is encoded whole by byte-level vocabularies, whose rules join it with blanks.

Where the splitting rule parts letters from punctuation, the stops that end a word are a unit of their own, and where
texts are lower-cased anyway units are hashed in lower case: fewer units are new. New units of letters alone are
passed to the library many to a text, and their ids are told apart by the vocabulary's marks of word ends.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache

import numpy as np

from gaugewell.llm import words as W

#: White space outside ASCII, in UTF-8 (fixed by Unicode).
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
CACHE_UNITS = 1_000_000
#: Texts per call of the library, whose results take some hundred bytes a text beside the ids.
CALL_TEXTS = 2048
#: Units of letters in one text of a call.
JOINED = 64
#: The splitting rule under which a letter or digit and the stops after it are apart (a fixed value of the vocabulary).
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = re.compile(r"[a-z]+")
STOP, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
STOP[list(b".,;:!?")] = True
PLAIN[list((string.ascii_letters + string.digits).encode())] = True


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes blocks of texts; keeps the ids of at most about :data:`CACHE_UNITS` distinct units."""

    def __init__(self, name: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocabulary_path(name) if not os.path.isabs(name) else name
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.attached = self.library.normalizer is None
        self.size = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.lowers = {"type": "Lowercase"} in ((rules["normalizer"] or {}).get("normalizers") or [])
        self.parts = self.lowers and PARTING in [(x.get("pattern") or {}).get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers") or []]
        mark, known = rules["model"].get("end_of_word_suffix"), self.library.get_vocab()
        #: Whether an id ends a word, where every word of letters has just one such id.
        self.ends_word = None
        if self.parts and mark and all(letter + mark in known for letter in string.ascii_lowercase):
            self.ends_word = np.zeros(self.size, bool)
            self.ends_word[[i for token, i in known.items() if token.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.lengths, self.store = np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their numbers, by the library alone."""
        ids, lengths = [np.zeros(0, np.uint32)], []
        for first in range(0, len(texts), CALL_TEXTS):
            found = [x.ids for x in self.library.encode_batch_fast(texts[first : first + CALL_TEXTS], add_special_tokens=False)]
            lengths += map(len, found)
            ids.append(np.fromiter((i for own in found for i in own), np.uint32, sum(map(len, found))))
        return np.concatenate(ids), np.array(lengths, np.int64)

    def fresh_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`direct` gives, with units of letters joined into longer texts."""
        if self.ends_word is None:
            return self.direct(texts)
        plain = [i for i, text in enumerate(texts) if LETTERS.fullmatch(text)]
        ids, _ = self.direct([" ".join(texts[i] for i in plain[first : first + JOINED]) for first in range(0, len(plain), JOINED)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(plain):
            return self.direct(texts)
        others = np.setdiff1d(np.arange(len(texts)), plain)
        more, sizes = self.direct([texts[i] for i in others.tolist()])
        lengths = np.zeros(len(texts), np.int64)
        lengths[plain], lengths[others] = np.diff(ends, prepend=0), sizes
        every, at = np.empty(len(ids) + len(more), np.uint32), np.cumsum(lengths) - lengths
        every[W.ragged(at[plain], lengths[plain])] = ids
        every[W.ragged(at[others], lengths[others])] = more
        return every, lengths

    def units(self, block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the units of a block, and the first unit of each text."""
        words = W.find_words(block)
        if not self.attached:
            if not self.parts or not len(words.starts):
                return words.starts, words.ends, words.firsts
            # A word's end without its stops: the last other byte before it, if that is a letter or digit.
            last = np.maximum.accumulate(np.where(STOP[block.data], -1, np.arange(len(block.data))))
            head = last[words.ends - 1] + 1
            cut = np.flatnonzero((head < words.ends) & (head > words.starts) & PLAIN[block.data[head - 1]])
            starts = np.sort(np.concatenate([words.starts, head[cut]]))
            ends = np.sort(np.concatenate([words.ends, head[cut]]))
            return starts, ends, np.searchsorted(starts, block.offsets)
        rows = len(block.offsets) - 1
        begin = np.empty(len(words.starts), np.int64)
        begin[1:] = words.ends[:-1]
        some = np.diff(words.firsts) > 0
        begin[words.firsts[:-1][some]] = block.offsets[:-1][some]
        reach = block.offsets[:-1].copy()
        reach[some] = words.ends[words.firsts[1:][some] - 1]
        tail = np.flatnonzero(reach < block.offsets[1:])
        starts, ends = np.concatenate([begin, reach[tail]]), np.concatenate([words.ends, block.offsets[1:][tail]])
        owner = np.concatenate([words.text_of(), tail])
        order = np.argsort(owner, kind="stable")
        return starts[order], ends[order], np.searchsorted(owner[order], np.arange(rows + 1))

    def encode(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``block``, one after the other, and the number of ids of each."""
        if self.lowers:
            block = block._replace(data=W.LOWER[block.data])
        starts, ends, firsts = self.units(block)
        rows = len(block.offsets) - 1
        distinct, first, which = np.unique(W.span_hash(block.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self.forget()
        spot = np.searchsorted(self.keys, distinct)
        fresh = np.ones(len(distinct), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(spot, len(self.keys) - 1)] != distinct
        if fresh.any():
            raw = block.data.tobytes()
            ids, lengths = self.fresh_units([raw[s:e].decode() for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)])
            self.keys = np.insert(self.keys, spot[fresh], distinct[fresh])
            self.at = np.insert(self.at, spot[fresh], (len(self.store) + np.cumsum(lengths) - lengths).astype(np.uint32))
            self.lengths = np.insert(self.lengths, spot[fresh], lengths.astype(np.uint32))
            self.store = np.concatenate([self.store, ids])
            spot = np.searchsorted(self.keys, distinct)
        lengths = self.lengths[spot][which].astype(np.int64)
        ids = self.store[W.ragged(self.at[spot][which].astype(np.int64), lengths)]
        ends_at = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(ends_at[firsts])
        if self.attached and WIDE_SPACE.search(block.data):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for row in range(rows):
                text = block.data[block.offsets[row] : block.offsets[row + 1]].tobytes()
                if WIDE_SPACE.search(text):
                    parts[row], counts[row : row + 1] = self.direct([text.decode()])
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """The encoder of a vocabulary file, one per worker."""
    return Encoder(name)
