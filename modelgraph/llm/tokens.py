"""Token ids of whole texts by a public tokenizer file, with a cache of pieces.

The tokenizer in use lower-cases, cuts at white space, and cuts runs of letters
from what stands around them (but for contractions), before anything else.  So a
text is encoded as the concatenation of such pieces, and each distinct piece is
encoded once per Python worker.  The ids equal those of encoding the whole text;
texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per Python worker; beyond it the cache starts anew.
CACHE = 400_000

#: Letters and other characters of Latin-1.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_OTHERS = "".join(c for c in map(chr, range(256)) if not c.isalpha())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.vocab_size, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, runs: list[str]) -> list[bytes]:
        """Runs of letters are one unit each, which its last id ends; so many of
        them are encoded as one text and cut again."""
        out: list[bytes] = []
        for k in range(0, len(runs), 500):
            part = runs[k : k + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out += self._encode(part)
                continue
            raw, at = ids.tobytes(), (cuts * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *at], at)]
        return out

    def _plain(self, text: str) -> bool:
        """Whether the text can be cut into pieces: it is Latin-1, where
        lower-casing goes character by character, without special tokens."""
        if "<|" in text and any(s in text.lower() for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _ids_of(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of pieces, from the cache or newly encoded."""
        found = list(map(self.cache.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.cache) + len(new) > CACHE:
            self.cache = {"": b""}
        letters = [p for p in new if p.isalpha()]
        ids = dict(zip(letters, self._encode_letters(letters), strict=True))
        other = [p for p in new if not p.isalpha()]
        ids.update(zip(other, self._encode(other), strict=True))
        self.cache.update(ids)
        return [ids[p] if x is None else x for p, x in zip(pieces, found, strict=True)]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """All words of the texts at once: a word is the letters it begins with
        and the rest, and each distinct one of either is looked up once."""
        low = pc.replace_substring(pc.utf8_lower(pa.array(texts, pa.large_string())), "\n", " ")
        split = pc.split_pattern(low, " ")
        words = split.values.dictionary_encode()
        rest = pc.utf8_ltrim(words.dictionary, characters=_LETTERS)
        stem = pc.utf8_rtrim(words.dictionary, characters=_OTHERS)
        whole = pc.equal(pc.add(pc.binary_length(stem), pc.binary_length(rest)), pc.binary_length(words.dictionary))
        stem = pc.if_else(whole, stem, "").dictionary_encode()
        rest = pc.if_else(whole, rest, words.dictionary).dictionary_encode()
        n = len(stem.dictionary)
        found = self._ids_of(stem.dictionary.to_numpy(zero_copy_only=False)) + self._ids_of(rest.dictionary.to_numpy(zero_copy_only=False))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        index = words.indices.to_numpy(zero_copy_only=False)
        pieces = np.empty(2 * len(index), dtype=np.int64)
        pieces[0::2] = stem.indices.to_numpy(zero_copy_only=False)[index]
        pieces[1::2] = rest.indices.to_numpy(zero_copy_only=False)[index] + n
        count = size[pieces]
        end = np.cumsum(count)
        ids = flat[np.repeat(first[pieces] - (end - count), count) + np.arange(end[-1] if len(end) else 0)].tobytes()
        at = np.r_[0, end][2 * split.offsets.to_numpy()] * 4
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; call it with a few MB of texts at a time."""
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self._plain(t)]
        if plain:
            for i, ids in zip(plain, self._encode_plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        done = set(plain)
        other = [i for i, t in enumerate(texts) if t and i not in done]
        for i, ids in zip(other, self._encode([texts[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    return WordEncoder(path)
