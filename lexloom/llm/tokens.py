"""Token ids by the tokenizers library, a distinct chunk at a time.

The vocabulary's tokenizer lower-cases and splits at white space first, so the ids of a text are those of its white-space chunks one after
another. Chunks of plain letters, also with signs behind them, go through the same BPE model with a cheaper pre-tokeniser, the others
through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: The pre-token pattern of the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

_SIGNS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_LETTERS = re.compile(rb"[a-z]+").fullmatch


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """encode(texts) -> list of int32 arrays, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        from .wordcache import ChunkCache

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile("\n|" + PRE_TOKEN)
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        #: Characters whose lower-casing, normal form and class are settled one by one; anything else takes the whole tokenizer.
        self.simple = regex.compile(r"[\x21-\x3b\x3d-\x7e¡-¬®-įı-ſ]+").fullmatch
        self.pieces = ChunkCache(self._pieces, most=200_000)
        self.chunks = ChunkCache(self._chunks, most=200_000)

    def _pieces(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, encoded in zip(parts, self.plain.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype=np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out += [np.array(self.whole.encode(w, add_special_tokens=False).ids, dtype=np.int32).tobytes() for w in part]
                continue
            raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _chunks(self, raw: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(raw)
        # a letter ends a pre-token, and the signs after it are the next one
        bases = [x.rstrip(_SIGNS) for x in raw]
        at = [i for i, x in enumerate(bases) if _LETTERS(x)]
        tails = [raw[i][len(bases[i]) :].decode() for i in at]
        bases = list(map(bytes.decode, map(bases.__getitem__, at)))
        ids = self.pieces.get(set(bases).union(filter(None, tails)))
        for i, base, tail in zip(at, bases, tails, strict=True):
            out[i] = ids[base] + ids[tail] if tail else ids[base]
        text = ["" if y is not None else x.decode() for x, y in zip(raw, out, strict=True)]
        easy = [i for i, x in enumerate(text) if out[i] is None and self.simple(x)]
        for at in range(0, len(easy), 20_000):
            part = easy[at : at + 20_000]
            found = self.split.findall("\n".join(text[i] for i in part).lower())
            ids = self.pieces.get({x for x in found if x != "\n"})
            k, own = 0, []
            for x in found:
                if x == "\n":
                    out[part[k]] = b"".join(own)
                    k, own = k + 1, []
                else:
                    own.append(ids[x])
            out[part[k]] = b"".join(own)
        hard = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(hard, self.whole.encode_batch_fast([text[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.int32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # a lone surrogate can't come out of Spark's UTF-8 strings; special tokens are spelt in lower case only, so those texts keep theirs
        words = [(raw if b"<|" in (raw := x.encode()) else raw.lower()).split() for x in texts]
        known = self.chunks.get(set().union(*words)) if words else {}
        return [np.frombuffer(b"".join(map(known.__getitem__, w)), dtype=np.int32) for w in words]

    def close(self) -> None:
        """Gives back what is remembered, and the models (the caches refer to this object, so nothing else would at once)."""
        self.pieces.forget()
        self.chunks.forget()
        del self.pieces, self.chunks, self.plain, self.whole


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
