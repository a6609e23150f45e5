"""Token ids of whole texts for a byte-level vocabulary."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from valprint.llm.shared import kept


#: Blanks in a row that the faster encoder's word pattern is not asked to go back over; texts with more go to the library.
BLANKS = 50_000
_blanks = re.compile(rf"\s{{{BLANKS}}}")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the library gives them without added special tokens.

    Texts go whole through an encoder over the same ranks where the vocabulary allows it, else to the library; texts
    that hold the string of a special token, or very many blanks in a row, always go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ranked = self._by_rank(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    @staticmethod
    def _by_rank(path: str):
        """The same merges as a faster encoder, if the ids of the vocabulary are its ranks and words split as usual."""
        import public_tokenizers
        import tiktoken

        from valprint.llm.rank_merge import byte_symbols

        spec = json.load(open(path, encoding="utf-8"))
        vocab, split = spec["model"]["vocab"], spec["pre_tokenizer"]
        made = [m[0] + m[1] if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if spec["normalizer"] or split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or [vocab.get(m) for m in made] != list(range(256, 256 + len(made))):
            return None
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(map(byte.__getitem__, k)): v for k, v in vocab.items() if v < 256 + len(made)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if any(s in text for s in self.special) or len(text) >= BLANKS and _blanks.search(text):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(array("I", self.ranked.encode_ordinary(text)).tobytes())
        return out


def encoder(path: str | None = None) -> ByteEncoder:
    """The worker's encoder for a vocabulary, byte_bpe_50k.json if no path is given."""
    path = path or byte_vocabulary()
    return kept(("bytes", path), lambda: ByteEncoder(path))
