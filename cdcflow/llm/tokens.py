"""Token ids of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import numpy as np


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, those of the ``tokenizers`` library without special tokens.

    ``ranks`` is the same vocabulary for a library that is about four times as fast; both give the same ids, but for
    texts that name one of the vocabulary's special tokens, which always go to the first. Without it all texts do.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()
