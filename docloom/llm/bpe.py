"""Token ids of whole texts, as the ``tokenizers`` library gives them.

The vocabulary is a ``tokenizers`` JSON file, or a ``tiktoken`` one of ranks,
which that library reads.  When it is JSON of a plain byte-level BPE
whose merges are listed in the order of their ids, its merge table alone fixes
the ids, and :class:`Encoder` hands that table to ``tiktoken``, which gives the
same ids in a fifth of the time (a test compares both on every code point).
Vocabularies of any other kind go through the library itself.

Longer texts than ``BLOCK`` are encoded in parts, cut only where a word of the
pre-tokenizer ends whatever follows, so the ids are those of the whole text; a
long run of blanks is one such word and goes to the merges directly, as the
engine's pattern would need stack for each of its characters.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: How byte-level BPE cuts a text before it merges (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a text that are encoded together, about.
BLOCK = 1 << 18
#: Blanks from which a run is a part of its own.
RUN = 1 << 10
#: Unicode's white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{RUN},}}")
_END = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text whose ids are those of the whole, and whether one is a run of blanks, which is one word.

    No word goes on from a character into a blank behind it; a run of blanks is
    a word but for its last blank, which may begin the next word.
    """
    at = 0
    while at < len(text):
        run = _RUN.search(text, at)
        start = run.start() if run else len(text)
        while start - at > BLOCK and (end := _END.search(text, at + BLOCK, start)):
            yield text[at : end.start()], False
            at = end.start()
        if start > at:
            yield text[at:start], False
        at = start
        if run:
            at = run.end() - (run.end() < len(text))
            yield text[start:at], True


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _merge_table(spec: dict) -> dict[bytes, int] | None:
    """Rank of each token's bytes, or None where ranks alone don't fix the ids."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        spec.get("normalizer") is None and model.get("type") == "BPE" and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout")
        and not model.get("ignore_merges")
    )
    if not plain:
        return None
    vocab = model["vocab"]
    joined = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    if not all(vocab.get(token) == 256 + i for i, token in enumerate(joined)):
        return None
    special, byte_of = {t["content"] for t in spec.get("added_tokens", [])}, _byte_of_char()
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


class Encoder:
    """Encodes texts with the vocabulary file at ``path``.

    No special token is added, and the name of one in a text is ordinary text.
    """

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.dtype = np.dtype("<u2") if max(ranks.values()) < 1 << 16 else np.dtype("<u4")
            self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        ranks = _merge_table(json.loads(self.tokenizer.to_str()))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("merges", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of one text; a null text is an empty one."""
        if not text:
            return np.empty(0, self.dtype)
        if self.fast is not None and len(text) <= BLOCK:
            return np.array(self.fast.encode_ordinary(text), self.dtype)
        if self.fast is not None:
            return np.concatenate([self._part(part, blanks) for part, blanks in parts(text)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _part(self, part: str, blanks: bool) -> np.ndarray:
        if blanks:
            return np.array(self.fast._encode_single_piece(part.encode()), self.dtype)
        return self.fast.encode_to_numpy(part, disallowed_special=()).astype(self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for ``path``; it is built once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
