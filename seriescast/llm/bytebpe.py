"""Ids of a byte-level BPE ``tokenizer.json`` at the speed the corpus needs.

``tokenizers`` encodes about 1 MB a second and core, so the file's own vocabulary and merges are run by the
engine of ``tiktoken``, which gives the same ids about five times faster.  Characters for which the two
libraries' Unicode tables could differ send a text to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# The pre-tokenizer rule of byte-level BPE and the white space it knows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Within these blocks (Latin, Greek, Cyrillic, punctuation, CJK, kana, Hangul) letters, digits and spaces are
#: the same in every Unicode version of the last twenty years.
SETTLED = re.compile("[\x00-ɏΑ-ΡΣ-ωЀ-ҁ‐-‧‰-⁞€"
                     "、-〃〈-】ぁ-ゖァ-ヺ一-龥가-힣！-～]*")


def tokenizer_path(name: str) -> str:
    """A path as it is, or a file of the public tokenizers by name (resolved where the task runs)."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.lengths = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for w, i in ranks.items():
            self.lengths[i] = len(w)
        for w, i in self.special.items():
            self.lengths[i] = len(w.encode())
        self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._own = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if SETTLED.fullmatch(text):
            return self._fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.asarray(self._own.encode(text, add_special_tokens=False).ids, np.uint32)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the place in ``text`` where it ends; -1 where that is inside a character."""
        ids = self.ids(text)
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        first = (raw & 0xC0) != 0x80
        whole = np.append(first, True)
        chars = np.append(np.cumsum(first) - first, len(text))
        return ids, np.where(whole[ends], chars[ends], -1)


@lru_cache(maxsize=4)
def load(name: str) -> ByteBPE:
    return ByteBPE(tokenizer_path(name))
