"""Token ids of whole texts, by the vocabulary files of public tokenizers.

A text goes to the library in pieces cut where the library itself starts a new word, so that a piece's
ids don't depend on its neighbours and very long texts need bounded memory.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a piece of a long text.
PIECE_CHARS = 1 << 18
#: White space after anything else: the word pattern always starts a new word there.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])")
#: Beyond these the two libraries' tables of character classes may differ, so the first one decides.
_UNUSUAL = re.compile(r"[^\t-\r -~¡-ɏ‐-‧‰-⁞€]")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts text at safe places about limit characters apart; a stretch without one stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """ids(text): ids as the library gives them by default, with nothing added before or after.

    A byte-level .json vocabulary is encoded by its .tiktoken twin when one lies beside it and holds the same
    ids, since that gives equal ids several times faster. Texts with special strings or with characters outside
    Latin scripts and common punctuation go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path, self.fast, self.special = path, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = lambda text: self.piece.encode(text, num_threads=1)
            self.many = lambda texts: self.piece.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.slow = lambda text: self.model.encode(text, add_special_tokens=False).ids
        self.many = lambda texts: self.model.encode_batch_fast(texts, add_special_tokens=False)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        # special strings that white space is no part of are never cut where white space begins
        self.cut_special = all(not re.search(r"\s", t.content) and not t.lstrip and not t.rstrip for t in self.model.get_added_tokens_decoder().values())
        twin = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(twin):
            self.fast = self._twin(twin, set(added))

    def _twin(self, path: str, added: set[str]):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        shown = byte_letters()
        own = {k: v for k, v in self.model.get_vocab(with_added_tokens=True).items() if k not in added}
        if {"".join(map(shown.__getitem__, k)): v for k, v in ranks.items()} != own:
            return None
        return tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> list[str]:
        """The pieces of a text that are encoded each by itself. A .model normalises across words: its texts stay whole."""
        if not text:
            return []
        if self.path.endswith(".model") or not self.cut_special and self.special is not None and self.special.search(text):
            return [text]
        return list(pieces(text))

    def quick(self, part: str) -> bool:
        return self.fast is not None and not _UNUSUAL.search(part) and not (self.special is not None and self.special.search(part))

    def ids(self, text: str) -> np.ndarray:
        found = [np.asarray(self.fast.encode_ordinary(p) if self.quick(p) else self.slow(p), np.uint32) for p in self.parts(text)]
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint32)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text, of all their pieces in one batch call to each library."""
        parts = [self.parts(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        every = [p for ps in parts for p in ps]
        quick = np.fromiter(map(self.quick, every), bool, len(every))
        count = np.zeros(len(every), np.int64)
        if quick.any():
            count[quick] = list(map(len, self.fast.encode_ordinary_batch([p for p, q in zip(every, quick.tolist(), strict=True) if q], num_threads=1)))
        if not quick.all():
            count[~quick] = list(map(len, self.many([p for p, q in zip(every, quick.tolist(), strict=True) if not q])))
        return np.bincount(owner, count, len(texts)).astype(np.int64)


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(4)
def encoder(vocabulary: str) -> Encoder:
    """Loaded once in each Python worker; vocabulary: a file's path, or a name in the public folder."""
    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path(vocabulary))
    return Encoder(vocabulary)
