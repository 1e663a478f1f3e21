"""Public tokenizers applied piecewise: equal pieces of text are tokenized once for each task.

The vocabulary files stay where the ``public_tokenizers`` package keeps them; their names are parameters.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

#: Entries of a memo before it starts anew, and the longest piece that it keeps.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64


class _Memo(dict):
    """Values by key, computed when missing. At ``MEMO_ENTRIES`` it starts anew, beside the entries it had, which are taken over when used."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.compute(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


#: Byte-level vocabularies write a byte as the character of its number if that is printable, else as one from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian 32-bit words")


def _one_run(part: str) -> bool:
    """Whether a part is letters only that the normaliser leaves as they are; one that it splits may leave a mark that joins what follows."""
    return part.isalpha() and (part.islower() if part.isascii() else part == part.lower() and is_normalized("NFC", part))


class WordIds:
    """Ids of a tokenizer that drops white space, as little-endian 32-bit bytes.

    Such a tokenizer never joins characters over a space or line break, so a text's ids are those of its parts between
    these, in order. (Its normaliser maps characters one by one or composes marks with the letter before, and
    special strings hold no space.) It also lower-cases, so ASCII letters are lowered first, unless a special string may be there.
    A part of normalised letters is one run, which goes to the model at once; a sign behind it is a run of its own.
    """

    def __init__(self, name: str):
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tok.model
        self.memo = _Memo(self._one)
        self.memo[""] = b""

    def _one(self, part: str) -> bytes:
        if _one_run(part):
            run = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array("I", [t.id for t in self.model.tokenize(run)]).tobytes()
        if not part:
            return b""
        if part[-1] in ".,!?:;" and _one_run(part[:-1]):
            return self.memo[part[:-1]] + self.memo[part[-1]]
        return array("I", self.tok.encode(part, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            text = text.encode().lower().decode()
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def word_ids(name: str) -> WordIds:
    """One for each process, so that tasks of the same Python worker share the memo."""
    return WordIds(name)


#: A pre-token: the spaces before a word and the word up to the next space or line break, a line break with what follows it, or spaces at the end.
_PRE = re.compile("\n[^ \n]*| *[^ \n]+| +")


class PieceCounts:
    """Numbers of pieces of a sentencepiece model with byte fallback whose pieces hold spaces at their start only and no line breaks.

    Merges then never join a character to a space or line break after it, nor a line break to what follows, so counts of pre-tokens add up.
    """

    def __init__(self, name: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.memo = _Memo(self.count)

    def count(self, pre: str) -> int:
        """The library puts a space before each text: ``pre`` gives its own first space for it, and a line break a space that stands alone."""
        if pre[0] == " ":
            return len(self.sp.encode(pre[1:])) if len(pre) > 1 else 1
        return len(self.sp.encode(pre)) - 1

    def pre_tokens(self, text: str) -> list[str]:
        return _PRE.findall(" " + text.replace("▁", " ")) if text else []

    def direct(self, text: str) -> int:
        return len(self.sp.encode(text))
