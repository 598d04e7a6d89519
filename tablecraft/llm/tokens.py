"""Token ids of many texts, equal to those of the ``tokenizers`` library.

Word-piece vocabularies that split at white space (lower-casing, word ends marked)
are encoded chunk by chunk: a text is cut at white space, and a bounded memo keeps
the ids of chunks seen before. Chunks not in the memo are encoded together by
``tiktoken`` with the same merges: a word end is a final NUL byte there, whose
merges come first. The two agree if every entry of the vocabulary that has a rank
is what the merges make of its own bytes (a test goes through the vocabulary).
Texts with characters outside a plain Latin range, or with special strings, and
tokenizers of another kind, go to the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Chunks in the memo before it is emptied; a memory bound without influence on results.
MEMO = 300_000
#: Characters of text that are encoded together.
TOGETHER = 1 << 18

# Latin letters whose lower case and composed form are single characters of the same range; printable ASCII; line breaks.
_ODD = re.compile("[^\t\n\r -~¡-¬®-įı-ſ]|<\\|")
_LETTER = "a-zª\xb5ºß-öø-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+|\n")
# Fixed value: the split pattern of the tokenizer file that the fast way is for.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_END = "</w>"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        size = max([*described["model"]["vocab"].values(), *(t["id"] for t in described["added_tokens"])]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.fast = None
        if described["model"].get("end_of_word_suffix") == _END and _SPLIT in json.dumps(described["pre_tokenizer"]).replace("\\\\", "\\"):
            self._prepare(described["model"])

    def _prepare(self, model: dict) -> None:
        import tiktoken

        letters, vocab = byte_letters(), model["vocab"]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        for end in ("", _END):
            for letter, byte in sorted(letters.items(), key=lambda x: x[1]):
                ranks[bytes([byte]) + b"\0" * bool(end)] = len(ids)
                ids.append(vocab.get(letter + end, 0))
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            token = left + right
            ended = token.endswith(_END)
            raw = bytes(letters[c] for c in (token[:-len(_END)] if ended else token)) + b"\0" * ended
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab[token])
        self.ids = np.array(ids, self.dtype)
        self.mark = ranks[b"\n\0"]
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        if self.fast is None:
            for text in texts:
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
            return
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        chunks = [None if _ODD.search(t) else t.lower().split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = [c for c in {c for found in chunks if found for c in found} if c not in memo]
        if new:
            pieces = _PIECE.findall("\n".join(new) + "\n")
            ranks = np.array(self.fast.encode_ordinary("\0".join(pieces) + "\0"), np.int64)
            raw, width = self.ids[ranks].tobytes(), self.dtype.itemsize
            begin = 0
            for chunk, end in zip(new, np.flatnonzero(ranks == self.mark).tolist(), strict=True):
                memo[chunk] = raw[begin * width:end * width]
                begin = end + 1
        for text, found in zip(texts, chunks, strict=True):
            if found is None:
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
            else:
                yield np.frombuffer(b"".join(map(memo.__getitem__, found)), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, special_as_text)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
