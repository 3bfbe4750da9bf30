"""Identifiers of texts under a byte-level BPE file, by the tokenizers library, one call for each distinct chunk.

A byte-level pre-tokeniser never joins what a white-space boundary parts, so a
text's identifiers are those of its chunks (a run of other characters with the
space before it, or white space) one after the other.  Nor does it join a letter
or digit with ASCII punctuation behind it, so a word parts from the first mark
after it.  The chunks of natural text repeat; a bounded memo in each worker
keeps their identifiers as bytes.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

from tidemark.llm.bpe_count import WHITE, Memo, read_vocabulary

MARKS = r"!-/:-@\[-`{-~"
CHUNKS = re.compile(rf" ?[^{WHITE}{MARKS}]++(?:(?=[{MARKS}])(?<=[^\W_])|[^{WHITE}]*+)| ?[^{WHITE}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class ChunkIds:
    """Little-endian unsigned 32-bit identifiers of a text, without begin, end, truncation or padding.

    plain_specials: whether special strings in a text are ordinary text; by
    default they are single tokens, as the library has them, and a text that
    holds one goes to the library whole.
    """

    def __init__(self, spec: str, plain_specials: bool = False):
        library = Tokenizer.from_str(spec)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = plain_specials
        self.library = library
        strings = [t.content for t in library.get_added_tokens_decoder().values()]
        self.specials = None if plain_specials or not strings else re.compile("|".join(map(re.escape, strings)))
        self.memo = Memo(self._ids)

    def _ids(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.specials and self.specials.search(text):
            return self._ids(text)
        return b"".join(map(self.memo.__getitem__, CHUNKS.findall(text)))


_held: dict[bool, tuple[str, ChunkIds]] = {}  # what this worker holds, by treatment of special strings


def chunk_ids(spec: str, plain_specials: bool = False) -> ChunkIds:
    """The worker's encoder of a tokenizer file's content; its memo outlives the task."""
    if plain_specials not in _held or _held[plain_specials][0] is not spec and _held[plain_specials][0] != spec:
        _held[plain_specials] = (spec, ChunkIds(spec, plain_specials))
    return _held[plain_specials][1]


def read_spec(path: str) -> str:
    """Content of a byte-level BPE file, on the driver; files of another kind are refused, as chunks would not be independent."""
    read_vocabulary(path)
    with open(path, encoding="utf-8") as f:
        return f.read()
