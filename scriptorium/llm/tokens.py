"""Exact token ids by a public tokenizer, with work done once per distinct chunk of text and once per distinct pre-token.

No pre-token crosses a border between white space and other characters, but for the one space that the byte-level
vocabulary keeps before a word. A text's ids are therefore those of its chunks (a word with that space, or white space), and
a chunk's those of its pre-tokens. Each pre-token is encoded when a worker first meets it; whatever
holds characters beyond Latin letters goes through the whole library, chunk by chunk. Texts with special strings are cut
there first, as the library does by default. The memory of a worker is bounded: its tables stop growing at `CACHED` entries.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

from .common import held


#: White space as Unicode defines it, and what of it is neither a space nor a line feed.
_WS = r"\t-\r\x20\x85\xa0  -     　"
_RARE = "\t\x0b\x0c\r\x85\xa0                　"
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Printable ASCII and the letters and signs up to U+017F, whose classes no version of Unicode has changed.
_SIGNS = [chr(c) for c in [*range(32, 127), *range(161, 173), *range(174, 384)]]
_L = re.escape("".join(c for c in _SIGNS if unicodedata.category(c)[0] == "L"))
_N = re.escape("".join(c for c in _SIGNS if unicodedata.category(c)[0] == "N"))
_PLAIN = re.compile(f"[{re.escape(''.join(_SIGNS))}]*").fullmatch
#: The pre-tokenizers' patterns of the two vocabularies, for plain text.
_PIECES = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ {_L}{_N}]+| +(?! )| +"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ {_L}{_N}]+"),
}
CACHED = 400_000
#: Characters of text whose chunks are held at once.
BATCH_CHARS = 1_000_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible in Latin-1, else from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def _plain(chunk: str) -> bool:
    return (chunk.isascii() and chunk.isprintable()) or _PLAIN(chunk) is not None


class Memo(dict):
    """A dict that computes what it lacks, and keeps the first CACHED results."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, k):
        v = self.make(k)
        if len(self) < CACHED:
            self[k] = v
        return v


class ChunkTokenizer:
    """Ids of texts by a tokenizers file; kind: 'byte' (spaces count) or 'word' (lower case, spaces don't count)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        letters = _byte_letters()
        self.letters = dict(enumerate(letters))
        self.encode_piece = None
        if kind == "byte" and self._ids_are_ranks():
            # A coder by ranks gives the same ids as the library's model, faster.
            import tiktoken

            byte = {x: b for b, x in enumerate(letters)}
            ranks = {bytes(byte[x] for x in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items()}
            self.encode_piece = tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ids = Memo(self._chunk_ids)  # of a chunk
        self.spaced_ids = Memo(lambda c: self._chunk_ids(" " + c))  # of a chunk with a space before it
        self.piece_ids = Memo(self._piece_ids)

    def _ids_are_ranks(self) -> bool:
        """Whether the vocabulary is one letter for each byte and then what its merges make, in their order. If not, the library's model
        encodes each piece."""
        merges = json.loads(self.library.to_str())["model"].get("merges", [])
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        letters = {t for t in vocabulary if len(t) == 1}
        ids = [vocabulary.get(t, -1) for t in made]
        in_order = ids == sorted(set(ids)) and (not ids or ids[0] > max(vocabulary[t] for t in letters))
        return in_order and letters == set(self.letters.values()) and letters | set(made) == {*vocabulary} - self.special.keys()

    def _plain_pieces(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in ",." and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return _PIECES[self.kind].findall(chunk)

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk of a byte-level vocabulary."""
        if chunk in self.special:
            return [chunk]
        if _plain(chunk):
            return self._plain_pieces(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _piece_ids(self, piece: str) -> bytes:
        if self.encode_piece:
            return array("H", self.encode_piece(piece)).tobytes()
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.library.model.tokenize(letters)]).tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        if chunk in self.special:
            return array("H", [self.special[chunk]]).tobytes()
        plain = _plain(chunk)
        if plain and self.kind == "word":
            chunk = chunk.lower()
            plain = _plain(chunk)  # not if a small letter has a mark of its own
        if not plain:
            return array("H", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.piece_ids.__getitem__, self._plain_pieces(chunk)))

    def chunks(self, text: str) -> list[tuple[bool, list[str]]]:
        """A text as lists of chunks, in order; True: each has a space before it which is left out."""
        if self.cut and any(s in text for s in self.special):
            parts = [p for p in self.cut(text) if p]
            return [c for p in parts for c in ([(False, [p])] if p in self.special else self._chunks(p))]
        return self._chunks(text)

    def _chunks(self, text: str) -> list[tuple[bool, list[str]]]:
        if self.kind == "word":
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space for Python alone
                return [(False, [c for c in (x.strip(" ") for x in _CHUNK.findall(text)) if c])]
            return [(False, text.split())]
        if any(s in text for s in ("  ", " \n", "\n ", "\n\n")) or any(c in text for c in _RARE):
            return [(False, _CHUNK.findall(text))]
        out: list[tuple[bool, list[str]]] = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append((False, ["\n", words[0]] if out else words[:1]))
            if len(words) > 1:
                out.append((True, words[1:]))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 16-bit integers (both vocabularies are smaller than 65,536)."""
        plain, spaced = self.ids.__getitem__, self.spaced_ids.__getitem__
        return b"".join([b"".join(map(spaced if space else plain, words)) for space, words in self.chunks(text)])

    def encoded(self, texts: Iterable[str]) -> Iterator[bytes]:
        return map(self.encode, texts)


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in groups of about BATCH_CHARS characters, a longer text alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def chunk_tokenizer(path: str, kind: str) -> ChunkTokenizer:
    """One for each Python worker."""
    return held(("tokens", path, kind), lambda: ChunkTokenizer(path, kind))
