"""Token ids of whole texts by the public tokenizer files.

``TextEncoder`` takes texts as they come.  ``PieceEncoder`` (for operator 10)
uses that both vocabularies split a text into words before they merge, and
that a single space or line feed between two non-space characters always ends
a word: a text is cut there and every distinct piece is encoded once.  Merging
is done by ``tiktoken`` with the merge order of the file; what neither treats
by itself goes to the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from punctual.llm.common import held, no_cycles

# Bound on each memo of a Python worker, and on the length of what it holds.
MEMO_ENTRIES = 250_000
MEMO_CHARS = 48
# Word rule of the byte-level vocabulary, and of the other one on lower-case plain text (fixed values).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
MARKED = r"[^\x00]+\x00"
# Runs of one kind of character beyond this length are left to the library.
LONG_RUN = 100_000
_RUN = re.compile(r"\s+|\S+")
# A character beyond Latin-1 letters, digits, marks and plain white space, or what may be a special string.
_STRANGE = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
_END = re.compile(r"[ \n]|\Z")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_LEADS = re.compile(r"(?=[ \n])")
# Letters of Latin-1, then marks that no rule of either vocabulary treats by itself.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\[-`{}~]*)\Z")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def pieces(text: str) -> list[str]:
    """Cut before each space and line feed, which lead the pieces."""
    if "\0" in text:
        return _LEADS.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def library(tokenizer_file: str):
    """The ``tokenizers`` object of a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file)
    t.no_truncation()
    t.no_padding()
    return t


def library_ids(tokenizer, text: str) -> bytes:
    return array("H", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def odd_words(text: str) -> list[str]:
    """``text`` in parts: plain, a word with something strange, plain, and so on (in time linear in its length)."""
    parts, done = [], 0
    for m in _STRANGE.finditer(text):
        if m.start() >= done:
            first = max(done, text.rfind(" ", done, m.start()) + 1, text.rfind("\n", done, m.start()) + 1)
            parts.append(text[done:first])
            done = _END.search(text, m.end()).start()
            parts.append(text[first:done])
    return [*parts, text[done:]]


class Memo:
    """Bounded memo of two generations: when full, what was used lately stays at hand."""

    def __init__(self, limit: int = MEMO_ENTRIES):
        self.now, self.older, self.limit = {}, {}, limit

    def missing(self, keys: set) -> list:
        """Keys of which the value must be computed; the others are in ``now`` afterwards."""
        if len(self.now) + len(keys) > self.limit:
            self.older, self.now = self.now, {}
        gone = keys.difference(self.now)
        older = self.older
        known = list(filter(older.__contains__, gone))
        self.now.update(zip(known, map(older.__getitem__, known)))
        return list(filterfalse(older.__contains__, gone))

    def forget_long(self, keys) -> None:
        for k in keys:
            if len(k) > MEMO_CHARS:
                self.now.pop(k, None)


class Merger:
    """Byte-pair merging by the rules of a tokenizer file, done by ``tiktoken``.

    Its merges go by the joined bytes of two tokens, those of the file by the
    pair.  Both give the same ids where every token of the file comes out of
    merging its own bytes, which ``tests/llm`` checks for both files.  The end
    of a word, where the vocabulary has one, is a byte of its own, which merges first.
    """

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.file = tokenizer_file
        self.lower = spec["normalizer"] is not None
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.suffix: str = model["end_of_word_suffix"] or ""
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")

    def _bpe(self, mark: bytes):
        """The merger with ``mark`` for the end of a word, a byte that its input does not hold otherwise."""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        for token, i in self.vocab.items():
            if token not in self.added:
                word = token.removesuffix(self.suffix)
                ranks[bytes(map(byte_of.__getitem__, word)) + (mark if word != token else b"")] = i
        return tiktoken.Encoding(self.file, pat_str=MARKED if self.suffix else SPLIT, mergeable_ranks=ranks,
                                 special_tokens={})._core_bpe

    @cached_property
    def _by_word(self):
        return self._bpe(b"\xff")

    @cached_property
    def _by_text(self):
        return self._bpe(b"\0")

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 16 bits) of each word, given as it comes out of the word split."""
        one, mark = self._by_word.encode_single_piece, b"\xff" if self.suffix else b""
        return [array("H", one(w.encode() + mark)).tobytes() if w else b"" for w in words]

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without special strings; where words have ends, a zero must mark each (and nothing else)."""
        return array("H", self._by_text.encode_ordinary(text)).tobytes()


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 16-bit integers; remembers next to nothing.

    A vocabulary without word ends goes through whole texts.  For one with word
    ends, the words of a text's plain parts (Latin-1 letters, digits, marks) are
    lowered and marked; words with other characters go to ``tokenizers``.
    Special token strings take their ids.
    """

    def __init__(self, tokenizer_file: str):
        self.merger = Merger(tokenizer_file)
        self.special = re.compile("(" + "|".join(map(re.escape, self.merger.added)) + ")") if self.merger.added else None
        self.odd = Memo()

    @cached_property
    def tokenizer(self):
        return library(self.merger.file)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        with no_cycles():
            return self._words(texts) if self.merger.suffix else list(map(self._whole, texts))

    def _whole(self, text: str) -> bytes:
        if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in _RUN.finditer(text)):
            return library_ids(self.tokenizer, text)
        if self.special is None or not self.special.search(text):
            return self.merger.ordinary(text)
        added = self.merger.added
        return b"".join(array("H", [added[p]]).tobytes() if p in added else self.merger.ordinary(p) for p in self.special.split(text))

    def _marked(self, text: str) -> bytes:
        """Ids of a plain part."""
        words = WORD.findall(text.lower())
        return self.merger.ordinary("\0".join(words) + "\0") if words else b""

    def _words(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        mixed = []
        for i, text in enumerate(texts):
            parts = odd_words(text)
            if len(parts) > 1:
                mixed.append((i, parts))
            else:
                out[i] = self._marked(text)
        new = self.odd.missing({p for _, parts in mixed for p in parts[1::2]})
        known = self.odd.now
        for p in new:
            known[p] = library_ids(self.tokenizer, p)
        for i, parts in mixed:
            out[i] = b"".join(known[p] if at % 2 else self._marked(p) for at, p in enumerate(parts))
        self.odd.forget_long(new)
        return out


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 16-bit integers."""

    def __init__(self, tokenizer_file: str):
        self.merger = Merger(tokenizer_file)
        self.lower = self.merger.lower
        self.words, self.pieces = Memo(), Memo()

    @cached_property
    def tokenizer(self):
        return library(self.merger.file)

    def odd_piece(self, piece: str) -> bytes:
        """Ids of a piece that is not a plain word with marks."""
        return library_ids(self.tokenizer, piece)

    def plain_words(self, words: list[str]) -> list[bytes]:
        return self.merger.merge(words)

    def _loose(self, piece: str) -> bool:
        """Its space touches another space, so the cut may not stand (spaces count in this vocabulary)."""
        return not self.lower and (piece[-1:].isspace() or piece[:1] in (" ", "\n") and piece[1:2].isspace())

    def _learn(self, new: list[str]) -> None:
        now = self.pieces.now
        plain, others = [], []
        for p in new:
            m = _PLAIN.match(p)
            if m:
                lead, word, tail = m.groups()
                if self.lower:
                    plain.append((p, "", word.lower(), tail))
                else:
                    plain.append((p, lead if lead == "\n" else "", " " + word if lead == " " else word, tail))
            else:
                others.append(p)
        parts = {x for p in plain for x in p[1:]}
        unknown = self.words.missing(parts)
        word = self.words.now
        word.update(zip(unknown, self.plain_words(unknown)))
        for p, lead, w, tail in plain:
            now[p] = word[lead] + word[w] + word[tail]
        self.words.forget_long(unknown)
        for p in others:
            now[p] = None if self._loose(p) else self.odd_piece(p) if p else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if any("\0" in t for t in texts):
            cut = pa.array([pieces(t) for t in texts], pa.list_(pa.string()))
        else:
            marked = pa.array(texts, pa.string())
            for lead in (" ", "\n"):
                marked = pc.replace_substring(marked, lead, "\0" + lead)
            cut = pc.split_pattern(marked, "\0")
        # Distinct pieces and, for every piece, which of them it is.
        coded = cut.flatten().dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = self.pieces.missing(set(distinct))
        self._learn(new)
        found = list(map(self.pieces.now.__getitem__, distinct))
        loose = np.array([ids is None for ids in found])
        found = [ids or b"" for ids in found]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        first = np.cumsum(size) - size
        sizes = size[which]
        ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(found), "<u2")[np.repeat(first[which] - ends + sizes, sizes) + np.arange(ends[-1])]
        begin = cut.offsets.to_numpy()
        at = (2 * np.concatenate([[0], ends])[begin]).tolist()
        raw = ids.tobytes()
        out = [raw[a:z] for a, z in zip(at, at[1:])]
        if loose.any():  # a loose piece: cut such texts only where it is safe
            for i in np.flatnonzero(np.add.reduceat(loose[which], begin[:-1])).tolist():
                out[i] = b"".join(map(self.odd_piece, _CUT.split(texts[i])))
        self.pieces.forget_long(new)
        return out


def text_encoder(tokenizer_file: str) -> TextEncoder:
    """One encoder per Python worker and file."""
    return held(("texts", tokenizer_file), lambda: TextEncoder(tokenizer_file))
