"""Whole-text encoding by a public tokenizer file, memoised by word.

The tokenizers library does all encoding; this module only remembers what it
returned for a piece of text.  A text is cut where both tokenizers always cut:

* byte-level files: at a single blank or line feed between two other
  characters (the blank stays with what follows).  Texts with any other white
  space, or with two white-space characters side by side, go to the library
  whole, since runs of white space are grouped by look-ahead there.  Also before
  closing punctuation that follows an ASCII letter: no pre-token goes on from a
  letter to a sign, and none is judged by what stands before it.
* word files: at blanks and line feeds (white space is dropped there).

A piece of letters is one pre-token of either file, so it goes straight to the
library's BPE model; letters with closing punctuation are two pre-tokens;
anything else goes through the library's full pipeline.  Texts for byte-level
files are cut in the buffer of their Arrow column, and the memo is asked once for
each different piece of a call.  The memo
of a worker process is bounded; when it is full, it keeps what it met first.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

ENTRIES = 800_000
KEPT = 150_000
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
_CLOSING = ".,;:!?|*$%&#"
_SPACE, _ODD_SPACE, _SIGN = 1, 2, 4
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _byte_letters() -> dict[int, str]:
    """Byte-level files write each byte as one printable character; a rule, not a table."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_SHOWN = "".join(_LETTERS[b] for b in range(256))
_ID = attrgetter("id")


class Memo(dict):
    """piece -> number of its run of token ids; unknown pieces are encoded when asked for."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.closing: dict[str, array] = {}
        self.ids, self.at = array("I"), array("q", [0])

    def shrink(self) -> None:
        """Keep the entries that were met first, which are the frequent ones, and forget the rest."""
        stay = {p: k for p, k in self.items() if k < KEPT}
        self.clear()
        self.update(stay)
        del self.at[KEPT + 1 :]
        del self.ids[self.at[-1] :]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def letters(self, core: str) -> list[int]:
        shown = core.replace(" ", "Ġ") if core.isascii() else core.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.model.tokenize(shown)]

    def _put(self, piece: str, found) -> int:
        self.ids.extend(found)
        self.at.append(len(self.ids))
        self[piece] = n = len(self.at) - 2
        return n

    def learn(self, pieces: list[str]) -> None:
        """As asking for each of these unknown pieces of byte-level texts, but those with white space that does not cut stay unknown."""
        words = [p for p in pieces if (p[1:] if p[0] == " " else p).isalpha()]
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            shown = charmap_decode("\n".join(some).encode(), "strict", _SHOWN)[0].split(_SHOWN[10])
            found = list(map(self.model.tokenize, shown))
            first = len(self.at) - 1
            self.at.frombytes((np.cumsum(list(map(len, found))) + len(self.ids)).tobytes())
            self.ids.extend(map(_ID, chain.from_iterable(found)))
            self.update(zip(some, range(first, first + len(some)), strict=True))
        if len(words) < len(pieces):
            for p in pieces:
                if not (p[1:] if p[0] == " " else p).isalpha() and (p.isascii() or not _OTHER_SPACE.search(p)):
                    self[p]

    def __missing__(self, piece: str) -> int:
        core = piece.rstrip(_CLOSING)
        if not (core[1:] if core[:1] == " " else core).isalpha():
            return self._put(piece, self.whole(piece))
        if core == piece:
            return self._put(piece, self.letters(core))
        tail = piece[len(core) :]
        if (last := self.closing.get(tail)) is None:
            last = array("I", self.whole(tail))
            if len(tail) < 9:
                self.closing[tail] = last
        k = self[core]
        return self._put(piece, self.ids[self.at[k] : self.at[k + 1]] + last)

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries one after another, and how many each has."""
        at = np.frombuffer(self.at, dtype=np.int64)
        ids = np.frombuffer(self.ids, dtype=np.uint32) if len(self.ids) else np.empty(0, np.uint32)
        first = at[entries]
        lengths = at[entries + 1] - first
        ends = np.cumsum(lengths)
        shift = np.repeat(first - (ends - lengths), lengths)
        shift += np.arange(len(shift))
        return ids[shift], lengths


class Encoder:
    """encode(texts) -> (ids of all texts one after another, ids in each text); texts: a list or an Arrow column."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.words_only = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str().replace(" ", "")
        self.memo = Memo(self.tokenizer)
        # a sign that the file's own added tokens have does not cut, they are looked for in whole texts
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kinds = np.zeros(256, dtype=np.uint8)
        self.kinds[[10, 32]], self.kinds[[9, 11, 12, 13]] = _SPACE, _ODD_SPACE
        self.kinds[[ord(c) for c in _CLOSING if c not in added]] = _SIGN

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text for a word file, or None where it must be encoded whole."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        # one letter for one letter here, as the file's own normaliser does
        return [p for p in text.lower().replace("\n", " ").split(" ") if p]

    def _list(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _column, for a word file."""
        cuts = [self._cut(t) if t else [] for t in texts]
        flat: list[str] = []
        for c in cuts:
            if c:
                flat += c
        entries = np.fromiter(map(self.memo.__getitem__, flat), dtype=np.int64, count=len(flat))
        return entries, np.array([len(c) if c else 0 for c in cuts], dtype=np.int64), np.array([c is None for c in cuts], dtype=bool)

    def _column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Memo entries of all pieces, pieces of each text, and which texts must be encoded whole (they have no pieces here)."""
        _, ends, data = texts.buffers()
        edges = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", dtype=np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        text_of = lambda at: np.searchsorted(edges, at, side="right") - 1
        whole = np.zeros(len(texts), dtype=bool)

        kinds = self.kinds[raw]
        at = np.flatnonzero(kinds)
        kinds = kinds[at]
        space, sign = at[kinds == _SPACE], at[kinds == _SIGN]
        sign = sign[_LETTER[raw[sign - 1]]]
        whole[text_of(at[kinds == _ODD_SPACE])] = True
        # white space side by side, or where a text begins or ends
        near = np.flatnonzero(np.diff(space) == 1)
        whole[text_of(space[near])] = True
        whole[text_of(space[near + 1])] = True
        some = edges[:-1] < edges[1:]
        for ends in (edges[:-1][some], edges[1:][some] - 1):
            whole[text_of(ends[self.kinds[raw[ends]] == _SPACE])] = True

        cuts = np.concatenate([space, space[raw[space] == 10] + 1, sign, edges])
        cuts.sort()
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
        counts = np.diff(np.searchsorted(cuts, edges))
        if whole.any():
            pieces = pieces.filter(pa.array(np.repeat(~whole, counts)))
            counts[whole] = 0
        pieces = pieces.dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, names))
        if None in found:
            self.memo.learn([name for name, k in zip(names, found, strict=True) if k is None])
            found = [self.memo.get(name, -1) if k is None else k for name, k in zip(names, found, strict=True)]
        numbers = np.array(found, dtype=np.int64)
        entries = numbers[pieces.indices.to_numpy()]
        if (numbers < 0).any():
            odd = np.zeros(len(texts), dtype=bool)
            odd[np.repeat(np.arange(len(texts)), counts)[entries < 0]] = True
            entries = entries[np.repeat(~odd, counts)]
            counts[odd] = 0
            whole |= odd
        return entries, counts, whole

    def encode(self, texts: list | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > ENTRIES:
            self.memo.shrink()
        if self.words_only:
            texts = texts if isinstance(texts, list) else texts.to_pylist()
            entries, n_pieces, whole = self._list(texts)
        else:
            texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
            entries, n_pieces, whole = self._column(texts)
        ids, lengths = self.memo.runs(entries)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        pieces = np.concatenate([[0], np.cumsum(n_pieces)])
        counts = sums[pieces[1:]] - sums[pieces[:-1]]
        if not whole.any():
            return ids, counts
        parts, at = [], 0
        for i, alone in enumerate(whole.tolist()):
            if alone:
                parts.append(np.asarray(self.memo.whole(texts[i] if isinstance(texts, list) else texts[i].as_py()), dtype=np.uint32))
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[at : at + counts[i]])
                at += int(counts[i])
        return np.concatenate(parts), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its memo, for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
