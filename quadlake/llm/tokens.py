"""Encoding with a public tokenizer, faster where its pieces repeat.

Both families of tokenizers used here split a text before merging, and neither merges across the places where we cut:

* ``words``: white space separates and is dropped (lower-casing and composing act within a word), so a text is cut at
  every blank and line feed;
* ``blanks``: a blank belongs to the word after it, so a text is cut before a blank or line feed that stands alone
  between other characters. A text with any other white space is encoded whole.

A text that names an added token, such as <|endoftext|>, is encoded whole, as such names are found before anything is
split. Each distinct piece is encoded by the library, once while the cache holds it; a test holds this against encoding
whole texts.
"""

from __future__ import annotations

import re
import string
from array import array
from itertools import repeat

import numpy as np

from . import common as C

PUNCT = string.punctuation
ODD = re.compile(r"[^\S \n]")
LONG = 64  # characters of the longest piece that is kept


class _Known:
    """Pieces and their ids, which lie one piece after another in one array."""

    def __init__(self):
        self.at: dict[str, int] = {}  # in the order of their numbers
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n = self.end = 0

    def find(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers, -1 for what is not known."""
        return np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """pieces, none known, and the ids of all of them, so many for each."""
        n, end = self.n + len(pieces), self.end + len(ids)
        if n > len(self.start):
            self.start, self.size, self.used = (np.concatenate([x[: self.n], np.zeros(2 * n - self.n, np.int64)]) for x in (self.start, self.size, self.used))
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.end], np.zeros(2 * end - self.end, np.uint32)])
        self.at.update(zip(pieces, range(self.n, n)))
        self.ids[self.end : end] = ids
        self.start[self.n : n] = self.end + np.cumsum(size) - size
        self.size[self.n : n] = size
        self.n, self.end = n, end

    def joined(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these numbers, one after another."""
        size = self.size[at]
        ends = np.cumsum(size)
        place = np.repeat(self.start[at] - ends + size, size)
        place += np.arange(len(place))
        return self.ids[place]

    def keep(self, entries: int) -> None:
        """Only so many pieces, those used last."""
        chosen = np.sort(np.argsort(-self.used[: self.n], kind="stable")[:entries])
        names, ids, size, used = list(self.at), self.joined(chosen), self.size[chosen], self.used[chosen]
        self.__init__()
        self.add([names[i] for i in chosen.tolist()], ids, size)
        self.used[: self.n] = used

    def drop(self, pieces: list[str]) -> None:
        """Forgets these pieces, which were added last."""
        for p in pieces:
            del self.at[p]
        self.n -= len(pieces)
        self.end = int(self.start[self.n]) if pieces else self.end


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers. cut: words, blanks, or whole for no cutting.

    Many texts are cut at once by Arrow, which also tells their distinct pieces, so only these are looked up.
    """

    def __init__(self, path: str, cut: str, entries: int = 400_000, chars: int = 8 << 20):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        #: Names of added tokens match across the places where we cut, so a text with one is encoded whole.
        added = self.t.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.cut, self.entries, self.chars = "whole" if any(t.normalized for t in added) else cut, entries, chars
        self.known, self.calls = _Known(), 0
        vocab = self.t.get_vocab(with_added_tokens=True)
        #: With words, the ids that end a word; with blanks, those that start with one. Either tells where pieces of letters meet.
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for k, i in vocab.items() if (k.endswith("</w>") if cut == "words" else k.startswith("\u0120"))]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        many = getattr(self.t, "encode_batch_fast", self.t.encode_batch)
        return [array("I", e.ids).tobytes() for e in many(texts, add_special_tokens=False)]

    def _spelled(self, piece: str) -> str:
        """A piece as it stands in a text: what blanks part has one before it, but for heads of texts, which a tab marks."""
        if self.cut == "words" or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == "\t" else " " + piece

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = self._raw([self._spelled(p) for p in pieces])
        return np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)

    def _letters(self, pieces: list[str]) -> None:
        """Learns pieces of letters alone, many encoded as one text; where edges and pieces differ in number, one by one."""
        many = getattr(self.t, "encode_batch_fast", self.t.encode_batch)
        groups = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        texts = [(" " if self.cut == "blanks" else "") + " ".join(g) for g in groups]
        for k in range(0, len(groups), 16):
            for g, e in zip(groups[k : k + 16], many(texts[k : k + 16], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(self.edge[ids])
                if len(at) != len(g):
                    self.known.add(g, *self._one_by_one(g))
                else:
                    self.known.add(g, ids, np.diff(at, prepend=-1) if self.cut == "words" else np.diff(at, append=len(ids)))

    def _learn(self, new: list[str]) -> list[str]:
        """Encodes pieces that are not known. Gives the long ones, which come last."""
        known, blanks = self.known, self.cut == "blanks"
        alone, letters, tails, long = [], {}, {}, []
        whole, cores, ends = [], [], []
        for p in new:
            if len(p) > LONG:
                long.append(p)
            elif p.isalpha():
                letters[p] = None
            elif p[:1] in "\n\t":  # an empty one too
                alone.append(p)
            elif (core := p.rstrip(PUNCT)).isalpha():  # letters and marks after them never merge
                letters[core] = None
                tails[p[len(core) :]] = None
                whole.append(p)
                cores.append(core)
                ends.append(p[len(core) :])
            elif blanks:
                letters[p] = None  # one blank a piece, whatever else it holds
            else:
                alone.append(p)
        self._letters([p for p in letters if p not in known.at])
        for i in range(0, len(alone), 2048):
            known.add(alone[i : i + 2048], *self._one_by_one(alone[i : i + 2048]))
        if whole:
            tail = _Known()
            raw = self._raw(list(tails))
            tail.add(list(tails), np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64))
            a, b = known.find(cores), tail.find(ends)
            both = _Known()  # core and tail by turns
            both.ids = np.concatenate([known.ids[: known.end], tail.ids[: tail.end]])
            both.start = np.concatenate([known.start[: known.n], tail.start[: tail.n] + known.end])
            both.size = np.concatenate([known.size[: known.n], tail.size[: tail.n]])
            known.add(whole, both.joined(np.stack([a, b + known.n], 1).ravel()), known.size[a] + tail.size[b])
        for p in long:
            known.add([p], *self._one_by_one([p]))
        return long

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.cut == "whole":
            return self._raw(texts)
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added) or self.cut == "blanks" and _odd(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, x in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            out[i] = x
        skip = set(whole)
        run, held = [], 0
        for i, t in enumerate(texts):
            if i not in skip:
                run.append(i)
                held += len(t)
            if run and (held >= self.chars or i == len(texts) - 1):
                for j, x in zip(run, self._cut([texts[j] for j in run]), strict=True):
                    out[j] = x
                run, held = [], 0
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = self.known
        if known.n > 2 * self.entries:
            known.keep(self.entries)
        self.calls += 1
        texts = [_folded(t).replace("\n", " ") for t in texts] if self.cut == "words" else ["\t" + t.replace("\n", " \n") for t in texts]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = split.flatten().dictionary_encode()
        pieces = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = known.find(pieces)
        missed = np.flatnonzero(at < 0)
        long = self._learn([pieces[i] for i in missed.tolist()])
        at[missed] = known.find([pieces[i] for i in missed.tolist()])
        known.used[at] = self.calls
        at = at[flat.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(known.size[at]) * 4))[np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        raw = known.joined(at).tobytes()
        known.drop(long)
        return [raw[x:y] for x, y in zip(ends, ends[1:])]


def _odd(text: str) -> bool:
    """Whether white space in it, the ends counted, is anything but blanks and line feeds that stand alone."""
    return not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD.search(text) is not None


def _folded(text: str) -> str:
    """In lower case where that is sure to be what the tokenizer makes of it: there, nothing composes or depends on its place."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def encoder(path: str, cut: str) -> Encoder:
    """One a worker process, kept for its later tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_quadlake_encoders", {})
    if (path, cut) not in kept:
        kept[path, cut] = Encoder(path, cut)
    return kept[path, cut]


C.travels(__name__)
