"""Token ids by the tokenizers library, with each distinct word encoded once.

A byte-pair encoder works on one pre-token at a time, and no pre-token runs across a single space
or line feed into the word behind it, so the ids of a text are the ids of its words joined.  Texts
whose characters all lie where the pre-tokeniser's classes are beyond doubt (ASCII and Latin
letters) and whose white space is single spaces and line feeds are cut into words here; a batch's
words are numbered by Arrow, and the ids of each distinct word, made by the library, are kept in one
flat array from which a batch's ids are gathered.  Every other text goes to the library whole.

A word of letters is one pre-token, and so is the ASCII punctuation behind it where no apostrophe
is in it; such parts go to the library's model itself, all other words through its whole chain.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters up to U+024F without controls, white space other than space and line feed, and the soft hyphen.
PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-įı-ɏ]*")
PLAIN_LATIN = bytes([0x0A, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
#: White space that a single word would not see as its neighbours do.
UNEVEN = ("  ", " \n", "\n ", "\n\n")
#: Letters, with a space before them or not, and punctuation: a pre-token each.
SIMPLE = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+)?([!-&(-/:-@\\[-`{-~]+)?")
#: Characters that go through the arrays at once.
GROUP = 1 << 22


def is_plain(text: str) -> bool:
    if text.isascii() or text.isprintable() and max(text) < "Ā":
        return not text.encode("latin-1").translate(None, PLAIN_LATIN)
    return PLAIN.fullmatch(text) is not None


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others in their order for characters from U+0100.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(hidden)}


def runs_of(texts: list[str], most: int = GROUP) -> Iterator[list[str]]:
    """The texts in groups of about most characters."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield texts[first : k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield texts[first:]


class Encoder:
    """ids(texts) gives one little-endian uint16 or uint32 array for each text, flat(texts) one for all.

    kept: distinct words whose ids are held at once; beyond it the store starts anew, so memory
    is bounded whatever the vocabulary of the corpus.
    """

    def __init__(self, path: str, kept: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.lower = self.library.normalizer is not None
        self.kept = kept
        self.shown = byte_characters()
        self._forget()
        self.feed = None if self.lower else self._library_ids("\n")[0]

    def _forget(self) -> None:
        #: The number of each word, and by number where its ids begin in the store and how many they are.
        self.words: dict[str, int] = {"": 0}
        self.begin, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.store = np.empty(0, self.dtype)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found, lengths = self.flat(texts)
        return np.split(found, np.cumsum(lengths)[:-1]) if texts else []

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        lengths = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        parts: list[str] = []
        owners: list[int] = []
        size = 0

        def settle():
            nonlocal size
            if parts:
                found, counts = self._gather(parts)
                out.append(found)
                np.add.at(lengths, owners, counts)
                parts.clear()
                owners.clear()
                size = 0

        for k, text in enumerate(texts):
            if not self._by_words(text):
                settle()
                out.append(self._library_ids(text))
                lengths[k] = len(out[-1])
                continue
            lo = 0
            while lo < len(text):
                # a long text is cut before a space, which belongs to the word behind it
                hi = text.find(" ", lo + GROUP) if len(text) - lo > GROUP else -1
                hi = len(text) if hi < 0 else hi
                parts.append(text[lo:hi])
                owners.append(k)
                size += hi - lo
                lo = hi
                if size >= GROUP:
                    settle()
        settle()
        return np.concatenate(out) if out else np.empty(0, self.dtype), lengths

    def _by_words(self, text: str) -> bool:
        if not is_plain(text):
            return False
        return self.lower or not (any(pair in text for pair in UNEVEN) or text[-1:] in (" ", "\n") or text[:1] == "\n")

    def _gather(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        else:
            apart = pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\0 ")
            split = pc.split_pattern(pc.replace_substring(apart, "\n", "\0\n\0"), "\0")
        numbered = split.values.dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self.words]
        if missing:
            if len(self.words) + len(missing) > self.kept:
                self._forget()
                missing = distinct
            self._learn(missing)
        number = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[numbered.indices.to_numpy()]
        counts = self.count[number]
        ends = np.cumsum(counts)
        places = np.repeat(self.begin[number] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return self.store[places], np.diff(upto)

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _add(self, found: dict[str, list[int]]) -> None:
        """Puts words and their ids into the store."""
        counts = np.fromiter(map(len, found.values()), np.int64, len(found))
        begins = len(self.store) + np.cumsum(counts) - counts
        first = len(self.begin)
        self.words.update(zip(found, range(first, first + len(found))))
        self.begin, self.count = np.concatenate([self.begin, begins]), np.concatenate([self.count, counts])
        self.store = np.concatenate([self.store, np.fromiter(chain.from_iterable(found.values()), self.dtype, int(counts.sum()))])

    def _learn(self, words: list[str]) -> None:
        """The ids of words unseen so far."""
        found: dict[str, list[int]] = {}
        known: dict[str, list[int]] = {"": []}
        odd, tokenize, shown, match = [], self.library.model.tokenize, self.shown, SIMPLE.fullmatch

        def ids(part: str) -> list[int]:
            if part in self.words:
                k = self.words[part]
                own = self.store[self.begin[k] : self.begin[k] + self.count[k]].tolist()
            else:
                # ASCII is shown as it is but for the space
                plain = part.replace(" ", chr(shown[0x20])) if part.isascii() else part.encode("utf-8").decode("latin-1").translate(shown)
                own = found[part] = [t.id for t in tokenize(plain)]
            known[part] = own
            return own

        for word in words:
            if word in self.words or word in found:
                continue
            m = match(word)
            if m is None:
                odd.append(word)
                continue
            letters, marks = m[1] or "", m[2] or ""
            own = known[letters] if letters in known else ids(letters)
            if marks:
                found[word] = own + (known[marks] if marks in known else ids(marks))
        found.update(self._whole_chain(odd))
        self._add(found)

    def _whole_chain(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of words by the library's whole chain.

        Where line feeds have an id of their own, words that hold none are encoded as the lines
        of one text, which the library does faster than word by word.
        """
        if self.feed is None:
            encoded = self.library.encode_batch_fast(words, add_special_tokens=False)
            return {w: e.ids for w, e in zip(words, encoded)}
        lines = [w for w in words if w != "\n"]
        found = {w: self._library_ids(w).tolist() for w in words if w == "\n"}
        for at in range(0, len(lines), 512):
            some = lines[at : at + 512]
            ids = self._library_ids("\n".join(some))
            split = np.split(ids, np.flatnonzero(ids == self.feed))
            found.update({w: x[k > 0 :].tolist() for k, (w, x) in enumerate(zip(some, split))})
        return found


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    return Encoder(path)
