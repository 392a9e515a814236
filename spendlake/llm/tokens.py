"""Token ids of whole texts, with a bounded cache of words."""

import functools
import os
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from spendlake.llm.common import word_hashes

#: Words, and bare lower-case words, whose ids a worker remembers.
CACHED_WORDS, CACHED_CORES = 1_000_000, 800_000
#: Marks that may follow a word; none of them starts a contraction.
_MARKS = b".,;:!?"
#: Text whose words are looked up together.
WINDOW_BYTES = 1 << 20
#: Words that the tokenizer reads as one text.
ENCODED_WORDS = 1024
_SPACE, _WORD = re.compile(rb"[ \t-\r]"), re.compile(rb"[^ \t-\r]+")


def _gathered(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values``, one after the other."""
    at = np.repeat(offsets - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among ``known``, which ascends."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class WordEncoder:
    """Ids of a text by a tokenizer that never joins across white space.

    Such a tokenizer gives a text the ids of its words, one after the other, so
    each distinct word is encoded once. Words are split at ASCII white space;
    any other space stays inside its word and is left to the tokenizer. With
    ``folds`` (it lowers case, and cuts letters from marks) a word of letters with marks behind
    it has the ids of the word in lower case, then those of the marks.
    """

    def __init__(self, path: str, folds: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        self.tokenizer = Tokenizer.from_file(path)
        self.folds = folds
        self._forget()
        self._forget_cores()

    def _forget(self) -> None:
        """Known words by hash: where their ids lie in ``flat``."""
        self.known = np.zeros(0, np.uint64)
        self.offsets, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _forget_cores(self) -> None:
        """Known parts of words by hash: where their ids lie in ``core_ids``."""
        self.cores = np.zeros(0, np.uint64)
        self.core_offsets, self.core_lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.core_ids = np.zeros(0, np.uint32)

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """A word in lower case, and the marks behind it; other words whole."""
        core = word.rstrip(_MARKS)
        if not self.folds:
            return word, b""
        if core.isalpha():  # ASCII letters only
            return core.lower(), word[len(core) :]
        text = core.decode("utf-8", "replace")
        if not text.isalpha():
            return word, b""
        # Letters must stay letters when composed and lowered; else the word is left whole.
        whole = unicodedata.normalize("NFC", text).lower().isalpha()
        return (core, word[len(core) :]) if whole else (word, b"")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words``, one after the other, and how many each has.

        They are read as one text: no id reaches across white space.
        """
        starts = np.cumsum([0, *(len(word) + 1 for word in words)])
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        at = np.fromiter((start for start, _ in found.offsets), np.int64, len(ids))
        return ids, np.diff(np.searchsorted(at, starts))

    def _learn_cores(self, hashes: np.ndarray, cores: list[bytes]) -> None:
        """Add the ids of ``cores`` to the table; hashes ascend."""
        all_ids, all_lengths = [], []
        for low in range(0, len(cores), ENCODED_WORDS):
            texts = [core.decode("utf-8", "replace") for core in cores[low : low + ENCODED_WORDS]]
            # A space that is not ASCII inside a word, or none but it, is left to the tokenizer alone.
            odd = {i for i, text in enumerate(texts) if not text.isalnum() and len(text.split()) != 1}
            ids, lengths = self._encode_words(["" if i in odd else text for i, text in enumerate(texts)] if odd else texts)
            if odd:
                each = np.split(ids, np.cumsum(lengths)[:-1])
                for i in odd:
                    each[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                ids, lengths = np.concatenate(each), np.array([len(x) for x in each])
            all_ids.append(ids)
            all_lengths.append(lengths)
        lengths = np.concatenate(all_lengths)
        offsets = len(self.core_ids) + np.cumsum(lengths) - lengths
        self.core_ids = np.concatenate([self.core_ids, *all_ids])
        at = np.searchsorted(self.cores, hashes)
        self.cores = np.insert(self.cores, at, hashes)
        self.core_offsets = np.insert(self.core_offsets, at, offsets)
        self.core_lengths = np.insert(self.core_lengths, at, lengths)

    def _core_slots(self, parts: list[bytes]) -> np.ndarray:
        """Where each of ``parts`` (none is empty) stands in the table; those that are not in it are learnt."""
        names = word_hashes(b" ".join(parts))[0]
        different, first = np.unique(names, return_index=True)
        new = ~_among(different, self.cores)
        if new.any():
            self._learn_cores(different[new], [parts[i] for i in first[new].tolist()])
        return np.searchsorted(self.cores, names)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add the ids of ``words`` to the table."""
        cores, marks = [], []
        for word in words:
            core, mark = self._parts(word)
            cores.append(core)
            marks.append(mark)
        kinds = {mark: i for i, mark in enumerate(sorted(set(marks) - {b""}), 1)}
        slots = self._core_slots(cores + list(kinds))
        kinds[b""] = 0  # no marks, no ids
        ends = np.r_[slots[:1], slots[len(words) :]]
        kind = np.fromiter(map(kinds.__getitem__, marks), np.int64, len(words))
        both = np.stack([self.core_lengths[slots[: len(words)]], np.where(kind > 0, self.core_lengths[ends[kind]], 0)], 1)
        starts = np.stack([self.core_offsets[slots[: len(words)]], self.core_offsets[ends[kind]]], 1)
        lengths = both.sum(axis=1)
        offsets = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, _gathered(self.core_ids, starts.ravel(), both.ravel())])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.offsets, self.lengths = np.insert(self.offsets, at, offsets), np.insert(self.lengths, at, lengths)

    def _ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words of ``data``, where each word starts, and how many ids it has."""
        hashes, starts = word_hashes(data)
        if not len(hashes):
            return np.zeros(0, np.uint32), starts, starts
        different, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~_among(different, self.known)
        if new.any():
            self._learn(different[new], [_WORD.match(data, i).group() for i in starts[first[new]].tolist()])
        at = np.searchsorted(self.known, different)
        lengths = self.lengths[at][back]
        return _gathered(self.flat, self.offsets[at][back], lengths), starts, lengths

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text.

        Words are told apart by 64-bit hashes: the ids of each different word of a window are
        looked up once, and gathered for all its places.
        """
        if len(self.known) > CACHED_WORDS:
            self._forget()
        if len(self.cores) > CACHED_CORES:
            self._forget_cores()
        data = b" ".join(texts)
        text_starts = np.cumsum([0, *(len(text) + 1 for text in texts)])
        ids, places, counts, start = [], [], [], 0
        while start < len(data):
            # A window ends behind a word.
            end = start + WINDOW_BYTES
            end = len(data) if end >= len(data) or (cut := _SPACE.search(data, end)) is None else cut.end()
            found, starts, lengths = self._ids(data[start:end])
            ids.append(found)
            places.append(starts + start)
            counts.append(lengths)
            start = end
        if not ids:
            return [b""] * len(texts)
        flat, at = np.concatenate(ids).astype("<u4"), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        bounds = at[np.searchsorted(np.concatenate(places), text_starts)].tolist()
        return [flat[low:high].tobytes() for low, high in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
