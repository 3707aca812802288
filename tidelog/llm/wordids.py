"""Token ids of whole texts by the tokenizers library, with each distinct word
encoded once.

The vocabulary's normaliser and pre-tokenizer never join what white space parts:
its splits are runs of letters, single digits or runs of other non-space
characters. So a text's ids are the ids of its space-parted words in a row, and a
word's ids can be kept. Keys have ASCII letters lowered (the vocabulary lowers all
text), but not in texts with the beginning of a special token, whose spelling counts,
and are parted at ASCII white space only. A word that ends in a letter or digit and
then ASCII signs is kept in those two parts.

Splitting, finding distinct words and putting ids in a row are Arrow operations over
many texts at once; Python sees each distinct word of such a lot.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a worker: about 80 MB.
CACHE_WORDS = 400_000
#: ASCII signs that end a word apart from its letters; not the apostrophe, which
#: the pre-tokenizer may join with letters.
SIGNS = r""".,;:!?%&$*#|()[]{}"/+=<>@^~`\-_"""
#: Letters that are composed, and that lower-casing keeps single letters, everywhere:
#: those of Latin below U+0250, without U+0130 (a dotted capital I, which becomes a letter and a mark).
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
#: How special tokens begin.
SPECIAL = "<|"
#: Words encoded in one string: long strings cost more for each word.
JOINED = 128


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: the byte's own
    where that is printable in Latin-1, the others in turn from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


def as_string(column: pa.Array) -> pa.Array:
    """A binary column's bytes as text, not checked; null: empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), 0, column.offset)


def offsets_of(words: pa.Array) -> np.ndarray:
    """Where each text of a string column begins in its bytes."""
    return np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)


def offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy()


def flat(lists: pa.Array) -> np.ndarray:
    """The values of lists that begin at their values' beginning."""
    at = offsets(lists)
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


class IdStore:
    """Ids of words in one array, and the row of each word. Of more than ``most`` words, or of
    many more ids or bytes than words of common lengths have, those that were met in the most
    calls stay, up to half as many."""

    #: Ids and bytes of a word that the bound counts on.
    IDS, BYTES = 16, 64

    def __init__(self, most: int):
        self.most = most
        self.row: dict[str | bytes, int] = {}
        self.at, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.met, self.marks = np.empty(0, np.int32), np.empty(0, np.int32)
        self.n_bytes = 0

    def rows(self, words: list, learn: Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """``learn`` gives ids, lengths and a number to keep with each of the words that aren't known."""
        if len(self.row) > self.most or len(self.ids) > self.IDS * self.most or self.n_bytes > self.BYTES * self.most:
            self._shrink()
        found = list(map(self.row.get, words))
        new = [w for w, k in zip(words, found, strict=True) if k is None]
        if new:
            ids, lengths, marks = learn(new)
            n = len(self.row)
            self.n_bytes += sum(map(len, new))
            self.row.update(zip(new, range(n, n + len(new)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32, copy=False)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
            self.marks = np.concatenate([self.marks, marks.astype(np.int32, copy=False)])
            found = list(map(self.row.__getitem__, words)) if n else range(len(new))
        found = np.fromiter(found, np.int64, len(words))
        self.met[found] += 1
        return found

    def _shrink(self) -> None:
        words = list(self.row)
        order = np.argsort(-self.met, kind="stable")
        size = np.fromiter(map(len, words), np.int64, len(words))
        half = self.most // 2
        most = [half, *(int(np.searchsorted(np.cumsum(x[order]), n * half, "right")) for x, n in ((np.diff(self.at), self.IDS), (size, self.BYTES)))]
        stay = np.sort(order[: min(most)])
        self.n_bytes = int(size[stay].sum())
        lists = self.lists().take(pa.array(stay))
        self.row = {words[k]: i for i, k in enumerate(stay.tolist())}
        self.at, self.ids = offsets(lists).astype(np.int64), flat(lists).copy()
        self.met, self.marks = self.met[stay] // 2, self.marks[stay]

    def lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.at.astype(np.int32)), pa.array(self.ids))


def in_a_row(lists: pa.Array, word: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and the number of each one's, from the list of each
    distinct word, the number of the word at each place, and where texts begin."""
    taken = lists.take(pa.array(word))
    return flat(taken), np.diff(offsets(taken)[text_at]).astype(np.int64)


def put_back(order: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of words in their own order, given those of word ``order[0]``, ``order[1]`` and so on."""
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return flat(pa.ListArray.from_arrays(pa.array(at), pa.array(ids)).take(pa.array(back))), lengths[back]


class WordIds:
    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        if not all(t.content.startswith(SPECIAL) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise NotImplementedError(f"special tokens that don't begin with {SPECIAL}")
        # The same model without the steps before it, for words of Latin letters, lowered:
        # those are one piece, and their bytes' signs are known.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.signs = _byte_signs() | {32: 32}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.store = IdStore(CACHE_WORDS)
        # A character whose only token ends words: between words, it marks where their ids part.
        for mark in "☃★♥✔§":
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                self.mark, self.mark_id = mark, ids[0]
                break
        else:
            raise ValueError(f"{vocabulary} has no mark")

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = pa.array(words, pa.binary())
        short = pc.less(pc.binary_length(column), 200)
        latin = pc.and_(short, pc.match_substring_regex(as_string(column), f"^[{LATIN}]+$")).to_numpy(zero_copy_only=False)
        alone, plain = [], []  # numbers of words
        for i in np.flatnonzero(~latin).tolist():
            w = words[i]
            (alone if SPECIAL.encode() in w or len(w) > 2000 or self.mark.encode() in w else plain).append(i)
        order = np.concatenate([np.flatnonzero(latin), np.array(plain, np.int64), np.array(alone, np.int64)]).astype(np.int64)
        n_latin, texts = int(latin.sum()), [words[i].decode("utf-8", "replace") for i in order.tolist()]
        parts = [self._latin(texts[:n_latin]), self._plain(texts[n_latin : n_latin + len(plain)])]
        for t in texts[n_latin + len(plain) :]:
            own = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            parts.append((own, np.array([len(own)])))
        ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        return *put_back(order, lengths, ids), np.zeros(len(words), np.int32)

    def _encoded(self, tokenizer, strings: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(words[i : i + JOINED]).lower() for i in range(0, len(words), JOINED)]
        ids = self._encoded(self.bare, [j.encode().decode("latin-1").translate(self.signs) if not j.isascii() else j for j in joined])
        ends = np.flatnonzero(self.ends[ids]) + 1  # a word's last id says that it ends
        if len(ends) != len(words):
            raise ValueError("a word's ids don't end where it does")
        return ids, np.diff(ends, prepend=0)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        between = f" {self.mark} "
        ids = self._encoded(self.tokenizer, [between.join(words[i : i + JOINED]) + between for i in range(0, len(words), JOINED)])
        mark = ids == self.mark_id
        ends = np.flatnonzero(mark)
        if len(ends) != len(words):
            raise ValueError("words and marks don't take turns")
        return ids[~mark], np.diff(ends, prepend=-1) - 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a binary column's texts in a row, and the number of each one's; null: none."""
        text = as_string(column)
        parted = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(text, SPECIAL), text, pc.ascii_lower(text)))
        coded = pc.dictionary_encode(parted.values)
        words = coded.dictionary
        # A distinct word is one part, or a core and the signs after it; parts are cut out of
        # the words' own bytes, and a word of one part has an empty second one.
        core = pc.ascii_rtrim(words, characters=SIGNS)
        split = pc.match_substring_regex(core, f"[0-9{LATIN}]$").to_numpy(zero_copy_only=False)
        split &= ~pc.match_substring(words, SPECIAL).to_numpy(zero_copy_only=False)
        begins = offsets_of(words)
        cuts = np.empty(2 * len(words) + 1, np.int32)
        cuts[::2] = begins
        cuts[1::2] = np.where(split, begins[:-1] + pc.binary_length(core).to_numpy(), begins[1:])
        parts = pa.Array.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(cuts), words.buffers()[2]])
        both = pc.dictionary_encode(parts)
        row = self.store.rows(both.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        taken = self.store.lists().take(pa.array(row[both.indices.to_numpy()]))
        lists = pa.ListArray.from_arrays(pa.array(offsets(taken)[::2]), taken.values)
        out = in_a_row(lists, coded.indices.to_numpy(), offsets(parted))
        del parted, coded, words, core, parts, both, taken, lists
        pa.default_memory_pool().release_unused()  # workers live on with what they don't give back
        return out


@lru_cache(maxsize=4)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text's."""
    counts = counts + 1
    out = np.empty(len(ids) + len(counts), np.uint32)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(counts) - 1] = True
    out[ends], out[~ends] = end_id, ids
    return out, counts


def slices(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a binary column that hold about so many bytes, as (start, part); a longer
    value is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield lo, column.slice(lo, hi - lo)
        lo = hi
