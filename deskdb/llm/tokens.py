"""Fast, exact encoding of whole texts with a byte-level BPE of the tokenizers library.

The library takes some 10 microseconds for a word, whether it has met the word before or not. A byte-level BPE with
the usual split pattern never merges across a single space between two characters that are not white space: what
stands before the space ends a token there, and the space begins the next. So texts are cut at such spaces, each distinct
word is encoded once by the library (many in one call) and remembered, and a text's ids are gathered from its words'.
That pattern also cuts between letters and a mark, so a mark that ends a word of Latin letters stands apart from it, and "word", "word," and "word." are one.
Texts with any other space (doubled, next to a line break, at an end) are encoded whole by the library.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a Python worker (some 170 MB); beyond it the later half is forgotten, as common words come early.
MEMO_WORDS = 550_000
#: Ids remembered for each of these words on average, at most.
MEMO_IDS = 16
#: Characters of text encoded at a time.
STEP_CHARS = 4_000_000
JOINED = 256
SLICE_ROWS = 2400
#: Marks that stand apart from the word before them, and which words these are.
MARKS = ".,;:!?"
MARKED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]$"


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_bytes(tokenizer: str, end_id: int) -> int:
    """2 if every id of the vocabulary and ``end_id`` fit two bytes, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[begins[0]:begins[0]+lengths[0]], then the next, and so on, as one array."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return flat[np.repeat(begins - ends + lengths, lengths) + np.arange(total)]


def odd_words(words: pa.LargeStringArray) -> np.ndarray:
    """Which words are empty, or begin or end with white space (of all Unicode)."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    out = at[1:] == at[:-1]
    if words.buffers()[2] is None or not words.buffers()[2].size:
        return out
    flat = np.frombuffer(words.buffers()[2], np.uint8)
    ends = np.stack([flat[np.minimum(at[:-1], len(flat) - 1)], flat[at[1:] - 1]])
    ask = np.flatnonzero(~out & ((ends <= 32) | (ends >= 127)).any(0))  # other ends are characters that are not white space
    out[ask] = [w[0].isspace() or w[-1].isspace() for w in words.take(pa.array(ask)).to_pylist()]
    return out


class WordEncoder:
    _made: dict[str, "WordEncoder"] = {}

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """One for each worker process, kept over tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        for name, k in names.items():
            self.spaced[k] = name.startswith("Ġ")
        made = json.loads(self.tokenizer.to_str())
        usual = not made["normalizer"] and (made["pre_tokenizer"] or {}).get("type") == "ByteLevel" and made["pre_tokenizer"].get("use_regex", True)
        self.apart = bool(usual) and not any(set(MARKS) & set(x["content"]) for x in made["added_tokens"])
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}  # with a space before it
        self.bare: dict[str, int] = {}  # at a text's start
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begins, self.lengths, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        marks = self.whole(list(MARKS))  # numbers 0, 1, ...
        self._keep(np.array([x for e in marks for x in e], np.uint32), np.array([len(e) for e in marks], np.int64))

    def trim(self) -> None:
        """Forgets the words learned later, down to half of MEMO_WORDS."""
        keep = min(max(MEMO_WORDS // 2, len(MARKS)), self.n)
        if keep and int(self.begins[keep - 1] + self.lengths[keep - 1]) <= MEMO_WORDS * MEMO_IDS // 2:
            self.memo = {w: n for w, n in self.memo.items() if n < keep}
            self.bare = {w: n for w, n in self.bare.items() if n < keep}
            self.n, self.used = keep, int(self.begins[keep - 1] + self.lengths[keep - 1])
        else:
            self.forget()

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Adds words; the number of the first."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lengths) > len(self.begins):
            self.begins, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begins[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.used, self.n, first = self.used + len(ids), self.n + len(lengths), self.n
        return first

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> int:
        """The number of the first; the others follow."""
        begin = self.n
        for lo in range(0, len(words), JOINED):
            some = words[lo : lo + JOINED]
            ids = np.array(self.whole([" " + " ".join(some)])[0], np.uint32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(some):
                lengths = np.diff(at, append=len(ids))
            else:
                each = self.whole([" " + w for w in some])
                ids, lengths = np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each])
            first = self._keep(ids, lengths)
            self.memo.update(zip(some, range(first, first + len(some))))
        return begin

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in one array, and how many each has."""
        if self.n > MEMO_WORDS or self.used > MEMO_WORDS * MEMO_IDS:
            self.trim()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy().astype(np.int64)
        codes, mark = words.indices.to_numpy(), np.full(len(words.dictionary), -1, np.int64)
        plain = words.dictionary
        if self.apart:
            marked = pc.match_substring_regex(plain, MARKED)
            mark[marked.to_numpy(zero_copy_only=False)] = pc.index_in(pc.utf8_slice_codeunits(plain.filter(marked), -1), pa.array(list(MARKS), plain.type)).to_numpy()
            plain = pc.replace_with_mask(plain, marked, pc.utf8_slice_codeunits(plain.filter(marked), 0, -1))
        plain = plain.dictionary_encode()
        known = plain.dictionary.to_pylist()
        odd = odd_words(plain.dictionary)
        number = np.fromiter(map(self.memo.get, known, itertools.repeat(-1)), np.int64, len(known))  # odd words are never learned
        new = np.flatnonzero((number < 0) & ~odd)
        if len(new):
            number[new] = self._learn([known[k] for k in new.tolist()]) + np.arange(len(new))
        numbers, marks = number[plain.indices.to_numpy()[codes]], mark[codes]
        firsts = words.dictionary.take(pa.array(codes[bounds[:-1]])).to_pylist()
        marks[bounds[:-1]] = -1
        new = list(dict.fromkeys(w for w in firsts if w not in self.bare))
        if new:
            each = self.whole(new)
            first = self._keep(np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64))
            self.bare.update(zip(new, range(first, first + len(new))))
        numbers[bounds[:-1]] = [-1 if w and (w[0].isspace() or w[-1].isspace()) else self.bare[w] for w in firsts]
        # an empty first word is a text that is empty, or begins with a space
        count = np.diff(bounds)
        bad = np.zeros(len(texts), bool)
        bad[np.repeat(np.arange(len(texts)), count)[numbers < 0]] = True
        bad |= (count > 1) & np.array([not w for w in firsts], bool)
        if bad.any():
            rows = np.flatnonzero(bad)
            each = self.whole([texts[k] for k in rows])
            first = self._keep(np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64))
            drop = bad[np.repeat(np.arange(len(texts)), count)]
            drop[bounds[:-1][rows]] = False
            numbers[bounds[:-1][rows]] = np.arange(first, first + len(rows))
            numbers, marks = numbers[~drop], marks[~drop]
            count = np.where(bad, 1, count)
        if (marks >= 0).any():
            ends, two = np.cumsum(count), marks >= 0
            at = np.arange(len(numbers)) + np.cumsum(two) - two
            both = np.empty(len(numbers) + int(two.sum()), np.int64)
            both[at], both[at[two] + 1] = numbers, marks[two]
            more = np.concatenate([[0], np.cumsum(two)])
            numbers, count = both, count + more[ends] - more[ends - count]
        lengths = self.lengths[numbers]
        ids = gather(self.flat, self.begins[numbers], lengths)
        ends = np.cumsum(count)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[ends] - sums[ends - count]


def segments(text: str, size: int = STEP_CHARS) -> list[str]:
    """A very long text cut before safe spaces, about every ``size`` characters; the pieces after the first begin with the space."""
    out, lo = [], 0
    while len(text) - lo > size:
        at = text.find(" ", lo + size)
        while at >= 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[lo:at])
        lo = at
    return [*out, text[lo:]]


def encoded(texts: list[str | None] | pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids) for each text in order; null counts as empty. Memory is bounded by STEP_CHARS and the longest text's ids."""
    if isinstance(texts, pa.Array):  # Python strings of a slice at a time
        for at in range(0, len(texts), SLICE_ROWS):
            yield from ((at + k, ids) for k, ids in encoded(texts.slice(at, SLICE_ROWS).to_pylist(), path))
        return
    encoder, lo = WordEncoder.of(path), 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= STEP_CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        if chars > STEP_CHARS:
            parts = segments(texts[lo])
            ids = [encoder.encode([parts[0]])[0]]
            for p in parts[1:]:  # "x" + p: a word of one known letter in front, whose id is taken off
                x = encoder.encode(["x" + p])[0]
                ids.append(x[1:])
            yield lo, np.concatenate(ids)
        else:
            ids, counts = encoder.encode([t or "" for t in texts[lo:hi]])
            ends = np.cumsum(counts)
            for k in range(hi - lo):
                yield lo + k, ids[ends[k] - counts[k] : ends[k]]
        lo = hi
