"""The BPE of a tokenizers file with word ends, exactly, for many words at once.

Reads the vocabulary, merges and special tokens from the file; its path is a parameter. Texts are normalised (NFC,
white space to single spaces, lower case) and cut into words, and the distinct words of a slice of text are merged
together: each round finds the best-ranked pair of every word in one pass over arrays and merges all of its places,
left to right. Texts of ASCII and Latin-1 are cut as arrays of bytes; others go through regular expressions.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from lumenframe.llm import kit

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLANK = regex.compile(r"\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        p = np.array(pairs, np.int64)
        key = p[:, 0] << 20 | p[:, 1]
        key, first = np.unique(key, return_index=True)
        self.rank, self.made = first.astype(np.int64), p[first, 2]
        self.n_ranks = len(pairs)
        self._table(key)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        spelled = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.names_off = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        self.names = np.frombuffer(b"".join(spelled), np.uint8)

    def _table(self, key: np.ndarray, bits: int = 18) -> None:
        """Pairs by an open-addressed table: most are found, or found missing, at the first look."""
        self.bits, self.key = bits, np.full(1 << bits, -1, np.int64)
        self.slot = np.zeros(1 << bits, np.int64)
        left, at = np.arange(len(key)), self._hash(key)
        self.looks = 0
        while len(left):
            self.looks += 1
            free = self.key[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.key[at[put]], self.slot[at[put]] = key[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_slots(self, key: np.ndarray) -> np.ndarray:
        """The merge of each pair, or -1."""
        at = self._hash(key)
        got = self.key[at]
        out = np.where(got == key, self.slot[at], -1)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self.looks):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.key[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merged(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (rows of bytes), one after another, and their offsets."""
        lengths = np.diff(off)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        sym = self.inner[data]
        last = off[1:] - 1
        sym[last] = self.final[data[last]]
        word, done = np.repeat(np.arange(len(lengths)), lengths), []
        while len(sym):
            pair = np.full(len(sym), -1, np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            pair[same] = self.pair_slots(sym[same] << 20 | sym[same + 1])
            rank = np.where(pair >= 0, self.rank[pair], self.n_ranks)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, head)
            counts = np.diff(np.append(head, len(sym)))
            live = np.repeat(best < self.n_ranks, counts)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank, pair, best = sym[live], word[live], rank[live], pair[live], np.repeat(best, counts)[live]
            else:
                best = np.repeat(best, counts)
            if not len(sym):
                break
            hit = rank == best
            if (hit[1:] & hit[:-1] & (word[1:] == word[:-1])).any():  # a run such as aaa: every other place, from the left
                place = np.flatnonzero(hit)
                new = np.concatenate([[True], (np.diff(place) > 1) | (word[place[1:]] != word[place[:-1]])])
                begun = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
                hit[place[(np.arange(len(place)) - begun) % 2 == 1]] = False
            place = np.flatnonzero(hit)
            sym[place] = self.made[pair[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(lengths)))])

    def decoded(self, ids: np.ndarray) -> bytes:
        """Token strings joined by single spaces, as UTF-8."""
        return kit.taken(self.names, self.names_off, ids)[0][:-1].tobytes()

    def encoded(self, column: pa.Array, lexicon=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int64) of the texts, one after another, and their offsets. A lexicon knows the ids of frequent words; unseen ones are merged."""
        data, off = kit.utf8(column)
        simple = plain(data, off)
        rows = np.flatnonzero(~simple)
        if not len(rows):
            return self._plain_ids(data, off, lexicon)
        if len(rows) == len(simple):
            return self._other_ids([column[i].as_py() or "" for i in rows.tolist()], lexicon)
        ids, ids_off = self._plain_ids(*kit.taken(data, off, np.flatnonzero(simple)), lexicon)
        more, more_off = self._other_ids([column[i].as_py() or "" for i in rows.tolist()], lexicon)
        index = np.where(simple, np.cumsum(simple) - 1, simple.sum() + np.cumsum(~simple) - 1)
        return kit.taken(np.concatenate([ids, more]), np.concatenate([ids_off, ids_off[-1] + more_off[1:]]), index)

    def counted(self, column: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The different words of the texts, and how often each occurs."""
        data, off = kit.utf8(column)
        simple = plain(data, off)
        some, some_off = kit.taken(data, off, np.flatnonzero(simple))
        some = lowered(some)
        words, words_off, index = distinct(some, *pieces(some, some_off)[:2])
        raw, o = words.tobytes(), words_off.tolist()
        count = Counter(dict(zip([raw[s:e] for s, e in zip(o, o[1:], strict=False)], np.bincount(index, minlength=len(o) - 1).tolist(), strict=True)))
        for i in np.flatnonzero(~simple).tolist():
            for piece in self.cut.split(column[i].as_py() or ""):
                if piece not in self.special:
                    count.update(w.encode() for w in WORDS.findall(normal(piece)))
        return list(count), np.fromiter(count.values(), np.int64, len(count))

    def _plain_ids(self, data: np.ndarray, off: np.ndarray, lexicon) -> tuple[np.ndarray, np.ndarray]:
        """Of Latin-1 texts: cut, told apart and looked up as arrays of bytes."""
        data = lowered(data)
        starts, ends, first = pieces(data, off)
        words, words_off, index = distinct(data, starts, ends)
        ids, ids_off = self.word_ids(words, words_off, lexicon)
        out, out_off = kit.taken(ids, ids_off, index)
        return out, out_off[first]

    def _other_ids(self, texts: list[str], lexicon) -> tuple[np.ndarray, np.ndarray]:
        """Of any texts: special tokens, Unicode normalisation and classes. A text with code points that this Python's Unicode tables lack goes to the tokenizers library whole."""
        words: dict[str, int] = {}
        rows: list[list[int]] = []  # numbers of words, or -1 - id of a special token
        foreign: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            row: list[int] = []
            if any(unicodedata.category(c) == "Cn" for c in set(t)):
                foreign[k] = library(self.path).encode(t, add_special_tokens=False).ids
            else:
                for piece in self.cut.split(t):
                    if piece in self.special:
                        row.append(-1 - self.special[piece])
                    else:
                        row += [words.setdefault(w, len(words)) for w in WORDS.findall(normal(piece))]
            rows.append(row)
        raw = [w.encode() for w in words]
        ids, ids_off = self.word_ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64), lexicon)
        tail = sorted(self.special.values())
        extra = [-1 - i for i in tail]
        ids, ids_off = np.concatenate([ids, tail]).astype(np.int64), np.concatenate([ids_off, ids_off[-1] + 1 + np.arange(len(tail))])
        place = {e: len(words) + k for k, e in enumerate(extra)}
        out = [foreign[k] if k in foreign else kit.taken(ids, ids_off, np.array([place.get(w, w) for w in row], np.int64))[0] for k, row in enumerate(rows)]
        return np.concatenate([np.zeros(0, np.int64), *map(np.asarray, out)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def word_ids(self, data: np.ndarray, off: np.ndarray, lexicon) -> tuple[np.ndarray, np.ndarray]:
        if lexicon is None:
            return self.merged(data, off)
        known = lexicon.ranks(data, off)
        unseen = np.flatnonzero(known < 0)
        new, new_off = self.merged(*kit.taken(data, off, unseen))
        old, old_off = np.asarray(lexicon.ids), np.asarray(lexicon.offsets)
        index = known.copy()
        index[unseen] = len(old_off) - 1 + np.arange(len(unseen))
        return kit.taken(np.concatenate([old, new]), np.concatenate([old_off, old_off[-1] + new_off[1:]]), index)


# ---- texts of ASCII and Latin-1 letters, as arrays

_C2_NUMBER = np.isin(np.arange(256), [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
_C2_LETTER = np.isin(np.arange(256), [0xAA, 0xB5, 0xBA])


def plain(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have only code points under 256, no white space but ASCII's, no separators 1C to 1F and no '<|'."""
    odd = (data > 0xC3) | ((data >= 0x1C) & (data <= 0x1F))
    if len(data) > 1:
        after = data[1:]
        odd[:-1] |= ((data[:-1] == 0xC2) & ((after == 0x85) | (after == 0xA0))) | ((data[:-1] == 0x3C) & (after == 0x7C))
    return kit.row_sums(odd, off) == 0


def lowered(data: np.ndarray) -> np.ndarray:
    out = kit.LOWER[data]
    if len(data):
        up = np.flatnonzero(data[:-1] == 0xC3) + 1
        up = up[(data[up] >= 0x80) & (data[up] <= 0x9E) & (data[up] != 0x97)]
        out[up] += 0x20
    return out


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered Latin-1 texts, and where each text's words begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = np.full(256, 3, np.int8)  # 0 space, 1 letter, 2 number, 3 other
    kind[kit.SPACE], kind[97:123], kind[48:58] = 0, 1, 2
    c = kind[data]
    lead = np.flatnonzero(data >= 0xC2)
    then = data[lead + 1]
    c3 = data[lead] == 0xC3
    c[lead] = np.where(c3, np.where((then == 0x97) | (then == 0xB7), 3, 1), np.where(_C2_LETTER[then], 1, np.where(_C2_NUMBER[then], 2, 3)))
    c[lead + 1] = c[lead]
    border = np.zeros(n + 1, bool)
    border[off] = True
    begin = np.ones(n, bool)
    begin[1:] = (c[1:] != c[:-1]) | (c[1:] == 2)
    begin |= border[:-1]
    begin[lead + 1] = False
    quote = np.flatnonzero((data == 39) & begin)
    if len(quote):  # 's 't 'm 'd 're 've 'll at the start of a word
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        inside = np.concatenate([~border[:-1], np.zeros(4, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & inside[quote + 1]
        long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & inside[quote + 1] & inside[quote + 2]
        begin[quote[short | long] + 1] = False
        begin[quote[long] + 2] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        begin[after[after < n]] = True
    begin &= c != 0
    starts = np.flatnonzero(begin)
    stop = begin | (c == 0) | border[:-1]
    nxt = np.append(np.flatnonzero(stop), n)
    ends = nxt[np.searchsorted(nxt, starts) + 1]
    return starts, ends, np.searchsorted(starts, off)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ranges of bytes (rows of bytes and their offsets), and for each range which of them it is."""
    h = kit.range_hashes(data, starts, ends)
    _, first, index = np.unique(h, return_index=True, return_inverse=True)
    lengths = ends - starts
    row, at = kit.ragged(lengths)
    same = lengths[first[index]] == lengths
    if not same.all() or not (data[starts[row] + at] == data[starts[first[index]][row] + at]).all():  # two words of one hash
        words: dict[bytes, int] = {}
        raw = data.tobytes()
        index = np.array([words.setdefault(raw[s:e], len(words)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), index
    own, own_at = kit.ragged(lengths[first])
    return data[starts[first][own] + own_at], np.concatenate([[0], np.cumsum(lengths[first])]), index


def normal(text: str) -> str:
    """NFC, white space to single spaces, lower case letter by letter (no special form of a final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return _BLANK.sub(" ", text).lower()


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
