"""Test items whose text occurs, whole or in part, in documents.

The test items make a BM25 inverted index; every passage of every document is a
query against it. Terms are words. A word of a passage counts as each word of the
index that it equals, is one slip away from (found by the words less one letter that
both have), or makes together with the word after it, so slips are put right before
anything is retrieved. A term's impact is shared out among its places in an item.

*Threshold.* A passage that holds half of an item's words, in whatever pattern, has at
least the sum of the item's least impacts, as many as half of its words. This is the
item's threshold, so retrieval loses no pair that verification would accept.

*Block-max WAND* over a batch of documents at once: items are put into blocks of
similar length and language, a block's passages are windows of twice its longest item,
a quarter of that apart. Per term and block the index has the greatest impact that the
term has in an item of the block; running sums of these along the text give every
window's upper bound by one subtraction, and only windows whose bound reaches the least
threshold of a block are scored against its items. In a narrow trade half of an item's
words are common ones, so many windows reach it; these are run through a bit-parallel
longest common subsequence, all windows at once, before any is verified word by word.

*Verification.* The longest common subsequence of item and passage must have half of
the item's words, with words that differ by one slip counted too.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.kmers import mix
from kinfold.llm.tokens import char_ranges, slices
from kinfold.session import Scratch

K1, B = 1.2, 0.75
BLOCK = 8
#: Share of an item's words that a passage must hold, in order.
SHARE = 0.5
#: Lengths of words whose slips are put right; shorter ones are near too many others.
SLIP_FROM, SLIP_TO = 4, 60
#: Items of one index that is sent to the executors; more make several indexes, one
#: after another. An index takes at most about 60 bytes a character of its items.
INDEX_ITEMS, INDEX_CHARS = 5000, 5_000_000
#: Cells of the table of windows and terms that is counted at once.
CELLS = 4_000_000
#: Rounding of sums is no reason to miss a threshold.
EPS = 1 - 1e-5
PAIRS = "doc_id long, item_id long"
ROW = "\ue000"  # parts the texts of a batch: a private-use character, never a letter

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w",
    "х": "x", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
}
#: Letters that are written with two (fixed values).
WIDE = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "ij"}
_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|font|sub|sup|mark|small|code|s|tt|q)\b[^<>\ue000]{0,300}>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>\ue000]{0,500}>")
_BROKEN = re.compile("[ÂÃ].", re.S)
_HYPHEN = re.compile("[-\u2010\u00ad](?<=[^\\W\\d_].)[ \t]*\r?\n[ \t]*(?=[^\\W\\d_])")  # begins with what is rare


@cache
def fold_table() -> np.ndarray:
    """By code point: the letter or digit it counts as, 1 if it is passed over
    (marks, invisible characters), 0 if it ends a word."""
    table = np.zeros(0x110000, np.uint32)
    table[char_ranges(r"[\p{L}\p{N}]")] = 2
    own = table == 2
    for c in np.flatnonzero(own):
        # the big scripts without case or marks stay as they are
        if 0x3400 <= c <= 0xD7A3 or c >= 0x20000:
            table[c] = c
            continue
        low = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).casefold()
        low = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
        low = LOOKALIKES.get(low[:1], low[:1])
        table[c] = ord(low) if low and (low.isalnum()) else c
    table[char_ranges(r"[\p{M}\p{Cf}]")] = 1
    table[char_ranges(r"[\p{Cc}\p{Co}]")] = 0
    for c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        table[c] = 1
    for c in map(ord, "_'’‘`´"):
        table[c] = 0
    return table


def _repair(m: re.Match) -> str:
    """A UTF-8 pair that was read as Latin-1 or Windows-1252."""
    for code in ("latin-1", "cp1252"):
        try:
            return m[0].encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def plain(text: str) -> str:
    """Markup, entities, broken encodings, hyphens at line ends and wide letters."""
    if "Ã" in text or "Â" in text:
        text = _BROKEN.sub(_repair, text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "-" in text or "‐" in text or "­" in text:
        text = _HYPHEN.sub("", text)
    if not text.isascii():
        for a, b in WIDE.items():
            text = text.replace(a, b)
    return text


def fold(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters, and where each word begins and ends among them. ``ROW`` is
    a word of its own."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = fold_table()[points]
    letters[points == ord(ROW)] = 2  # stands for the end of a text
    letters = letters[letters != 1]
    inside = letters > 0
    marks = letters == 2
    begin = inside & ~np.r_[False, inside[:-1]]
    begin |= marks
    begin[1:] |= inside[1:] & marks[:-1]
    begin = np.flatnonzero(begin)
    stop = inside & ~np.r_[inside[1:], False]
    stop |= marks
    stop[:-1] |= inside[:-1] & marks[1:]
    return letters, begin, np.flatnonzero(stop) + 1


def hash_words(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - begin
    if not len(begin):
        return np.zeros(0, np.uint64)
    head = np.cumsum(length) - length
    at = np.repeat(begin - head, length) + np.arange(length.sum())
    place = (at - np.repeat(begin, length)).astype(np.uint64)
    return np.add.reduceat(mix(letters[at].astype(np.uint64) + (place << np.uint64(32))), head)


def words_of(text: str | None) -> tuple[list[str], np.ndarray]:
    letters, begin, end = fold(plain(text or ""))
    words = ["".join(map(chr, letters[b:e])) for b, e in zip(begin, end, strict=True)]
    return words, hash_words(letters, begin, end)


def _places(letters: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words end to end, and their places within each word."""
    head = np.cumsum(length) - length
    turn = np.arange(length.sum())
    return letters[np.repeat(begin - head, length) + turn].astype(np.uint64), (turn - np.repeat(head, length)).astype(np.uint64)


def less_one(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, word)`` of words of middling length, whole and less each letter."""
    word = np.flatnonzero((end - begin >= SLIP_FROM) & (end - begin <= SLIP_TO))
    n = (end - begin)[word]
    letter, place = _places(letters, begin[word], n)
    far = np.uint64(32)
    run, moved = np.zeros(len(letter) + 1, np.uint64), np.zeros(len(letter) + 1, np.uint64)
    np.cumsum(mix(letter + (place << far)), out=run[1:])
    np.cumsum(mix(letter + ((np.maximum(place, np.uint64(1)) - np.uint64(1)) << far)), out=moved[1:])
    high = np.cumsum(n)
    low = high - n
    at = np.arange(len(letter))
    less = run[at] - run[np.repeat(low, n)] + moved[np.repeat(high, n)] - moved[at + 1]
    return np.concatenate([run[high] - run[low], less]), np.concatenate([word, np.repeat(word, n)])


def _expand(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``low[0], low[0] + 1, ...`` for ``n[0]`` numbers, and so on."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """BM25 impacts of the words of up to INDEX_ITEMS items, in blocks by length."""

    def __init__(self, items: list[tuple[int, str]]):
        parsed = [(i, *words_of(t)) for i, t in items]
        parsed = [p for p in parsed if p[1]]
        n = len(parsed)
        spelling = {h: w for p in parsed for w, h in zip(p[1], p[2].tolist(), strict=True)}
        self.vocabulary = np.array(sorted(spelling), np.uint64)
        self.spelling = [spelling[h] for h in self.vocabulary.tolist()]
        terms = [np.searchsorted(self.vocabulary, p[2]).astype(np.int32) for p in parsed]
        df = np.bincount(np.concatenate([np.unique(t) for t in terms]), minlength=len(self.vocabulary)) if n else np.zeros(0)
        # one language is told by its commonest word, one length by a power of 1.3
        order = sorted(range(n), key=lambda i: (int(np.log(len(terms[i])) / np.log(1.3)), int(terms[i][np.argmax(df[terms[i]])]), len(terms[i]), parsed[i][0]))
        self.ids = [parsed[i][0] for i in order]
        self.words = [terms[i] for i in order]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = np.mean([len(t) for t in terms]) if n else 1.0
        self.blocks = [slice(b, min(b + BLOCK, n)) for b in range(0, n, BLOCK)]
        #: Per item: terms, how often it has each, impact per place; per block: terms
        #: and the greatest impact of each.
        self.postings, self.threshold = [], np.zeros(n)
        for i, t in enumerate(self.words):
            u, tf = np.unique(t, return_counts=True)
            weight = idf[u] * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            self.postings.append((u, tf.astype(np.int32), weight.astype(np.float32)))
            self.threshold[i] = np.sort(np.repeat(weight, tf))[: -(-len(t) // 2)].sum() * EPS
        self.block_terms, self.block_max = [], []
        for b in self.blocks:
            u, back = np.unique(np.concatenate([p[0] for p in self.postings[b]]), return_inverse=True)
            top = np.zeros(len(u), np.float32)
            np.maximum.at(top, back, np.concatenate([p[2] for p in self.postings[b]]))
            self.block_terms.append(u)
            self.block_max.append(top)
        self.block_threshold = [float(self.threshold[b].min()) for b in self.blocks]
        self.span = [2 * max(len(w) for w in self.words[b]) + 16 for b in self.blocks]
        # words less one letter, sorted by hash
        letters = np.array([ord(c) for w in self.spelling for c in w], np.uint32)
        stop = np.cumsum([len(w) for w in self.spelling], dtype=np.int64)
        less, word = less_one(letters, np.r_[0, stop][:-1], stop) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        by_hash = np.argsort(less, kind="stable")
        self.less, self.less_word = less[by_hash], word[by_hash].astype(np.int32)

    def nbytes(self) -> int:
        flat = [self.vocabulary, self.less, self.less_word, *self.words, *self.block_terms, *self.block_max, *(x for p in self.postings for x in p)]
        return sum(x.nbytes for x in flat) + sum(60 + 4 * len(w) for w in self.spelling)

    def item(self, i: int) -> list[str]:
        return [self.spelling[t] for t in self.words[i].tolist()]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        v = len(self.vocabulary)
        if not v:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), v - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def near(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word, term)``: words of a text and the terms that they are one slip from."""
        less, word = less_one(letters, begin, end)
        low, high = np.searchsorted(self.less, less), np.searchsorted(self.less, less, "right")
        word, term = np.repeat(word, high - low), self.less_word[_expand(low, high - low)]
        both = np.unique(word * len(self.vocabulary) + term)
        word, term = both // max(len(self.vocabulary), 1), both % max(len(self.vocabulary), 1)
        text: dict[int, str] = {}
        keep = []
        for w, t in zip(word.tolist(), term.tolist(), strict=True):
            if w not in text:
                text[w] = "".join(map(chr, letters[begin[w] : end[w]]))
            keep.append(text[w] != self.spelling[t] and one_slip(text[w], self.spelling[t]))
        keep = np.array(keep, bool)
        return word[keep], term[keep]

    def hits(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, in order, and terms of the words that some item has or is near to."""
        hashes = hash_words(letters, begin, end)
        hashes[marks] = 0
        kinds, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
        term = self.look_up(kinds)
        own = np.flatnonzero(term >= 0)
        word, near = self.near(letters, begin[sample], end[sample])
        who, what = np.concatenate([own, word]), np.concatenate([term[own], near])
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        each = np.bincount(who, minlength=len(kinds))
        n = each[kind]
        at, t = np.repeat(np.arange(len(kind)), n), what[_expand((np.cumsum(each) - each)[kind], n)]
        # halves of a word: the second's letters are hashed at the places after the first
        first = np.flatnonzero(~(marks[:-1] | marks[1:])) if len(marks) > 1 else np.zeros(0, np.int64)
        if len(first):
            n = (end - begin)[first + 1]
            letter, place = _places(letters, begin[first + 1], n)
            place += np.repeat((end - begin)[first], n).astype(np.uint64)
            with np.errstate(over="ignore"):
                joined = hashes[first] + np.add.reduceat(mix(letter + (place << np.uint64(32))), np.cumsum(n) - n)
            term = self.look_up(joined)
            at, t = np.concatenate([at, first[term >= 0]]), np.concatenate([t, term[term >= 0]])
            order = np.argsort(at, kind="stable")
            at, t = at[order], t[order]
        return at, t

    def candidates(self, at: np.ndarray, hit: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, from, to)`` of windows that reach an item's threshold and have
        half of its words in order. ``edge``: where the texts begin among the words.
        Texts are parted by one word of no item."""
        length = np.diff(edge) - 1
        # hits before each place
        before = np.zeros(edge[-1] + 1, np.int64)
        np.cumsum(np.bincount(at, minlength=edge[-1]), out=before[1:])
        local = np.full(len(self.vocabulary), -1, np.int32)
        own = np.zeros(len(hit) + 1, np.int64)
        for b, span in enumerate(self.span):
            terms = self.block_terms[b]
            local[terms] = np.arange(len(terms))
            term = local[hit]
            local[terms] = -1
            inside = term >= 0
            np.cumsum(inside, out=own[1:])  # hits of the block before each hit
            place, term = at[inside], term[inside]
            run = np.zeros(len(term) + 1)
            np.cumsum(self.block_max[b][term], dtype=np.float64, out=run[1:])
            step = max(1, span // 4)
            n = np.maximum(1, -(-(length - span) // step) + 1) * (length > 0)
            text = np.repeat(np.arange(len(length)), n)
            low = edge[text] + _expand(np.zeros(len(n), np.int64), n) * step
            high = np.minimum(low + span, edge[text] + length[text])
            first, last = own[before[low]], own[before[high]]
            some = np.flatnonzero(run[last] - run[first] >= self.block_threshold[b] * EPS)
            for r, i in self._scored(b, place, term, first[some], last[some]):
                w = some[r]
                yield int(text[w]), i, int(low[w]), int(high[w])

    def _scored(self, b: int, place: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
        """Windows (runs of hits) and items of a block, exactly scored."""
        terms, base = self.block_terms[b], self.blocks[b].start
        items = range(base, self.blocks[b].stop)
        table = item_bits([np.searchsorted(terms, self.words[i]) for i in items], len(terms))
        need = SHARE * np.array([len(self.words[i]) for i in items])
        lists = []
        for i in items:
            u, tf, weight = self.postings[i]
            lists.append((np.searchsorted(terms, u), tf[:, None].astype(np.float32), np.stack([weight, np.ones(len(u), np.float32)])))
        own: dict[int, np.ndarray] = {}  # hits of each item
        rows = max(1, CELLS // len(terms))
        for c in range(0, len(first), rows):
            lo, n = first[c : c + rows], (last - first)[c : c + rows]
            count = np.bincount(term[_expand(lo, n)] * len(lo) + np.repeat(np.arange(len(lo)), n), minlength=len(lo) * len(terms))
            count = count.reshape(len(terms), len(lo)).astype(np.float32)
            of, at, mask, windows = [], [], [], []
            for i in items:
                u, tf, weight = lists[i - base]
                # half of the item's places are held, and their impacts reach its threshold
                impact, held = weight @ np.minimum(count[u], tf)
                row = np.flatnonzero((impact >= self.threshold[i] * EPS) & (held >= need[i - base] * EPS))
                if not len(row):
                    continue
                bits = table[:, i - base]
                if i not in own:
                    own[i] = np.flatnonzero(bits.any(axis=0)[term])
                low, high = np.searchsorted(own[i], lo[row]), np.searchsorted(own[i], (lo + n)[row])
                take = own[i][_expand(low, high - low)]
                of.append(np.repeat(np.arange(len(row)), high - low) + sum(map(len, windows)))
                at.append(place[take])
                mask.append(bits[:, term[take]])
                windows.append(row * len(items) + (i - base))
            if windows:
                windows = np.concatenate(windows)
                common = common_in_windows(np.concatenate(of), np.concatenate(at), np.concatenate(mask, axis=1), len(windows))
                for k in windows[common >= need[windows % len(items)]].tolist():
                    yield c + k // len(items), base + k % len(items)


def item_bits(items: list[np.ndarray], v: int) -> np.ndarray:
    """Words of 64 bits by word, item and term (below ``v``): the term's places."""
    nw = max(-(-len(x) // 64) for x in items)
    table = np.zeros((nw, len(items), v), np.uint64)
    for i, x in enumerate(items):
        k = np.arange(len(x))
        np.bitwise_or.at(table, (k // 64, i, x), np.uint64(1) << (k % 64).astype(np.uint64))
    return table


def common_in_windows(of: np.ndarray, at: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
    """Length of the longest common subsequence of an item and a passage for each of
    ``n`` windows: ``of`` (rising) tells the window of each hit, ``at`` (rising in a
    window) its place, ``mask`` the item's places with its term, a bit each in words of
    64. Hits of one place match any of their terms. All windows a place at a time."""
    nw = len(mask)
    if not len(of):
        return np.zeros(n, np.int64)
    fresh = np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])]
    if not fresh.all():
        start = np.flatnonzero(fresh)
        mask, of = np.bitwise_or.reduceat(mask, start, axis=1), of[start]
    # windows with more places first, and first places of all windows first
    count = np.bincount(of, minlength=n)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    alive = np.searchsorted(-count[order], -np.arange(int(count.max())), "left")
    turn = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    begin = np.cumsum(alive) - alive
    laid = np.empty_like(mask)
    laid[:, begin[turn] + rank[of]] = mask
    rest = np.full((nw, n), 2**64 - 1, np.uint64)
    for b, m in zip(begin.tolist(), alive.tolist(), strict=True):
        carry = None
        for w in range(nw):
            r = rest[w, :m]
            hit = r & laid[w, b : b + m]
            total = r + hit
            if w + 1 < nw:
                over = total < hit
            if carry is not None:
                total += carry
                if w + 1 < nw:
                    over |= carry & (total == 0)
            if w + 1 < nw:
                carry = over
            np.subtract(r, hit, out=r)
            np.bitwise_or(r, total, out=r)
    # bits that no place of the item has never fall
    out = np.empty(n, np.int64)
    out[order] = 64 * nw - np.bitwise_count(rest).sum(axis=0, dtype=np.int64)
    return out


def common_words(bits: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence, an item's place per bit."""
    full = (1 << n) - 1
    rest = full
    for w in words:
        m = bits.get(w)
        if m is not None:
            u = rest & m
            rest = ((rest + u) | (rest - u)) & full
    return n - rest.bit_count()


def one_slip(a: str, b: str) -> bool:
    """One letter put in, left out, changed, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


class Slips:
    """Puts right words that are one slip from a word of the item. Short words are
    left: they are near too many others. Candidates share a word less one letter."""

    def __init__(self, item: list[str]):
        self.known = set(item)
        self.less: dict[str, list[str]] = {}
        self.seen: dict[str, str] = {}
        for w in sorted(self.known):
            if len(w) >= SLIP_FROM:
                for x in self._less(w):
                    self.less.setdefault(x, []).append(w)

    @staticmethod
    def _less(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def right(self, w: str) -> str:
        if w in self.known or not SLIP_FROM <= len(w) <= SLIP_TO:
            return w
        if w not in self.seen:
            if len(self.seen) > 50_000:  # bounds memory; a word is looked up anew
                self.seen.clear()
            near = (k for x in self._less(w) for k in self.less.get(x, ()) if one_slip(w, k))
            self.seen[w] = min(near, default=w)
        return self.seen[w]

    def passage(self, words: list[str]) -> list[str]:
        """Each word put right, and two halves of a word put together."""
        out, i = [], 0
        while i < len(words):
            w = words[i]
            if w not in self.known and i + 1 < len(words) and w + words[i + 1] in self.known:
                w += words[i + 1]
                i += 1
            out.append(self.right(w))
            i += 1
        return out


def holds(item: list[str], passage: list[str], slips: Slips | None = None) -> bool:
    """Some stretch of one and a half times the item's length has SHARE of its
    words in order."""
    n = len(item)
    need, span = -(-n * SHARE // 1), n * 3 // 2 + 8
    bits: dict[str, int] = {}
    for k, w in enumerate(item):
        bits[w] = bits.get(w, 0) | (1 << k)
    passage = (slips or Slips(item)).passage(passage)
    if common_words(bits, n, passage) < need:
        return False
    step = max(1, n // 8)
    return any(common_words(bits, n, passage[s : s + span]) >= need for s in range(0, max(1, len(passage) - span + step), step))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        items: dict[int, tuple[list[str], Slips]] = {}
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                text = plain(ROW.join((t or "").replace(ROW, " ") for t in part.column("text").to_pylist()) + ROW)
                letters, begin, end = fold(text)
                marks = letters[begin] == 2  # the last word of each text
                edge = np.r_[0, np.flatnonzero(marks) + 1]
                found: set[tuple[int, int]] = set()
                for r, i, low, high in index.candidates(*index.hits(letters, begin, end, marks), edge):
                    if (r, i) not in found:
                        passage = ["".join(map(chr, letters[b:e])) for b, e in zip(begin[low:high], end[low:high], strict=True)]
                        if i not in items:
                            items[i] = (index.item(i), Slips(index.item(i)))
                        if holds(items[i][0], passage, items[i][1]):
                            found.add((r, i))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r, _ in found], pa.int64()), pa.array([index.ids[i] for _, i in found], pa.int64())],
                        names=["doc_id", "item_id"])

    return run


def index_shards(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most INDEX_ITEMS items and about INDEX_CHARS characters, read
    one after another, so that the driver holds one at a time."""
    some, chars = [], 0
    for r in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        some.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if len(some) >= INDEX_ITEMS or chars >= INDEX_CHARS:
            yield Index(some)
            some, chars = [], 0
    if some:
        yield Index(some)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: the document holds, in one passage, at least half of
    the item's words in order; each pair once.

    Case, accents, markup, entities, invisible characters, look-alike letters,
    hyphens at line ends and broken encodings don't matter. An item without words
    (null, blank, marks alone) leaks nowhere; a null text holds nothing; null ids
    are left out. Documents are read once per index of items (see
    :func:`index_shards`), nothing of them is shuffled but the pairs found. With more
    than one index, each one's pairs are written before the next is made and sent.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    shards = (x for x in index_shards(items) if x.ids)
    index = next(shards, None)
    if index is None:
        return spark.createDataFrame([], PAIRS)
    out, scratch = None, Scratch(spark, "leaks")
    while index is not None:
        sent = spark.sparkContext.broadcast(index)
        found = docs.mapInArrow(_scan(sent), PAIRS)
        number, index = 0 if out is None else number + 1, next(shards, None)
        if index is not None or out is not None:
            found = scratch.write(found, f"shard{number}")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.distinct()
