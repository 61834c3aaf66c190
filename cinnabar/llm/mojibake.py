"""Text that was read in another encoding than it was written in: finding it, and restoring it where it isn't lost.

Texts are compared by line, without the marks of a quotation. Lines that are equal but for their non-ASCII characters are
near-twins; lines with less than ``SKELETON`` ASCII characters are twins where the whole texts around them are and they
stand at the same place. The most frequent line of such a group is joined to each other one, their non-ASCII runs are
aligned by the ASCII characters before them, and the transformations are looked for that turn each run of one into that of
the other: written in W, read in R, once or more. Few transformations that explain all twins are kept, the most frequent
ones first; and from the aligned characters comes the mapping: which garbled piece stands for which character, by how many
twins. What the twins show is then applied, inverted, to every other line.

A transformation is only believed of a stretch that it makes likelier: every pair of neighbouring characters at it must
have been seen, after inversion, with a weight of ``SEEN`` or more (three lines, or one that nine texts have) above what
chance puts in a place of the table, and ``TIMES`` as often as before it unless all its pieces are in the mapping with
``VOTES`` twins. Pairs are counted over the distinct lines of all texts, in a table of fixed size. A multi-byte W may hold
for some stretches of a line, since bytes that happen to form its sequences are evidence of their own; a single-byte W,
which decodes anything, must hold for most stretches of a line, leave no character of it out and make words that are better
known than those before. Lines unlike any other are also tried with transformations that no twin showed, on stronger
evidence (``shown`` is false then). A replacement character is a loss by itself, and C1 control characters are no text.
What rests on single bytes or lost characters doesn't hold for a line of ``MANY`` texts unless more texts have it restored.

Edge cases: null, empty and ASCII texts are not affected; texts of any length are read whole; rows with equal keys are
separate; null keys come out like others; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from . import bits

#: encodings that text is taken for, and those it may have been written in
READ = "cp1252 latin-1 iso8859-15 iso8859-2 cp1250 cp1251 koi8-r cp866 mac-roman cp437 cp850 cp1254 cp1253 iso8859-5 mac-cyrillic".split()
WRITTEN = ["utf-8", "euc-jp", "cp932", *READ]
MULTI = frozenset({"utf-8", "euc-jp", "cp932"})
TABLE = 1 << 20
UNIT = 4  #: weight of a line that is in one text; a line in n texts weighs UNIT times the root of n
SEEN = 3 * UNIT
TIMES = 3.0
VOTES = 3  #: twins that a learned piece needs
MANY = 9  #: texts that have a line on purpose, if none has more of its restored form
SKELETON = 8  #: ASCII characters that near-twins share at least
DEPTH = 3  #: transformations one upon the other
NEVER = 1 << 40
KEEP = 1_000_000  #: findings that a worker remembers
CHARACTERS = 2_000_000  #: that are counted at a time
LOST = "�"


def _table(codec: str) -> list[str]:
    """The character of each byte; bytes without one are read as their own number, as programs do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_DECODE = {c: _table(c) for c in READ}
_ENCODE = {c: {ch: b for b, ch in reversed(list(enumerate(t)))} for c, t in _DECODE.items()}
#: punctuation, currencies, arrows and mathematical signs
_SYMBOLS = ((0x2010, 0x2045), (0x20A0, 0x20C0), (0x2190, 0x219A), (0x2200, 0x2266))
_READABLE = frozenset(c for t in _DECODE.values() for c in t if c > "\x7f")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: as two-byte encodings have it whose second byte may be ASCII
_TRAILED = re.compile(r"(?:[^\x00-\x7f]+[\x40-\x7e]?)+")
_PAIRED = re.compile(rb"(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+")
_WORD = re.compile(r"[^\W\d_]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")


def _written(text: str, codec: str) -> bytes | None:
    if codec in _ENCODE:
        try:
            return bytes([_ENCODE[codec][c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def garbled(text: str, written: str, read: str) -> str | None:
    """``text`` written in one encoding and read in another; None where the first can't write it."""
    raw = _written(text, written)
    if raw is None:
        return None
    t = _DECODE[read]
    return "".join([t[b] for b in raw])


def aligned(a: str, b: str) -> list[tuple[str, str]] | None:
    """Pairs of differing non-ASCII runs of near-twins, by the visible ASCII characters before them."""

    def runs(x: str) -> dict[int, str]:
        out: dict[int, str] = {}
        at = 0
        for m in re.finditer(r"([\x21-\x7e]+)|([^\x21-\x7e]+)", x):
            if m.group(1):
                at += len(m.group(1))
            elif not m.group(2).isascii():
                out[at] = m.group(2).strip(" ")
        return out

    ra, rb = runs(a), runs(b)
    if ra.keys() != rb.keys():
        return None
    return [(ra[k], rb[k]) for k in ra if ra[k] != rb[k]]


def _explains(clean: tuple[str, ...], bad: tuple[str, ...]) -> list[tuple[str, str, int]]:
    """The (written, read, times) that turn each of ``clean`` into that of ``bad``."""
    found = []
    for w in WRITTEN:
        raw = _written(clean[0], w)
        if not raw or len(raw) > len(bad[0]):
            continue
        for r in READ:
            t = _DECODE[r]
            if w == r or len(raw) == len(bad[0]) and (t[raw[0]] != bad[0][0] or t[raw[-1]] != bad[0][-1]):
                continue
            now: list[str | None] = list(clean)
            for times in range(1, DEPTH + 1):
                now = [garbled(x, w, r) for x in now]
                if None in now or len(now[0]) > len(bad[0]):
                    break
                if all(x == y for x, y in zip(now, bad)):
                    found.append((w, r, times))
                    break
                if w not in MULTI and times == 2:
                    break
    return found


def transformations(one: str, two: str, flips: bool = True) -> list[tuple[str, str, bool]]:
    """The (written, read, whether ``two`` is the clean one) that turn the runs of one twin into those of the other, all at once."""
    pairs = aligned(one, two)
    if not pairs:
        return []
    a, b = zip(*pairs)
    return [(w, r, False) for w, r, _ in _explains(a, b)] + ([(w, r, True) for w, r, _ in _explains(b, a)] if flips else [])


def pieces(clean: tuple[str, ...], written: str, read: str, times: int) -> set[tuple[str, str]]:
    """(garbled piece, character) of what is not ASCII in ``clean``, of each step where it was garbled more than once."""
    out = set()
    for _ in range(times):
        out |= {(g, c) for x in clean for c in x if c > "\x7f" and (g := garbled(c, written, read)) and g != c}
        clean = tuple(garbled(x, written, read) or "" for x in clean)
    return out


@lru_cache(maxsize=400_000)
def _run_spots(run: str, written: str, read: str) -> tuple[tuple[int, int, str], ...]:
    """(start, end, restored) of the stretches of a run that the transformation may have made."""
    enc = _ENCODE[read]
    out: list[tuple[int, int, str]] = []
    at = 0
    while at < len(run):
        end = at
        while end < len(run) and run[end] in enc:
            end += 1
        if end > at:
            part = run[at:end]
            raw = bytes([enc[c] for c in part])
            if written == "utf-8":
                for q in _UTF8.finditer(raw):
                    try:
                        d = q.group().decode()
                    except UnicodeDecodeError:
                        continue
                    s, e = at + q.start(), at + q.end()
                    if out and out[-1][1] == s:
                        out[-1] = (out[-1][0], e, out[-1][2] + d)
                    else:
                        out.append((s, e, d))
            elif written == "cp932":
                for q in _PAIRED.finditer(raw):
                    try:
                        out.append((at + q.start(), at + q.end(), q.group().decode(written)))
                    except UnicodeDecodeError:
                        pass
            elif written in MULTI:
                try:
                    out.append((at, end, raw.decode(written)))
                except UnicodeDecodeError:
                    pass
            else:
                t = _DECODE[written]
                d = "".join([t[b] for b in raw])
                if d != part:
                    out.append((at, end, d))
        at = max(end, at + 1)
    return tuple(out)


def _lossy(written: str, read: str) -> dict[str, list[str]]:
    """What is left of a character's garbled form where the control characters in it were dropped."""
    out: dict[str, list[str]] = {}
    for c in sorted({c for t in _DECODE.values() for c in t if c > "\x9f"} | {chr(i) for a, b in _SYMBOLS for i in range(a, b)}):
        g = garbled(c, written, read) or ""
        left = "".join(x for x in g if not "\x80" <= x <= "\x9f")
        if left and left != g:
            out.setdefault(left, []).append(c)
    return out


def _plain(c: str) -> str:
    """Digits of ASCII count as alike, and letters in either case."""
    return "0" if "0" <= c <= "9" else c.lower() if c < "\x80" else c


def _runs(line: str, written: str = "") -> list[tuple[int, str, str, str]]:
    """(place, run, the character before it, the one after it) of the non-ASCII runs; nothing at the line's ends."""
    found = (_TRAILED if written == "cp932" else _RUN).finditer(line)
    return [(m.start(), m.group(), line[m.start() - 1 : m.start()] if m.start() else "", line[m.end() : m.end() + 1]) for m in found]


# the counts: places of pairs and characters in the lower half of a table, of words in the upper half


def _pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    h = p * np.uint32(0x9E3779B1) ^ q * np.uint32(0x85EBCA6B)
    return (h ^ h >> np.uint32(15)) & np.uint32(TABLE - 1)


def _characters(c: np.ndarray) -> np.ndarray:
    h = c * np.uint32(0x27D4EB2F)
    return (h ^ h >> np.uint32(13)) & np.uint32(TABLE - 1)


def _pair(p: str, q: str) -> int:
    """Place of a pair of characters."""
    h = (ord(_plain(p)) * 0x9E3779B1 ^ ord(_plain(q)) * 0x85EBCA6B) & 0xFFFFFFFF
    return (h ^ h >> 15) & TABLE - 1


def _character(c: str) -> int:
    h = ord(c) * 0x27D4EB2F & 0xFFFFFFFF
    return (h ^ h >> 13) & TABLE - 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letter_hash(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    return bits.mix(code.astype(np.uint64) | (place.astype(np.uint64) + np.uint64(1)) << np.uint64(21))


def _word(word: str) -> tuple[int, int]:
    """Two places of a word."""
    c = _codes(word)
    h = int(_letter_hash(c, np.arange(len(c))).sum(dtype=np.uint64))
    return TABLE + (h & TABLE - 1), TABLE + (h >> 32 & TABLE - 1)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which characters words are made of, and each ASCII character as it counts."""
    letter = np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)
    return letter, np.array([ord(_plain(chr(i))) for i in range(128)], np.uint32)


def words(text: str) -> list[str]:
    """Words with a letter beyond ASCII."""
    return [w for w in _WORD.findall(text) if not w.isascii()]


def count_lines(lines: list[str], weights: list[int], counts: np.ndarray) -> None:
    """Adds the lines' pairs, characters and words, each once a line, to a table of 2 TABLE places. Collisions only make a count larger."""
    if not lines:
        return
    letter, plain = _letters()
    code = _codes("\n" + "\n".join(x.replace("\n", " ") for x in lines) + "\n")
    line = np.cumsum(code == 10) - 1
    far = code > 127
    at = np.flatnonzero(far[:-1] | far[1:])
    low = code.copy()
    low[~far] = plain[code[~far]]
    places = [(line[at], _pairs(low[at], low[at + 1]).astype(np.int64)), (line[far], _characters(code[far]).astype(np.int64))]
    own = letter[code]
    start = np.flatnonzero(own & ~np.r_[False, own[:-1]])
    if len(start):
        size = np.flatnonzero(own & ~np.r_[own[1:], False]) + 1 - start
        cum = np.r_[0, np.cumsum(far)]
        beyond = cum[start + size] > cum[start]
        start, size = start[beyond], size[beyond]
    if len(start):
        place = bits.ranges(size)
        h = np.add.reduceat(_letter_hash(code[np.repeat(start, size) + place], place), np.cumsum(size) - size)
        for part in (h, h >> np.uint64(32)):
            places.append((line[start], TABLE + (part & np.uint64(TABLE - 1)).astype(np.int64)))
    key = np.unique(np.concatenate([i * (2 * TABLE) + p for i, p in places]))
    np.add.at(counts, key % (2 * TABLE), np.asarray(weights, counts.dtype)[key // (2 * TABLE)])


class Judge:
    """What the corpus says: which transformations and pieces its twins show, and how often pairs of characters are seen."""

    def __init__(self, counts: np.ndarray, chains: list[tuple[str, str]], learned: set[tuple[str, str]] = frozenset()):
        self.counts = counts
        self.most = int(counts[:TABLE].max(initial=0))
        # what a pair or word that was never seen finds in its place nine times of ten
        self.seen = SEEN + int(np.quantile(counts[:TABLE], 0.9))
        self.word_known = SEEN + int(np.quantile(counts[TABLE:], 0.7))
        self.chains, self.learned = chains, learned
        self.others = [(w, r) for w in WRITTEN for r in READ if w != r and (w, r) not in set(chains)]
        self.lossy = [(c, table) for c in chains if c[0] == "utf-8" and (table := _lossy(*c))]
        self.known: dict[tuple[str, str], int] = {}
        self.word_counts: dict[str, int] = {}
        self.shows: dict[tuple[str, str, str], bool] = {}
        self.hopes: dict[tuple, frozenset[tuple[str, str]]] = {}
        self.seen_runs: dict[tuple[str, str, str], tuple[frozenset, list, bool]] = {}

    def support(self, text: str, s: int, e: int) -> int:
        """The least count of the pairs at text[s:e], with the characters beside it; of many pairs the lower quartile."""
        t = (text[s - 1] if s else "\n") + text[s:e] + (text[e] if e < len(text) else "\n")
        found = []
        known = self.known
        for k in zip(t, t[1:]):
            n = known.get(k)
            if n is None:
                n = NEVER if k[0] < "\x80" and k[1] < "\x80" else int(self.counts[_pair(*k)])
                if len(known) < KEEP:
                    known[k] = n
            if n < NEVER:
                found.append(n)
        if len(found) < 8:
            return min(found, default=NEVER)
        return sorted(found)[len(found) // 4]

    def word_seen(self, word: str) -> int:
        n = self.word_counts.get(word)
        if n is None:
            a, b = _word(word)
            n = min(int(self.counts[a]), int(self.counts[b]))
            if len(self.word_counts) < KEEP:
                self.word_counts[word] = n
        return n

    def is_shown(self, restored: str, w: str, r: str) -> bool:
        """Whether the mapping has every piece of a stretch."""
        key = (restored, w, r)
        got = self.shows.get(key)
        if got is None:
            got = all(c < "\x80" or (garbled(c, w, r), c) in self.learned for c in restored)
            if len(self.shows) < KEEP:
                self.shows[key] = got
        return got

    def better(self, line: str, spots: list[tuple[int, int, str]], w: str, r: str, times: float, known: dict[tuple[int, int], int]) -> tuple[float, str] | None:
        """(gain, line) with the stretches restored that are likelier so; of a single-byte ``w`` nearly all must be, and make known words."""
        if not spots:
            return None
        every = w not in MULTI

        def replaced(some: list[tuple[int, int, str]]) -> str:
            parts, at = [], 0
            for s, e, d in some:
                parts += [line[at:s], d]
                at = e
            return "".join([*parts, line[at:]])

        new = replaced(spots)
        gain, good, shift, bad = 0.0, [], 0, 0
        for s, e, d in spots:
            before = known.get((s, e))
            if before is None:
                before = known[s, e] = self.support(line, s, e)
            a = s + shift
            after = self.support(new, a, a + len(d))
            shift += len(d) - (e - s)
            fine = not any("\x80" <= c <= "\x9f" or c == LOST for c in d)
            if w == "utf-8" and not d.strip(LOST):  # what was lost before was garbled since
                gain += 2 * len(d)
                good.append((s, e, d))
                continue
            if not every and e - s >= 3 * len(d):
                # three bytes that make a character in use are no accident, whatever stands beside it
                alone = min(int(self.counts[_character(c)]) for c in d)
                if alone > after and (e - s == 4 or len(d) > 1 or self.support(line[s:e], 1, 2) * times <= alone):
                    after, before = alone, min(before, self.support(line[s:e], 1, 2))
            if fine and self.seen <= after < NEVER and (after >= times * before or not every and self.is_shown(d, w, r)):
                gain += max(0.1, log((after + 0.5) / (before + 0.5))) * max(1, len(d) / 2)  # a long stretch is more evidence
                good.append((s, e, d))
            elif fine and w == "utf-8" and _CONTROL.search(line, s, e) and d.isprintable():
                gain += 2 * len(d)  # control characters that make one of the encoding's sequences
                good.append((s, e, d))
            elif every:
                bad += 1
                if bad * 2 > len(spots):
                    return None
        if not good:
            return None
        if every:
            old, fresh = words(line), words(new)
            gone, touched = [x for x in old if x not in fresh and len(x) > 1], [x for x in fresh if x not in old and len(x) > 1]
            known_old, known_new = ([self.word_seen(x) for x in some] for some in (gone, touched))
            if not touched:
                return (gain, new) if gain >= 2 * len(good) and not any(n >= self.word_known for n in known_old) else None
            if 5 * sum(n >= self.word_known for n in known_new) < 3 * len(touched):
                return None
            if sum(log(1 + n) for n in known_new) < sum(log(1 + n) for n in known_old) + log(TIMES):
                return None
            return gain, new
        return gain, new if len(good) == len(spots) else replaced(good)

    def hopeful(self, before: str, run: str, after: str, chains: list[tuple[str, str]], times: float) -> frozenset[tuple[str, str]]:
        """The transformations that make a run likelier between its two neighbours. Runs recur, so this is kept."""
        key = (_plain(before), run, _plain(after), times)
        got = self.hopes.get(key)
        if got is None:
            found = set()
            if any(c in _READABLE for c in run):
                text = before + run + after
                at = len(before)
                for w, r in chains:
                    spots = [(s + at, e + at, d) for s, e, d in _run_spots(run, w, r)]
                    if w == "cp932":  # its stretches may end beyond the run
                        more = [d for _, _, d in _run_spots(run + after if "\x40" <= after <= "\x7e" else run, w, r)]
                        if any(min(self.inside(d), default=0) >= self.seen for d in more):
                            found.add((w, r))
                    elif not spots:
                        continue
                    elif w in MULTI:
                        known: dict[tuple[int, int], int] = {}
                        if self.better(text, spots, w, r, TIMES, known) or w == "utf-8" and self.better(text, self.inner(spots, w, r), w, r, TIMES, known):
                            found.add((w, r))
                    elif any(self.single(text, s, e, d, times) for s, e, d in spots):
                        found.add((w, r))
            got = frozenset(found)
            if len(self.hopes) < KEEP:
                self.hopes[key] = got
        return got

    def inside(self, d: str) -> list[int]:
        """Counts of the pairs within a stretch, or of its one character."""
        return [int(self.counts[_pair(p, q)]) for p, q in zip(d, d[1:])] or [int(self.counts[_character(c)]) for c in d]

    def single(self, text: str, s: int, e: int, d: str, times: float) -> bool:
        after = self.support(text[:s] + d + text[e:], s, s + len(d))
        return self.seen <= after < NEVER and after >= times * self.support(text, s, e)

    @staticmethod
    def inner(spots: list[tuple[int, int, str]], w: str, r: str) -> list[tuple[int, int, str]]:
        """The stretches that were garbled twice, by way of something too rare to be believed."""
        out = []
        for s, e, d in spots:
            again = _run_spots(d, w, r)
            if len(again) == 1 and again[0][:2] == (0, len(d)):
                out.append((s, e, again[0][2]))
        return out

    def once(self, line: str, hopes: set[tuple[str, str]], times: float = TIMES) -> tuple[float, str, str] | None:
        """(gain, line, written) by the best of ``hopes``."""
        runs = _runs(line)
        best, known = None, {}
        for w, r in sorted(hopes):
            if w not in MULTI and 5 * sum(any(c not in _ENCODE[r] for c in run) for _, run, _, _ in runs) > len(runs):
                continue
            spots = [(at + s, at + e, d) for at, run, _, _ in (_runs(line, w) if w == "cp932" else runs) for s, e, d in _run_spots(run, w, r)]
            got = self.better(line, spots, w, r, TIMES if w in MULTI else times, known)
            if got is None and w == "utf-8":
                got = self.better(line, self.inner(spots, w, r), w, r, TIMES, known)
            if got and (best is None or got[0] > best[0] + 1e-9):
                best = (*got, w)
        return best

    def left_over(self, before: str, run: str, after: str) -> list[tuple[int, int, str]]:
        """(table, weight, character) for a run that may be what garbling and a lost control character left."""
        got = []
        text = before + run + after
        s, e = len(before), len(before) + len(run)
        for n, (_, table) in enumerate(self.lossy):
            for d in table.get(run, ()):
                if self.single(text, s, e, d, TIMES):
                    got.append((n, self.support(before + d + after, s, s + len(d)), d))
        return got

    def dropped(self, line: str) -> str | None:
        """The line with the likeliest characters for what garbling and lost control characters left; None if any run is left as it is."""
        runs = _runs(line)
        found: dict[int, dict[int, tuple[int, int, str]]] = {}
        for at, run, before, after in runs:
            for n, weight, d in self.look(before, run, after)[1]:
                own = found.setdefault(n, {})
                own[at] = max(own.get(at, (0, 0, "")), (weight, at + len(run), d))
        best = max(found.items(), key=lambda x: (len(x[1]), -x[0]), default=(0, {}))[1]
        if not runs or len(best) < len(runs):
            return None
        for s in sorted(best, reverse=True):
            _, e, d = best[s]
            line = line[:s] + d + line[e:]
        return line

    def look(self, before: str, run: str, after: str) -> tuple[frozenset, list, bool]:
        """Of a run: the transformations that may have made it, what may be left in it, whether it is unlike others."""
        key = (before, run, after)
        got = self.seen_runs.get(key)
        if got is None:
            s = len(before)
            rare = self.support(before + run + after, s, s + len(run)) < max(TIMES * self.seen, self.most / 1000)
            got = self.hopeful(before, run, after, self.chains, TIMES), self.left_over(before, run, after), rare
            if len(self.seen_runs) < KEEP:
                self.seen_runs[key] = got
        return got

    def restored(self, line: str) -> tuple[bool, str, bool, bool]:
        """Whether the line is affected, the line restored as far as it can be, whether twins showed how, whether the evidence is weak."""
        if line.isascii():
            return False, line, True, False
        affected = LOST in line
        shown, weak = True, not affected
        for _ in range(DEPTH):
            looks = [self.look(b, run, a) for _, run, b, a in _runs(line)]
            hopes = frozenset().union(*(x[0] for x in looks))
            got = self.once(line, hopes) if hopes else None
            if got is None:
                break
            affected, line = True, got[1]
            weak = weak and got[2] not in MULTI
        if any(x[1] for x in looks) and (got := self.dropped(line)) is not None:
            affected, line = True, got
        if not affected and 2 * sum(x[2] for x in looks) > len(looks):
            # a line unlike any other: what no twin showed, on stronger evidence
            hopes = frozenset().union(*(self.hopeful(b, run, a, self.others, 2 * TIMES) for _, run, b, a in _runs(line)))
            got = self.once(line, hopes, 2 * TIMES) if hopes else None
            if got is not None and got[0] >= 8:
                affected, line, shown = True, got[1], False
        if not affected and _CONTROL.search(line):
            affected, shown, weak = True, False, False
        return affected, line, shown, weak and affected


BREAK = r"[\r\n]"  #: each one breaks; between the two of a Windows break is an empty line
FAR = r"[^\x00-\x7f]+"
HIDDEN = r"[^\x21-\x7e]+"


def _far(x: Column | str) -> Column:
    """Whether a text isn't ASCII."""
    return F.octet_length(x) > F.char_length(x)


def _line(x: Column) -> Column:
    return F.ltrim(x, F.lit(">| \t"))


def _twins(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): the most frequent line of each group of twins with every other one, and their texts. Only hashes are grouped."""
    own = lines.where("s is not null").select(F.col("s").alias("k"), "h", "n")
    parts = texts.select(F.xxhash64(F.regexp_replace("text", FAR, "")).alias("t"), F.posexplode(F.split("text", BREAK)).alias("i", "line")).where(_far("line"))
    parts = parts.withColumn("line", _line(F.col("line"))).where(F.length(F.regexp_replace("line", HIDDEN, "")) < SKELETON)
    short = parts.groupBy(F.xxhash64("t", "i").alias("k"), F.xxhash64("line").alias("h")).agg(F.count("*").alias("n"))
    own = cut(own.unionByName(short))
    most = own.groupBy("k").agg(F.max_by("h", F.struct("n", "h")).alias("one"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = cut(own.join(most, "k").where("h <> one").select("one", F.col("h").alias("two")).distinct())
    # the few lines that have twins are looked up by hash
    wanted = pairs.select(F.col("one").alias("h")).unionByName(pairs.select(F.col("two").alias("h"))).distinct()
    text = cut(lines.select("h", "line", "n").join(wanted, "h", "left_semi"))
    return pairs.join(text.toDF("one", "a", "n_a"), "one").join(text.toDF("two", "b", "n_b"), "two").select("a", "b", "n_a", "n_b")


_SHOWN = "kind string, a string, b string, n long"


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chains``: a set of transformations that explain as many twins each; ``piece``: garbled, character, twins; ``line``: one that is garbled."""
    for batch in batches:
        chains: Counter = Counter()
        learned: Counter = Counter()
        bad = set()
        for a, b, n_a, n_b in zip(*(batch[c].to_pylist() for c in ("a", "b", "n_a", "n_b"))):
            if n_a < n_b:
                a, b, n_a, n_b = b, a, n_b, n_a
            pairs = aligned(a, b)
            if not pairs:
                continue
            one, two = zip(*pairs)
            found = [(w, r, t, one, b) for w, r, t in _explains(one, two)]
            if n_a <= 4 * n_b:  # what far more texts have is the clean one
                found += [(w, r, t, two, a) for w, r, t in _explains(two, one)]
            if found:
                chains[" ".join(sorted({f"{w}>{r}" for w, r, *_ in found}))] += 1
            multi = [x for x in found if x[0] in MULTI and (x[4] == b or found[0][4] == a)]  # turned round only where nothing else explains it
            learned.update(set().union(*(pieces(clean, w, r, t) for w, r, t, clean, _ in multi)))
            bad |= {line for *_, line in multi}
        rows = [("chains", k, None, n) for k, n in chains.items()] + [("piece", g, c, n) for (g, c), n in learned.items()] + [("line", x, None, 1) for x in bad]
        yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in rows], t) for i, (k, t) in enumerate((("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())))})


def cover(sets: dict[str, int]) -> list[tuple[str, str]]:
    """Few transformations that explain all twins: again and again the one that explains most of those left."""
    left = {frozenset(k.split()): n for k, n in sets.items()}
    order = lambda x: (WRITTEN.index(x.split(">")[0]), READ.index(x.split(">")[1]))  # noqa: E731  usual ones first
    out = []
    while left:
        votes: Counter = Counter()
        for s, n in left.items():
            votes.update(dict.fromkeys(s, n))
        best = min(votes, key=lambda x: (-votes[x], *order(x)))
        same = ">".join(best.split(">")[::-1])
        some = {best, same} if votes[same] == votes[best] else {best}  # a single-byte one and its inverse, which is which not told
        out += [tuple(x.split(">")) for x in some]
        left = {s: n for s, n in left.items() if not some & s}
    return sorted(out)


_JUDGES: dict[str, Judge] = {}


def _judge(name: str, shared) -> Judge:
    """A worker keeps what it found for its next task."""
    if name not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[name] = Judge(*shared.value)
    return _JUDGES[name]


def judged(df: DataFrame, text: str = "text") -> DataFrame:
    """(line, restored, shown): the distinct affected lines of all texts, without marks of quotation, and what they were."""
    spark = df.sparkSession
    texts = spread(df.select(F.col(text).cast("string").alias("text"))).where(_far("text"))
    lines = texts.select(F.explode(F.array_distinct(F.split("text", BREAK))).alias("line")).where(_far("line")).select(_line(F.col("line")).alias("line"))
    skeleton = F.regexp_replace("line", HIDDEN, "")
    lines = lines.groupBy("line").agg(F.count("*").alias("n")).select("line", "n", F.xxhash64("line").alias("h"), F.when(F.length(skeleton) >= SKELETON, F.xxhash64(skeleton)).alias("s"))
    lines = cut(lines)
    shown = cut(_twins(lines, texts).mapInArrow(_shown, _SHOWN))
    # sets of a fixed list of encodings; characters with their garbled forms in these
    chains = cover({r["a"]: r["n"] for r in shown.where("kind = 'chains'").groupBy("a").agg(F.sum("n").alias("n")).collect()})
    learned = {(r["a"], r["b"]) for r in shown.where("kind = 'piece'").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= VOTES).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * TABLE, np.int64)
        for batch in batches:
            held = batch["line"].to_pylist()
            weights = (UNIT * np.sqrt(batch["n"].to_numpy())).astype(int)
            # some characters at a time, however long the lines are
            part = np.cumsum([len(x) for x in held]) // CHARACTERS if held else np.zeros(0, int)
            for s, e in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(held)]))(np.flatnonzero(np.diff(part)) + 1)):
                count_lines(held[s:e], weights[s:e], counts)
        at = np.flatnonzero(counts)
        for s in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"at": at[s : s + 100_000], "n": counts[at[s : s + 100_000]]})

    table = np.zeros(2 * TABLE, np.int64)
    got = spread(lines.select("line", "n")).mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2 TABLE rows at most
    table[got["at"].to_numpy()] = got["n"].to_numpy()
    shared = spark.sparkContext.broadcast((table.astype(np.int32) if table.max(initial=0) < 2**31 else table, chains, learned))

    name = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(name, shared)
        for batch in batches:
            rows = [(x, *found[1:], n) for x, n in zip(batch["line"].to_pylist(), batch["n"].to_pylist()) for found in [judge.restored(x)] if found[0]]
            yield pa.RecordBatch.from_pydict(
                {
                    "line": pa.array([x[0] for x in rows], pa.string()),
                    "restored": pa.array([x[1] for x in rows], pa.string()),
                    "shown": pa.array([x[2] for x in rows], pa.bool_()),
                    "few": pa.array([x[4] if x[3] and x[4] >= MANY else 0 for x in rows], pa.int64()),
                }
            )

    out = cut(spread(lines.select("line", "n")).mapInArrow(run, "line string, restored string, shown boolean, few long"))
    doubted = out.where("few > 0").select("line", "restored", "shown", "few", F.xxhash64("restored").alias("h"))
    held = doubted.join(lines.select("h", "n"), "h").where("n > few").select("line", "restored", "shown")
    by_twin = shown.where("kind = 'line'").select(F.col("a").alias("line"), F.lit(None).cast("string").alias("restored"), F.lit(True).alias("shown"))
    return out.where("few = 0").select("line", "restored", "shown").unionByName(held).unionByName(by_twin).groupBy("line").agg(F.max("restored").alias("restored"), F.min("shown").alias("shown"))


def affected(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the texts of which at least one line is affected."""
    bad = judged(df, text).select(F.xxhash64("line").alias("h"))
    own = df.select(F.col(key), F.explode(F.array_distinct(F.split(F.col(text).cast("string"), BREAK))).alias("line")).where(_far("line")).select(key, F.xxhash64(_line(F.col("line"))).alias("h"))
    return own.join(bad, "h", "left_semi").select(key).distinct()


def restored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, shown) of the affected texts; what is lost stays as it is. ``shown``: nothing in it rests on what no twin showed.

    Each line keeps its own break. Keys are taken to be unique.
    """
    bad = cut(judged(df, text).select(F.xxhash64("line").alias("h"), F.coalesce("restored", "line").alias("new"), "shown"))
    own = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    lines = own.select("k", F.posexplode(F.split("t", BREAK)).alias("i", "line")).withColumn("h", F.xxhash64(_line(F.col("line"))))
    hit = lines.where(_far("line")).join(bad, "h").select("k", "i", F.concat(F.regexp_extract("line", r"^[>| \t]*", 0), F.col("new")).alias("new"), "shown")
    changes = hit.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "new"))).alias("changes"), F.min("shown").alias("shown"))
    whole = own.join(changes, "k").withColumn("breaks", F.regexp_extract_all("t", F.lit(f"({BREAK})")))
    new = F.array_join(F.transform(F.split("t", BREAK), lambda x, i: F.concat(F.coalesce(F.try_element_at("changes", i), x), F.coalesce(F.get("breaks", i), F.lit("")))), "")
    return whole.select(F.col("k").alias(key), new.alias("restored"), "shown")
