"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass goes over the boundaries between characters and keeps, for each, the piece that a best path ends
with. A piece has ``longest`` characters at most, so what follows depends only on the last ``longest``
boundaries: this is the window. Whenever all paths that survive in it run through one boundary, the ids up
to there are committed and their back-pointers dropped. What goes on from there is that boundary, the piece
before it and the characters after it, nothing else; so memory doesn't grow with the text.

Both kinds of models fit this:

* unigram: the best path to a boundary has the highest sum of scores;
* byte-pair encoding: merging is by score, then from the left. A sequence of pieces is what merging yields
  exactly if no merge would cross any of its joints, which depends on the two neighbours alone. So each
  boundary has one surviving path, and a piece may extend it if merging leaves the joint alone.

Where no piece of the vocabulary holds a space mark after another character, every path runs through the
boundary before a space mark; then words are segments of their own, and equal ones are encoded once. All
segments, of many texts, go through one pass side by side, as lanes of arrays, ``STRETCH`` boundaries at a time;
after each stretch every lane commits. Texts are read ``PIECE_CHARS`` characters at a time, and a lane that the
end of such a piece cuts goes on in the next one from its last commit.

Ids are those of the installed sentencepiece library; the vocabulary file is a parameter, read on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from webloom.llm.textvec import mix64, utf8

MARK = "▁"
#: Boundaries that a lane goes on by before it commits; characters handled at a time.
STRETCH, PIECE_CHARS = 64, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE, _DEAD = -1, -3


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and contents of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 0x80:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else (8 if key & 7 == 1 else 4, i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def _hash(codes: np.ndarray) -> int:
    h = 0
    for c in codes.tolist():
        h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class _Lookup:
    """64-bit keys to small numbers, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, _NONE, np.int64)
        self.used = np.zeros(1 << self.bits, dtype=bool)
        for k, v, s in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            while self.used[s]:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.values[s], self.used[s] = k, v, True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.used[slot] & (self.keys[slot] == keys), self.values[slot], _NONE)
        todo = np.flatnonzero(self.used[slot] & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            s = slot[todo]
            hit = self.used[s] & (self.keys[s] == keys[todo])
            out[todo[hit]] = self.values[s[hit]]
            todo = todo[self.used[s] & ~hit]
        return out


class Vocabulary:
    """A SentencePiece model file, as arrays that can be sent to executors."""

    def __init__(self, model_file: str):
        import sentencepiece

        with open(model_file, "rb") as f:
            data = f.read()
        kind, self.prefix, self.byte_fallback = 1, True, False
        normal, charsmap, squeeze = b"", b"", True
        for number, value in _fields(data):
            if number == 2:
                for k, v in _fields(value):
                    kind = v if k == 3 else kind
                    self.byte_fallback = bool(v) if k == 35 else self.byte_fallback
            elif number == 3:
                for k, v in _fields(value):
                    normal, charsmap = (v if k == 1 else normal), (v if k == 2 else charsmap)
                    self.prefix, squeeze = (bool(v) if k == 3 else self.prefix), (bool(v) if k == 4 else squeeze)
        if kind not in (1, 2) or charsmap or squeeze:
            raise ValueError("only unigram and BPE models that leave texts as they are (identity, no squeezing of spaces) are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bpe, self.unk = kind == 2, sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, self.unk, np.int32)
        self.bytes_of: list[bytes] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            else:
                self.bytes_of.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"" if sp.is_control(i) else name.replace(MARK, " ").encode())
        self.starts_marked = np.array([not s and x.startswith(MARK) for s, x in zip(special, names)])
        pieces = {x: i for i, (x, s) in enumerate(zip(names, special)) if not s}
        # characters of pieces that are no pieces themselves take part in merges under ids past the end
        extra = sorted({c for x in pieces for c in x} - set(pieces))
        self.n, self.unknown = n, n + len(extra)  # the last id: any other character
        self.ids = pieces | {c: n + k for k, c in enumerate(extra)}
        self.texts = {i: x for x, i in self.ids.items()}
        lowest = min((sp.get_score(i) for i in pieces.values()), default=0.0)
        self.scores = np.array([sp.get_score(i) for i in range(n)] + [-np.inf] * len(extra) + [-np.inf])
        if not self.bpe:
            self.scores[n:] = lowest - 10.0  # what the library charges for an unknown character
        self.longest = max(map(len, self.ids), default=1)
        self.separable = not any(MARK in x.lstrip(MARK) for x in pieces)
        self._tables()

    def _tables(self) -> None:
        size = self.unknown + 1
        self.length, self.key = np.ones(size, np.int64), np.zeros(size, np.uint64)
        prefixes: dict[int, int] = {}
        reachable = {}
        top = self.longest
        self.merges = np.full((size, top), -np.inf)  # scores of the merges that build a piece, in order
        self.left, self.right = np.full((size, top), _NONE, np.int32), np.full((size, top), _NONE, np.int32)  # its outer pieces after each
        self.left[:, 0] = self.right[:, 0] = np.arange(size)
        for x, i in self.ids.items():
            codes = np.frombuffer(x.encode("utf-32-le"), np.uint32)
            self.length[i] = len(codes)
            h = 0
            for k, c in enumerate(codes.tolist()):
                h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes.setdefault(h, _NONE)
            self.key[i] = h
            if self.bpe:
                history = self._build(x)
                if history is None:
                    continue
                for k, (score, a, b) in enumerate(history):
                    if k:
                        self.merges[i, k - 1] = score
                    self.left[i, k], self.right[i, k] = a, b
            prefixes[h] = i
            reachable[x] = i
        self.powers = self.powers_to(top + 2)
        self.reachable = reachable
        whole = np.array([self.key[i] for i in self.ids.values()], np.uint64)
        self.find = _Lookup(whole, np.array(list(self.ids.values()), np.int64))  # any piece
        # prefixes of pieces: -2 for one that is no reachable piece
        self.extend = _Lookup(np.array(list(prefixes), np.uint64), np.array([v if v != _NONE else -2 for v in prefixes.values()], np.int64))

    def _build(self, text: str) -> list[tuple[float, int, int]] | None:
        """(score, leftmost piece, rightmost piece) after each merge of a text, the start first; None if it doesn't end in one piece."""
        parts = list(text)
        out = [(0.0, self.ids[parts[0]], self.ids[parts[-1]])]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1], self.n)
                if i < self.n and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, self.ids[parts[0]], self.ids[parts[-1]]))
        return out

    # byte-pair encoding: does merging leave the joint of two pieces alone?

    def joints(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces: whether merging their joined text yields just these two."""
        out = np.ones(len(a), dtype=bool)
        todo = np.flatnonzero((a < self.unknown) & (b < self.unknown))
        i, j = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        while len(todo):
            p, q = a[todo], b[todo]
            x, y = self.right[p, i], self.left[q, j]
            over = self.find(self.key[x] * self.powers[np.minimum(self.length[y], self.longest)] + self.key[y])
            cross = np.where((over >= 0) & (over < self.n) & (self.length[x] + self.length[y] <= self.longest), self.scores[over], -np.inf)
            left, right = self.merges[p, i], self.merges[q, j]
            crossed = (cross > left) & (cross >= right) & (cross > -np.inf)
            out[todo[crossed]] = False
            go = ~crossed & ((left > -np.inf) | (right > -np.inf))
            by_left = (left >= right)[go]
            todo = todo[go]
            i, j = i[go] + by_left, j[go] + ~by_left
        return out

    # all segments of a piece of text

    def _pieces_at(self, codes: np.ndarray, begin: np.ndarray, width: np.ndarray, base: np.ndarray) -> np.ndarray:
        """[n, character]: the piece of n characters that begins at each character of the lanes' stretches, or none."""
        total = int(width.sum())
        at = np.arange(total) - np.repeat(base, width)
        code = codes[np.repeat(begin, width) + at].astype(np.uint64) + np.uint64(1)
        room = np.repeat(width, width) - at  # characters from here to the stretch's end
        found = np.full((self.longest + 1, total), _NONE, np.int32)
        live, h = np.arange(total), np.zeros(total, np.uint64)
        for n in range(1, self.longest + 1):
            h = h * _BASE + code[live + n - 1]
            piece = self.extend(h)
            hit = piece >= 0
            found[n, live[hit]] = piece[hit]
            if n == 1:
                found[1, live[piece == _NONE]] = self.unknown
            go = (piece != _NONE) & (room[live] > n)
            live, h = live[go], h[go]
            if not len(live):
                break
        return found

    def _stretch(self, codes: np.ndarray, begin: np.ndarray, width: np.ndarray, before: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, lane of each, how many characters each lane commits, its last piece), for lanes by descending width.

        A lane's stretch has ``width`` characters from ``begin`` on, and ``before`` is the piece that its path so
        far ends with. Where the stretch ``ends`` its segment all of it is committed; else what the paths to the
        last ``longest`` boundaries have in common.
        """
        w, base = len(begin), np.cumsum(width) - width
        found = self._pieces_at(codes, begin, width, base)
        mark = base + np.arange(w)  # boundary 0 of each lane
        piece_at = np.full(len(found[0]) + w, _DEAD, np.int32)  # the last piece of the path to each boundary
        score_at = np.zeros(len(piece_at))
        piece_at[mark] = before
        for i in range(1, int(width[0]) + 1):
            k = int(np.searchsorted(-width, -i, "right"))
            n, lane = np.nonzero(found[1 : min(i, self.longest) + 1][::-1][_diagonal(base[:k], i, min(i, self.longest))] >= 0)
            n = min(i, self.longest) - n  # the longest first
            piece = found[n, base[lane] + i - n]
            prev = piece_at[mark[lane] + i - n]
            ok = prev != _DEAD
            if self.bpe:
                test = np.flatnonzero(prev >= 0)
                ok[test] = self._joint(prev[test].astype(np.int64), piece[test].astype(np.int64))
                piece_at[mark[lane[ok]] + i] = piece[ok]
            else:
                n, lane, piece = n[ok], lane[ok], piece[ok]
                score = score_at[mark[lane] + i - n] + self.scores[piece]
                order = np.lexsort((-n, -score, lane))
                first = order[np.flatnonzero(np.diff(lane[order], prepend=-1))]
                piece_at[mark[lane[first]] + i], score_at[mark[lane[first]] + i] = piece[first], score[first]
        meet = self._meet(piece_at, mark, width, ends)
        out, owner, at = [], [], []
        last = np.where(meet > 0, piece_at[mark + meet], before)
        rows, pos = np.flatnonzero(meet > 0), meet[meet > 0]
        while len(rows):  # back along the paths
            piece = piece_at[mark[rows] + pos]
            out.append(piece)
            owner.append(rows)
            at.append(pos)
            pos = pos - self.length[piece]
            rows, pos = rows[pos > 0], pos[pos > 0]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), meet, last
        out, owner, at = np.concatenate(out), np.concatenate(owner), np.concatenate(at)
        order = np.lexsort((at, owner))
        return out[order].astype(np.int64), owner[order], meet, last

    def _meet(self, piece_at: np.ndarray, mark: np.ndarray, width: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The boundary of each lane at which the paths to its last boundaries meet."""
        meet = np.where(ends, width, 0)
        rows = np.flatnonzero(~ends)
        if len(rows):
            back = np.arange(self.longest)
            alive = width[rows, None] - back  # boundaries, the last first; 0 for those that no path reaches
            alive = np.where(alive > 0, alive, 0)
            alive = np.where(piece_at[mark[rows, None] + alive] == _DEAD, width[rows, None], alive)
            while True:
                top, low = alive.max(1), alive.min(1)
                open_ = top > low
                if not open_.any():
                    break
                step = (alive == top[:, None]) & open_[:, None]
                at = np.broadcast_to(mark[rows, None], alive.shape)[step] + alive[step]
                alive[step] -= self.length[piece_at[at]]
            meet[rows] = alive[:, 0]
        return meet

    def _lanes(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of all segments, how many of each, characters committed of each, its last piece).

        A segment that isn't ``closed`` goes on after its last character; it commits what doesn't depend on that.
        """
        done, last = np.zeros(len(starts), np.int64), before.copy()
        count, out, owner = np.zeros(len(starts), np.int64), [], []
        stretch = np.full(len(starts), STRETCH)
        todo = np.flatnonzero(sizes > 0)
        while len(todo):
            width = np.minimum(sizes[todo] - done[todo], stretch[todo])
            order = np.argsort(-width, kind="stable")
            todo, width = todo[order], width[order]
            whole = done[todo] + width == sizes[todo]
            pieces, lane, moved, ends = self._stretch(codes, starts[todo] + done[todo], width, last[todo], whole & closed[todo])
            out.append(pieces)
            owner.append(todo[lane])
            count += np.bincount(todo[lane], minlength=len(starts))
            done[todo] += moved
            last[todo] = ends
            # paths that don't meet yet: a longer stretch
            stretch[todo] = np.where(moved == 0, 2 * stretch[todo], STRETCH)
            todo = todo[(done[todo] < sizes[todo]) & ~(whole & ~closed[todo])]
        if not out:
            return np.zeros(0, np.int64), count, done, last
        owner = np.concatenate(owner)
        return np.concatenate(out)[np.argsort(owner, kind="stable")], count, done, last

    def _joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``joints`` behind a direct-mapped cache."""
        if not hasattr(self, "_cache"):
            self._cache = (np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, dtype=bool))
        keys, values = self._cache
        key = a * (self.unknown + 1) + b
        slot = (mix64(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out, miss = values[slot], np.flatnonzero(keys[slot] != key)
        if len(miss):
            fresh, at = np.unique(key[miss], return_inverse=True)
            ok = self.joints(fresh // (self.unknown + 1), fresh % (self.unknown + 1))
            out[miss] = ok[at]
            keys[slot[miss]], values[slot[miss]] = key[miss], ok[at]
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_cache", "_flat")}

    def _segments(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First characters of the segments of texts given as code points."""
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[offsets[:-1]] = True
        if self.separable:
            mark = codes == ord(MARK)
            first[1:-1] |= mark[1:] & ~mark[:-1]
        return np.flatnonzero(first[:-1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        out, ends, offsets = [], 0, [0]
        for i, j in _batches(texts):
            if len(texts[i]) > PIECE_CHARS:
                for ids in self._long(texts[i]):
                    out.append(ids)
                    ends += len(ids)
                offsets.append(ends)
                continue
            ids, bounds, _ = self._some([(MARK if self.prefix else "") + t.replace(" ", MARK) if t else "" for t in texts[i:j]])
            out.append(ids)
            offsets += (bounds[1:] + ends).tolist()
            ends += len(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(offsets, np.int64)

    def _long(self, text: str) -> Iterator[np.ndarray]:
        """Ids of one text, a piece at a time; only the characters since the last commit go on to the next."""
        rest, before = MARK if self.prefix else "", _NONE
        for k in range(0, len(text), PIECE_CHARS):
            rest += text[k : k + PIECE_CHARS].replace(" ", MARK)
            ids, _, (left, before) = self._some([rest], before, k + PIECE_CHARS < len(text))
            rest = rest[len(rest) - left :]
            yield ids

    def _some(self, ready: list[str], before: int = _NONE, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """(ids, offsets of the texts in them, (characters at the end that aren't committed, the piece before them)).

        ``before`` is the piece before the first character, and with ``goes_on`` the last text does.
        """
        codes = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ready), np.int64, len(ready)))])
        starts = self._segments(codes, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(ready) + 1, np.int64), (0, before)
        sizes = np.diff(np.append(starts, len(codes)))
        # equal segments once: those whose characters hash alike in 64 bits; never one that is cut
        powers = self.powers_to(int(sizes.max()))
        within = np.arange(len(codes)) - np.repeat(starts, sizes)
        h = mix64(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * powers[within], starts) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        del within, powers
        cut = np.zeros(len(starts), np.int64)
        cut[0] += before != _NONE
        cut[-1] += 2 * goes_on
        key = np.empty(len(h), dtype=[("h", np.uint64), ("cut", np.int64)]) if cut.any() else h
        if cut.any():
            key["h"], key["cut"] = h, cut
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        first_piece = np.where(cut[one] & 1, before, _NONE)
        pieces_, count, done, last = self._lanes(codes, starts[one], sizes[one], first_piece, cut[one] < 2)
        first = np.cumsum(count) - count
        # of all segments, in order
        n = count[which]
        seq = pieces_[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        at = np.cumsum(self.length[seq]) - self.length[seq]  # first character of each piece
        plain = seq < self.n
        width = np.ones(len(seq), np.int64)
        raw = codes[at[~plain]]
        width[~plain] = 1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000) if self.byte_fallback else 1
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[(ends - width)[plain]] = seq[plain]
        if not plain.all():
            if self.byte_fallback:
                unknown = np.frombuffer(raw.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
                w = width[~plain]
                out[np.repeat((ends - width)[~plain] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))] = self.byte_ids[unknown]
            else:
                out[(ends - width)[~plain]] = self.unk
        left = int(sizes[-1] - done[which[-1]])
        return out, np.concatenate([[0], ends])[np.searchsorted(at, offsets)], (left, int(last[which[-1]]))

    def powers_to(self, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1) - 1, _BASE, np.uint64)]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids; bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "_flat"):
            size = np.fromiter(map(len, self.bytes_of), np.int64, self.n)
            self._flat = (np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size)
        data, first, size = self._flat
        raw, ends = [], np.zeros(len(offsets), np.int64)
        for k in range(0, len(ids), PIECE_CHARS):
            part = ids[k : k + PIECE_CHARS]
            n = size[part]
            at = np.concatenate([[0], np.cumsum(n)])
            inside = (offsets > k) & (offsets <= k + len(part))
            done = sum(map(len, raw))
            ends[inside] = done + at[offsets[inside] - k]
            raw.append(data[np.repeat(first[part] - at[:-1], n) + np.arange(int(at[-1]))].tobytes())
        ends, joined = np.maximum.accumulate(ends), b"".join(raw)
        out = []
        for i, j, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            if j > i and self.prefix and self.starts_marked[ids[i]]:
                a += 1  # the space put before every text
            out.append(joined[a:b].decode("utf-8", "replace"))
        return out


def _diagonal(base: np.ndarray, i: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces lie that end at boundary i of each lane, the longest first."""
    n = np.arange(longest, 0, -1)
    return np.arange(longest)[:, None], base[None, :] + i - n[:, None]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``PIECE_CHARS`` characters at most; a longer text is alone."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > PIECE_CHARS:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(column, kind, True)])


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; null for a null text, no ids for an empty one.

    A column of that name that ``docs`` has is replaced, all others stay. Repeated rows and ids do no harm; no
    rows give no rows.
    """
    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _batches(texts):
                ids, offsets = v.encode(texts[i:j])
                own = b.slice(i, j - i)
                missing = np.asarray(own.column("text").is_null())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*b.schema.names, column])

    return docs.mapInArrow(run, _with(docs, column, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", column: str = "text") -> DataFrame:
    """``encoded`` with the text of each list of ids; null for null. A column of that name is replaced."""
    encoded = encoded.drop(column)
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            lists = b.column(ids)
            size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            out = v.decode(np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(size)]))
            texts = [None if m else t for t, m in zip(out, lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, column])

    return encoded.mapInArrow(run, _with(encoded, column, T.StringType()))


def encoding_report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_ids, ids_sha256, decoded_sha256, round_trip`` for every row of ``docs``.

    ids_sha256 is over the ids as little-endian 32-bit numbers, decoded_sha256 over the UTF-8 of what they
    decode to, and round_trip says whether that is the text. A null text counts as an empty one: no ids.
    Repeated ids, extra columns and empty tables do no harm; whole texts are encoded.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _batches(texts):
                ids, offsets = v.encode(texts[i:j])
                back = v.decode(ids, offsets)
                raw = ids.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(offsets)),
                        pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        pa.array([t == o for t, o in zip(back, texts[i:j])], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def vocabulary_path(spark: SparkSession) -> str:
    """``webloom.sentencepiece.model`` of the session, else the installed public 32,000-piece model."""
    own = spark.conf.get("webloom.sentencepiece.model", None)
    if own:
        return own
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
