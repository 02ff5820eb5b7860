"""Batched Viterbi segmentation with the pieces of a SentencePiece model.

Words of equal length advance together. A hash of every substring of up to the longest piece is probed in the sorted piece
keys, and what is found is sorted by where it ends; then, position by position, the best piece ending there is taken for all
words at once, and its length is stored as the backpointer.

In a unigram model the path's score is the sum of its pieces' scores. A byte-pair model merges greedily, and the path of
greatest score isn't what it yields. Its segmentation is the one path all of whose adjacent pieces are stable: merging the
text of two neighbours alone yields just the two. (A merge never crosses a boundary of the result, so the merges within two
neighbours are the same in any context; and if no pair merges across its boundary, nothing does.) So an unstable pair scores
minus infinity, and the maximum over what is left is the exact result of the library.

Whether a pair is stable is told without merging it: the merges within the two are undone from the last on, and at each step the
pieces at the boundary must not be a pair that would have merged by then.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np

U = np.uint64
SPACE = "▁"
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words of more characters go position by position; the batch would hold one word.
LONG = 200
#: Words (those of the text at hand may be more), and slots for pairs of pieces, that a worker remembers.
CACHE, SLOTS = 250_000, 1 << 22
#: Rank of pairs that don't merge.
NEVER = np.iinfo(np.int64).max


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class Pieces:
    """A model's pieces: strings, scores and kinds as in its file. byte_ids: ids of the 256 byte pieces, or None; unk: id of the unknown piece."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], bpe: bool, unk: int = 0, byte_ids: list[int] | None = None, dummy_prefix: bool = True):
        self.pieces, self.bpe, self.unk, self.byte_ids, self.dummy_prefix = pieces, bpe, unk, byte_ids, dummy_prefix
        self.n = len(pieces)
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
        self.score = np.append(np.array(scores, float), min(scores) - 10.0)
        self.longest = max(map(len, self.ids))
        self.power, self.inverse = _powers(_BASE, LONG + 2), _powers(_INVERSE, LONG + 2)
        keys = np.array([sum((ord(c) + 1) * int(q) for c, q in zip(p, self.power[: len(p)].tolist(), strict=True)) % (1 << 64) for p in self.ids], U)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        # most substrings are no pieces, and are known as such by the top bits of their hash
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> U(44)).astype(np.int64)] = True
        self._forget()
        # verdicts on pairs of pieces, each in the one slot that its hash gives
        self.asked, self.verdict = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        table = [p.encode() for p in pieces]
        for b, i in enumerate(byte_ids or ()):
            table[i] = bytes([b])
        self.bytes = table
        if bpe:
            self._merges()

    def _merges(self) -> None:
        chars = {c for p in self.ids for c in p}
        if missing := [c for c in chars if c not in self.ids]:
            raise ValueError(f"characters of pieces that aren't pieces: {missing[:5]}")
        ranks = {s: k for k, s in enumerate(sorted({self.score[i] for i in self.ids.values()}, reverse=True))}
        found = [(self.ids[p[:k]] * self.n + self.ids[p[k:]], ranks[self.score[i]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        found.sort()
        self.pair, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.pair_some = np.zeros(1 << 20, bool)
        self.pair_some[self._slot(self.pair, 20)] = True
        self.size = np.array([len(p) for p in self.pieces])
        self.letters = np.zeros((self.n, 2 * self.longest), np.int64)
        for p, i in self.ids.items():
            self.letters[i, : len(p)] = [self.ids[c] for c in p]
        self._last_merges()

    def _last_merges(self) -> None:
        """whole: pieces that their characters merge to; left, right, rank: the two that the last merge of such a piece joins, and its rank; orderly: whether no merge within is of a later rank than the one that uses it."""
        self.whole, self.orderly = np.zeros(self.n, bool), np.zeros(self.n, bool)
        self.left, self.right, self.rank = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.full(self.n, -1)
        single = [i for p, i in self.ids.items() if len(p) == 1]
        self.whole[single] = self.orderly[single] = True
        sizes = self.size[self.pair_id]
        for size in range(2, self.longest + 1):
            at = np.flatnonzero(sizes == size)
            at = at[self._met(self.pair[at])]
            a, b = np.divmod(self.pair[at], self.n)
            made, rank = self.pair_id[at], self.pair_rank[at]
            self.left[made], self.right[made], self.rank[made], self.whole[made] = a, b, rank, True
            self.orderly[made] = self.orderly[a] & self.orderly[b] & (np.maximum(self.rank[a], self.rank[b]) <= rank)
        self.alone = np.append(self.whole, True)  # an unknown character too

    @staticmethod
    def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
        return ((pairs.astype(U) * U(_BASE)) >> U(64 - bits)).astype(np.int64)

    def _ranked(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs that merge, their places among all and their ranks; of others 0 and NEVER."""
        place, rank = np.zeros(pairs.shape, np.int64), np.full(pairs.shape, NEVER)
        maybe = self.pair_some[self._slot(pairs, 20)]
        probed = pairs[maybe]
        at = np.minimum(np.searchsorted(self.pair, probed), len(self.pair) - 1)
        place[maybe], rank[maybe] = at, np.where(self.pair[at] == probed, self.pair_rank[at], NEVER)
        return place, rank

    def _stable(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces, pair by pair, ends at the two. pairs: first * n + second."""
        slot = self._slot(pairs, 22)
        got, miss = self.verdict[slot], self.asked[slot] != pairs
        if miss.any():
            new = pairs[miss]
            found = self._ranked(new)[1] == NEVER
            found[found] = self._met(new[found])
            got[miss] = found
            slot = slot[miss]
            self.asked[slot] = new
            # of pairs with one slot the last stays, in both arrays alike
            self.verdict[slot] = found
        return got

    def _met(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces comes to the two, which may then merge themselves."""
        first, second = np.divmod(pairs, self.n)
        out, ordered = self.whole[first] & self.whole[second], self.orderly[first] & self.orderly[second]
        odd = np.flatnonzero(out & ~ordered)
        if len(odd):
            out[odd] = self._merged(pairs[odd])
        index = np.flatnonzero(out & ordered)
        x, y = first[index], second[index]
        # the merges are undone from the last on. In an orderly piece they go by rank, and a tie goes to the left; x and y lie at
        # the boundary until merges of the ranks until_x and until_y use them, and a merge of the two must not come before
        until_x = until_y = np.full(len(index), NEVER)
        while True:
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = np.flatnonzero(np.maximum(rank_x, rank_y) >= 0)
            if not len(go):
                return out
            index, x, y, until_x, until_y, rank_x, rank_y = (v[go] for v in (index, x, y, until_x, until_y, rank_x, rank_y))
            later = rank_x > rank_y
            until_x, until_y = np.where(later, rank_x, until_x), np.where(later, until_y, rank_y)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
            rank = self._ranked(x * self.n + y)[1]
            crossed = (rank < until_x) & (rank <= until_y)
            out[index[crossed]] = False
            index, x, y, until_x, until_y = (v[~crossed] for v in (index, x, y, until_x, until_y))

    def _merged(self, pairs: np.ndarray) -> np.ndarray:
        """The same for any pieces, by the merges themselves."""
        first, second = np.divmod(pairs, self.n)
        sizes, out = self.size[first] + self.size[second], np.zeros(len(pairs), bool)
        for size in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == size)
            a, b = first[places], second[places]
            edge = self.size[a]
            column = np.arange(size)[None]
            row = np.where(column < edge[:, None], self.letters[a, :size], self.letters[b[:, None], np.maximum(column - edge[:, None], 0)])
            index = places
            for width in range(size, 2, -1):
                place, rank = self._ranked(row[:, :-1] * self.n + row[:, 1:])
                at = rank.argmin(axis=1)
                all_rows = np.arange(len(row))
                go = (rank[all_rows, at] != NEVER) & (at != edge - 1)
                made = self.pair_id[place[all_rows, at]]
                row = np.where(np.arange(width - 1)[None] < at[:, None], row[:, :-1], row[:, 1:])
                row[all_rows, at] = made
                row, edge, index = row[go], (edge - (at < edge - 1))[go], index[go]
                if not len(row):
                    break
            out[index] = True
        return out

    def _batch(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations of words of size characters: their lengths, and their ids one after the other."""
        # positions come first, so that what advances together lies together
        n = len(words)
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).T.astype(U)
        total = np.zeros((size + 1, n), U)
        np.cumsum((text + U(1)) * self.power[:size, None], axis=0, dtype=U, out=total[1:])
        # every piece in every word: where it begins (position * n + word) and its length
        origins, lengths, keys = [], [], []
        for k in range(1, min(size, self.longest) + 1):
            key = ((total[k:] - total[: size + 1 - k]) * self.inverse[: size + 1 - k, None]).reshape(-1)
            maybe = np.flatnonzero(self.some[(key >> U(44)).astype(np.int64)])
            origins.append(maybe)
            lengths.append(np.full(len(maybe), k))
            keys.append(key[maybe])
        origin, length, key = np.concatenate(origins), np.concatenate(lengths), np.concatenate(keys)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        real = self.keys[place] == key
        origin, length, piece = origin[real], length[real], self.key_ids[place[real]]
        known = np.zeros(size * n, bool)
        known[origin[length == 1]] = True
        unknown = np.flatnonzero(~known)
        if len(unknown):
            origin, length = np.append(origin, unknown), np.append(length, np.ones(len(unknown), np.int64))
            piece = np.append(piece, np.full(len(unknown), self.n))
        goal = origin + length * n
        end = goal // n
        order = np.argsort(end.astype(np.int16), kind="stable")
        origin, length, piece, goal = origin[order], length[order], piece[order], goal[order]
        bounds = np.cumsum(np.bincount(end, minlength=size + 1)).tolist()
        last, back = np.full((size + 1) * n, -1), np.zeros((size + 1) * n, np.int64)
        last[:n] = self.n
        score = np.zeros((size + 1) * n)
        for j in range(1, size + 1):
            at = slice(bounds[j - 1], bounds[j])
            before, pieces, to, steps = last[origin[at]], piece[at], goal[at], length[at]
            if self.bpe:
                # where there is no piece before, one must itself be what its characters merge to
                fine = (before >= 0) & self.alone[pieces]
                asked = np.flatnonzero(fine & (before < self.n) & (pieces < self.n))
                fine[asked] = self._stable(before[asked] * self.n + pieces[asked])
                # only one piece is left at each place
                best = np.flatnonzero(fine)
            else:
                # by place, greatest score first, then the shortest
                got = score[origin[at]] + self.score[pieces]
                by = np.lexsort((steps, -got, to))
                best = by[np.diff(to[by], prepend=-1) > 0]
                score[to[best]] = got[best]
            last[to[best]], back[to[best]] = pieces[best], steps[best]
        last, back = last.reshape(size + 1, n), back.reshape(size + 1, n)
        rows = np.arange(n)
        last, back = last.T, back.T
        at, steps = np.full(n, size), []
        while (at > 0).any():
            steps.append(np.where(at > 0, last[rows, at], -1))
            at = at - np.where(at > 0, back[rows, at], 0)
        path = np.stack(steps[::-1], axis=1)
        if not (path == self.n).any():
            used = path >= 0
            return used.sum(axis=1), path[used].astype(np.int32)
        named = [self._named(row[row >= 0], word) for row, word in zip(path, words, strict=True)]
        return np.array([len(x) for x in named]), np.concatenate(named)

    def _long(self, word: str) -> np.ndarray:
        """The same path for one long word."""
        size, ids = len(word), self.ids
        score, last, back = [0.0] + [-np.inf] * size, [self.n] * (size + 1), [0] * (size + 1)
        ends = [[(k, ids[word[j - k : j]]) for k in range(1, min(j, self.longest) + 1) if word[j - k : j] in ids] for j in range(size + 1)]
        fine: dict[int, bool] = {}
        if self.bpe:
            asked = np.array(sorted({b * self.n + a for j in range(1, size + 1) for k, a in ends[j] for _, b in ends[j - k]}), np.int64)
            fine = dict(zip(asked.tolist(), self._stable(asked).tolist(), strict=True))
        for j in range(1, size + 1):
            for k, a in ends[j] or [(1, self.n)]:
                i = j - k
                if score[i] == -np.inf or self.bpe and a < self.n and not (self.whole[a] if last[i] == self.n else fine[last[i] * self.n + a]):
                    continue
                value = score[i] + self.score[a]
                if value > score[j]:
                    score[j], last[j], back[j] = value, a, k
        path, at = [], size
        while at:
            path.append(last[at])
            at -= back[at]
        return self._named(np.array(path[::-1], np.int64), word)

    def _named(self, path: np.ndarray, word: str) -> np.ndarray:
        """The path's ids, with unknown characters as their bytes."""
        if not (path == self.n).any():
            return path.astype(np.int32)
        out, at = [], 0
        for p in path.tolist():
            if p < self.n:
                out.append(p)
                at += len(self.pieces[p])
            else:
                out.extend([self.byte_ids[b] for b in word[at].encode()] if self.byte_ids else [self.unk])
                at += 1
        return np.array(out, np.int32)

    def split(self, text: str) -> list[str]:
        """Words that no piece reaches out of: spaces and what follows them, line ends apart."""
        if not hasattr(self, "_split"):
            inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
            line = "" if any("\n" in p for p in self.ids) else "\n"
            self._split = None if inner else re.compile(f"[ {SPACE}]*[^ {SPACE}{line}]+|[ {SPACE}]+" + ("|\n" if line else ""))
        return self._split.findall(text) if self._split else [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the pieces of each text."""
        # texts keep their spaces, which stand for the piece's sign until a new word is segmented
        split = [self.split(" " + t if self.dummy_prefix else t) if t else [] for t in texts]
        none, rest = itertools.repeat(-1), range(len(split))
        places = [np.fromiter(map(self.known.get, ws, none), np.int64, len(ws)) for ws in split]
        new = {split[k][i] for k in rest for i in np.flatnonzero(places[k] < 0).tolist()}
        for which in places:
            self.used[which[which >= 0]] = True
        if len(self.known) + len(new) > CACHE and self.known:
            moved = self._age()
            places = [np.where(which >= 0, moved[which], -1) for which in places]
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        found, lengths = [self.flat], [self.length]
        for size, words in by.items():
            step = max(1, 400_000 // (size * min(size, self.longest)))
            for at in range(0, len(words), step):
                part = words[at : at + step]
                signed = [w.replace(" ", SPACE) for w in part]
                if size <= LONG:
                    n, flat = self._batch(signed, size)
                else:
                    paths = [self._long(w) for w in signed]
                    n, flat = np.array([len(x) for x in paths]), np.concatenate(paths)
                self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
                found.append(flat)
                lengths.append(n)
        self.length = np.concatenate(lengths)
        self.flat = np.concatenate(found)
        self.used = np.append(self.used, np.zeros(len(new), bool))
        first = np.cumsum(self.length) - self.length
        out = []
        for ws, which in zip(split, places, strict=True):
            for i in np.flatnonzero(which < 0).tolist():
                which[i] = self.known[ws[i]]
            n = self.length[which]
            out.append(self.flat[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out

    def _forget(self) -> None:
        """known: the number of each remembered word, in order; length: its pieces; flat: all their ids; used: whether it has come again since the last ageing."""
        self.known: dict[str, int] = {}
        self.length, self.flat, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)

    def _age(self) -> np.ndarray:
        """Forgets the words that haven't come again. The new number of each word, or -1."""
        keep = np.flatnonzero(self.used)
        moved = np.full(len(self.used), -1, np.int64)
        moved[keep] = np.arange(len(keep))
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(keep.tolist())}
        n, first = self.length[keep], (np.cumsum(self.length) - self.length)[keep]
        self.flat = self.flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.length, self.used = n, np.zeros(len(keep), bool)
        return moved

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids, which end at the offsets ends; bytes that aren't UTF-8 become replacement characters."""
        if not hasattr(self, "_letters"):
            table = [b.replace(SPACE.encode(), b" ") for b in self.bytes]
            self._length = np.array([len(b) for b in table])
            self._first, self._letters = np.cumsum(self._length) - self._length, np.frombuffer(b"".join(table), np.uint8)
        n = self._length[ids]
        stop = np.cumsum(n)
        data = self._letters[np.repeat(self._first[ids] - (stop - n), n) + np.arange(n.sum())].tobytes()
        at = np.concatenate([[0], stop])[ends].tolist()
        skip = 1 if self.dummy_prefix else 0
        return [data[a + (skip if data[a : a + 1] == b" " else 0) : b].decode("utf-8", "replace") if b > a else "" for a, b in zip([0, *at[:-1]], at, strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The pieces of a model file whose text normalisation is the identity."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and byte-pair models that leave the text as it is")
    kinds = [p.type for p in m.pieces]
    if 4 in kinds:
        raise ValueError("user-defined pieces aren't handled")
    where = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
    byte_ids = [where[f"<0x{b:02X}>"] for b in range(256)] if m.trainer_spec.byte_fallback else None
    return Pieces([p.piece for p in m.pieces], [p.score for p in m.pieces], [k == 1 for k in kinds], m.trainer_spec.model_type == 2, kinds.index(2), byte_ids, spec.add_dummy_prefix)
