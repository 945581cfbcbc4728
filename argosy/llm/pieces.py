"""SentencePiece encoding, decoding, and sampling of segmentations by Gumbel top-k without replacement.

Encoding. Where two characters are neighbours in no piece of the vocabulary, no piece can span them. So a text is the sequence
of its units: a newline, a run of spaces, or spaces with what follows them, parted before and after the signs that the vocabulary
never joins to other characters (found from its pieces). The model's own encoder is asked once for each
distinct unit that a worker meets; the ids of a text are those of its units in order, equal to the encoder's on the whole text.
A literal U+2581, which the format cannot tell from a space, is written by its byte pieces, so decoding gives back every text.

Sampling. All segmentations of a text into pieces form a lattice, a chain of its units' lattices. A piece of rank r among the
scores weighs (2 + r) ** -alpha (for models with probabilities exp(alpha * score)); a segmentation's probability is its product over the
lattice's sum. The k segmentations with the greatest Gumbel-perturbed log probabilities are a sample without replacement
(Vieira 2014; Kool et al. 2019). They are found by A* over prefixes: the set of all that branches off an opened path has the
Gumbel maximum of its mass, truncated at the path's value, as an exact bound; the set with the greatest bound is opened next, its
own best path is drawn, and the rest of it returns to the queue. So k paths are opened in all, with vector operations over the
units of a batch of texts. The next bound is the threshold t of the inclusion score, 1 - exp(-exp(log p - t)). Random numbers come
from the row's key, so reruns and other partitionings agree.

Within a unit's lattice, sums go forward from its start and a path is drawn backward from its end; the draw that avoids the
most probable path has states of its own ("apart"), so it needs no rejection. Most units of a text keep their most probable path.

Defined results: a null or empty text has no ids and one empty segmentation; texts with fewer than k segmentations have fewer
samples, as have those whose remaining mass is below 1e-12 of a unit's; rows that repeat a key and a text sample alike; other columns are
ignored; an empty table gives an empty result. The model file is read once, on the driver, and sent with the tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from array import array
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches, text_of

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "﷐"
#: Units that a worker remembers; it starts anew beyond.
CACHE = 300_000
LEAST = 1e-12


class Vocabulary:
    """A SentencePiece model: pieces, weights, units and the plain encoder."""

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = {i: sp.get_score(i) for i in usable}
        merges = all(float(s).is_integer() for s in scores.values())  # a BPE model's scores are ranks
        ranked = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-scores[i], i)))}
        weight = {i: -alpha * math.log(2 + ranked[i]) if merges else alpha * scores[i] for i in usable}
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.id = {self.pieces[i]: i for i in usable}
        self.share: dict[str, float] = {}  # every prefix of a piece; the weight of a whole one, else 0
        for piece, i in self.id.items():
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"piece {piece!r} spans units")
            for k in range(1, len(piece)):
                self.share.setdefault(piece[:k], 0.0)
            self.share[piece] = math.exp(weight[i])
        self.floor = math.exp(min(weight.values()) - alpha)
        self.longest = max(map(len, self.id))
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.has_bytes = sp.is_byte(self.byte[0])
        apart = {c for piece in self.id for c in piece if c != SPACE and not (c.isalpha() or c.isdecimal())} | set(string.punctuation)
        pairs = {(x, y) for piece in self.id for bare in [piece.lstrip(SPACE)] for x, y in zip(bare, bare[1:], strict=False)}
        while True:  # signs that stand next to signs of their kind alone
            joined = {c for x, y in pairs if (x in apart) != (y in apart) for c in (x, y)}
            if not joined & apart:
                break
            apart -= joined
        self.signs, self._cuts = frozenset(apart), {}
        self.wide_signs = frozenset(c for c in apart if c > "\x7f")

    def cut(self, text: str) -> list[str]:
        """The text's units. The pattern names only those signs beyond ASCII that the text has, most often none."""
        has = frozenset() if text.isascii() else frozenset(set(text) & self.wide_signs)
        if has not in self._cuts:
            if len(self._cuts) > 1000:
                self._cuts.clear()
            some = "".join(re.escape(c) for c in sorted(self.signs) if c <= "\x7f" or c in has)
            self._cuts[has] = re.compile(rf" *[{some}]+| *[^{some} \n]+| +|\n" if some else r" *[^ \n]+| +|\n").findall
        return self._cuts[has](text)

    def spelled(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character, or the unknown piece."""
        return tuple(self.byte[b] for b in char.encode("utf-8")) if self.has_bytes else (self.sp.unk_id(),)

    def plain(self, units: list[str]) -> list[bytes]:
        """The encoder's ids of each unit, as little-endian 32-bit integers. A newline before a unit keeps the encoder from adding a space of its own."""
        skip = len(self.sp.encode("\n"))
        ids = self.sp.encode(["\n" + u for u in units])
        raw, to = array("i", chain.from_iterable(ids)).tobytes(), np.cumsum([4 * len(x) for x in ids]).tolist()
        out = [raw[a + 4 * skip : b] for a, b in zip([0, *to], to, strict=False)]
        for i, u in enumerate(units):
            if SPACE in u:
                parts = [x[skip:] for x in self.sp.encode(["\n" + p for p in u.split(SPACE)])]
                out[i] = array("i", [*parts[0], *(x for p in parts[1:] for x in (*self.spelled(SPACE), *p))]).tobytes()
        return out


class Store:
    """The units met so far, with their lattices as flat arrays; units are added, and paths drawn, many at a time.

    A lattice has a state for each position. Edges lie grouped by the state they end in, longest first; an edge is the number of a
    piece, or of a character's spelling after all pieces. `total` is the weight of all paths to a state, `top` that of the best.
    Units of more than `limit` characters could leave the range of doubles; they are handled one by one in logarithms.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.n_pieces = len(v.pieces)
        self.limit = max(1, int(-570 / math.log(v.floor)))
        nodes = {"": 0}
        for prefix in v.share:
            nodes[prefix] = len(nodes)
        steps = [(nodes[p[:-1]] << 21 | ord(p[-1]), n, v.id.get(p, -1)) for p, n in nodes.items() if p]
        self._hash_steps(*(np.array(x, np.int64) for x in zip(*steps, strict=True)))
        self.clear()

    def _hash_steps(self, key: np.ndarray, node: np.ndarray, piece: np.ndarray) -> None:
        """The trie's steps (node and character -> node, piece) as an open hash table, at most a fifth full."""
        self.shift = np.uint64(64 - max(8, int(5 * len(key)).bit_length()))
        room = 1 << (64 - int(self.shift))
        self.step_key, self.step_node, self.step_piece = np.full(room, -1, np.int64), np.zeros(room, np.int64), np.full(room, -1, np.int64)
        todo, slot = np.arange(len(key)), self._slots(key)
        while len(todo):
            free = todo[self.step_key[slot[todo]] < 0]
            self.step_key[slot[free]] = key[free]  # of several the last stays
            won = free[self.step_key[slot[free]] == key[free]]
            self.step_node[slot[won]], self.step_piece[slot[won]] = node[won], piece[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) % room

    def _slots(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The slot of each step, -1 where the trie has none."""
        slot, mask = self._slots(key), len(self.step_key) - 1
        there = self.step_key[slot]
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            there[todo] = self.step_key[slot[todo]]
            todo = todo[(there[todo] != key[todo]) & (there[todo] >= 0)]
        slot[there < 0] = -1
        return slot

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.plain: list[bytes] = []
        self.best: list[bytes] = []
        self.spellings: dict[str, int] = {}
        self.spelled: list[str] = []
        pieces = self.vocabulary.pieces
        self.length = np.array([len(p) for p in pieces], np.int32)
        self.share = np.array([self.vocabulary.share.get(p, 0.0) for p in pieces])
        self.n_units = self.n_states = self.n_edges = self.n_levels = 0
        self.log_total, self.log_best, self.apart_share = (np.zeros(1 << 12) for _ in range(3))
        self.size, self.rank, self.levels = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.level = np.zeros(1 << 10, np.int64)  # the first state of each position of each batch of units
        self.total, self.top = np.zeros(1 << 14), np.zeros(1 << 14)
        self.first, self.via = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.code = np.zeros(1 << 16, np.int32)

    def _put(self, at: int, **columns) -> int:
        """Writes columns at a place, making room; the place after them."""
        for name, column in columns.items():
            old, end = getattr(self, name), at + len(column)
            if end > len(old):
                new = np.zeros(end + end // 2, old.dtype)
                new[:at] = old[:at]
                setattr(self, name, old := new)
            old[at:end] = column
        return end

    def _spelling(self, char: str) -> int:
        """The number of a character's spelling by bytes."""
        if char not in self.spellings:
            self.spellings[char] = self.n_pieces + len(self.spelled)
            self.spelled.append(char)
            self.length, self.share = np.append(self.length, np.int32(1)), np.append(self.share, self.vocabulary.floor)
        return self.spellings[char]

    def _text(self, unit: str) -> str:
        return unit.replace(SPACE, LITERAL).replace(" ", SPACE)

    def units(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's units; unknown ones are added."""
        cut, number = self.vocabulary.cut, self.number
        get = number.get
        found = [cut(" " + t) if t else [] for t in texts]
        numbers = [list(map(get, f)) for f in found]
        missing = [[i for i, n in enumerate(ns) if n is None] if None in ns else () for ns in numbers]
        if new := list(dict.fromkeys([f[i] for f, at in zip(found, missing, strict=True) for i in at])):
            for at in range(0, len(new), 20_000):
                self.add(new[at : at + 20_000])
            for f, ns, at in zip(found, numbers, missing, strict=True):
                for i in at:
                    ns[i] = number[f[i]]
        return numbers

    def add(self, units: list[str]) -> None:
        units = sorted(units, key=len, reverse=True)
        n_long = sum(len(u) > self.limit for u in units)
        logs = [self.in_logs(self._text(u)) for u in units[:n_long]]
        best = [self.written(x.best) for x in logs]
        columns = {"log_total": [x.total[-1] for x in logs], "log_best": [x.top[-1] - x.total[-1] for x in logs], "apart_share": [-math.expm1(min(0.0, x.top[-1] - x.total[-1])) for x in logs]}
        size = np.array([len(u) for u in units], np.int64)
        if n_long < len(units):
            total, top, short = self._lay_out(units[n_long:], size[n_long:])
            best += short
            ratio = np.minimum(1.0, top / total)
            for name, x in (("log_total", np.log(total)), ("log_best", np.log(ratio)), ("apart_share", 1.0 - ratio)):
                columns[name] = np.concatenate([columns[name], x])
        columns |= {"size": size, "rank": np.arange(len(units)) - n_long, "levels": np.full(len(units), self.n_levels - (size[n_long] + 1 if n_long < len(units) else 0))}
        plain = self.vocabulary.plain(units)
        self.number.update(zip(units, range(self.n_units, self.n_units + len(units)), strict=True))
        self.names += units
        self.plain += plain
        self.best += [p if p == b else b for p, b in zip(plain, best, strict=True)]  # equal ones share memory
        self.n_units = self._put(self.n_units, **columns)

    def _lay_out(self, units: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Adds the lattices of units in falling order of size: total and best weight of each, and its best path.

        States are numbered by position first, then by unit; so all states of a position are summed at once.
        """
        n, longest = len(units), int(size[0])
        chars = np.frombuffer(self._text("".join(units)).encode("utf-32-le"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(n), size)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        room = size[unit] - place
        level = np.zeros(longest + 2, np.int64)
        level[1:] = np.cumsum(np.searchsorted(-size, -np.arange(longest + 1), side="right"))  # how many units reach each position
        at, node, ends, starts, codes = np.arange(len(chars)), np.zeros(len(chars), np.int64), [], [], []
        for k in range(1, self.vocabulary.longest + 1):
            fits = room[at] >= k
            at, node = at[fits], node[fits]
            if not len(at):
                break
            key = node << 21 | chars[at + k - 1]
            hit = self._step(key)
            known = hit >= 0
            piece = np.where(known, self.step_piece[hit], -1)
            if k == 1:
                for i in np.flatnonzero(piece < 0).tolist():  # no piece of this character alone: its bytes
                    piece[i] = self._spelling(SPACE if (c := chr(chars[i])) == LITERAL else " " if c == SPACE else c)
            whole = np.flatnonzero(piece >= 0)
            ends.append(level[place[at[whole]] + k] + unit[at[whole]])
            starts.append(level[place[at[whole]]] + unit[at[whole]])
            codes.append(piece[whole])
            at, node = at[known], self.step_node[hit[known]]
        end, start, code = (np.concatenate(x[::-1]) for x in (ends, starts, codes))
        order = np.argsort(end, kind="stable")  # longest first within a state
        end, start, code = end[order], start[order], code[order]
        first = np.searchsorted(end, np.arange(level[-1] + 1))
        total, top, via = np.zeros(level[-1]), np.zeros(level[-1]), np.zeros(level[-1], np.int64)
        total[: level[1]] = top[: level[1]] = 1.0
        weight = self.share[code]
        for k in range(1, longest + 1):
            own = slice(level[k], level[k + 1])
            lo, hi = first[level[k]], first[level[k + 1]]
            cuts = first[own] - lo
            total[own] = np.add.reduceat(total[start[lo:hi]] * weight[lo:hi], cuts)
            tops = top[start[lo:hi]] * weight[lo:hi]
            top[own] = np.maximum.reduceat(tops, cuts)
            hit = lo + np.flatnonzero(tops == np.repeat(top[own], np.diff(np.append(cuts, hi - lo))))[::-1]
            via[end[hit]] = hit
        last = level[size] + np.arange(n)
        state, live, steps = last.copy(), np.arange(n), []
        while len(live):
            edge = via[state[live]]
            steps.append((live, code[edge]))
            state[live] = start[edge]
            live = live[state[live] >= level[1]]
        self._put(self.n_states, total=total, top=top, via=via + self.n_edges)
        self._put(self.n_states, first=first + self.n_edges)
        self.n_edges = self._put(self.n_edges, code=code)
        self.n_levels = self._put(self.n_levels, level=level[:-1] + self.n_states)
        self.n_states += len(first)  # one more, so that the last state's edges have an end
        return total[last], top[last], self._paths(steps, n)

    def _paths(self, steps: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[bytes]:
        """The ids of n paths, from the (path, code) of each step backward."""
        if not steps:
            return [b""] * n
        codes = np.full((n, len(steps)), -1, np.int32)
        for i, (live, code) in enumerate(steps):
            codes[live, len(steps) - 1 - i] = code
        held = codes >= 0
        flat, to = codes[held], np.cumsum(held.sum(axis=1)).tolist()
        raw = flat.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *to], to, strict=False)]
        for i in np.flatnonzero((codes >= self.n_pieces).any(axis=1)).tolist():
            out[i] = self.written(codes[i][held[i]].tolist())
        return out

    def written(self, path: list[int]) -> bytes:
        """The ids of a path of codes, as little-endian 32-bit integers."""
        n = self.n_pieces
        return array("i", [i for p in path for i in ((p,) if p < n else self.vocabulary.spelled(self.spelled[p - n]))]).tobytes()

    def apart(self, units: np.ndarray, seeds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """For each unit the ids of a path drawn from all but its best, and the log of its share of all.

        Backward from the end. As long as a path is the best one so far, the edge that keeps it so has the mass of all other ways to its start.
        """
        size, log_p, paths = self.size[units], -self.log_total[units], {}
        for i in np.flatnonzero(size > self.limit).tolist():
            paths[i], log_p[i] = self.another(int(units[i]), [self.best[units[i]]], int(seeds[i]))
        live = np.flatnonzero(size <= self.limit)
        k, flagged = size.copy(), np.ones(len(units), bool)
        base, rank = self.levels[units], self.rank[units]
        steps, step = [], 0
        while len(live):
            before, ranks, flag = base[live] + k[live], rank[live], flagged[live]
            state = self.level[before] + ranks
            left = uniform(seeds[live], step) * (self.total[state] - np.where(flag, self.top[state], 0.0))
            edge, last, best = self.first[state].astype(np.int64), self.first[state + 1], np.where(flag, self.via[state], -1)
            chosen, todo = edge.copy(), np.arange(len(live))
            while len(todo):
                e = edge[todo]
                code = self.code[e]
                s = self.level[before[todo] - self.length[code]] + ranks[todo]
                mass = (self.total[s] - np.where(e == best[todo], self.top[s], 0.0)) * self.share[code]
                some = mass > 0
                chosen[todo[some]] = e[some]
                left[todo] -= mass
                edge[todo] += 1
                todo = todo[(left[todo] >= 0) & (edge[todo] < last[todo])]
            code = self.code[chosen]
            log_p[live] += np.log(self.share[code])
            steps.append((live, code))
            k[live] -= self.length[code]
            flagged[live] = flag & (chosen == best)
            live, step = live[k[live] > 0], step + 1
        drawn = self._paths(steps, len(units))
        for i, ids in paths.items():
            drawn[i] = ids
        return drawn, log_p

    def in_logs(self, text: str) -> Logs:
        """A unit's lattice in logarithms, one edge at a time."""
        get, n, longest = self.vocabulary.share.get, len(text), self.vocabulary.longest
        total, top, into, via = [0.0], [0.0], [[]], [0]
        for k in range(1, n + 1):
            edges = [(i, self._code(text, i, k), math.log(w)) for i in range(max(0, k - longest), k) if (w := get(text[i:k]) or (self.vocabulary.floor if k == i + 1 else 0.0))]
            peak = max(total[i] + w for i, _, w in edges)
            total.append(peak + math.log(sum(math.exp(total[i] + w - peak) for i, _, w in edges)))
            tops = [top[i] + w for i, _, w in edges]
            top.append(max(tops))
            via.append(tops.index(top[k]))
            into.append(edges)
        best, k = [], n
        while k:
            i, code, _ = into[k][via[k]]
            best.append(code)
            k = i
        return Logs(total, top, into, best[::-1])

    def _code(self, text: str, i: int, k: int) -> int:
        p = self.vocabulary.id.get(text[i:k], -1)
        return p if p >= 0 else self._spelling(SPACE if text[i] == LITERAL else " " if text[i] == SPACE else text[i])

    def another(self, unit: int, taken: list[bytes], seed: int) -> tuple[bytes, float]:
        """A path of the unit that isn't taken, and the log of its share: an edge's mass is less by the taken paths that go through it."""
        x, heads = self.in_logs(self._text(self.names[unit])), [self.read(unit, t) for t in taken]
        k, path, log_p, step = self.size[unit].item(), [], -x.total[-1], 0
        while k:
            options = []
            for i, code, w in x.into[k]:
                gone = sum(math.exp(min(0.0, h[i][1] - x.total[i])) for h in heads if i in h and h[i][0] == k)
                options.append((max(0.0, 1.0 - gone) * math.exp(x.total[i] + w - x.total[k]) if gone < 1 - LEAST else 0.0, i, code, w))
            left, step = _uniform(seed, step) * sum(o[0] for o in options), step + 1
            chosen = max(options)
            for o in options:
                if o[0] > 0:
                    chosen = o
                    left -= o[0]
                    if left < 0:
                        break
            _, i, code, w = chosen
            path.append(code)
            log_p += w
            heads = [h for h in heads if i in h and h[i][0] == k]
            k = i
        return self.written(path[::-1]), log_p

    def read(self, unit: int, ids: bytes) -> dict[int, tuple[int, float]]:
        """A path as start -> (stop, log weight of the pieces before); its log weight is at -1."""
        text, at, before, out = self._text(self.names[unit]), 0, 0.0, {}
        queue, v = np.frombuffer(ids, np.int32).tolist(), self.vocabulary
        j = 0
        while at < len(text):
            piece = v.pieces[queue[j]]
            if text.startswith(piece, at) and piece in v.id:
                to, w, j = at + len(piece), v.share[piece], j + 1
            else:
                to, w = at + 1, v.floor
                j += len(v.spelled(SPACE if text[at] == LITERAL else " " if text[at] == SPACE else text[at]))
            out[at] = (to, before)
            at, before = to, before + math.log(w)
        out[-1] = (0, before)
        return out

    def log_p(self, unit: int, ids: bytes) -> float:
        return self.read(unit, ids)[-1][1] - float(self.log_total[unit])


class Logs(NamedTuple):
    """A lattice in logarithms: sums and bests of the positions, edges (start, code, weight) into each, and the best path."""

    total: list[float]
    top: list[float]
    into: list[list[tuple[int, int, float]]]
    best: list[int]


GOLDEN, ONE, TWO = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(ONE)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(TWO)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, step) -> np.ndarray:
    """Numbers in (0, 1), by seed and step."""
    with np.errstate(over="ignore"):
        x = mixed(seeds.astype(np.uint64) + (np.asarray(step, np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _uniform(seed: int, step: int) -> float:
    mask = (1 << 64) - 1
    x = (seed + (step + 1) * GOLDEN) & mask
    x = ((x ^ (x >> 30)) * ONE) & mask
    x = ((x ^ (x >> 27)) * TWO) & mask
    return (((x ^ (x >> 31)) >> 12) + 0.5) * 2.0**-52


def truncated(mass: float, bound: float, u: float) -> float:
    """The Gumbel maximum of a set of that mass, given that it is at most the bound."""
    if not mass > 0:
        return -math.inf
    phi, x = math.log(mass), math.log(-math.log(u))
    top = max(phi - bound, x)
    return phi - top - math.log(math.exp(phi - bound - top) + math.exp(x - top))


class Drawn(NamedTuple):
    """One sample of every text of a batch that has it."""

    has: np.ndarray  # of each text
    other: dict[int, bytes]  # units, by place in the batch, whose path isn't the best
    log_p: np.ndarray  # of each text
    value: np.ndarray  # the perturbed log probability


class Path:
    """An opened segmentation of every text that has it, and the mass of what branches off it at each unit."""

    def __init__(self, n_units: int, value: np.ndarray, has: np.ndarray):
        self.value, self.has, self.other = value, has, {}
        self.log_p, self.rest = np.zeros(n_units), np.zeros(n_units)


def gumbel_top_k(store: Store, numbers: list[list[int]], keys: np.ndarray, k: int) -> tuple[list[Drawn], np.ndarray]:
    """The k best segmentations of each text by perturbed log probability, best first, and the value of the next.

    All that branches off a path is one set in the queue, with the Gumbel maximum of its mass as bound; when it is opened, the unit where its
    best leaves the path is drawn by mass, and the set less that branch returns to the queue. Texts are independent; they are
    handled together to share vector operations. `keys` seeds each text.
    """
    sizes = np.array([len(n) for n in numbers])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    units = np.fromiter(chain.from_iterable(numbers), np.int64, int(starts[-1]))
    text = np.repeat(np.arange(len(numbers)), sizes)
    stream = lambda n, what: mixed(keys + np.uint64(GOLDEN * (16 * n + what) & (2**64 - 1)))
    log_best, apart = store.log_best[units], store.apart_share[units]
    filled = np.flatnonzero(sizes)
    bounds = [(i, int(starts[i]), int(starts[i + 1])) for i in filled]
    choice = np.flatnonzero(apart > 0)  # units with more than one path
    place = (choice - starts[text[choice]]).astype(np.uint64)
    likely = np.exp(log_best[choice])

    def complete(path: Path, n: int, at: np.ndarray) -> None:
        """Draws the choices of the path's texts from place `at` (in the batch) on, and weighs what branches off there."""
        if n:
            own = path.has[text] & (np.arange(len(units)) >= at[text])
            path.log_p[own], path.rest[own] = log_best[own], apart[own]
            free = np.flatnonzero(own[choice])
        else:
            path.log_p, path.rest, free = log_best.copy(), apart.copy(), np.arange(len(choice))
        odd = free[uniform(mixed(stream(n, 0)[text[choice[free]]] + place[free]), 0) >= likely[free]]
        if len(odd):
            where = choice[odd]
            paths, log_p = store.apart(units[where], mixed(stream(n, 1)[text[where]] + place[odd]))
            path.other |= dict(zip(where.tolist(), paths, strict=True))
            path.log_p[where], path.rest[where] = log_p, -np.expm1(np.minimum(log_p, -LEAST))
        path.upto = np.empty(len(units))
        for _, a, b in bounds:  # each text's own sums, so that they don't depend on its batch
            np.cumsum(path.log_p[a:b], out=path.upto[a:b])
        with np.errstate(under="ignore"):
            path.mass = np.exp(path.upto - path.log_p) * path.rest
        path.bound = np.full(len(sizes), -np.inf)
        drawn = uniform(stream(n, 5), 0)
        for i, a, b in bounds:
            if path.has[i]:
                path.bound[i] = truncated(path.mass[a:b].sum(), path.value[i], drawn[i])

    first = Path(len(units), -np.log(-np.log(uniform(stream(0, 2), 0))), np.ones(len(sizes), bool))
    complete(first, 0, starts[:-1])
    paths, taken = [first], {}
    while len(paths) < k:
        n = len(paths)
        parent, value = _best(paths)
        live = ~np.isneginf(value)
        child = Path(len(units), value, live)
        where, at = uniform(stream(n, 7), 0), starts[1:].copy()
        for i, a, b in bounds:
            if live[i]:
                upto = np.cumsum(paths[parent[i]].mass[a:b])
                at[i] = a + min(int(np.searchsorted(upto, where[i] * upto[-1], side="right")), int(np.flatnonzero(np.diff(upto, prepend=0.0))[-1]))
        of, kept = parent[text], live[text] & (np.arange(len(units)) < at[text])
        for m, p in enumerate(paths):
            own = kept & (of == m)
            child.log_p[own] = p.log_p[own]
            child.other |= {j: o for j, o in p.other.items() if own[j]}
        seeds, again = stream(n, 3), uniform(stream(n, 6), 0)
        fresh = [i for i in np.flatnonzero(live).tolist() if int(at[i]) not in paths[parent[i]].other and (int(parent[i]), int(at[i])) not in taken]
        ready = {}
        if fresh:  # only the best path is taken: one draw for all such texts
            drawn, log_p = store.apart(units[at[fresh]], seeds[fresh])
            ready = dict(zip(fresh, zip(drawn, log_p.tolist(), strict=True), strict=True))
        ready |= _unlike(store, {i: (int(units[at[i]]), paths[parent[i]].other[int(at[i])], float(paths[parent[i]].log_p[at[i]])) for i in np.flatnonzero(live).tolist() if i not in ready and (int(parent[i]), int(at[i])) not in taken}, stream(n, 8))
        for i in np.flatnonzero(live).tolist():
            j, p = int(at[i]), paths[parent[i]]
            unit = int(units[j])
            best = store.best[unit]
            gone = taken.setdefault((int(parent[i]), j), [p.other.get(j, best)])
            chosen, log_p = ready[i] if i in ready else store.another(unit, gone, int(seeds[i]))
            gone.append(chosen)
            if chosen != best:
                child.other[j] = chosen
            child.log_p[j] = log_p
            left = (store.apart_share[unit] if best in gone else 1.0) - sum(math.exp(store.log_p(unit, g)) for g in gone if g != best)
            p.mass[j] = math.exp(p.upto[j] - p.log_p[j]) * left if left > LEAST else 0.0
            p.bound[i] = truncated(p.mass[starts[i] : starts[i + 1]].sum(), value[i], again[i])
        complete(child, n, at + 1)
        paths.append(child)
    out = []
    for p in paths:
        total = np.zeros(len(sizes))
        total[filled] = p.upto[starts[1:][filled] - 1]
        out.append(Drawn(p.has, p.other, total, p.value))
    return out, _best(paths)[1]


def _unlike(store: Store, asked: dict[int, tuple[int, bytes, float]], seeds: np.ndarray) -> dict[int, tuple[bytes, float]]:
    """For each text's (unit, path that isn't its best, log share) another path by share: the best one, or draws apart from it until one is another."""
    out, todo = {}, []
    for i, (unit, _, log_p) in asked.items():
        if uniform(seeds[i : i + 1], 0)[0] * -math.expm1(min(log_p, -LEAST)) < (best := math.exp(store.log_best[unit])):
            out[i] = (store.best[unit], math.log(best))
        else:
            todo.append(i)
    for turn in range(1, 33):
        if not todo:
            break
        drawn, log_p = store.apart(np.array([asked[i][0] for i in todo]), mixed(seeds[todo] + np.uint64(turn)))
        out |= {i: (path, p) for i, path, p in zip(todo, drawn, log_p.tolist(), strict=True) if path != asked[i][1]}
        todo = [i for i in todo if i not in out]
    return out  # what is left after that many turns is drawn without rejection


def _best(paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the path whose set has the greatest bound, and that bound."""
    every = np.stack([p.bound for p in paths])
    return every.argmax(axis=0), every.max(axis=0)


class Encoded(NamedTuple):
    """Ids are little-endian 32-bit integers."""

    ids: bytes
    samples: list[tuple[bytes, float, float]]  # ids, log probability, inclusion score


class Encoder:
    """Encodes, samples and decodes texts; one for each worker and model."""

    def __init__(self, model: bytes, alpha: float = 1.0):
        self.store = Store(Vocabulary(model, alpha))

    def encode(self, texts: list[str], keys: list[str], k: int, seed: int) -> list[Encoded]:
        store = self.store
        if store.n_units > CACHE or store.n_edges > 40 * CACHE or len(store.spelled) > 10_000:
            store.clear()
        numbers = store.units(texts)
        plain, best = store.plain, store.best
        ids = [b"".join([plain[i] for i in n]) for n in numbers]
        if not k:
            return [Encoded(i, []) for i in ids]
        seeds = np.array([xxhash.xxh64_intdigest(key, seed=seed) for key in keys], np.uint64)
        drawn, beyond = gumbel_top_k(store, numbers, seeds, k)
        samples: list[list[tuple[bytes, float, float]]] = [[] for _ in texts]
        starts = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).tolist()
        likeliest = [best[i] for n in numbers for i in n]
        for d in drawn:
            flat = likeliest.copy()
            for j, path in d.other.items():
                flat[j] = path
            with np.errstate(over="ignore"):
                inclusion = np.where(np.isneginf(beyond), 1.0, -np.expm1(-np.exp(np.minimum(50.0, d.log_p - beyond))))
            for i in np.flatnonzero(d.has).tolist():
                samples[i].append((b"".join(flat[starts[i] : starts[i + 1]]), float(d.log_p[i]), float(inclusion[i])))
        return [Encoded(*x) for x in zip(ids, samples, strict=True)]

    def decode(self, ids: bytes) -> str:
        return self.store.vocabulary.sp.decode(np.frombuffer(ids, np.int32).tolist())


def encoder(model: bytes, alpha: float) -> Encoder:
    """This process's encoder of the model; its units stay known from task to task."""
    return held(("pieces", hashlib.sha256(model).digest(), alpha), lambda: Encoder(model, alpha))


def _mapped(docs: DataFrame, model_path: str, alpha: float, row, fields: str, arrow: pa.Schema, k: int, seed: int) -> DataFrame:
    with open(model_path, "rb") as f:  # a vocabulary file on the driver; its bytes go with the tasks
        model = f.read()
    docs = small_batches(docs).select(F.col("doc_id"), text_of().alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = encoder(model, alpha)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # as many rows at once as hold about a million characters
                to, size = at + 1, len(texts[at])
                while to < len(texts) and to - at < 512 and size + len(texts[to]) <= 1_000_000:
                    size += len(texts[to])
                    to += 1
                part = batch.slice(at, to - at)
                rows = [row(own, x) for x in own.encode(texts[at:to], [str(i) for i in part.column(0).to_pylist()], k, seed)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True))], ["doc_id", *arrow.names])
                at = to

    return docs.mapInArrow(run, f"doc_id {kind}, {fields}")


def encode(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 8, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids, and samples: array of ids, log_p and inclusion."""

    def row(own: Encoder, x: Encoded):
        return np.frombuffer(x.ids, np.int32), [{"ids": np.frombuffer(i, np.int32), "log_p": p, "inclusion": q} for i, p, q in x.samples]

    ids = pa.list_(pa.int32())
    sample = pa.struct([("ids", ids), ("log_p", pa.float64()), ("inclusion", pa.float64())])
    return _mapped(docs, model_path, alpha, row, "ids array<int>, samples array<struct<ids: array<int>, log_p: double, inclusion: double>>", pa.schema([("ids", ids), ("samples", pa.list_(sample))]), k, seed)


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """doc_id and text of (doc_id, ids)."""
    with open(model_path, "rb") as f:
        model = f.read()
    encoded = encoded.select("doc_id", F.col(ids_col).alias("_ids"))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sp = encoder(model, 1.0).store.vocabulary.sp
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, f"doc_id {kind}, text string")


def digest(ids: bytes) -> str:
    """Lowercase hex SHA-256 of the ids."""
    return hashlib.sha256(ids).hexdigest()


def digests(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 8, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The same encodings as hashes, made where they are: doc_id, n_ids, ids_sha256, decoded_sha256 and samples (n_ids, ids_sha256, log_p, inclusion)."""

    def row(own: Encoder, x: Encoded):
        back = hashlib.sha256(own.decode(x.ids).encode()).hexdigest()
        return len(x.ids) // 4, digest(x.ids), back, [{"n_ids": len(i) // 4, "ids_sha256": digest(i), "log_p": p, "inclusion": q} for i, p, q in x.samples]

    sample = pa.struct([("n_ids", pa.int64()), ("ids_sha256", pa.string()), ("log_p", pa.float64()), ("inclusion", pa.float64())])
    arrow = pa.schema([("n_ids", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("samples", pa.list_(sample))])
    return _mapped(docs, model_path, alpha, row, "n_ids long, ids_sha256 string, decoded_sha256 string, samples array<struct<n_ids: bigint, ids_sha256: string, log_p: double, inclusion: double>>", arrow, k, seed)
