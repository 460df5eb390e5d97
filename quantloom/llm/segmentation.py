"""SentencePiece segmentations by Gumbel top-k without replacement, and their decoding.

A text's lattice holds every way to cut it into vocabulary pieces (with UTF-8 byte pieces for characters that have no
piece). Pieces get log-probabilities by a Zipf law over their merge ranks, sharpened by `alpha`; nothing is trained. A
perturbed A* search visits the tree of partial segmentations from the top: a node's key is the largest Gumbel-perturbed
log-probability below it, which is drawn from its parent's key, so the first k leaves taken from the queue are a sample
of k distinct segmentations without replacement. A node's untaken children are one queue entry, since their largest key
is one truncated Gumbel draw. The (k+1)-th key is the threshold of the inclusion scores.

No piece joins letters with other signs, or crosses a digit, a newline or a space that follows another character (checked
when the model is read), so backward sums are computed by unit, for all distinct units of a batch at once. Draws
are hashes of (row key, sample, unit, step): a row's samples do not depend on its batch or partition. Memory: one batch of at most `batch_chars` characters, or one text.

Defined results: a null or empty text has one empty segmentation; a literal U+2581 is read as a space, as
SentencePiece does; a text with fewer than k segmentations gives all of
them with inclusion 1; a null id is a key of its own; rows that repeat an id and text repeat its samples; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from itertools import compress, pairwise, repeat
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import lean, utf8

SPACE = "▁"
#: Units: letters, one digit, or other signs, each with the spaces before it; a newline; spaces at the end.
_LETTER = "[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]"
UNIT = re.compile(f"\n|{SPACE}*(?:{_LETTER}+|[0-9]|(?:(?!{_LETTER})[^0-9{SPACE}\n])+)|{SPACE}+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03))
_BASE = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose first bits can be used: 18 are a slot of the marks, 14 a bucket."""
    return h * _A


def _slot(spread: np.ndarray) -> np.ndarray:
    return spread >> np.uint64(46)


def _found(keys: np.ndarray, starts: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Where each hash lies in the ordered keys, which end with the largest number; elsewhere the first larger one's place. starts: each bucket's first place."""
    at = starts[spread >> np.uint64(50)]
    on = np.flatnonzero(keys[at] < spread)
    while len(on):
        at[on] += 1
        on = on[keys[at[on]] < spread[on]]
    return at


class Pieces:
    """A model's pieces by length and hash, with log-probabilities."""

    def __init__(self, model: str, alpha: float) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte, self.texts = np.full(256, -1, dtype=np.int32), [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        ids, said = [], []  # of normal pieces; what each piece adds to a decoded text
        for i, p in enumerate(self.texts):
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                said.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                said.append(b"")
            else:
                said.append(p.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    ids.append(i)
        self.said, normal = pa.array(said, pa.large_binary()), [self.texts[i] for i in ids]
        crossing = [p for p in normal if not UNIT.fullmatch(p)]
        if crossing:
            raise ValueError(f"pieces cross units: {crossing[:3]}")
        length = np.fromiter(map(len, normal), dtype=np.int64, count=len(normal))
        self.longest = int(length.max())
        if self.longest > 127:
            raise ValueError("a piece's length must fit 8 bits")
        weight = [1 / (rank + 2.7) for rank in range(1, len(normal) + 257)]
        total = math.log(sum(weight))
        self.byte_logp = alpha * (math.log(weight[-1]) - total)
        logp = np.array([alpha * (math.log(w) - total) for w in weight[: len(normal)]])
        # by length: pieces in order of hash, and a table that tells most hashes of no piece (bit 0) or of no piece's start (bit 1)
        codes = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        first, number = np.cumsum(length) - length, np.array(ids, dtype=np.int32)
        rows, h = np.arange(len(normal)), np.zeros(len(normal), dtype=np.uint64)
        self.tables = [(codes[:0], number[:0], logp[:0], np.zeros(1, dtype=np.uint8))]
        self.starts: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]  # of each table's buckets
        for n in range(1, self.longest + 1):
            with np.errstate(over="ignore"):
                h = h * _BASE + codes[first[rows] + n - 1]
            spread, whole = _spread(h), np.flatnonzero(length[rows] == n)
            whole = whole[np.argsort(spread[whole], kind="stable")]
            marks, keys = np.zeros(1 << 18, dtype=np.uint8), spread[whole]
            marks[_slot(spread)] = 2
            marks[_slot(keys)] |= 1
            self.starts.append(np.searchsorted(keys >> np.uint64(50), np.arange(1 << 14, dtype=np.uint64)).astype(np.int32))
            self.tables.append((np.append(keys, np.uint64(2**64 - 1)), number[rows[whole]], logp[rows[whole]], marks))
            on = length[rows] > n
            rows, h = rows[on], h[on]


class Lattice:
    """The lattices of distinct units. Node: a character's place; an edge goes to node + length for each piece that starts there. Edges lie by distance from their unit's end, then by node."""

    def __init__(self, units: list[str], pieces: Pieces) -> None:
        joined = "".join(units)
        length = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        self.end = np.cumsum(length, dtype=np.int32)  # places fit 32 bits: a batch is a few million characters, or one text
        self.start = self.end - length.astype(np.int32)
        n = len(joined)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.points.astype(np.uint64) + np.uint64(1)
        left = np.repeat(self.end, length) - np.arange(n, dtype=np.int32)  # characters up to the unit's end
        rows, h, single = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        found: list[tuple] = []
        with np.errstate(over="ignore"):
            for k in range(pieces.longest):
                h = h * _BASE + codes[rows + k]
                keys, ids, logp, marks = pieces.tables[k + 1]
                spread = _spread(h)
                mark = marks[_slot(spread)]
                may = np.flatnonzero(mark & 1)
                if len(may):
                    spread = spread[may]
                    at = _found(keys, pieces.starts[k + 1], spread)
                    hit = (keys[at] == spread) & (at < len(ids))
                    at, own = at[hit], rows[may[hit]]
                    found.append((own, np.full(len(own), k + 1, dtype=np.int32), logp[at], ids[at]))
                    if not k:
                        single[own] = True
                more = (mark > 1) & (left[rows] > k + 1)
                rows, h = rows[more], h[more]
                if not len(rows):
                    break
        bare = np.flatnonzero(~single)  # no piece of one character: its bytes
        c = self.points[bare]
        found.append((bare.astype(np.int32), np.ones(len(bare), dtype=np.int32), pieces.byte_logp * (1.0 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)), np.where(c < 0x80, pieces.byte[np.minimum(c, 0x7F)], -1).astype(np.int32)))
        node, size, weight, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(node, kind="stable")
        far = left[node[order]]
        order = order[np.argsort(far.astype(np.int16) if far.max() < 32767 else far, kind="stable")]
        self.node, self.size, weight, self.piece = node[order], size[order].astype(np.int8), weight[order], piece[order]
        fresh = np.concatenate([[True], self.node[1:] != self.node[:-1]])
        heads = np.flatnonzero(fresh)  # first edge of each node
        degree = np.diff(np.concatenate([heads, [len(self.node)]]))
        self.first, self.last = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
        self.first[self.node[heads]], self.last[self.node[heads]] = heads, heads + degree - 1
        own = left[self.node]
        beta, to = np.zeros(n + 1), np.where(self.size == own, n, self.node + self.size)  # a unit's end counts as the last place, where beta is 0
        far = own[heads]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(far)) + 1, [len(heads)]])
        score = np.empty(len(weight))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = heads[a], heads[b] if b < len(heads) else len(weight)
            s = weight[lo:hi] + beta[to[lo:hi]]
            score[lo:hi] = s
            top = np.maximum.reduceat(s, heads[a:b] - lo)
            beta[self.node[heads[a:b]]] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, degree[a:b])), heads[a:b] - lo))
        self.logp = np.minimum(score - beta[self.node], 0.0)  # of an edge, given its node
        p = np.exp(self.logp)
        total = np.cumsum(p)
        self.cum = total - np.repeat(total[heads] - p[heads], degree)

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each node an edge, by its share. From its last edge down, since long pieces take most of it."""
        first, edge = self.first[nodes], self.last[nodes]
        on = np.flatnonzero(edge > first)
        while len(on):
            below = edge[on] - 1
            less = u[on] < self.cum[below]
            on, below = on[less], below[less]
            edge[on] = below
            on = on[below > first[on]]
        return edge


class Lattices(Lattice):
    """The lattices of the units added so far, in arrays with room to grow. cut() takes the last ones away again."""

    BY_UNIT, BY_NODE, BY_EDGE = ("end", "start"), ("points", "first", "last"), ("node", "size", "piece", "logp", "cum")

    def __init__(self) -> None:
        self.room: dict[str, np.ndarray] = {}
        self.used = (0, 0, 0)

    def add(self, other: Lattice) -> None:
        _, n, m = self.used
        shift = {"end": n, "start": n, "node": n, "first": m, "last": m}
        for count, names in zip(self.used, (self.BY_UNIT, self.BY_NODE, self.BY_EDGE), strict=True):
            for name in names:
                its, mine = getattr(other, name), self.room.get(name)
                if mine is None or len(mine) < count + len(its):
                    grown = np.empty(max(1024, (count + len(its)) * 5 // 4), dtype=its.dtype)
                    if mine is not None:
                        grown[:count] = mine[:count]
                    self.room[name] = mine = grown
                mine[count : count + len(its)] = its
                if shift.get(name):
                    mine[count : count + len(its)] += its.dtype.type(shift[name])
        self.cut((self.used[0] + len(other.end), n + len(other.points), m + len(other.node)))

    def cut(self, used: tuple[int, int, int]) -> None:
        self.used = used
        for count, names in zip(used, (self.BY_UNIT, self.BY_NODE, self.BY_EDGE), strict=True):
            for name in names:
                setattr(self, name, self.room[name][:count])


class Path:
    """One segmentation: the edges of its pieces, its perturbed log-probability, and the queue's keys of the untaken children of its first steps.

    A uniform draw has 53 bits, so no Gumbel exceeds NOISE; steps whose log-probability lies further below a key than that cannot have a larger one and are not drawn.
    """

    NOISE, AHEAD = 38.0, 224

    def __init__(self, lattice: Lattice, edge: np.ndarray, logp: np.ndarray, unit_of, gumbel: float, seed: int, first: int = 0, drawn: tuple[np.ndarray, float] | None = None) -> None:
        self.edge, self.logp, self.unit_of, self.gumbel, self.seed, self.taken = edge, logp, unit_of, gumbel, seed, {}
        self.total, self.lattice = float(logp.sum()), lattice
        self.keys, self.before = drawn or (np.zeros(0), 0.0)
        if not drawn:
            self.extend(first + self.AHEAD)
            self.keys[:first] = -np.inf  # those belong to the path it branched from

    @staticmethod
    def drawn(logp: np.ndarray, before, gumbel, seed: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the steps from `lo` on, of one path or a row for each, and the log-probabilities up to each step."""
        ahead = before + np.cumsum(logp, axis=-1)
        with np.errstate(divide="ignore"):
            loc = ahead - logp + np.log(-np.expm1(logp))  # of a step's other edges
        u = _uniform(seed + np.arange(lo, lo + logp.shape[-1], dtype=np.uint64) * _D)
        keys = loc - np.logaddexp(loc - gumbel, np.log(-np.log(u)))
        keys[~np.isfinite(loc)] = -np.inf
        return keys, ahead

    @classmethod
    def roots(cls, lattice: Lattice, edge: np.ndarray, logp: np.ndarray, places: np.ndarray, bounds: list[tuple[int, int]], seeds: list[int]) -> Iterator[Path]:
        """The first path of each row with the units lo to hi; 64 rows are drawn at once."""
        for c in range(0, len(bounds), 64):
            some, own = bounds[c : c + 64], seeds[c : c + 64]
            at, end = (places[list(x)] for x in zip(*some, strict=True))
            n = np.minimum(end - at, cls.AHEAD)
            steps = np.arange(n.max())
            of = np.where(steps < n[:, None], logp.take(at[:, None] + steps, mode="clip"), 0.0)  # a certain step has no key
            u = np.array([(xxhash.xxh64_intdigest("('root',)", seed) >> 11) * 2.0**-53 + 2.0**-54 for seed in own])
            turns = [xxhash.xxh64_intdigest("(0,)", seed) for seed in own]
            gumbel = [-math.log(-math.log(x)) for x in u.tolist()]
            keys, ahead = cls.drawn(of, 0.0, np.array(gumbel)[:, None], np.array(turns, dtype=np.uint64)[:, None], 0)
            for i, (a, b, m) in enumerate(zip(at.tolist(), end.tolist(), n.tolist(), strict=True)):
                own_places = places[some[i][0] : some[i][1]] - a
                yield cls(lattice, edge[a:b], logp[a:b], lambda t, p=own_places: int(p.searchsorted(t, side="right")) - 1, gumbel[i], turns[i], drawn=(keys[i, :m], float(ahead[i, m - 1])))

    def extend(self, upto: int) -> None:
        """Draws the keys of the steps before `upto`."""
        lo, hi = len(self.keys), min(upto, len(self.edge))
        if hi <= lo:
            return
        keys, ahead = self.drawn(self.logp[lo:hi], self.before, self.gumbel, np.uint64(self.seed), lo)
        self.keys, self.before = np.concatenate([self.keys, keys]), float(ahead[-1])

    def best(self) -> tuple[float, int] | None:
        """The largest key and its step."""
        while True:
            t = int(self.keys.argmax()) if len(self.keys) else -1
            if len(self.keys) == len(self.edge) or t >= 0 and self.keys[t] > self.before + self.NOISE:
                return (float(self.keys[t]), t) if t >= 0 and self.keys[t] > -np.inf else None
            self.extend(2 * len(self.keys) + 64)


def search(lattice: Lattice, root: Path, fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, seed: int) -> tuple[list[Path], float]:
    """Perturbed A*: the k segmentations with the largest keys, and the next key (-inf if there is none). fresh: for each sample after the root the edges drawn top down, their log-probabilities and the first place of each unit."""
    h = lambda *x: xxhash.xxh64_intdigest(repr(x), seed)
    paths = [root]
    queue: list[tuple[float, int, int]] = []

    def push(i: int) -> None:
        if (top := paths[i].best()) is not None:
            heapq.heappush(queue, (-top[0], i, top[1]))

    push(0)
    while queue and len(paths) < k:
        key, i, t = heapq.heappop(queue)
        key, base, j = -key, paths[i], len(paths)
        node = int(lattice.node[base.edge[t]])
        lo, hi = int(lattice.first[node]), int(lattice.last[node]) + 1
        taken = base.taken.setdefault(t, [int(base.edge[t])])
        p = np.exp(lattice.logp[lo:hi])
        p[np.array(taken) - lo] = 0.0
        c = np.cumsum(p)
        took = lo + int(min(np.searchsorted(c, (h("turn", j) >> 11) * 2.0**-53 * c[-1], side="right"), np.flatnonzero(p)[-1]))
        taken.append(took)
        p[took - lo] = 0.0
        base.keys[t] = -np.inf
        if p.any():
            loc, u = float(base.logp[:t].sum()) + math.log(p.sum()), (h("rest", j) >> 11) * 2.0**-53 + 2.0**-54
            base.keys[t] = loc - np.logaddexp(loc - key, math.log(-math.log(u)))
        # finish the unit, then go on with the sample's own units
        edges, now = [took], base.unit_of(t)
        stop = int(lattice.end[np.searchsorted(lattice.end, node, side="right")])
        while (at := int(lattice.node[edges[-1]] + lattice.size[edges[-1]])) < stop:
            lo, hi = int(lattice.first[at]), int(lattice.last[at])
            edges.append(lo + int(lattice.cum[lo:hi].searchsorted((h("step", j, len(edges)) >> 11) * 2.0**-53, side="right")))
        edge, logp, places = fresh[j - 1]
        rest = int(places[now + 1]) if now + 1 < len(places) else len(edge)

        def unit_of(x: int, t=t, m=len(edges), base=base, now=now, rest=rest, places=places) -> int:
            return base.unit_of(x) if x < t else now if x < t + m else int(np.searchsorted(places, x - t - m + rest, side="right")) - 1

        paths.append(Path(lattice, np.concatenate([base.edge[:t], edges, edge[rest:]]), np.concatenate([base.logp[:t], lattice.logp[edges], logp[rest:]]), unit_of, key, h(j), t + 1))
        push(i)
        push(j)
    return paths, -queue[0][0] if queue else -np.inf


class _Index(dict):
    """Numbers units as they are first asked for."""

    def numbers(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each key's number, and the keys that have none yet: they are numbered on, in this order, but only keep() remembers them."""
        at = np.fromiter(map(self.get, keys, repeat(-1)), dtype=np.int32, count=len(keys))
        miss = at < 0
        if not miss.any():
            return at, []
        missed = list(compress(keys, miss.tolist()))
        new = list(dict.fromkeys(missed))
        number = dict(zip(new, range(len(self), len(self) + len(new)), strict=True))
        at[miss] = np.fromiter(map(number.__getitem__, missed), dtype=np.int32, count=len(missed))
        return at, new

    def keep(self, new: list[str]) -> None:
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))


class _Parts(_Index):
    """Numbers what stands between the spaces of texts: part n has the units flat[begin[n] : begin[n + 1]].

    Most known parts are found by arrays: slots holds a part's number by its characters' hash, chars its characters from
    places[n] on, with the space before it. A part whose slot another one has is found by name, as are new ones.
    """

    def __init__(self) -> None:
        super().__init__()
        self.begin, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.slots, self.powers = np.full(1 << 20, -1, dtype=np.int32), np.cumprod(np.full(1024, _BASE))
        self.places, self.chars = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    @staticmethod
    def found(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as one, each with a space before it, its characters, where the parts start in it, and each text's first part and the number of all. A part takes the spaces before it; those at a text's end are a part of their own."""
        texts = [" " + text if text else "" for text in texts]
        joined, ends = "".join(texts), np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blank = chars == 32
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[ends[:-1][ends[:-1] < len(chars)]] = True
        starts = np.flatnonzero(head)
        return joined, np.where(blank, np.uint32(ord(SPACE)), chars), starts, np.searchsorted(starts, np.concatenate([[0], ends]))

    def _slot(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        place = np.arange(len(chars), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        return _mix(np.add.reduceat(chars * self.powers[place & 1023], starts)) >> np.uint64(44)

    def known(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each part's number, or -1: it is new, or must be asked for by name."""
        sizes = np.diff(starts, append=len(chars))
        at = self.slots[self._slot(chars, starts, sizes)]
        place = self.places[at]
        same = (at >= 0) & (self.places[at + 1] - place == sizes)
        if same.any():  # equal hashes are not enough
            its = self.chars.take(np.arange(len(chars)) + np.repeat(place - starts, sizes), mode="clip")
            same &= ~np.logical_or.reduceat(its != chars, starts)
        return np.where(same, at, np.int32(-1))

    @staticmethod
    def cut(parts: list[str]) -> tuple[list[str], np.ndarray]:
        """What the parts' units are, each part's last one followed by a newline, and the places of these newlines. A newline is a unit of its own, so no unit holds signs of two parts."""
        said = UNIT.findall(SPACE + f"\n{SPACE}".join(parts) + "\n")
        ends = np.cumsum(np.fromiter(map(len, said), dtype=np.int64, count=len(said)))
        return said, np.searchsorted(ends, np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 2))

    def units(self, which: np.ndarray, *more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all these parts, one after the other, and where each part ends. more: the number of units of each part that is not kept, and these units."""
        begin, flat = self.begin, self.flat
        for sizes, unit in more:
            begin, flat = np.concatenate([begin, begin[-1] + np.cumsum(sizes)]), np.concatenate([flat, unit])
        first = begin[which]
        n = begin[which + 1] - first
        ends = np.cumsum(n)
        return flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1])], ends

    def keep(self, new: list[str], sizes: np.ndarray, unit: np.ndarray) -> None:
        chars = np.frombuffer((SPACE + SPACE.join(new)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 1
        slot, at = self._slot(chars, np.cumsum(length) - length, length), np.arange(len(self), len(self) + len(new), dtype=np.int32)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = at[free]
        self.places, self.chars = np.concatenate([self.places, self.places[-1] + np.cumsum(length)]), np.concatenate([self.chars, chars])
        super().keep(new)
        self.begin, self.flat = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)]), np.concatenate([self.flat, unit])


class Sampler:
    """Segments texts; see the module's docstring. Lattices of the units seen first serve all batches, up to KEPT characters of them, and the cuts of the parts seen first, up to KEPT_UNITS."""

    KEPT, KEPT_UNITS = 400_000, 200_000

    def __init__(self, model: str = MODEL, k: int = 2, alpha: float = 0.5, seed: int = 1) -> None:
        self.pieces, self.k, self.seed = Pieces(model, alpha), k, seed
        self.index, self.lattices, self.said = _Index(), Lattices(), self.pieces.said
        self.parts = _Parts()

    def texts(self) -> pa.Array:
        """Every piece's text, by id."""
        return pa.array(self.pieces.texts, pa.string())

    def _keep(self, before: tuple[int, int, int], units: list[str], parts: list[str], sizes: np.ndarray, unit: np.ndarray) -> None:
        """Remembers a batch's new units, up to KEPT nodes, and its new parts of such units, up to KEPT_UNITS. before: what the lattices held without the new ones."""
        if not units or self.lattices.used[1] <= self.KEPT:
            self.index.keep(units)
        else:
            self.lattices.cut(before) if before[0] else self.lattices.__init__()
        room = self.KEPT_UNITS - len(self.parts.flat)
        if room <= 0:
            return
        stays = np.maximum.reduceat(unit, np.cumsum(sizes) - sizes) < len(self.index)
        stays &= np.cumsum(sizes * stays) <= room
        if stays.any():
            self.parts.keep(list(compress(parts, stays.tolist())), sizes[stays], unit[np.repeat(stays, sizes)])

    def ids(self, lattice: Lattice, path: Path) -> np.ndarray:
        out = lattice.piece[path.edge]
        if (out < 0).any():
            parts, last = [], 0
            for t in np.flatnonzero(out < 0):
                parts += [out[last:t], self.pieces.byte[list(chr(lattice.points[lattice.node[path.edge[t]]]).encode("utf-8", "surrogatepass"))]]
                last = t + 1
            out = np.concatenate([*parts, out[last:]])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return next(self.decoded(ids)).decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray, ends: Iterable[int] | None = None) -> Iterator[bytes]:
        """The decoded text, in UTF-8, of the ids up to each end, without the space that encoding puts first. ends: one text without them."""
        said = self.said.take(pa.array(ids))
        places, data = np.frombuffer(said.buffers()[1], dtype=np.int64), said.buffers()[2]
        data, last = data.to_pybytes() if data else b"", 0
        for end in places[[len(ids)] if ends is None else ends].tolist():
            yield data[last + 1 : end]
            last = end

    def batch(self, rows: list[tuple[object, str]]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each (key, text) its samples: ids, log-probability, perturbed log-probability, log of the inclusion probability."""
        joined, chars, starts, cuts = _Parts.found([text for _, text in rows])
        seeds = [xxhash.xxh64_intdigest(repr(key), self.seed) for key, _ in rows]
        if not len(starts):
            return [[(np.zeros(0, dtype=np.int32), 0.0, 0.0, 0.0)] for _ in rows]
        before, lattice = self.lattices.used, self.lattices
        which = self.parts.known(chars, starts)
        asked, stops = np.flatnonzero(which < 0), np.append(starts, len(chars))
        joined = joined.replace(" ", SPACE)
        named = [joined[a:b] for a, b in zip((starts[asked] + 1).tolist(), stops[asked + 1].tolist(), strict=True)]
        which[asked], new = self.parts.numbers(named)
        del joined, chars, named
        if new:
            said, stops = _Parts.cut(new)
            unit, units = self.index.numbers(said)
            if units:
                lattice.add(Lattice(units, self.pieces))
            unit, sizes = np.delete(unit, stops), np.diff(stops, prepend=-1) - 1
            del said
            every, ends = self.parts.units(which, (sizes, unit))
        else:
            every, ends = self.parts.units(which)
        bounds = np.concatenate([[0], ends])[cuts]
        counts = np.diff(bounds)
        owner = np.repeat(np.array(seeds, dtype=np.uint64), counts)
        ordinal = np.arange(len(every)) - np.repeat(bounds[:-1], counts)
        fresh = [(edge, lattice.logp[edge], places) for edge, places in (self._fresh(lattice, every, owner, ordinal, j) for j in range(self.k))]
        out, spans = [], list(pairwise(bounds.tolist()))
        some = [d for d, (lo, hi) in enumerate(spans) if lo < hi]
        roots = Path.roots(lattice, *fresh[0], [spans[d] for d in some], [seeds[d] for d in some])
        for (lo, hi), seed in zip(spans, seeds, strict=True):
            if lo == hi:
                out.append([(np.zeros(0, dtype=np.int32), 0.0, 0.0, 0.0)])
                continue
            own = []
            for edge, logp, places in fresh[1:]:
                a, b = int(places[lo]), int(places[hi])
                own.append((edge[a:b], logp[a:b], places[lo:hi] - a))
            paths, after = search(lattice, next(roots), own, self.k, seed)
            found = []
            for p in paths:
                logp = p.total
                x = logp - after  # inclusion: the chance that a Gumbel at logp exceeds the threshold
                inclusion = 0.0 if after == -np.inf or x > 700 else (x if x < -30 else math.log(-math.expm1(-math.exp(x))))
                found.append((self.ids(lattice, p), logp, float(p.gumbel), inclusion))
            out.append(found)
        if new:
            self._keep(before, units, new, sizes, unit)
        return out

    @staticmethod
    def _fresh(lattice: Lattice, every: np.ndarray, owner: np.ndarray, ordinal: np.ndarray, j: int) -> tuple:
        """One top-down sample of every unit: edges in text order, and the first place of each unit."""
        with np.errstate(over="ignore"):
            key = _mix(owner + ordinal.astype(np.uint64) * _A + np.uint64(j + 1) * _C)
            live, at, stop = np.arange(len(every), dtype=np.int32), lattice.start[every], lattice.end[every]
            steps, count, s = [], np.zeros(len(every) + 1, dtype=np.int64), 0
            while len(live):
                took = lattice.draw(at, _uniform(key + np.uint64(s + 1) * _D))
                steps.append((live, took))
                count[live + 1] += 1
                at = at + lattice.size[took]
                more = np.flatnonzero(at < stop)
                live, at, stop, key = live[more], at[more], stop[more], key[more]
                s += 1
        places = np.cumsum(count)
        edge = np.empty(places[-1], dtype=np.int32)
        for i, (live, took) in enumerate(steps):
            edge[places[live] + i] = took
        return edge, places


def _grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    rows, chars = [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py() or ""
            rows.append((key, text))
            chars += len(text) + 1
            if chars > limit:
                yield rows
                rows, chars = [], 0
    if rows:
        yield rows


def sample_segmentations(docs: DataFrame, k: int = 2, alpha: float = 0.5, seed: int = 1, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 125_000, with_pieces: bool = False) -> DataFrame:
    """A row for each sample: doc_id, sample (0 first), n_pieces, logp, gumbel, log_inclusion, round_trip (the decoded ids are the text) and ids; with_pieces: the pieces' texts in addition."""
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "sample", "n_pieces", "logp", "gumbel", "log_inclusion", "round_trip", "ids"]  # the columns of run() have the text in UTF-8 where round_trip will be

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, k, alpha, seed)
        for rows in _grouped(batches, batch_chars):
            cols: list[list] = [[] for _ in names]
            for (key, text), found in zip(rows, sampler.batch(rows), strict=True):
                data = utf8(text)
                for i, (ids, logp, gumbel, inclusion) in enumerate(found):
                    for c, v in zip(cols, (key, i, len(ids), logp, gumbel, inclusion, data, ids), strict=True):
                        c.append(v)
            flat, ends = np.concatenate(cols[7]), np.cumsum(cols[2])
            cols[6] = list(map(eq, cols[6], sampler.decoded(flat, ends)))
            kinds = [None, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
            if arrays[0].type == pa.null():
                arrays[0] = arrays[0].cast(pa.int64())
            ends, flat = pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)
            arrays.append(pa.ListArray.from_arrays(ends, flat))
            if with_pieces:
                arrays.append(pa.ListArray.from_arrays(ends, sampler.texts().take(flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "pieces"][: len(arrays)])

    schema = f"doc_id {kind}, sample int, n_pieces long, logp double, gumbel double, log_inclusion double, round_trip boolean, ids array<int>" + (", pieces array<string>" if with_pieces else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def decode_ids(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text of its ids in the column `out`; null ids give null."""
    encoded = encoded.drop(out) if out != ids_col else encoded
    at, names = encoded.columns.index(ids_col), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            said = [None if x is None else sp.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{out}` string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: two distinct sampled segmentations of every document: their piece ids and inclusion scores."""
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
