"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is coded in binary decisions: a word of the head vocabulary by its path in a Huffman tree, any other word by the
escape path and then either as a training word outside the head, in proportion to its count, or by its bytes and their
paths in a byte tree (both ways add up), so the probabilities of all texts sum to at most one.  For every decision three predictors vote in the logistic domain: the node alone, the node behind the last very frequent word
(behind the last two bytes when spelling), and the node behind the last word (the last four bytes).  The context
predictors are counts in hashed tables (nodes of one subtree of three levels lie in eight neighbouring slots), gathered from all training documents as dense slices that are summed per slice.
Their votes are combined by weights that a gate picks from how often both contexts were seen.  The weights start from a
logistic fit on the decisions of all training documents: these are halved by a hash, each half meets the tables of the other, and
decisions are counted by gate, bit and levels of the three votes (31 levels each), a table of fixed size.  The tables that score
are the sum of both halves.  The weights are refined online within each document after every block of decisions (64 at first,
then twice as many each time up to 2048), so a document's score depends on nothing but its text and the model, and not on
how rows are dealt to tasks.  The tables have 2^21 slots whatever the input, so contexts of a
large corpus share slots.
"""

from __future__ import annotations

import heapq

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .spark_util import discard, partitions, with_text, written

FOLDS, HELD = 7, 2
HEAD = 1 << 17
FREQUENT = 256
TABLE_BITS = 21
SLICE = 4096
NEAR_BITS = 18
FIRST_BLOCK, BLOCK = 64, 2048
#: Longest array that a task keeps from one piece of text to the next.
HELD_DECISIONS = 2_000_000
#: Decisions after which a task sends its counts and starts anew, so that no 32-bit counter can overflow.
SEND_DECISIONS = 1 << 31
GATES = 16
EASE = 200.0
#: The levels of votes that the fit tells apart, and the borders between them; zero is a level of its own.
LEVELS = np.sinh(0.2 * np.arange(-15, 16))
BORDERS = (LEVELS[1:] + LEVELS[:-1]) / 2
END = np.uint64(0x5BF03635D1CE4E5B)

_U64, _U32 = np.uint64, np.uint32


class Room:
    """Arrays by name that every piece of text fills anew: fresh ones cost more in page faults than the arithmetic on them."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, dtype) -> np.ndarray:
        have = self.kept.get(name)
        if have is None or len(have) < n:
            have = np.empty(n + n // 4, dtype)
            if n <= HELD_DECISIONS:
                self.kept[name] = have
        return have[:n]

    def ramp(self, n: int) -> np.ndarray:
        """0 to n - 1."""
        have = self.kept.get("ramp")
        if have is None or len(have) < n:
            have = np.arange(n + n // 4)
            if n <= HELD_DECISIONS:
                self.kept["ramp"] = have
        return have[:n]


def _owners(n: np.ndarray, out: np.ndarray) -> np.ndarray:
    """0 n[0] times, then 1 n[1] times and so on."""
    begin = np.cumsum(n) - n
    out.fill(0)
    np.add.at(out, begin[begin < len(out)], 1)
    out[:1] -= 1
    return np.cumsum(out, out=out)


class Code:
    """A Huffman tree: the path of every symbol (nodes and bits, root first) and each node's share of ones.

    Nodes are numbered by subtrees of three levels: 8 times the subtree plus 1 to 7, the place in it.  ``apart`` keeps the slots of two trees apart."""

    def __init__(self, weight: np.ndarray, apart: int = 0):
        n = len(weight)
        heap = [(int(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, side, total = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), [*map(int, weight)] + [0] * n
        top = n
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b], side[b] = top, top, 1
            total[top] = wa + wb
            heapq.heappush(heap, (wa + wb, top))
            top += 1
        root = top - 1
        number, depth, subtrees = [9 if i == root else 0 for i in range(top)], [0] * top, 2
        up, right = parent.tolist(), side.tolist()
        for c in range(root - 1, n - 1, -1):
            depth[c] = depth[up[c]] + 1
            if depth[c] % 3:
                number[c] = number[up[c]] + (number[up[c]] & 7) + right[c]
            else:
                number[c] = 8 * subtrees + 1
                subtrees += 1
        number = np.array(number, np.int32)
        one = np.full(8 * subtrees, 0.5)
        for c in range(root):
            if right[c]:
                one[number[up[c]]] = total[c] / total[up[c]]
        at, paths = np.arange(n), []
        while True:
            live = at != root
            if not live.any():
                break
            paths.append((np.where(live, number[parent[at]], -1), side[at]))
            at = np.where(live, parent[at], root)
        nodes = np.stack([p for p, _ in paths[::-1]], axis=1) if paths else np.zeros((n, 0), np.int64)
        bits = np.stack([b for _, b in paths[::-1]], axis=1) if paths else np.zeros((n, 0), np.uint8)
        real = nodes >= 0
        self.size = real.sum(axis=1)
        self.start = np.cumsum(self.size) - self.size
        self.nodes, self.bits = nodes[real].astype(np.int32), bits[real].astype(np.uint8)
        one = np.clip(one, 1e-9, 1 - 1e-9)
        self.vote = np.log(one / (1 - one)).astype(np.float32)
        #: Key of the node's subtree (28 bits, odd), place of the node in it (3 bits) and the bit of the path.
        self.packed = _node_keys(self.nodes + np.int32(apart)) << _U32(4) | (self.nodes & 7).astype(_U32) << _U32(1) | self.bits
        #: The node's vote against the bit of the path.
        self.against = np.where(self.bits.astype(bool), -self.vote[self.nodes], self.vote[self.nodes])

    def __call__(self, symbols: np.ndarray, room: Room, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decisions of each symbol, place of each decision's symbol, place of each decision in the paths)."""
        n = self.size.take(symbols)
        total = int(n.sum())
        owner = _owners(n, room("owner", total, np.intp))
        path = (self.start.take(symbols) - (np.cumsum(n) - n)).take(owner, out=room(name + "path", total, np.intp), mode="clip")
        path += room.ramp(total)
        return n, owner, path


class Model:
    """What every scoring task needs; its size is bounded by HEAD and TABLE_BITS."""

    def __init__(self, head: np.ndarray, count: np.ndarray, rest: int, byte_count: np.ndarray, total: int, distinct: int):
        order = np.argsort(head)
        self.head, self.count = head[order], count[order]
        self.total, self.distinct = total, distinct
        rank = np.empty(len(head), np.int64)
        rank[np.argsort(-self.count, kind="stable")] = np.arange(len(head))
        self.mark = np.where(rank < FREQUENT, rank, -1)
        self.words = Code(np.append(self.count, max(1, rest)))
        self.bytes = Code(byte_count + 1, 1 << 24)
        self.votes = self.weights = None
        #: First head word at or behind each value of the top bits of a hash; one more head word ends every search.
        self.near = np.searchsorted(self.head, np.arange(1 << NEAR_BITS, dtype=_U64) << _U64(64 - NEAR_BITS)).astype(np.int32)
        self.ended = np.append(self.head, ~_U64(0))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Head index of each word, or the escape symbol."""
        at = self.near.take((hashes >> _U64(64 - NEAR_BITS)).view(np.int64)).astype(np.int64)
        found = self.ended.take(at)
        behind = np.flatnonzero(found < hashes)
        while len(behind):
            at[behind] += 1
            found[behind] = more = self.ended.take(at[behind])
            behind = behind[more < hashes[behind]]
        at[found != hashes] = len(self.head)
        return at


def _tokenised(buf: np.ndarray, offs: np.ndarray):
    """(token hashes with an end after every text, first token of each text plus one more, word starts and ends per token,
    lower-cased bytes)."""
    low = t.LOWER[buf]
    starts, ends, first = t.words(low, offs, t.NON_SPACE)
    hashes = t.hash_runs(low, starts, ends)
    at = first[1:]
    return np.insert(hashes, at, END), first + np.arange(len(first)), np.insert(starts, at, 0), np.insert(ends, at, 0), low


def _slots(context: np.ndarray, node: np.ndarray, salt: int) -> np.ndarray:
    return _spread(context, np.arange(len(node)), _node_keys(node), (node & 7).astype(_U32), salt, Room(), "")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U32(16))) * _U32(0x7FEB352D)
    x = (x ^ (x >> _U32(15))) * _U32(0x846CA68B)
    return x ^ (x >> _U32(16))


def _node_keys(node: np.ndarray) -> np.ndarray:
    """One for all nodes of a subtree."""
    return _mixed((node >> 3).astype(_U32) * _U32(0xC2B2AE35)) >> _U32(4) | _U32(1)


def _spread(context: np.ndarray, owner: np.ndarray, keys: np.ndarray, places: np.ndarray, salt: int, room: Room, name: str) -> np.ndarray:
    """Slots of decisions: the place of each one's context, with the keys of the nodes and the places in their subtrees.  A
    context's nodes of one subtree are neighbours in eight slots, so that they are read together."""
    x = (_mixed((context * _U32(0x85EBCA6B)) ^ _U32(salt)) | _U32(1)).take(owner, out=room("x", len(owner), _U32), mode="clip")
    x *= keys
    x >>= _U32(32 - TABLE_BITS)
    x ^= places
    slots = room(name, len(owner), np.intp)
    slots[:] = x
    return slots


def _stream(code: Code, symbols: np.ndarray, contexts: tuple[np.ndarray, np.ndarray], salts: tuple[int, int], room: Room, name: str):
    """(decisions of each symbol, places in the paths, bits, slots 1, slots 2)."""
    n, owner, path = code(symbols, room, name)
    keys = code.packed.take(path, out=room("keys", len(path), _U32), mode="clip")
    bit = np.bitwise_and(keys, _U32(1), out=room(name + "bit", len(path), _U32))
    places = np.right_shift(keys, _U32(1), out=room("places", len(path), _U32))
    places &= _U32(7)
    keys >>= _U32(4)
    return n, path, bit, *(_spread(c, owner, keys, places, salt, room, f"{name}{k}") for k, (c, salt) in enumerate(zip(contexts, salts)))


def streams(model: Model, buf: np.ndarray, offs: np.ndarray, room: Room | None = None):
    """Two streams of decisions, words and spelled bytes: (code, first decision of each text plus one, place in its paths, bit, slots 1, slots 2),
    and with them the token hashes, the first token of each text, the head index of every token, and the first decision of
    each spelled word plus one.  What lies in ``room`` holds until the next call."""
    room = room or Room()
    hashes, first, starts, ends, low = _tokenised(buf, offs)
    symbols = model.tokens(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = first[:-1][text]
    place = np.arange(len(symbols))
    mark = np.append(model.mark, -1)[symbols]
    seen = np.maximum.accumulate(np.where(mark >= 0, place, -1))
    seen = np.concatenate([[-1], seen[:-1]])
    topic = np.where(seen >= begin, mark[seen], FREQUENT).astype(_U32)
    last = np.concatenate([[_U64(0)], hashes[:-1]])
    last = np.where(place == begin, _U64(0), last)
    back = (last ^ (last >> _U64(32))).astype(_U32)
    n, *found = _stream(model.words, symbols, (topic, back), (0x11111111, 0x22222222), room, "word ")
    words = (model.words, np.concatenate([[0], np.cumsum(n)])[first], *found)

    odd = np.flatnonzero(symbols == len(model.head))
    size = ends[odd] - starts[odd] + 1
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts[odd] - (stop - size), size)
    tail = np.zeros(len(at), bool)
    tail[stop - 1] = True
    letters = np.append(low, 0)[at]
    letters[tail] = 0x20
    depth = np.arange(len(at)) - np.repeat(stop - size, size)
    recent = np.zeros(len(at), _U32)
    short = np.zeros(len(at), _U32)
    for k in range(1, 5):
        prior = np.zeros(len(at), _U32)
        prior[k:] = letters[:-k].astype(_U32) + _U32(1) if len(at) > k else prior[k:]
        prior[depth < k] = 0
        recent = recent * _U32(257) + prior
        if k == 2:
            short = recent.copy()
    n, *found = _stream(model.bytes, letters.astype(np.int64), (short, recent), (0x33333333, 0x44444444), room, "letter ")
    per_word = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], stop])] if len(odd) else np.zeros(1, np.int64)
    bounds = per_word[np.searchsorted(odd, first)]
    spelled = (model.bytes, bounds, *found)
    return (words, spelled), hashes, first, symbols, per_word


def _packed(counts: np.ndarray) -> bytes:
    """Counts in full, in the narrowest of three widths; ``_unpacked`` tells the width by the size."""
    most = int(counts.max())
    return counts.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def _unpacked(data) -> np.ndarray:
    width = data.size // (4 * SLICE)
    return np.frombuffer(data, {2: np.uint16, 4: np.uint32, 8: np.uint64}[width]).reshape(2, SLICE, 2)


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = 2 * SLICE
    for i in range(0, counts.shape[1], width):
        part = counts[:, i : i + width]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // width], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["slice", "counts"])


def _gather(model):
    """Counts of zeros and ones in both hashed tables over a task's documents, as dense slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        counts = np.zeros((2, 2 << TABLE_BITS), np.uint32)
        room, unsent = Room(), 0
        for batch in batches:
            for _, _, buf, offs in t.pieces(t.texts_of(batch)):
                for _, _, _, bit, *slots in streams(own, buf, offs, room)[0]:
                    for c in range(2):
                        at = np.left_shift(slots[c], 1, out=slots[c])
                        at |= bit
                        np.add.at(counts[c], at, _U32(1))
                    unsent += len(bit)
                if unsent > SEND_DECISIONS:
                    yield from _slices(counts)
                    counts[:], unsent = 0, 0
        yield from _slices(counts)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            own = _unpacked(data.as_buffer())
            if i in sums:
                sums[i] += own
            else:
                sums[i] = own.astype(np.uint64)
    return sums


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, n in _summed(batches).items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(n)], pa.binary())], names=["slice", "counts"])


def _tables(slices: DataFrame) -> np.ndarray:
    """Both tables of votes of the slices."""
    return _collected(slices)


def _collected(slices: DataFrame) -> np.ndarray:
    out = np.zeros((2, 1 << TABLE_BITS), _U32)
    found = slices.repartition(partitions(slices.sparkSession), "slice").mapInArrow(_votes, "slice int, votes binary").toArrow()
    for i, v in zip(found.column("slice").to_pylist(), found.column("votes")):
        out[:, i * SLICE : (i + 1) * SLICE] = np.frombuffer(v.as_buffer(), _U32).reshape(2, SLICE)
    return out


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed slices -> votes in the logistic domain, with how far they can be trusted (0 to 3) in their two lowest bits."""
    for i, n in _summed(batches).items():
        seen = n.sum(axis=2)
        vote = np.log((n[:, :, 1] + 0.4) / (n[:, :, 0] + 0.4)).astype(np.float32)
        trust = np.searchsorted([0.5, 2.5, 11.5], seen.ravel()).astype(np.uint32).reshape(seen.shape)
        packed = (vote.view(np.uint32) & ~_U32(3)) | trust
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["slice", "votes"])


def _inputs(model: Model, stream, room: Room):
    """(bounds, the three votes against the bits that came, gate): a table entry is a vote whose two lowest bits are its trust."""
    code, bounds, path, bit, *slots = stream
    size = len(path)
    a, b = (model.votes[k].take(slots[k], out=room(f"vote {k}", size, _U32), mode="clip") for k in (0, 1))
    trust = np.bitwise_and(a, _U32(3), out=room("places", size, _U32))
    trust <<= _U32(2)
    trust |= np.bitwise_and(b, _U32(3), out=room("x", size, _U32))
    gate = room("gate", size, np.uint8)
    gate[:] = trust
    sign = np.left_shift(bit, _U32(31), out=room("x", size, _U32))
    a ^= sign
    b ^= sign
    node = code.against.take(path, out=room("vote", size, np.float32), mode="clip")
    return bounds, (node, a.view(np.float32), b.view(np.float32)), gate


def _levels(votes: np.ndarray) -> np.ndarray:
    """Table of votes -> level and trust of each in one byte."""
    return (np.searchsorted(BORDERS, votes.view(np.float32)).astype(np.uint8) << 2) | (votes & _U32(3)).astype(np.uint8)


def _cells(model, levels):
    """Decisions of a task's documents by stream, levels of the three votes, trusts and bit, against the tables of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = model.value, levels.value
        node_level = {id(code): (np.searchsorted(BORDERS, code.vote)[code.nodes] << 15 | code.bits).astype(_U32) for code in (own.words, own.bytes)}
        counts, room = np.zeros((2, 1 << 20), np.uint64), Room()
        for batch in batches:
            for half in (0, 1):
                part = batch.filter(pc.equal(batch.column("half"), half))
                for _, _, buf, offs in t.pieces(t.texts_of(part)):
                    for k, (code, _, path, _, *slots) in enumerate(streams(own, buf, offs, room)[0]):
                        cell = node_level[id(code)].take(path, out=room("keys", len(path), _U32), mode="clip")
                        for table, at, shift in zip(tables[1 - half], slots, (8, 1)):
                            level = room("x", len(path), _U32)
                            level[:] = table.take(at, out=room("level", len(path), np.uint8), mode="clip")
                            level <<= _U32(shift)
                            cell |= level
                        slots[0][:] = cell
                        np.add.at(counts[k], slots[0], _U64(1))
        yield from _slices(counts)

    return run


def _fit_weights(cells: np.ndarray) -> np.ndarray:
    """Start weights of every gate by Newton steps of a logistic fit on the counted decisions (two streams x gates x predictors)."""
    out = np.zeros((2, GATES, 3))
    out[:, :, 0] = 1.0
    for k in (0, 1):
        n = cells[k].reshape(-1, 2).astype(np.float64)
        cell = np.flatnonzero(n.any(axis=1))
        gates = (cell >> 7 & 3) * 4 + (cell & 3)
        votes = np.stack([LEVELS[cell >> 14], LEVELS[cell >> 9 & 31], LEVELS[cell >> 2 & 31]])
        for g in range(GATES):
            mine = gates == g
            x, zeros, ones, w = votes[:, mine], n[cell[mine], 0], n[cell[mine], 1], out[k, g].copy()
            if zeros.sum() + ones.sum() < 50:
                continue
            for _ in range(20):
                p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
                hess = (x * ((zeros + ones) * p * (1 - p))) @ x.T + 5.0 * np.eye(3)
                step = np.clip(np.linalg.solve(hess, x @ (ones * (1 - p) - zeros * p) - 5.0 * (w - out[k, g])), -0.5, 0.5)
                w += step
                if np.abs(step).max() < 1e-6:
                    break
            out[k, g] = w
    return out


def _costs(weights: np.ndarray, bounds: np.ndarray, votes: tuple[np.ndarray, ...], gate: np.ndarray, room: Room) -> np.ndarray:
    """Minus the natural-log probability of every decision, from votes against the bits that came; every text refines its own
    weights block by block."""
    out = room("cost", len(gate), np.float32)
    order = np.argsort(bounds[:-1] - bounds[1:], kind="stable")  # long texts first: those that go on are the first ones
    a, end, size = bounds[:-1][order], bounds[1:][order], FIRST_BLOCK
    live = int(np.count_nonzero(end > a))
    own = [np.tile(weights[:, j].astype(np.float32), live) for j in range(3)]
    while live:
        a, end = a[:live], end[:live]
        b = np.minimum(a + size, end)
        n = b - a
        total = int(n.sum())
        runs = [slice(i, j) for i, j in zip(a.tolist(), b.tolist())]
        x = [np.concatenate([v[r] for r in runs], out=room(f"block {j}", total, np.float32)) for j, v in enumerate(votes)]
        g = _owners(n, room("owner", total, np.intp))
        g *= GATES
        g += np.concatenate([gate[r] for r in runs], out=room("block gate", total, np.uint8))
        odds = own[0].take(g, out=room("odds", total, np.float32), mode="clip")  # at first the log odds against the bits that came
        odds *= x[0]
        more = room("more", total, np.float32)
        for j in (1, 2):
            own[j].take(g, out=more, mode="clip")
            more *= x[j]
            odds += more
        np.clip(odds, -30, 30, out=odds)
        np.exp(odds, out=odds)
        sure = np.add(odds, np.float32(1), out=more)
        live = int(np.count_nonzero(end > b))
        m = int(n[:live].sum())
        miss = np.divide(odds[:m], sure[:m], out=odds[:m])
        cost, at = np.log(sure, out=sure), 0
        for r, k in zip(runs, n.tolist()):
            out[r] = cost[at : at + k]
            at += k
        if live:
            g = g[:m]
            ease = EASE + np.bincount(g, minlength=live * GATES)
            pull = room("pull", m, np.float64)
            for j in range(3):
                np.multiply(miss, x[j][:m], out=pull)
                own[j] = own[j][: live * GATES] - (np.bincount(g, weights=pull, minlength=live * GATES) / ease).astype(np.float32)
        a = b
        size = min(2 * size, BLOCK)
    return out


def _totals(cost: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs that start at bounds, the last bound being the end."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(cost, bounds[some], dtype=np.float64)
    return out


_SCORED = "doc_id long, n_bytes long, n_tokens long, head_known long, head_base double, head_score double, tail array<struct<h: long, spelled: double>>"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        spread = float(own.total + own.distinct + 1)
        gain = np.append(np.log10((own.count + 1) / spread), 0.0)
        known = np.append(own.count > 0, False)
        room = Room()
        for batch in batches:
            for a, b, buf, offs in t.pieces(t.texts_of(batch)):
                (words, spelled), hashes, first, symbols, per_word = streams(own, buf, offs, room)
                in_head = -_totals(_costs(own.weights[0], *_inputs(own, words, room), room), words[1]) / np.log(10.0)
                letters = -_totals(_costs(own.weights[1], *_inputs(own, spelled, room), room), per_word) / np.log(10.0)
                odd = symbols == len(own.head)
                split = np.concatenate([[0], np.cumsum(odd)])[first].astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(hashes[odd].view(np.int64)), pa.array(letters)], names=["h", "spelled"])
                cols = [
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offs).astype(np.int64)), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.add.reduceat(known[symbols], first[:-1]).astype(np.int64)), pa.array(np.add.reduceat(gain[symbols], first[:-1])), pa.array(in_head), pa.ListArray.from_arrays(pa.array(split), tail),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "head_known", "head_base", "head_score", "tail"])

    return run


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_tokenised(buf, offs)[0] for _, _, buf, offs in t.pieces(t.texts_of(batch))]
        if parts:
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].view(np.int64)), pa.array(c[i : i + 50_000])], names=["h", "c"])


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for _, _, buf, _ in t.pieces(t.texts_of(batch)):
            total += np.bincount(t.LOWER[buf], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int64()), pa.array(total)], names=["h", "c"])


def lm_scores(docs: DataFrame, head: int = HEAD, sample: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs (doc_id, text).

    Training documents are those whose crc32 of doc_id mod 7 is not 2; null texts are empty (one end token), also in
    training, and have no bits_per_byte.  Rows of one doc_id, and rows without one (held out or not by the hash of the empty
    text), are scored on their own; very long texts are scored whole.  Words are told apart by 64-bit hashes.  Counts of words, bytes and
    contexts and the fit of the weights cover all training documents (``sample``, which bounded the fit, has no effect any more); the ``head`` most frequent words of two uses or more are broadcast, all others meet their counts in a join."""
    spark = docs.sparkSession
    docs = with_text(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD
    train = docs.where(~held)
    counts = written(train.mapInArrow(_token_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    total, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    # Words seen once stay outside the head: their share of the tokens is what unseen words may be expected to have, and words
    # seen r times may be expected to have the share of those seen r + 1 times.
    top = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(head).toArrow()
    letters = train.mapInArrow(_byte_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).collect()
    byte_count = np.zeros(256, np.int64)
    for r in letters:
        byte_count[r.h] = r.c
    head_hash, head_count = top.column("h").to_numpy().view(_U64), top.column("c").to_numpy()
    outside = int(total) - int(head_count.sum())
    edge = int(head_count.min()) if len(head_count) == head else 1  # no word outside the head is more frequent
    again = int(counts.where((F.col("c") > 1) & (F.col("c") <= edge + 1)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    model = Model(head_hash, head_count, int(once) + again, byte_count, int(total), int(distinct))
    known = spark.sparkContext.broadcast(model)
    halved = train.withColumn("half", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int"))
    dealt = lambda slices: slices.repartition(partitions(spark), "slice").mapInArrow(_sums, "slice int, counts binary")
    halves = [written(dealt(halved.where(F.col("half") == half).select("text").mapInArrow(_gather(known), "slice int, counts binary")), label) for half, label in enumerate(("lm-slices", "lm-sample"))]
    levels = spark.sparkContext.broadcast([_levels(_tables(halves[0])), _levels(_collected(halves[1]))])
    cells = np.zeros((2, 1 << 20), np.uint64)
    for r in dealt(halved.mapInArrow(_cells(known, levels), "slice int, counts binary")).toArrow().to_batches():
        for i, n in _summed([r]).items():
            cells[:, 2 * i * SLICE : 2 * (i + 1) * SLICE] = n.reshape(2, -1)
    levels.unpersist()
    known.unpersist()
    model.weights = _fit_weights(cells)
    model.votes = _tables(halves[0].unionByName(halves[1]))
    discard(*halves)
    ready = spark.sparkContext.broadcast(model)

    scored = written(docs.mapInArrow(_score(ready), _SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    ready.unpersist()
    words = scored.select("row", F.inline("tail"))
    spread = float(int(total) + int(distinct) + 1)
    gain = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(spread))
    new = (int(once) + 1) / (int(once) + again + 2) if outside else 1.0  # share of unseen words among those outside the head
    either = F.col("c") * F.lit((1 - new) / max(1, outside)) + F.pow(F.lit(10.0), F.col("spelled")) * F.lit(new)
    mixed = F.when(F.col("c").isNull(), F.col("spelled") + F.lit(float(np.log10(new)))).otherwise(F.log10(either))
    tails = words.join(counts, "h", "left").groupBy("row").agg(F.sum(gain).alias("tail_base"), F.count("c").alias("tail_known"), F.sum(mixed).alias("tail_score"))
    out = scored.drop("tail").join(tails, "row", "left").withColumn("score", F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score", F.try_divide(-F.col("score") * F.lit(float(np.log2(10.0))), F.col("n_bytes")).alias("bits_per_byte"),
    )
