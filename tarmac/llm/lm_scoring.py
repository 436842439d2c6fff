"""LM scoring by online logistic context mixing, and a unigram base beside it.

A text is its words, lower-cased A-Z, and one end. Each token is coded by binary
decisions: does a context of two words know it, else the context of one word,
else any text at all; a token that none knows is spelled, bit by bit along a code
tree. Among what a context knows, a token has the share of its count.

*Counts.* What contexts know are counts of hashed word pairs and triples and of
whole words over all training texts; they grow with the corpus. Tasks gather their
block's distinct n-grams, each meets its like in a bucket of its hash (one entry
a block, so no key is hot), and the sums go back to the blocks that asked.

*Online.* A text is read in order: at each token the counts are those of the other
training texts and of what the text itself had before. A training text's own
counts are left out, so a text that is in the training data once and one that is
held out are read alike, and a text that occurs twice is known by its copy.

*Mixing.* Four hashed-context predictors estimate every decision: by the context's
count, by the last three tokens' outcomes, by the counts of both contexts, and by
the word before. Their log odds are mixed with weights gated by the decision and
the last outcome; the weights follow the text's own bits, block by block. Spelled
bits are mixed from the last byte, the last two and the last three.

*Fit.* Counts, spelling tables, the code tree and the predictors' bit counts are
sums over all training texts. Starting and spelling weights are fitted on all
their decisions and spelled words: each block takes Newton steps on its own, and
the blocks' quadratic forms about where they end are summed and solved once.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import SPACES, Scratch, mix64, released

#: How often a block looks at its decisions and its spelled words, and how strongly weights are drawn to their start.
LOOKS, SPELLED_LOOKS, PRIOR = 3, 2, 30.0
#: Characters of a block, which a task holds at once (a longer text is a block of its own), and of a bucket's share.
BLOCK_CHARS, BUCKET_CHARS, PIECE = 6_000_000, 8_000_000, 1 << 20
#: Bits of an n-gram's hash over those of the number of all characters: at most about one n-gram in 2000 shares another's counts.
SPARE_BITS = 8
#: log2 of the slots of each spelling table: contexts of at most three bytes, so they need not grow.
TABLE_BITS = (16, 18, 20)
#: Decisions of a text between two moves of its weights, and how far they move.
STEP, RATE = 32, 0.02
SLICE = 1 << 16
END = 0xFF
LOG_ODDS_STEP = 16.0
GAP = re.compile(rb"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- packed integers


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, the used ones alone, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    used = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8).T[:used]
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    out = np.zeros((len(raw) // data[0], 8), np.uint8)
    out[:, : data[0]] = raw.reshape(data[0], -1).T
    return out.view("<u8").ravel()


def groups(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions by key, equal keys in order of position; their keys; and where a new key begins. Keys are under ``bound``."""
    n = len(key)
    shift = max(1, n).bit_length()
    if bound.bit_length() + shift < 63:
        both = np.sort(key << shift | np.arange(n))
        at, key = both & ((1 << shift) - 1), both >> shift
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    return at, key, np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]])


def ascending(x: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit hashes, by their upper bits with the position below where those differ."""
    shift = np.uint64(max(1, len(x)).bit_length())
    both = np.sort(x >> shift << shift | np.arange(len(x), dtype=np.uint64))
    upper = both >> shift
    if (upper[1:] == upper[:-1]).any():
        return np.argsort(x, kind="stable")
    return (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)


# ---------------------------------------------------------------- spelling


class Code:
    """A binary code for bytes: for each, the inner nodes on its path and the turns taken."""

    def __init__(self, counts: np.ndarray) -> None:
        heap = [(int(n) + 1, k, k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        children, tick = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[tick] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], tick, tick))
            tick += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        walk: list[tuple[int, list]] = [(heap[0][2], [])]
        while walk:
            node, path = walk.pop()
            if node < 256:
                paths[node] = path
            else:
                walk += [(child, [*path, (node - 256, turn)]) for turn, child in enumerate(children[node])]
        self.size = np.array([len(paths[k]) for k in range(256)], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.node = np.array([n for k in range(256) for n, _ in paths[k]], np.int64)
        self.turn = np.array([t for k in range(256) for _, t in paths[k]], np.uint8)
        self.salt = (mix64(self.node.astype(np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)

    def bits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Turns, their nodes, each table's slots, and each word's first bit. The empty word is a text's end."""
        data = np.frombuffer(b"".join([w + b"\xff" for w in words]), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        n = len(data)
        place = np.arange(n) - np.repeat(starts, lengths)
        padded = np.concatenate([np.full(3, END, np.uint8), data])
        context, slots = np.zeros(n, np.uint64), []
        sizes = self.size[data]
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(n), sizes)
        at = np.arange(len(owner)) + (self.first[data] - (ends - sizes))[owner]
        for k, b in zip((1, 2, 3), TABLE_BITS, strict=True):
            context = context << np.uint64(8) | np.where(place >= k, padded[3 - k : 3 - k + n], END).astype(np.uint64)
            mixed = (mix64(context + np.uint64(k << 56)) >> np.uint64(32)).astype(np.uint32)
            with np.errstate(over="ignore"):
                slots.append((((mixed[owner] ^ self.salt[at]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - b)).astype(np.int64))
        return self.turn[at], self.node[at], slots, (ends - sizes)[starts]


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds in steps of 1/16, one byte a slot."""
    return np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * LOG_ODDS_STEP), -127, 127).astype(np.int8)


class Speller:
    """Costs of words in nats, bit by bit, from tables of bit counts over all distinct training words."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        self.code, self.tables = code, tables
        self.weights = np.full((255, len(tables)), 0.4 / LOG_ODDS_STEP) if weights is None else weights

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        turn, node, slots, first = self.code.bits(words)
        return turn, node, np.stack([t.take(s) for t, s in zip(self.tables, slots, strict=True)], 1).astype(np.float64), first

    def chunks(self, words: list[bytes]):
        """First word, turns, nodes, each table's log odds and each word's first bit, 20,000 words at a time."""
        for at in range(0, len(words), 20_000):
            turn, node, slots, first = self.code.bits(words[at : at + 20_000])
            yield at, turn, node, [t.take(s) for t, s in zip(self.tables, slots, strict=True)], first

    def cost(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, turn, node, odds, first in self.chunks(words):
            z = np.zeros(len(turn))
            for x, w in zip(odds, self.weights.T, strict=True):
                z += x * np.ascontiguousarray(w).take(node)
            out[at : at + 20_000] = np.add.reduceat(nats(np.where(turn, z, -z)), first)
        return out

    def form(self, words: list[bytes]) -> np.ndarray:
        """The quadratic form of these words' nats in the weights, by node."""
        total = np.zeros((255, len(self.tables), len(self.tables) + 1))
        for _, turn, node, odds, _ in self.chunks(words):
            by = np.argsort(node.astype(np.uint8), kind="stable")
            x = np.stack([o.take(by) for o in odds]).astype(np.float32)
            total += form(x, turn.take(by), np.searchsorted(node.take(by), np.arange(256)), self.weights, PRIOR * LOG_ODDS_STEP**2, SPELLED_LOOKS)
        return total


def nats(z: np.ndarray) -> np.ndarray:
    """Cost of a bit whose log odds are ``z``."""
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(-z, 0)


def form(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, start: np.ndarray, prior: float, looks: int) -> np.ndarray:
    """By gate, the curvature of the bits' log-likelihood in the weights, and curvature times place plus slope beside it.

    ``x`` has a row an input; columns ``cuts[g]`` to ``cuts[g + 1]`` are gate g's. The form is taken where ``looks - 1`` Newton steps from
    ``start``, drawn towards it, end. Forms of parts of the data add up.
    """
    gates, k = start.shape
    out = np.zeros((gates, k, k + 1))
    for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        own, w = x[:, a:b], start[g].copy()
        for look in range(looks):
            p = 1 / (1 + np.exp(-(w.astype(x.dtype) @ own)))
            slope = (own @ (y[a:b] - p).astype(x.dtype)).astype(np.float64)
            curve = ((own * (p * (1 - p))) @ own.T).astype(np.float64)
            if look < looks - 1:
                w += np.linalg.solve(curve + prior * np.eye(k), slope - prior * (w - start[g]))
        out[g, :, :k], out[g, :, k] = curve, curve @ w + slope
    return out


def solved(total: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
    """The weights at the least of a sum of forms and of the draw towards ``start``."""
    k = start.shape[1]
    return np.linalg.solve(total[:, :, :k] + prior * np.eye(k), (total[:, :, k] + prior * start)[:, :, None])[:, :, 0]


# ---------------------------------------------------------------- blocks


class Block:
    """Texts as numbered tokens (0 start, 1 end, then the block's distinct words) with their pairs and triples.

    Each text is laid out as two starts, its words and its end. ``ids`` has, by
    order of n-gram, each place's n-gram (meaningless where the text has none yet)
    and ``hashes`` their hashes.
    """

    def __init__(self, words: list[bytes], numbers: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.sizes = words, sizes
        lengths = sizes + 3
        starts = np.cumsum(lengths) - lengths
        self.n = int(lengths.sum())
        self.text = np.repeat(np.arange(len(sizes)), lengths)
        self.place = np.arange(self.n) - starts[self.text]
        token = np.zeros(self.n, np.int64)
        token[(self.place >= 2) & (self.place < lengths[self.text] - 1)] = numbers + 2
        token[starts + lengths - 1] = 1
        hashed = np.array([0x51A7, 0xE17D, *map(xxhash.xxh3_64_intdigest, words)], np.uint64)
        many = len(hashed)
        self.ids, self.hashes = {1: token}, {1: hashed}
        for order, multiplier in ((2, 0x9E3779B97F4A7C15), (3, 0xD1342543DE82EF95)):
            at = np.flatnonzero(self.place >= order - 1)
            where, key, new = groups(self.ids[order - 1][at - 1] * many + token[at], (len(self.hashes[order - 1]) + 1) * many)
            ids = np.zeros(self.n, np.int64)
            ids[at[where]] = np.cumsum(new) - 1
            key = key[new]
            with np.errstate(over="ignore"):
                self.hashes[order] = mix64(mix64(self.hashes[order - 1][key // many] * np.uint64(multiplier)) + hashed[key % many])
            self.ids[order] = ids

    def by_hash(self, order: int) -> np.ndarray:
        """The n-grams in order of their hash, words without start and end: the order in which they are asked for."""
        return ascending(self.hashes[1][2:]) + 2 if order == 1 else ascending(self.hashes[order])

    def before(self, order: int, totals: np.ndarray, own: np.ndarray) -> np.ndarray:
        """At each place, how often its n-gram came before: in all training texts but the text itself if that is one (``own``), and in the text up to there."""
        at = np.flatnonzero(self.place >= order - 1)
        ids, text = self.ids[order][at], self.text[at]
        where, key, new = groups(text * len(totals) + ids, (len(self.sizes) + 1) * len(totals))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        group = np.cumsum(new) - 1
        out = np.zeros(self.n, np.int64)
        rank = np.arange(len(key)) - first[group]
        out[at[where]] = totals[ids[where]] - np.where(own[text[where]], size[group], 0) + rank
        return out


class Decisions:
    """A block's texts as decisions with their contexts, and what is paid beside them."""

    #: Slots of the four predictors.
    SLOTS = (3 * 48, 3 * 64, 12 * 256, 3 * 4096)
    GATES = 12

    def __init__(self, block: Block, totals: dict[int, np.ndarray], tokens: int, own: np.ndarray) -> None:
        at = np.flatnonzero(block.place >= 2)
        text, place = block.text[at], block.place[at] - 2
        single, pair, triple = (block.before(k, totals[k], own) for k in (1, 2, 3))
        counts = np.stack([single[at], pair[at], triple[at]])
        # What a context has seen follow it: all tokens, the word before (at a text's start: all other texts), both words before.
        first = np.where(place == 0, pair[at - 1], single[at - 1])
        known = np.stack([tokens - np.where(own, block.sizes + 1, 0)[text] + place, first, pair[at - 1]])
        counts = np.minimum(counts, known)  # hashes may collide
        outcome, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        cost = np.zeros(len(at))
        asked = []
        for stage in (2, 1, 0):
            asks = open_ & (known[stage] > 0)
            hit = asks & (counts[stage] > 0)
            asked.append(np.flatnonzero(asks) * 3 + 2 - stage)
            cost[hit] = np.log(known[stage][hit]) - np.log(counts[stage][hit])
            outcome[hit], open_ = stage + 1, open_ & ~hit
        spelled = np.flatnonzero(open_)
        which, self.spelled = np.unique(block.ids[1][at[spelled]], return_inverse=True)
        #: Words that are spelled, and the texts that spell them.
        self.unknown, self.spelled_by = [b"" if k == 1 else block.words[k - 2] for k in which.tolist()], text[spelled]
        back = [np.where(place >= k, np.concatenate([np.zeros(k, np.int64), outcome[:-k]])[: len(at)], 0) for k in (1, 2, 3)]
        order = np.sort(np.concatenate(asked))
        token, stage = order // 3, 2 - order % 3
        self.bit = (outcome[token] == stage + 1).astype(np.float64)
        last, n = back[0][token], known[stage, token]
        level = lambda c, top: np.minimum(np.frexp(c)[1], top)
        slots = [
            stage * 48 + np.minimum(np.floor(2 * np.log2(n)).astype(np.int64), 47),
            stage * 64 + last * 16 + back[1][token] * 4 + back[2][token],
            (stage * 4 + last) * 256 + level(known[2][token], 15) * 16 + level(known[1][token], 15),
            stage * 4096 + (block.hashes[1][block.ids[1][at - 1]] >> np.uint64(52)).astype(np.int64)[token],
        ]
        self.slots = [s.astype(np.int32) for s in slots]
        #: Where each text's decisions begin, and its cost beside them and beside spelling.
        self.bounds = np.searchsorted(text[token], np.arange(len(block.sizes) + 1))
        self.beside = np.bincount(text, cost, len(block.sizes))

    @staticmethod
    def gates(slots: list[np.ndarray]) -> np.ndarray:
        """Stage and last outcome, which the second predictor's slots begin with."""
        return slots[1] >> 4


def odds(ones: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Log odds of a slot's bit, drawn towards the stage's rate."""
    p = (ones + 4 * rate) / (n + 4)
    return np.log(p) - np.log1p(-p)


class Mixer:
    """The predictors' log odds by slot, and the starting weights by gate; the last input is constant.

    ``counts`` has zeros and ones by predictor and slot, over all training texts.
    """

    def __init__(self, counts: list[np.ndarray]) -> None:
        k = len(Decisions.SLOTS)
        self.weights = np.zeros((Decisions.GATES, k + 1))
        self.weights[:, :k] = 0.3
        self.odds, self.without = [np.zeros(n) for n in Decisions.SLOTS], []
        by_stage = counts[0].reshape(3, -1, 2).sum(1)
        if not by_stage.any():
            return
        rate = (by_stage[:, 1] + 1) / (by_stage.sum(1) + 2)
        for j, c in enumerate(counts):
            own, n = rate[np.arange(len(c)) // (len(c) // 3)], c.sum(1)
            self.odds[j] = odds(c[:, 1], n, own)
            rest = np.maximum(n - 1, 0)  # without a bit itself: by slot and bit
            self.without.append(np.stack([odds(np.minimum(c[:, 1], rest), rest, own), odds(np.maximum(c[:, 1] - 1, 0), rest, own)], 1).astype(np.float32).ravel())

    def form(self, r: Read) -> np.ndarray:
        """The quadratic form of the nats of a block's training texts in the weights, by gate."""
        own = np.flatnonzero(np.repeat(r.train, np.diff(r.bounds)))
        gate = Decisions.gates(r.slots)[own].astype(np.uint8)
        by = np.argsort(gate, kind="stable")
        own, cuts = own[by], np.searchsorted(gate[by], np.arange(Decisions.GATES + 1))
        x, y = np.full((len(self.odds) + 1, len(own)), 0.5, np.float32), r.bit[own]
        for j, table in enumerate(self.without):
            x[j] = table.take(r.slots[j][own] * 2 + y)
        return form(x, y, cuts, self.weights, PRIOR, LOOKS)

    def cost(self, d: Read) -> np.ndarray:
        """Nats of each text's decisions. Every text starts from the starting weights, which move after each STEP of its decisions."""
        gates, k = self.weights.shape
        sizes = np.diff(d.bounds)
        order = np.argsort(-sizes, kind="stable")
        of = Decisions.gates(d.slots)
        cost, weights, seen = np.zeros(len(sizes)), np.repeat(self.weights[None], len(sizes), 0), np.full((len(sizes), gates, k), 1.0)
        for begin in range(0, int(sizes.max(initial=0)), STEP):
            live = int(np.searchsorted(-sizes[order], -begin))
            rows = order[:live]
            at = (d.bounds[rows] + begin)[:, None] + np.arange(STEP)
            inside = at < d.bounds[rows + 1][:, None]
            at = np.minimum(at, len(d.bit) - 1)
            gate, y, v = of[at], d.bit[at], np.full((live, STEP, k), 0.5)
            for j, (o, s) in enumerate(zip(self.odds, d.slots, strict=True)):
                v[:, :, j] = o.take(s[at])
            cell = (np.arange(live)[:, None] * gates + gate).ravel()
            z = np.einsum("tbj,tbj->tb", v, weights.reshape(-1, k).take(cell, axis=0).reshape(v.shape))
            cost[rows] += (nats(np.where(y > 0, z, -z)) * inside).sum(1)
            wrong = (y - 1 / (1 + np.exp(-z))) * inside
            slope = np.stack([np.bincount(cell, (wrong * v[:, :, j]).ravel(), live * gates).reshape(live, gates) for j in range(k)], 2)
            seen[:live] += slope**2
            weights[:live] += RATE * slope / np.sqrt(seen[:live])
        return cost


# ---------------------------------------------------------------- gathering


ROW = "dest long, kind int, block long, part int, a binary, b binary, n long, v long"
FIELDS = ["dest", "kind", "block", "part", "a", "b", "n", "v"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
#: Kinds of rows: a block's texts; asks and answers for its words, pairs and triples; bits of spelled words; sums.
TEXTS, WORDS, BITS, SUMS = 0, 1, 8, 9


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], FIELDS)


def _pieces(text: bytes):
    """A text, cut between words, so that no list of all words of a very long one is held."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _ask(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Blocks of texts, and what they ask for: their n-grams with how often the block's training texts have them.

    ``docs`` has doc_id, text, train.
    """

    def run(batches):
        partition, number = TaskContext.get().partitionId() << 24, 0

        def done():
            nonlocal number
            words, sizes = list(known), np.array([s for *_, s in rows], np.int64)
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words, flat = [words[k] for k in order.tolist()], rank[flat]
            block, name = Block(words, flat, sizes), partition + number
            number += 1
            train = np.array([t for _, t, *_ in rows], bool)
            head = pickle.dumps([[i for i, *_ in rows], train, np.array([n for _, _, n, _ in rows]), sizes])
            squeeze = zstandard.ZstdCompressor(level=3).compress
            body = pickle.dumps([squeeze(head), squeeze(b"\xff".join(words)), len(words)])
            yield _batch([(-1 - name, TEXTS, name, 0, body, pack(flat), int(train.sum()), None)])
            for order in (1, 2, 3):
                ids, by = block.ids[order], block.by_hash(order)
                times = np.bincount(ids[(block.place >= max(order - 1, 2 if order == 1 else 0)) & train[block.text]], minlength=len(block.hashes[order]))[by]
                hashes = block.hashes[order][by]
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                out = []
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        # A word cannot hold a byte 0xFF: it isn't UTF-8. Hashes ascend, so their differences are small.
                        asked = squeeze(b"\xff".join([words[j - 2] for j in by[a:b].tolist()])) if order == 1 else pack(np.diff(hashes[a:b] >> np.uint64(64 - width), prepend=np.uint64(0)))
                        out.append((k, order, name, k, asked, pack(times[a:b]), None, None))
                for a in range(0, len(out), 64):
                    yield _batch(out[a : a + 64])

        rows, numbers, size = [], [], 0
        known = defaultdict(count().__next__)
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for k, (i, train) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "train")), strict=True)):
                text = (texts[k].as_py() or b"").lower()
                if rows and size + len(text) > BLOCK_CHARS:
                    yield from done()
                    rows, numbers, size = [], [], 0
                    known = defaultdict(count().__next__)
                own = 0
                for piece in _pieces(text):
                    found = piece.split()
                    numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    own += len(found)
                rows.append((i, train, len(text), own))
                size += len(text) + 8
        if rows:
            yield from done()

    return docs.mapInArrow(released(run), ROW)


def _answer(asked: DataFrame, code: Code, buckets: int, width: int) -> DataFrame:
    """Sums what the blocks ask for in each bucket and answers every block; texts pass.

    Of each bucket also come the number of its tokens and distinct words, and the
    bit counts of its distinct training words, each spelled once, by slices of the tables.
    """

    def run(batches):
        held, bucket = defaultdict(list), None
        grow = zstandard.ZstdDecompressor().decompress

        def done():
            tables = [np.zeros(2 << b, np.int64) for b in TABLE_BITS]
            for order in sorted(held):
                asks = held.pop(order)
                times = [unpack(t).astype(np.int64) for *_, t in asks]
                if order == WORDS:
                    number = defaultdict(count().__next__)
                    ids = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in (grow(a).split(b"\xff") for _, a, _ in asks)]
                else:
                    flat = np.concatenate([np.cumsum(unpack(a)).astype(np.int64) for _, a, _ in asks])
                    where, _, new = groups(flat, 1 << width)
                    which = np.empty(len(flat), np.int64)
                    which[where] = np.cumsum(new) - 1
                    ids = np.split(which, np.cumsum([len(t) for t in times])[:-1])
                sums = np.bincount(np.concatenate(ids), np.concatenate(times)).astype(np.int64)
                for (block, *_), own in zip(asks, ids, strict=True):
                    yield _batch([(bucket, order, block, bucket, pack(sums[own]), None, None, None)])
                if order == WORDS:
                    yield _batch([(bucket, SUMS, 0, bucket, None, None, int(sums.sum()), int((sums > 0).sum()))])
                    words = [w for w, n in zip(number, sums.tolist(), strict=True) if n]
                    for a in range(0, len(words), 50_000):
                        turn, _, slots, _ = code.bits(words[a : a + 50_000])
                        for table, slot in zip(tables, slots, strict=True):
                            table += np.bincount(slot * 2 + turn, minlength=len(table))
            for k, table in enumerate(tables):
                for part in range(0, len(table), 2 * SLICE):
                    if table[part : part + 2 * SLICE].any():
                        yield _batch([(bucket, BITS, 0, k * 1000 + part // (2 * SLICE), pack(table[part : part + 2 * SLICE]), None, None, None)])

        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == TEXTS:
                    yield _batch([tuple(row[f] for f in FIELDS)])
                    continue
                if row["dest"] != bucket:
                    yield from done() if held else ()
                    bucket = row["dest"]
                held[row["kind"]].append((row["block"], row["a"], row["b"]))
        if held:
            yield from done()

    return asked.repartition(buckets, "dest").sortWithinPartitions("dest").mapInArrow(released(run), ROW)


def _bits(answered: DataFrame) -> DataFrame:
    """part, a: the spelled bits' slices, summed over the buckets."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("a").to_pylist(), strict=True):
                sums[part] = sums[part] + unpack(data) if part in sums else unpack(data)
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(own)], pa.binary())], ["part", "a"])

    return answered.filter(F.col("kind") == BITS).select("part", "a").repartition("part").mapInArrow(released(run), "part int, a binary")


class Answered:
    """A block with its answers."""

    def __init__(self, body: bytes, numbers: bytes, answers: dict[int, list[bytes]], ends: int) -> None:
        head, words, n = pickle.loads(body)
        grow = zstandard.ZstdDecompressor().decompress
        self.ids, self.train, self.n_bytes, sizes = pickle.loads(grow(head))
        self.block = Block(grow(words).split(b"\xff") if n else [], unpack(numbers).astype(np.int64), sizes)
        self.totals = {}
        for order in (1, 2, 3):
            total = np.zeros(len(self.block.hashes[order]), np.int64)
            if answers[order]:
                total[self.block.by_hash(order)] = np.concatenate([unpack(a) for a in answers[order]]).astype(np.int64)
            self.totals[order] = total
        self.totals[1][1] = ends

    def read(self, tokens: int, distinct: int) -> Read:
        """What scoring needs of the block, with the base scores and known tokens beside it."""
        d, n = Decisions(self.block, self.totals, tokens, self.train), len(self.ids)
        words = np.flatnonzero(self.block.place >= 2)
        text, c = self.block.text[words], self.totals[1][self.block.ids[1][words]]
        base = np.bincount(text, np.log10(c + 1.0) - math.log10(tokens + distinct + 1.0), n)
        known = np.bincount(text, c > 0, n).astype(np.int64)
        return Read(self.ids, self.train, self.n_bytes, self.block.sizes, known, base, d.beside, d.bounds, d.slots, (d.bit > 0).astype(np.uint8), d.unknown, d.spelled, d.spelled_by)


class Read:
    """A block's texts as decisions; all that depends on fitted weights is left open."""

    def __init__(self, ids: list, train: np.ndarray, n_bytes: np.ndarray, sizes: np.ndarray, known: np.ndarray, base: np.ndarray, beside: np.ndarray, bounds: np.ndarray, slots: list[np.ndarray], bit: np.ndarray, unknown: list[bytes], spelled: np.ndarray, spelled_by: np.ndarray) -> None:
        self.ids, self.train, self.n_bytes, self.sizes, self.known, self.base, self.beside = ids, train, n_bytes, sizes, known, base, beside
        self.bounds, self.slots, self.bit, self.unknown, self.spelled, self.spelled_by = bounds, slots, bit, unknown, spelled, spelled_by

    def stored(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        heads = pickle.dumps([self.ids, self.train, self.n_bytes, self.sizes, self.known, self.base, self.beside, self.bounds])
        planes = [squeeze(s.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()) for s in self.slots]
        return pickle.dumps([squeeze(heads), planes, len(self.bit), squeeze(np.packbits(self.bit).tobytes()), squeeze(b"\xff".join(self.unknown)), len(self.unknown), pack(self.spelled), pack(self.spelled_by)])

    @classmethod
    def of(cls, stored: bytes) -> Read:
        heads, planes, n, bit, unknown, many, spelled, spelled_by = pickle.loads(stored)
        grow = zstandard.ZstdDecompressor().decompress
        slots = [np.ascontiguousarray(np.frombuffer(grow(p), np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int32) for p in planes]
        bits = np.unpackbits(np.frombuffer(grow(bit), np.uint8), count=n)
        return cls(*pickle.loads(grow(heads)), slots, bits, grow(unknown).split(b"\xff") if many else [], unpack(spelled).astype(np.int64), unpack(spelled_by).astype(np.int64))

    def counts(self) -> np.ndarray:
        """Zeros and ones of the training texts' decisions by predictor and slot, one predictor after the other."""
        own = np.flatnonzero(np.repeat(self.train, np.diff(self.bounds)))
        bit = self.bit[own]
        return np.concatenate([np.bincount(s[own] * 2 + bit, minlength=2 * n) for s, n in zip(self.slots, Decisions.SLOTS, strict=True)])

    def training_words(self) -> list[bytes]:
        """The words that training texts spell."""
        return [self.unknown[k] for k in np.unique(self.spelled[self.train[self.spelled_by]]).tolist()]


def _blocks(rows, ends: int):
    """Blocks from rows (block, kind, part, a, b) in that order."""
    body = numbers = None
    answers: dict[int, list[bytes]] = {}
    for _, kind, _, a, b in rows:
        if kind == TEXTS:
            if body:
                yield Answered(body, numbers, answers, ends)
            body, numbers, answers = a, b, {1: [], 2: [], 3: []}
        else:
            answers[kind].append(a)
    if body:
        yield Answered(body, numbers, answers, ends)


class Model:
    """What scores a block: sums over the training texts, the speller and the mixer. Bounded by the tables' sizes."""

    def __init__(self, tokens: int, distinct: int, ends: int, speller: Speller, mixer: Mixer) -> None:
        self.tokens, self.distinct, self.ends, self.speller, self.mixer = tokens, distinct, ends, speller, mixer

    def scored(self, r: Read) -> pa.RecordBatch:
        cost = r.beside + self.mixer.cost(r)
        if r.unknown:
            cost += np.bincount(r.spelled_by, self.speller.cost(r.unknown)[r.spelled], len(r.ids))
        columns = [
            pa.array(r.ids, pa.int64()),
            pa.array(r.sizes + 1, pa.int64()),
            pa.array(r.known, pa.int64()),
            pa.array(np.full(len(r.ids), self.tokens), pa.int64()),
            pa.array(r.base, pa.float64()),
            pa.array(-cost / math.log(10), pa.float64()),
            pa.array(cost / math.log(2) / np.maximum(r.n_bytes, 1), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def _bytes(train: DataFrame) -> np.ndarray:
    """How often each byte is in the words of all texts; 0xFF counts the ends of words and texts."""

    def run(batches):
        total, gap = np.zeros(256, np.int64), np.zeros(256, bool)
        gap[list(SPACES)] = True

        def add(texts: list[bytes]) -> None:
            data = np.frombuffer(b"\n".join([b"", *texts]), np.uint8)
            space = gap[data]
            total[:] += np.bincount(data, minlength=256)
            total[END] += len(texts) + np.count_nonzero(space[:-1] & ~space[1:])

        for b in batches:
            held, size = [], 0
            for text in b.column("text").cast(pa.binary()):
                held.append((text.as_py() or b"").lower())
                size += len(held[-1])
                if size > 1 << 20:
                    add(held)
                    held, size = [], 0
            if held:
                add(held)
        total[gap] = 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in train.select("text").mapInArrow(released(run), "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def _summed(rows: DataFrame, column: str, dtype) -> np.ndarray | None:
    """The sum of all rows' arrays of ``dtype``, added up by a few tasks."""

    def run(batches):
        total = None
        for b in batches:
            for data in b.column(column):
                own = np.frombuffer(data.as_py(), dtype)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [column])

    parts = [np.frombuffer(r[column], dtype) for r in rows.select(column).coalesce(8).mapInArrow(released(run), f"{column} binary").collect()]
    return sum(parts[1:], parts[0]) if parts else None


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    """crc32 of the identifier as text; rows without one are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame) -> tuple[DataFrame, int, Model]:
    """The blocks of ``docs`` (doc_id, text, train) as decisions, their number, and the model."""
    spark = docs.sparkSession
    code = Code(_bytes(docs.filter("train")))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets, width = max(8, -(-chars // BUCKET_CHARS)), min(60, max(40, int(chars).bit_length() + SPARE_BITS))
    scratch = Scratch(spark, "lm-scoring")
    answered = scratch.write("answered", _answer(_ask(docs, buckets, width), code, buckets, width))

    sums = answered.filter(F.col("kind") == SUMS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends, blocks = answered.filter(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = sums[0] + ends, sums[1] + (ends > 0)
    tables = [np.zeros(1 << b, np.int8) for b in TABLE_BITS]
    for row in _bits(answered).toLocalIterator():  # as many counts as the tables have slots
        counts, at = unpack(row["a"]).reshape(-1, 2), row["part"] % 1000 * SLICE
        tables[row["part"] // 1000][at : at + len(counts)] = _log_odds(counts[:, 0], counts[:, 1])
    speller = Speller(code, tables)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "part", "a", "b")), strict=True))
        for a in _blocks(rows, ends):
            r = a.read(tokens, distinct)
            del a
            own = [r.stored(), r.counts().astype("<i8").tobytes(), speller.form(r.training_words()).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], ["read", "counts", "spelling"])

    rows = answered.filter(F.col("kind") < BITS).select("block", "kind", "part", "a", "b")
    dealt = rows.repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind", "part")
    read = scratch.write("read", dealt.mapInArrow(released(run), "read binary, counts binary, spelling binary"))
    scratch.drop("answered")
    return read, blocks, fit(read, speller, tokens, distinct, ends)


def score(docs: DataFrame, held: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    The model and the base learn from the rows that ``held`` doesn't hold out; for
    ``score`` a training text is read without its own counts. Null text is empty:
    one end token, and its bits are those of one byte. Rows without an identifier
    are never held out. Rows that repeat identifier and text have equal results,
    as each knows the other; other columns are not read. Without training texts
    all counts are the text's own and unknown words are spelled at even odds.
    ``bits_per_byte`` is the text's total bits over its bytes in UTF-8.
    """
    held = F.lit(False) if held is None else held
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~held).alias("train"))
    read, _, model = learn(docs)

    def run(batches):
        for b in batches:
            for stored in b.column("read"):
                yield model.scored(Read.of(stored.as_py()))

    return read.select("read").mapInArrow(released(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def fit(read: DataFrame, speller: Speller, tokens: int, distinct: int, ends: int) -> Model:
    """Spelling weights from all words that training texts spell, and the mixer from all their decisions."""
    spelling, counts = _summed(read, "spelling", np.float64), _summed(read, "counts", "<i8")
    if spelling is not None:
        form = spelling.reshape(255, len(speller.tables), -1)
        speller = Speller(speller.code, speller.tables, solved(form, speller.weights, PRIOR * LOG_ODDS_STEP**2))
    sizes = 2 * np.array(Decisions.SLOTS)
    split = np.split(np.zeros(sizes.sum(), np.int64) if counts is None else counts, np.cumsum(sizes)[:-1])
    mixer = Mixer([c.reshape(-1, 2) for c in split])

    def run(batches):
        total = np.zeros((*mixer.weights.shape, mixer.weights.shape[1] + 1))
        for b in batches:
            for stored in b.column("read"):
                total += mixer.form(Read.of(stored.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["form"])

    if mixer.without:
        total = sum(np.frombuffer(r["form"]) for r in read.select("read").mapInArrow(released(run), "form binary").collect())  # 3 KB a task
        mixer.weights = solved(total.reshape(*mixer.weights.shape, -1), mixer.weights, PRIOR)
    return Model(tokens, distinct, ends, speller, mixer)
