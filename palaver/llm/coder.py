"""Adaptive context-mixing range coder for blocks of ids, many blocks at once.

Each block starts from nothing but the list of its distinct ids, which goes before it. Three orders predict an id: the one that
followed the same two ids last time (order 2), the one that followed the same last id (order 1), and the frequencies of the
block's ids that those two didn't give (order 0). An event says which of them gives the id: 0 the prediction of order 2, 1 that of order 1, 2
the distribution of order 0. Two adaptive distributions of events, one by how sure orders 2 and 1 have been, one by the last two events, are
mixed by a weight that follows which of the two gave more to the events so far. Events go to one range coder, the ids of order 0 in turn to ``WAYS`` others,
which all write 16-bit words; carries are settled when a block ends.

Predictions of orders 1 and 2 are learned with every id, distributions and weights after each segment: ``EVENT_STEP`` events,
up to ``ORDER0_STEP`` ids of order 0. So the encoder, which knows all ids, finds predictions and events of a whole
block by sorting, and the decoder's steps stay short: it reads all ids of order 0 before the events. The blocks of a call go in step, one numpy operation for all; that
makes no difference to their bytes. All numbers are whole and below 2 ** 53, most of them in floating point, which is exact there and faster than 64-bit
integers; so encoder and decoder agree on every machine.
"""

from __future__ import annotations

import zlib
from struct import Struct

import numpy as np

#: Digits of the events' shares, of weights, and of order 0's shares.
EVENT_BITS, WEIGHT_BITS, ORDER0_BITS = 12, 4, 12
ONE, ALL, ONE0 = 1 << EVENT_BITS, float(1 << EVENT_BITS + WEIGHT_BITS), 1 << ORDER0_BITS
#: Events, and ids of order 0, between lessons; coders that take these in turn; ids of a block at most: order 0 needs a part for each.
EVENT_STEP, ORDER0_STEP, WAYS, MOST = 128, 512, 4, 4096
CONTEXTS_A, CONTEXTS_B, EVENTS = 32, 9, 3
#: What an event adds to its count, and where counts are halved.
COUNT, LIMIT = 4, 1 << 10
ORDER2_BITS = 11
NONE = 0x3FFF
U16 = np.uint16
STEPS = tuple(np.unique(np.r_[64 << np.arange(3), np.arange(ORDER0_STEP, MOST + 1, ORDER0_STEP)]).tolist())
#: Digits of an event's share, in 256ths: what it costs.
COST = np.rint(256 * (EVENT_BITS - np.log2(np.maximum(1, np.arange(ONE + 1))))).astype(np.int32)
FULL, HALF, WORD = float(1 << 48), float(1 << 32), float(1 << 16)
#: Of a block: bytes of its list, distinct ids, ids of order 0, and words of each coder but the last.
HEAD = Struct(f"<{3 + WAYS}H")


class Events:
    """What blocks learn of events: two distributions and their weight."""

    def __init__(self, lanes: int):
        self.lanes, lane = lanes, np.arange(lanes)
        self.base_a, self.base_b = lane * CONTEXTS_A, lane * CONTEXTS_B
        self.count_a, self.count_b = (np.ones((EVENTS, lanes * n), np.int32) for n in (CONTEXTS_A, CONTEXTS_B))
        self.weight = np.full(lanes, 1 << (WEIGHT_BITS - 1), np.int64)
        self.distributions()

    def distributions(self) -> None:
        """Ends of the first two events' shares by context, as one complex number, each distribution times its weight."""
        self.shares, packed = [], []
        for count, weight in ((self.count_a, self.weight), (self.count_b, (1 << WEIGHT_BITS) - self.weight)):
            scaled = count * ((ONE - EVENTS) // (count[0] + count[1] + count[2])) + 1
            second = scaled[0] + scaled[1]
            self.shares.append((scaled[0], scaled[1], ONE - second))
            both = np.empty((self.lanes, count.shape[1] // self.lanes), np.complex128)
            np.multiply(scaled[0].reshape(both.shape), weight[:, None], out=both.real)
            np.multiply(second.reshape(both.shape), weight[:, None], out=both.imag)
            packed.append(both.ravel())
        self.a, self.b = packed

    def mixed(self, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the first two events' shares."""
        both = self.a.take(ia, mode="clip")
        both += self.b.take(ib, mode="clip")
        return both.real, both.imag

    def learn(self, ia: np.ndarray, ib: np.ndarray, event: np.ndarray) -> None:
        """Contexts and events of a segment, in any order."""
        costs = []
        for count, shares, at, contexts in ((self.count_a, self.shares[0], ia, CONTEXTS_A), (self.count_b, self.shares[1], ib, CONTEXTS_B)):
            seen = np.bincount((event * count.shape[1] + at).ravel(), minlength=count.size).reshape(count.shape).astype(np.int32)
            costs.append(sum(seen[e] * COST.take(shares[e]) for e in range(EVENTS)).reshape(self.lanes, contexts).sum(1))
            count += seen * COUNT
            over = np.flatnonzero(count[0] + count[1] + count[2] > LIMIT)
            count[:, over] = (count[:, over] + 1) >> 1
        self.weight += np.sign(costs[1] - costs[0])
        np.clip(self.weight, 1, (1 << WEIGHT_BITS) - 1, out=self.weight)
        self.distributions()


class Frequencies:
    """What blocks learn of order 0."""

    def __init__(self, sizes: np.ndarray):
        self.lanes, self.most, self.sizes = len(sizes), int(sizes.max()), sizes
        self.base = np.arange(self.lanes) * self.most
        #: 1 where the lane has an id, and occurrences.
        self.have = (np.arange(self.most) < sizes[:, None]).astype(np.int32)
        self.count = np.zeros((self.lanes, self.most), np.int32)
        self.shared()

    def shared(self) -> None:
        """Where each id's share begins, and how large it is, as one complex number."""
        total = self.count.sum(1)
        scale = np.where(total > 0, ((ONE0 - self.sizes) << 12) // np.maximum(1, total), 0)
        share = ((self.count * scale[:, None]) >> 12).astype(np.int32) + self.have
        share[np.arange(self.lanes), self.sizes - 1] += ONE0 - share.sum(1)  # the last id takes what rounding left
        self.share = share.ravel()
        both = np.empty(share.shape, np.complex64)
        both.real, both.imag = np.cumsum(share, axis=1, dtype=np.int32) - share, share
        self.both = both.ravel()

    def learn(self, ids: np.ndarray) -> None:
        """Ids of a segment by their place in the block's list; (lanes, ids)."""
        self.count += np.bincount((self.base[:, None] + ids).ravel(), minlength=self.count.size).reshape(self.count.shape).astype(np.int32)
        self.shared()


class Writer:
    """Range coders that go in step."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.width = np.zeros(lanes), np.full(lanes, FULL - 1)
        self.stride = steps + 3  # no step narrows an interval by more than a word
        self.words = np.zeros(lanes * self.stride, np.uint32)
        self.first = np.arange(lanes) * self.stride
        self.used = self.first.copy()

    def put(self, start: np.ndarray, size: np.ndarray, whole: float) -> None:
        """Narrow the intervals step by step; (steps, lanes), in parts of ``whole``."""
        low, width, words, used = self.low, self.width, self.words, self.used
        for s, z in zip(start, size, strict=True):
            width *= 1 / whole
            np.floor(width, out=width)
            s *= width
            low += s
            width *= z
            narrow = np.flatnonzero(width < HALF)  # few of the lanes
            part, at = low[narrow], used[narrow]
            word = np.floor(part * (1 / HALF))
            words[at] = word
            at += 1
            used[narrow] = at
            width[narrow] *= WORD
            word *= HALF
            part -= word
            part *= WORD
            low[narrow] = part

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """All words (lanes, words) and how many each lane has. Two more words name a place within the interval, whatever follows them."""
        last = (self.low.astype(np.int64) + 0xFFFF) >> 16
        self.words[self.used], self.words[self.used + 1] = last >> 16, last & 0xFFFF
        used = self.used + 2 - self.first
        words = self.words.reshape(len(used), self.stride)[:, : int(used.max())]
        if (words >> 16).any():
            by_place = np.ascontiguousarray(words.T)
            for t in range(len(by_place) - 1, 0, -1):  # carries, from the end of each lane to its beginning
                by_place[t - 1] += by_place[t] >> np.uint32(16)
            words = by_place.T
        return words.astype("<u2"), used


class Reader:
    """The same, from words that each begin at their own place."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words, self.width = words, np.full(len(at), FULL - 1)
        self.code = words[at] * HALF + words[at + 1] * WORD + words[at + 2]
        self.at = at + 3

    def fill(self) -> None:
        narrow = np.flatnonzero(self.width < HALF)  # few of the lanes
        self.width[narrow] *= WORD
        at = self.at[narrow]
        self.code[narrow] = self.code[narrow] * WORD + self.words.take(at, mode="clip")
        at += 1
        self.at[narrow] = at


def _predictions(ids: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of each id: the one that followed its context last time and how often in a row (1 to 3; 0: never seen), as prediction * 4 + times."""
    order = np.argsort(context, kind="stable")
    own, group = ids.take(order), context.take(order)
    other = group[1:] != group[:-1]
    at = np.arange(len(ids), dtype=np.int16)
    missed = at.copy()
    missed[1:] *= other | (own[1:] != own[:-1])
    np.maximum.accumulate(missed, out=missed)
    at -= missed
    np.minimum(at, 2, out=at)
    found = own[:-1] << 2
    found += at[:-1].view(U16)
    found += 1
    first = -other.astype(np.int16)  # all digits set where a context is new
    found &= ~first.view(U16)
    found |= first.view(U16) & U16(NONE << 2)
    out = np.full(len(ids), NONE << 2, U16)
    out[order[1:]] = found
    return out


def _modelled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context by orders 2 and 1, context by the last two events, and event of each id of a block."""
    last, before = np.zeros(len(ids), U16), np.zeros(len(ids), U16)
    last[1:], before[2:] = ids[:-1], ids[:-2]
    e1 = _predictions(ids, last)
    e2 = _predictions(ids, (last * U16(13) + before * U16(601)) & U16((1 << ORDER2_BITS) - 1))
    c1, c2 = e1 >> 2, e2 >> 2
    a = ((e2 & 3) << 3) | ((e1 & 3) << 1) | (c1 == c2)
    no2, no1 = (c2 != ids).view(np.int8), (c1 != ids).view(np.int8)
    event = no2 + (no2 & no1)
    b = np.zeros(len(ids), np.int16)
    b[1:] = event[:-1]
    b[2:] += 3 * event[:-2]
    return a, b, event


def _listed(block: np.ndarray, rank: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """How many distinct ids a block has, its ids by their place among them, and the list as bytes. ``rank`` is scratch space."""
    own, new = np.sort(block, kind="stable"), np.ones(len(block), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    known = own[new].astype(np.int64)
    rank[known] = np.arange(len(known))
    local = rank.take(block)
    gaps = known.copy()
    gaps[1:] -= known[:-1] + 1
    small = np.minimum(gaps, 255).astype(np.uint8).tobytes() + gaps[gaps >= 255].astype("<u4").tobytes()
    deflate = zlib.compressobj(6, zlib.DEFLATED, -12, 7, zlib.Z_HUFFMAN_ONLY)
    return len(known), local, deflate.compress(small) + deflate.flush()


def _unlisted(coded: bytes, size: int) -> np.ndarray:
    try:
        raw = zlib.decompress(coded, -15)
        gaps = np.frombuffer(raw, np.uint8, size).astype(np.int64)
        large = gaps == 255
        gaps[large] = np.frombuffer(raw, "<u4", int(large.sum()), size)
    except (zlib.error, ValueError) as e:
        raise ValueError("a block's list of ids is damaged") from e
    return np.cumsum(gaps + 1) - 1


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block of 16-bit ids; a block holds 1 to ``MOST``."""
    if not blocks:
        return []
    if any(not 0 < len(b) <= MOST for b in blocks):
        raise ValueError(f"a block holds 1 to {MOST} ids")
    n, steps = len(blocks), max(map(len, blocks))
    a, b, event = (np.zeros((n, steps), np.int16) for _ in range(3))
    sizes, heads, given = np.zeros(n, np.int64), [], []
    rank = np.zeros(1 << 16, U16)
    length = np.array([len(x) for x in blocks])
    for k, block in enumerate(blocks):
        sizes[k], local, head = _listed(block, rank)
        heads.append(head)
        own = slice(0, len(block))
        a[k, own], b[k, own], event[k, own] = _modelled(local)
        given.append(local[event[k, own] == 2])

    events, writer, short = Events(n), Writer(n, steps), int(length.min())
    for at in range(0, steps, EVENT_STEP):
        part = slice(at, min(steps, at + EVENT_STEP))
        kind = event[:, part].astype(np.int64)
        ia, ib = events.base_a[:, None] + a[:, part], events.base_b[:, None] + b[:, part]
        ends = np.empty((EVENTS + 1, *kind.shape))
        ends[0], ends[3] = 0, ALL
        ends[1], ends[2] = events.mixed(ia, ib)
        pick = kind * kind.size
        pick += np.arange(kind.size).reshape(kind.shape)
        start = ends.take(pick, mode="clip")
        size = ends[1:].ravel().take(pick, mode="clip")
        size -= start
        if part.stop > short:
            over = np.arange(part.start, part.stop) >= length[:, None]
            start[over], size[over] = 0, ALL
        writer.put(np.ascontiguousarray(start.T), np.ascontiguousarray(size.T), ALL)
        events.learn(ia, ib, kind)
    streams = [writer.close()]

    many = np.array([len(g) for g in given])
    turns = max(1, -(-int(many.max()) // WAYS))
    ids = np.zeros((n, turns * WAYS), U16)
    for k, own in enumerate(given):
        ids[k, : len(own)] = own
    frequencies, writer, at = Frequencies(sizes), Writer(n * WAYS, turns), 0
    while at < turns * WAYS:
        stop = min(turns * WAYS, next((s for s in STEPS if s > at), MOST))
        own = ids[:, at:stop]
        both = frequencies.both.take(frequencies.base[:, None] + own)
        both[np.arange(at, stop) >= many[:, None]] = complex(0, ONE0)
        both = both.reshape(n, -1, WAYS).transpose(1, 0, 2).reshape(-1, n * WAYS)
        writer.put(both.real.astype(np.float64), both.imag.astype(np.float64), float(ONE0))
        frequencies.learn(own)
        at = stop
    words, used = writer.close()
    streams += [(words[k::WAYS], used[k::WAYS]) for k in range(WAYS)]
    out = []
    for k, head in enumerate(heads):
        lengths = [int(u[k]) for _, u in streams]
        out.append(HEAD.pack(len(head), sizes[k], many[k], *lengths[:-1]) + head + b"".join(w[k, :u].tobytes() for (w, _), u in zip(streams, lengths, strict=True)))
    return out


@np.errstate(invalid="ignore", over="ignore", divide="ignore")  # beyond the end of blocks, and in damaged ones
def decode(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    if not coded:
        return []
    known, bodies, many, begins, place = [], [], [], [], 0
    for c, length in zip(coded, lengths, strict=True):
        if len(c) < HEAD.size:
            raise ValueError("a block's head is damaged")
        head, size, own, *used = HEAD.unpack_from(c)
        body = c[HEAD.size + head :]
        if not 0 < size <= length <= MOST or own > length or 2 * sum(used) > len(body):
            raise ValueError("a block's head is damaged")
        known.append(_unlisted(c[HEAD.size : HEAD.size + head], size))
        bodies.append(body[: len(body) // 2 * 2])
        many.append(own)
        begins.append(place + np.cumsum([0, *used]))
        place += len(body) // 2
    n, steps = len(coded), max(lengths)
    sizes = np.array([len(k) for k in known], np.int64)
    words, begin = np.frombuffer(b"".join(bodies) + bytes(8), "<u2"), np.array(begins)
    lane = np.arange(n)

    # the ids of order 0
    turns = max(1, -(-max(many) // WAYS))
    frequencies, reader = Frequencies(sizes), Reader(words, begin[:, 1:].ravel())
    every = np.tile(np.arange(frequencies.most, dtype=U16), n)
    slots, base_slot, base = np.repeat(every, frequencies.share), np.repeat(lane << ORDER0_BITS, WAYS), np.repeat(frequencies.base, WAYS)
    given = np.empty((turns, n, WAYS), U16)
    learned = 0
    for t in range(turns):
        width, code = reader.width, reader.code
        width *= 1 / ONE0
        np.floor(width, out=width)
        # a quotient that isn't whole is off a whole number by 2 ** -36 at least, and both are exact, so its floor is
        inside = (code / width).astype(np.int64)
        inside += base_slot
        mine = slots.take(inside, mode="clip")
        both = frequencies.both.take(base + mine)
        code -= both.real * width
        width *= both.imag
        reader.fill()
        given[t] = mine.reshape(n, WAYS)
        if (t + 1) * WAYS in STEPS:
            frequencies.learn(given[learned : t + 1].transpose(1, 0, 2).reshape(n, -1))
            slots = np.repeat(every, frequencies.share)
            learned = t + 1
    given = given.transpose(1, 0, 2).ravel()
    at_given = lane * (turns * WAYS)

    # the events, and so all ids; order 2 comes first where both orders are rows of one array, and what the events choose from are rows, too
    events, reader = Events(n), Reader(words, begin[:, 0])
    base = np.array([n * frequencies.most + (lane << ORDER2_BITS), frequencies.base])
    table = np.full(n * (frequencies.most + (1 << ORDER2_BITS)), NONE << 2, U16)
    ids = np.zeros((steps, n), U16)
    a, b, event = (np.zeros((EVENT_STEP, n), np.int64) for _ in range(3))
    context, entry, sure = (np.zeros((2, n), U16) for _ in range(3))
    choice, ends, over = np.zeros((3, n), U16), np.zeros((EVENTS + 1, n)), np.zeros((2, n), bool)
    starts, stops, at, pick = ends.ravel(), ends[1:].ravel(), np.zeros((2, n), np.int64), np.zeros(n, np.int64)
    before, history, old = np.zeros(n, U16), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lane_end, mask = (sizes - 1).astype(U16), U16((1 << ORDER2_BITS) - 1)
    width, code = reader.width, reader.code
    for t in range(steps):
        row = t % EVENT_STEP
        now, ia, ib, kind = ids[t], a[row], b[row], event[row]
        np.add(events.base_b, history, out=ib)
        np.add(base, context, out=at)
        table.take(at, out=entry, mode="clip")
        np.right_shift(entry, 2, out=choice[:2])
        np.bitwise_and(entry, 3, out=sure)
        both = sure[0] << 2
        both |= sure[1]
        both <<= 1
        both |= choice[0] == choice[1]
        np.add(events.base_a, both, out=ia)
        first, second = events.mixed(ia, ib)
        width *= 1 / ALL
        np.floor(width, out=width)
        np.multiply(first, width, out=ends[1])
        np.multiply(second, width, out=ends[2])
        np.multiply(width, ALL, out=ends[3])
        np.greater_equal(code, ends[1:3], out=over)
        kind[:] = over[0].view(np.int8) + over[1].view(np.int8)
        np.multiply(kind, n, out=pick)
        pick += lane
        start = starts.take(pick, mode="clip")
        code -= start
        np.subtract(stops.take(pick, mode="clip"), start, out=width)
        reader.fill()
        given.take(at_given, out=choice[2], mode="clip")
        np.minimum(choice.ravel().take(pick, mode="clip"), lane_end, out=now)  # damaged blocks may name what there isn't
        at_given += over[1]
        np.add(old, kind, out=history)
        np.multiply(kind, 3, out=old)
        held = choice[:2] == now
        np.minimum(sure, 2, out=sure)  # one that held is surer by one, 3 at most
        sure *= held
        sure += (now << 2) | 1
        table[at] = sure
        np.multiply(now, U16(13), out=context[0])
        context[0] += before
        context[0] &= mask
        context[1] = now
        np.multiply(now, U16(601), out=before)
        if row == EVENT_STEP - 1:
            events.learn(a, b, event)
    by_lane = np.ascontiguousarray(ids.T)
    return [k[by_lane[i, :length]].astype(U16) for i, (k, length) in enumerate(zip(known, lengths, strict=True))]
