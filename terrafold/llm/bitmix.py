"""Context mixing over the bits of a code of words and bytes, in numpy.

A text is cut into pieces: a run of letters, digits or bytes over 127, with the
space before it, is one piece, and so is any other byte. Frequent pieces are
symbols of their own; other pieces are spelled in bytes. Symbols (and an end)
are coded by a Huffman code, so frequent ones have few bits.

A bit is predicted from its place in the code tree alone, from two tables at
slots hashed from the place and the last symbol, or (inside a spelled piece) all
of the piece so far, and by a guess at the whole symbol: what most often came
after the same PIECES_BEFORE pieces. The guess speaks for the bits of its own
code, until they differ. The log odds of all are combined by
weights and squashed. Which weights, depends on a gate: how often the two
contexts and the guess have been seen. The mixed log odds are then corrected by a
map over their own size. Each document begins with the same fitted weights and an
empty map; after each block of it, both are refined by the gradient of what the
block cost, so every bit's probability follows from what was before it. Blocks
begin small, so short documents are refined too.
"""

from __future__ import annotations

import heapq

import numpy as np

from .shingles import mixed

HASHED = 2
FEATURES = HASHED + 2
#: Pieces that a guess follows from, and bits of their hash.
PIECES_BEFORE, GUESS_BITS = 3, 44
END = 256
FIRST_PIECE = 257
#: Symbols in a document's blocks: the first, and the largest; each is twice as long as the one before.
BLOCK, LONGEST_BLOCK = 32, 2_048
GATES, GUESS_GATE = 36, 12
RATE, MAP_RATE = 0.003, 0.03
MAP_STEPS, LIMIT = 12, 14.0
#: The tally that first weights are fitted on rounds log odds to this step, up to so many steps to each side: of the tree, of the first table, and of the other table or the guess.
TALLY_STEP, TALLY_SIDES = 0.5, (8, 17, 17)
CELLS = GATES * int(np.prod([2 * s + 1 for s in TALLY_SIDES]))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_MULT = (np.arange(1, 4, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)
_SPELL = np.uint32(0x7FEB352D)
_NODE = np.uint32(0x2545F491)
_SALT = np.array([0x1B873593, 0xCC9E2D51], np.uint32)


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each piece begins and how long it is, and the number of its text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(data):
        none = np.empty(0, np.int64)
        return data, none, none, none
    word = _WORD[data]
    begins = np.ones(len(data), bool)
    begins[1:] = ~(word[1:] & word[:-1])
    bounds = np.cumsum(sizes)
    first = (bounds - sizes)[sizes > 0]
    begins[first] = True
    # a space goes to the word behind it
    joins = np.zeros(len(data), bool)
    joins[1:] = begins[1:] & word[1:] & (data[:-1] == 32)
    joins[first] = False
    begins &= ~joins
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(data)))
    return data, starts, lengths, np.searchsorted(bounds, starts, side="right")


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The powers of _P and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (_P, inverse)]
    return _POWERS


def piece_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each piece's bytes: the sum of each byte plus 1 times a power by its place in the piece, from sums over all bytes so far."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=total[1:], dtype=np.uint64)
    total[1:] *= power[: len(data)]
    np.cumsum(total, out=total)
    return mixed((total[starts + lengths] - total[starts]) * inverse[starts] + lengths.astype(np.uint64))


class Code:
    """A Huffman code for the bytes, the end and the pieces: for each symbol, its tree nodes and the bit taken at each.

    known are the pieces' hashes, in the order of their symbols; counts has a
    number for each symbol. A piece is looked up by its hash's first bits, and one
    whose slot is taken by a more frequent one is spelled.
    """

    SLOT_BITS = 20

    def __init__(self, counts: np.ndarray, known: np.ndarray = np.empty(0, np.uint64)):
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        n = len(heap)
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children.append((a[2], b[2]))
            heapq.heappush(heap, (a[0] + b[0], n + len(children) - 1, n + len(children) - 1))
        self.__setstate__((known, np.array(children, np.int32).reshape(-1, 2)))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces and the tree, from which each process makes its tables."""
        return self.known, self.children

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]):
        self.known, self.children = known, children = state
        slot, first = np.unique(known >> np.uint64(64 - self.SLOT_BITS), return_index=True)
        self.hashes, self.symbols = np.zeros(1 << self.SLOT_BITS, np.uint64), np.zeros(1 << self.SLOT_BITS, np.int32)
        self.hashes[slot.astype(np.int64)], self.symbols[slot.astype(np.int64)] = known[first], first + FIRST_PIECE
        self.nodes = len(children)
        n = self.nodes + 1
        above, side = np.full(n + self.nodes, -1, np.int64), np.zeros(n + self.nodes, np.uint8)
        above[children] = np.arange(self.nodes)[:, None]
        side[children[:, 1]] = 1
        # all symbols go up to the root together
        steps, at = [], np.arange(n)
        while True:
            up = above[at]
            if (up < 0).all():
                break
            steps.append((up, side[at]))
            at = np.where(up < 0, at, up + n)
        self.length = sum(((up >= 0).astype(np.int32) for up, _ in steps), np.zeros(n, np.int32))
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.place, self.bit = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.uint8)
        for k, (up, bit) in enumerate(steps):
            some = np.flatnonzero(up >= 0)
            where = self.start[some] + self.length[some] - 1 - k
            self.place[where], self.bit[where] = up[some], bit[some]
        # the first 52 bits of each symbol's code, as a number
        depth = np.arange(len(self.bit)) - np.repeat(self.start, self.length)
        value = np.where(depth < 52, self.bit.astype(np.float64) * 2.0 ** (51 - np.minimum(depth, 51)), 0)
        self.word = np.add.reduceat(value, self.start).astype(np.int64)

    def with_odds(self, plain: np.ndarray) -> np.ndarray:
        """For all places of the flat tables: twice the node plus the bit, and behind it the node's log odds, to be fetched at once."""
        if getattr(self, "_with", (None,))[0] is not plain:
            out = np.empty((len(self.place), 2), np.uint32)
            out[:, 0] = (self.place.view(np.uint32) << np.uint32(1)) | self.bit
            out[:, 1] = plain.astype(np.float32)[self.place].view(np.uint32)
            self._with = plain, out.view(np.uint64).ravel()
        return self._with[1]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bits the codes of two symbols begin with alike."""
        return np.minimum(52 - np.frexp((self.word[a] ^ self.word[b]).astype(np.float64))[1], self.length[a]).astype(np.int32)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each symbol has, and the places of all bits in the flat tables."""
        n = self.length[symbols]
        before = np.cumsum(n, dtype=np.int32) - n
        return n, np.repeat(self.start[symbols] - before, n) + np.arange(int(n.sum()), dtype=np.int32)

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """What read() and guessed() both begin with: the pieces, their hashes, their slots, and which are symbols."""
        data, starts, lengths, owner = pieces(texts)
        h = piece_hashes(data, starts, lengths)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        return data, starts, lengths, owner, h, slot, (self.hashes[slot] == h) & (lengths > 1)

    def read(self, texts: list[bytes], cut: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, each behind HASHED zeros and before END; where each begins; its symbols with END; and
        for each symbol, how many bytes of its own spelled piece stand before it.
        """
        data, starts, lengths, owner, _, slot, known = self.cut(texts) if cut is None else cut
        per = np.where(known, 1, lengths)
        many = np.bincount(owner, per, len(texts)).astype(np.int64) + 1
        begin = np.cumsum(many + HASHED) - many
        out = np.zeros(int(begin[-1] + many[-1]) if len(texts) else 0, np.int32)
        inside = np.zeros(len(out), np.int32)
        out[begin + many - 1] = END
        # where each piece's first symbol goes: behind what its text has had so far
        upto = np.cumsum(per) - per
        shift = begin - (np.cumsum(many - 1) - (many - 1))
        at = upto + shift[owner]
        out[at[known]] = self.symbols[slot[known]]
        spelled = np.flatnonzero(~known)
        n = lengths[spelled]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        where = np.repeat(at[spelled], n) + offset
        out[where] = data[np.repeat(starts[spelled], n) + offset]
        inside[where] = offset
        return out, begin, many, inside

    def guessed(self, texts: list[bytes], cut: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece and each text's end: a hash of the pieces before it, the symbol that comes, and that symbol's number among the texts' symbols."""
        data, starts, lengths, owner, h, slot, known = self.cut(texts) if cut is None else cut
        count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        # pieces of all texts, each text behind PIECES_BEFORE zeros and before its end
        begin = np.cumsum(count + PIECES_BEFORE + 1) - count - 1
        line = np.zeros(int((count + PIECES_BEFORE + 1).sum()), np.uint64)
        at = np.arange(len(h)) + (begin - (np.cumsum(count) - count))[owner]
        line[at] = h | np.uint64(1)
        total = np.zeros(len(line), np.uint64)
        for k in range(1, PIECES_BEFORE + 1):
            total[k:] += mixed(line[:-k] + np.uint64(k))
        where = np.concatenate([at, begin + count])
        first = np.where(known, self.symbols[slot], data[starts] if len(starts) else 0)
        said = np.concatenate([first, np.full(len(texts), END)]).astype(np.int64)
        per = np.where(known, 1, lengths)
        many = np.bincount(owner, per, len(texts)).astype(np.int64) + 1
        number = np.cumsum(per) - per + owner
        number = np.concatenate([number, np.cumsum(many) - 1])
        return mixed(total[where]) >> np.uint64(64 - GUESS_BITS), said, number


def contexts(symbols: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """For each hashed table, a hash of what stands before each symbol."""
    s = symbols.astype(np.uint32) + np.uint32(1)
    finished = lambda h, k: (((h := (h ^ _SALT[k]) * np.uint32(0x85EBCA6B)) ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35))
    scattered = (s * np.uint32(0x9E3779B1)) ^ (s >> np.uint32(7))
    total, out = np.zeros(len(s), np.uint32), []
    for k in range(1, HASHED + 1):
        total[k:] += scattered[:-k] * _MULT[k - 1]
        out.append(total.copy())
    # inside a spelled piece, the last one is all of the piece so far
    deep = np.flatnonzero(inside)
    if len(deep):
        powers = np.cumprod(np.concatenate([[np.uint32(1)], np.full(int(inside.max()), _SPELL)]).astype(np.uint32))
        term = scattered * powers[inside]
        so_far = np.concatenate([[np.uint32(0)], np.cumsum(term, dtype=np.uint32)])
        out[-1][deep] = so_far[deep] - so_far[deep - inside[deep]] + inside[deep].astype(np.uint32) * np.uint32(0x2C1B3C6D)
    return [finished(x, k) for k, x in enumerate(out)]


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    x = (context ^ node) * np.uint32(0x9E3779B1)
    x >>= np.uint32(32 - bits)
    return x


def count_bits(texts: list[bytes], code: Code, plain: np.ndarray, hashed: np.ndarray) -> None:
    """Adds to plain[bit, node] and hashed[table, bit, slot] what the texts have."""
    if not texts:
        return
    bits = int(hashed.shape[2]).bit_length() - 1
    symbols, starts, many, inside = code.read(texts)
    real = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    said = symbols[real]
    which, n = np.unique(said, return_counts=True)
    per, flat = code.expand(which)
    np.add.at(plain.reshape(-1), code.place[flat] + code.bit[flat].astype(np.int64) * plain.shape[1], np.repeat(n, per).astype(plain.dtype))
    for k, c in enumerate(contexts(symbols, inside)):
        if k == HASHED - 1:  # only inside spelled pieces
            real, said = (x[inside[real] > 0] for x in (real, said))
        key, n = np.unique((c[real].astype(np.uint64) << np.uint64(20)) | said.astype(np.uint64), return_counts=True)
        per, flat = code.expand((key & np.uint64((1 << 20) - 1)).astype(np.int64))
        at = slots(np.repeat((key >> np.uint64(20)).astype(np.uint32), per), code.place[flat].view(np.uint32) * _NODE, bits).astype(np.int64)
        at += code.bit[flat].astype(np.int64) << bits
        np.add.at(hashed[k].reshape(-1), at, np.repeat(n, per).astype(hashed.dtype))


def plain_odds(plain: np.ndarray) -> np.ndarray:
    return np.log((plain[1] + 0.4) / (plain[0] + 0.4)).astype(np.float32)


def squeezed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Both counts in 16 bits; above 255, they keep their ratio."""
    over = np.maximum(np.maximum(n0, n1) / 255.0, 1)
    a, b = np.rint(n0 / over), np.rint(n1 / over)
    # what was seen at all stays seen
    a, b = np.where((n0 > 0) & (a == 0), 1, a), np.where((n1 > 0) & (b == 0), 1, b)
    return (a * 256 + b).astype(np.uint16)


def guess_strength(n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and level of a guess that came n times of ``of``."""
    n = np.maximum(n, 0)
    odds = np.log((n + 0.15) / (np.maximum(of - n, 0) + 0.3)).astype(np.float32)  # large numbers are cut, and may not add up
    return np.where(n > 0, odds, 0).astype(np.float32), np.where(n > 0, 1 + (n > 2), 0).astype(np.uint8)


def _looked_up() -> tuple[np.ndarray, np.ndarray]:
    """Log odds and level (0 never seen, 1 seldom, 2 often) of squeezed counts: as they are, without a 0, without a 1."""
    n0, n1 = (x.ravel().astype(float) for x in np.divmod(np.arange(1 << 16), 256))
    odds, level = [], []
    for less0, less1 in ((0, 0), (1, 0), (0, 1)):
        a, b = np.maximum(n0 - less0, 0), np.maximum(n1 - less1, 0)
        odds.append(np.log((b + 0.06) / (a + 0.06)))
        level.append(np.digitize(a + b, (0.5, 4)))
    return np.concatenate(odds).astype(np.float32), np.concatenate(level).astype(np.uint8)


_ODDS, _LEVEL = _looked_up()
#: What a table's level adds to the gate; outside of spelled pieces, the second one adds nothing.
_GATE = [_LEVEL, (3 * (1 + _LEVEL)).astype(np.uint8)]


def initial_weights() -> np.ndarray:
    w = np.full((GATES, FEATURES), 0.25, np.float32)
    w[0] = (1, 0, 0, 0)
    return w


def _step(x: np.ndarray) -> np.ndarray:
    return ((x + np.float32(LIMIT)) * np.float32(MAP_STEPS / (2 * LIMIT + 1e-3))).astype(np.int32)


def blocks_of(longest: int) -> list[tuple[int, int]]:
    out, at, size = [], 0, BLOCK
    while at < longest:
        out.append((at, size))
        at, size = at + size, min(2 * size, LONGEST_BLOCK)
    return out


def _features(code: Code, plain: np.ndarray, tables: list[np.ndarray], symbols: np.ndarray, inside: np.ndarray, ctx: list[np.ndarray], at: np.ndarray, guesses: tuple | None, mine: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the symbols at ``at``: how many bits each has, and for all bits the sign, the gate and the log odds of all features.

    mine are the symbols' numbers in guesses: the guessed symbol, its log odds and its level.
    """
    said = symbols[at]
    per, flat = code.expand(said)
    both = code.with_odds(plain).take(flat, mode="clip").view(np.uint32)
    node, odds, gate = both[::2], [np.ascontiguousarray(both[1::2]).view(np.float32)], None
    bit = node & np.uint32(1)
    node = (node >> np.uint32(1)) * _NODE
    sign = bit.astype(np.float32)
    sign *= 2
    sign -= 1
    bit += np.uint32(1)
    bit <<= np.uint32(16)
    slot_bits = len(tables[0]).bit_length() - 1
    deep = inside[at] > 0
    some = np.flatnonzero(np.repeat(deep, per))
    for k in range(HASHED):
        last = k == HASHED - 1  # only inside spelled pieces
        x = np.repeat(ctx[k][at[deep]], per[deep]) if last else np.repeat(ctx[k][at], per)
        x ^= node[some] if last else node
        x *= np.uint32(0x9E3779B1)
        x >>= np.uint32(32 - slot_bits)
        seen = tables[k].take(x.view(np.int32), mode="clip")
        if own:
            seen = seen + (bit[some] if last else bit).view(np.int32)
        e, g = _ODDS.take(seen, mode="clip"), _GATE[k].take(seen, mode="clip")
        if last:
            odds.append(np.zeros(len(flat), np.float32))
            odds[-1][some] = e
            gate[some] += g
        else:
            odds.append(e)
            gate = g if gate is None else np.add(gate, g, out=g)
    odds.append(np.zeros(len(flat), np.float32))
    if guesses is not None:
        guess, strength, level = guesses
        speaks = np.flatnonzero(level[mine])
        if len(speaks):  # bits of the symbols that are guessed, up to the first one that is wrong
            its = mine[speaks]
            alike = code.shared(said[speaks], guess[its])
            heard = np.minimum(alike + 1, per[speaks])
            ends = np.cumsum(per)
            depth = np.arange(int(heard.sum())) - np.repeat(np.cumsum(heard) - heard, heard)
            where = np.repeat((ends - per)[speaks], heard) + depth
            odds[-1][where] = np.where(depth < np.repeat(alike, heard), sign[where], -sign[where]) * np.repeat(strength[its], heard)
            gate[where] += np.repeat(level[its], heard) * np.uint8(GUESS_GATE)
    return per, sign, gate, odds


def score_texts(texts: list[bytes], code: Code, plain: np.ndarray, tables: list[np.ndarray], start: np.ndarray, guesses: tuple | None = None, own: bool = False, rate: float = RATE, cut: tuple | None = None) -> np.ndarray:
    """Natural log probability of each text and its end.

    plain are the log odds of the tree's nodes, tables the squeezed counts, and
    guesses, for all symbols of all texts, the guessed symbol, how often it came
    and of how many. With ``own``, the texts are among those counted: every bit
    is predicted without its own occurrence (of guesses, the caller takes it off).
    cut is code.cut(texts), where the caller has it.
    """
    if not texts:
        return np.empty(0)
    symbols, starts, many, inside = code.read(texts, cut)
    ctx = contexts(symbols, inside)
    moved = np.zeros((len(texts), FEATURES), np.float32)  # what a document has added to the weights of all gates
    maps = np.zeros((len(texts), MAP_STEPS), np.float32)
    out = np.zeros(len(texts))
    before = np.cumsum(many) - many
    if guesses is not None:
        guesses = guesses[0], *guess_strength(*guesses[1:])
    for j, size in blocks_of(int(many.max())):
        # those that have more blocks come first: the others need no refining
        alive = np.concatenate([np.flatnonzero(many > j + size), np.flatnonzero((many > j) & (many <= j + size))])
        more = int((many > j + size).sum())
        begin, n = starts[alive] + j, np.minimum(size, many[alive] - j)
        first = np.cumsum(n) - n
        count = np.arange(int(n.sum()))
        at = np.repeat(begin - first, n) + count
        per, sign, gate, odds = _features(code, plain, tables, symbols, inside, ctx, at, guesses, np.repeat(before[alive] + j - first, n) + count, own)
        bits = np.add.reduceat(per, first)
        begins = np.cumsum(bits) - bits
        doc = np.repeat(np.arange(len(alive), dtype=np.int32), bits)
        whose = doc * np.int32(GATES)
        whose += gate
        w = start[None] + moved[alive][:, None]
        x = np.zeros(len(sign), np.float32)
        for k in range(FEATURES):
            t = np.ascontiguousarray(w[:, :, k]).ravel().take(whose, mode="clip")
            t *= odds[k]
            x += t
        np.clip(x, -LIMIT, LIMIT, out=x)
        bucket = _step(x)
        doc *= np.int32(MAP_STEPS)
        bucket += doc
        x += maps[alive].ravel().take(bucket, mode="clip")
        x *= sign
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1  # 1 / probability
        out[alive] -= np.add.reduceat(np.log(x), begins, dtype=np.float64)
        if rate and more:
            alive, bits, begins = alive[:more], bits[:more], begins[:more]
            end = int(bits.sum())
            err = (1 - 1 / x[:end]) * sign[:end]
            trust = np.sqrt(bits + 16.0)
            moved[alive] += (rate * np.stack([np.add.reduceat(err * f[:end], begins) for f in odds], 1) / trust[:, None]).astype(np.float32)
            m = np.bincount(bucket[:end], err, more * MAP_STEPS).reshape(-1, MAP_STEPS)
            maps[alive] += (MAP_RATE * m / trust[:, None]).astype(np.float32)
    return out


def tally(texts: list[bytes], code: Code, plain: np.ndarray, tables: list[np.ndarray], guesses: tuple, cut: tuple | None = None) -> np.ndarray:
    """How many bits of the texts, which are among those counted, fall into each cell: a gate and rounded log odds for the bit that comes.

    Log odds against the bit are negative, so both bits share the cells. Inside of
    spelled pieces nothing is guessed, so one axis serves their table and the guess.
    """
    if not texts:
        return np.zeros(CELLS, np.int64)
    symbols, starts, many, inside = code.read(texts, cut)
    mine = np.arange(int(many.sum()))
    at = np.repeat(starts - (np.cumsum(many) - many), many) + mine
    guesses = guesses[0], *guess_strength(*guesses[1:])
    ctx, heard, deep = contexts(symbols, inside), guesses[2] > 0, inside[at] > 0
    cells = _in_cells(*_features(code, plain, tables, symbols, inside, ctx, at[heard], guesses, mine[heard], True))
    # symbols without a guess that follow the same are alike, and looked up once
    a, b = at[~heard & ~deep], at[~heard & deep]
    one, n_one = np.unique((ctx[0][a].astype(np.uint64) << np.uint64(20)) | symbols[a].astype(np.uint64), return_counts=True)
    two, n_two = np.unique((ctx[1][b].astype(np.uint64) << np.uint64(16)) | (symbols[b - 1] << 8 | symbols[b]).astype(np.uint64), return_counts=True)
    after = contexts(np.arange(257), np.zeros(257, np.int32))[0][1:]  # behind each byte
    said = np.concatenate([one & np.uint64((1 << 20) - 1), two & np.uint64(255)]).astype(np.int32)
    first = np.concatenate([(one >> np.uint64(20)).astype(np.uint32), after[(two >> np.uint64(8)).astype(np.int64) & 255]])
    second = np.concatenate([np.zeros(len(one), np.uint32), (two >> np.uint64(16)).astype(np.uint32)])
    inside = np.repeat(np.array([0, 1], np.int32), (len(one), len(two)))
    at = np.arange(len(said))
    return cells + _in_cells(*_features(code, plain, tables, said, inside, [first, second], at, None, at, True), np.concatenate([n_one, n_two]))


def _in_cells(per: np.ndarray, sign: np.ndarray, gate: np.ndarray, odds: list[np.ndarray], times: np.ndarray | None = None) -> np.ndarray:
    """How many bits of symbols that occur so many times fall into each cell."""
    odds[2] += odds.pop()
    cell = gate.astype(np.int32)
    for f, side in zip(odds, TALLY_SIDES):
        f *= sign
        f *= np.float32(1 / TALLY_STEP)
        f += np.float32(side + 0.5)
        np.clip(f, 0.5, 2 * side + 0.5, out=f)
        cell *= np.int32(2 * side + 1)
        cell += f.astype(np.int32)
    return np.bincount(cell, None if times is None else np.repeat(times, per), CELLS).astype(np.int64)


def fitted_weights(cells: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights with the least cost on the tallied bits."""
    w = initial_weights().astype(np.float64)
    at = np.flatnonzero(cells)
    n, rest, f = cells[at].astype(float), at, []
    for side in TALLY_SIDES[::-1]:
        rest, x = np.divmod(rest, 2 * side + 1)
        f.append((x - side) * TALLY_STEP)
    gate, third = rest, f[0]
    guess = gate >= GUESS_GATE
    f = np.stack([f[2], f[1], np.where(guess, 0, third), np.where(guess, third, 0)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((w[gate] * f).sum(1), -LIMIT, LIMIT)))
        err, bend = n * (1 - p), n * p * (1 - p)
        grad = np.stack([np.bincount(gate, err * x, GATES) for x in f.T], 1)
        hess = np.stack([np.stack([np.bincount(gate, bend * x * y, GATES) for y in f.T], 1) for x in f.T], 1)
        old, w = w, newton_step(w, grad, hess)
        if np.abs(w - old).max() < 1e-5:
            break
    return w.astype(np.float32)


def newton_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray, hold: float = 4.0) -> np.ndarray:
    """Weights after a Newton step on the summed gradient and curvature, held to where they began with the weight ``hold``."""
    grad = grad - hold * (w - initial_weights())
    w = w + np.linalg.solve(hess + hold * np.eye(FEATURES), grad[..., None])[..., 0]
    return np.clip(w, -2, 3)
