"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

The nondeterministic machine guesses a segmentation: a guess is (last finished token, trie node of the token being read).
A byte moves down the trie; where the node is itself a token that may follow the last one, a guess may also finish it. A
sequence of tokens is the BPE encoding of its bytes exactly if every adjacent pair is (that is, if merging the bytes of
the two by rank ends in just these two), so after each byte exactly one guess has finished a token, and the others are
inside one. A deterministic state is the set of all guesses; it tells the token that the prefix read so far ends with.
States and transitions are made when first needed, every byte goes through them, and the least recently used ones are
forgotten when there are too many. Tokens go out once all guesses descend from the same place: no token is longer than
the longest entry of the vocabulary, so the machine looks ahead a few tokens at most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import held, map_arrow, require

#: Bounds of what a worker remembers; beyond them it forgets what it has not used for longest, or starts anew.
MAX_STATES = 200_000
MAX_PAIRS = 400_000
MAX_MOVES = 200_000
CUT_ROWS = 1_000_000
#: Pieces up to so many bytes run side by side, a byte of each at a time; longer ones one by one.
SIDE_BY_SIDE = 256
#: Bytes of a long piece after which its tokens go out as far as they are settled.
PORTION = 4096


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the leftmost adjacent pair of lowest rank until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def edges(token: bytes, ranks: dict[bytes, int]) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]] | None:
    """What stands at a token's first and last place while it is merged from bytes, each with the rank that ends it.

    None if merging doesn't end in the token, so that no encoding holds it but as a whole piece.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    first, last = [parts[0]], [parts[-1]]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return None
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if i == 0:
            first.append(parts[0])
        if i == len(parts) - 1:
            last.append(parts[-1])
    ends = lambda chain: [(p, ranks[q]) for p, q in zip(chain, chain[1:], strict=False)] + [(chain[-1], float("inf"))]
    return ends(first), ends(last)


class Transducer:
    """Feeds on bytes; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"the vocabulary lacks bytes {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        ends, depth, inner = {}, [0], {0}
        for token, rank in ranks.items():
            node = 0
            for b in token:
                inner.add(node)
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(depth)
                    depth.append(depth[node] + 1)
                node = nxt
            ends[node] = rank
        self.depth = depth
        self.token_at = [ends.get(i, -1) for i in range(len(depth))]
        self.inner = bytearray(i in inner for i in range(len(depth)))
        self.size = np.array([len(b) for b in self.table()], dtype=np.int64)
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.bytes_read = 0  # through transitions
        self.start = (0,)
        self._empty([self.start])

    def table(self) -> list[bytes]:
        """Bytes of each id."""
        return [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=0) + 1)]

    def _empty(self, states: list[tuple[int, ...]]) -> None:
        """Only these states, without transitions. A guess is (last token + 1) << 32 | node; the finished one is the last."""
        self.states = states
        self.number = {s: i for i, s in enumerate(states)}
        self.last = np.zeros(max(1024, 2 * len(states)), np.int32)
        self.last[: len(states)] = [(s[-1] >> 32) - 1 for s in states]
        self.seen = np.zeros(len(self.last), np.int32)  # the round in which a state was last reached
        self.round = 0
        self.moves: dict[int, int] = {}
        self.keys, self.next, self.n_moves = np.full(4096, -1, np.int64), np.zeros(4096, np.int32), 0

    def _edges(self, token: int):
        if token not in self.edges:
            self.edges[token] = edges(self.bytes_of[token], self.ranks)
        return self.edges[token]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether no merge across their border comes before those inside the two tokens (the left one wins ties)."""
        key = last << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            if last < 0 or not self._edges(token):
                return last < 0 and self._edges(token) is not None
            left, right, rank_of = self._edges(last)[1], self._edges(token)[0], self.ranks.get
            i = j = 0
            ok = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = rank_of(x + y)
                if across is not None and across < x_ends and across <= y_ends:
                    ok = False
                    break
                if x_ends <= y_ends:
                    if i + 1 == len(left):
                        break
                    i += 1
                else:
                    j += 1
            self.pairs[key] = ok
        return ok

    def _make(self, state: int, byte: int) -> int:
        """The state that a byte leads to: all guesses moved on; nodes without children have nothing more to read."""
        child, token_at, inner, may_follow, done = self.child, self.token_at, self.inner, self._may_follow, 0
        guesses = []
        for code in self.states[state]:
            nxt = child.get((code & 0xFFFFFFFF) << 8 | byte)
            if nxt is None:
                continue
            if inner[nxt]:
                guesses.append(code >> 32 << 32 | nxt)
            token = token_at[nxt]
            if token >= 0 and not done and may_follow((code >> 32) - 1, token):
                done = token + 1
        guesses.append(done << 32)
        new = tuple(guesses)
        n = self.number.get(new)
        if n is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
            if n == len(self.last):
                self.last, self.seen = np.concatenate([self.last, np.zeros_like(self.last)]), np.concatenate([self.seen, np.zeros_like(self.seen)])
            self.last[n] = done - 1
        return n

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Next states by transition keys (state << 8 | byte); -1 where none is made yet. Open addressing."""
        slot, mask = self._slots(keys), len(self.keys) - 1
        held = self.keys[slot]
        out = np.where(held == keys, self.next[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & mask
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.next[slot[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new transitions."""
        if 2 * (self.n_moves + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.next[old], values])
            size = 1 << (4 * len(keys) - 1).bit_length()
            self.keys, self.next, self.n_moves = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
        self.n_moves += len(keys)
        slot, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one gets it
            got = self.keys[slot] == keys
            self.next[slot[got]] = values[got]
            keys, values, slot = keys[~got], values[~got], (slot[~got] + 1) & mask

    def _forget(self, current: np.ndarray) -> np.ndarray:
        """Keeps the start, ``current`` states and the half of MAX_STATES that were reached last; the new numbers of ``current``."""
        n = len(self.states)
        seen = self.seen[:n].copy()
        seen[0] = seen[current] = self.round + 1
        kept = np.sort(np.argsort(-seen, kind="stable")[: max(MAX_STATES // 2, len(np.unique(current)) + 1)])
        renumber = np.full(n, -1, np.int32)
        renumber[kept] = np.arange(len(kept))
        used = self.keys >= 0
        keys, values, round_, seen = self.keys[used], self.next[used], self.round, self.seen[kept]
        self._empty([self.states[i] for i in kept.tolist()])
        self.round, self.seen[: len(kept)] = round_, seen
        source, target = renumber[keys >> 8], renumber[values]
        on = (source >= 0) & (target >= 0)
        self._insert(source[on].astype(np.int64) << 8 | keys[on] & 0xFF, target[on])
        return renumber[current].astype(np.int64)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        return self.encode_all([piece])[0].tolist()

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the split pattern, one after the other, and how many each has.

        A piece that is a token is that; all others go through the transitions.
        """
        rank_of = self.ranks.get
        direct = np.fromiter((rank_of(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        rest = np.flatnonzero((direct < 0) & (length > 0))
        short, long = rest[length[rest] <= SIDE_BY_SIDE], rest[length[rest] > SIDE_BY_SIDE]
        short = short[np.argsort(-length[short], kind="stable")]
        back, at = self._side_by_side([pieces[i] for i in short.tolist()], length[short])
        size = (direct >= 0).astype(np.int64)
        size[short] = np.bincount(at, minlength=len(short)) if len(short) else 0
        alone = [np.fromiter(self.tokens(pieces[i]), dtype=np.int64) for i in long.tolist()]
        size[long] = [len(x) for x in alone]
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[(ends - size)[direct >= 0]] = direct[direct >= 0]
        for i, x in zip(long.tolist(), alone, strict=True):
            out[ends[i] - size[i] : ends[i]] = x
        # tokens of the short ones were found from their ends
        order = np.argsort(at, kind="stable")
        first = np.cumsum(size[short]) - size[short]
        out[ends[short][at[order]] - 1 - (np.arange(len(order)) - first[at[order]])] = back[order]
        return out, size

    def _side_by_side(self, pieces: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pieces in order of falling length: their tokens, each piece's from its end on, and whose each is."""
        if not pieces:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        start = np.cumsum(length) - length
        ends_with = np.empty(len(data), np.int32)
        state = np.zeros(len(pieces), np.int64)
        self.round += 1
        self.bytes_read += len(data)
        for k in range(int(length[0])):
            on = int(np.searchsorted(-length, -k, side="left"))  # pieces longer than k
            keys = state[:on] << 8 | data[start[:on] + k]
            nxt = self._find(keys)
            missing = np.flatnonzero(nxt < 0)
            if missing.size:
                new, which = np.unique(keys[missing], return_inverse=True)
                made = np.fromiter((self._make(x >> 8, x & 0xFF) for x in new.tolist()), dtype=np.int32, count=len(new))
                self._insert(new, made)
                nxt[missing] = made[which]
            state[:on] = nxt
            self.seen[nxt] = self.round
            ends_with[start[:on] + k] = self.last[nxt]
            if len(self.states) > 2 * MAX_STATES:
                state[:on] = self._forget(state[:on])
        if len(self.states) > MAX_STATES:
            self._forget(np.zeros(1, np.int64))
        tokens, whose = [], []
        at, who = start + length - 1, np.arange(len(pieces))
        while who.size:
            token = ends_with[at]
            tokens.append(token)
            whose.append(who)
            at = at - self.size[token]
            left = at >= start[who]
            at, who = at[left], who[left]
        return np.concatenate(tokens).astype(np.int64), np.concatenate(whose)

    def tokens(self, piece: bytes, portion: int = PORTION) -> Iterator[int]:
        """Ids of one piece as they become certain, asked after every ``portion`` of bytes."""
        state, moves, begun = 0, self.moves, 0  # ``begun``: bytes whose tokens went out
        ends_with: list[int] = []  # by byte since then, the token that the prefix ends with
        size = self.size
        self.bytes_read += len(piece)
        for lo in range(0, len(piece), portion):
            for b in piece[lo : lo + portion]:
                nxt = moves.get(state << 8 | b)
                if nxt is None:
                    nxt = moves[state << 8 | b] = self._make(state, b)
                state = nxt
                ends_with.append(int(self.last[state]))
            read = min(len(piece), lo + portion)
            if len(self.states) > MAX_STATES:
                self.round += 1
                state = int(self._forget(np.array([state]))[0])
                moves = self.moves
            elif len(moves) > MAX_MOVES:
                moves.clear()
            # every guess began somewhere; tokens before the place that all of them come from are settled
            places = {read - begun - self.depth[code & 0xFFFFFFFF] for code in self.states[state]} if read < len(piece) else {read - begun}
            while len(places) > 1:
                latest = max(places)
                places.remove(latest)
                places.add(latest - int(size[ends_with[latest - 1]]))
            settled = at = places.pop()
            out = []
            while at > 0:
                out.append(ends_with[at - 1])
                at -= int(size[out[-1]])
            yield from reversed(out)
            del ends_with[:settled]
            begun += settled


class CutTable:
    """Encodings of parts of text met so far, in a few arrays: about 30 bytes a part.

    A part is looked up by a 64-bit hash of its bytes, and what is found counts only if its tokens' bytes are the
    part's, so a collision costs time, not correctness. When ``rows`` parts are held the table starts anew.
    """

    LONGEST = 48

    def __init__(self, token_bytes: list[bytes], rows: int) -> None:
        self.rows = rows
        self.token_size = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_flat = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.odd = np.random.default_rng(1).integers(1 << 62, 1 << 63, self.LONGEST, dtype=np.uint64) | np.uint64(1)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.row = np.empty(0, np.int32)
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One per part; of parts that are not longer than LONGEST."""
        size = np.diff(offsets)
        place = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)
        each = (data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)) * self.odd[np.minimum(place, self.LONGEST - 1)]
        out = np.add.reduceat(each, offsets[:-1] - offsets[0]) if len(size) else np.empty(0, np.uint64)
        return out ^ (out >> np.uint64(29))

    def find(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row of each part (it stands for the part with a blank before it), or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        row = self.row[at[hit]].astype(np.int64)
        size = self.size[row].astype(np.int64)
        ids = ragged(self.ids, self.start[row], size, slice(None))
        length = np.add.reduceat(self.token_size[ids], np.cumsum(size) - size) if len(row) else size
        want = np.diff(offsets)[hit] + 1
        fits = length == want
        hit, row, size, want = hit[fits], row[fits], size[fits], want[fits]
        ids = ragged(self.ids, self.start[row], size, slice(None))
        have = ragged(self.token_flat, self.token_start, self.token_size, ids)
        begin = np.cumsum(want) - want
        text = np.full(int(want.sum()), 0x20, dtype=np.uint8)
        inner = np.ones(len(text), dtype=bool)
        inner[begin] = False
        text[inner] = ragged(data, offsets[:-1][hit].astype(np.int64), want - 1, slice(None))
        same = np.logical_and.reduceat(have == text, begin) if len(hit) else np.empty(0, bool)
        out[hit[same]] = row[same]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if len(self.start) + len(keys) > self.rows:
            self._empty()
        first = len(self.start)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        every, row = np.concatenate([self.keys, keys]), np.concatenate([self.row, np.arange(first, first + len(keys), dtype=np.int32)])
        order = np.argsort(every, kind="stable")
        self.keys, self.row = every[order], row[order]


#: A blank that white space or the end follows; such texts are matched against the pattern as a whole.
GAP = r" ([\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|$)"
#: Ids of some strings, one after the other, and how many each has.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Splitter:
    """Cuts texts at blanks and joins the encodings of the cuts.

    Every blank that a non-blank follows starts a match of the tokenizer's pattern, so texts without other blanks are cut
    there, and distinct cuts are encoded once and remembered in a bounded table. ``cuts`` encodes parts that a blank
    stands before, ``others`` beginnings of texts, and texts that are not cut: those with other blanks, and those that
    ``special`` (a regular expression) finds something in.
    """

    def __init__(self, token_bytes: list[bytes], cuts: Encoder, others: Encoder, special: str | None = None, rows: int | None = None) -> None:
        self.encode_cuts, self.encode_others, self.special = cuts, others, special
        self.table = CutTable(token_bytes, rows or CUT_ROWS)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one after the other, and where each text's ids begin (and the last end)."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, GAP)
        if self.special:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        flat_cuts = lists.flatten()
        first -= first[0]
        starts = flat_cuts.take(pa.array(first)).to_pylist()
        cuts = flat_cuts.dictionary_encode()
        at = cuts.indices.to_numpy().astype(np.int64)
        used = np.ones(len(at), dtype=bool)
        used[first] = False  # no blank stands before a text's first cut
        seen = np.bincount(at[used], minlength=len(cuts.dictionary)) > 0
        at = (np.cumsum(seen) - 1)[at]
        distinct = cuts.dictionary.filter(pa.array(seen))
        del lists, flat_cuts, cuts, used, seen
        known = len(distinct)
        offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int32, count=known + 1, offset=4 * distinct.offset) if known else np.zeros(1, np.int32)
        data = np.frombuffer(distinct.buffers()[2], dtype=np.uint8) if known and distinct.buffers()[2] is not None else np.empty(0, np.uint8)
        keys = self.table.hashes(data, offsets)
        row = self.table.find(keys, data, offsets)
        new = np.flatnonzero(row < 0)
        fresh, fresh_size = self.encode_cuts(distinct.take(pa.array(new)).to_pylist()) if len(new) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        head = texts.to_pylist() if pc.any(odd).as_py() else None
        rest, rest_size = self.encode_others([head[i] if head and o else s for i, (s, o) in enumerate(zip(starts, odd.to_pylist(), strict=True))])
        fresh, fresh_size = np.concatenate([fresh, rest]), np.concatenate([fresh_size, rest_size])
        fresh_start = np.cumsum(fresh_size) - fresh_size
        # encodings of the known cuts, then of the new ones, then of the texts' beginnings
        old = np.flatnonzero(row >= 0)
        size = np.empty(known + n, np.int64)
        size[old], size[new], size[known:] = self.table.size[row[old]], fresh_size[: len(new)], fresh_size[len(new) :]
        found = ragged(self.table.ids, self.table.start[row[old]], size[old], slice(None))
        flat = np.concatenate([found, fresh])
        start = np.empty(known + n, np.int64)
        start[old], start[new], start[known:] = np.cumsum(size[old]) - size[old], fresh_start[: len(new)] + len(found), fresh_start[len(new) :] + len(found)
        at[first] = known + np.arange(n)
        each = size[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = ragged(flat, start, size, at), np.concatenate([ends[first], ends[-1:]])
        short = np.diff(offsets)[new] <= self.table.LONGEST if len(new) else np.empty(0, bool)
        kept = np.flatnonzero(short)
        self.table.add(keys[new][kept], ragged(fresh, fresh_start, fresh_size, kept), fresh_size[kept])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for each i of ``at`` (a slice takes all), one after the other."""
    each = size[at]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(start[at] - (ends - each), each)
    index += np.arange(total)
    return flat[index]


class Utf8Stream:
    """Incremental UTF-8: ids come in any portions, complete characters go out, an unfinished one waits.

    A token moves the machine from (bytes still missing, allowed range of the next byte) to another such state; the
    moves of tokens are remembered. Malformed bytes become U+FFFD, as Python's ``errors="replace"`` has it.
    """

    START = (0, 0x80, 0xBF)

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.table = token_bytes
        self.size = np.array([len(b) for b in self.table], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.table), dtype=np.uint8)
        self.complete = np.array([self._run(self.START, b) == self.START for b in self.table], dtype=bool)
        self.known: dict[tuple[tuple[int, int, int], int], tuple[int, int, int] | None] = {}
        self.state: tuple[int, int, int] | None = self.START
        self.bad = False
        self.tail = b""

    @classmethod
    def _run(cls, state: tuple[int, int, int], data: bytes) -> tuple[int, int, int] | None:
        missing, lo, hi = state
        for b in data:
            if missing:
                if not lo <= b <= hi:
                    return None
                missing, lo, hi = missing - 1, 0x80, 0xBF
            elif b >= 0x80:
                if 0xC2 <= b <= 0xDF:
                    missing = 1
                elif 0xE0 <= b <= 0xEF:
                    missing, lo, hi = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
                elif 0xF0 <= b <= 0xF4:
                    missing, lo, hi = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
                else:
                    return None
        return missing, lo, hi

    def feed(self, ids: np.ndarray) -> bytes:
        """Bytes of the characters that are complete now."""
        data = self.tail + ragged(self.flat, self.start, self.size, ids).tobytes()
        if not self.bad and not (self.state == self.START and self.complete[ids].all()):
            for i in ids.tolist():
                key = (self.state, i)
                if key not in self.known:
                    self.known[key] = self._run(self.state, self.table[i])
                self.state = self.known[key]
                if self.state is None:
                    self.bad = True
                    break
        if self.bad:
            self.tail = data
            return b""
        keep = 0
        if self.state[0]:
            while keep < 3 and keep < len(data):
                keep += 1
                if data[-keep] >= 0xC0:
                    break
        self.tail = data[len(data) - keep :]
        return data[: len(data) - keep]

    def close(self) -> bytes:
        """What is left; malformed or unfinished bytes as U+FFFD. The machine is ready for the next document."""
        rest = self.tail.decode("utf-8", "replace").encode() if self.tail else b""
        self.state, self.bad, self.tail = self.START, False, b""
        return rest


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.machine = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.splitter = Splitter(self.machine.table(), self._cuts, self._others)
        self.stream = Utf8Stream(self.machine.table())

    def _cuts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Matches of the pattern in a text made of all parts end where the parts do."""
        pieces = self.find(" " + " ".join(words))
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        borders = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        return self._joined(pieces, np.searchsorted(ends, borders) + 1)

    def _others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, ends = [], []
        for text in texts:
            pieces += self.find(text)
            ends.append(len(pieces))
        return self._joined(pieces, np.array(ends, dtype=np.int64))

    def _joined(self, pieces: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, distinct ones encoded once, and how many there are up to each end."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        ids, size = self.machine.encode_all(coded.dictionary.cast(pa.binary()).to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size[at])])
        return ragged(ids, np.cumsum(size) - size, size, at), np.diff(total[np.concatenate([[0], ends])])

    def encode(self, text: str | None) -> np.ndarray:
        return self.splitter.encode(text)

    def decode(self, ids: np.ndarray, portion: int = 1 << 16) -> bytes:
        parts = [self.stream.feed(ids[i : i + portion]) for i in range(0, len(ids), portion)]
        return b"".join([*parts, self.stream.close()])


#: Bytes of text encoded at a time: distinct cuts are encoded once a slice.
ENCODE_BYTES = 3 << 19


def worker_codec(ranks: bytes, pattern: str) -> Codec:
    """The codec that this worker's tasks share."""

    return held("bpe", (hashlib.sha256(ranks).digest(), pattern), lambda: Codec(parse_ranks(ranks), pattern))


def list_array(ids: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """list<int32> from all ids and where each list begins; no id becomes a Python object."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, check: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary, from the ids alone) of every row.

    With ``check``, same_text instead of decoded: whether decoding gave the text's bytes. Narrow: no shuffle. The
    vocabulary file (under 1 MB) is read once on the driver and broadcast. A null text counts as empty: no ids, empty
    bytes. Texts of any length are encoded whole; repeated rows and null ids stay; an empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    require(docs, "doc_id", "text")
    with open(ranks_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    last = "same_text" if check else "decoded"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data.value, pattern)
        for batch in batches:
            texts = batch.column("text")
            ids, starts = codec.splitter.encode_many(texts)
            decoded: list = [codec.decode(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            if check:
                decoded = [d == (t or b"") for d, t in zip(decoded, texts.cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), list_array(ids, starts), pa.array(decoded, pa.bool_() if check else pa.binary())], ["doc_id", "ids", last]
            )

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id bigint, ids array<int>, {last} {'boolean' if check else 'binary'}", keep="bpe", limit=ENCODE_BYTES)
