"""A BPE tokenizer with word ends, compiled into a deterministic transducer.

State after a prefix of a word: for every position ``p`` whose rest is still the
beginning of a vocabulary entry, that rest, the last token of the tokenization
that ends at ``p``, and how many tokens that one has more than the whole prefix.
The last token of a longer prefix is the one entry that is compatible with the
token before it (two tokens are compatible if the merges leave them apart), so
each byte leads to exactly one next state and changes the count by a known
number.  States and transitions are made when a text first needs them and kept
in dense arrays; transitions carry the change of the token count, and a state
carries the change that the end of the word makes.

Chunks of text run side by side, one array operation a byte for all of them.
What a chunk does to the state it is entered in depends on that state only up to
its first word boundary.  ``count`` runs the parts behind the boundaries first
and then replays the heads from left to right (no state map is made): a chunk
with a boundary hands a known state on, so all chunks after such chunks are
resolved at once, and chunks inside one long word follow in turn.
"""

from __future__ import annotations

import json

import numpy as np

GAP = 512  # code of what lies between words; 256 + byte begins a word
LANE = 256
FEW = 24


class Transducer:
    """``limit`` bounds the kept states; beyond it, only states in use are kept and the others are made again."""

    def __init__(self, path: str, limit: int = 240_000):
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        vocab = model["vocab"]
        self.inner = {t for t in vocab if not (suffix and t.endswith(suffix))}
        self.final = {t[: -len(suffix)] for t in vocab if suffix and t.endswith(suffix)} if suffix else self.inner
        begin = {t[:k] for t in self.inner for k in range(1, len(t))}
        self.begin = begin | {t[:k] for t in self.final for k in range(1, len(t) + 1)}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = iter(range(256, 512))
        self.chars = [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]
        self.pairs: dict[tuple, bool] = {}
        self.limit = limit
        self._reset([(("", None, 0),)])

    def _reset(self, keep: list[tuple]) -> None:
        self.states = {s: i for i, s in enumerate(keep)}
        self.listed = list(keep)
        self.column = np.full(256, -1, np.int32)
        self.columns = 0
        #: next state * 128 + change of the count + 64, or -1
        self.next = np.full((max(1024, 2 * len(keep)), 64), -1, np.int32)
        self.end = np.zeros(len(self.next), np.int8)
        self.entries: dict[tuple, tuple] = {}
        for i, s in enumerate(keep):
            self.end[i] = self._end(s)

    # -- merges
    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 30:
                break
            symbols[at: at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _fits(self, before: str | None, token: str, final: bool) -> bool:
        key = (before, token, final)
        ok = self.pairs.get(key)
        if ok is None:
            symbols = list((before or "") + token)
            whole = token
            if final and self.suffix:
                symbols[-1] += self.suffix
                whole += self.suffix
            ok = self._merge(symbols) == ([whole] if before is None else [before, whole])
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    # -- states
    def _end(self, state: tuple) -> int:
        for rest, token, rel in state:
            if rest and rest in self.final and self._fits(token, rest, True):
                return rel + 1
        return 0  # the start: no word is open

    def _id(self, state: tuple) -> int:
        i = self.states.get(state)
        if i is None:
            i = self.states[state] = len(self.listed)
            self.listed.append(state)
            if i >= len(self.end):
                more = max(1024, len(self.end) // 2)
                self.next = np.concatenate([self.next, np.full((more, self.next.shape[1]), -1, np.int32)])
                self.end = np.concatenate([self.end, np.zeros(more, np.int8)])
            self.end[i] = self._end(state)
        return i

    def _step(self, i: int, byte: int) -> None:
        state, c = self.listed[i], self.chars[byte]
        for rest, token, rel in state:
            if rest + c in self.inner and self._fits(token, rest + c, False):
                delta, last = rel + 1, rest + c
                break
        else:
            raise ValueError(f"no token ends with {c!r} after {state!r}")
        after = [(r + c, t, k - delta) for r, t, k in state if r + c in self.begin] + [("", last, 0)]
        j = self._id(tuple(self.entries.setdefault(e, e) for e in after))
        self.next[i, self.column[byte]] = j * 128 + delta + 64

    def _columns(self, used: np.ndarray) -> None:
        for b in used:
            if self.column[b] < 0:
                if self.columns == self.next.shape[1]:
                    self.next = np.concatenate([self.next, np.full((len(self.next), 32), -1, np.int32)], 1)
                self.column[b] = self.columns
                self.columns += 1

    def _move(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count for states and bytes side by side."""
        col = self.column[byte]
        wide = self.next.shape[1]
        at = state.astype(np.int64) * wide + col
        to = self.next.ravel()[at]
        new = np.flatnonzero(to < 0)
        if len(new):
            for k in np.unique(state[new].astype(np.int64) * 256 + byte[new]):
                self._step(int(k >> 8), int(k & 255))
            to = self.next.ravel()[at]
        return to >> 7, ((to & 127) - 64).astype(np.int8)

    def _trim(self, state: np.ndarray) -> np.ndarray:
        """Drop all states but the start and those given; returns the given ones by their new numbers."""
        if len(self.listed) <= self.limit:
            return state
        live, back = np.unique(np.append(state, 0), return_inverse=True)
        used = np.flatnonzero(self.column >= 0)
        self._reset([self.listed[i] for i in live])
        self._columns(used)
        return back[:-1].astype(state.dtype)

    # -- running
    def count(self, codes: np.ndarray) -> np.ndarray:
        """Change of the token count at each code; the codes end with ``GAP``.

        A code is a byte inside a word, 256 + a byte that begins one, or ``GAP``.
        """
        n = len(codes)
        lanes = -(-n // LANE)
        grid = np.full(lanes * LANE, GAP, np.int16)
        grid[:n] = codes
        grid = grid.reshape(lanes, LANE)
        self._columns(np.unique(grid[grid < GAP] & 255))
        fixed = grid >= 256
        head = np.where(fixed.any(1), fixed.argmax(1), LANE)
        out = np.zeros((LANE, lanes), np.int8)
        state = np.zeros(lanes, np.int32)
        steps = np.ascontiguousarray(grid.T)
        for k in range(LANE):  # what follows the first boundary of each chunk
            c = steps[k]
            on = np.flatnonzero((head <= k) & (c != GAP))
            first = head == k
            closes = np.flatnonzero((c >= 256) & ~first)
            out[k, closes] = self.end[state[closes]]
            b = (c[on] & 255).astype(np.int32)
            state[c >= 256] = 0
            if len(on):
                to, delta = self._move(state[on], b)
                state[on] = to
                out[k, on] += delta
            if len(self.listed) > self.limit:
                state = self._trim(state)
        # the heads: each chunk's map is applied to the state that the chunk before it leaves
        known = head < LANE
        entry = np.zeros(lanes, np.int32)
        open_ = np.flatnonzero(np.arange(lanes) >= 0)
        done = np.zeros(lanes, bool)
        while len(open_):
            ready = open_[(open_ == 0) | known[open_ - 1]]
            entry[ready] = np.where(ready > 0, state[ready - 1], 0)
            if len(ready) < FEW:
                for lane in ready.tolist():
                    self._head_alone(lane, grid, head, entry, state, out)
            else:
                self._heads(ready, steps, head, entry, state, out)
            known[ready] = done[ready] = True
            open_ = open_[~done[open_]]
            if len(self.listed) > self.limit:
                both = self._trim(np.concatenate([state, entry]))
                state, entry = both[:lanes].copy(), both[lanes:].copy()
        return out.T.ravel()[:n]

    def _heads(self, ready, steps, head, entry, state, out) -> None:
        now = entry[ready].copy()
        size = head[ready]
        for k in range(int(size.max()) + 1):
            if k < LANE:
                on = np.flatnonzero(size > k)
                if len(on):
                    to, delta = self._move(now[on], steps[k, ready[on]].astype(np.int32))
                    now[on] = to
                    out[k, ready[on]] += delta
                shut = np.flatnonzero(size == k)
                out[k, ready[shut]] += self.end[now[shut]]
        whole = size == LANE
        state[ready[whole]] = now[whole]

    def _head_alone(self, lane, grid, head, entry, state, out) -> None:
        now = int(entry[lane])
        for k in range(int(head[lane])):
            b = int(grid[lane, k])
            col = self.column[b]
            if self.next[now, col] < 0:
                self._step(now, b)
            to = int(self.next[now, col])
            out[k, lane] += (to & 127) - 64
            now = to >> 7
        if head[lane] < LANE:
            out[head[lane], lane] += self.end[now]
        else:
            state[lane] = now
