"""A minimal acyclic transducer over byte strings with lists of ids as outputs.

States are built from sorted words; states with the same suffix language are shared. An
arc's output is the number of words before it, so the outputs along a word's path add up
to the word's index, at which its ids are stored. The arrays lie in one file and are
mapped into memory; many words are looked up at once, a byte of all of them at a time.
"""

from __future__ import annotations

import numpy as np

_MAGIC = 0x46464C58


class Transducer:
    def __init__(self, arc_key, arc_to, arc_add, final, offsets, ids) -> None:
        self.arc_key, self.arc_to, self.arc_add, self.final, self.offsets, self.ids = arc_key, arc_to, arc_add, final, offsets, ids

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> "Transducer":
        order = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        size: list[int] = []  # words below each finished state
        arcs_of: list[list[tuple[int, int]]] = []
        final: list[bool] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            found = register.get(key)
            if found is None:
                found = register[key] = len(arcs_of)
                arcs_of.append(node[1])
                final.append(node[0])
                size.append(int(node[0]) + sum(size[t] for _, t in node[1]))
            return found

        path: list[list] = [[False, []]]
        last = b""
        for w in order:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                done = freeze(path.pop())
                path[-1][1].append((last[depth - 1], done))
            for _ in w[same:]:
                path.append([False, []])
            path[-1][0] = True
            last = w
        for depth in range(len(last), 0, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[depth - 1], done))
        root = freeze(path.pop())
        # the root gets number 0
        number = {root: 0}
        for s in range(len(arcs_of)):
            number.setdefault(s, len(number))
        rows = []
        for s, arcs in enumerate(arcs_of):
            before = int(final[s])
            for byte, to in arcs:
                rows.append((number[s] << 8 | byte, number[to], before))
                before += size[to]
        rows.sort()
        flags = np.zeros(len(arcs_of), np.uint8)
        for s, n in number.items():
            flags[n] = final[s]
        lists = [words[w] for w in order]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        table = np.array(rows, np.int64).reshape(-1, 3)
        return cls(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), flags, offsets, np.array([i for x in lists for i in x], np.int32))

    def dump(self) -> bytes:
        parts = [self.arc_key, self.arc_to, self.arc_add, self.final, self.offsets, self.ids]
        return np.concatenate([np.array([_MAGIC, *(len(p) for p in parts)], np.int64), *(p.astype(np.int64) for p in parts)]).tobytes()

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.dump())

    @classmethod
    def open(cls, path: str) -> "Transducer":
        m = np.memmap(path, np.int64, "r")
        if m[0] != _MAGIC:
            raise ValueError(f"{path} holds no transducer")
        at, parts = 7, []
        for n in m[1:7].tolist():
            parts.append(m[at : at + n])
            at += n
        return cls(*parts)

    def index(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for words that are not held."""
        n = len(words)
        if not n or not len(self.arc_key):
            return np.full(n, -1, np.int64)
        lens = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        begin = np.cumsum(lens) - lens
        state, add = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(lens > 0)
        state[lens == 0] = -1
        step = 0
        while len(live):
            want = state[live] << 8 | data[begin[live] + step].astype(np.int64)
            arc = np.minimum(np.searchsorted(self.arc_key, want), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == want
            state[live[~hit]] = -1
            arc, live = arc[hit], live[hit]
            state[live] = self.arc_to[arc]
            add[live] += self.arc_add[arc]
            step += 1
            live = live[lens[live] > step]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] != 0), add, -1)

    def lookup(self, words: list[bytes]) -> list[list[int] | None]:
        out: list[list[int] | None] = []
        for i in self.index(words).tolist():
            out.append(None if i < 0 else self.ids[self.offsets[i] : self.offsets[i + 1]].tolist())
        return out
