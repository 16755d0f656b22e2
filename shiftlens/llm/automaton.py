"""A minimal acyclic transducer from byte strings to sequences of ids, laid out as flat arrays that can be memory-mapped.

States that accept the same suffixes with the same outputs are one state. Outputs stand as far to the front as the words that share an arc agree on
them, which makes the transducer canonical and lets suffixes of many words be shared. Words are looked up side by side, a byte a step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_TYPES = {"keys": np.int64, "target": np.int32, "out_at": np.int32, "out_n": np.int32, "final_at": np.int32, "final_n": np.int32, "pool": np.int32}
_WORD = 8


class _State:
    __slots__ = ("arcs", "final", "rest")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte: [state, output]
        self.final = False
        self.rest: tuple = ()  # output at the end of a word

    def name(self) -> tuple:
        return (self.final, self.rest, tuple((b, id(to), out) for b, (to, out) in self.arcs.items()))


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905  the shorter one ends it
        if x != y:
            break
        n += 1
    return n


def _minimal(words: Iterable[tuple[bytes, tuple]]) -> _State:
    """The start state of the minimal transducer of distinct words, given in byte order. States off the current word's path are final in form and registered."""
    register: dict[tuple, _State] = {}
    path, before = [_State()], b""

    def close(upto: int):
        while len(path) - 1 > upto:
            state = path.pop()
            path[-1].arcs[before[len(path) - 1]][0] = register.setdefault(state.name(), state)

    for word, out in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        close(shared)
        # What the new word doesn't share of the outputs on the way moves behind.
        for k in range(shared):
            arc = path[k].arcs[word[k]]
            n = _common(arc[1], out)
            moved, arc[1], out = arc[1][n:], out[:n], out[n:]
            if moved:
                for later in path[k + 1].arcs.values():
                    later[1] = moved + later[1]
                if path[k + 1].final:
                    path[k + 1].rest = moved + path[k + 1].rest
        for k in range(shared, len(word)):
            path.append(_State())
            path[k].arcs[word[k]] = [path[k + 1], ()]
        path[-1].final = True
        if shared < len(word):
            path[shared].arcs[word[shared]][1] = out
        else:
            path[-1].rest = out
        before = word
    close(0)
    return path[0]


def compile_words(words: Iterable[tuple[bytes, tuple]]) -> bytes:
    """The transducer of distinct words with their ids, as one block of bytes for `Lexicon`."""
    start = _minimal(sorted(words))
    number, todo = {id(start): 0}, [start]
    for state in todo:
        for to, _ in state.arcs.values():
            if id(to) not in number:
                number[id(to)] = len(todo)
                todo.append(to)
    pool: list[int] = []
    pooled: dict[tuple, int] = {}

    def place(out: tuple) -> int:
        if out not in pooled:
            pooled[out] = len(pool)
            pool.extend(out)
        return pooled[out]

    keys, target, out_at, out_n, final_at, final_n = [], [], [], [], [], []
    for k, state in enumerate(todo):
        for b, (to, out) in sorted(state.arcs.items()):
            keys.append(k << 8 | b)
            target.append(number[id(to)])
            out_at.append(place(out))
            out_n.append(len(out))
        final_at.append(place(state.rest) if state.final else -1)
        final_n.append(len(state.rest))
    arrays = [np.array(x, t) for x, t in zip((keys, target, out_at, out_n, final_at, final_n, pool), _TYPES.values(), strict=True)]
    padded = [a.tobytes() + bytes(-a.nbytes % _WORD) for a in arrays]
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *padded])


class Lexicon:
    """Looks words up in a compiled transducer."""

    def __init__(self, block: np.ndarray):
        """block: its bytes, as an array of uint8; a memory map will do."""
        sizes, at = block[: _WORD * len(_TYPES)].view(np.int64), _WORD * len(_TYPES)
        for (name, kind), n in zip(_TYPES.items(), sizes.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, block[at : at + size].view(kind))
            at += size + -size % _WORD

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def states(self) -> int:
        return len(self.final_at)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are known, flat ids of all known ones, n + 1 offsets of the words in them)."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state, live, depth = np.zeros(n, np.int64), np.arange(n) if len(self.keys) else np.zeros(0, np.int64), 0
        known, said = np.zeros(n, bool), []
        while len(live):
            at_end = sizes[live] == depth
            ended = live[at_end]
            ended = ended[self.final_at[state[ended]] >= 0]
            known[ended] = True
            said.append((ended, self.final_at[state[ended]], self.final_n[state[ended]]))
            live = live[~at_end]
            key = state[live] << 8 | data[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.target[arc]
            said.append((live, self.out_at[arc], self.out_n[arc]))
            depth += 1
        who, at, many = (np.concatenate(x) if said else np.zeros(0, np.int64) for x in (zip(*said, strict=True) if said else ([], [], [])))
        use = known[who] & (many > 0)
        who, at, many = who[use], at[use].astype(np.int64), many[use].astype(np.int64)
        order = np.argsort(who, kind="stable")
        who, at, many = who[order], at[order], many[order]
        ids = self.pool[np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return known, ids, np.concatenate([[0], np.cumsum(np.bincount(who, many, n))]).astype(np.int64)
