"""A minimal acyclic transducer from byte strings to token ids.

Words are added in sorted order; equal suffixes are merged as soon as they are complete, so the
automaton is minimal at every moment. A word's output is found by counting: each arc carries the
number of words that sort before the ones behind it, their sum along a path is the word's number,
and the number points into one flat table of ids. The whole is a handful of flat arrays in one
file, which workers map into memory and search for many words at a time.
"""

from __future__ import annotations

import io
import json

import numpy as np

_FIELDS = ("state_of", "byte_of", "target", "skip", "final", "id_at", "ids")


class _State:
    __slots__ = ("arcs", "final", "words", "number")

    def __init__(self) -> None:
        self.arcs: list[tuple[int, _State]] = []
        self.final = False
        self.words = 0
        self.number = -1

    def key(self) -> tuple:
        return (self.final, *((b, id(s)) for b, s in self.arcs))


def build(words: dict[bytes, list[int]]) -> bytes:
    """The file of the transducer for words and their ids."""
    root, known, path, last = _State(), {}, [], b""
    path = [root]

    def settle(down_to: int) -> None:
        while len(path) - 1 > down_to:
            child = path.pop()
            child.words = child.final + sum(s.words for _, s in child.arcs)
            kept = known.setdefault(child.key(), child)
            byte = path[-1].arcs[-1][0]
            path[-1].arcs[-1] = (byte, kept)

    order = sorted(words)
    for word in order:
        common = 0
        for x, y in zip(word, last):
            if x != y:
                break
            common += 1
        settle(common)
        for byte in word[common:]:
            state = _State()
            path[-1].arcs.append((byte, state))
            path.append(state)
        path[-1].final = True
        last = word
    settle(0)

    states, todo = [], [root]
    while todo:
        s = todo.pop()
        if s.number >= 0:
            continue
        s.number = len(states)
        states.append(s)
        todo.extend(c for _, c in s.arcs)
    arcs = []
    for s in states:
        before = int(s.final)
        for byte, child in s.arcs:
            arcs.append((s.number * 256 + byte, byte, child.number, before))
            before += child.words
    arcs.sort()
    lens = np.array([len(words[w]) for w in order], np.int64)
    table = {
        "state_of": np.array([a[0] for a in arcs], np.int64),
        "byte_of": np.array([a[1] for a in arcs], np.uint8),
        "target": np.array([a[2] for a in arcs], np.int32),
        "skip": np.array([a[3] for a in arcs], np.int32),
        "final": np.array([s.final for s in states], np.uint8),
        "id_at": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64),
        "ids": np.array([i for w in order for i in words[w]], np.int32),
    }
    head, at, body = {}, 0, io.BytesIO()
    for name in _FIELDS:
        raw = np.ascontiguousarray(table[name]).tobytes()
        raw += b"\0" * (-len(raw) % 16)
        head[name] = (str(table[name].dtype), len(table[name]), at)
        body.write(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 16)
    return len(text).to_bytes(8, "little") + text + body.getvalue()


class Transducer:
    """Lookup in a transducer's file, mapped into memory."""

    def __init__(self, source: str | bytes) -> None:
        raw = np.frombuffer(source, np.uint8) if isinstance(source, bytes) else np.memmap(source, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        for name, (kind, count, at) in head.items():
            start = 8 + n + at
            setattr(self, name, raw[start : start + count * np.dtype(kind).itemsize].view(kind))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton doesn't hold it."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.state_of):
            return found
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        alive, state, number, step = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(alive):
            done = lens[alive] == step
            if done.any():
                ok = done & (self.final[state] == 1)
                found[alive[ok]] = number[ok]
                alive, state, number = alive[~done], state[~done], number[~done]
                if not len(alive):
                    break
            key = state * 256 + flat[start[alive] + step]
            at = np.minimum(np.searchsorted(self.state_of, key), len(self.state_of) - 1)
            ok = self.state_of[at] == key
            alive, at, number = alive[ok], at[ok], number[ok]
            number = number + self.skip[at]
            state = self.target[at].astype(np.int64)
            step += 1
        return found

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.id_at[number] : self.id_at[number + 1]]
