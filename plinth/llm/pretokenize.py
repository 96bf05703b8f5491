"""Cut texts into the pieces that byte-level BPE merges separately, without a regular expression.

The cuts are those of the pattern of public_tokenizers.PATTERN (contractions, letters, numbers, other
signs, each with one space before it, and white space). Every code point becomes a symbol: its class,
plus what the next few code points decide. An automaton of eight states reads the symbols. Its transition
functions form a small monoid, so the states of a whole buffer follow from an associative scan: functions
are composed inside blocks, then over the blocks, each step one table lookup on all blocks at once. Texts
lie one after the other in the buffer; the first symbol of each resets the state.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Classes of code points, and symbols. The latter five replace classes where the next code points matter.
LETTER, NUMBER, OTHER, SPACE = range(4)
TWO, THREE, INNER, BLANK, LAST = range(4, 9)
SYMBOLS = 9
#: States: in a run of letters, numbers or other signs; after white space; after a blank that leads the
#: next piece; one or two letters before the end of a contraction; after a contraction.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, LED, ONE_LEFT, TWO_LEFT, CUT = range(8)
STATES = 8
#: Second and third letters of 's 't 'm 'd and 're 've 'll (fixed values of the pattern).
SHORT, LONG = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, sign in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[[ord(c) for c in regex.findall(sign, every)]] = kind
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts with this code point."""
    if state in (ONE_LEFT, TWO_LEFT) and symbol == LETTER:  # of the contraction; no other symbol can come here
        return (CUT if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (LETTER, NUMBER, OTHER):
        return symbol, state not in (symbol, LED)
    if symbol in (TWO, THREE):
        if state in (IN_OTHERS, LED):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == TWO else TWO_LEFT), True
    if symbol == INNER:
        return AFTER_SPACE, state != AFTER_SPACE
    return (LED if symbol == BLANK else CUT), True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function (those that reset first state come SYMBOLS later), the table of
    compositions (first, then), the value of each function at each state, and where pieces start."""
    plain = [tuple(step(s, a)[0] for s in range(STATES)) for a in range(SYMBOLS)]
    reset = [(step(CUT, a)[0],) * STATES for a in range(SYMBOLS)]
    identity = tuple(range(STATES))
    found = {identity: 0}
    todo = [identity]
    while todo:  # all products of the generators
        f = todo.pop()
        for g in (*plain, *reset):
            if (h := tuple(g[x] for x in f)) not in found:
                found[h] = len(found)
                todo.append(h)
    functions = list(found)
    assert len(functions) < 256
    then = np.array([[found[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8)
    starts = np.array([[step(s, a)[1] for a in range(SYMBOLS)] for s in range(STATES)])
    return np.array([found[f] for f in (*plain, *reset)], np.uint8), then, np.array(functions, np.uint8), starts


def scan(codes: np.ndarray, width: int = 64) -> np.ndarray:
    """The composition of all functions before each place, by blocks of ``width``."""
    _, then, _, _ = monoid()
    flat = np.ascontiguousarray(then).ravel()
    if len(codes) <= width:
        out, f = np.zeros(len(codes), np.uint8), 0
        for i, g in enumerate(codes.tolist()):
            out[i] = f
            f = int(then[f, g])
        return out
    blocks = -(-len(codes) // width)
    padded = np.zeros(blocks * width, np.uint8)
    padded[: len(codes)] = codes
    rows = np.ascontiguousarray(padded.reshape(blocks, width).T)
    within = np.zeros_like(rows)  # of the block's functions before each place
    f = np.zeros(blocks, np.uint8)
    for j in range(width):
        within[j] = f
        f = flat[f.astype(np.uint16) * len(then) + rows[j]]
    before = scan(f, width).astype(np.uint16) * len(then)
    return flat[before[None, :] + within].T.ravel()[: len(codes)]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start whose code points lie one after the other in ``points``; ``first``:
    the texts' first places (of those that are not empty), ascending from 0."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = classes()[points]
    opens = np.zeros(n + 3, bool)  # a text starts here, or nothing follows
    opens[first] = True
    opens[n:] = True
    white = symbols == SPACE
    if white.any():
        at = np.flatnonzero(white)
        inner = opens[at + 1] | np.append(white, False)[at + 1]
        symbols[at] = np.where(inner, INNER, np.where(points[at] == 0x20, BLANK, LAST))
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        tail = np.zeros(n + 2, np.uint32)
        tail[:n] = points
        one, two = np.where(opens[at + 1], 0, tail[at + 1]), np.where(opens[at + 1] | opens[at + 2], 0, tail[at + 2])
        symbols[at[np.isin(one, [ord(c) for c in SHORT])]] = TWO
        symbols[at[np.any([(one == ord(a)) & (two == ord(b)) for a, b in LONG], axis=0)]] = THREE
    generators, then, functions, starts = monoid()
    codes = symbols.copy()
    codes[first] += SYMBOLS
    state = functions[scan(generators[codes]), CUT]
    state[first] = CUT
    return np.flatnonzero(starts[state, symbols])
