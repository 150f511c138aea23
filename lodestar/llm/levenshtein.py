"""Whether texts are within some edits of each other, for many pairs at a time.

The table of distances of each pair is taken in words of 64 rows, whose rises and falls are bits (Myers). Only words that a path
of so few edits can pass through are taken, and a word takes a column one step after the word above it: in a step, all
words of all pairs on such a slant are independent of one another. What lies outside counts as what a path along
the edge would cost, which is never too little, so that distances up to the bound are exact and others exceed it.
Every path passes the slant, so pairs whose distances there all exceed their bounds are done.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_TOP = np.uint64(63)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes that the tables of characters may take, and steps after which pairs that are done are looked for.
TABLE, LOOK = 32 << 20, 64


def within(codes: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether codes[i] and codes[j], texts of one character or more, are at a distance of most or less; for arrays of pairs."""
    ones, which = np.unique(i, return_inverse=True)
    others, whose = np.unique(j, return_inverse=True)
    rows, columns = (np.array([len(codes[k]) for k in names.tolist()], np.int64) for names in (ones, others))
    letters, coded = np.unique(np.concatenate([codes[k] for k in (*ones.tolist(), *others.tolist())]), return_inverse=True)
    words = int(-(-rows.max() // 64))
    if len(i) > 1 and len(ones) * words * len(letters) * 8 > TABLE:
        half = len(i) // 2
        order = np.argsort(i, kind="stable")
        out = np.empty(len(i), bool)
        for part in (order[:half], order[half:]):
            out[part] = within(codes, i[part], j[part], most[part])
        return out

    # for each text of i, word and letter: the bits of where the letter is
    at = np.concatenate([[0], np.cumsum(np.concatenate([rows, columns]))])
    place = np.arange(at[len(rows)]) - np.repeat(at[: len(rows)], rows)
    cell = (np.repeat(np.arange(len(rows)), rows) * words + place // 64) * len(letters) + coded[: at[len(rows)]]
    table = np.zeros(len(rows) * words * len(letters), np.uint64)
    np.add.at(table, cell, _ONE << (place % 64).astype(np.uint64))
    # columns x pairs: letters of the texts of j
    each = np.zeros((int(columns.max()), len(others)), np.int64)
    each[np.arange(at[-1] - at[len(rows)]) - np.repeat(at[len(rows) : -1] - at[len(rows)], columns), np.repeat(np.arange(len(others)), columns)] = coded[at[len(rows)] :]
    text = each[:, whose]
    start = (which * words + np.arange(words)[:, None]) * len(letters)

    size, width, bound = rows[which], columns[whose], int(most.max())
    word = (size - 1) // 64  # with the last row
    end = width + word
    ask = np.arange(len(i))  # the pairs that are not done
    shape = (words, len(i))
    up, down = np.full(shape, _FULL), np.zeros(shape, np.uint64)
    score = np.zeros(shape, np.int64)  # at a word's last row
    score[0] = 64
    rise, fall = np.ones((words + 1, len(i)), np.uint64), np.zeros((words + 1, len(i)), np.uint64)  # out of the word above, by the column
    begun = 1

    def ending() -> dict[int, list[int]]:
        """The pairs whose last word is at the last column in a step."""
        found: dict[int, list[int]] = {}
        for k, t in enumerate(end.tolist()):
            found.setdefault(t, []).append(k)
        return found

    last = ending()
    out = np.zeros(len(i), bool)
    n = len(each)
    for t in range(1, int(end.max()) + 1):
        # word q is at column t - q, from 64 q + 1 - bound to 64 q + 64 + bound and to n
        high = min(words - 1, t - 1, (t - 1 + bound) // 65)
        low = max(0, t - n, -((64 + bound - t) // 65))
        while begun <= high:
            score[begun] = score[begun - 1] + 64 - rise[begun].astype(np.int64) + fall[begun].astype(np.int64)
            begun += 1
        now = slice(low, high + 1)
        a, b, above, below = up[now], down[now], rise[now], fall[now]
        same = table.take(start[now] + text[t - 1 - high : t - low][::-1])
        level = same | b
        same |= below
        run = same & a
        run += a
        run ^= a
        run |= same
        more = run | a
        np.invert(more, out=more)
        more |= b
        less = a & run
        out_rise, out_fall = more >> _TOP, less >> _TOP
        more <<= _ONE
        more |= above
        less <<= _ONE
        less |= below
        np.bitwise_and(more, level, out=b)
        level |= more
        np.invert(level, out=level)
        np.bitwise_or(less, level, out=a)
        score[now] += out_rise.view(np.int64)
        score[now] -= out_fall.view(np.int64)
        rise[low + 1 : high + 2], fall[low + 1 : high + 2] = out_rise, out_fall
        if low:  # the word above has ended
            rise[low], fall[low] = 1, 0
        for k in last.get(t, ()):
            q = int(word[k])
            rest = (int(_FULL) << int((size[k] - 1) % 64 + 1)) & int(_FULL)
            out[ask[k]] = score[q, k] - (int(up[q, k]) & rest).bit_count() + (int(down[q, k]) & rest).bit_count() <= most[k]
        if t % LOOK == 0:
            go = (end > t) & (score[now].min(axis=0) - 63 <= most)
            if 2 * go.sum() <= len(ask):
                if not go.any():
                    return out
                up, down, score, rise, fall, text, start = (x[:, go] for x in (up, down, score, rise, fall, text, start))
                size, word, end, most, ask = (x[go] for x in (size, word, end, most, ask))
                last = ending()
    return out
