"""Fuzzy line deduplication.

Lines end at \n. A line's words are its runs of digits, a-z (A-Z lower-cased) and code points beyond ASCII; in lines
of FOLD words or more every digit is 0. The words of a line with none of these are its runs of other than blanks; a
blank line is left alone. Lines with equal words are one class. Two classes are linked if the edit similarity of their
words, 1 - distance / longer length in characters, is SIMILARITY or more, and they are candidates.
Of each connected group the first occurrence stays, by doc_id and then line; the others are removed.

A line's SimHash has BLOCKS blocks of BITS bits. A hash deals the byte grams of the words to the blocks, about
GRAMS to each; a bit of a block is the sign of its grams' sum, and of a long line as many grams stay undealt as there
are too many. An edit changes only blocks to which grams that it touches are dealt: while it leaves one block as it
was, the two lines share that block (pigeonhole). Two lines that share a block of LEAST grams or more are candidates if
their lengths allow for them to be similar and, of SKETCH bits of each block, they differ in FAR at most. SimHashes are of a
tier of lengths; a line just below a tier has those of both, so that no pair is parted by its lengths. Which grams
share a block is chance: the README gives the recall. Where more than CROWD lines share a block, all are taken as
candidates. Blocks that only one line has are left out beforehand, by keys alone. Connected candidates are a region for regions.links(), which confirms the links on the words.

Null text stays null, with no lines; an empty text has one line, a blank one. Null doc_ids are an id of
their own, before all others. Rows with equal doc_id and text are one document and get the same result. Very long texts
and lines are taken whole. An empty table has no rows. Other columns are passed through by deduplicate(), whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import kept, scratch, small, stored, unused
from ._text import ALNUM, LOWER, NONSPACE, mix, pieces, tidy, word_bounds, word_hashes
from .components import components, forest
from .levenshtein import within
from .regions import Pairs, links

SIMILARITY = 0.9
#: Lines of fewer words keep their digits.
FOLD = 5
#: Of a SimHash: blocks, bits of one, grams dealt to one on average, and the least that one to be joined by must have.
BLOCKS, BITS, GRAMS, LEAST = 12, 32, 4, 3
#: Bits of each block by which candidates are compared, and in how many of all of them they may differ.
SKETCH, FAR = 10, 24
#: Characters from which a tier begins: the shortest line that an edit can leave similar, then by this factor.
FIRST, FACTOR, TIERS = 10, 1.6, 30
#: Rows that share a block and are compared in pairs; more are compared by regions alone.
CROWD = 2000
#: Characters that a task may hold of a region.
CHUNK = 2_000_000
#: Characters that a line counts for besides its own.
WEIGHT = 256
#: Lines of a task that are remembered, to be given no second SimHash.
KNOWN = 500_000
#: Bytes of texts whose lines are hashed at a time: what is held for each of their grams is what this takes of memory.
PART = 1 << 19
#: Lines from which a group is compared in many pairs at a time, pairs that are fewer than that pays for, and characters of those compared together.
GROUP, FEW, TOGETHER = 6, 16, 1_000_000
_FOLD = LOWER.copy()
_FOLD[48:58] = 48
_FOLD_BYTES, _LOWER_BYTES = _FOLD.tobytes(), LOWER.tobytes()
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of the key of a block and of the id of a line's SimHash, to find blocks that several lines have; parts of a partition they are dealt to.
KEY, PID, PARTS = 6, 5, 8
#: Characters of a line that its key tells apart.
_LENGTHS = 14


def gram_size(characters: int) -> int:
    """Bytes of a gram for lines of a tier that begins there: long lines have most short grams in common."""
    return 2 if characters < 25 else 4 if characters < 40 else 5 if characters < 100 else 7


def _tiers() -> np.ndarray:
    """Of each tier: characters from which it begins, bytes of its grams, blocks to which all grams of a line are dealt."""
    out, least = [], float(FIRST)
    for _ in range(TIERS):
        q = gram_size(int(least))
        out.append((int(least), q, max(2, round((1.25 * int(least) - q + 2) / GRAMS))))
        least *= FACTOR
    return np.array(out)


_TIERS = _tiers()
_STEP = 1 << 16
_UP = np.multiply.accumulate(np.append(1, np.full(_STEP, 0x01000193)).astype(np.uint32))
_DOWN = np.multiply.accumulate(np.append(1, np.full(_STEP, pow(0x01000193, -1, 1 << 32))).astype(np.uint32))


def _joined(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the words, each followed by a blank."""
    size = ends - starts
    word = np.repeat(np.arange(len(size)), size)
    out = np.full(len(word) + len(size), 32, np.uint8)
    at = np.arange(len(word))
    out[at + word] = folded[at + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
    return out


_WIDEST = max(q for _, q, _ in _TIERS.tolist())


def _gram_sums(data: np.ndarray) -> list[np.ndarray]:
    """What _gram_hashes() is taken from, whatever the size of a gram: for each stretch the sums of powers up to each byte."""
    out = []
    for lo in range(0, len(data), _STEP - _WIDEST):
        part = data[lo : lo + _STEP - 1]
        total = np.zeros(len(part) + 1, np.uint32)
        np.cumsum((part + np.uint32(1)) * _UP[: len(part)], out=total[1:])
        out.append(total)
    return out


def _gram_hashes(data: np.ndarray, q: int, sums: list[np.ndarray] | None = None) -> np.ndarray:
    """A 32-bit hash of each q bytes, equal for equal ones: sums of powers, and the powers taken back. sums: _gram_sums(data), if known."""
    out = np.empty(max(0, len(data) - q + 1), np.uint32)
    for lo, total in zip(range(0, len(out), _STEP - _WIDEST), _gram_sums(data) if sums is None else sums):
        n = min(_STEP - _WIDEST, len(out) - lo)
        out[lo : lo + n] = (total[q : q + n] - total[:n]) * _DOWN[:n]
    return out


#: Four bits as numbers of 16 bits each, so that sums of four are taken at a time.
_SPREAD = np.array([sum((n >> k & 1) << 16 * k for k in range(4)) for n in range(16)], np.uint64)


def _signs(bits: np.ndarray, first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For runs of number hashes from first on: the bytes of the bits that more than half of them have."""
    out = np.zeros((len(first), BITS // 8), np.uint8)
    for k in range(BITS // 4):
        total = np.add.reduceat(_SPREAD[bits >> np.uint64(4 * k) & np.uint64(15)], first)
        for n in range(4):
            out[:, k // 2] |= (2 * (total >> np.uint64(16 * n) & np.uint64(0xFFFF)) > number.view(np.uint64)).astype(np.uint8) << (4 * (k % 2) + n)
    return out


def simhashes(data: np.ndarray, at: np.ndarray, length: np.ndarray, asked: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines data[at[k]:at[k + 1]] of length characters, each once or twice in the order of the lines; for each of
    these rows its tier, the bytes of its blocks, and how many grams each block has (255 at most). asked: which lines have any."""
    lines, tiers, blocks, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, BLOCKS, BITS // 8), np.uint8)], [np.zeros((0, BLOCKS), np.uint8)]
    own = np.searchsorted(_TIERS[:, 0], length, "right") - 1
    above = np.searchsorted(_TIERS[:, 0] * SIMILARITY - 1e-9, length, "right") - 1
    sums = _gram_sums(data)
    for q in sorted(set(_TIERS[:, 1].tolist())):
        grams = None
        for tier in (own, above):
            rows = np.flatnonzero(asked & (tier >= 0) & (_TIERS[tier, 1] == q) & (np.diff(at) >= q) & ((tier is own) | (own < above)))
            if not len(rows):
                continue
            if grams is None:
                grams = _gram_hashes(data, q, sums)
            size = at[rows + 1] - at[rows] - q + 1
            first = np.cumsum(size) - size
            end = at[rows] - first
            gram = grams[np.arange(size.sum(), dtype=np.int32) + np.repeat(end.astype(np.int32), size)] if len(data) < 1 << 31 else grams[np.arange(size.sum()) + np.repeat(end, size)]
            dealt = np.repeat(_TIERS[tier[rows], 2].astype(np.uint32), size)
            held = np.zeros((len(rows), BLOCKS, BITS // 8), np.uint8)
            count = np.zeros((len(rows), BLOCKS), np.uint8)
            for done in sorted({k for d in set(_TIERS[tier[rows], 2].tolist()) for k in range(0, BLOCKS, d)}):  # lines with few grams deal them several times
                some = np.flatnonzero(done % dealt == 0) if done else None
                part, deal = (gram, dealt) if some is None else (gram[some], dealt[some])
                turn = (part ^ np.uint32(done * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                turn ^= turn >> np.uint32(15)
                block = ((turn * np.uint32(0xC2B2AE35) >> np.uint32(12)).astype(np.uint64) * deal >> np.uint64(20)).astype(np.uint32)
                mine = np.flatnonzero(block < BLOCKS - done)
                if not len(mine):
                    continue
                place = mine if some is None else some[mine]
                line = np.searchsorted(first, place, "right") - 1
                cell = line * BLOCKS + block[mine] + done
                bits = mix(turn[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(done))
                order = np.argsort(cell, kind="stable")
                cell, bits = cell[order], bits[order]
                new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                number = np.diff(np.append(new, len(cell)))
                held.reshape(-1, BITS // 8)[cell[new]] = _signs(bits, new, number)
                count.ravel()[cell[new]] = np.minimum(number, 255)
            lines.append(rows), tiers.append(tier[rows]), blocks.append(held), sizes.append(count)
    line = np.concatenate(lines)
    order = np.argsort(line, kind="stable")
    return line[order], np.concatenate(tiers)[order], np.concatenate(blocks)[order], np.concatenate(sizes)[order]


#: A print: the tier, a bit for each block that has LEAST grams, and the blocks.
_PRINT = 1 + 2 + BLOCKS * BITS // 8
_OCCURRENCE = "text_hash long, line int, k1 long, k2 long, length int, prints array<binary>, size long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, line, two hashes of the words, their characters, their SimHashes, the bytes; for each line that counts.

    A line that occurs again in a task has no SimHash: its first occurrence does.
    """
    known: set[int] = set()
    for batch in batches:
        for first, _, data, offsets in pieces(batch.column(2), PART):
            cuts = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
            doc = np.searchsorted(offsets, cuts[:-1], "right") - 1  # of each line; empty texts have none
            line = np.arange(len(doc)) - np.searchsorted(doc, doc)
            starts, ends = word_bounds(data, offsets, ALNUM)
            size = np.diff(np.searchsorted(starts, cuts))
            filled = np.concatenate([[0], np.cumsum(NONSPACE[data], dtype=np.int32)])
            bare = (size == 0) & (filled[cuts[1:]] > filled[cuts[:-1]])
            if bare.any():
                inside = ALNUM[data] | NONSPACE[data] & np.repeat(bare, np.diff(cuts))
                starts, ends = word_bounds(inside.view(np.uint8), offsets, np.array([False, True]))
                size = np.diff(np.searchsorted(starts, cuts))
            rows = np.flatnonzero(size)
            if not len(rows):
                continue
            folded = np.where(np.repeat(size >= FOLD, np.diff(cuts)), _FOLD[data], LOWER[data])
            words, joined = word_hashes(folded, starts, ends), _joined(folded, starts, ends)
            size = size[rows]
            at = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(len(words)) - np.repeat(at[:-1], size)
            factor = mix(place.astype(np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)
            k1 = mix(np.add.reduceat(words * factor, at[:-1]))
            k2 = mix(np.add.reduceat(mix(words + np.uint64(1)) * factor, at[:-1]))
            at = np.concatenate([[0], np.cumsum(ends - starts + 1)])[at]
            characters = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80, dtype=np.int32)])[at]
            length = np.diff(characters) - 1  # without the blank at the end
            own, where = np.unique(k1, return_index=True)
            new = np.zeros(len(rows), bool)
            names = own.tolist()
            new[where[[k not in known for k in names]]] = True
            if len(known) < KNOWN:
                known.update(names)
            of, tier, blocks, count = simhashes(joined, at, length, new)
            prints = np.concatenate([tier.astype(np.uint8)[:, None], np.packbits(count >= LEAST, axis=1), blocks.reshape(len(of), BLOCKS * BITS // 8)], axis=1)
            prints = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(rows) + 1)), pa.int32()), pa.array([x.tobytes() for x in prints], pa.binary()))
            take = pa.array(first + doc[rows])
            columns = [line[rows].astype(np.int32), k1.view(np.int64), k2.view(np.int64), length.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x) for x in columns), prints, pa.array(np.diff(cuts)[rows])], ["doc_id", "text_hash", "line", "k1", "k2", "length", "prints", "size"])


def _sketches(blocks: np.ndarray) -> np.ndarray:
    """SKETCH bits of each block of the rows, in two numbers."""
    some = blocks[:, :, 0].astype(np.uint64) << np.uint64(SKETCH - 8) | blocks[:, :, 1].astype(np.uint64) >> np.uint64(16 - SKETCH)
    out = np.zeros((len(blocks), 2), np.uint64)
    for k in range(BLOCKS):
        out[:, k % 2] = out[:, k % 2] << np.uint64(SKETCH) | some[:, k]
    return out


def _block_keys(prints: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The key of blocks of rows of prints: the tier, the block's number, and the block, in 41 bits."""
    key = prints[row, 0].astype(np.uint64) * np.uint64(BLOCKS) + number.astype(np.uint64)
    for k in range(BITS // 8):
        key = key << np.uint64(8) | prints[row, 3 + number * (BITS // 8) + k].astype(np.uint64)
    return key


def _blocks_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The prints of a column, a row each, and which of their blocks are to be joined by."""
    prints = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _PRINT)
    return prints, np.unpackbits(prints[:, 1:3], axis=1)[:, :BLOCKS]


def _packed(parts: int):
    """For rows (pid, print): rows (part, keys) of the blocks to be joined by, those of a part in one row: KEY bytes of each key and PID of
    its pid, which take a third of a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            pid = np.concatenate([b.column(0).to_numpy() for b in held])
            prints, joined = _blocks_of(pa.chunked_array([b.column(1) for b in held]))
            row, number = np.nonzero(joined)
            key = _block_keys(prints, row, number)
            part = (mix(key) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            names, first = np.unique(part[order], return_index=True)
            data = np.concatenate([key[order].view(np.uint8).reshape(-1, 8)[:, :KEY], pid[row[order]].view(np.uint8).reshape(-1, 8)[:, :PID]], axis=1)
            offsets = np.append(first, len(order)).astype(np.int32) * (KEY + PID)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], ["part", "keys"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 15:
                yield packed()
                held = []
        if held:
            yield packed()

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of _packed() in the order of their parts: rows (pid, mask) of the keys that several pids have, a bit for the block's number."""
    held: list[bytes] = []
    at = None

    def shared() -> pa.RecordBatch:
        data = np.frombuffer(b"".join(held), np.uint8).reshape(-1, KEY + PID)
        wide = np.zeros((2, len(data), 8), np.uint8)
        wide[0, :, :KEY], wide[1, :, :PID] = data[:, :KEY], data[:, KEY:]
        key, pid = wide.view(np.uint64)[:, :, 0]
        order = np.argsort(key)
        again = key[order[1:]] == key[order[:-1]]
        some = order[np.append(again, False) | np.append(False, again)] if len(order) else order
        some = some[np.lexsort((pid[some], key[some]))]
        key, pid = key[some], pid[some]
        fresh = np.append(True, (key[1:] != key[:-1]) | (pid[1:] != pid[:-1]))[: len(key)]  # a line that several tasks have
        key, pid = key[fresh], pid[fresh]
        again = key[1:] == key[:-1]
        several = (np.append(again, False) | np.append(False, again))[: len(key)]
        mask = np.int64(1) << ((key[several] >> np.uint64(BITS)) % np.uint64(BLOCKS)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pid[several].view(np.int64)), pa.array(mask)], ["pid", "mask"])

    for batch in batches:
        for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != at:
                if held:
                    yield shared()
                held, at = [], part
            held.append(keys)
    if held:
        yield shared()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (id, length, print, mask): a row for each block to be joined by that the mask has: its key, which is that of the block and
    the length; the id, and SKETCH bits of each block in two numbers."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            part = batch.slice(lo, 8192)
            prints, joined = _blocks_of(part.column(2))
            row, number = np.nonzero(joined & (part.column(3).to_numpy()[:, None] >> np.arange(BLOCKS) & 1).astype(np.uint8))
            key = _block_keys(prints, row, number) << np.uint64(_LENGTHS) | np.minimum(part.column(1).to_numpy()[row], (1 << _LENGTHS) - 1).astype(np.uint64)
            sketch = _sketches(prints[:, 3:].reshape(len(prints), BLOCKS, BITS // 8))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(sketch[row, 0].view(np.int64)), pa.array(sketch[row, 1].view(np.int64))], ["key", "id", "s1", "s2"])


def _most(longer: np.ndarray) -> np.ndarray:
    """The largest distance of similar words, the longer of that length."""
    return np.floor((1 - SIMILARITY) * longer + 1e-6).astype(np.int64)


def _possible(length: np.ndarray, sketch: np.ndarray, i, j: np.ndarray) -> np.ndarray:
    """Whether the lengths of rows i and j allow for them to be similar, and their SimHashes are near; each j is at least as long as its i."""
    differ = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (length[i] >= length[j] - _most(length[j])) & (differ <= FAR)


def _pairs(key: np.ndarray, length: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates among rows in the order of key and length, each with those after it of its key."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.repeat(np.append(new[1:], len(key)), np.diff(np.append(new, len(key))))
    active, step = np.arange(len(key)), 1
    while True:
        active = active[active + step < end[active]]
        active = active[length[active] >= length[active + step] - _most(length[active + step])]
        if not len(active):
            return
        for lo in range(0, len(active), 1 << 16):
            i = active[lo : lo + (1 << 16)]
            i = i[_possible(length, sketch, i, i + step)]
            yield node[i], node[i + step]
        step += 1


def _joined_up(length: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the candidates among rows of one key, in the order of length: a row is compared with those not yet connected with it."""
    label = np.arange(len(node))
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[_possible(length, sketch, i, j)]
        if len(j):
            names, where = np.unique(label[j], return_index=True)
            yield np.full(len(where), node[i]), node[j[where]]
            label[np.isin(label, names)] = label[i]


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches, so many together that there are least rows or more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(batch.num_columns)]
            held = []
    if any(b.num_rows for b in held):
        yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)]


def _shared_blocks(rows: list[np.ndarray], crowded: bool) -> pa.RecordBatch:
    """Of rows in the order of key and id: the ids of which several share a block, and the block; crowded: the first block has other ids besides."""
    block, node = rows[0] >> _LENGTHS, rows[1]
    fresh = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (node[1:] != node[:-1])])[: len(node)]
    block, node = block[fresh], node[fresh]
    new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(node)])
    size = np.diff(np.append(new, len(node)))
    several = size > 1
    several[:1] |= crowded
    keep = np.repeat(several, size)
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.nulls(int(keep.sum()), pa.int64()), pa.array(block[keep])], ["a", "b", "block"])


def _near_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_near(), with a third column that is null, and besides them rows (id, null, block) of the blocks that lines share."""
    for batch in _near(batches, True):
        yield batch if batch.num_columns == 3 else pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], ["a", "b", "block"])


def _near(batches: Iterator[pa.RecordBatch], shared: bool = False) -> Iterator[pa.RecordBatch]:
    """For rows of _keyed() in the order of their keys: edges that connect the candidates; shared: and batches of _shared_blocks()."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]
    crowd: int | None = None  # the key of the rows held, if there have been more than CROWD

    def found(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for a, b in pairs:
            held.append((a, b))
            size += len(a)
            if size > 400_000:
                held = [forest(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > 200_000:
                    yield batch_of(*held.pop())
                    size = 0
        if size:
            yield batch_of(*forest(*(np.concatenate(x) for x in zip(*held))))

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def pairs(rows: list[np.ndarray], crowded: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of whole keys; crowded: the first key has other rows besides."""
        key, length, node, sketch = rows[0] >> _LENGTHS, rows[0] & (1 << _LENGTHS) - 1, rows[1], np.stack(rows[2:], axis=1)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        many = size > 64
        if crowded:
            many[0] = True
        few = np.repeat(~many, size)
        yield from _pairs(key[few], length[few], node[few], sketch[few])
        for k in np.flatnonzero(many).tolist():
            at = slice(new[k], new[k] + size[k])
            if size[k] > CROWD or crowded and k == 0:
                near = np.flatnonzero(length[at][:-1] >= length[at][1:] - _most(length[at][1:]))
                yield node[at][near], node[at][near + 1]
            else:
                yield from _joined_up(length[at], node[at], sketch[at])

    for many_rows in _gathered(batches, 1 << 17):
        rows = [np.concatenate(x) for x in zip(rest, many_rows)]
        block = rows[0] >> _LENGTHS
        last = int(np.searchsorted(block, block[-1]))
        crowded = crowd is not None and crowd == int(block[0])
        if last:
            yield from found(pairs([x[:last] for x in rows], crowded))
            if shared:
                yield _shared_blocks([x[:last] for x in rows], crowded)
            crowded, crowd = False, None
        rest = [x[last:] for x in rows]
        if crowded or len(rest[0]) > CROWD:  # linked in a row, so that the last is all there is to keep
            crowd = int(block[-1])
            yield from found(pairs(rest, True))
            if shared:
                yield _shared_blocks([x[:-1] for x in rest], True)
            rest = [x[-1:] for x in rest]
    if len(rest[0]):
        yield from found(pairs(rest, crowd is not None))
        if shared:
            yield _shared_blocks(rest, crowd is not None)


def _places(text: str) -> dict[str, int]:
    """For each character the bits of where it is in the text."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(a: str, b: str) -> int:
    """Levenshtein distance, a whole column of the table at a time in the bits of one integer.

    A bit of up or down says that the table's value rises or falls by one from a row to the next.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    get = _places(a).get
    full = (1 << len(a)) - 1
    up, down = full, 0
    for c in b:
        same = get(c, 0)
        flat = same | down
        same = (((same & up) + up) ^ up | same) & full
        right = (down | full ^ (same | up)) << 1 | 1
        left = (up & same) << 1
        up = (left | ~(flat | right)) & full
        down = right & flat & full
    return len(b) + up.bit_count() - down.bit_count()


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    return _similar(a, b, _codes(a), _codes(b), least)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _similar(a: str, b: str, codes_a: np.ndarray, codes_b: np.ndarray, least: float) -> bool:
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if shorter < least * longer - 1e-9:
        return False
    most = int((1 - least) * longer + 1e-6)
    apart = np.flatnonzero(codes_a[:shorter] != codes_b[:shorter])
    if len(apart) + longer - shorter <= most:
        return True
    begin = int(apart[0])  # what the two begin and end with does not add to their distance
    rest = shorter - begin
    apart = np.flatnonzero(codes_a[len(a) - rest :][::-1] != codes_b[len(b) - rest :][::-1])
    end = int(apart[0]) if len(apart) else rest
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if max(len(a), len(b)) <= most:
        return True
    head = 2 * most + 16
    return (head > 0.7 * len(a) or _begins_like(a[:head], b[: head + most], most)) and distance(a, b) <= most


def _begins_like(head: str, text: str, most: int) -> bool:
    """Whether some beginning of the text is within most edits of head. A step changes the distance by one at most."""
    get = _places(head).get
    full = (1 << len(head)) - 1
    up, down, look = full, 0, max(1, len(head) - most)
    for n, c in enumerate(text, 1):
        same = get(c, 0)
        flat = same | down
        same = (((same & up) + up) ^ up | same) & full
        right = (down | full ^ (same | up)) << 1 | 1
        left = (up & same) << 1
        up = (left | ~(flat | right)) & full
        down = right & flat & full
        if n == look:
            now = n + up.bit_count() - down.bit_count()
            if now <= most:
                return True
            look = n + now - most
    return False


def words_of(line: str) -> str:
    """The words of a line, as they are compared."""
    raw = line.encode()
    words = _WORD.findall(raw.translate(_LOWER_BYTES)) or raw.translate(_LOWER_BYTES).split()
    joined = b" ".join(words)
    return (joined.translate(_FOLD_BYTES) if len(words) >= FOLD else joined).decode()


class Line(NamedTuple):
    """The words of a line, their code points, and their SimHashes' tiers and sketches: of a second tier, or of none."""

    words: str
    codes: np.ndarray
    tiers: tuple[int, int]
    sketches: np.ndarray


def _load(column: pa.Array) -> list[Line]:
    words = [words_of(line) for line in column.to_pylist()]
    raw = [w.encode() + b" " for w in words]
    length = np.array([len(w) for w in words], np.int64)
    line, tier, blocks, _ = simhashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), length)
    tiers, sketches = np.full((len(words), 2), -1), np.zeros((len(words), 2, 2), np.uint64)
    second = np.concatenate([[False], line[1:] == line[:-1]]).astype(np.int64)
    tiers[line, second], sketches[line, second] = tier, _sketches(blocks)
    return [Line(w, _codes(w), tuple(t), s) for w, t, s in zip(words, tiers.tolist(), sketches)]


def _linked(items: list[Line]):
    length = np.array([len(line.words) for line in items])
    tiers, sketches = np.array([line.tiers for line in items]), np.stack([line.sketches for line in items])
    if len(items) >= GROUP:
        return Pairs(lambda active: _alike(length, tiers, sketches, active), lambda i, j: _links(items, length, i, j))

    def test(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        near = np.zeros(len(others), bool)  # candidates, whichever of their tiers they have in common
        for k in (0, 1):
            for n in (0, 1):
                if tiers[i, k] >= 0:
                    differ = np.bitwise_count(sketches[others, n] ^ sketches[i, k]).sum(axis=1, dtype=np.int64)
                    near |= (tiers[others, n] == tiers[i, k]) & (differ <= FAR)
        near &= np.abs(length[others] - length[i]) <= _most(np.maximum(length[others], length[i]))
        for k in np.flatnonzero(near):
            one, other = items[i], items[others[k]]
            out[k] = _similar(one.words, other.words, one.codes, other.codes, SIMILARITY)
        return out

    return test


def _alike(length: np.ndarray, tiers: np.ndarray, sketches: np.ndarray, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs.near() for lines: candidates by any tier that they have in common, those of the nearest SimHashes first."""
    for tier in np.unique(tiers[tiers >= 0]):
        row, second = np.nonzero(tiers == tier)
        order = np.argsort(length[row], kind="stable")
        row, second = row[order], second[order]
        size, sketch = length[row], sketches[row, second]
        one, other = np.ascontiguousarray(sketch[:, 0]), np.ascontiguousarray(sketch[:, 1])
        asked = np.flatnonzero(active[row])
        for lo in range(0, len(asked), 64):
            part = asked[lo : lo + 64]
            # lines that are too short or too long for all of the part
            begin = int(np.searchsorted(size, size[part[0]] - _most(size[part[0]])))
            end = int(np.searchsorted(size - _most(size), size[part[-1]], "right"))
            differ = np.bitwise_count(one[part, None] ^ one[begin:end]) + np.bitwise_count(other[part, None] ^ other[begin:end])
            p, q = np.nonzero(differ <= FAR)
            nearest = np.argsort(differ[p, q], kind="stable")
            p, q = part[p[nearest]], begin + q[nearest]
            i, j = row[p], row[q]
            keep = (np.abs(size[p] - size[q]) <= _most(np.maximum(size[p], size[q]))) & (i != j) & (~active[j] | (i < j))
            yield i[keep], j[keep]


def _bunched(items: list[Line], group: np.ndarray) -> Pairs:
    """_linked() for the lines of many small groups: the candidates in all of them, which are compared together."""
    length = np.array([len(line.words) for line in items])
    tiers, sketches = np.array([line.tiers for line in items]), np.stack([line.sketches for line in items])

    def near(active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = []
        for step in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero(group[step:] == group[:-step])
            j = i + step
            i = i[keep := (active[i] | active[j]) & (np.abs(length[i] - length[j]) <= _most(np.maximum(length[i], length[j])))]
            j = j[keep]
            least = np.full(len(i), FAR + 1)  # of any tiers they have in common
            for k in (0, 1):
                for n in (0, 1):
                    differ = np.bitwise_count(sketches[i, k] ^ sketches[j, n]).sum(axis=1, dtype=np.int64)
                    least = np.where((tiers[i, k] >= 0) & (tiers[i, k] == tiers[j, n]), np.minimum(least, differ), least)
            i, j, least = i[close := least <= FAR], j[close], least[close]
            found.append((np.where(active[i], i, j), np.where(active[i], j, i), least))
        if found:
            i, j, least = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(least, kind="stable")
            yield i[order], j[order]

    return Pairs(near, lambda i, j: _links(items, length, i, j))


def _links(items: list[Line], length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs.test() for lines: those of about one length are compared together."""
    out = np.zeros(len(i), bool)
    longer = np.maximum(length[i], length[j])
    order = np.argsort(longer, kind="stable")
    at = 0
    while at < len(order):
        least = int(longer[order[at]])
        end = min(at + max(1, TOGETHER // (least + 64)), int(np.searchsorted(longer[order], 1.4 * least + 16, "right")))
        part = order[at:end]
        if len(part) < FEW:
            for k in part:
                one, other = items[i[k]], items[j[k]]
                out[k] = _similar(one.words, other.words, one.codes, other.codes, SIMILARITY)
        else:
            out[part] = within([x.codes for x in items], i[part], j[part], _most(longer[part]))
        at = end
    return out


def removals(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_hash and number, from 0, of each line to remove; stored."""
    with scratch():
        return kept(stored(_removals(docs, chunk), "removals"))


def _removals(docs: DataFrame, chunk: int) -> DataFrame:
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = stored(docs.mapInArrow(tidy(_occurrences), f"doc_id {kind}, {_OCCURRENCE}"), "occurrences")
    place = F.struct("doc_id", "text_hash", "line")
    classes = stored(seen.groupBy("k1", "k2").agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("many"), F.max("size").alias("weight")), "classes")

    # most blocks are of one line only: those that several have are found by keys alone, and only they go on with SimHashes
    prints = seen.select(F.col("k1").alias("id"), "length", F.explode("prints").alias("print"))
    prints = prints.withColumn("pid", F.xxhash64("id", F.substring("print", 1, 1)).bitwiseAND((1 << 8 * PID) - 1))
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = prints.select("pid", "print").mapInArrow(tidy(_packed(parts)), "part int, keys binary").repartition("part").sortWithinPartitions("part")
    live = packed.mapInArrow(tidy(_common), "pid long, mask long").groupBy("pid").agg(F.bit_or("mask").alias("mask"))
    live = _small(stored(live, "live"), 16)
    keyed = prints.join(live, "pid").select("id", "length", "print", "mask").mapInArrow(tidy(_keyed), "key long, id long, s1 long, s2 long")
    keyed = keyed.repartition(F.shiftright("key", _LENGTHS)).sortWithinPartitions("key", "id")
    met = stored(keyed.mapInArrow(tidy(_near_shared), "a long, b long, block long"), "met")
    found = components(met.where("block is null").select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("region"))
    found = stored(found.unionByName(found.select(F.col("region").alias("id"), "region").distinct()), "regions")
    members = classes.select(F.col("k1").alias("id"), (F.col("weight") + WEIGHT).alias("weight"), "first")
    members = stored(members.join(_small(found, 32), "id").select("region", "id", "weight", "first"), "members")

    def attach(deal: DataFrame) -> DataFrame:
        need = deal.join(members.select("id", "first.*").dropDuplicates(["id"]), "id")
        few = deal.count() * 128 <= _shared.BROADCAST_BYTES
        on = [docs["doc_id"].eqNullSafe(need["doc_id"]), docs["text_hash"] == need["text_hash"]]
        return docs.join(F.broadcast(need) if few else need, on).select(*[need[c] for c in deal.columns], F.expr(r"substring_index(substring_index(text, '\n', line + 1), '\n', -1)").alias("payload"))

    def regroup(ids: DataFrame) -> DataFrame:
        """Lines that share a block: candidates do, and regions of candidates grow together as lines become many."""
        some = met.where("block is not null").select(F.col("a").alias("id"), F.col("block").alias("group"))
        return some.join(_small(ids, 16), "id", "left_semi")

    edges = links(members.select("region", "id", "weight"), attach, _load, _linked, chunk, regroup, _bunched)
    groups = components(edges).select(F.col("node").alias("k1"), F.col("component").alias("group"))
    groups = stored(groups.unionByName(groups.select(F.col("group").alias("k1"), "group").distinct()), "groups")
    fuzzy = classes.join(_small(groups, 32), "k1").select("k1", "k2", "first", "group")
    keep = fuzzy.groupBy("group").agg(F.min("first").alias("keeper"))
    affected = fuzzy.join(keep, "group").select("k1", "k2", "keeper")
    affected = affected.unionByName(classes.where("many").join(_small(groups, 32), "k1", "left_anti").select("k1", "k2", F.col("first").alias("keeper")))
    affected = _small(stored(affected, "affected"), 80)
    lost = seen.join(affected, ["k1", "k2"]).where(~place.eqNullSafe(F.col("keeper")))
    return lost.select("doc_id", "text_hash", "line").distinct()


def _small(frame: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, to be broadcast if it is known to be small."""
    return F.broadcast(frame) if small(frame, row_bytes) else frame


def deduplicate(docs: DataFrame, removed: str = "_removed") -> DataFrame:
    """docs without the lines to remove; removed: a further column with their numbers, named with underscores if need be."""
    removed = unused(docs, removed)
    lost = removals(docs)
    cut = lost.groupBy(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash")).agg(F.sort_array(F.collect_list("line")).alias("_cut"))
    cut = F.broadcast(cut) if small(lost, 64) else cut
    columns = [docs[c] for c in docs.columns]
    out = docs.join(cut, [docs["doc_id"].eqNullSafe(cut["_cut_id"]), F.xxhash64(docs["text"]) == cut["_cut_hash"], docs["text"].isNotNull()], "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda _, i: ~F.array_contains(cut["_cut"], i)), "\n")
    text = F.when(cut["_cut"].isNull(), docs["text"]).otherwise(left).alias("text")
    return out.select(*[text if name == "text" else column for name, column in zip(docs.columns, columns)], F.coalesce(cut["_cut"], F.array().cast("array<int>")).alias(removed))


def report(docs: DataFrame) -> DataFrame:
    """For every document: doc_id, n_lines, n_removed, the numbers of the lines removed, and the cleaned text's SHA-256."""
    had = docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = deduplicate(had)
    return out.select("doc_id", "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.transform("_removed", lambda x: x.cast("string")), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))
