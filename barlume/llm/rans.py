"""A static range asymmetric numeral system over token ids, in numpy, many interleaved streams at a time.

A block of ids is dealt over LANES coder states: id i goes to state i mod LANES. All states of a block share one stream
of 32-bit words. Every STEP rounds the states and the place in the stream are noted, so that a reader can start there;
the reader below uses these checkpoints to decode all stretches of all blocks side by side.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LANES, STEP, BLOCK = 64, 256, 1 << 16
BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"RANS1\0\0\0"
HEAD = struct.Struct("<8sQQII")


@dataclass(frozen=True)
class Frequencies:
    """The shared table: 2**BITS slots, of which every id has at least one."""

    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Frequencies:
        """From the counts of all ids of the vocabulary; ids that do not occur keep one slot."""
        n, total = len(counts), 1 << BITS
        if n > total // 2:
            raise ValueError(f"{n} ids do not fit a table of {total} slots")
        c = counts.astype(np.float64)
        freq = 1 + np.floor(c * ((total - n) / max(1.0, c.sum()))).astype(np.int64)
        freq[int(np.argmax(c))] += total - int(freq.sum())
        start = np.cumsum(freq) - freq
        return Frequencies(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(n, dtype=np.uint32), freq))


def encode_blocks(ids: np.ndarray, first: int, table: Frequencies) -> list[bytes]:
    """The blocks of a run of ids whose first has the given place in the whole. Full blocks are coded together."""
    full = len(ids) // BLOCK
    out = _encode(ids[: full * BLOCK].reshape(full, BLOCK), BLOCK, first, table) if full else []
    rest = ids[full * BLOCK :]
    if len(rest):
        rounds = -(-len(rest) // LANES)
        padded = np.zeros(rounds * LANES, ids.dtype)
        padded[: len(rest)] = rest
        out += _encode(padded.reshape(1, -1), len(rest), first + full * BLOCK, table)
    return out


def _encode(blocks: np.ndarray, real: int, first: int, table: Frequencies) -> list[bytes]:
    n, rounds = len(blocks), blocks.shape[1] // LANES
    steps = np.ascontiguousarray(blocks.reshape(n, rounds, LANES).transpose(1, 0, 2)).reshape(rounds, n * LANES)
    x = np.full(n * LANES, LOW, np.uint64)
    words, sent = np.empty((rounds, n * LANES), np.uint32), np.empty((rounds, n * LANES), bool)
    marks = np.empty((-(-rounds // STEP), n * LANES), np.uint64)
    shift, high = np.uint64(32), np.uint64(63 - BITS)
    for t in range(rounds - 1, -1, -1):
        f, c = table.freq[steps[t]], table.start[steps[t]]
        np.greater_equal(x, f << high, out=sent[t])
        words[t] = x
        x = np.where(sent[t], x >> shift, x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + c
        if t % STEP == 0:
            marks[t // STEP] = x
    out = []
    for b in range(n):
        cols = slice(b * LANES, (b + 1) * LANES)
        own = sent[:, cols]
        payload = words[:, cols][own].astype("<u4").tobytes()
        places = np.concatenate([[0], np.cumsum(own.sum(axis=1))])[: rounds : STEP].astype("<u4").tobytes()
        crc = zlib.crc32(blocks[b, :real].astype("<u4").tobytes())
        head = HEAD.pack(MAGIC, first + b * BLOCK, real, rounds, crc)
        body = marks[:, cols].astype("<u8").tobytes() + places + payload
        out.append(head + body + struct.pack("<I", zlib.crc32(head + body)))
    return out


def decode_blocks(blocks: list[bytes], table: Frequencies) -> list[tuple[int, np.ndarray]]:
    """(place of the first id, ids) of each block; ValueError if a checksum does not fit."""
    heads, states, at, lengths, payloads, base = [], [], [], [], [], 0
    for block in blocks:
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block of a token file is damaged")
        magic, first, real, rounds, crc = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("this is no block of a token file")
        marks, p = -(-rounds // STEP), HEAD.size
        states.append(np.frombuffer(block, "<u8", marks * LANES, p).reshape(marks, LANES))
        p += marks * LANES * 8
        at.append(np.frombuffer(block, "<u4", marks, p).astype(np.int64) + base)
        p += marks * 4
        payloads.append(np.frombuffer(block, "<u4", (len(block) - 4 - p) // 4, p))
        base += len(payloads[-1])
        lengths += [min(STEP, rounds - i * STEP) for i in range(marks)]
        heads.append((first, real, crc, marks))
    if not heads:
        return []
    x, place, length = np.concatenate(states).astype(np.uint64), np.concatenate(at), np.array(lengths)
    stream = np.concatenate([*payloads, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    ids = np.zeros((len(x), STEP, LANES), np.uint32)
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    order = np.argsort(-length, kind="stable")  # shorter stretches leave first
    x, place, length = x[order], place[order], length[order]
    for t in range(int(length[0])):
        live = int(np.searchsorted(-length, -t, side="left"))
        y = x[:live]
        slot = y & mask
        s = table.slots[slot]
        ids[:live, t] = s
        y = table.freq[s] * (y >> bits) + slot - table.start[s]
        need = y < LOW
        rank = np.cumsum(need, axis=1)
        y = np.where(need, (y << np.uint64(32)) | stream[np.minimum(place[:live, None] + rank - 1, len(stream) - 1)], y)
        place[:live] += rank[:, -1]
        x[:live] = y
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out, k = [], 0
    for first, real, crc, marks in heads:
        got = ids[back[k : k + marks]].reshape(-1)[:real]
        k += marks
        if zlib.crc32(got.astype("<u4").tobytes()) != crc:
            raise ValueError("the ids of a block do not fit their checksum")
        out.append((first, got))
    return out
