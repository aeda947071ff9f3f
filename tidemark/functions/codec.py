"""The compressed format of blocks, losslessly.

A block holds its first time and value beside the stream.  Every later point is written as the change of its time
step and its value, one after the other, most significant bit first, zeros filling the last byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import CodecError

#: For changes of the time step from low to high, prefix and its bits, and the bits of change - low.
STEPS = ((0, 0, 0b0, 1, 0), (-63, 64, 0b10, 2, 7), (-255, 256, 0b110, 3, 9), (-2047, 2048, 0b1110, 4, 12), (-(2**31), 2**31 - 1, 0b1111, 4, 32))


def _bits(numbers: np.ndarray, widths: np.ndarray, blocks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fields of up to 64 bits one after the other, those of each of n blocks from a byte of their own, as bytes; and
    where each block ends."""
    sizes = -(-np.bincount(blocks, widths, n).astype(np.int64) // 8)
    ends = np.cumsum(sizes)
    before = np.cumsum(widths) - widths
    first = np.searchsorted(blocks, np.arange(n))  # fields come block by block
    start = np.append(before, widths.sum())[first]
    at = before - start[blocks] + 8 * (ends - sizes)[blocks]
    out = np.zeros(8 * (ends[-1] if n else 0), np.uint8)
    of = np.repeat(np.arange(len(widths)), widths)
    place = np.arange(len(of)) - before[of]
    out[at[of] + place] = (numbers[of] >> (widths[of] - 1 - place).astype(np.uint64)) & np.uint64(1)
    return np.packbits(out), ends


def time_fields(change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes and numbers, each with widths, of changes of the time step."""
    if len(change) and (change.min() < -(2**31) or change.max() >= 2**31):
        raise CodecError("a time step changes by more than 32 bits hold")
    kind = np.select([(change >= low) & (change <= high) for low, high, *_ in STEPS], range(len(STEPS)))
    table = np.array(STEPS, np.int64)[kind]
    return table[:, 2].astype(np.uint64), table[:, 3], (change - table[:, 0]).astype(np.uint64), table[:, 4]


def _length(x: np.ndarray) -> np.ndarray:
    """Bits up to the highest that is set."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(2**32 - 1)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.int64)


def value_fields(x: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for values, from their exclusive or with the value before: 0 where all bits are as before, else 10 and
    the bits.

    short: 11, six bits for the leading zeros, six for the length less one, and only the bits between the zeros.
    """
    same = x == 0
    if not short:
        return np.where(same, 0, 0b10).astype(np.uint64), np.where(same, 1, 2), x, np.where(same, 0, 64)
    top, low = _length(x), np.maximum(_length(x & (~x + np.uint64(1))) - 1, 0)
    size = np.maximum(top - low, 1)
    head = (0b11 << 12) | ((64 - np.maximum(top, 1)) << 6) | (size - 1)
    return np.where(same, 0, head).astype(np.uint64), np.where(same, 1, 14), x >> low.astype(np.uint64), np.where(same, 0, size)


def encode_many(ts: np.ndarray, values: np.ndarray, blocks: np.ndarray, short: bool = False) -> list[bytes]:
    """The streams of blocks (numbered from 0, their points in order and together): all points but the first of each."""
    n = int(blocks[-1]) + 1 if len(blocks) else 0
    ts, raw = ts.astype(np.int64), values.astype(np.float64).view(np.uint64)
    later = np.flatnonzero(blocks[1:] == blocks[:-1]) + 1
    step = ts[later] - ts[later - 1]
    second = np.append(True, blocks[later][1:] != blocks[later][:-1])[: len(later)]
    change = step - np.where(second, 0, np.append(0, step[:-1])[: len(later)])
    fields = (*time_fields(change), *value_fields(raw[later] ^ raw[later - 1], short))
    numbers, widths = (np.stack([fields[k + j] for k in (0, 2, 4, 6)], axis=1).ravel() for j in (0, 1))
    data, ends = _bits(numbers.astype(np.uint64), widths.astype(np.int64), np.repeat(blocks[later], 4), n)
    return [data[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]


def encode(ts: np.ndarray, values: np.ndarray, short: bool = False) -> bytes:
    """The stream of all points of a block but the first."""
    return encode_many(np.asarray(ts), np.asarray(values), np.zeros(len(ts), np.int64), short)[0] if len(ts) else b""


class _Reader:
    """Reads a field of each of many streams at once, from a window of 64 bits at any bit."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], np.int64)
        data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8).astype(np.uint64)
        self.next = data[8:]
        self.words = np.zeros(len(data) - 8, np.uint64)
        for k in range(8):
            self.words |= data[k : k + len(self.words)] << np.uint64(56 - 8 * k)
        self.ends = 8 * np.cumsum(sizes)
        self.at = self.ends - 8 * sizes

    def take(self, which: np.ndarray, widths: np.ndarray) -> np.ndarray:
        at = self.at[which]
        if (at + widths > self.ends[which]).any():
            raise CodecError("the stream ends within a field")
        self.at[which] = at + widths
        byte, bit = at >> 3, (at & 7).astype(np.uint64)
        window = self.words[byte] << bit | self.next[byte] >> (np.uint64(8) - bit)
        return np.where(widths > 0, window >> (np.uint64(64) - np.maximum(widths, 1).astype(np.uint64)), np.uint64(0))


def decode_many(first_ts: np.ndarray, first_value: np.ndarray, counts: np.ndarray, streams: list[bytes], short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """block, place, time and value of the points of many blocks, which are read side by side, a point of each at once."""
    read, table = _Reader(streams), np.array(STEPS, np.int64)
    ts, raw, step = np.array(first_ts, np.int64), np.array(first_value, np.float64).view(np.uint64), np.zeros(len(streams), np.int64)
    one, which = np.int64(1), np.flatnonzero(counts > 0)
    out = [(which, np.zeros(len(which), np.int64), ts[which], raw[which])]
    for place in range(1, int(counts.max()) if len(counts) else 0):
        which = np.flatnonzero(counts > place)
        ones, open_ = np.zeros(len(which), np.int64), np.arange(len(which))
        for _ in range(4):
            open_ = open_[read.take(which[open_], np.full(len(open_), one)) == 1]
            ones[open_] += 1
        step[which] += read.take(which, table[ones, 4]).astype(np.int64) + table[ones, 0]
        ts[which] += step[which]
        new = which[read.take(which, np.full(len(which), one)) == 1]
        if (read.take(new, np.full(len(new), one)) != int(short)).any():
            raise CodecError("a value of another format")
        if short:
            lead, size = read.take(new, np.full(len(new), 6)), read.take(new, np.full(len(new), 6)) + np.uint64(1)
            raw[new] ^= read.take(new, size.astype(np.int64)) << (np.uint64(64) - lead - size)
        else:
            raw[new] ^= read.take(new, np.full(len(new), 64))
        out.append((which, np.full(len(which), place), ts[which], raw[which]))
    block, place, times, bits = (np.concatenate([x[k] for x in out]) for k in range(4))
    return block, place, times, bits.view(np.float64)


def decode(first_ts: int, first_value: float, count: int, data: bytes, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a block."""
    return decode_many(np.array([first_ts]), np.array([first_value]), np.array([count]), [data], short)[2:]


BLOCK = "series_key string, block_id bigint, start_ts bigint, end_ts bigint, count bigint, first_value double, data binary"


def encode_blocks(blocks: DataFrame, short: bool = False) -> DataFrame:
    """One row for each block of assign_blocks(); a block is bounded, a series is not.  Blocks come together, and the
    whole ones of a batch are encoded at once."""

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, key, number = pdf["ts_ms"].to_numpy(), pdf["series_key"].to_numpy(), pdf["block_id"].to_numpy()
        new = np.append(True, (key[1:] != key[:-1]) | (number[1:] != number[:-1]))
        first = np.flatnonzero(new)
        data = encode_many(ts, pdf["value"].to_numpy(), np.cumsum(new) - 1, short)
        out = pdf.iloc[first][["series_key", "block_id"]].reset_index(drop=True)
        return out.assign(start_ts=ts[first], end_ts=np.maximum.reduceat(ts, first), count=np.diff(np.append(first, len(ts))), first_value=pdf["value"].to_numpy()[first], data=data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["series_key"] == pdf["series_key"].iloc[-1]) & (pdf["block_id"] == pdf["block_id"].iloc[-1]) if len(pdf) else None
            if last is None or last.all():
                rest = pdf
                continue
            yield encoded(pdf[~last])
            rest = pdf[last].reset_index(drop=True)
        if rest is not None and len(rest):
            yield encoded(rest)

    rows = blocks.select("series_key", "block_id", "seq", "ts_ms", "value").repartition("series_key", "block_id").sortWithinPartitions("series_key", "block_id", "seq")
    return rows.mapInPandas(run, BLOCK)


def decode_blocks(encoded: DataFrame, short: bool = False) -> DataFrame:
    """series_key, block_id, place, ts_ms, value of all points of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                pdf = whole.iloc[i : i + 2000]
                of, place, ts, v = decode_many(pdf["start_ts"].to_numpy(), pdf["first_value"].to_numpy(), pdf["count"].to_numpy(), pdf["data"].tolist(), short)
                yield pd.DataFrame({"series_key": pdf["series_key"].to_numpy()[of], "block_id": pdf["block_id"].to_numpy()[of], "place": place, "ts_ms": ts, "value": v})

    return encoded.mapInPandas(run, "series_key string, block_id bigint, place bigint, ts_ms bigint, value double")
