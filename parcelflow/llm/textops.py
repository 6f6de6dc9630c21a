"""Vectorised byte-level helpers shared by the text operators (run inside Arrow tasks).

A batch of texts is one byte buffer with offsets; words, shingles and n-grams are index arrays
over it, so no Python string is made per word.  Work is cut into pieces of about ``PIECE`` bytes
to bound memory; one text longer than that is a piece of its own and is still processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
U64 = np.uint64
#: Odd base of the polynomial byte hash (mod 2^64), its inverse, and the multiplier that chains word hashes.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
CHAIN = 0xD6E8FEB86659FD93

#: The two word alphabets of the contracts, as byte classes after A-Z became a-z.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def _spaced() -> np.ndarray:
    t = np.ones(256, bool)
    t[list(SPACE_BYTES)] = False
    return t


def _alnum() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


NON_SPACE, ALNUM = _spaced(), _alnum()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            out = np.ones(size, U64)
            filled = 1
            while filled < size:  # doubling: the next block is the first one times base^filled
                more = min(filled, size - filled)
                out[filled : filled + more] = out[:more] * U64(pow(base, filled, 1 << 64))
                filled += more
        if size <= 2 * PIECE:
            _pow_cache[base] = out
        have = out
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of buf[t] * BASE^t over i <= t < j."""
    out = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]; equal bytes have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * powers(BASE_INV, len(prefix))[starts]
        return mix(h ^ ((ends - starts).astype(U64) << U64(56)))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offs: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text with one more at the end); words never cross texts."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = alphabet[buf]
    edges = inside[1:] != inside[:-1]  # edge before byte i
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    glued = cut[inside[cut] & inside[cut + 1]]  # a word ends and another starts where two texts meet
    starts = np.flatnonzero(edges & inside[1:])
    ends = np.flatnonzero(edges & inside[:-1])
    if len(glued):
        glued = np.unique(glued)
        starts = np.sort(np.concatenate([starts, glued]))
        ends = np.sort(np.concatenate([ends, glued]))
    return starts, ends, np.searchsorted(starts, offs)


_PLACES = mix(np.arange(1, 4097, dtype=U64) * U64(BASE))
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] (none empty): every 8 bytes are mixed with their place in the run before they are
    added up, so no pattern of bytes cancels out as it can in a polynomial modulo 2^64."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, U64)
    wide = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((wide[starts] & _LOW_BYTES[np.minimum(n, 8)]) ^ _PLACES[0])
    long = np.flatnonzero(n > 8)
    if len(long):
        chunks = (n[long] - 1) >> 3
        first = np.cumsum(chunks) - chunks
        place = np.arange(1, int(chunks.sum()) + 1) - np.repeat(first, chunks)
        at = np.repeat(starts[long], chunks) + 8 * place
        value = wide[at] & _LOW_BYTES[np.minimum(np.repeat(ends[long], chunks) - at, 8)]
        salt = _PLACES[place] if int(place.max()) < len(_PLACES) else mix((place + 1).astype(U64) * U64(BASE))
        with np.errstate(over="ignore"):
            out[long] += np.add.reduceat(mix(value ^ salt), first)
    with np.errstate(over="ignore"):
        return mix(out + n.astype(U64) * U64(CHAIN))


def word_hashes(buf: np.ndarray, offs: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word after A-Z became a-z, first word of each text with one more at the end)."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, alphabet)
    return hash_runs(low, starts, ends), first


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive items (len(hashes) - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, U64)
        for j in range(n):
            out = out * U64(CHAIN) + hashes[j : j + m]
    return mix(out)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc_mod(doc_ids, m: int) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo m (null counts as the empty text)."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % m for i in doc_ids), np.int64, len(doc_ids))
