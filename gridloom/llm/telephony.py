"""Telephony audio columns: companded and ADPCM samples kept as WAV bytes, decoded to PCM.

mu-law and A-law bytes are expanded by 256-entry lookup tables built from the
companding rules. IMA ADPCM is decoded with numpy across blocks: step k of all
blocks is one vector operation. PCM, resampled to half or twice the rate, is stored in
a binary column beside the media.

A null text is empty; an empty payload is padded like any other, to one block.
Equal payloads give equal values. Columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_text, slices, written

BLOCK = 192
RATE = 8000
MULAW, ALAW, ADPCM = 7, 6, 0x11  # WAV format tags
_HEADER = struct.Struct("<4sI4s4sIHHIIHHH4sII")


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law byte."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law byte."""
    a = np.arange(256) ^ 0x55
    part, mantissa = (a >> 4) & 7, a & 15
    size = np.where(part == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def _compress(table: np.ndarray) -> np.ndarray:
    """For each 16-bit value (+32768) the byte of the nearest table value; the smaller value on ties."""
    order = np.argsort(table, kind="stable")
    values = table[order].astype(np.int32)
    mids = (values[:-1] + values[1:]) / 2
    return order[np.searchsorted(mids, np.arange(-32768, 32768), side="left")].astype(np.uint8)


def encode(pcm: np.ndarray, table: np.ndarray) -> np.ndarray:
    """PCM16 to companded bytes by the inverse lookup table."""
    return _compress(table)[pcm.astype(np.int32) + 32768]


# Fixed values of IMA ADPCM: index changes by code, and step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209
    230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499
    2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500
    20350 22385 24623 27086 29794 32767""".split(),
    np.int32,
)


def _changes() -> np.ndarray:
    """Change of the predictor by (step index, code)."""
    code = np.arange(16)
    step = STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


CHANGES = _changes()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM16 of IMA ADPCM blocks, an array (blocks, bytes): 4 header bytes, then two codes a byte, low half first.

    The header has the first sample (little-endian) and the step index, held to the table's range.
    """
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value -= (value & 0x8000) << 1
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    flat = CHANGES.ravel()
    for k in range(size - 4):
        for half in (0, 1):
            code = (codes[k] >> 4 if half else codes[k] & 15).astype(np.int32)
            value += flat[index * 16 + code]
            np.clip(value, -32768, 32767, out=value)
            index += INDEX_CHANGE[code]
            np.clip(index, 0, len(STEPS) - 1, out=index)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    if len(pcm):
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def resample_half(pcm: np.ndarray) -> np.ndarray:
    """Half the rate: the mean of each two samples; a last one alone is kept."""
    wide = pcm.astype(np.int32)
    return np.append((wide[: len(pcm) // 2 * 2 : 2] + wide[1::2]) >> 1, wide[len(pcm) // 2 * 2 :]).astype(np.int16)


def to_wav(payload: bytes, form: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file with 8-bit companded samples, or with ADPCM blocks of ``block`` bytes."""
    n = len(payload)
    pad = n & 1
    samples = n if form != ADPCM else n // block * (2 * block - 7)
    per_second = rate if form != ADPCM else rate * block // (2 * block - 7)
    head = _HEADER.pack(b"RIFF", 50 + n + pad, b"WAVE", b"fmt ", 18, form, 1, rate, per_second, block, 8 if form != ADPCM else 4, 0, b"fact", 4, samples)
    return head + struct.pack("<4sI", b"data", n) + payload + b"\0" * pad


def from_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, bytes in a block, sample bytes) of a WAV file; a file of another kind is an error."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, rate, block = 12, 0, 0, 1
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif kind == b"data":
            return form, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples in the WAV file")


def pcm_of(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a WAV file with mu-law, A-law or ADPCM samples; a last ADPCM block cut short is left out."""
    form, rate, block, payload = from_wav(media)
    data = np.frombuffer(payload, np.uint8)
    if form == ADPCM:
        return rate, adpcm_decode(data[: len(data) // block * block].reshape(-1, block)).ravel()
    if form not in (MULAW, ALAW):
        raise ValueError(f"WAV format {form} is not known")
    return rate, (_MULAW if form == MULAW else _ALAW)[data]


_MULAW, _ALAW = mulaw_table(), alaw_table()


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, rate and pcm: the text's bytes, spaces appended to whole blocks, as mu-law samples of a WAV file, and its PCM."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            media = [to_wav(r.ljust(max(BLOCK, -(-len(r) // BLOCK) * BLOCK))) for r in raw]
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "media": pa.array(media, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | _pcm_columns(media, 0.5))

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, rate int, pcm binary")


def _pcm_columns(media: list[bytes], ratio: float) -> dict[str, pa.Array]:
    """rate and pcm of WAV files, resampled by ``ratio`` (0.5 or 2)."""
    resample = {0.5: resample_half, 2: resample_double}[ratio]
    found = [pcm_of(m) for m in media]
    return {"rate": pa.array([int(r * ratio) for r, _ in found], pa.int32()), "pcm": pa.array([resample(p).astype("<i2").tobytes() for _, p in found], pa.binary())}


def with_pcm(media: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``media`` (doc_id, media: WAV files with mu-law, A-law or ADPCM samples) decoded: rate and pcm, 16-bit samples at ``ratio`` times the stored rate."""

    def run(batches):
        for batch in slices(batches, "media", 2 << 20):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | _pcm_columns(batch.column("media").to_pylist(), ratio))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, rate int, pcm binary")


def _said(name: str, pcm: np.ndarray) -> str:
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{name}={int(wide.sum())}/{int((wide * wide).sum())}/{int(wide.max())}/{int(wide.min())}/{crossings}"


def feature_of(payload: bytes, pcm: np.ndarray, decoded: np.ndarray | None = None) -> str:
    """The feature string: statistics of the samples expanded as mu-law, as A-law and decoded as ADPCM blocks, and of the stored PCM."""
    codes = np.frombuffer(payload, np.uint8)
    if decoded is None:
        decoded = adpcm_decode(codes.reshape(-1, BLOCK)).ravel()
    return f"{_said('mulaw', _MULAW[codes])};{_said('alaw', _ALAW[codes])};{_said('adpcm', decoded)};{_said('pcm', pcm)}/{zlib.crc32(pcm.tobytes()):08x}"


def media_report(media: DataFrame) -> DataFrame:
    """Reads stored media and PCM back: digests of payload and stored form, and a feature string.

    The feature has, for the samples expanded as mu-law, as A-law, decoded as ADPCM blocks,
    and of the stored PCM: sum, sum of squares, largest, smallest and sign changes; then
    the PCM's CRC-32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            media = batch.column("media").to_pylist()
            payloads = [from_wav(m)[3] for m in media]
            coded = adpcm_decode(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK))
            features, block = [], 0
            for p, pcm in zip(payloads, batch.column("pcm").to_pylist(), strict=True):
                n = len(p) // BLOCK
                features.append(feature_of(p, np.frombuffer(pcm, "<i2"), coded[block : block + n].ravel()))
                block += n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(features),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def audio_columns(docs: DataFrame) -> DataFrame:
    """Texts stored as audio in the shared folder, read back and described; one row a document."""
    return media_report(written(with_media(docs), "media"))
