"""Media columns (operator 1): audio stored losslessly, and features of the stored samples.

``store`` keeps a payload of bytes as the samples of a WAV file: one channel, 8 bits, unsigned.
``features`` reads the samples back from the stored bytes and takes

* polyphase resampling by UP / DOWN: each output phase has its own short filter, so no sample is
  computed that isn't kept;
* log-mel filterbanks of half-overlapping windows, cut into patches of one fixed shape;
* segments of the frames' energy with hysteresis: a segment opens above one level and closes
  below a lower one.

``read_patches`` reads patches that were written back as Arrow tensors of fixed shape.

Long audio is worked on in blocks, so memory doesn't grow with a payload's length beyond the
payload and its features.

Defined results: a null or empty text is 64 zero bytes; a null id stays null; repeated rows give
repeated rows, equal payloads equal values; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkwell.llm.common import id_text, slices, text_bytes

RATE, UP, DOWN, TAPS = 12_000, 2, 3, 16
FRAME, HOP, MELS = 256, 128, 24
#: Frames of a patch; a text's last patch is filled with the floor.
PATCH = 64
#: Patches that a task reads back at once.
PATCHES_AT_ONCE = 512
FLOOR_DB = -60.0
OPEN_DB, CLOSE_DB = 1.5, 0.5
#: Payloads are filled with zero bytes up to a positive multiple of this.
UNIT = 64
#: Frames worked on at once.
BLOCK_FRAMES = 8192
STORED = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, n_frames long, n_patches long, segments array<struct<start_s: double, end_s: double>>, "
    "mean_db double"
)
#: A row for each document: its features, and its patches in order, each tensor as the bytes of its 32-bit floats.
PATCHED = FEATURES + ", patches array<struct<start_s: double, end_s: double, log_mel: binary>>"
#: What ``read_patches`` adds: number, end of the last one's span, and SHA-256 of spans and tensors.
READ = "patches_read long, end_s double, tensors_sha256 string"
PATCHES = "doc_id long, patch long, start_s double, end_s double, log_mel array<float>"


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of a WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file with 8-bit samples, found by its chunk headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def _low_pass() -> np.ndarray:
    """A windowed-sinc filter at the lower of the two rates, split into its UP phases."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(t * cut) * cut * np.hamming(n)
    return np.ascontiguousarray((taps / taps.sum() * UP).reshape(TAPS, UP).T.astype(np.float32))


def _mel_bank() -> np.ndarray:
    """Triangles at even distances on the mel scale, one column each."""
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    at = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise = (at - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_PHASES, _BANK, _WINDOW = _low_pass(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs first to first + count of the resampled signal; it is zero outside of the samples."""
    out = np.empty(count, np.float32)
    for k in range(UP):  # outputs k, k + UP, ... share one phase
        n = len(range(k, count, UP))
        if not n:
            continue
        position = (first + k) * DOWN
        newest, phase = position // UP, position % UP
        lo, hi = newest - TAPS + 1, newest + (n - 1) * DOWN + 1
        part = samples[max(lo, 0) : max(hi, 0)]
        part = np.pad(part, (max(-lo, 0), max(0, hi - max(lo, 0) - len(part)) if hi > 0 else hi - lo - max(-lo, 0)))
        total = np.zeros(n, np.float32)
        for j, weight in enumerate(_PHASES[phase]):
            total += weight * part[TAPS - 1 - j :: DOWN][:n]
        out[k::UP] = total
    return out


def frame_count(n_samples: int) -> int:
    """Frames of the resampled signal; the last ones are filled with zeros."""
    return max(1, -(-max(0, n_samples * UP // DOWN - FRAME) // HOP) + 1)


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies in decibels, a row for each frame, and the frames' energies."""
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    frames = frame_count(len(samples))
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for lo in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - lo)
        signal = resample(samples, lo * HOP, (n - 1) * HOP + FRAME)
        windows = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * _WINDOW
        spectrum = np.fft.rfft(windows)
        power = spectrum.real**2 + spectrum.imag**2
        mels[lo : lo + n] = 10 * np.log10(np.maximum(power @ _BANK, 1e-6))
        energy[lo : lo + n] = 10 * np.log10(np.maximum((windows**2).mean(axis=1), 1e-6))
    return np.maximum(mels, FLOOR_DB), energy


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans in seconds whose energy rose OPEN_DB over the median and has not fallen under CLOSE_DB over it."""
    base = np.median(energy)
    mark = np.where(energy > base + OPEN_DB, 1, np.where(energy < base + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    seconds = HOP * DOWN / (RATE * UP)
    return [(float(a * seconds), float(b * seconds)) for a, b in zip(edges[::2], edges[1::2])]


def patches(mels: np.ndarray) -> np.ndarray:
    """The frames as tensors of the fixed shape (PATCH, MELS)."""
    count = -(-len(mels) // PATCH)
    out = np.full((count * PATCH, MELS), FLOOR_DB, np.float32)
    out[: len(mels)] = mels
    return out.reshape(count, PATCH, MELS)


def tensor_column(log_mels: pa.Array | pa.ChunkedArray) -> pa.ExtensionArray:
    """A log_mel column, as read from what ``log_mel_patches`` wrote or PATCHED holds, as Arrow tensors of fixed shape."""
    if isinstance(log_mels, pa.ChunkedArray):
        log_mels = log_mels.combine_chunks()
    if pa.types.is_binary(log_mels.type):
        values = pa.array(text_bytes(log_mels)[0].view(np.float32))
    else:
        values = log_mels.flatten().cast(pa.float32())
    flat = pa.FixedSizeListArray.from_arrays(values, PATCH * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS)), flat)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text's UTF-8) and media, the WAV file that holds the filled payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = [t.encode() for t in part.column(1).to_pylist()]
                media = [to_wav(b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT), b"\0")) for b in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, STORED)


def _patch_lists(mels: list[np.ndarray]) -> pa.Array:
    """For each text's log-mel energies the list of its patches, as in PATCHED."""
    seconds = HOP * DOWN / (RATE * UP)
    cut = [patches(m) for m in mels]
    many = np.array([len(c) for c in cut])
    k = np.concatenate([np.arange(n) for n in many])
    frames = np.repeat([len(m) for m in mels], many)
    offsets = (np.arange(len(k) + 1) * (4 * PATCH * MELS)).astype(np.int32)
    tensors = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(cut))])
    spans = [pa.array(k * PATCH * seconds), pa.array(np.minimum((k + 1) * PATCH, frames) * seconds)]
    rows = pa.StructArray.from_arrays([*spans, tensors], names=["start_s", "end_s", "log_mel"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), rows)


def features(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """Digests of the payload read back and of the stored form, frame and patch counts, segments, mean level.

    With ``tensors``, the patches too: their time spans and their log-mel tensors (see PATCHED).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in batches:
            for part in slices(batch, 2):
                rows, energies = [], []
                for media in part.column(2).to_pylist():
                    payload = from_wav(media)
                    mels, energy = log_mel(payload)
                    if tensors:
                        energies.append(mels)
                    rows.append(
                        (
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-UNIT:]),
                            len(media),
                            hashlib.sha256(media).hexdigest(),
                            len(mels),
                            -(-len(mels) // PATCH),
                            [{"start_s": a, "end_s": b} for a, b in segments(energy)],
                            float(mels.mean(dtype=np.float64)),
                        )
                    )
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), spans, pa.float64()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                names = [x.split()[0] for x in FEATURES.replace("array<struct<start_s: double, end_s: double>>", "a").split(", ")]
                if tensors:
                    columns.append(_patch_lists(energies))
                    names.append("patches")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PATCHED if tensors else FEATURES)


def _few_patches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about PATCHES_AT_ONCE patches each; a longer document stands alone."""
    if batch.num_rows:
        many = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // PATCHES_AT_ONCE)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def read_patches(written: DataFrame) -> DataFrame:
    """The columns of a table of PATCHED but the patches, and READ, taken from the patches as tensors."""
    others = [c for c in written.columns if c != "patches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few_patches(whole, len(others))):
            lists = batch.column(len(others))
            rows = lists.flatten()
            read = tensor_column(pc.struct_field(rows, "log_mel")).to_numpy_ndarray()
            spans = np.stack([pc.struct_field(rows, c).to_numpy(zero_copy_only=False) for c in ("start_s", "end_s")], axis=1)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            starts = np.append(0, ends[:-1]).astype(np.int64)
            digests = [
                hashlib.sha256(spans[a:b].tobytes() + read[a:b].tobytes()).hexdigest() for a, b in zip(starts.tolist(), ends.tolist())
            ]
            found = [pa.array(ends - starts, pa.int64()), pa.array(spans[ends - 1, 1]), pa.array(digests, pa.string())]
            names = [*others, *(x.split()[0] for x in READ.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *found], names=names)

    schema = FEATURES + ", " + READ
    return written.select(*others, "patches").mapInArrow(run, schema)


def log_mel_patches(stored: DataFrame) -> DataFrame:
    """A row for each patch: its time span and its log-mel tensor, flattened (see ``tensor_column``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds = HOP * DOWN / (RATE * UP)
        for batch in batches:
            for part in slices(batch, 2):
                for doc_id, media in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    mels, _ = log_mel(from_wav(media))
                    cut = patches(mels)
                    k = np.arange(len(cut))
                    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(cut).storage
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id] * len(cut), pa.int64()),
                            pa.array(k, pa.int64()),
                            pa.array(k * PATCH * seconds),
                            pa.array(np.minimum((k + 1) * PATCH, len(mels)) * seconds),
                            tensors.cast(pa.list_(pa.float32())),
                        ],
                        names=["doc_id", "patch", "start_s", "end_s", "log_mel"],
                    )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PATCHES)
