"""Media columns: WAV bytes, short-time Fourier transforms and peak-pair fingerprints.

A WAV is read by the ``wave`` module, brought to one channel, and cut into
overlapping frames under a Hann window. A spectral peak is a cell of the
spectrogram that is louder than all cells around it and than the frame's mean;
each peak is paired with the next few peaks of its target zone, and the pair's
two frequencies and distance in time make a hash that doesn't depend on where in
the recording it lies. Fingerprints are two arrays of equal length: frame
numbers and hashes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a frame and between frames.
FRAME, HOP = 512, 256
#: A peak is the loudest within so many frames and bins to each side, at least LOUDER times its frame's mean.
NEAR_FRAMES, NEAR_BINS, LOUDER = 2, 6, 2.0
#: Pairs of a peak, and the frames ahead that its partners lie in.
FAN_OUT, AHEAD = 5, 32
#: Frames transformed at once, so that a long recording takes bounded memory.
BLOCK = 4096


def read_wav(data: bytes | None) -> tuple[int, np.ndarray] | None:
    """(samples a second, samples between -1 and 1); None for what isn't a PCM WAV of 8, 16, 24 or 32 bits."""
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            x = _samples(w.readframes(w.getnframes()), width, channels)
    except (wave.Error, EOFError, RuntimeError):
        return None
    return None if x is None else (rate, x)


def _samples(raw: bytes, width: int, channels: int) -> np.ndarray | None:
    """One channel of samples between -1 and 1; None for a width that PCM doesn't have."""
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    elif width == 4:
        x = (np.frombuffer(raw, "<i4") / (1 << 31)).astype(np.float32)
    else:
        return None
    return x.reshape(-1, channels).mean(axis=1, dtype=np.float32) if channels > 1 else x


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV of samples between -1 and 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def stft(samples: np.ndarray) -> np.ndarray:
    """Magnitudes, a row for each frame and FRAME / 2 + 1 bins; the last frame is padded with silence."""
    if not len(samples):
        return np.zeros((0, FRAME // 2 + 1), np.float32)
    many = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((many - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.concatenate([np.abs(np.fft.rfft(frames[k : k + BLOCK] * _WINDOW, axis=1)).astype(np.float32) for k in range(0, many, BLOCK)])


def _moving_max(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Largest value within ``reach`` to each side, by doubling windows."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    y = np.pad(x, pad, constant_values=-1)
    have, want = 1, 2 * reach + 1
    while have < want:
        step = min(have, want - have)
        y = np.maximum(y[step:], y[:-step]) if axis == 0 else np.maximum(y[:, step:], y[:, :-step])
        have += step
    return y


def peaks(spectrum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks by frame and bin; of equal neighbours all are peaks."""
    if not len(spectrum):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    around = _moving_max(_moving_max(spectrum, NEAR_FRAMES, 0), NEAR_BINS, 1)
    floor = np.maximum(spectrum.mean(axis=1, keepdims=True) * LOUDER, 1e-3)
    return np.nonzero((spectrum == around) & (spectrum > floor))


def pairs(frame: np.ndarray, bin_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, hash) of each peak with the next FAN_OUT peaks that lie 1 to AHEAD frames later, by frame and hash."""
    times, hashes = [], []
    first = np.searchsorted(frame, frame + 1)
    for k in range(FAN_OUT):
        other = first + k
        ok = other < len(frame)
        i, j = np.flatnonzero(ok), other[ok]
        near = frame[j] - frame[i] <= AHEAD
        i, j = i[near], j[near]
        times.append(frame[i])
        hashes.append((bin_[i] << 32) | (bin_[j] << 16) | (frame[j] - frame[i]))
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order], h[order]


def fingerprint(data: bytes | None, block: int = BLOCK) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(rate, samples, frame numbers, hashes) of a WAV, or None.

    The recording is read and transformed ``block`` frames at once, with the few
    around them that their peaks are held against; only the peaks stay.
    """
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            if _samples(b"", width, channels) is None:
                return None
            total, step = 0, HOP * block
            while n := len(w.readframes(step)) // (width * channels):
                total += n
            many = -(-max(0, total - FRAME) // HOP) + 1 if total else 0
            frames, bins = [], []
            for k in range(0, many, block):
                a, b = max(0, k - NEAR_FRAMES), min(many, k + block + NEAR_FRAMES)
                w.setpos(a * HOP)
                part = _samples(w.readframes(min(total - a * HOP, (b - a - 1) * HOP + FRAME)), width, channels)
                spectrum = stft(np.concatenate([part, np.zeros((b - a - 1) * HOP + FRAME - len(part), np.float32)]))
                frame, bin_ = peaks(spectrum)
                own = (frame + a >= k) & (frame + a < k + block)
                frames.append(frame[own] + a)
                bins.append(bin_[own])
    except (wave.Error, EOFError, RuntimeError):
        return None
    none = np.zeros(0, np.int64)
    return rate, total, *pairs(np.concatenate([none, *frames]), np.concatenate([none, *bins]))


PRINTS = "rate int, n_samples long, n_pairs int, times array<int>, hashes array<long>"


def fingerprints(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, rate, n_samples, n_pairs, times, hashes) for every row of a table with a column of WAV bytes.

    Null bytes and bytes that aren't a PCM WAV give null for all but the key, a WAV
    without samples or peaks gives empty arrays. Rows are answered one by one,
    null keys and repeated rows too; other columns, whatever their names, don't matter.
    An empty table gives an empty result. Recordings of any length are read whole,
    a block of frames at once; of equally loud neighbours all are peaks.
    """
    kind = media.schema[key].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f and f[0] for f in found], pa.int32()),
                    pa.array([f and f[1] for f in found], pa.int64()),
                    pa.array([f and len(f[2]) for f in found], pa.int32()),
                    pa.array([f and f[2] for f in found], pa.list_(pa.int32())),
                    pa.array([f and f[3] for f in found], pa.list_(pa.int64())),
                ],
                [key, "rate", "n_samples", "n_pairs", "times", "hashes"],
            )

    return media.select(key, column).mapInArrow(emit, f"`{key}` {kind}, {PRINTS}")


def read_wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, wav) of the .wav files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", F.col("content").alias("wav"))


def matches(prints: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query, key, offset, votes): for each query and recording that share pairs, the shift in frames that most pairs agree on.

    Of shifts with equal votes the least counts. Both sides have the columns of
    ``fingerprints``; every query row is answered.
    """

    def flat(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(name), F.explode(F.arrays_zip("times", "hashes")).alias("p")).select(name, F.col("p.times").alias(f"{name}_t"), F.col("p.hashes").alias("hash"))

    votes = (
        flat(queries, "query").join(flat(prints, "found"), "hash")
        .groupBy("query", "found", (F.col("found_t") - F.col("query_t")).alias("offset"))
        .agg(F.count("*").alias("votes"))
    )
    best = votes.groupBy("query", "found").agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.col("offset"))).alias("b"))
    return best.select("query", F.col("found").alias(key), "b.offset", "b.votes")


#: The tables have no recordings: every embedding is played as a tune of a note a component.
RATE, NOTE = 8000, 250


def tune(vector: np.ndarray) -> np.ndarray:
    """Samples of a tune: component v sounds as a note of 300 to 3300 Hz, by the rank of tanh(2 v)."""
    pitch = 1800 + 1500 * np.tanh(2 * np.nan_to_num(np.asarray(vector, np.float64)))
    t = np.arange(NOTE) / RATE
    fade = np.sin(np.pi * (np.arange(NOTE) + 0.5) / NOTE)
    return (0.8 * fade * np.sin(2 * np.pi * pitch[:, None] * t)).ravel()


def recordings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, wav): the embeddings as WAV bytes; a null or empty vector has null bytes, a null component sounds as 0."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # 32 kB a row
                some = batch.slice(k, 256)
                wavs = [write_wav(tune([0.0 if c is None else c for c in v]), RATE) if v else None for v in some.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(wavs, pa.binary())], ["vec_id", "wav"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(emit, "vec_id long, wav binary")


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the tunes of all embeddings."""
    return fingerprints(recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id", "wav")


QUERIES = {"op9_audio_fingerprints": op9_audio_fingerprints}
