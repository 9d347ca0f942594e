"""Audio fragments in a binary column: decoding, pitch classes, onsets and tempo, in Arrow batches.

A fragment that can not be decoded gives a row with its error and no values; it stops nothing else. Samples beyond the
asked length are never decoded, so that a row's memory is bounded by it.
"""

from __future__ import annotations

import functools
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.functions import vocab
from lodefinder.operators import audio

#: Seconds of a fragment, samples of a frame and between frames, octaves of the pitches (4 holds 440 Hz), tempi.
SECONDS, FRAME, HOP, OCTAVES, TEMPI = 45.0, 2048, 512, (2, 3, 4, 5, 6), (30.0, 300.0)
BATCH = 16


def decoded(data: bytes, start: float, seconds: float) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 of at most that many seconds from start on, and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        if rate <= 0 or width not in (1, 2, 4):
            raise ValueError(f"{8 * width} bit at {rate} Hz")
        w.setpos(min(int(start * rate), w.getnframes()))
        raw = w.readframes(int(seconds * rate))
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if not raw:
        raise ValueError("no samples")
    x = np.frombuffer(raw, dtype={1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encoded(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit file of samples that are whole numbers."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames of size samples under a Hann window; a shorter signal is one frame, filled up with zeros."""
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size))


@functools.lru_cache(maxsize=4)
def waves(size: int, rate: int, octaves: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pitches of the octaves lie below half the rate, and their cosines and sines over a frame."""
    steps = np.array([12 * (o - 4) + p - 9 for o in octaves for p in range(12)])
    frequency = 440 * 2 ** (steps / 12)
    heard = frequency < rate / 2
    angle = 2 * np.pi * np.outer(np.arange(size), frequency[heard]) / rate
    return heard, np.cos(angle), np.sin(angle)


def pitch_classes(frames: np.ndarray, rate: int, octaves: tuple[int, ...] = OCTAVES) -> np.ndarray:
    """Twelve magnitudes for each frame: the Fourier transform at the pitches of the octaves, below half the rate."""
    heard, cosines, sines = waves(frames.shape[1], rate, octaves)
    found = np.zeros((len(frames), len(heard)))
    found[:, heard] = np.hypot(frames @ cosines, frames @ sines)
    return found.reshape(len(frames), len(octaves), 12).sum(axis=1)


def onsets(frames: np.ndarray) -> np.ndarray:
    """Spectral flux: how much louder the bands of each frame are than those of the one before, 0 for the first."""
    loud = np.log1p(1000 * np.abs(np.fft.rfft(frames, axis=1)))
    return np.append(0.0, np.maximum(np.diff(loud, axis=0), 0).mean(axis=1))


def autocorrelation(series: np.ndarray) -> np.ndarray:
    """At lags 0 and up, by Fourier transforms."""
    size = 1 << (2 * len(series) - 1).bit_length()
    power = np.abs(np.fft.rfft(series, size)) ** 2
    return np.fft.irfft(power, size)[: len(series)]


def tempo(flux: np.ndarray, step: float) -> tuple[float | None, float]:
    """(beats a minute with one decimal, confidence): the best lag between the tempi, refined between its neighbours.

    The confidence is that of audio.periodicity. None where the fragment is too short for two beats or has no onsets.
    """
    confidence = audio.periodicity(flux)
    if len(flux) < 2:
        return None, confidence
    ac = autocorrelation(flux - flux.mean())
    low, high = max(1, int(np.ceil(60 / TEMPI[1] / step))), min(len(ac) - 2, int(60 / TEMPI[0] / step))
    if high < low or ac[0] <= 1e-12:
        return None, confidence
    lag = low + int(np.argmax(ac[low : high + 1]))
    a, b, c = ac[lag - 1 : lag + 2]
    bend = a - 2 * b + c
    return round(60 / ((lag + (0.5 * (a - c) / bend if bend < 0 else 0.0)) * step), 1), confidence


FIELDS = [("seconds", T.DoubleType()), ("chroma", T.ArrayType(T.ArrayType(T.DoubleType()))), ("bpm", T.DoubleType()), ("bpm_confidence", T.DoubleType()), ("error", T.StringType())]


def measured(fragments: DataFrame, id_col: str, data_col: str, start: float | None = None, seconds: float | None = None, frame: int = FRAME, hop: int = HOP, octaves: tuple[int, ...] = OCTAVES) -> DataFrame:
    """(id, seconds, chroma, bpm, bpm_confidence, error): what each fragment sounds like, or why that is not known.

    chroma has twelve values for each frame. No or zero seconds mean SECONDS; a null fragment has the error 'no data'.
    """
    first, length = start or 0.0, seconds or SECONDS
    narrow = fragments.select(id_col, data_col)
    schema = T.StructType([narrow.schema[id_col], *(T.StructField(n, t) for n, t in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.float64(), pa.list_(pa.list_(pa.float64())), pa.float64(), pa.float64(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch, rows = whole.slice(at, BATCH), []
                for data in batch.column(1):
                    try:
                        if not data.is_valid:
                            raise ValueError("no data")
                        x, rate = decoded(data.as_py(), first, length)
                        frames = framed(x, frame, hop)
                        rows.append((len(x) / rate, pitch_classes(frames, rate, octaves).tolist(), *tempo(onsets(frames), hop / rate), None))
                    except (ValueError, EOFError, wave.Error) as e:
                        rows.append((None, None, None, None, str(e) or type(e).__name__))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(n for n, _ in FIELDS)])

    return narrow.mapInArrow(run, schema)


def analyzed(fragments: DataFrame, id_col: str, data_col: str, **options) -> DataFrame:
    """(id, bpm, bpm_confidence, key, key_confidence, error) of each fragment; see measured for the options."""
    made = measured(fragments, id_col, data_col, **options)
    k = F.when(F.col("chroma").isNotNull(), audio.key_estimate(audio.chroma_profile(F.col("chroma"))))
    return made.select(id_col, "bpm", "bpm_confidence", k.alias("k"), "error").select(id_col, "bpm", "bpm_confidence", F.col("k.key").alias("key"), F.col("k.confidence").alias("key_confidence"), "error")


def tones(vectors: DataFrame, id_col: str, vector_col: str, rate: int, samples: int) -> DataFrame:
    """(id, data): a fragment for each vector, the twelve pitches from 261.6 Hz up as loud as its first twelve components."""
    narrow = vectors.select(id_col, F.transform(F.slice(vector_col, 1, len(vocab.PITCHES)), lambda x: F.abs(x.cast("double"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave_of = np.sin(2 * np.pi * np.outer(440 * 2 ** ((np.arange(12) - 9) / 12), np.arange(samples)) / rate)
        for batch in batches:
            made = [encoded(np.floor(32767 * (np.array(v) @ wave_of) / max(sum(v), 1e-300) + 0.5), rate) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_col, "data"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema[id_col], T.StructField("data", T.BinaryType())]))
