"""Audio fragments: decoding, pitch classes, tempo, and what is broken."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefinder.operators import fragments

RATE = 22_050


def file_of(x, rate=RATE, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        top = (1 << (8 * width - 1)) - 1
        whole = np.round(np.repeat(x, channels) * top)
        w.writeframes((whole + 128).astype("u1").tobytes() if width == 1 else whole.astype(f"<i{width}").tobytes())
    return out.getvalue()


def chord(*names, seconds=2.0, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * 440 * 2 ** ((fragments.vocab.PITCHES.index(n) - 9) / 12) * t) for n in names) / len(names)


def clicks(bpm, seconds=12.0):
    x = np.zeros(int(seconds * RATE))
    for beat in np.arange(0.1, seconds, 60 / bpm):
        at = int(beat * RATE)
        x[at : at + 200] = np.random.default_rng(1).uniform(-0.9, 0.9, len(x[at : at + 200]))
    return x


@pytest.mark.parametrize(("width", "channels"), [(1, 1), (2, 1), (2, 2), (4, 2)])
def test_decoding(width, channels):
    x = chord("A", seconds=0.5)
    got, rate = fragments.decoded(file_of(x, width=width, channels=channels), 0.1, 0.2)
    assert rate == RATE and len(got) == int(0.2 * RATE)
    assert np.abs(got - x[int(0.1 * RATE) :][: len(got)]).max() < (0.02 if width == 1 else 1e-3)


def test_pitch_classes():
    for name in fragments.vocab.PITCHES:
        mean = fragments.pitch_classes(fragments.framed(chord(name), 4096, 2048), RATE).mean(axis=0)
        assert fragments.vocab.PITCHES[int(mean.argmax())] == name


@pytest.mark.parametrize("bpm", [60, 90, 120, 150])
def test_tempo_of_clicks(bpm):
    found, confidence = fragments.tempo(fragments.onsets(fragments.framed(clicks(bpm), 1024, 256)), 256 / RATE)
    assert min(abs(found - m * bpm) for m in (1, 0.5)) < 0.02 * bpm and 0.5 <= confidence <= 1


def test_autocorrelation():
    x = np.random.default_rng(3).random(57)
    assert np.allclose(fragments.autocorrelation(x), np.correlate(x, x, mode="full")[56:])


def test_query(spark):
    good = file_of(chord("C", "E", "G"))
    rows = [(1, good), (2, None), (3, b""), (4, good[:30]), (5, b"RIFF" + bytes(100)), (6, file_of(np.zeros(10))), (7, file_of(np.zeros(RATE))), (8, file_of(chord("A", "C", "E"))), (8, good)]
    got = fragments.analyzed(spark.createDataFrame(rows, "id long, data binary").withColumn("key", F.lit("x")), "id", "data").collect()
    found = {(r.id, r.key, r.error is None) for r in got}
    assert len(got) == len(rows) and {(1, "C major", True), (8, "A minor", True), (8, "C major", True), (7, "C major", True)} <= found
    assert {i for i, _, ok in found if not ok} == {2, 3, 4, 5} and [r.error for r in got if r.id == 2] == ["no data"]
    assert [(r.key_confidence, r.bpm) for r in got if r.id == 7] == [(0.0, None)]
    short = fragments.measured(spark.createDataFrame(rows[:1], "id long, data binary"), "id", "data", seconds=0.5).first()
    assert short.seconds == pytest.approx(0.5, abs=1e-3) and len(short.chroma[0]) == 12
    assert fragments.analyzed(spark.createDataFrame([], "id long, data binary"), "id", "data").count() == 0
