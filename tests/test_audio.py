"""Levels, loudness and resampling against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import media as M
from tidewell.operators import audio


def signal(amplitude, n=4800, rate=4800, hz=100, channels=2):
    x = amplitude * np.sin(2 * np.pi * hz * np.arange(n) / rate)
    return np.repeat(x, channels).tolist()


def filtered(x, rate):
    for b, a in audio.K_WEIGHTING.get(rate, audio.K_WEIGHTING[48000]):
        y, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in x:
            out = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x2, x1, y2, y1 = x1, v, y1, out
            y.append(out)
        x = y
    return x


def test_loudness_against_loop(spark):
    rate, rng = 1000, np.random.default_rng(1)
    x = rng.normal(0, 0.1, 5000)
    left, right = x, x * 0.5
    df = spark.createDataFrame([(1, np.stack([left, right], 1).ravel().tolist()), (2, [0.0] * 8000), (3, []), (4, None), (5, [0.1] * 10)], "id long, s array<double>")
    rows = {r.id: r for r in audio.loudness(df, "id", "s", 2, rate).collect()}
    e = [(a * a + b * b) / 2 for a, b in zip(filtered(left, rate), filtered(right, rate))]
    level = lambda v: -0.691 + 10 * math.log10(v)
    blocks = [sum(e[i : i + 400]) / 400 for i in range(0, len(e) - 399, 100)]
    gate = level(sum(blocks) / len(blocks)) - 10
    kept = [b for b in blocks if level(b) > gate]
    assert rows[1].integrated == pytest.approx(level(sum(kept) / len(kept)), abs=1e-6)
    assert rows[1].momentary == pytest.approx(level(sum(e[-400:]) / 400), abs=1e-6) and rows[1].short_term == pytest.approx(level(sum(e[-3000:]) / 3000), abs=1e-6)
    for i in (2, 3, 4, 5):
        assert rows[i].integrated is None and rows[i].momentary is None


def test_levels(spark):
    df = spark.createDataFrame([(1, signal(0.5, channels=1)), (2, [0.0] * 10), (3, [])], "id long, s array<double>")
    rows = {r.id: r for r in audio.block_levels(df, "s").collect()}
    assert rows[1].rms == pytest.approx(0.5 / math.sqrt(2), abs=1e-3) and rows[1].peak == pytest.approx(0.5, abs=1e-3) and rows[1].true_peak >= rows[1].peak
    assert (rows[2].rms, rows[2].peak, rows[3].rms) == (0.0, 0.0, 0.0)


def test_channels_and_pcm(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    a = F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))
    assert one(M.interleave(M.deinterleave(a, 2))) == [0.1, 0.2, 0.3, 0.4]
    assert one(M.mono_to_stereo(F.array(F.lit(1.0)))) == [1.0, 1.0] and one(M.stereo_to_mono(a)) == pytest.approx([0.15, 0.35])
    assert one(M.mix(F.array(*map(F.lit, (1.0, 1.0, 1.0, 0.0, 1.0, 1.0))), M.SURROUND_51)) == [1.0, 1.0]
    assert one(M.mix(F.array(*map(F.lit, (0.1, 0.2, 0.1, 0.0, 0.1, 0.1, 0.1, 0.1))), M.SURROUND_71)) == pytest.approx([0.1 + 0.3 * M.HALF, 0.2 + 0.3 * M.HALF])
    assert one(M.int16_to_int32(F.array(F.lit(2)))) == [131072] and one(M.int32_to_int16(F.array(F.lit(131072)))) == [2]
    assert one(M.float_to_int32(F.array(F.lit(-2.0)))) == [-2147483647] and one(M.int32_to_float(F.array(F.lit(1 << 30)))) == [0.5]
    assert bytes(one(M.byte_swap(F.lit(bytearray(b"\1\2\3\4")), 2))) == b"\2\1\4\3"
    assert one(M.frames_in(F.lit(1000), 2, 2)) == 250 and one(M.seconds_in(F.lit(1000), 2, 2, 250)) == 1.0 and one(M.bytes_for(F.lit(1.0), 2, 2, 250)) == 1000
    assert one(M.packed_language(F.lit((5 << 10) | (14 << 5) | 7))) == "eng"
    assert one(M.rescale(F.lit(90000), F.lit(90000), F.lit(48000))) == 48000 and one(M.ticks(F.lit(1.9999), F.lit(10))) == 19


def test_silence_regions(spark):
    rows = [(1, i, 0.5 if 3 <= i < 6 else 0.0001) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, i long, rms double")
    got = sorted((r.start, r.end) for r in audio.silence(df, ["k"], "i", "rms", 0.5, 1.0).collect())
    assert got == [(0.0, 1.5), (3.0, 5.0)]
