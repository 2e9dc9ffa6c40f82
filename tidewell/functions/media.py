"""Scalar rules of streaming media: time, levels, codecs, ladders, delivery, keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score limits of the grades, from the best.
GRADES = ((0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor"))
GRADE_ORDER = ("critical", "poor", "fair", "good", "excellent")
#: Attempts, first delay, growth and longest delay of the retry presets.
RETRY = {"default": (3, 1.0, 2.0, 30.0), "aggressive": (5, 0.5, 1.5, 10.0), "conservative": (2, 2.0, 3.0, 60.0)}
#: Window seconds, alert and critical ratio and least samples of the bandwidth presets.
BANDWIDTH = {"standard": (10.0, 0.9, 0.5, 3), "aggressive": (5.0, 0.95, 0.5, 2), "conservative": (30.0, 0.8, 0.4, 5)}
#: Name, width, height, video and audio bits a second of the quality presets.
QUALITY = (
    ("360p", 640, 360, 800_000, 64_000), ("480p", 854, 480, 1_400_000, 96_000), ("720p", 1280, 720, 2_800_000, 128_000),
    ("1080p", 1920, 1080, 5_000_000, 128_000), ("2160p", 3840, 2160, 14_000_000, 192_000)
)
#: Loudness targets.
LOUDNESS = {"podcast": -16.0, "music": -14.0, "broadcast": -23.0, "film": -24.0}


def grade(score: Column) -> Column:
    """Strict limits: above 0.9 is excellent, and so on down to critical."""
    out = F.lit("critical")
    for limit, name in reversed(GRADES):
        out = F.when(score > limit, name).otherwise(out)
    return out


def grade_ordinal(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GRADE_ORDER)), name).cast("int") - 1


def effective_grade(state: Column, quality: Column) -> Column:
    """A lost connection is critical; without a measurement a pending one is poor, a live one good."""
    return F.when(state.isin("disconnected", "failed"), "critical").when(
        state.isin("connecting", "reconnecting"), F.coalesce(quality, F.lit("poor"))
    ).otherwise(F.coalesce(quality, F.lit("good")))


def backoff(attempt: Column, base: float = 1.0, growth: float = 2.0, longest: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(growth), attempt), F.lit(longest))


def ticks(seconds: Column, timescale: Column) -> Column:
    """Truncated towards zero."""
    return (seconds * timescale).cast("long")


def rescale(value: Column, source: Column, target: Column) -> Column:
    """Integer value * target / source, no less than 0."""
    product = value.cast("long") * target.cast("long")
    return F.greatest(F.lit(0).cast("long"), ((product - product % source) / source).cast("long"))


def decibels(x: Column) -> Column:
    """20 log10(x); null where the level is nothing (-inf)."""
    return F.when(x > 0, 20 * F.log10(x))


def lufs(energy: Column) -> Column:
    return F.when(energy > 0, -0.691 + 10 * F.log10(energy))


def aspect_ratio(width: Column, height: Column) -> Column:
    """w:h in lowest terms."""
    # Euclid's steps as a fold; 64 suffice for any int
    gcd = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), F.struct(width.cast("long").alias("a"), height.cast("long").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    )["a"]
    return F.concat((width / gcd).cast("long").cast("string"), F.lit(":"), (height / gcd).cast("long").cast("string"))


def hold_back(explicit: Column, target: Column) -> Column:
    return F.coalesce(explicit, target * 3)


def iv_hex(sequence: Column) -> Column:
    """The 128-bit big-endian IV of a sequence number."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(sequence.cast("long"))), 32, "0"))


def avc_codec(profile: Column, constraint: Column, level: Column) -> Column:
    """avc1.PPCCLL"""
    two = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")
    return F.concat(F.lit("avc1."), two(profile), two(constraint), two(level))


def instream_id(standard: Column, service: Column) -> Column:
    """CCn for 608 channels, SERVICEn for 708 services."""
    return F.concat(F.when(standard == "608", "CC").otherwise("SERVICE"), service.cast("string"))


def scale_preset(src_w: Column, src_h: Column, src_rate: Column, w: Column, h: Column, rate: Column) -> Column:
    """struct(width, height, rate) without upscaling: beyond the source in a dimension, the source's size and the lower rate."""
    over = (w > src_w) | (h > src_h)
    return F.struct(
        F.when(over, src_w).otherwise(w).alias("width"), F.when(over, src_h).otherwise(h).alias("height"),
        F.when(over, F.least(rate, src_rate)).otherwise(rate).alias("rate")
    )


def packed_language(code: Column) -> Column:
    """Three 5-bit letters."""
    letter = lambda n: F.chr((F.shiftright(code, n).bitwiseAND(31) + 96).cast("long"))
    return F.concat(letter(10), letter(5), letter(0))


def is_vcl(codec: Column, nal: Column) -> Column:
    """Whether a NAL unit type carries picture data."""
    return F.when(codec == "h264", nal.between(1, 5)).when(codec == "h265", nal <= 31).otherwise(F.lit(False))


def is_keyframe(codec: Column, nal: Column) -> Column:
    return F.when(codec == "h264", nal == 5).when(codec == "h265", nal.isin(19, 20, 21)).otherwise(F.lit(False))


def hevc_nal_type(byte: Column) -> Column:
    return F.shiftright(byte, 1).bitwiseAND(63)


def pts(seconds: Column) -> Column:
    return (seconds * 90000).cast("long")


# PCM, on arrays of samples

HALF = math.sqrt(0.5)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def int16_to_float(a: Column) -> Column:
    return F.transform(a, lambda x: x / 32768.0)


def float_to_int16(a: Column) -> Column:
    return F.transform(a, lambda x: (clamp(x.cast("double")) * 32767).cast("int"))


def int16_to_int32(a: Column) -> Column:
    return F.transform(a, lambda x: F.shiftleft(x.cast("int"), 16))


def int32_to_int16(a: Column) -> Column:
    return F.transform(a, lambda x: F.shiftright(x.cast("int"), 16))


def deinterleave(a: Column, channels: int) -> Column:
    """Frame-major samples to one array per channel."""

    def plane(channel: int) -> Column:
        return F.filter(a, lambda _, i: i % channels == channel)

    return F.array(*map(plane, range(channels)))


def interleave(planes: Column) -> Column:
    """The inverse."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(planes[0]) - 1), lambda i: F.transform(planes, lambda p: F.get(p, i))))


def mono_to_stereo(a: Column, equal_power: bool = False) -> Column:
    g = HALF if equal_power else 1.0
    return F.flatten(F.transform(a, lambda x: F.array(x * g, x * g)))


def stereo_to_mono(a: Column) -> Column:
    """The mean of each pair."""
    return F.transform(F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1), lambda i: (F.get(a, 2 * i) + F.get(a, 2 * i + 1)) / 2)


def mix(a: Column, matrix: list[list[float]]) -> Column:
    """Interleaved frames times a matrix (rows: outputs), clamped to full scale."""
    n_in = len(matrix[0])
    frames = F.sequence(F.lit(0), (F.size(a) / n_in).cast("int") - 1)
    return F.flatten(
        F.transform(
            frames,
            lambda f: F.array(
                *[clamp(sum((F.get(a, f * n_in + i).cast("double") * g for i, g in enumerate(row) if g), F.lit(0.0))) for row in matrix]
            )
        )
    )


#: Left, right, centre, effects, left and right surround to stereo.
SURROUND_51 = [[1, 0, HALF, 0, HALF, 0], [0, 1, HALF, 0, 0, HALF]]


def resample_linear(a: Column, source: int, target: int) -> Column:
    """Linear interpolation at i * source / target, neighbours clamped; ceil(n * target / source) samples."""
    n = F.size(a)
    count = F.ceil(n * F.lit(float(target)) / source).cast("int")

    def at(i: Column) -> Column:
        pos = i * (float(source) / float(target))
        low = F.floor(pos).cast("int")
        x0 = F.get(a, F.least(low, n - 1)).cast("double")
        x1 = F.get(a, F.least(low + 1, n - 1)).cast("double")
        return x0 + (x1 - x0) * (pos - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def simple_ratio(source: Column, target: Column) -> Column:
    """Whether one of two positive rates is, within a thousandth, a whole multiple of the other."""
    whole = lambda x: F.abs(x - F.round(x)) < 0.001
    return F.when((source > 0) & (target > 0), whole(target / source) | whole(source / target)).otherwise(False)


def true_peak(a: Column) -> Column:
    """Largest magnitude of the samples and of three cubic interpolations after each, edges repeated."""
    n = F.size(a)
    x = lambda i: F.get(a, F.greatest(F.lit(0), F.least(n - 1, i))).cast("double")

    def cubic(i: Column, t: float) -> Column:
        y0, y1, y2, y3 = x(i - 1), x(i), x(i + 1), x(i + 2)
        a0 = y3 - y2 - y0 + y1
        return F.abs(a0 * t**3 + (y0 - y1 - a0) * t**2 + (y2 - y0) * t + y1)

    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda m, i: F.greatest(m, F.abs(x(i)), cubic(i, 0.25), cubic(i, 0.5), cubic(i, 0.75))
    )


def rms(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(a))


def peak(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))


def normalise(a: Column, measured: Column, target: float, limit: float = -1.0) -> Column:
    """Gain to `target`, less if the true peak would pass `limit` dB; silence (null level) passes through."""
    gain = F.lit(target) - measured
    over = decibels(true_peak(a)) + gain - limit
    gain = F.when(over > 0, gain - over).otherwise(gain)
    # the factor is bound to a variable, else every sample would work it out anew
    factor = F.array(F.coalesce(F.pow(F.lit(10.0), gain / 20), F.lit(1.0)))
    return F.element_at(F.transform(factor, lambda g: F.transform(a, lambda x: clamp(x.cast("double") * g))), 1)


def box_filter(a: Column, half: int) -> Column:
    """Centred mean over up to 2 * half + 1 samples, fewer at the edges."""
    n = F.size(a)

    def at(_: Column, i: Column) -> Column:
        low = F.greatest(i - half, F.lit(0))
        part = F.slice(a, low + 1, F.least(i + half, n - 1) - low + 1)
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(part)

    return F.transform(a, at)


def resample_medium(a: Column, source: int, target: int) -> Column:
    """Linear after a box filter of half the ratio when going down."""
    half = max(1, int(source / target / 2)) if target < source else 0
    return resample_linear(box_filter(a, half) if half else a, source, target)


def resample_lanczos(a: Column, source: int, target: int, lobes: int = 4) -> Column:
    """Windowed sinc with normalised weights; the window widens with the ratio when going down."""
    n, ratio = F.size(a), float(source) / float(target)
    scale = max(1.0, ratio)
    reach = lobes * scale
    count = F.ceil(n * F.lit(float(target)) / source).cast("int")
    sinc = lambda x: F.when(F.abs(x) < 1e-9, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))

    def at(i: Column) -> Column:
        pos = i * ratio
        near = F.sequence(F.greatest(F.lit(0), F.ceil(pos - reach).cast("int")), F.least(n - 1, F.floor(pos + reach).cast("int")))

        def add(s: Column, j: Column) -> Column:
            x = (pos - j) / scale
            w = sinc(x) * sinc(x / lobes)
            return F.struct((s["v"] + w * F.get(a, j).cast("double")).alias("v"), (s["w"] + w).alias("w"))

        total = F.aggregate(near, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), add)
        return F.element_at(F.transform(F.array(total), lambda t: F.when(F.abs(t["w"]) > 1e-12, t["v"] / t["w"]).otherwise(0.0)), 1)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def float_to_int32(a: Column) -> Column:
    return F.transform(a, lambda x: (clamp(x.cast("double")) * 2147483647.0).cast("long"))


def int32_to_float(a: Column) -> Column:
    return F.transform(a, lambda x: x / 2147483648.0)


#: Left, right, centre, effects, left and right side, left and right rear to stereo.
SURROUND_71 = [[1, 0, HALF, 0, HALF, 0, HALF, 0], [0, 1, HALF, 0, 0, HALF, 0, HALF]]


def byte_swap(data: Column, width: int) -> Column:
    """Reverses the bytes of each sample of `width` bytes."""
    hexed = F.regexp_extract_all(F.hex(data), F.lit("." * (2 * width)), 0)
    return F.unhex(F.array_join(F.transform(hexed, lambda h: F.array_join(F.reverse(F.regexp_extract_all(h, F.lit(".."), 0)), "")), ""))


def frames_in(size: Column, channels: int, width: int) -> Column:
    return F.floor(size / (channels * width)).cast("long")


def seconds_in(size: Column, channels: int, width: int, rate: int) -> Column:
    return frames_in(size, channels, width) / float(rate)


def bytes_for(seconds: Column, channels: int, width: int, rate: int) -> Column:
    return (seconds * rate).cast("long") * (channels * width)
