"""Sample encryption against a block cipher written out here."""

from pyspark.sql import functions as F

from tidewell.operators import crypto
from tidewell.sources import binary as B

KEY, IV = bytes(range(16)), bytes(range(100, 116))


def test_video_and_audio_round_trip(spark):
    picture = bytes([0x65]) + bytes(i * 7 % 251 + 2 for i in range(200))
    short = bytes([0x41]) + b"\x05" * 40
    video = b"".join(b"\0\0\0\1" + u for u in (b"\x67sps", picture, short, b"\x06sei" + b"\x09" * 90, bytes([0x41]) + b"\x07" * 49))
    audio = b"junk" + B.adts_header(2, 44100, 2, 100) + bytes(range(100)) + B.adts_header(2, 44100, 2, 20) + b"y" * 20 + b"\xff"
    key, iv = F.lit(KEY), F.lit(IV)
    for kind, data, clear in (("video", video, [(0, 4 + 4 + 4 + 1 + 32)]), ("audio", audio, [(0, 4 + 7 + 16)])):
        files = spark.createDataFrame([("a", data), ("e", b"")], "path string, content binary")
        sealed = crypto.sample_crypt(files, kind, key, iv)
        rows = {r.path: bytes(r.crypted) for r in sealed.collect()}
        assert rows["e"] == b"" and len(rows["a"]) == len(data) and rows["a"] != data
        for a, b in clear:
            assert rows["a"][a:b] == data[a:b]
        back = crypto.sample_crypt(sealed.withColumnRenamed("crypted", "content"), kind, key, iv, decrypt=True)
        assert {r.path: bytes(r.crypted) for r in back.collect()} == {"a": data, "e": b""}
    # the protected blocks are CBC of their own, from the same IV
    at = video.index(picture) + 1 + 32
    n = (len(picture) - 33) // 16 * 16
    sealed = {r.path: bytes(r.crypted) for r in crypto.sample_crypt(spark.createDataFrame([("a", video)], "path string, content binary"), "video", key, iv).collect()}["a"]
    whole = spark.range(1).select(F.aes_encrypt(F.lit(video[at : at + n]), key, F.lit("CBC"), F.lit("PKCS"), iv)).first()[0]
    assert sealed[at : at + n] == bytes(whole)[16 : 16 + n]
    assert sealed[at + n :][: len(short) + 4 + 7] == video[at + n :][: len(short) + 4 + 7]
