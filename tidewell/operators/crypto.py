"""Segment encryption, on JVM functions: AES-128-CBC with the IV of a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import iv_hex


def iv_bytes(sequence: Column) -> Column:
    return F.unhex(F.substr(iv_hex(sequence), F.lit(3)))


def encrypt(segments: DataFrame, payload: str, key: Column, iv: Column, name: str = "encrypted") -> DataFrame:
    """AES-128-CBC with PKCS7; the IV is not part of the output."""
    sealed = F.aes_encrypt(F.col(payload), key, F.lit("CBC"), F.lit("PKCS"), iv)
    return segments.withColumn(name, F.substr(sealed, F.lit(17), F.octet_length(sealed) - 16))


def decrypt(segments: DataFrame, payload: str, key: Column, iv: Column, name: str = "decrypted") -> DataFrame:
    return segments.withColumn(name, F.aes_decrypt(F.concat(iv, F.col(payload)), key, F.lit("CBC"), F.lit("PKCS")))


def with_key_tags(segments: DataFrame, index: str, uri: Column, every: int, name: str = "key_line") -> DataFrame:
    """The KEY line before the first segment and each `every`-th, null elsewhere."""
    line = F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="'), uri, F.lit('",IV='), iv_hex(F.col(index)))
    return segments.withColumn(name, F.when(F.col(index) % every == 0, line))


def _seal(piece: Column, key: Column, iv: Column) -> Column:
    """CBC of whole blocks without padding: the padding block that the JVM adds is cut off."""
    sealed = F.aes_encrypt(piece, key, F.lit("CBC"), F.lit("PKCS"), iv)
    return F.substr(sealed, F.lit(17), F.octet_length(piece))


def _open(piece: Column, key: Column, iv: Column) -> Column:
    """The inverse: a padding block that fits the last one is made by sealing nothing, and appended."""
    last = F.substr(piece, F.octet_length(piece) - 15, F.lit(16))
    padding = F.substr(F.aes_encrypt(F.unhex(F.lit("")), key, F.lit("CBC"), F.lit("PKCS"), last), F.lit(17), F.lit(16))
    return F.aes_decrypt(F.concat(iv, piece, padding), key, F.lit("CBC"), F.lit("PKCS"))


def sample_crypt(
    files: DataFrame, kind: str, key: Column, iv: Column, decrypt: bool = False, name: str = "path", content: str = "content",
    out: str = "crypted"
) -> DataFrame:
    """(name, out): sample encryption of elementary streams, `video` (H.264 with 4-byte start codes: pictures
    from their 33rd payload byte on) or `audio` (ADTS: frames from their 17th payload byte on).

    Only whole blocks are encrypted, each region from the same IV. key and iv are columns of literals.
    The worker cuts a stream into clear and protected pieces; ciphers and joining are JVM functions.
    """
    from ..sources.binary import protected_pieces, rows_of

    pieces = rows_of(files, name, content, "position int, piece binary, protected boolean", lambda d: protected_pieces(d, kind))
    worked = (_open if decrypt else _seal)(F.col("piece"), key, iv)
    pieces = pieces.withColumn("piece", F.when(F.col("protected"), worked).otherwise(F.col("piece")))
    ordered = F.array_sort(F.collect_list(F.struct("position", F.hex("piece").alias("h"))))
    return pieces.groupBy(name).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias(out))
