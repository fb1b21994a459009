"""What a value is replaced by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = {"CBC": ("CBC", "PKCS", 16), "GCM": ("GCM", "DEFAULT", 12)}
UNKNOWN = "UNKNOWN"  # the name of a span without a type
HASHES = ("md5", "sha256", "sha512")


def placeholder(entity_type: Column) -> Column:
    return F.concat(F.lit("<"), F.coalesce(entity_type, F.lit(UNKNOWN)), F.lit(">"))


def mask(value: Column, char: Column, count: Column, from_end: Column) -> Column:
    """Cover ``count`` characters from the start or the end."""
    k = F.greatest(F.lit(0), F.least(count, F.length(value)))
    cover = F.repeat(char, k)
    keep = F.length(value) - k
    return F.when(from_end, F.concat(F.substring(value, F.lit(1), keep), cover)).otherwise(
        F.concat(cover, F.substring(value, k + 1, keep))
    )


def hashed(value: Column, kind: str) -> Column:
    if kind == "md5":
        return F.md5(value)
    return F.sha2(value, {"sha256": 256, "sha512": 512}[kind])


def key_bytes(key: Column, base64_key: bool | Column) -> Column:
    if isinstance(base64_key, Column):
        return F.when(base64_key, F.try_to_binary(key, F.lit("base64"))).otherwise(F.encode(key, "UTF-8"))
    return F.unbase64(key) if base64_key else F.encode(key, "UTF-8")


def fits(key: Column, base64_key: bool | Column = False) -> Column:
    """Whether a key has 128, 192 or 256 bits."""
    return F.octet_length(key_bytes(key, base64_key)).isin(16, 24, 32)


def _by_mode(mode: str | Column, made) -> Column:
    """``made(mode)``, for a mode that may be a column."""
    if not isinstance(mode, Column):
        return made(mode)
    chosen = F
    for name in MODES:
        chosen = chosen.when(mode == name, made(name))
    return chosen.otherwise(F.lit(None).cast("string"))


def encrypt(value: Column, key: Column, salt: Column, mode: str | Column = "CBC", base64_key: bool | Column = False) -> Column:
    """AES, as base64 text of initial vector and ciphertext.

    The vector is derived from the key, the place (``salt``) and the value.
    A random one would change between two evaluations of the same column, and
    Spark may evaluate a column more than once.
    """
    seed = F.concat_ws("\u0001", key, salt, value)

    def sealed(known: str) -> Column:
        name, padding, size = MODES[known]
        vector = F.unhex(F.substring(F.sha2(seed, 256), 1, size * 2))
        done = F.aes_encrypt(value, key_bytes(key, base64_key), F.lit(name), F.lit(padding), vector)
        # base64 breaks lines after 76 characters by default
        return F.translate(F.base64(done), "\r\n", "")

    return _by_mode(mode, sealed)


def decrypt(value: Column, key: Column, mode: str | Column = "CBC", base64_key: bool | Column = False) -> Column:
    """NULL when the value does not open with the key."""

    def opened(known: str) -> Column:
        name, padding, _ = MODES[known]
        plain = F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), key_bytes(key, base64_key), F.lit(name), F.lit(padding))
        return F.try_validate_utf8(plain.cast("string"))

    return _by_mode(mode, opened)


# Fixed format: sv1.<key id>.<mode>.<text or base64, the form of the key>.<base64 of vector and ciphertext>
ENVELOPE = "sv1"
KEY_ID = "[A-Za-z0-9_-]{1,64}"
_WHOLE = rf"^{ENVELOPE}\.({KEY_ID})\.({'|'.join(MODES)})\.(text|base64)\.([A-Za-z0-9+/=]+)$"


def in_envelope(sealed: Column, key_id: str | Column, mode: str | Column, base64_key: bool | Column) -> Column:
    """A sealed value that says which key opens it, and how."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    form = F.when(as_column(base64_key), "base64").otherwise("text")
    return F.concat_ws(".", F.lit(ENVELOPE), as_column(key_id), as_column(mode), form, sealed)


def envelope(value: Column) -> Column:
    """``struct<key_id, mode, base64_key, sealed>`` of a value in an envelope; NULL for any other."""
    part = lambda i: F.regexp_extract(value, _WHOLE, i)
    whole = F.struct(
        part(1).alias("key_id"), part(2).alias("mode"), (part(3) == "base64").alias("base64_key"), part(4).alias("sealed")
    )
    return F.when(value.rlike(_WHOLE), whole)


def pseudonym(entity_type: Column, value: Column, salt: Column, length: int = 32) -> Column:
    """Same value, same name across the corpus, without a table of names.

    128 bits by default: two values of a large corpus don't meet in one name.
    """
    return F.concat(
        F.lit("<"), F.coalesce(entity_type, F.lit(UNKNOWN)), F.lit("_"),
        F.substring(F.sha2(F.concat(salt, value), 256), 1, length), F.lit(">"),
    )
