"""Objects by key on any file system that Spark reaches, and links to them that are signed and expire.

A link's signature is HMAC-SHA256 over method, key and expiry, as column expressions; whoever holds the secret checks
it without a table of links.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pads(secret: bytes) -> tuple[bytes, bytes]:
    """The secret as HMAC-SHA256's inner and outer prefix."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)


def signature(secret: bytes, method: Column, key: Column, expires: Column) -> Column:
    """Hex HMAC-SHA256 of method, key and expiry (seconds), each on a line; null if one is."""
    inner, outer = pads(secret)
    said = F.concat(method, F.lit("\n"), key, F.lit("\n"), expires.cast("string"))
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(said, "utf-8")), 256))), 256)


def link(base: str, secret: bytes, method: Column, key: Column, expires: Column) -> Column:
    """A link to an object for one method, good until `expires`."""
    return F.concat(F.lit(base.rstrip("/") + "/"), key, F.lit("?method="), method, F.lit("&expires="), expires.cast("string"), F.lit("&signature="), signature(secret, method, key, expires))


def valid_link(secret: bytes, method: Column, key: Column, expires: Column, given: Column, now: Column) -> Column:
    """Whether a link's signature is right for what it says and its time is not over."""
    return F.coalesce((given == signature(secret, method, key, expires)) & (now <= expires), F.lit(False))


class ObjectStore:
    """Objects under a folder. A put is seen whole or not at all: it is written aside and renamed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, key: str):  # noqa: ANN202
        if not key or any(part in ("", ".", "..") or part.startswith("_") for part in key.split("/")):
            raise ValueError("a key is a path of names, none of them empty, a dot or two, or with a leading underscore")
        return self._path(f"{self.root}/{key}")

    def put(self, key: str, body: bytes) -> None:
        """Stores or replaces one object."""
        at, aside = self._at(key), self._path(f"{self.root}/_{hashlib.sha256(key.encode()).hexdigest()}")
        out = self._fs.create(aside, True)
        out.write(body)
        out.close()
        self._fs.mkdirs(at.getParent())
        self._fs.delete(at, False)
        if not self._fs.rename(aside, at):
            raise OSError(f"cannot store {key}")

    def get(self, key: str) -> bytes | None:
        """One object's bytes; None if there is none."""
        if not self._fs.exists(self._at(key)):
            return None
        stream = self._fs.open(self._at(key))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def delete(self, key: str) -> bool:
        return self._fs.delete(self._at(key), False)

    def objects(self, pattern: str = "*") -> DataFrame:
        """(key, size, content) of the objects whose keys match a glob, read by the executors."""
        found = self.spark.read.format("binaryFile").load(f"{self.root}/{pattern}")
        top = self._fs.makeQualified(self._path(self.root)).toString()
        return found.select(F.replace("path", F.lit(top + "/"), F.lit("")).alias("key"), F.col("length").alias("size"), "content")
