"""Token counts: rollups by source, language and tokenizer version that signed changes keep up to date.

A batch of changes (insert, delete, revise) becomes signed counts, which tasks sum before the shuffle; what is stored
for a batch is one row for each source, language and version, in a folder of its own. A manifest names the folders
that count and the ids of all batches committed. A commit writes its folder first and then the next manifest, which
is moved into place whole and only if no other has taken that number: so a batch counts once, whoever tries it how
often, and readers see all of it or nothing. compact() sums the folders into one by the same rule. What an interrupted
attempt left is named by no manifest and counts for nothing; clean() removes it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of public tokenizers and the version counted by default.
FOLDER, VERSION = "/opt/tokenizers", "byte_bpe_50k"
KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


@cache
def encoder(folder: str, version: str):  # noqa: ANN201
    """The tokenizer, once a Python process: a .tiktoken file of ranks, or a file of the tokenizers library."""
    path = os.path.join(folder, f"{version}.tiktoken")
    if os.path.exists(path):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        #: Fixed value: the pattern by which this vocabulary's makers cut texts before merging bytes.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(os.path.join(folder, f"{version}.json"))
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


def counted(folder: str, version: str, columns: list[str]):  # noqa: ANN201
    """A function for mapInArrow that counts the tokens of text columns; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, version)
        for batch in batches:
            count = lambda column: pa.array([len(encode(x)) if (x := text.as_py()) else 0 for text in column], pa.int64())
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([count(batch.column(n)) if n in columns else batch.column(n) for n in names], names)

    return run


def token_counts(docs: DataFrame, version: str = VERSION, folder: str = FOLDER) -> DataFrame:
    """doc_id, source, lang and n_tokens of each document's whole text; nothing is shuffled.

    A null or empty text has 0 tokens; equal rows count alike and each keeps its row; null ids, sources and languages
    are kept; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = docs.select("doc_id", "source", "lang", "text").mapInArrow(counted(folder, version, ["text"]), f"doc_id {kind}, source string, lang string, text bigint")
    return counts.withColumnRenamed("text", "n_tokens")


def signed(changes: DataFrame, version: str = VERSION, folder: str = FOLDER) -> DataFrame:
    """Changes as additive rows (source, lang, version, n_docs, n_tokens), summed by key.

    changes: op (insert, delete or revise), source, lang, old_text, new_text. An insert adds its new text, a delete
    takes its old text away, a revision does both and keeps the number of documents. Null texts have no tokens; null
    sources and languages are keys of their own; repeated rows are changes each; an unknown op raises an error when
    run; no changes give no rows; other columns are not read.
    """
    own = changes.select("op", "source", "lang", "old_text", "new_text")
    counts = own.mapInArrow(counted(folder, version, ["old_text", "new_text"]), "op string, source string, lang string, old_text bigint, new_text bigint")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "delete", F.lit(0)).otherwise(F.col("new_text")) - F.when(F.col("op") == "insert", F.lit(0)).otherwise(F.col("old_text"))
    return counts.groupBy("source", "lang", F.lit(version).alias("version")).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens"))


def changed(docs: DataFrame, op: str, old_text: Column | None = None, new_text: Column | None = None) -> DataFrame:
    """Changes of one kind, one for each row of `docs` (source, lang and what the texts are computed from)."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit(op).alias("op"), "source", "lang", (none if old_text is None else old_text).alias("old_text"), (none if new_text is None else new_text).alias("new_text"))


def inserts(docs: DataFrame) -> DataFrame:
    return changed(docs, "insert", new_text=F.col("text"))


class Rollup:
    """Totals kept in a folder that driver and executors share, on any file system with an atomic rename.

    manifest/N lists {"folders": those that count, "ids": batches committed}; the greatest N holds. The list of ids has
    one name a batch and is the driver's to read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.path).getFileSystem(self._conf)
        self._whole = hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    def _names(self, folder: str) -> list[str]:
        top = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def manifest(self) -> tuple[int, dict]:
        """Number and content of the manifest that holds; 0 and an empty one before the first commit."""
        last = max((int(n) for n in self._names("manifest") if n.isdigit()), default=0)
        if not last:
            return 0, {"folders": [], "ids": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest/{last}"))
        try:
            return last, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> bool:
        """Moves a manifest into place whole; False if that number is taken."""
        draft = self._path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(content).encode())
        out.close()
        try:
            self._whole.rename(self._qualified(draft), self._qualified(self._path(f"{self.path}/manifest/{number}")), self._keep)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def _qualified(self, path):  # noqa: ANN001, ANN202
        return self._fs.makeQualified(path)

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def committed(self, batch: str) -> bool:
        return batch in self.manifest()[1]["ids"]

    def commit(self, batch: str, changes: DataFrame, version: str = VERSION, folder: str = FOLDER) -> bool:
        """Adds a batch of changes; False, and nothing done, if that id was committed before or by another meanwhile."""
        if not batch:
            raise ValueError("a batch needs an id")
        if self.committed(batch):
            return False
        own = self._write(signed(changes, version, folder))
        while True:
            number, now = self.manifest()
            if batch in now["ids"]:
                self._fs.delete(self._path(f"{self.path}/{own}"), True)
                return False
            if self._publish(number + 1, {"folders": [*now["folders"], own], "ids": [*now["ids"], batch]}):
                return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs and n_tokens over all committed batches; keys whose sums are all 0 are left out."""
        return self._read(self.manifest()[1]["folders"])

    def compact(self) -> bool:
        """Sums all folders that count into one; False, and nothing done, if another has folded some of them meanwhile."""
        folded = self.manifest()[1]["folders"]
        own = self._write(self._read(folded))
        while True:
            number, now = self.manifest()
            if not set(folded) <= set(now["folders"]):
                self._fs.delete(self._path(f"{self.path}/{own}"), True)
                return False
            if self._publish(number + 1, {"folders": [own, *(f for f in now["folders"] if f not in folded)], "ids": now["ids"]}):
                return True

    def clean(self, older_s: float = 86_400) -> int:
        """Removes folders, drafts and manifests that hold no longer and are older than `older_s`; how many."""
        number, now = self.manifest()
        held = {*now["folders"], f"manifest/{number}"}
        limit = self.spark._jvm.System.currentTimeMillis() - older_s * 1000
        old = [f"{top}/{n}" for top in ("data", "manifest") for n in self._names(top) if f"{top}/{n}" not in held and not n.startswith(".")]
        gone = [x for x in old if self._fs.getFileStatus(self._path(f"{self.path}/{x}")).getModificationTime() <= limit]
        for x in gone:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        return len(gone)
