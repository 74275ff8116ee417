"""Token counts with a digest cache.

Counts are stored under the digests of the normalised text and of the tokenizer
file.  A run joins its documents with the stored counts, encodes each distinct
text that misses once, and appends the new counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import new_path, save

LIMIT = 2048
WORD_CACHE, CHUNK = 500_000, 8_192
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
_word = re.compile(r"[^ \t-\r]+")


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter(dict):
    """Token counts of texts.  With ``by_word``, a text's count is the sum of its words' counts, each word encoded once while the cache holds it."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for i in range(0, len(texts), CHUNK) for e in self.tokenizer.encode_batch_fast(texts[i : i + CHUNK], add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [n for t in texts for n in self.encode([t])]
        if len(self) > WORD_CACHE:
            self.clear()
        split = [_word.findall(t) for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self))
        self.update(zip(new, self.encode(new), strict=True))
        return [sum(map(self.__getitem__, words)) for words in split]


def normal(text):
    """Runs of ASCII space count as one, as no token reaches across them; used with ``by_word`` only."""
    return F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " "))


def _first_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops texts whose digest this task has passed on already."""
    seen: set[bytes] = set()
    for b in batches:
        fresh = []
        for d in b["digest"]:
            fresh.append(d not in seen)
            seen.add(d)
        yield b[fresh]


def count(docs: DataFrame, path: str, cache: str | None = None, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` for every row; new counts are appended to ``cache``.

    ``by_word`` is for tokenizers none of whose tokens reaches across a space;
    otherwise whole texts are encoded.  ``cache`` is a Parquet folder of ``(tokenizer, digest,
    n_tokens)``, read if it exists; without one the run has its own in the
    shared folder.  Null counts as empty, 0 tokens.  Repeated texts are encoded once; extra columns
    are not read; an empty table gives an empty result and an empty cache.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(normal(text) if by_word else text, "UTF-8"), 256))
    keys = save(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    # A hot text leaves each task once, so its digest meets few rows after the exchange.
    texts = texts.mapInPandas(_first_seen, "digest binary, text string")
    if cache and _exists(spark, cache):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        texts = texts.join(stored, "digest", "left_anti")
    misses = texts.repartition("digest")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path, by_word)
        for b in _first_seen(batches):
            yield pd.DataFrame({"tokenizer": version, "digest": b["digest"], "n_tokens": counter.count(b["text"].tolist())})

    cache = cache or new_path(spark, "token-counts")
    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # concurrent runs may have stored a count twice
    return keys.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def report(docs: DataFrame, path: str, limit: int = LIMIT, **options) -> DataFrame:
    return count(docs, path, **options).withColumn("over_limit", F.col("n_tokens") > limit)
