"""Token ids and counts of texts; counts are kept in a cache by digest."""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import new_path, text_of, written

# Fixed value: how byte-level BPE files cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable,
    else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def as_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Byte strings with their ids, and the added tokens, of a byte-level BPE file whose merges come
    in the order of their ids and which changes texts in no other way; None for other files."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"] or {}
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    plain_token = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    if not (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and file["normalizer"] is None
            and not model.get("ignore_merges") and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and all(plain_token.items() <= t.items() for t in file["added_tokens"])
            and [vocab.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))):
        return None
    back = {c: b for b, c in byte_characters().items()}
    return {bytes(back[c] for c in token): i for token, i in vocab.items()}, added


class Ids:
    """Ids of texts as the `tokenizers` library gives them, without begin, end or padding.

    Byte-level BPE files whose merges are in rank order are run by the `tiktoken` engine,
    which gives the same ids four times as fast; other files, and texts it cannot cut, by the
    library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._fast = None
        if ranks := as_ranks(path):
            import tiktoken
            self._fast = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks[0], special_tokens=ranks[1])

    def whole(self, text: str) -> list[int]:
        return self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def of(self, text: str) -> list[int]:
        if self._fast is None:
            return self.whole(text)
        try:
            return self._fast.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # a run of white space beyond what the engine's pattern can look back on
            return self.whole(text)


def ids_of(path: str) -> Ids:
    """One per worker and file.

    Workers need not have this package: functions reach them by value, with globals that last for a task. What
    is to last as long as the worker is kept with its modules.
    """
    kept = sys.modules.setdefault("_tokenizers_of_worker", types.ModuleType("_tokenizers_of_worker")).__dict__
    if path not in kept:
        kept[path] = Ids(path)
    return kept[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def version_of(path: str) -> str:
    """A digest of the tokenizer's file: another file never finds this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached_counts(spark, cache: str, version: str) -> DataFrame | None:
    try:
        rows = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have added one digest


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 cache: str | None = None, limit: int = 512) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row.

    Counts come from `cache`, a folder of Parquet by tokenizer version with (digest,
    n_tokens); contents it lacks are encoded once each, however many rows repeat them, and
    appended. Without `cache` a new folder is used. A null text counts as empty, which has no
    tokens. Rows that repeat a key, null keys and clashing columns do no harm: only key and
    text are read, each row gives one. An empty table gives an empty result.

    `tokenizer` is a file of the `tokenizers` library, at the same place on every machine;
    strings of special tokens inside a text are handled as the library does by default.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    version, cache = version_of(path), cache or new_path(spark, "token-cache")
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("content"))
    digests = rows.select("id", F.octet_length("content").cast("long").alias("n_bytes"),
                          F.unhex(F.sha2("content", 256)).alias("digest"))
    wanted = rows.select(F.unhex(F.sha2("content", 256)).alias("digest"), "content")
    batch = digests.select("digest").distinct()  # of a cache that grew over many batches only these counts are used
    stored = cached_counts(spark, cache, version)
    missing = wanted if stored is None else wanted.join(stored, "digest", "left_anti")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ids_of(path)
        for pdf in frames:
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": [len(ids.of(t)) for t in pdf["content"]]})

    distinct = missing.groupBy("digest").agg(F.first("content").alias("content"))
    (distinct.mapInPandas(count, "digest binary, n_tokens long")
     .write.mode("append").parquet(f"{cache}/version={version}"))
    # written, so that the join is of two plain tables and a hot digest's rows can be split among tasks
    known = cached_counts(spark, cache, version)
    counts = written(known if stored is None else known.join(batch, "digest", "left_semi"), "counts")
    return (digests.join(counts, "digest")
            .select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
