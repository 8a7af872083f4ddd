"""Token counts through a digest cache.

A text's count is stored under two digests: of its normalised content and of the
tokenizer's version (its file and the library's).  A run joins the corpus to the stored
counts, encodes each distinct missing text once, appends those counts to the cache,
and reads every row's count from it.

Where the tokenizer surely ends a token at the white space after a word, a task gives the
library each word once and adds up the words' counts; otherwise it gives it whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm.shared import text_or_empty

CACHE = "content binary, n_tokens bigint, tokenizer string"


def version(path: str) -> str:
    """Digest of a tokenizer: its file's bytes and the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes() + f"|{library.__version__}".encode()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the library of the file, without begin, end, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


#: What some engine or version of Unicode may take for white space, but for the four of ``_CUT``.
_UNSURE = r"\x0B\x0C\x1C-\x1F\x85\xA0\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u3000\uFEFF"
#: White space to everyone.  Text is cut before it, after a character that surely is none.
_CUT = r" \t\n\r"
_SPACE = f"[{_UNSURE}{_CUT}]"
_WORD = f"[^{_UNSURE}{_CUT}]"
#: Words with the white space before them, without gaps; white space only at the end of a text.
PARTS = re.compile(f"{_SPACE}*+{_WORD}++(?:[{_UNSURE}]{_SPACE}*+{_WORD}*+)*+|{_SPACE}++")


def splits_at_space(path: str) -> bool:
    """Whether a text's count is the sum of those of its ``PARTS``.

    True of byte-level BPE with its usual pattern: none of the pattern's pieces goes from
    text to white space, none looks back, and only white space looks ahead, up to the next
    character.  Nothing may change the text before, and added tokens must not reach over a cut.
    """
    if path.endswith(".model"):
        return False
    form = json.loads(Path(path).read_bytes())
    split = form.get("pre_tokenizer") or {}
    model = form.get("model") or {}
    return (
        not form.get("normalizer")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and split.get("add_prefix_space") is False
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(
            re.fullmatch(f"{_WORD}+", token["content"])
            and not (token.get("single_word") or token.get("lstrip") or token.get("rstrip"))
            for token in form.get("added_tokens") or []
        )
    )


#: Characters given to the library at once, each text counted as ``RESULT`` more: its results are
#: far larger than the text.
CHARACTERS = 1 << 20
RESULT = 64

#: Words that a task keeps the counts of; beyond that it starts anew.  Longer ones are not kept.
KEPT_WORDS = 1 << 19
KEPT_CHARACTERS = 32


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + RESULT
        if size >= CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_words(count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """``count``, given each word once as long as its count is kept."""
    known: dict[str, int] = {}

    def run(texts: list[str]) -> list[int]:
        parts = [PARTS.findall(text) for text in texts]
        new = set().union(*parts).difference(known)
        for words in _groups(new):
            known.update(zip(words, count(words), strict=True))
        counts = [sum(map(known.__getitem__, words)) for words in parts]
        for word in new:
            if len(word) > KEPT_CHARACTERS:
                del known[word]
        if len(known) > KEPT_WORDS:
            known.clear()
        return counts

    return run


def _encode(path: str, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        count = None
        for batch in batches:
            count = count or (_by_words(counter(path)) if by_words else counter(path))
            counts = [n for texts in _groups(batch.column("_text").to_pylist()) for n in count(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

    return run


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    text: str = "text",
    normalise: Callable[[Column], Column] = text_or_empty,
) -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes and n_tokens.

    ``tokenizer``: path of the vocabulary file on every executor.  ``cache``: folder of the
    stored counts on the shared store; made if missing; one run at a time appends to it.
    ``normalise`` must not change the counts; the default only takes null as empty.
    Null and empty texts count 0 tokens and 0 bytes.  Equal texts are encoded once;
    repeated rows come back as often as they are.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    version_digest = version(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("tokenizer").parquet(cache)

    def stored() -> DataFrame:
        kept = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version_digest)
        # A digest that two runs, or a repeated commit, have stored counts once.
        return kept.groupBy("content").agg(F.first("n_tokens").alias("count"))

    content = F.unhex(F.sha2(normalise(docs[text]), 256))
    misses = (
        docs.select(content.alias("content"), normalise(docs[text]).alias("_text"))
        .join(stored(), "content", "left_anti")
        .groupBy("content")
        .agg(F.first("_text").alias("_text"))  # a hot text leaves each task once
    )
    (
        misses.mapInArrow(_encode(tokenizer, splits_at_space(tokenizer)), "content binary, n_tokens bigint")
        .withColumn("tokenizer", F.lit(version_digest))
        .write.mode("append").partitionBy("tokenizer").parquet(cache)
    )
    # The rows' own columns travel in a struct, so that no name clashes.
    own = F.struct(*(docs[c] for c in docs.columns if c not in (text, "n_bytes", "n_tokens")), F.octet_length(text_or_empty(docs[text])).cast("long").alias("n_bytes"))
    return (
        docs.select(content.alias("content"), own.alias("own")).join(stored(), "content", "left")
        .select("own.*", F.col("count").alias("n_tokens"))
    )
