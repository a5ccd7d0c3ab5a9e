"""Token counts (op 12) through a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): ``digest`` is the SHA-256 of
a normalised text, ``tokenizer`` that of the tokenizer's file, its library's version and
the settings.  Normalised means null as empty and UTF-8, nothing else: any other change
would change the counts.  One call

1. writes each row's id, length and digest,
2. joins the distinct digests to the cache,
3. brings one text of each miss together (Spark's map-side aggregate leaves one copy a
   task before the shuffle), encodes it and appends the counts to the cache,
4. joins the rows to the cache.

Digests of at least a ten-thousandth of all rows, of which there can be 10,000, are joined
by broadcast and the others by shuffle, so that no key of the shuffle is a hot one.
Appended files become visible when the job commits; digests that two writers append
count once.

Byte-level tokenizers split at white space before anything else, and a space belongs to
what follows it.  So a text's count is the sum of its fragments' counts, cut before each
space that a character other than white space or a special token's text follows, and
between letters and closing punctuation; a task asks the tokenizer once for each distinct
fragment and keeps a bounded number of bytes of them.  Other tokenizers are given whole texts.

Null and empty texts have no tokens.  Rows are kept one for one, repeated rows and null ids
too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.llm.common import byte_lengths, chunks, prepare, stored
from cellcube.session import scratch_path

KNOWN_BYTES = 64 << 20      # of a worker's known fragments, with about 120 for each beside its text
KEPT_LENGTH = 256           # longer fragments are not kept
FEW = 1 << 18               # misses up to this number (8 MB of digests) filter the texts by broadcast
HOT_SHARE = 10_000

CACHE = "digest binary, n_tokens long, tokenizer string"

_counters: dict = {}


class _Counter:
    """Counts of fragments or whole texts by one tokenizer file."""

    def __init__(self, name: str):
        import public_tokenizers

        path = public_tokenizers.path(name)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the cores are Spark's
        self.parts, self.special, self.known, self.size = False, (), {}, 0
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ask = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.ask = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                rules = json.load(f)
            before, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
            plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in added)
            self.parts = (plain and rules.get("normalizer") is None and not rules["model"].get("dropout") and before.get("type") == "ByteLevel"
                          and before.get("use_regex", True) and not before.get("add_prefix_space"))
            self.special = tuple(t["content"] for t in added)

    def of(self, texts: list[str]) -> list[int]:
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        known = self.known
        out = [known.get(x) for x in texts]
        new = {x: self._cut(x) for x, n in zip(texts, out) if n is None}
        ask = list({p for parts in new.values() for p in parts if p not in known})
        found = dict(zip(ask, self.ask(ask))) if ask else {}
        for x, parts in new.items():
            new[x] = sum(found[p] if p in found else known[p] for p in parts)
        for x, n in (found | new).items():
            if len(x) <= KEPT_LENGTH:
                known[x] = n
                self.size += len(x) + 120
        return [new[x] if n is None else n for x, n in zip(texts, out)]

    def _cut(self, fragment: str) -> tuple[str, ...]:
        """A word of Latin letters and the punctuation after it are two tokens' beginnings."""
        word = fragment.rstrip(string.punctuation) if self.parts else fragment
        letters = word[1:] if word.startswith(" ") else word
        if len(word) == len(fragment) or not letters.isalpha() or max(letters) >= "\u0250":
            return (fragment,)
        return word, fragment[len(word):]

    def glued(self, piece: str) -> bool:
        """No cut before the space in front of this piece."""
        return not piece or piece[0].isspace() or piece.startswith(self.special)


def _counter(name: str) -> _Counter:
    if name not in _counters:
        _counters[name] = _Counter(name)
    return _counters[name]


def token_counts(texts: pa.Array, tokenizer: str) -> np.ndarray:
    """Number of tokens of each text (null: empty)."""
    counter = _counter(tokenizer)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not counter.parts:
        return np.array(counter.ask(texts.to_pylist()), np.int64)
    split = pc.split_pattern(texts, " ")
    bounds = split.offsets.to_numpy()
    bounds = bounds - bounds[0]
    flat = split.flatten()
    coded = flat.dictionary_encode()
    index, pieces = coded.indices.to_numpy(), coded.dictionary
    glued = np.array([counter.glued(p) for p in pieces.to_pylist()], bool)[index]
    first = np.zeros(len(index), bool)
    first[bounds[:-1]] = True
    head = first | ~glued
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(index))          # pieces of each fragment
    counts = np.zeros(len(begin), np.int64)
    alone = end - begin == 1
    for inner, pick in ((" ", alone & ~first[begin]), ("", alone & first[begin])):
        used = np.zeros(len(pieces), bool)
        used[index[begin[pick]]] = True
        table = np.zeros(len(pieces), np.int64)
        table[used] = counter.of([inner + p for p in pieces.filter(pa.array(used)).to_pylist()])
        counts[pick] = table[index[begin[pick]]]
    several = np.flatnonzero(~alone)
    if len(several):
        # pieces lie one space apart in their text
        length = pc.binary_length(flat).to_numpy().astype(np.int64) + 1
        at = np.cumsum(length) - length
        doc = np.searchsorted(bounds, begin[several], "right") - 1
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        lead = np.where(first[begin[several]], 0, 1)
        lo = offsets[doc] + at[begin[several]] - at[bounds[doc]] - lead
        hi = offsets[doc] + at[end[several] - 1] + length[end[several] - 1] - 1 - at[bounds[doc]]
        counts[several] = counter.of([body[a:b].to_pybytes().decode() for a, b in zip(lo.tolist(), hi.tolist())])
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(total[np.searchsorted(begin, bounds)])


def tokenizer_digest(tokenizer: str) -> str:
    """SHA-256 of the tokenizer's file, its library's version and the settings."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if tokenizer.endswith(".model") else tokenizers.__version__
    with open(public_tokenizers.path(tokenizer), "rb") as f:
        return hashlib.sha256(f.read() + f"\n{version}\nwhole text, no added tokens".encode()).hexdigest()


def _stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """digest and n_tokens of one tokenizer version; None when there is no cache yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 1024,
                 id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).  ``cache`` is the folder of the
    cache, made when it is not there; without it the cache lives as long as the driver."""
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch_path(spark, "llm-token-counts")
    text = F.coalesce(F.col(text_name), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    keys = stored(docs.select(F.col(id_name), F.octet_length(text).cast("long").alias("n_bytes"), digest), "counts-keys")
    kinds = stored(keys.groupBy("digest").agg(F.count("*").alias("rows")), "counts-kinds")
    before = _stored_counts(spark, cache, version)
    missing = kinds.select("digest") if before is None else kinds.select("digest").join(before, "digest", "left_anti")
    n, n_missing = keys.count(), missing.count()
    if n_missing:
        texts = docs.select(digest, text.alias("text"))
        few = n_missing <= FEW
        if before is not None and few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
        if before is not None and not few:
            texts = texts.join(missing, "digest", "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                for a, b in chunks(byte_lengths(column)):
                    found = token_counts(column.slice(a, b - a), tokenizer)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["digest", "n_tokens"])

        counted = texts.mapInArrow(encode, "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version))
        counted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = _stored_counts(spark, cache, version)
    if known is None:       # no rows at all
        known = spark.createDataFrame([], "digest binary, n_tokens long")
    frequent = kinds.filter(F.col("rows") >= max(2, math.ceil(n / HOT_SHARE))).select("digest")
    # at most HOT_SHARE digests: each stands for a ten-thousandth of the rows or more
    hot = F.broadcast(known.join(F.broadcast(frequent), "digest"))
    rows = keys.join(hot, "digest").unionByName(keys.join(F.broadcast(frequent), "digest", "left_anti").join(known, "digest"))
    return rows.select(id_name, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
