"""Token counts with a digest cache.

Digests of texts are joined by (content digest, tokenizer digest) to stored counts before any text moves; only the
distinct texts that miss are fetched and encoded, and their counts are appended to the cache for later runs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, pick, scratch, spread_join

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Entries a worker's cache of unit counts may have before it is emptied, and the longest unit that it takes.
UNIT_CACHE, UNIT_CHARS = 600_000, 64
#: A word of Latin letters and at most one mark, each a token of the byte alphabet.
WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
#: How the byte alphabet writes the bytes that aren't printable in Latin-1: code points from 256 on, in order.
BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Characters of text that a worker handles at a time.
BLOCK_CHARS = 1_000_000
#: Missing digests that are broadcast to pick their texts where they are; more are met by a shuffle of all distinct texts.
FEW_MISSES = 20_000


class UnitCounter:
    """Exact token counts of texts, by a cache of the counts of their units.

    The byte-level pre-tokenizer never lets a token cross (1) a single space between two characters that aren't
    white space, which begins a token, or (2) a single line feed between two such characters, which is a token.
    So a count is a sum over these units. Where white space is any other (runs, tabs, line ends beside spaces), all
    up to the next plain place is one unit. For other kinds of tokenizer every text is encoded whole.
    """

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_unit = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            spec = json.loads(model.to_str())
            pre = spec.get("pre_tokenizer") or {}
            self.by_unit = (
                pre.get("type") == "ByteLevel"
                and not pre.get("add_prefix_space")
                and pre.get("use_regex", True)
                and not spec.get("normalizer")
                and not any(t["lstrip"] or t["rstrip"] or t.get("single_word") or len(t["content"].split()) != 1 for t in spec.get("added_tokens", []))
            )
            # an added token of letters alone could be inside a plain word
            self.by_unit = self.by_unit and not any(WORD.fullmatch(t["content"]) for t in spec.get("added_tokens", []))
            self.merge = model.model.tokenize
        self.after_space: dict[str, int] = {}
        self.at_start: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of texts, in order."""
        if not self.by_unit:
            return self.encode(texts) if texts else []
        out: list[int] = []
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                out += self._block(block)
                block, size = [], 0
        return out + (self._block(block) if block else [])

    def _block(self, texts: list[str]) -> list[int]:
        parsed = [self._units(text) for text in texts]
        if len(self.after_space) + len(self.at_start) > UNIT_CACHE:
            self.after_space.clear()
            self.at_start.clear()
        spaced: set[str] = set()
        first: set[str] = set()
        for starts, inner, _ in parsed:
            first.update(starts)
            spaced.update(*inner)
        own_spaced = self._learn(self.after_space, spaced, " ")
        own_first = self._learn(self.at_start, first, "")
        out = []
        for starts, inner, feeds in parsed:
            n = feeds + sum(map(own_first, starts))
            for pieces in inner:
                n += sum(map(own_spaced, pieces))
            out.append(n)
        return out

    def _learn(self, known: dict[str, int], wanted: set[str], prefix: str):
        """A lookup for the wanted units; short ones stay in ``known``."""
        missing, counts = self._encode_units(wanted - known.keys(), prefix)
        long: dict[str, int] = {}
        for unit, n in zip(missing, counts):
            (known if len(unit) <= UNIT_CHARS else long)[unit] = n
        if not long:
            return known.__getitem__
        both = {**{k: known[k] for k in wanted if k in known}, **long}
        return both.__getitem__

    def _encode_units(self, units: set[str], prefix: str) -> tuple[list[str], list[int]]:
        """The units with their counts. A word of Latin letters, with or without a mark after it, goes straight to the merges."""
        simple, odd, counts = [], [], []
        lead, merge, match = "\u0120" if prefix else "", self.merge, WORD.fullmatch
        for unit in units:
            if m := match(unit):
                word, mark = m.groups()
                simple.append(unit)
                counts.append(len(merge(lead + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)))) + len(mark))
            else:
                odd.append(unit)
        return simple + odd, counts + (self.encode([prefix + x for x in odd]) if odd else [])

    @staticmethod
    def _units(text: str) -> tuple[list[str], list[list[str]], int]:
        """Units at a start of a line or block, units after a single space (one list for each line), and line feeds that are tokens."""
        starts: list[str] = []
        inner: list[list[str]] = []
        feeds = 0
        odd: list[str] | None = None  # lines of odd white space that wait for a plain place
        for i, line in enumerate(text.split("\n")):
            pieces = line.split(" ")
            plain = line and pieces == line.split()
            if odd is not None:
                if plain:
                    odd.append(pieces[0])
                    starts.append("\n".join(odd))
                    inner.append(pieces[1:])
                    odd = None
                else:
                    odd.append(line)
            elif plain:
                feeds += i > 0
                starts.append(pieces[0])
                inner.append(pieces[1:])
            else:
                odd = ["", line] if i else [line]
        if odd is not None:
            starts.append("\n".join(odd))
        return starts, inner, feeds


@functools.lru_cache(maxsize=2)
def counter(path: str) -> UnitCounter:
    return UnitCounter(path)


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_file: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for every row of ``docs``.

    The content is normalised to the empty text where it is null and not otherwise, since any other change could
    change the count. ``tokenizer_file`` is a .json or .model file at the same place on each machine. ``cache_path``
    is a Parquet folder (CACHE_SCHEMA) that later runs share; without one, a fresh folder in the shared place is used.

    Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id is kept. Repeated rows each get their row.
    An empty table gives no rows. Further columns are ignored. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch(spark, "token-cache")
    version = tokenizer_digest(tokenizer_file)
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    places = materialise(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-places")
    digests = materialise(places.groupBy("digest").agg(F.count("*").alias("size")), "token-digests")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
        # two runs may have appended the same text: both counts are the same
        return cache.groupBy(F.col("content_digest").alias("digest")).agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches):
        count = counter(tokenizer_file).count
        for batch in batches:
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    missing = materialise(digests.select("digest").join(stored(), "digest", "left_anti"), "token-misses")
    n_missing = missing.count()
    if n_missing:
        few = n_missing <= FEW_MISSES
        asked = rows.select("digest", "text")
        asked = asked.join(F.broadcast(missing), "digest", "left_semi") if few else asked
        # one text for each digest leaves a map task, whatever the number of copies
        distinct = asked.groupBy("digest").agg(F.first("text").alias("text"))
        distinct = distinct if few else distinct.join(missing, "digest", "left_semi")
        distinct.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = materialise(digests.join(stored(), "digest"), "token-counts")
    discard(missing, digests)
    out = spread_join(places, known, ["digest"], places.count())
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
