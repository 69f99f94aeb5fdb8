"""Token ids of candidate texts in segments of separately compressed documents.

Format. A segment is one row of a Parquet table: its ``frames`` are the zstandard frames of
the ids (little-endian unsigned 32-bit integers, end id included) of a run of documents in
ascending order of their ids, one frame per document, and its ``index`` has id, offset,
length and number of tokens of each. All frames share one dictionary, trained on serialized
id arrays and stored once beside the segments; every segment keeps its hash. A
document is read by finding its segment by the range of ids, then its frame by the offset:
nothing else is decompressed. Segments are written by Spark's own writer, so any file
system will do, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from rankspark.llm.common import many_small_objects, per_worker, pick, slices_by_bytes
from rankspark.session import cut


class WrongDictionary(ValueError):
    """Segments were written with another dictionary."""


@dataclass(frozen=True)
class TokenConfig:
    """``sample_texts`` texts of at most ``sample_bytes`` bytes train the dictionary of ``dictionary_bytes``."""

    end_id: int = 2
    level: int = 3
    dictionary_bytes: int = 64 << 10
    sample_texts: int = 1000
    sample_bytes: int = 20_000
    segment_bytes: int = 4 << 20
    bytes_per_batch: int = 2 << 20
    rows_per_task: int = 10_000


class WordTokenizer:
    """The library's encoder, asked once per distinct word.

    For a tokenizer whose normaliser maps white space to a space and whose pre-tokenizer
    drops it, a text's ids are those of its parts between spaces and line feeds, one after
    the other. Arrow splits the texts and numbers the distinct parts, the library encodes
    those not met before, and the ids are gathered by number. Tokenizers of another kind get whole texts.
    """

    # a word of letters that have no other form, then punctuation without apostrophes: one or two
    # pre-tokens; and none that an added token could stand in
    _PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:;=?-@\[-`{}~]*)")

    def __init__(self, definition: str, remembered: int = 700_000) -> None:
        self.library = Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        self.by_word = drops_white_space(parsed)
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        ends = [i for token, i in parsed["model"]["vocab"].items() if suffix and token.endswith(suffix)]
        self.ends_word = np.zeros(max(parsed["model"]["vocab"].values(), default=0) + 1, dtype=bool)
        self.ends_word[ends] = True
        normalizer = parsed.get("normalizer") or {}
        self.lowers = any(s.get("type") == "Lowercase" for s in normalizer.get("normalizers", [normalizer]))
        self.words: dict[str, bytes] = {"": b""}
        self.remembered = remembered

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _of_words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        learned = self._learn(new)
        if len(self.words) + len(learned) > self.remembered:
            self.words = {"": b""}
        self.words.update(learned)
        return [learned[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words. Plain ones go to the library as one text, whose ids are dealt out by ends of pre-tokens."""
        matches = list(map(self._PLAIN.fullmatch, new)) if self.ends_word.any() else []
        plain = [(m[0], m[0][: m.start(1)], m[1]) for m in matches if m]
        learned: dict[str, bytes] = {}
        if plain:
            # letters and punctuation are pre-tokens of their own, so each distinct one is encoded once
            cores = [core.lower() for _, core, _ in plain] if self.lowers else [core for _, core, _ in plain]
            parts = list(dict.fromkeys(cores)) + list(dict.fromkeys(after for _, _, after in plain if after))
            (encoded,) = self.library.encode_batch_fast([" ".join(parts)], add_special_tokens=False)
            ids = np.array(encoded.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(parts) and ends[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                of = {p: raw[a:b] for p, a, b in zip(parts, [0, *stops], stops)}
                of[""] = b""
                learned = {w: of[core] + of[after] for (w, _, after), core in zip(plain, cores, strict=True)}
        rest = [w for w in new if w not in learned]
        learned.update(zip(rest, self._encode(rest), strict=True))
        return learned

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow column; null is the empty text."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.frombuffer(x, dtype=np.uint32) for x in self._encode(texts.to_pylist())]
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = parts.flatten().dictionary_encode()
        of_word = self._of_words(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, of_word), dtype=np.int64, count=len(of_word)) // 4
        pool, first = np.frombuffer(b"".join(of_word), dtype=np.uint32), np.cumsum(length) - length
        word = numbered.indices.to_numpy()
        n = length[word]
        ends = np.cumsum(n)
        at = np.repeat(first[word] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return np.split(pool[at], bounds[1:-1])


def drops_white_space(definition: dict) -> bool:
    """Whether a tokenizer treats the parts of a text between white space on their own."""
    normalizer, splitter = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    kinds = {s.get("type") for s in steps}
    spaces = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    first = (splitter.get("pretokenizers") or [splitter])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    # every alternative of the pattern must be one of these, none of which takes white space
    known = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"}
    words_only = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    rest = (splitter.get("pretokenizers") or [splitter])[1:]
    plain = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in rest)
    no_extras = not definition.get("post_processor") and not definition.get("truncation") and not definition.get("padding")
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in definition.get("added_tokens", []))
    return bool(
        kinds <= {"NFC", "Replace", "Lowercase"} and spaces and words_only and set(pattern.split("|")) <= known and plain and no_extras and added
    )


def tokenizer(definition: str) -> WordTokenizer:
    name = f"tokenizer {hashlib.sha256(definition.encode()).hexdigest()}"
    return per_worker(name, lambda: WordTokenizer(definition))


def load_definition(path: str) -> str:
    """The tokenizer file, read where the job is started; tasks get its content and need no file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _end(cfg: TokenConfig) -> np.ndarray:
    return np.asarray([cfg.end_id], dtype="<u4")


def train_dictionary(texts: DataFrame, definition: str, cfg: TokenConfig) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample, chosen by a hash of the ids.

    Too little to train on gives an empty dictionary: frames are then compressed without one.
    """
    usable = texts.where((F.octet_length("text") > 0) & (F.octet_length("text") <= cfg.sample_bytes))
    chosen = usable.orderBy(F.xxhash64("candidate_id"), "candidate_id", "text").limit(cfg.sample_texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(shared.value), _end(cfg)
        for batch in batches:
            ids = [np.append(x, end).tobytes() for x in encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    shared = texts.sparkSession.sparkContext.broadcast(definition)
    samples = sorted(bytes(r["ids"]) for r in cut(chosen.select("text")).repartition(8).mapInArrow(run, "ids binary").collect())
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    size = min(cfg.dictionary_bytes, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, cfg: TokenConfig) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if known:
        known.precompute_compress(cfg.level)
    return zstandard.ZstdCompressor(level=cfg.level, dict_data=known, write_checksum=True)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_tokens(
    candidates: DataFrame,
    path: str,
    definition: str,
    cfg: TokenConfig = TokenConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
) -> None:
    """Encode all texts and write ``path/segments`` and ``path/dictionary``.

    Null and empty texts have the end id alone. Documents stand in ascending order of
    their ids, null ids first, repeated ids side by side; segments are numbered in that order, part by part.
    An empty table writes no segments; other columns are not read.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    spark = texts.sparkSession
    dictionary = train_dictionary(texts, definition, cfg)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    shared = spark.sparkContext.broadcast((definition, dictionary))
    kind = texts.schema["candidate_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition_, dictionary_ = shared.value
        encode, press, end = tokenizer(definition_), _compressor(dictionary_, cfg), _end(cfg)
        part, number, frames, index, size = TaskContext.get().partitionId(), 0, [], [], 0

        def segment() -> pa.RecordBatch:
            row = {"part": part, "number": number, "dictionary_hash": digest, "frames": b"".join(frames), "index": index}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                entry = pa.struct([("candidate_id", batch.schema.field("candidate_id").type), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])
                arrow = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("dictionary_hash", pa.string()), ("frames", pa.binary()), ("index", pa.list_(entry))])
            for few in slices_by_bytes(batch, "text", cfg.bytes_per_batch):
                with many_small_objects():
                    found = encode(few.column("text"))
                for name, ids in zip(few.column("candidate_id").to_pylist(), found, strict=True):
                    frame = press.compress(np.append(ids, end).astype("<u4").tobytes())
                    index.append({"candidate_id": name, "offset": size, "length": len(frame), "n_tokens": len(ids) + 1})
                    frames.append(frame)
                    size += len(frame)
                    if size >= cfg.segment_bytes:
                        yield segment()
                        number, frames, index, size = number + 1, [], [], 0
        if index:
            yield segment()

    parts = max(1, -(-texts.count() // cfg.rows_per_task))
    ordered = texts.repartitionByRange(parts, "candidate_id").sortWithinPartitions("candidate_id", "text")
    ordered.mapInArrow(
        run,
        "part bigint, number bigint, dictionary_hash string, frames binary,"
        f" index array<struct<candidate_id: {kind}, offset: bigint, length: bigint, n_tokens: bigint>>",
    ).write.parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["dictionary_hash"], bytes(row["dictionary"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``candidate_id, start, n_tokens, part, number, offset, length``: where each document stands.

    ``start`` is the number of ids of all documents before it. No frame is read.
    """
    segments = spark.read.parquet(f"{path}/segments").select("part", "number", "index")
    counted = segments.select("part", "number", F.aggregate("index", F.lit(0).cast("bigint"), lambda s, x: s + x["n_tokens"]).alias("n"))
    # one row per segment of some megabytes: the running sum over them is short
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    entries = segments.select("part", "number", F.posexplode("index").alias("nth", "e"))
    inside = Window.partitionBy("part", "number").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("e.n_tokens").over(inside), F.lit(0))
    return (
        entries.withColumn("within", within)
        .join(first, ["part", "number"])
        .select("e.candidate_id", (F.col("first") + F.col("within")).alias("start"), "e.n_tokens", "part", "number", "e.offset", "e.length")
    )


def read_tokens(spark: SparkSession, path: str, checksums_only: bool = False) -> DataFrame:
    """``candidate_id, start, n_tokens`` and ``ids`` (or ``ids_crc32`` alone) of every document in the files.

    Segments with another dictionary than the stored one are an error.
    """
    digest, dictionary = _dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    counted = segments.select("part", "number", F.aggregate("index", F.lit(0).cast("bigint"), lambda s, x: s + x["n_tokens"]).alias("n"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    shared = spark.sparkContext.broadcast((digest, dictionary))
    kind = next(f.dataType.elementType["candidate_id"].dataType.simpleString() for f in segments.schema if f.name == "index")
    last, last_type = ("ids_crc32", pa.int64()) if checksums_only else ("ids", pa.list_(pa.int64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, dictionary_ = shared.value
        press = _decompressor(dictionary_)
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("dictionary_hash")[row].as_py() != wanted:
                    raise WrongDictionary(batch.column("dictionary_hash")[row].as_py())
                frames = memoryview(batch.column("frames")[row].as_buffer())
                index = batch.column("index")[row].values
                ids = index.field("candidate_id")
                counts = index.field("n_tokens").to_numpy()
                starts = batch.column("first")[row].as_py() + np.cumsum(counts) - counts
                values = []
                for at, length in zip(index.field("offset").to_numpy(), index.field("length").to_numpy(), strict=True):
                    raw = press.decompress(frames[at : at + length])
                    values.append(zlib.crc32(raw) if checksums_only else np.frombuffer(raw, dtype="<u4").astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, last_type)],
                    names=["candidate_id", "start", "n_tokens", last],
                )

    spark_type = "bigint" if checksums_only else "array<bigint>"
    joined = segments.join(first, ["part", "number"]).select("first", "dictionary_hash", "frames", "index")
    return joined.mapInArrow(run, f"candidate_id {kind}, start bigint, n_tokens bigint, {last} {spark_type}")


def read_document(spark: SparkSession, path: str, candidate_id) -> list[list[int]]:
    """Ids of the documents with one id, from their own frames only."""
    digest, dictionary = _dictionary(spark, path)
    entry = F.explode(F.filter("index", lambda e: e["candidate_id"].eqNullSafe(F.lit(candidate_id)))).alias("e")
    found = spark.read.parquet(f"{path}/segments").select("dictionary_hash", "part", "number", "frames", entry)
    frame = F.substring("frames", (F.col("e.offset") + 1).cast("int"), F.col("e.length").cast("int"))
    rows = found.orderBy("part", "number", "e.offset").select("dictionary_hash", frame.alias("frame")).collect()
    if any(r["dictionary_hash"] != digest for r in rows):
        raise WrongDictionary(path)
    press = _decompressor(dictionary)
    return [np.frombuffer(press.decompress(bytes(r["frame"])), dtype="<u4").tolist() for r in rows]
