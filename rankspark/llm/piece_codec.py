"""SentencePiece encoding of candidate texts without running the merges, and decoding.

A merge-type (BPE) encoding is the only sequence of pieces that spells the text and whose
neighbours are all compatible: encoding the two of them together gives the two back. So it
can be searched for instead of merged: take the longest piece at the current place (from an
Aho-Corasick automaton over all pieces), check that it is compatible with the piece before
it, and go back where no piece fits, with a bit set for every place known to fail.
Compatibility is checked by undoing the last merges of both pieces, the later one first: if
a merge across the border came before the one undone, the pieces would not have formed.

White space never stands inside a piece after another character, so a text falls into
words that are encoded on their own; their results are remembered while a worker lives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from rankspark.llm.common import Recent, many_small_objects, per_worker, pick, slices

SPACE = "▁"


class UnsupportedModel(ValueError):
    """The model is not of the kind that the search can encode exactly."""


class PieceEncoder:
    """Exact encoder for a merge-type model with byte fallback and the identity normaliser."""

    def __init__(self, model: bytes) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.text: list[str] = []
        self.rank: list[float] = []
        self.id: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            usable = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            self.text.append(piece)
            self.rank.append(-sp.get_score(i) if usable and len(piece) > 1 else -1.0)
            if usable:
                self.id[piece] = i
        if len(self.bytes) < 256:
            raise UnsupportedModel("byte fallback is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise UnsupportedModel("a piece has white space after another character")
        self.line_feed_splits = not any("\n" in p for p in self.id)
        # characters that only occur inside longer pieces still take part in merges
        for c in sorted({c for p in self.id for c in p} - set(self.id)):
            self.id[c] = len(self.text)
            self.text.append(c)
            self.rank.append(-1.0)
        self.n_pieces = n
        self.halves: dict[int, tuple[int, int]] = {}
        self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) == 1 or i in self.halves:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # the longest shorter piece that each piece begins with
        self.length = [len(t) for t in self.text]
        self.shorter = [-1] * len(self.text)
        for piece, i in self.id.items():
            for cut_ in range(len(piece) - 1, 0, -1):
                j = self.id.get(piece[:cut_])
                if j is not None and (cut_ == 1 or j in self.halves):
                    self.shorter[i] = j
                    break
        self.pairs = Recent(self._compatible, 150_000)
        self.words = Recent(self._word, 400_000)
        self.shown = list(map(str, range(n)))
        self.characters = frozenset(c for c in self.id if len(c) == 1)

    def _learn_merges(self) -> None:
        """The last merge of every piece; a piece that its own characters do not merge to is never made."""
        for piece, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            if len(piece) > 1:
                last = self._merge(piece)
                if last is not None:
                    self.halves[i] = last

    def _merge(self, piece: str) -> tuple[int, int] | None:
        parts = [self.id[c] for c in piece]
        while len(parts) > 1:
            best, at = float("inf"), -1
            for k in range(len(parts) - 1):
                joint = self.id.get(self.text[parts[k]] + self.text[parts[k + 1]])
                if joint is not None and self.rank[joint] < best:
                    best, at = self.rank[joint], k
            if at < 0:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [self.id[self.text[parts[at]] + self.text[parts[at + 1]]]]
        return None

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether two neighbours stay as they are: no merge across their border comes before one inside them."""
        a, b = pair
        rank, before, tie = self.rank, float("inf"), False
        while True:
            joint = self.id.get(self.text[a] + self.text[b])
            if joint is not None and (rank[joint] < before or (tie and rank[joint] == before)):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                # the merge inside the left piece stands before the border and wins a tie
                before, tie, a = rank[a], False, self.halves[a][1]
            else:
                before, tie, b = rank[b], True, self.halves[b][0]

    def _search(self, text: str) -> list[int]:
        """Pieces of a run of characters that all occur in pieces."""
        pairs, length, shorter, n = self.pairs, self.length, self.shorter, len(text)
        # longest matches one after the other; if all neighbours are compatible, that is the encoding
        found = [i for _, (i, _) in self.automaton.iter_long(text)]
        longest, at, last = {}, 0, -1
        for good, i in enumerate(found):
            if last >= 0 and not pairs[last, i]:
                break
            longest[at] = last = i
            at += length[i]
        else:
            return found
        # else from the first pair that is not: shorter pieces, and back where there are none
        del found[good:]
        failed = 0  # places from which the rest cannot be encoded
        while True:
            if i < 0:
                failed |= 1 << at
                if not found:
                    raise UnsupportedModel(f"no encoding of {text!r}")
                i = found.pop()
                at -= length[i]
                i = shorter[i]
                last = found[-1] if found else -1
            elif failed >> (at + length[i]) & 1 or (last >= 0 and not pairs[last, i]):
                i = shorter[i]
            else:
                found.append(i)
                last = i
                at += length[i]
                if at == n:
                    return found
                i = longest.get(at, -1)
                if i < 0:
                    i = longest[at] = next(self.automaton.iter_long(text, at))[1][0]

    def _spell(self, i: int) -> list[int]:
        """Ids of a piece; a character that is no piece becomes its bytes."""
        return [i] if i < self.n_pieces else [self.bytes[b] for b in self.text[i].encode("utf-8")]

    def _word(self, word: str) -> str:
        """Decimal ids joined by commas: much smaller to remember than numbers."""
        if self.characters.issuperset(word):
            found = self._search(word)
        else:
            # a character of no piece is its bytes and ends what stands before it
            found = []
            for unknown, run in groupby(word, lambda c: c not in self.characters):
                run = "".join(run)
                found.extend((self.bytes[b] for b in run.encode("utf-8")) if unknown else self._search(run))
        if found and max(found) >= self.n_pieces:
            found = list(chain.from_iterable(map(self._spell, found)))
        shown = self.shown
        return ",".join([shown[i] for i in found])

    _SPLIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
    _SPLIT_SPACE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def encode(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Ids of a text, word by word: as decimal text joined by commas and as numbers."""
        return [(w, tuple(map(int, w.split(",")))) for w in self.encode_words(text)]

    def encode_words(self, text: str) -> list[str]:
        """Ids of a text, word by word, as decimal text joined by commas."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if self.line_feed_splits and SPACE * 2 not in marked:
            parts = marked.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")
            return list(map(self.words.__getitem__, filter(None, parts)))
        split = self._SPLIT if self.line_feed_splits else self._SPLIT_SPACE
        return list(map(self.words.__getitem__, split.findall(marked)))


def numbers(joined: str) -> np.ndarray:
    """Ids from their decimal text."""
    return np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.empty(0, dtype=np.int32)


def encoder(model: bytes) -> PieceEncoder:
    return per_worker(f"pieces {hashlib.sha256(model).hexdigest()}", lambda: PieceEncoder(model))


def load_model(path: str) -> bytes:
    """The model file, read where the job is started; tasks get its bytes and need no file."""
    with open(path, "rb") as f:
        return f.read()


def _texts(candidates: DataFrame, candidate_id: str, text: str) -> DataFrame:
    return pick(candidates, candidate_id=candidate_id, text=text)


def encode_candidates(
    candidates: DataFrame, model: bytes, candidate_id: str = "candidate_id", text: str = "text"
) -> DataFrame:
    """``candidate_id, ids``: ids of every whole text, without begin and end ids.

    Null and empty texts have no ids. Every row gives one row, repeated and null ids
    included; an empty table gives an empty result; other columns are not read.
    """
    texts = _texts(candidates, candidate_id, text)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [numbers(",".join(codec.encode_words(x.as_py() or ""))) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("candidate_id"), pa.array(ids, pa.list_(pa.int32()))], names=["candidate_id", "ids"]
                )

    kind = texts.schema["candidate_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"candidate_id {kind}, ids array<int>")


def decode_candidates(encoded: DataFrame, model: bytes, candidate_id: str = "candidate_id", ids: str = "ids") -> DataFrame:
    """``candidate_id, text``: the text of every list of ids; null or empty lists give the empty text."""
    rows = pick(encoded, candidate_id=candidate_id, ids=ids)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(shared.value).library
        for batch in batches:
            texts = [library.decode(x.as_py() or []) or "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("candidate_id"), pa.array(texts, pa.string())], names=["candidate_id", "text"]
            )

    kind = rows.schema["candidate_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"candidate_id {kind}, text string")


def codec_digests(candidates: DataFrame, model: bytes, candidate_id: str = "candidate_id", text: str = "text") -> DataFrame:
    """``candidate_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass, as checksums.

    ``ids_sha256`` is that of the decimal ids joined by commas, ``decoded_sha256`` that of the
    decoded text in UTF-8, both in lowercase hexadecimal. Null texts count as empty; rows are
    treated as by ``encode_candidates``.
    """
    texts = _texts(candidates, candidate_id, text)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(shared.value)
        decode = codec.library.decode
        sha = hashlib.sha256
        for batch in slices(batches):
            n, of_ids, of_text = [], [], []
            for x in batch.column("text"):
                with many_small_objects():
                    joined = ",".join(codec.encode_words(x.as_py() or ""))
                ids = numbers(joined).tolist()
                n.append(len(ids))
                of_ids.append(sha(joined.encode("ascii")).hexdigest())
                of_text.append(sha((decode(ids) if ids else "").encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("candidate_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=["candidate_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = texts.schema["candidate_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"candidate_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
