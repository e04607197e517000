"""Best-fit packing (operator 9): sum-of-squares placement of token pieces into sequences.

A document is its token ids and an end id. Documents longer than a sequence are cut into whole
sequences and a rest. A whole sequence stands alone; other pieces are dealt by hash to groups of
about ``GROUP`` pieces, and each group is packed, longest pieces first, by the sum-of-squares rule: a piece
goes where the sum of the squared counts of open sequences per residual gap becomes smallest (ties:
the smallest gap left); a new sequence is opened where no open one has room.

Texts are cut at ASCII white space, and between a letter and punctuation, before they reach the
tokenizer, which never joins ids across either, and lower-cased, as the tokenizer does itself; the ids
of each such word are kept in a bounded table of the worker. A tokenizer whose file doesn't say that it works
so gets whole texts.

Defined cases: null and empty texts are one piece, the end id. Repeated rows are packed each. An
empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import filterfalse, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import map_arrow, materialise, read

LENGTH = 2048
END_ID = 0
#: Pieces of a group, about: one task packs a group, and leaves a few sequences open.
GROUP = 20_000
#: Words in each of the two tables that a worker keeps.
WORDS = 300_000
#: Stands between words that share a text on their way through the tokenizer.
MARK = "~"

#: A letter and a mark of punctuation, which are never one part of a text and don't merge into one character.
AFTER_LETTER = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:$&%#*)])"
#: Texts whose ASCII letters are left to the tokenizer: those that may hold a special token or combining marks.
KEEPS_CASE = "<\\||[\u0300-\u036f]"

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

_KEPT: dict[int, Words] = {}


def works_by_words(json_text: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space, and joins neither letters with other characters nor words."""
    c = json.loads(json_text)
    flat = lambda x, many: [x] if x and many not in x else (x or {}).get(many, [])
    normal, cut = flat(c.get("normalizer"), "normalizers"), flat(c.get("pre_tokenizer"), "pretokenizers")
    split = cut[0] if cut and cut[0].get("type") == "Split" else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    removes = split.get("behavior") == "Removed" and split.get("invert") is True and "[\\p{L}]+|" in pattern and pattern.endswith("[^\\s\\p{L}\\p{N}]+")
    return any(n["type"] == "Lowercase" for n in normal) and removes and c["model"].get("end_of_word_suffix") == "</w>"


class Words:
    """Ids of words, kept in two tables: when the newer one is full it becomes the older one."""

    def __init__(self, text: str, kept: int = WORDS):
        from tokenizers import Tokenizer

        self.coder, self.kept, self.by_words = Tokenizer.from_str(text), kept, works_by_words(text)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.mark = self.coder.encode(MARK, add_special_tokens=False).ids
        vocabulary = self.coder.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part of a text
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, without the end id; each distinct word of the texts is looked up once."""
        if not len(texts):
            return []
        if not self.by_words:
            return [np.array(self.coder.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        apart = pc.replace_substring_regex(texts, AFTER_LETTER, r"\1 \2")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(apart, KEEPS_CASE), apart, pc.ascii_lower(apart)))
        coded = words.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_buffer().to_pybytes().split(b" ")
        lacking = list(filterfalse(self.new.__contains__, distinct))
        if len(self.new) + len(lacking) > self.kept:
            self.old, self.new = self.new, {}
            lacking = distinct
        known = list(filter(self.old.__contains__, lacking))
        self.new |= zip(known, map(self.old.__getitem__, known), strict=True)
        self.new |= self.ids(list(filterfalse(self.old.__contains__, lacking)))
        found = list(map(self.new.__getitem__, distinct))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        held = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), np.frombuffer(b"".join(found), "<u4"))
        taken = held.take(coded.indices)
        bounds = taken.offsets.to_numpy()[words.offsets.to_numpy()]
        ids = taken.values.to_numpy()
        return [ids[a:b] for a, b in pairwise(bounds.tolist())]

    def ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word as little-endian bytes. Many words share a text on their way through the tokenizer.

        Words of letters are one part each, so that ids which end a part tell them apart. Other
        words stand between marks, whose single id nothing else has; those that hold the mark's
        character, or whose text didn't come apart as expected, go alone.
        """
        out: dict[bytes, bytes] = {}
        self._share([w for w in words if _LETTERS.fullmatch(w.decode())], b" ", out)
        if len(self.mark) == 1:
            self._share([w for w in words if w not in out and MARK.encode() not in w], f" {MARK} ".encode(), out)
        alone = [w for w in words if w not in out]
        for w, e in zip(alone, self._batch(alone), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def _batch(self, texts: list[bytes]) -> list:
        return self.coder.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)

    def _share(self, words: list[bytes], between: bytes, out: dict[bytes, bytes]) -> None:
        parts = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for part, e in zip(parts, self._batch([between.join([*x, b""]) for x in parts]), strict=True):
            ids = np.array(e.ids, "<u4")
            if between == b" ":
                stops = np.flatnonzero(self.last[ids]) + 1
                starts = np.concatenate([[0], stops[:-1]])
            else:
                stops = np.flatnonzero(ids == self.mark[0])
                starts = np.concatenate([[0], stops[:-1] + 1])
            if len(stops) == len(part):
                raw = ids.tobytes()
                out |= zip(part, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * stops).tolist(), strict=True)], strict=True)


def encode(vocabulary_: str, texts: pa.Array) -> list[np.ndarray]:
    """Ids of whole texts, without the end id, by this worker's tables."""
    key = hash(vocabulary_)
    if key not in _KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _KEPT.clear()
        _KEPT[key] = Words(vocabulary_)
    return _KEPT[key].encode(texts)


def sum_of_squares(lengths: np.ndarray, size: int = LENGTH, open_early: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the order given.

    By the plain rule (``open_early``) a new sequence competes with the open ones; else one is opened only
    where no open one has room, which leaves fewer sequences when pieces come longest first.
    """
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by gap
    count = np.zeros(size + 1, np.int64)
    used: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        # change of the sum if a sequence of gap g gets the piece; gap 0 is closed and counts nothing
        change = 2 * (count[: size + 1 - n] - count[n:]) + 2
        change[0] = 1 - 2 * count[n]
        room = count[n:] > 0
        change = np.where(room, change, np.iinfo(np.int64).max)
        if open_early or not room.any():
            change[size - n] = 2 * count[size - n] + 1 if n < size else 0  # a new sequence
        left = int(change.argmin())
        if left == size - n:
            bin_, at = len(used), 0
            used.append(0)
        else:
            bin_ = open_at[left + n].pop()
            count[left + n] -= 1
            at = used[bin_]
        used[bin_] = at + n
        if left:
            open_at[left].append(bin_)
            count[left] += 1
        where[k], offset[k] = bin_, at
    return where, offset


def pieces(docs: DataFrame, vocabulary_: str, size: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, at = [], []
        for i, ids in enumerate(encode(shared.value, batch.column(1).fill_null(""))):
            raw = ids.tobytes() + END_ID.to_bytes(4, "little")
            for k, start in enumerate(range(0, len(ids) + 1, size)):
                part = raw[4 * start : 4 * (start + size)]
                rows.append((k, start, len(part) // 4, zlib.crc32(part)))
                at.append(i)
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary_: str, size: int = LENGTH, group: int = GROUP) -> DataFrame:
    """A row for each piece with its sequence_id and offset.

    Sequences of group g have ids from g * 2**32; whole ones have negative ids.
    """
    cut = pieces(docs, vocabulary_, size).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(cut, "pieces")
    groups = max(1, round(rows.where(F.col("length") < size).count() / group))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        where, offset = sum_of_squares(part["length"].to_numpy(), size)
        return part.assign(sequence_id=(int(part["group"].iloc[0]) << 32) + where, offset=offset)[[x.split()[0] for x in schema.split(", ")]]

    rest = rows.where(F.col("length") < size).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    whole = rows.where(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.groupBy("group").applyInPandas(place, schema).unionByName(whole)


def vocabulary(path: str | None = None) -> str:
    """A tokenizer file as text; it is read by the driver and sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary())
