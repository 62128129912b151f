"""Token ids as flat binary files.

Documents are dealt out by ranges of their order, so the files, by number, hold the whole corpus in
order. A file is the ids of its documents, each ended by the end id, as little-endian unsigned
integers (16 bits if the vocabulary allows, else 32), and then a footer: document ids, the start of
each document as 64-bit offsets, the counts. Where a file's ids start in the whole corpus (its base)
is the prefix sum of the files before it. ``Shard`` maps a file into memory.

The files are written by Spark's text sink, so to any store Spark knows and with its commit
protocol: a lost executor's files are never half there. The sink ends every row with a line
separator; that separator is the end id itself.

Defined results: a null text is an empty one, an empty text has the end id only. Rows are documents:
repeated ids stay, in the order of their texts' hashes, and null ids come first. An empty table has
no files or files without documents. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from inkveil.functions.lineage import small_batches, written
from inkveil.llm.workers import frugal, kept

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
SHARD_BYTES = 32 << 20
_MAGIC = b"flatids1"
#: The splitting rule of the tokenizer file, a fixed value: no match holds white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts that libraries might lower, compose or split differently, or that may spell a special token.
_DELICATE = re.compile("[^\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e]|<\\|")
#: How vocabularies of bytes spell them: visible characters as they are, the others as the characters from 256 on. Spaces stay.
_SPELLED = np.arange(256, dtype="<u2")
_UNSEEN = [*range(33), *range(127, 161), 173]
_SPELLED[_UNSEEN] = 256 + np.arange(len(_UNSEEN))
_SPELLED[32] = 32
#: Where a long text may be cut.
_SPACE = re.compile(r"\s")
#: Kinds of the characters that the other texts have after lowering: white space, letters, numbers, anything else.
_KINDS = np.array([0 if chr(c).isspace() else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x3000)], dtype=np.uint8)
#: Letters that join an apostrophe which begins a word: one or two of them.
_JOINED = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Texts are cut into words together, about so many characters at a time.
_PIECE = 1 << 19
#: Words that a worker keeps, twice over, and their letters and ids in bytes: with what Python adds, some 50 MB at most.
_KNOWN, _KNOWN_BYTES = 1 << 17, 4 << 20


def _cut(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of lowered text that ends with a space, by the rule above."""
    kinds = _KINDS[chars]
    edges = np.flatnonzero((np.diff(kinds, prepend=255, append=255) != 0) | (np.append(kinds, 0) == 2))
    begins, ends = edges[:-1], edges[1:]
    words = kinds[begins] != 0
    begins, ends = begins[words], ends[words]
    # A lone apostrophe takes what it shortens from the letters behind it.
    lone = np.flatnonzero((ends - begins == 1) & (chars[begins] == ord("'")))
    lone = lone[(lone + 1 < len(begins)) & (ends[lone] == begins[np.minimum(lone + 1, len(begins) - 1)])]
    lone = lone[kinds[ends[lone]] == 1]
    first, second = chars[ends[lone]], chars[ends[lone] + 1]
    takes = np.isin(first, [ord(x) for x in _JOINED[0]]).astype(np.int64)
    for pair in _JOINED[1]:
        takes[(first == ord(pair[0])) & (second == ord(pair[1]))] = 2
    lone, takes = lone[takes > 0], takes[takes > 0]
    ends[lone] += takes
    begins[lone + 1] += takes
    some = begins < ends
    return begins[some], ends[some]


def _pieces(text: str) -> Iterator[str]:
    """Long texts, cut at white space."""
    at = 0
    while len(text) - at > 2 * _PIECE and (space := _SPACE.search(text, at + _PIECE)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


class Encoder:
    """Ids of whole texts: what the tokenizer gives, but each distinct word is merged once.

    The tokenizer never merges across the words of the splitting rule, so a text's ids are its words'
    ids. The ids of known words are kept; when there are too many, those that weren't met since the last time are
    forgotten. Another kind of tokenizer file, and delicate texts, are encoded whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype, self.known, self.size = Tokenizer.from_file(path), dtype, {}, 0
        # Only these parts of the file, as the vocabulary would stay in the worker's memory as Python objects.
        before, rule = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        parts = json.loads(rule.__getstate__()).get("pretokenizers", []) if rule else []
        kinds = [x["type"] for x in json.loads(before.__getstate__()).get("normalizers", [])] if before else []
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and bool(parts) and parts[0].get("pattern") == {"Regex": _SPLIT}
        # The same merges for words that are cut, lowered and spelled in bytes already.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_word = self.by_word and bool(suffix)
        # Ids that end a word; asked one by one, for the same reason.
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())) if self.by_word else ()
        self.lasts = np.array([n.endswith(suffix) for n in names], dtype=bool)
        self.before: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held, places, size = [], [], 0
        for i, text in enumerate(texts):
            if not self.by_word or _DELICATE.search(text):
                out[i].append(self._whole(text))
                continue
            for piece in _pieces(text):
                held.append(piece)
                places.append(i)
                size += len(piece)
                if size >= _PIECE:
                    for place, ids in zip(places, self._words(held), strict=True):
                        out[place].append(ids)
                    held, places, size = [], [], 0
        for place, ids in zip(places, self._words(held), strict=True):
            out[place].append(ids)
        return [b"".join(x) for x in out]

    def _words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, whose words are numbered together; the words' letters are two bytes each."""
        low = [t.lower() for t in texts]
        raw = " ".join([*low, ""]).encode("utf-16-le")
        chars = np.frombuffer(raw, dtype="<u2")
        begins, ends = _cut(chars)
        if not len(begins):
            return [b""] * len(texts)
        # The spaces between words leave the buffer, so that words are a binary array.
        marks = np.zeros(len(chars) + 1, dtype=np.int8)
        marks[begins] += 1
        marks[ends] -= 1
        letters = chars[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(ends - begins) * 2]).astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        ids = self._ids(every.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = every.indices.to_numpy(zero_copy_only=False)
        lengths = np.array([len(x) for x in ids]) // np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(ids), dtype=self.dtype)
        firsts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        sums = np.cumsum(n)
        whole = flat[np.arange(sums[-1]) + np.repeat(firsts[codes] - sums + n, n)]
        bounds = np.cumsum([len(t) + 1 for t in low])
        upto = np.concatenate([[0], sums])[np.searchsorted(begins, bounds)].tolist()
        return [whole[a:b].tobytes() for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        known = self.known
        out = list(map(known.get, words))
        unmet = [i for i, ids in enumerate(out) if ids is None]
        for i in unmet:
            out[i] = self.before.get(words[i])
        known.update((words[i], out[i]) for i in unmet if out[i] is not None)
        absent = [i for i in unmet if out[i] is None]
        new = [words[i] for i in absent]
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            joined = _SPELLED[np.frombuffer(b" \x00".join(some).decode("utf-16-le").encode(), dtype=np.uint8)].tobytes()
            found = self.merger.encode_batch_fast([joined.decode("utf-16-le")], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype=self.dtype)
            bounds = [0, *(np.flatnonzero(self.lasts[ids]) + 1).tolist()]
            width, raw = ids.itemsize, ids.tobytes()
            for i, word, begin, end in zip(absent[at : at + 1000], some, bounds, bounds[1:], strict=False):
                out[i] = known[word] = raw[begin * width : end * width]
            self.size += sum(map(len, some)) // 2 + len(raw)
        if len(known) >= _KNOWN or self.size >= _KNOWN_BYTES:
            self.before, self.known, self.size = known, {}, 0
        return out

def id_type(path: str = TOKENIZER) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _footer(docs: list, starts: list[int], dtype: str) -> bytes:
    valid = np.array([d is not None for d in docs], dtype=np.uint8)
    ids = np.array([d or 0 for d in docs], dtype="<i8")
    width = np.dtype(dtype).itemsize
    return ids.tobytes() + valid.tobytes() + np.array([*starts, len(docs), width], dtype="<i8").tobytes() + _MAGIC


def _encode(path: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, docs, starts = kept(("encoder", path, dtype), lambda: Encoder(path, dtype)), [], [0]
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = encode([t or "" for t in part.column(1).to_pylist()])
                docs += part.column(0).to_pylist()
                for v in values:
                    starts.append(starts[-1] + len(v) // width + 1)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([_footer(docs, starts, dtype)], pa.binary())], names=["value"])

    return run


def write(
    docs: DataFrame, path: str, order: list[Column] | None = None, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END
) -> str:
    """Write the ids of all texts in ascending ``order`` (default: the id) below ``path``."""
    whole = F.col(text).cast("string")
    keys = order or [F.col(doc).cast("bigint"), F.xxhash64(whole)]
    named = docs.select(F.col(doc).cast("bigint").alias("doc_id"), whole.alias("text"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    ks = [f"k{i}" for i in range(len(keys))]
    dtype = id_type(tokenizer)
    dealt = named.repartitionByRange(shards, *ks).sortWithinPartitions(*ks).select("doc_id", "text")
    separator = end.to_bytes(np.dtype(dtype).itemsize, "little").decode("latin-1")
    if not separator.isascii():
        raise ValueError(f"end id {end}: its bytes have to be below 128, as the sink encodes its separator")
    ids = dealt.mapInArrow(frugal(_encode(tokenizer, dtype), keeps=True), "value binary").select(F.col("value").cast("string"))
    with small_batches(docs.sparkSession):
        ids.write.option("lineSep", separator).text(path)
    return path


class Shard:
    """One file: ``ids`` of all its documents, ``docs`` and ``starts`` (one more than documents)."""

    def __init__(self, data):
        """``data``: a path, which is mapped into memory, or the bytes of a file."""
        raw = np.memmap(data, dtype=np.uint8, mode="r") if isinstance(data, str) else np.frombuffer(data, dtype=np.uint8)
        at = raw.tobytes().rfind(_MAGIC) if len(raw) < 64 else len(raw) - 64 + bytes(raw[-64:]).rfind(_MAGIC)
        n, width = np.frombuffer(raw[at - 16 : at], dtype="<i8").tolist()
        starts_at = at - 16 - 8 * (n + 1)
        self.starts = np.frombuffer(raw[starts_at : at - 16], dtype="<i8")
        valid = raw[starts_at - n : starts_at]
        ids = np.frombuffer(raw[starts_at - 9 * n : starts_at - n], dtype="<i8")
        self.docs = [d if v else None for d, v in zip(ids.tolist(), valid.tolist(), strict=True)]
        self.ids = raw[: int(self.starts[-1]) * width].view(f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(content.as_buffer())
            lengths = np.diff(shard.starts)
            crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in range(len(lengths))]
            columns = [np.full(len(lengths), part), np.arange(len(lengths)), shard.starts[:-1], lengths, np.array(crc, dtype=np.int64)]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(shard.docs, pa.int64()), *arrays], names=["doc_id", "part", "place", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all files below ``path``, from the files: id, place in the corpus, length, checksum."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint")
    schema = "doc_id bigint, part bigint, place bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    docs = written(files.select(part.alias("part"), "content").mapInArrow(frugal(_read), schema))
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "part", "place")
