"""Token-id files with keyed access through a minimal perfect hash index.

A file holds one run of documents in ascending order of id: raw ids one after another, and an index. The index is a minimal perfect hash by
displacement: a key's hash names a bucket, the bucket's displacement names the slot, and n keys fill n slots. A slot has a fingerprint of its key, which
turns away most keys that aren't there, and the ordinal of the document, whose stored key settles the rest. ``Shard.get`` reads the footer once, and then
for each key one displacement, one fingerprint, one ordinal, one key, two offsets and the ids, whatever the file's size. The manifest has the first and last key of
each file; ``lookup`` sends keys to the files whose range holds them and fetches each by the index.

The files go to the shared folder under names of their own for each attempt of a task; the manifest table, which Spark commits once,
says which ones count. A lost executor costs the shards that it was writing.

Layout, little-endian: ids (2 or 4 bytes each), keys (int64, in order of documents), offsets (uint64, one more than documents), displacements (int32),
fingerprints (uint32 by slot), ordinals (uint32 by slot), footer (FOOTER).

Defined results: a null text is an empty one and has the end id only; null ids come first; rows with one id lie side by side in the order of a hash of their
texts, over as many files as they fill, and are keyed by (id, how many before it in the file); a text of any length is encoded whole, in memory in proportion to it;
equal rows give equal results; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_texts, materialize, n_partitions, scratch_path, ship_package, table
from .textgrams import U, mix

MAGIC = b"LQTOKEN1"
FOOTER = struct.Struct("<QQIIQ8s")  # documents, ids, bytes of an id, buckets, seed, MAGIC
BUCKET_KEYS = 4
END_ID = 2
SHARD_BYTES = 64 << 20
#: The bound on files: their first and last keys (16 bytes each) go to every task of a lookup. Beyond it the files grow instead.
MAX_FILES = 100_000
MAX_WORDS = 1_000_000
LEARN_WORDS = 50_000
#: Marks that are pieces of their own after a letter or digit; an apostrophe isn't, as it begins contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
NULL_KEY = np.iinfo(np.int64).min


def key_hashes(keys: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (key, how many equal keys before it)."""
    x = keys.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + nth.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(seed)
    return mix(mix(x) ^ U(0x165667B19E3779F9))


def _slot(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ (displacement.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)) % U(n)).astype(np.int64)


def build_index(h: np.ndarray) -> np.ndarray | None:
    """Displacements for distinct hashes; None if two are equal, for another seed. A negative one, -1 - s, sends a bucket of one key to slot s."""
    n = len(h)
    if len(np.unique(h)) < n:
        return None
    buckets = max(1, -(-n // BUCKET_KEYS))
    where = (h % U(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    size = np.bincount(where, minlength=buckets)
    first = np.cumsum(size) - size
    out, taken = np.zeros(buckets, np.int32), np.zeros(n, bool)
    tries = np.arange(64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = h[order[first[b] : first[b] + size[b]]]
        base = 0
        while True:
            slots = _slot(own[None, :], (tries + base)[:, None], n)
            ok = ~taken[slots].any(axis=1)
            for t in np.flatnonzero(ok):
                if len(set(slots[t].tolist())) == size[b]:
                    out[b] = base + t
                    taken[slots[t]] = True
                    break
            else:
                base += len(tries)
                continue
            break
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(size == 1)
    out[single] = -1 - free[: len(single)]
    return out


def lookup_slots(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[(h % U(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -1 - d.astype(np.int64), _slot(h, np.maximum(d, 0), n))


def occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal keys come before each, in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class ShardWriter:
    """Writes one file: payload as it comes, then the index."""

    def __init__(self, stream, item: int):
        self.stream, self.item, self.keys, self.counts = stream, item, [], []

    def add(self, key: int, packed: bytes) -> None:
        self.stream.write(packed)
        self.keys.append(key)
        self.counts.append(len(packed) // self.item)

    def close(self) -> tuple[int, int]:
        keys, offsets = np.array(self.keys, np.int64), np.concatenate([[0], np.cumsum(self.counts)]).astype(np.uint64)
        nth, seed, displacements = occurrence(keys), 0, None
        while displacements is None:
            seed += 1
            h = key_hashes(keys, nth, seed)
            displacements = build_index(h)
        slot = lookup_slots(h, displacements, len(keys))
        prints, ordinals = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
        prints[slot], ordinals[slot] = (h >> U(32)).astype(np.uint32), np.arange(len(keys), dtype=np.uint32)
        for part in (keys, offsets, displacements, prints, ordinals):
            self.stream.write(part.tobytes())
        self.stream.write(FOOTER.pack(len(keys), int(offsets[-1]), self.item, len(displacements), seed, MAGIC))
        return len(keys), int(offsets[-1])


class Shard:
    """An open file. Single lookups read what they need; the arrays of the index are read whole when many are asked for."""

    PARTS = (("keys", "<i8"), ("offsets", "<u8"), ("displacements", "<i4"), ("prints", "<u4"), ("ordinals", "<u4"))

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.stream = system.open_input_file(place)
        end = self.stream.size()
        if end < FOOTER.size:
            raise ValueError(f"{path} is no token file")
        self.n, n_ids, self.item, buckets, self.seed, magic = FOOTER.unpack(self.stream.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        at, self.places = n_ids * self.item, {}
        for (name, kind), count in zip(self.PARTS, (self.n, self.n + 1, buckets, self.n, self.n), strict=True):
            self.places[name] = (at, count, np.dtype(kind))
            at += np.dtype(kind).itemsize * count
        self.held: dict[str, np.ndarray] = {}

    def part(self, name: str) -> np.ndarray:
        """One array of the index."""
        if name not in self.held:
            at, count, kind = self.places[name]
            self.held[name] = np.frombuffer(self.stream.read_at(kind.itemsize * count, at), kind)
        return self.held[name]

    def items(self, name: str, i: int, n: int = 1) -> np.ndarray:
        """n entries of one array of the index."""
        if name in self.held:
            return self.held[name][i : i + n]
        at, _, kind = self.places[name]
        return np.frombuffer(self.stream.read_at(kind.itemsize * n, at + kind.itemsize * i), kind)

    def find(self, keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Ordinals of keys by the index; -1 where the fingerprint or the stored key says that a key isn't there."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1)
        h = key_hashes(keys, nth, self.seed)
        slot = lookup_slots(h, self.part("displacements"), self.n)
        ordinal = self.part("ordinals")[slot].astype(np.int64)
        there = (self.part("prints")[slot] == (h >> U(32)).astype(np.uint32)) & (self.part("keys")[ordinal] == keys)
        return np.where(there, ordinal, -1)

    def ids(self, ordinal: int) -> np.ndarray:
        a, b = self.items("offsets", ordinal, 2).tolist()
        return np.frombuffer(self.stream.read_at((b - a) * self.item, a * self.item), f"<u{self.item}")

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, by a constant number of small reads; None if the file doesn't hold it."""
        if not self.n:
            return None
        h = key_hashes(np.array([key]), np.array([nth]), self.seed)
        d = self.items("displacements", int(h[0] % U(self.places["displacements"][1])))
        slot = int(lookup_slots(h, d, self.n)[0])
        if self.items("prints", slot)[0] != (h >> U(32)).astype(np.uint32)[0]:
            return None
        ordinal = int(self.items("ordinals", slot)[0])
        return self.ids(ordinal) if self.items("keys", ordinal)[0] == key else None


class WordTokenizer:
    """Ids of a text by the tokenizers library. No piece of this tokenizer crosses ASCII white space and case is folded, so words are encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.item = 2 if max(self.tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else 4
        self.memo: dict[bytes, bytes] = {}
        self.closing: dict[str, bool] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.item}").tobytes()

    def _closes(self, stem: str) -> bool:
        """Whether marks after this stem are a piece of their own: the normalised stem, which may end in a combining mark where the stem ends in a letter, has to end in a letter or digit."""
        if stem.isascii():
            return stem[-1].isalnum()
        last = self.tokenizer.normalizer.normalize_str(stem)[-1:]
        if last not in self.closing:  # asked of the library, whose letters may be of another Unicode version
            self.closing[last] = last.isalnum() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(last + ".")) == 2
        return self.closing[last]

    def _encode_new(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of words that the memo lacks, and of their parts. A run of marks after a letter or digit is a piece of its own: such a word is its stem and the run."""
        marked = {}
        for w in words:
            text = w.decode()
            stem = text.rstrip(MARKS)
            if stem and len(stem) < len(text) and self._closes(stem):
                marked[w] = (stem.encode(), text[len(stem) :].encode())
        new = [w for w in {*(w for w in words if w not in marked), *(p for pair in marked.values() for p in pair)} if w not in self.memo]
        found = {}
        for a in range(0, len(new), LEARN_WORDS):
            part = new[a : a + LEARN_WORDS]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                found[w] = self.pack(e.ids)
        packed = lambda p: found[p] if p in found else self.memo[p]
        for w, (stem, mark) in marked.items():
            found[w] = packed(stem) + packed(mark)
        return found

    def encode_packed(self, text: str) -> bytes:
        raw = text.encode()
        if b"\xcc" not in raw:  # no U+0300 to U+033F: some compose with a small letter but not with its capital
            raw = raw.lower()
        if b"<|" in raw:  # may hold a special token's string, whose case counts
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words, memo = raw.split(), self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            found = self._encode_new({w for w in words if w not in memo})
        out = b"".join([found[w] if w in found else memo[w] for w in words])
        if len(memo) + len(found) > MAX_WORDS:
            memo.clear()
        if len(found) <= MAX_WORDS:
            memo.update(found)
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)


MANIFEST = "part int, path string, first_key long, last_key long, n_docs long, n_ids long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Encode and write all documents; the manifest: part, path, first_key, last_key (the smallest long for null), n_docs, n_ids, first_id (ids in all files before)."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed_texts(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(n_partitions(spark), min(MAX_FILES, -(-total // SHARD_BYTES)))

    def write(batches):
        from pyspark import TaskContext

        writer, part, system = None, TaskContext.get().partitionId(), None
        t = tokenizer(tokenizer_path)
        end = t.pack([END_ID])
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    path = f"{folder}/part-ids-{part:06d}-{uuid.uuid4().hex}.bin"
                    system, place = fs.FileSystem.from_uri(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    writer = ShardWriter(system.open_output_stream(place), t.item)
                k = key.as_py()
                writer.add(int(NULL_KEY) if k is None else k, t.encode_packed(text.as_py() or "") + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            writer.stream.close()
            row = {"part": part, "path": path, "first_key": writer.keys[0], "last_key": writer.keys[-1], "n_docs": n_docs, "n_ids": n_ids}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("first_key", "last_key", "n_docs", "n_ids"))]))

    # The text's hash splits an id that many rows share, null ones included.
    by_key = ["doc_id", F.xxhash64("text")]
    dealt = texts.repartitionByRange(n, *by_key).sortWithinPartitions(*by_key)
    manifest = materialize(dealt.mapInArrow(write, MANIFEST), "token_manifest")
    # One row for each file: the running sum is over the manifest, not over documents.
    return manifest.withColumn("first_id", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files whose id is in the column doc_id of keys, fetched by its key through the index.

    Keys go to the files whose range holds them; more than one where rows with one id span files.
    """
    ship_package(manifest.sparkSession)
    files = manifest.select("part", "first_key", "last_key", "path", "first_id").orderBy("part").collect()  # at most MAX_FILES rows, or shuffle.partitions
    first, last = (np.array([f[c] for f in files], np.int64) for c in ("first_key", "last_key"))
    places = manifest.select("part", "path", "first_id")

    def deal(batches):
        for batch in batches:
            k = batch.column(0).fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(last, k, "left"), np.searchsorted(first, k, "right")
            n = np.maximum(high - low, 0)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at], pa.int32()), pa.array(np.repeat(k, n))], ["part", "key"])

    numbers = np.array([f["part"] for f in files], np.int32)

    def fetch(key, group):
        shard = Shard(group.column("path")[0].as_py())
        base, asked, nth, out = group.column("first_id")[0].as_py(), group.column("key").to_numpy(), 0, []
        while len(asked):
            found = shard.find(asked, np.full(len(asked), nth))
            asked, found = asked[found >= 0], found[found >= 0]
            crc = np.array([zlib.crc32(shard.ids(int(o)).astype("<u4").tobytes()) for o in found], np.int64)
            begin, after = shard.part("offsets")[found].astype(np.int64), shard.part("offsets")[found + 1].astype(np.int64)
            out.append(pa.table([pa.array(asked, mask=asked == NULL_KEY), pa.array(begin + base), pa.array(after - begin), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]))
            nth += 1
        return pa.concat_tables(out)

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(deal, "part int, key long")
    return asked.join(places, "part").groupBy("part").applyInArrow(fetch, DIGEST)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return lookup(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token_files")), docs)


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
