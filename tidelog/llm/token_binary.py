"""Token ids as flat unsigned integer files with 64-bit document offsets.

A dataset is a folder of shards, in ascending doc_id order:

``NNNNNN.bin``  ids of all documents of the shard, little-endian unsigned,
                each document followed by the end id; 16 bits an id where
                the vocabulary has at most 65,536 ids, else 32
``NNNNNN.off``  n + 1 little-endian unsigned 64-bit offsets, counted in ids,
                of the shard's documents
``NNNNNN.doc``  n little-endian signed 64-bit document ids

A shard's base, the number of ids before it, is the prefix sum of the sizes
of the shards before it.  One range shuffle of the texts by doc_id makes the
shards; each is written under a name of the task attempt and renamed, so a
task that is run again leaves the same file.  Reading maps the files into
memory where the folder is a mounted one.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
#: Encoded chunks kept for reuse by a worker process, in a young and an old generation; what isn't met in one goes with the next.
MEMO = 1_400_000
#: Texts encoded together.
TEXTS = 2000
#: How a byte-level vocabulary writes a space.
SPACE_BYTE = "Ġ"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_kind(n_ids: int) -> str:
    """The numpy type of a dataset's ids."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


class ChunkEncoder:
    """Ids of whole texts by a tokenizers model, with a memo of frequent chunks.

    A text is cut before each single space; a byte-level model with the usual
    pattern never has a piece over such a place, as a space can only begin a
    piece or belong to a run of white space.  So a text's ids are those of its
    chunks, which repeat a lot.  Texts where a run of white space may go on
    over a cut are encoded as they are.  New chunks are cut once more, around
    single line breaks and before a last full stop or comma after a letter,
    where pieces end too, and what is new then is encoded many at a time: after
    single spaces, as in a text, or with a special token between, which no
    piece crosses either.
    """

    JOIN = 2048
    TAILS = frozenset(".,")
    RUN = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.memo = memo
        self.kind = id_kind(self.model.get_vocab_size(with_added_tokens=True))
        self.width = np.dtype(self.kind).itemsize
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # parts of chunks that have no space before them
        special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.mark, mark_id = next(iter(special.items()), (None, None))
        vocabulary = self.model.get_vocab()
        self.is_mark, self.spaced = np.zeros((2, max(vocabulary.values(), default=0) + 1), bool)
        if self.mark is not None:
            self.is_mark[mark_id] = True
        self.spaced[[i for x, i in vocabulary.items() if x.startswith(SPACE_BYTE)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str, starts: np.ndarray, n: int) -> list[bytes] | None:
        """Ids of a text in ``n`` parts that begin where ``starts`` holds for an id; None: there are more or fewer."""
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        at = (self.width * np.flatnonzero(starts[ids])).tolist()
        if len(at) != n:
            return None
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]

    def _many(self, parts: list[str]) -> list[bytes]:
        """Ids of short texts, each as if alone, joined with a special token between."""
        if self.mark is None:
            return self._encode(parts)
        out: list[bytes] = []
        for k in range(0, len(parts), self.JOIN):
            some = parts[k : k + self.JOIN]
            found = self._cut(self.mark + self.mark.join(some), self.is_mark, len(some))
            out += [x[self.width :] for x in found] if found else self._encode(some)  # one holds the special token itself
        return out

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that stand after a space, each as if alone; a piece that begins with a space begins a chunk."""
        out: list[bytes | None] = [None] * len(chunks)
        plain = [k for k, c in enumerate(chunks) if c and not c[0].isspace() and not c[-1].isspace()]
        for a in range(0, len(plain), self.JOIN):
            some = plain[a : a + self.JOIN]
            found = self._cut(" " + " ".join([chunks[k] for k in some]), self.spaced, len(some))
            for k, x in zip(some, found or self._many([" " + chunks[k] for k in some]), strict=True):
                out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._many([" " + chunks[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def _parts(self, chunk: str) -> tuple[str, list[str]] | None:
        """The chunk that a chunk begins with and the texts that follow it, cut where pieces end in any case; None: it has one part."""
        head, *lines = chunk.split("\n")
        if lines and any(not x or x[0].isspace() or x[-1].isspace() for x in (head, *lines)):
            return None
        rest = []
        if head[-1:] in self.TAILS and head[-2:-1].isalpha():
            rest.append(head[-1])
            head = head[:-1]
        for line in lines:
            rest.append("\n")
            if line[-1] in self.TAILS and line[-2:-1].isalpha():
                rest += [line[:-1], line[-1]]
            else:
                rest.append(line)
        return (head, rest) if rest else None

    def _learn(self, chunks: list[str]) -> None:
        known, old, bare = self.known, self.old, self.bare
        single: list[str] = []  # chunks of one part
        tailed: list[str] = []  # a head and a last full stop or comma
        cut: list[tuple[str, str, list[str]]] = []
        for c in chunks:
            if c.isalpha() or c.isdigit():
                single.append(c)
            elif "\n" in c:
                p = self._parts(c)
                if p:
                    cut.append((c, *p))
                else:
                    single.append(c)
            elif c[-1:] in self.TAILS and c[-2:-1].isalpha():
                tailed.append(c)
            else:
                single.append(c)
        heads = [c[:-1] for c in tailed]
        need = set(single)
        for h in (*heads, *(head for _, head, _ in cut)):
            if h not in known and h not in need:
                x = old.get(h)
                if x is None:
                    need.add(h)
                else:
                    known[h] = x
        names = list(need)
        known.update(zip(names, self._spaced(names), strict=True))
        names = list({x for _, _, rest in cut for x in rest if x not in bare} | (self.TAILS - bare.keys()))
        bare.update(zip(names, self._many(names), strict=True))
        known.update((c, known[h] + bare[c[-1]]) for c, h in zip(tailed, heads, strict=True))
        for c, head, rest in cut:
            known[c] = known[head] + b"".join([bare[x] for x in rest])
        if len(bare) > self.memo // 8:
            self.bare = {}

    def _of(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that stand after a space."""
        found = list(map(self.known.get, chunks))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            need = {chunks[k] for k in gaps}
            old = self.old
            kept = [c for c in need if c in old]
            self.known.update(zip(kept, map(old.__getitem__, kept), strict=True))
            self._learn(list(need.difference(kept)))
            known = self.known
            for k in gaps:
                found[k] = known[chunks[k]]
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.memo // 2:
            self.old, self.known = self.known, {}
        cut = [t.split(" ") for t in texts]
        flat: list[str] = []
        for chunks in cut:
            flat += chunks[1:]
        ids = self._of(flat)
        out, a = [], 0
        for chunks, head in zip(cut, self._encode([c[0] for c in cut]), strict=True):
            b = a + len(chunks) - 1
            out.append(head + b"".join(ids[a:b]))
            a = b
        # A chunk that is empty or begins with white space may belong to a run that the cut broke.
        whole = [i for i, t in enumerate(texts) if len(cut[i]) > 1 and (t[0].isspace() or self.RUN.search(t))]
        for i, x in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


def encoder(path: str) -> ChunkEncoder:
    return common.worker_state("tokens", path, lambda: ChunkEncoder(path))


def _local(url: str) -> str:
    u = urlparse(url)
    if u.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted folder, not {url}")
    return unquote(u.path)


def _publish(path: str, data) -> None:
    """Writes a file whole or not at all."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        for part in data:
            f.write(part)
    os.replace(tmp, path)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Encodes ``docs`` into the dataset ``path``; returns its shards ``(shard, base, n_tokens, n_docs)``.

    Null texts count as empty and have the end id alone.  Rows with equal
    doc_id are all written, in the order of their texts; rows without id come
    first.  An empty table gives a dataset without shards.
    """
    spark = docs.sparkSession
    model = tokenizer or tokenizer_path()
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)
    key = F.coalesce("doc_id", F.lit(common.NULL_ID))
    source = common.texts(docs).select(key.alias("doc_id"), "text")
    dealt = source.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches):
        shard, ids, sizes, tmp, out = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard = batch.column(2)[0].as_py()
                tmp = f"{folder}/{shard:06d}.bin.{uuid.uuid4().hex}.tmp"
                out = open(tmp, "wb")  # noqa: SIM115
            ids.append(np.asarray(batch.column(0), np.int64))
            enc = encoder(model)
            end = np.array([end_id], enc.kind).tobytes()
            for a in range(0, batch.num_rows, TEXTS):
                for data in enc(batch.column(1)[a : a + TEXTS].to_pylist()):
                    out.write(data)
                    out.write(end)
                    sizes.append(len(data) // enc.width + 1)
        if shard is None:
            return
        out.close()
        os.replace(tmp, f"{folder}/{shard:06d}.bin")
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        _publish(f"{folder}/{shard:06d}.off", [offsets.astype("<u8").tobytes()])
        _publish(f"{folder}/{shard:06d}.doc", [np.concatenate(ids).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(offsets[-1])], pa.int64()), pa.array([len(sizes)], pa.int64())], names=["shard", "n_tokens", "n_docs"])

    shards = sorted(dealt.mapInArrow(run, "shard int, n_tokens long, n_docs long").collect())  # one row for each shard
    base, rows = 0, []
    for s in shards:
        rows.append((s["shard"], base, s["n_tokens"], s["n_docs"]))
        base += s["n_tokens"]
    return spark.createDataFrame(rows, "shard int, base long, n_tokens long, n_docs long")


def open_shard(path: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, offsets, doc_ids)`` of a shard, mapped into memory."""
    folder = _local(path)
    ids, offsets, doc = (f"{folder}/{shard:06d}.{x}" for x in ("bin", "off", "doc"))
    off = np.memmap(offsets, "<u8", "r")
    kind = f"<u{os.path.getsize(ids) // int(off[-1])}"
    return np.memmap(ids, kind, "r"), off, np.memmap(doc, "<i8", "r")


def read(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents, from the files."""

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, doc = open_shard(path, shard)
                at = offsets.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(doc)), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    out = shards.select("shard", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != common.NULL_ID, F.col("doc_id")))


def documents(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """``(doc_id, ids array<long>)`` of all documents, from the files."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                ids, offsets, doc = open_shard(path, shard)
                at = offsets.astype(np.int64)
                for a in range(0, len(doc), 1000):
                    part = at[a : a + 1001]
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": np.array(doc[a : a + 1000]), "ids": [ids[x:y].astype(np.int64) for x, y in zip(part[:-1], part[1:], strict=True)]}), preserve_index=False)

    return shards.select("shard").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` to a new dataset in the shared folder and reads it back."""
    spark = docs.sparkSession
    path = common.shared_dir(spark, "tokens")
    shards = write(docs, path, tokenizer, end_id)
    common.remove_at_exit(spark, path)
    return read(spark, path, shards)
