"""Token-id files: flat unsigned integer ids plus 64-bit document offsets.

Layout of a data set folder (little-endian throughout):

* ``tokens-PPPPP.bin``: the ids of partition P's documents, end id included,
  as unsigned 16-bit integers where the vocabulary fits, else 32-bit;
* ``offsets-PPPPP.bin``: unsigned 64-bit, one more than documents: where each
  starts within the partition's ids;
* ``docs-PPPPP.bin``: signed 64-bit document ids.

Partitions hold ascending ranges of document ids. A document's global start is
its partition's base (a prefix sum over the partitions' totals) plus its offset.
Each task writes under a temporary name and renames, so a retried or
speculative task leaves the same files. Readers memory-map them.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import NULL_ID, held, slices, table
from dwell.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CACHE_ITEMS = 400_000  # per generation; two are kept
PIECE_CHARS = 64  # longer pieces are not kept
GROUP = 128  # pieces encoded in one text
READ_DOCS = 2048


def id_type(vocabulary: int) -> str:
    """16 bits where every id fits, else 32."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Encoder:
    """Byte-level BPE ids of whole texts.

    A lone space or newline between two visible characters always starts a new
    pre-token, so a text without other white space is cut there into pieces
    whose ids are kept in a cache of bounded size; every other text is encoded
    in one call. Punctuation after a letter is a pre-token of its own as well,
    so a piece's ids are those of its core and those of its punctuation. The
    tokenizer itself encodes both, many pieces in one text: only a piece's first id
    begins with a space. Ids equal those of the text in one call (tested)."""

    #: a piece that ends in punctuation after a letter; an apostrophe may join letters and stays in the core
    _TAIL = re.compile(r"(.*[A-Za-zÀ-ÖØ-öø-ɏ])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)

    def __init__(self, path: str, cache_items: int = CACHE_ITEMS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self.dtype = id_type(self._tok.get_vocab_size())
        self._code = "H" if self.dtype == "<u2" else "I"
        vocabulary = self._tok.get_vocab()
        self._spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self._spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the byte of a space
        self._limit = cache_items
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # the generation before
        self._tails: dict[str, bytes] = {}

    def _batch(self, texts: list[str]) -> list[bytes]:
        code = self._code
        return [array(code, e.ids).tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_pieces(self, keys: list[str]) -> list[bytes]:
        """Ids of every key led by its space."""
        groups = [keys[i : i + GROUP] for i in range(0, len(keys), GROUP)]
        out: list[bytes] = []
        for g, e in zip(groups, self._tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            starts = np.flatnonzero(self._spaced[ids])
            if len(starts) != len(g) or starts[0]:  # a vocabulary of another kind
                out += self._batch([" " + k for k in g])
                continue
            flat, cuts = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
            out += [flat[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _keys(self, text: str) -> list[str]:
        """Cache keys of a text's pieces: a piece led by its space goes without it,
        one led by its newline with it; a key led by a space is the text after
        that, as it stands (the first piece, and a text that can't be cut)."""
        flat = text.replace("\n", " ")
        # of the white space only the plain space is printable
        if not flat.isprintable() or "  " in flat or flat[0] == " " or flat[-1] == " " or any(a in text for a in self._added):
            return [" " + text]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = " " + keys[0]
        return keys

    @staticmethod
    def _literal(key: str) -> str:
        return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key

    def _fill(self, keys: list[str], out: dict[str, bytes]) -> None:
        """Encode the pieces that no cache holds; their cores are pieces as well."""
        tails, cache, older, new, parts = self._tails, self._cache, self._older, [], []
        for k in keys:
            # text that stands as it is may hold white space: never taken apart
            m = self._TAIL.fullmatch(k) if k[0] != " " else None
            if m:
                parts.append((k, *m.groups()))
            else:
                new.append(k)
        for c in {c for _, c, _ in parts}.difference(new, out):
            b = cache.get(c) or older.get(c)
            if b is None:
                new.append(c)
            else:
                out[c] = b
        spaced = [k for k in new if k[0] not in " \n"]
        out.update(zip(spaced, self._spaced_pieces(spaced), strict=True))
        new = [k for k in new if k[0] in " \n"]
        out.update(zip(new, self._batch([self._literal(k) for k in new]), strict=True))
        if len(tails) > self._limit:
            tails.clear()
        new = list({t for _, _, t in parts}.difference(tails))
        tails.update(zip(new, self._batch(new), strict=True))
        for k, c, t in parts:
            out[k] = out[c] + tails[t]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned integers of ``dtype``."""
        cut = [self._keys(t) if t else [] for t in texts]
        if len(self._cache) > self._limit:
            self._older, self._cache = self._cache, {}
        cache, older = self._cache, self._older
        need = set().union(*cut).difference(cache)
        local = {k: b for k in need if (b := older.get(k)) is not None}
        missing = [k for k in need if k not in local]
        if missing:
            self._fill(missing, local)
        cache.update(local)
        out = [b"".join(map(cache.__getitem__, ks)) for ks in cut]
        for k in [k for k in local if len(k) > PIECE_CHARS]:
            del cache[k]
        return out


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _filesystem(folder: str):
    """(filesystem, path): local and ``file:`` folders, and what pyarrow reaches."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:"):
            return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, and write the
    files in ascending id order (ties by text; null ids first, stored as -2^63). Returns the
    partition table (part, n_docs, n_tokens, width in bytes, base_doc, base_token), one row per
    partition. An empty table writes no files and gives an empty table."""
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer_path()
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.repartitionByRange("_id").sortWithinPartitions("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _filesystem(folder)
        temp = f"{root}/_tmp-{part:05d}-{uuid.uuid4().hex}"
        enc = encoder(path)
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize
        ids, lens, tok = [], [], None
        for batch in batches:
            for s in slices(batch, "_text"):
                if tok is None:
                    store.create_dir(root, recursive=True)
                    tok = store.open_output_stream(f"{temp}.tokens")
                ids.append(s.column(0).to_numpy())
                coded = [b + end for b in enc.encode(s.column(1).to_pylist())]
                lens.extend(len(b) // width for b in coded)
                tok.write(b"".join(coded))
        if tok is None:
            return
        tok.close()
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype("<u8")
        for name, a in (("offsets", offsets), ("docs", np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(f"{temp}.{name}") as f:
                f.write(a.tobytes())
        for name in ("tokens", "offsets", "docs"):
            store.move(f"{temp}.{name}", f"{root}/{name}-{part:05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(lens)]), pa.array([int(offsets[-1])]), pa.array([width])], names=["part", "n_docs", "n_tokens", "width"])

    # one row per partition: the prefix sums of the bases are taken over these
    parts = sorted(d.mapInArrow(run, "part long, n_docs long, n_tokens long, width long").collect())
    rows, doc, tok = [], 0, 0
    for p in parts:
        rows.append((*p, doc, tok))
        doc, tok = doc + p["n_docs"], tok + p["n_tokens"]
    return spark.createDataFrame(rows, "part long, n_docs long, n_tokens long, width long, base_doc long, base_token long")


def _map(store, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is a mounted file system, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files:
    one task per group of partitions, documents streamed from the maps."""
    n = parts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for b in batches:
            for p in b.to_pylist():
                tok = _map(store, f"{root}/tokens-{p['part']:05d}.bin", f"<u{p['width']}")
                off = _map(store, f"{root}/offsets-{p['part']:05d}.bin", "<u8")
                ids = _map(store, f"{root}/docs-{p['part']:05d}.bin", "<i8")
                for s in range(0, len(ids), READ_DOCS):
                    o = off[s : s + READ_DOCS + 1].astype(np.int64)
                    crc = [zlib.crc32(tok[a:z].astype("<u4")) for a, z in zip(o[:-1], o[1:], strict=True)]
                    i = ids[s : s + READ_DOCS].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i, mask=i == NULL_ID), pa.array(o[:-1] + p["base_token"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return parts.repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "llm-tokens")
    parts = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(parts, folder)
