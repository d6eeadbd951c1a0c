"""Flat token-id files with 64-bit document offsets, written and memory-mapped by Spark tasks.

Documents are range-partitioned by id, so one task holds one run of the final order. It writes

* ``<part>.ids``: the ids of its documents, one after the other, as little-endian unsigned integers
  of 2 bytes (vocabularies up to 65,536) or 4 bytes;
* ``<part>.key``: the documents' ids as signed 64-bit integers (the lowest value stands for NULL);
* ``<part>.off``: for each document, and for the end, the place of its first id in the whole
  corpus as unsigned 64-bit integers.

The base of a part is the sum of the sizes of the parts before it: one row per part goes through
the driver, whatever the number of documents. A part's files get a new name in every attempt and
only those of the attempt that succeeded are in the manifest, so a lost executor leaves no damage.

Defined results: NULL or empty text gives only the end id; NULL doc_id sorts first; rows with equal
doc_id are ordered by their text; an empty table gives no files and no rows; other columns of the
input are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.tokens import encoder, ended
from wardflow.session import materialize, scratch_path

_NULL_KEY = np.iinfo(np.int64).min
_MANIFEST = "part long, name string, n_docs long, n_tokens long"
_ROWS_OUT = 4096


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def mapped(uri: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is local, read where it is not."""
    from pyarrow import fs

    system, path = _open(uri)
    if not system.get_file_info(path).size:
        return np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=kind)


def _write_parts(folder: str, tokenizer: str, cut: str, width: int, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        encode_all = encoder(tokenizer, cut, width).encode_all
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        files = {}
        for batch in batches:
            if not files:
                system.create_dir(path, recursive=True)
                files = {x: system.open_output_stream(f"{path}/{name}.{x}") for x in ("ids", "key", "len")}
            for ids_and_places in encode_all(batch.column("text")):
                ids, places = ended(*ids_and_places, end_id)
                files["ids"].write(ids.tobytes())
                files["len"].write(np.diff(places).astype("<u8").tobytes())
                n_tokens += len(ids)
            keys = batch.column("doc_id").fill_null(_NULL_KEY).to_numpy(zero_copy_only=False)
            files["key"].write(keys.astype("<i8").tobytes())
            n_docs += batch.num_rows
        for file in files.values():
            file.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_tokens": n_tokens}])

    return write


def _write_offsets(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = mapped(f"{folder}/{row['name']}.len", "<u8")
                offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<u8")]).astype("<u8") + np.uint64(row["base"])
                temporary = f"{path}/{row['name']}.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary) as file:
                    file.write(offsets.tobytes())
                system.move(temporary, f"{path}/{row['name']}.off")
            yield batch

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, cut: str, vocabulary: int, end_id: int
) -> DataFrame:
    """Write ``docs`` (doc_id, text) to token files in ``folder``; returns the manifest.

    ``folder`` is a URI every executor reaches. The manifest has one row per part: part, name,
    n_docs, n_tokens, base (ids before the part) and width (bytes of an id).
    """
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The hash only spreads (and orders) rows that share an id.
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    written = rows.mapInArrow(_write_parts(folder, tokenizer, cut, width, end_id), _MANIFEST)
    parts = materialize(written, "parts").orderBy("part").collect()
    bases = np.concatenate([[0], np.cumsum([row["n_tokens"] for row in parts], dtype=np.int64)])
    manifest = [(*row, int(base), width) for row, base in zip(parts, bases)]
    manifest = spark.createDataFrame(manifest, f"{_MANIFEST}, base long, width int")
    with_offsets = _one_a_task(manifest, len(parts)).mapInArrow(_write_offsets(folder), manifest.schema)
    return materialize(with_offsets, "manifest")


def _one_a_task(manifest: DataFrame, n_parts: int) -> DataFrame:
    """The manifest with about one part a task; an explicit number keeps small partitions apart."""
    return manifest.repartitionByRange(max(1, n_parts), "part")


def _read_parts(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{folder}/{row['name']}"
                ids = mapped(f"{at}.ids", f"<u{row['width']}")
                offsets, keys = mapped(f"{at}.off", "<u8"), mapped(f"{at}.key", "<i8")
                places = (offsets - np.uint64(row["base"])).astype(np.int64)
                for first in range(0, len(keys), _ROWS_OUT):
                    some = range(first, min(first + _ROWS_OUT, len(keys)))
                    sums = [zlib.crc32(ids[places[i] : places[i + 1]].astype("<u4")) for i in some]
                    own = np.asarray(keys[some.start : some.stop], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == _NULL_KEY),
                            pa.array(offsets[some.start : some.stop].astype(np.int64)),
                            pa.array(np.diff(places[some.start : some.stop + 1])),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    return _one_a_task(manifest, manifest.count()).mapInArrow(
        _read_parts(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digest of all documents, from their token files in the shared scratch folder."""
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, cut="words", vocabulary=49_408, end_id=2)
    return read_token_files(manifest, folder)
