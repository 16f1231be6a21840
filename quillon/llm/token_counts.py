"""Token counts by separator scan.

A corpus is tokenised into flat files: token ids of a fixed width, one end-of-document id
after each document, no index. The scan deals each file to tasks as blocks of BLOCK tokens,
finds the separators of a block with one vectorised comparison, and gives for each block its
inner document lengths and what is left over at either end. A prefix scan over the blocks of
a file (sums of separators and of leftovers since the last separator) numbers the documents
and stitches those that cross one or more block borders.

Files lie under a folder that every task reaches, and are opened through Arrow's file
systems by URI (local paths, file://, hdfs://, s3:// ..). A writer task names its file after
itself and its attempt, and only files whose rows reach the manifest count, so tasks that are
lost, repeated or speculated leave nothing that is read.

Null and empty texts are documents of no tokens; a text that contains the separator's string
has it as ordinary text, so ids never collide. Documents longer than a block, or than many,
are stitched; a file's tail without a separator is a document of its own if it holds any
token. Repeated rows are documents of their own, and there are no ties to break. An empty table
gives no files and an empty result. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import cut, for_python, fresh_folder, table
from quillon.storage import remove

#: Tokens in a block of the scan.
BLOCK = 1 << 20
#: Tokens that a writer task puts into a file before it begins another.
FILE = 1 << 24
#: The id after each document: the first that the ranks leave free.
SEPARATOR = 50256
WIDTH = 2

#: Fixed value: the pattern that the vocabulary's public tokenizer splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the public vocabulary lies; a parameter of write_tokens().
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoder(ranks: bytes):
    """A tokenizer of a ranks file's contents, without special tokens."""
    import base64

    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


def _open(uri: str):
    """Arrow's file system for a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Flat token files under folder, and their manifest: doc_id, file, ordinal (from 0).

    The vocabulary is read by the driver only, which sends it to the executors.
    """
    with open(vocabulary, "rb") as lines:
        ranks = docs.sparkSession.sparkContext.broadcast(lines.read())  # a public file of some megabytes at most
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType())]
    )

    def run(batches):
        context = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        encode = encoder(ranks.value).encode_ordinary
        sink, name, size, ordinal = None, "", 0, 0
        end = np.array([separator], np.uint16).tobytes()
        for batch in batches:
            names, ordinals = [], []
            for text in batch.column(1):
                if sink is None or size >= FILE:
                    if sink is not None:
                        sink.close()
                    name = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:12]}.bin"
                    sink, size, ordinal = system.open_output_stream(f"{root}/{name}", buffer_size=1 << 20), 0, 0
                ids = np.array(encode(text.as_py() or ""), np.uint16)
                sink.write(ids.tobytes())
                sink.write(end)
                names.append(name)
                ordinals.append(ordinal)
                size += len(ids) + 1
                ordinal += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(ordinals, pa.int64())], names=schema.fieldNames()
            )
        if sink is not None:
            sink.close()

    return for_python(docs.select("doc_id", "text")).mapInArrow(run, schema)


def blocks(
    spark: SparkSession, folder: str, files: DataFrame, width: int = WIDTH, block: int = BLOCK, separator: int = SEPARATOR
) -> DataFrame:
    """file, block and the scan of each block of the files (column file) under folder."""

    def sizes(batches):
        system, root = _open(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [x.size for x in system.get_file_info([f"{root}/{n}" for n in names])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["file", "bytes"])

    sized = files.select("file").mapInArrow(sizes, "file string, bytes bigint").filter("bytes > 0")
    count = F.ceil(F.col("bytes") / (width * block)).cast("long")
    each = sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    schema = "file string, block bigint, head bigint, tail bigint, separators bigint, inner array<bigint>"

    def scan(batches):
        system, root = _open(folder)
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{file}") as source:
                    source.seek(at * block * width)
                    raw = source.read(block * width)
                ids = np.frombuffer(raw[: len(raw) // width * width], f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                head = int(ends[0]) if len(ends) else len(ids)
                tail = len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([at], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()),
                     pa.array([len(ends)], pa.int64()), pa.array([np.diff(ends) - 1 if len(ends) else []], pa.list_(pa.int64()))],
                    names=["file", "block", "head", "tail", "separators", "inner"],
                )

    dealt = each.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file", "block")
    return dealt.mapInArrow(scan, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """file, ordinal and n_tokens of every document of scanned blocks.

    The windows run over a file's blocks, whose number the file's size bounds: a block counts
    a million tokens as one row.
    """
    row = F.struct("block", "head", "tail", "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Blocks without a separator belong to the run that the last separator before began.
    runs = F.coalesce(F.sum(F.when(F.col("separators") > 0, 1).otherwise(0)).over(before), F.lit(0))
    narrow = scanned.select("file", row.alias("b")).select("file", "b.*")
    numbered = (
        narrow.withColumn("first", F.coalesce(F.sum("separators").over(before), F.lit(0)))
        .withColumn("run", runs)
        .withColumn("last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1)
    )
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # What precedes a block in its open document: the tail of the block that has the last
    # separator, and all tokens of the blocks without one since then.
    whole = F.when(F.col("separators") == 0, F.col("tail")).otherwise(0)
    numbered = numbered.withColumn("__qn_between", F.coalesce(F.sum(whole).over(since), F.lit(0)))
    ended = F.when(F.col("separators") > 0, F.col("tail"))
    numbered = numbered.withColumn(
        "__qn_tail_before", F.coalesce(F.last(ended, ignorenulls=True).over(before), F.lit(0))
    )
    crossing = numbered.withColumn("open", F.col("__qn_tail_before") + F.col("__qn_between"))
    heads = crossing.filter("separators > 0").select("file", F.col("first").alias("ordinal"), (F.col("open") + F.col("head")).alias("n_tokens"))
    rest = crossing.filter("last").select(
        "file", (F.col("first") + F.col("separators")).alias("ordinal"),
        F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("n_tokens"),
    ).filter("n_tokens > 0")
    firsts = crossing.filter("separators > 1").select(F.col("file").alias("__qn_f"), F.col("block").alias("__qn_b"), "first")
    inner = scanned.filter("separators > 1").join(firsts, (F.col("file") == F.col("__qn_f")) & (F.col("block") == F.col("__qn_b")))
    inner = inner.select("file", "first", F.posexplode("inner").alias("at", "n_tokens"))
    inner = inner.select("file", (F.col("first") + 1 + F.col("at")).alias("ordinal"), "n_tokens")
    return heads.unionByName(inner).unionByName(rest)


def op5_token_counts(spark, sf_dir):
    """doc_id and n_tokens of every document, from flat token files that are deleted again."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "tokens")
    try:
        manifest = cut(write_tokens(docs, folder))
        files = manifest.groupBy("file").agg(F.count(F.lit(1)).alias("documents")).select("file")
        scanned = cut(blocks(spark, folder, files))  # after which the files aren't needed
    finally:
        remove(folder)
    counts = stitch(scanned)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
