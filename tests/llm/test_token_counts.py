import numpy as np
import pytest

from quillon.llm import token_counts as t


def lengths(ids, separator=t.SEPARATOR):
    """Documents of a flat file, by a plain loop."""
    out, n = [], 0
    for x in ids:
        if x == separator:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_of_flat_files(spark, tmp_path, block):
    rng = np.random.default_rng(8)
    E = t.SEPARATOR
    files = {
        "a": [1, 2, E, 3, E, E, 4, 5, 6, 7, 8, 9, 1, 2, 3, E], "b": [], "c": [1] * 23, "d": [E], "e": [E, E, E, 5],
        "f": [1] * 20 + [E] + [2] * 9, "g": rng.choice([1, 2, 3, E], 400, p=[0.3, 0.3, 0.3, 0.1]).tolist(),
        "h": rng.choice([1, E], 200, p=[0.95, 0.05]).tolist(),
    }
    for name, ids in files.items():
        np.array(ids, np.uint16).tofile(tmp_path / name)
    names = spark.createDataFrame([(n,) for n in files], "file string")
    out = t.stitch(t.blocks(spark, str(tmp_path), names, block=block)).collect()
    for name, ids in files.items():
        got = sorted((r.ordinal, r.n_tokens) for r in out if r.file == name)
        assert got == list(enumerate(lengths(ids))), name


def test_round_trip_of_odd_rows(spark, tmp_path, monkeypatch):
    encode = t.encoder(open(t.VOCABULARY, "rb").read()).encode_ordinary
    texts = [None, "", "a <|endoftext|> b", "Ünï " * 9000, "x" * 20000, "same", "same"]
    docs = spark.createDataFrame([(i if i < 5 else 5, x, "q") for i, x in enumerate(texts)] + [(None, "no id", "q")], "doc_id bigint, text string, file string")
    folder = f"file://{tmp_path}/flat"
    manifest = t.write_tokens(docs, folder).persist()
    files = manifest.select("file").distinct()
    counts = t.stitch(t.blocks(spark, folder, files, block=64))
    got = sorted((str(r.doc_id), r.n_tokens) for r in manifest.join(counts, ["file", "ordinal"]).collect())
    want = sorted((str(r.doc_id), len(encode(r.text or ""))) for r in docs.collect())
    assert got == want
    assert t.write_tokens(docs.limit(0), folder).count() == 0


def test_query(spark):
    from quillon.llm.queries import QUERIES

    encode = t.encoder(open(t.VOCABULARY, "rb").read()).encode_ordinary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = QUERIES["op5_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r.doc_id, len(encode(r.text))) for r in docs)


def test_nothing_is_left_of_a_failed_scan(spark, tmp_path, monkeypatch):
    from quillon.llm import common

    monkeypatch.setattr(t, "fresh_folder", lambda spark, name: str(tmp_path / "flat"))

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(t, "blocks", broken)
    with common.scratch(), pytest.raises(RuntimeError):
        t.op5_token_counts(spark, "/root/testdata/sf0.001")
    assert not (tmp_path / "flat").exists()
