"""The whole pipeline against plain loops."""

import zlib
from array import array
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_operators import BYTE_BPE, measures, plain_components, plain_dedup, tokenizer


def plain_pipeline(pairs):
    """(doc_id, text) of every document that stays, as it leaves the third stage."""
    good = []
    for doc_id, text in pairs:
        n, chars, symbols, dup, repeated, lines = measures(text)
        if n >= 50 and 2 * repeated <= n and 5 * symbols <= n and 2 * dup <= lines and 2 * n <= chars <= 12 * n:
            good.append((doc_id, text))
    named = dict(p for p in good if p[0] is not None)
    firsts = {x for x, (_, first) in plain_components(list(named.items()), 5, 80, 100).items() if x == first}
    single = [(x, named[x]) for x in sorted(firsts)]
    left = plain_dedup(single)
    return [(x, left[x, text]) for x, text in single] + sorted({p for p in good if p[0] is None})


def plain_pieces(docs):
    whole, want = tokenizer(BYTE_BPE), Counter()
    for doc_id, text in docs:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        at = piece = 0
        while at < len(ids):
            n = 1024 if at or len(ids) % 1024 == 0 else len(ids) % 1024
            want[doc_id, piece, at, n, zlib.crc32(array("I", ids[at : at + n]).tobytes())] += 1
            at, piece = at + n, piece + 1
    return want


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_pipeline_against_loops(spark, request, tmp_path, name):
    df = request.getfixturevalue(name)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pieces(plain_pipeline(pairs))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    if name == "docs":
        stays = {key[0] for key in want}
        assert {1, 11, 12, None} <= stays and not stays & {2, 3, 4, 5, 10, 14}  # copies, NULL, empty and repeated words go
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns_of_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, "")
        assert left.schema.names == docs.schema.names
        assert [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
        assert 0 < left.count() <= docs.count()
