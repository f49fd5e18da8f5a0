import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import byte_bpe as bb

pytestmark = pytest.mark.skipif(not os.path.exists(bb.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bb.VOCABULARY)
    t.encode_special_tokens = True
    with open(bb.VOCABULARY, "rb") as f:
        return bb.ByteBPE(f.read()), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=120))
def test_any_text(both, text):
    own, other = both
    assert own.encode(text) == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehtiusrn '\n", max_size=200))
def test_dense_text(both, text):
    own, other = both
    assert own.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_documents_round_trip(spark, sf, both):
    own, other = both
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = bb.encode_corpus(docs)
    back = {r.doc_id: r.text for r in bb.decode_corpus(ids).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert back == {k: v or "" for k, v in texts.items()}
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {k: other.encode(v or "", add_special_tokens=False).ids for k, v in texts.items()}


def test_defined_cases(spark, both):
    rows = [(1, None, 7), (2, "", 7), (3, "<|endoftext|>", 7), (4, "a" * 100_000, 7), (4, "a" * 100_000, 7), (None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bb.encode_corpus(df).collect()
    assert len(got) == 6
    by = {r.doc_id: r.ids for r in got}
    assert by[1] == [] and by[2] == [] and 50256 not in by[3] and by[4] == both[1].encode("a" * 100_000, add_special_tokens=False).ids
    assert bb.encode_corpus(df.where("false")).count() == 0
