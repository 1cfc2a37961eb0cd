import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tonguemix.llm import entries
from tonguemix.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sp.model_bytes(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "   a  b ", "the cat sat", "▁x ▁▁", "é́ ﬁ​ 𝔘\x00\t\n", "<s> </s> <unk> <0x41>", "a" * 5000, "日本語 text " * 300, "　x\xa0y"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_decoding_are_the_librarys(text):
    (found,) = sp.codec(MODEL).encode([text])
    assert found.ids.tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert sp.codec(MODEL).decode([found.ids]) == [LIBRARY.decode(found.ids.tolist())]


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(text):
    (found,) = sp.codec(MODEL).encode([text])
    assert found.ids.tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert found.begins[0] == 0 and found.ends[-1] == len(text.encode())
    assert (found.begins[1:] == found.ends[:-1]).all()  # spans tile the text


def test_spans_hold_their_pieces():
    text = "the éclair, naïve 日本"
    (found,) = sp.codec(MODEL).encode([text])
    for id_, begin, end in list(zip(found.ids.tolist(), found.begins, found.ends, strict=True))[2:-1]:
        piece = LIBRARY.id_to_piece(id_)
        if not piece.startswith("<0x"):
            assert text.encode()[begin:end].decode() == piece.replace("▁", " ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("text", [*TEXTS, "Ⅷ ﷺ ① ﾊﾞ", "A  B", "ＡＢＣ　ｄ"])
def test_character_maps_of_the_library(rule, text):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    parts = {n: v for number, value, _ in sp._fields(library.serialized_model_proto()) if number == sp.NORMALIZER for n, v, _ in sp._fields(value)}
    charsmap = sp.CharacterMap(parts[sp.CHARSMAP]) if parts.get(sp.CHARSMAP) else None
    flags = [bool(parts.get(f, 1)) for f in (sp.DUMMY_PREFIX, sp.REMOVE_EXTRA, sp.ESCAPE)]
    data, source = sp.Normalizer(charsmap, *flags, False, ())(text)
    assert data.decode() == library.normalize(text)
    assert len(source) == len(data) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the cat", "x"), (None, None, "y"), (1, "the cat", "x"), (2, "", None), (3, "long " * 60000, "z")], "doc_id long, text string, ids string")
    rows = {(r.doc_id, r.n_tokens): r for r in sp.round_trip_digests(docs, MODEL).collect()}
    want = LIBRARY.encode("the cat", add_bos=True, add_eos=True)
    assert rows[1, len(want)].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert rows[None, 2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert sp.round_trip_digests(docs, MODEL).count() == 5
    encoded = sp.encode_documents(docs, MODEL)
    assert {r.doc_id: r.text for r in sp.decode_documents(encoded, MODEL).collect()} == {1: "the cat", None: "", 2: "", 3: "long " * 60000}
    assert sp.round_trip_digests(docs.limit(0), MODEL).count() == 0


def digests(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = entries.QUERIES["op3_sentencepiece"](spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: digests(LIBRARY, t) for i, t in texts.items()} and len(rows) == len(texts)


def test_a_model_with_a_character_map(spark):
    """The same pieces under the rules of nmt_nfkc: every text goes through the compiled map."""
    rules = next(v for n, v, _ in sp._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if n == sp.NORMALIZER)
    model = b"".join(raw for n, _, raw in sp._fields(MODEL) if n != sp.NORMALIZER) + sp._varint(sp.NORMALIZER << 3 | 2) + sp._varint(len(rules)) + rules
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [*TEXTS, "Ⅷ ﷺ ① ﾊﾞ", "A  B", "ＡＢＣ　ｄ", None] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = sp.round_trip_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sp.codec(model).normalize.charsmap is not None
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: digests(library, t) for i, t in enumerate(texts)}
