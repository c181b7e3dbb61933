"""Word-wise encoding, packing and the ORC token store."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rookery.llm import packing, token_store
from rookery.llm.tokens import Encoder, vocabulary
from rookery.session import shared_dir

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
DOCS = "doc_id long, text string, ids string, start string"
ODD = [
    "", " ", "a", " a  b ", "x\n y", "it's 'tis  the\t end   q \x1c z ", "ΑΣ ΣΑΣ İx ﬁ é a ́b", "<|endoftext|> hi", "a" * 3000,
    "12 34 5é 漢字 テスト 😀 don't we'll", "Ünter «quoted» word, (next)... | a|b &&& 100% x  y", "\0first \0end",
]
_plain, _own = {}, {}
for name, spaced in FILES:
    _plain[name] = Tokenizer.from_file(vocabulary(name))
    _plain[name].encode_special_tokens = True
    _own[name] = Encoder(vocabulary(name), spaced, end=None, most=50)


def _ids(name, text):
    return _plain[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [f[0] for f in FILES])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t,.'sdaé́"))), max_size=4))
def test_encoder_equals_tokenizer(name, texts):
    texts = [*texts, *ODD]
    ids, ends = _own[name].encode(texts)
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [_ids(name, t) for t in texts]


def test_words_are_merged_once_for_all_tails_and_lines():
    coder = Encoder(vocabulary("byte_bpe_50k.json"), True, end=None)
    merge, whole, seen, odd = coder.merge, coder.tokenizer, [], []
    coder.merge = lambda word: seen.append(word) or merge(word)
    coder._whole = lambda piece: odd.append(piece) or whole.encode(piece, add_special_tokens=False).ids
    texts = ["q alpha alpha. alpha; alpha.\nBeta beta,\nBeta. x\n\ny 's\n's a\r\nb \n c", "q beta.\nBeta"]
    ids, ends = coder.encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [_ids("byte_bpe_50k.json", t) for t in texts]
    assert len(seen) == len(set(seen)) and len(odd) == len(set(odd))
    assert sum("alpha" in w for w in seen) == 1 and not any("alpha" in p or "eta" in p for p in odd)


def _rows():
    words = "the of and thention ererly; Word, stupid été 12 x-y".split(" ")
    rows = [(i, " ".join(words[(i * j) % len(words)] for j in range(i * 7 % 400)), "c", "c") for i in range(120)]
    rows += [(500, None, "c", "c"), (501, "", "c", "c"), (502, "long " * 20_000, "c", "c"), (None, "no id", "c", "c")]
    return [*rows, (7, rows[7][1], "c", "c"), *((600 + i, t, "c", "c") for i, t in enumerate(ODD))]


def test_packing_covers_every_id_once(spark):
    rows = _rows()
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append([*_ids("word_bpe_49k.json", t), 2])
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for d, copies in want.items():
        pieces = sorted(by_doc.pop(d), key=lambda r: r.start)
        assert all(r.doc_tokens == len(copies[0]) for r in pieces)
        flat = {r.start: list(r.ids) for r in pieces} if len(copies) == 1 else None
        if flat is not None:
            assert [x for s in sorted(flat) for x in flat[s]] == copies[0]
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        else:
            assert sum(r.length for r in pieces) == sum(map(len, copies))
    assert not by_doc
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_bins_waste_little():
    rnd, bins = np.random.default_rng(1), packing.Bins()
    total = 0
    for i, n in enumerate(rnd.lognormal(6.5, 1, 4000).astype(int)):
        bins.add(i, np.zeros(n, np.uint32))
        total += n
    bins.finish()
    assert sum(len(p[2]) for p, _, _ in bins.out) == total
    assert total / (4096 * bins.made) > 0.99


def test_store_round_trip(spark):
    rows = _rows()
    path = shared_dir(spark, "test-store")
    token_store.write(spark.createDataFrame(rows, DOCS), path)
    got = token_store.checksums(token_store.read(spark, path)).collect()
    encoded = [(d, [*_ids("byte_bpe_50k.json", t), 2]) for d, t, *_ in rows]
    encoded.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in encoded]
    at = 0
    for r, (d, ids) in zip(got, encoded):
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    one = token_store.read(spark, path).where("doc_id = 502")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,502)" in one._jdf.queryExecution().toString()
    assert [r.n_tokens for r in one.collect()] == [len(dict(encoded)[502])]


def test_empty_store(spark):
    path = shared_dir(spark, "test-store")
    token_store.write(spark.createDataFrame([], DOCS), path)
    assert token_store.checksums(token_store.read(spark, path)).count() == 0
