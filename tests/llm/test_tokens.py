"""Ids by pieces equal ids of whole texts; files and windows give every id back."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoband.llm.packing import packed_pieces, sequences
from chronoband.llm.tokenfile import pack, read_tokens, unpack, write_tokens
from chronoband.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}
WHOLE = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
ODD = ["a b", " a  b ", "x\n\ny z", "it's 12 o'clock\t\n q", "é ´́ ́x", "a  b  c", "<|endoftext|> a <|endoftext|>b",
       "", " ", "  ", "\n", "word" * 400 + " end", "\x1c a\x85b \x1f", "ΑΣ ΑΣ. İı ﬀ", "a \n b \n\n  c"]


def plain(f: str, text: str) -> list[int]:
    return WHOLE[f].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("f", FILES)
@pytest.mark.parametrize("text", ODD)
def test_odd_texts(f, text):
    assert ENCODERS[f]([text])[0].tolist() == plain(f, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sZ1.\n\t    é́中<|>")), max_size=40))
def test_any_text(text):
    for f in FILES:
        assert ENCODERS[f]([text])[0].tolist() == plain(f, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("theanoNSßéµªÿİ .,")), max_size=60))
def test_words_of_letters(text):
    for f in FILES:
        assert ENCODERS[f]([text])[0].tolist() == plain(f, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abteSÉßéµÿ.,!&*\"(-_/12<|>'\n\n  ")), max_size=60))
def test_words_with_marks_inside(text):
    for f in FILES:
        assert ENCODERS[f]([text])[0].tolist() == plain(f, text)


def test_marks_between_letters_are_encoded_once(monkeypatch):
    words = [f"{a}{b}{mark}" for mark in ("!!", "&&&", ".\nThen", "-", ")") for a in ("qu", "vé", "zo") for b in ("ra", "il", "Ém")]
    for f in FILES:
        own, asked = Encoder(public_tokenizers.path(f)), []
        alone = own._alone
        monkeypatch.setattr(own, "_alone", lambda piece, alone=alone, asked=asked: asked.append(piece) or alone(piece))
        text = "start " + " ".join(words)
        assert own([text])[0].tolist() == plain(f, text)
        assert len(asked) <= 7


@given(st.lists(st.sampled_from([0, 1, 2, 77_000, 2**31, *range(300)]), max_size=900))
@settings(max_examples=60, deadline=None)
def test_code_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    assert unpack(*pack(ids), len(ids)).tolist() == ids.tolist()


def test_code_widths():
    ids = np.arange(70_000, dtype=np.uint32)
    table, control, data = pack(ids)
    assert len(data) == 256 + 2 * (65_536 - 256) + 3 * (70_000 - 65_536)
    assert (unpack(table, control, data, len(ids)) == ids).all()


ROWS = [(5, "to be or not"), (None, "null id"), (2, None), (9, ""), (5, "to be or not"), (7, "the end " * 3000), (1, "x")]


def test_files_give_every_id_back(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id bigint, text string, key string, part int")
    manifest, folder = write_tokens(docs, public_tokenizers.path(FILES[0]), 2)
    got = sorted(read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 5, 5, 7, 9]
    want = [plain(FILES[0], dict(ROWS)[r.doc_id] or "") + [2] for r in got]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert [r.n_tokens for r in got] == [len(w) for w in want]


def test_pieces_are_gapless(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in ROWS], "doc_id bigint, text string, `offset` int").repartition(3)
    got = packed_pieces(docs, public_tokenizers.path(FILES[1]), 2, window=64).collect()
    for (key, text), copies in ((r, ROWS.count(r)) for r in set(ROWS)):
        ids = plain(FILES[1], text or "") + [2]
        own = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == key)
        assert sum(n for _, n, _ in own) == copies * len(ids)
        assert all(zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) == c for a, n, c in own)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    last = max(windows)
    assert sorted(windows) == list(range(last + 1))
    for k, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == last
    whole = sequences(packed_pieces(docs, public_tokenizers.path(FILES[1]), 2, window=64)).collect()
    assert {(r.n_tokens, len(r.ids)) for r in whole if r.sequence_id != last} == {(64, 256)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    manifest, folder = write_tokens(none, public_tokenizers.path(FILES[0]), 2)
    assert read_tokens(manifest, folder).count() == 0
    assert packed_pieces(none, public_tokenizers.path(FILES[1]), 2).count() == 0
