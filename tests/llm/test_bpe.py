import hashlib
import random

import numpy as np
import pytest

from llm_helpers import documents
from vecspark.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return B.Encoder(B.default_tokenizer())


def check(own, library, texts):
    at, ids = own.encode_all(texts)
    decoded = own.decode_all(at, ids)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, t
        assert (decoded[i].as_py() or "") == library.decode(want, skip_special_tokens=False)


def test_odd_texts(own, library):
    r = random.Random(5)
    pieces = ["<|startoftext|>", "<|endoftext|>", "<|", "|>", "\x1c", "\x1f", "́", "\xa0", " ", "　", "᠎", "​", "Σ", "ΑΣ", "İ", "'s", "'LL", "don't", "ﬀ", "é", "한국", "日本語", "😀", " ", " ",
              "\x85", "1", "42", "a", "ab", "the", "of", "  ", "\n", "\t", "!!", "_", "½", "ⅷ", "ͅ", "Å", "\x00", ";", "﻿", "\xad"]
    check(own, library, ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", None, " "])


def test_characters_known_to_all_tables(own, library):
    import unicodedata

    assigned = [c for c in map(chr, range(0x30000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    r = random.Random(6)
    check(own, library, ["".join(r.choice(assigned) for _ in range(8)) for _ in range(3000)])


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in B.op7_bpe(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_merging_together_equals_merging_alone(own):
    r = random.Random(7)
    pieces = ["".join(r.choice("theandingstion") for _ in range(r.randrange(0, 25))).encode() for _ in range(3000)]
    at, ids = own.merge(pieces)
    for i in r.sample(range(3000), 200):
        assert own.merge([pieces[i]])[1].tolist() == ids[at[i] : at[i + 1]].tolist()
    small = B.Encoder(B.default_tokenizer(), limit=3)  # a full cache changes nothing
    text = " ".join(p.decode() for p in pieces)
    assert small.encode(text) == own.encode(text) == small.encode(text)


def test_messy_rows(spark, messy, library):
    got = B.encode(messy, B.default_tokenizer())
    assert got.columns == [*[c for c in messy.columns if c not in ("ids", "n_tokens")], "ids", "n_tokens", "decoded_sha256"]
    for r in got.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert B.digests(messy, B.default_tokenizer()).count() == messy.count()
    assert B.digests(documents(spark, [(1, "x")]).where("false"), B.default_tokenizer()).count() == 0


def test_characters_that_tables_disagree_on(own, library):
    import unicodedata

    # unassigned for this Python, newer marks for the library; each between letters, before and after other marks
    disagreed = [chr(c) for c in np.flatnonzero(B.library(B.default_tokenizer()).foreign) if not 0xD800 <= c < 0xE000]
    marks = [c for c in disagreed if unicodedata.category(c) != "Cn"]
    assert len(marks) > 3 and {"\u0898", "\u1ace", "\U0001e4ec"} <= set(marks)
    r = random.Random(8)
    every = [c for c in map(chr, range(0x30000)) if unicodedata.category(c)[0] == "M"]
    check(own, library, [f"a{c}\u0301b {c} A{c}\u0316\u0327{c}" for c in marks] + [f"x{c}y 1{c}{c}" for c in r.sample(disagreed, 400)])
    check(own, library, [" ".join("e" + "".join(r.choice(every) for _ in range(r.randrange(4))) for _ in range(3)) for _ in range(1000)])
