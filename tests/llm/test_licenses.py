import random

import pytest

from llm_helpers import documents, prose, rows_of
from vecspark.llm import licenses as L


@pytest.fixture(scope="module")
def own():
    return L.load(L.TEMPLATES)


def test_every_template_is_found_as_it_is(own):
    for name, text in L.TEMPLATES.items():
        for shown in (text, text.upper(), f"{prose(1, 300)}\n{text}\n{prose(2, 300)}", f"# {prose(3, 40)} {text} {prose(4, 40)}"):
            got = L.scan(own, shown)
            assert [(f[0], f[4]) for f in got] == [(name, "")], (name, shown[:60])
            assert L.words_of(shown[got[0][1] : got[0][2]]) == L.words_of(text)


def test_small_differences_are_told_and_large_ones_rejected(own):
    text = L.TEMPLATES["MIT-text"]
    one = text.replace("free of charge", "without charge").replace("sublicense, ", "")
    (name, _, _, gain, diff), *rest = L.scan(own, prose(1, 50) + "\n" + one)
    assert (name, rest) == ("MIT-text", []) and gain > 0 and set(diff.split()) == {"-free", "-of", "+without", "-sublicense"}
    w = L.TEMPLATES["GPL-3.0-notice"].split()
    r = random.Random(1)
    for i in r.sample(range(len(w)), len(w) // 4):
        w[i] = "other"
    assert not L.scan(own, " ".join(w))
    assert not L.scan(own, "A license is a text. Copyright law grants rights. " * 5)


def test_several_licenses_in_order(own):
    names = ["MIT", "GPL-3.0", "All-rights-reserved", "CC-BY-4.0", "MIT"]
    text = "\n".join(L.TEMPLATES[n] for n in names)
    assert [f[0] for f in L.scan(own, text)] == names
    spread = f"\n{prose(2, 400)}\n\n\n\n\n".join(L.TEMPLATES[n] for n in names)
    assert [f[0] for f in L.scan(own, spread)] == names
    many = " ".join([L.TEMPLATES["All-rights-reserved"], prose(5, 30)] * 120)  # one block of several parts
    assert len(L.scan(own, many)) == 120


def test_templates_without_candidate_words_are_refused():
    with pytest.raises(ValueError):
        L.load({"none": "Do what you want with it."})


def test_whole_table_against_plain_search(spark):
    """The table's license lines are whole sentences; each is one finding, and nothing else is."""
    sf = "/root/testdata/sf0.01"
    short = {n: t for n, t in L.TEMPLATES.items() if len(t) < 90}
    want = sorted(((r["doc_id"], n) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for n, t in short.items() for _ in range((r["text"] or "").count(t))), key=repr)
    assert want and rows_of(L.op10_license_scan(spark, sf), "doc_id", "license") == want


def test_messy_rows(spark, messy):
    got = L.license_scan(messy.withColumn("license", messy.text))
    assert rows_of(got, "doc_id", "license", "exact") == [(6, "MIT", True)]
    assert L.license_scan(messy.where("false")).count() == 0
    assert rows_of(L.license_scan(documents(spark, ["All rights reserved."]), {"own": "All rights reserved."}), "license") == [("own",)]


def test_wrapped_and_long_wordings_are_found_whole(own):
    cc0 = L.TEMPLATES["CC0-1.0"].replace("law, the", "law,\nthe")
    assert [(f[0], f[4]) for f in L.scan(own, f"{prose(1, 30)}\n{cc0}\n{prose(2, 30)}")] == [("CC0-1.0", "")]
    full = " ".join(f"{prose(100 + i, 5)} license" for i in range(260))
    for before in (0, 500, 1100):
        assert [(f[0], f[4]) for f in L.scan(L.load({"full": full}), f"{prose(3, before)} {full} {prose(4, 300)}")] == [("full", "")]
