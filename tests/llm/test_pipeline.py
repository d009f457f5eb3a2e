"""Each stage of the pipeline against brute force on the rows that it gets, and the registered queries."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as C
from llm_helpers import documents, prose
from test_decontaminate import brute as contaminated
from test_neardup import brute as groups
from test_passages import runs
from vecspark.llm import bpe, quality, registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before the first stage and after each, as the pipeline hands them on."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "minhash_neardup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    assert all(d.columns == COLUMNS for d in steps[:5]) and steps[5].columns == [*COLUMNS, "ids", "n_tokens", "decoded_sha256"]


def test_quality(spark, steps):
    docs = steps[0]
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    texts = {i: r["text"] for i, r in rows(docs).items()}
    score = dict(zip(texts, trees.score(quality.statistics(pa.array(list(texts.values()), pa.string()))), strict=True))
    assert rows(steps[1]) == {i: r for i, r in rows(docs).items() if score[i] >= 0.3} and 0 < len(rows(steps[1])) < len(texts)


def test_near_duplicates(steps):
    before = rows(steps[1])
    want = groups([(i, r["text"]) for i, r in before.items()], 80)
    assert rows(steps[2]) == {i: r for i, r in before.items() if want[i][1] == i}


def test_passages(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert before.keys() == after.keys()
    first, held = {}, {}
    for i in sorted(before):
        for g in runs(before[i]["text"]):
            first.setdefault(g, i)
    for i in sorted(before):
        if all(first[g] == i for g in runs(before[i]["text"])) and after[i] != before[i]:
            assert len(before[i]["text"].split()) - len(after[i]["text"].split()) >= 50  # a near repeat
        for g in runs(after[i]["text"]) & runs(before[i]["text"]):
            assert held.setdefault(g, i) == i
        assert after[i]["n_chars"] == len(after[i]["text"]) or after[i] == before[i]


def test_decontamination(spark, steps):
    before = rows(steps[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, _, n, *_ in contaminated([(i, r["text"]) for i, r in before.items()], items) if n}
    assert hit and rows(steps[4]) == {i: r for i, r in before.items() if i not in hit}


def test_encoding(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    library.no_padding()
    before, after = rows(steps[4]), rows(steps[5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["text"] == before[i]["text"]
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, steps):
    got, want = rows(C.run(spark, SF)), rows(steps[5])
    assert got == want


def test_stages_take_messy_rows(spark, messy):
    for _, stage in C.STAGES[:4]:
        out = stage(spark, messy, SF)
        assert out.columns == messy.columns
        assert out.where("doc_id = 4").count() == (0 if stage is C.quality_classifier and not out.where("doc_id = 3").count() else 1)
        assert stage(spark, messy.where("false"), SF).count() == 0
    assert C.bpe_encoding(spark, messy, SF).count() == messy.count()


def test_planted_cases(spark):
    """Exact and near copies, a benchmark passage and a long repeat go; clean documents stay."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base, passage = prose(50, 200, 10**6), prose(51, 60, 10**6)
    texts = [base, base, base.replace(base.split()[9], "changed"), f"{prose(52, 90, 10**6)} {passage}", f"{passage} {prose(53, 90, 10**6)}", f"{prose(54, 50, 10**6)} {item}", prose(55, 300, 10**6)]
    docs = documents(spark, texts)
    docs = C.minhash_neardup(spark, docs, SF)
    docs = C.substring_dedup(spark, docs, SF)
    docs = C.decontamination(spark, docs, SF)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {0: base, 3: texts[3], 4: prose(53, 90, 10**6), 6: texts[6]}


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)
    assert {*names, "pipeline"} <= set(e.queries()) and np.iterable(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    import duckdb

    from test_catalog import canon

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toArrow(), c.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and canon(got) == canon(want)
