"""The pipeline's stages against plain Python on a whole small table, and the table with odd rows."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lanewise.llm import mixing, toxicity
from lanewise.llm.packing import END_ID, SIZE
from lanewise.llm.queries import tokenizer_path
from test_operators import plain_near, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What went into and came out of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(set(after.columns) == set(COLUMNS) for name, (_, after) in stages.items() if name != "packing")


def test_toxicity_rejects_by_score(spark, stages):
    before, after = stages["toxicity"]
    scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))).select("doc_id", "score").collect()
    assert {r.doc_id for r in scores if r.score < 0.7} == set(texts(after))


def test_exact_and_near(stages):
    before, after = map(texts, stages["exact_dedup"])
    by = defaultdict(list)
    for i, t in before.items():
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert set(after) == {min(g) for g in by.values()}
    before, after = map(texts, stages["near_dedup"])
    _, component = plain_near(before, 5, 80)
    assert set(after) == {i for i, c in component.items() if i == c}


def test_mixing_and_packing(stages):
    before, after = stages["mixing"]
    want = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
    got, copies = Counter(), after.collect()
    full = texts(before)
    for r in copies:
        got[r.doc_id] += len(words(r.text))
        assert words(r.text) == words(full[r.doc_id])[:len(words(r.text))] and (r.n_chars == len(r.text) or r.text == full[r.doc_id])
    assert got == Counter({k: v for k, v in want.items() if v})
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokens = Counter()
    for r in copies:
        tokens[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + len([END_ID])
    packed, places = Counter(), defaultdict(list)
    for r in stages["packing"][1].collect():
        packed[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert packed == tokens
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= SIZE


def test_run_gives_the_last_stage(spark, stages):
    key = ["sequence_id", "offset", "length"]
    got = pipeline.run(spark, SF)
    assert got.count() == stages["packing"][1].count()
    assert got.agg(F.sum("length")).first() == stages["packing"][1].agg(F.sum("length")).first()
    assert len({tuple(r) for r in got.select(*key).collect()}) == got.count()


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, "you are a stupid idiot", "en", "a", 22), (None, None, None, None, None), (2, "", "en", None, 0), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5),
            (4, " ".join(f"w{i}" for i in np.arange(9000)), None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, keep in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / table)
        keep.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        got = pipeline.run(spark, folder).collect()
        assert bool(got) == (table == "full")
        assert all(r.doc_id in (1, 3, 4) for r in got)
