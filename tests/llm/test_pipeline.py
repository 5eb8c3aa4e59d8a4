import hashlib
import os
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from twinsieve.llm import mixing, neardup, toxicity
from twinsieve.llm.common import fresh_dir
from twinsieve.llm.queries import ORACLE, QUERIES


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names, at = docs.columns, fresh_dir(spark, "stages")
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i < 3:
            assert docs.columns == names
        out.append(docs.collect())
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(list(rows.values()), "doc_id long, text string, lang string, source string, n_chars long"), labels).collect()}
    clean = {i for i, p in scores.items() if not p}
    assert {r.doc_id for r in out[0]} == clean and len(out[0]) == len(clean)
    sets = {r.doc_id: neardup.shingles(r.text.encode()) for r in out[1]}
    gone = clean - set(sets)
    assert gone and len(sets) == len(out[1]) and set(sets) == first_of_groups({i: rows[i].text for i in clean})
    again = mixing.mixed(spark.read.parquet(f"{at}/1"))
    assert sorted(r.doc_id for r in again.select("doc_id").collect()) == sorted(r.doc_id for r in out[2])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in out[2]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        want.append((r.doc_id, len(ids), *sha))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out[3]) == sorted(want)


def first_of_groups(texts):
    """The smallest id of each group that pairs with a similarity of 0.8 or more of their five-word sets make, all pairs compared."""
    def grams(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {top(i) for i in texts}


def test_stages_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = [(None, None, None, None, None), (None, "some words of a text without a number", "en", "s", 3), (9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, " \n\t ", "en", "s", 3), (9004, "word " * 30_000, "en", "s", None), (9004, "word " * 30_000, "en", "s", None), (9005, "ÄÖ é 漢字 🙂", "xx", "s", 1)]
    for extra in (odd, odd[:1]):
        held = docs.unionByName(spark.createDataFrame(extra, docs.schema)) if extra is odd else spark.createDataFrame(extra, docs.schema)
        at = fresh_dir(spark, "odd")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, held, sf).write.parquet(f"{at}/{i}")
            held = spark.read.parquet(f"{at}/{i}")
            if i == 1:
                kept = [r.doc_id for r in held.collect()]
                assert kept.count(9004) == (1 if extra is odd else 0) and kept.count(None) == (2 if extra is odd else 1)
    held = docs.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, sf).write.parquet(f"{at}/none-{i}")
        held = spark.read.parquet(f"{at}/none-{i}")
    assert held.count() == 0


def test_queries_have_sql_or_tests():
    assert list(QUERIES) == ["op1_toxicity", "op2_warc", "op3_token_store", "op4_mixing", "op5_bpe", "op6_bitslice", "op7_rpforest", "op8_urlrules", "op9_tagpath", "op10_simhash", "op11_balltree", "op12_suffixtree", "op13_runs"]
    assert set(ORACLE) == {"op4_mixing", "op6_bitslice", "op11_balltree", "op12_suffixtree"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    df = QUERIES[name](spark, sf)
    want = c.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(x) for x in cols]
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
