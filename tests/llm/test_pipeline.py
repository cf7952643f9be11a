"""The pipeline against a brute-force version, stage by stage; and the registered queries."""

import math
import random
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from opsweave.llm.mixing import rates_by_temperature
from opsweave.llm.quality import train_quality
from opsweave.llm.simhash import near_groups, shingles
from opsweave.llm.tokens import default_tokenizer, ids_of
from tests.check_oracles import rows as plain_rows
from tests.llm.data import documents, sentence
from tests.llm.test_exact_lines_mixing import low, mixed_brute
from tests.llm.test_quality_html_licenses import corpus

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    _, labels, rows = corpus(spark, 200, seed=11)
    rng = random.Random(12)
    rows = [(i, t, lang, f"s{i % 3}", n) for i, t, lang, _, n in rows]
    for k in range(10):  # exact copies, and near ones
        text = sentence(rng, 150)
        rows.append((1000 + 3 * k, text, "en", "s0", 0))
        rows.append((1001 + 3 * k, text.upper().lower(), "en", "s1", 0))
        words = text.split()
        words[rng.randrange(150)] = "edited"
        rows.append((1002 + 3 * k, " ".join(words), "en", "s2", 0))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]
    quality, exact, near, mix, packing = stages.values()

    model = train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = quality(spark, docs, folder)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in docs.collect() if model.score(r["text"]) >= 0.5}
    assert good.columns == docs.columns

    unique = exact(spark, docs, folder)
    keep = {}
    for r in docs.collect():
        keep[low(r["text"])] = max(keep.get(low(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(keep.values()) and unique.columns == docs.columns

    apart = near(spark, unique, folder)
    left = {r["doc_id"]: set(shingles(r["text"], 5)) for r in unique.collect()}
    kept = {r["doc_id"] for r in apart.collect()}
    alike = [(a, b) for a in left for b in left if a < b and len(left[a] & left[b]) >= 0.8 * len(left[a] | left[b])]
    assert alike and all(not (a in kept and b in kept) for a, b in alike)
    touched = {i for pair in alike for i in pair}
    assert all(i in kept for i in left if i not in touched), "clean documents stay"
    assert apart.columns == docs.columns

    mixed = mix(spark, docs, folder)
    rates = {r["source"]: r["rate"] for r in rates_by_temperature(docs, power=0.5).collect()}
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == mixed_brute(docs.collect(), rates)
    assert mixed.columns == docs.columns

    twice = docs.unionByName(docs)
    packed = packing(spark, twice, folder).collect()
    ids = ids_of(default_tokenizer())
    lengths = Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r["doc_id"]: 2 * len(ids.whole(r["text"]) + [0]) for r in docs.collect()}


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
    got = entry.queries()["pipeline"](spark, folder).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want
    ids = ids_of(default_tokenizer())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    from array import array
    for r in got:
        part = array("I", (ids.whole(texts[r["doc_id"]]) + [0])[r["start"]:r["start"] + r["length"]])
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain_rows(df.columns, df.collect()) == plain_rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") and n not in entry.oracle_sql()))
def test_other_queries_give_a_row_per_row(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    key = "page_id" if name.startswith("op5") else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    want = {r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    got = [r[key] for r in df.select(key).collect()]
    assert set(got) == want and (len(got) == len(want) or name.startswith("op9"))


def all_near_pairs(texts, least=0.8):
    """(a, b) of all texts with different sets of shingles that share `least` of them: an exact prefix filter."""
    sets = [(i, s) for i, s in ((i, set(shingles(t or "", 5))) for i, t in texts) if s]
    often = Counter(g for _, s in sets for g in s)
    index, found = {}, []
    for n, (i, s) in enumerate(sets):
        rare = sorted(s, key=lambda g: (often[g], g))[:len(s) - math.ceil(least * len(s)) + 1]
        for m in {m for g in rare for m in index.get(g, ())}:
            j, u = sets[m]
            both = len(s & u)
            if s != u and both >= least * (len(s) + len(u) - both):
                found.append((i, j))
        for g in rare:
            index.setdefault(g, []).append(n)
    return found


def test_near_dedup_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    group = {r["doc_id"]: r["component_id"] for r in near_groups(docs, words=5, hashes=16, max_bits=184, least=0.8).collect()}
    pairs = all_near_pairs(texts)
    assert pairs and sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    by_set = {}
    for i, t in texts:
        by_set.setdefault(frozenset(shingles(t or "", 5)), set()).add(group[i])
    assert all(len(g) == 1 for g in by_set.values())
