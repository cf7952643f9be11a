import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opsweave.llm.exact import drop_exact, exact_groups
from opsweave.llm.lines import LineRuns, dedup_lines
from opsweave.llm.mixing import mix_sources, rates_by_temperature
from tests.llm.data import documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_groups(spark, digest):
    docs = documents(spark)
    got = exact_groups(docs, **({"digest": digest} if digest else {})).collect()
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r["text"])].append(r["doc_id"])
    want = {r["doc_id"]: (max(groups[low(r["text"])]), len(groups[low(r["text"])])) for r in rows}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    if digest is None:
        assert {r["doc_id"]: r["text_sha256"] for r in got} == {
            r["doc_id"]: hashlib.sha256(low(r["text"]).encode()).hexdigest() for r in rows}


def test_exact_hot_group_and_odd_rows(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_groups(hot)
    assert got.where("kept").count() == 2001 and got.agg(F.max("group_size")).first()[0] == 1000
    docs = documents(spark, extra=True)
    assert exact_groups(docs).count() == docs.count()
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    assert exact_groups(empty(spark)).count() == 0 and drop_exact(empty(spark)).count() == 0


def lines_brute(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            key = low(line.strip(strip))
            if len(key) >= min_chars and r["doc_id"] is not None:
                holders[key].add(r["doc_id"])
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(low(x.strip(strip)), ())) >= min_docs and r["doc_id"] != max(h))]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("extra,batches", [(False, 1), (False, 4), (True, 3)])
def test_lines(spark, extra, batches):
    docs = documents(spark, extra=extra)
    got = Counter(tuple(r) for r in dedup_lines(docs, batches=batches).collect())
    assert got == lines_brute(docs.collect())
    assert any(n[2] for n in got)


def test_lines_empty(spark):
    assert dedup_lines(empty(spark)).count() == 0


def test_runs_are_levelled(spark):
    runs = LineRuns(spark)
    for b in range(4):
        runs.add(spark.createDataFrame([(bytes([b]), 10 - b), (b"x", 10 - b)], "digest binary, doc_id long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    total = {bytes(r["digest"]): (r["first_doc"], r["n_docs"]) for r in runs.totals().collect()}
    assert total[b"x"] == (10, 4) and total[b"\x02"] == (8, 1)


def mixed_brute(rows, rates, seed=1):
    out = Counter()
    for r in rows:
        rate = rates.get(r["source"], 1.0)
        draws = max(1, math.ceil(rate / 16))
        n = 0
        for j in range(1, draws + 1):
            key = ":".join(x for x in (str(seed), None if r["doc_id"] is None else str(r["doc_id"]), str(j)) if x is not None)
            u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2 ** 52
            p = c = math.exp(-rate / draws)
            k = 0
            while c <= u and k < 95:
                k += 1
                p *= rate / draws / k
                c += p
                n += 1
        out[(r["doc_id"], r["text"])] += n
    return +out


def test_mixing(spark):
    docs = documents(spark, extra=True)
    rates = {"s0": 0.4, "s1": 40.5, None: 2.0}
    table = spark.createDataFrame(list(rates.items()), "source string, rate double")
    got = mix_sources(docs, table)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == mixed_brute(docs.collect(), rates)
    assert set(docs.columns) <= set(got.columns)
    assert mix_sources(docs, table.where("source = 'zz'")).where("mix_rate <> 1").count() == 0
    assert mix_sources(empty(spark), table).count() == 0


def test_rates_meet_the_target(spark):
    docs = documents(spark)
    rates = {r["source"]: r["rate"] for r in rates_by_temperature(docs, power=0.5).collect()}
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(r["text"] or "")
    shares = {s: rates[s] * n for s, n in sizes.items()}
    assert sum(shares.values()) == pytest.approx(sum(sizes.values()))
    assert shares["s0"] / shares["s1"] == pytest.approx(math.sqrt(sizes["s0"] / sizes["s1"]))
