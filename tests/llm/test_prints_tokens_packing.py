import math
import os
import random
import subprocess
import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import opsweave
from opsweave.llm import simhash, tokens
from opsweave.llm.components import components
from opsweave.llm.order_minhash import edited_fingerprints
from opsweave.llm.packing import best_fit, crossover, evolve, fitness, pack
from opsweave.llm.simhash import drop_near, near_groups, shingles
from opsweave.llm.tokens import as_ranks, default_tokenizer, ids_of, token_counts
from tests.llm.data import documents, empty, sentence


def fingerprint_brute(text, words=3):
    low = (text or "").encode().lower().split()
    grams = [b" ".join(low[i:i + words]) for i in range(max(1, len(low) - words + 1))] if low else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_brute(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = {r["doc_id"]: fingerprint_brute(r["text"]) for r in rows}
    want = components_brute(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = near_groups(docs).collect()
    assert {r["doc_id"]: r["fp"][0] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want)


def test_links_of_random_and_close_fingerprints(spark):
    from opsweave.llm.simhash import links_within_two
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(8):
            values.add(value)
            value ^= 1 << rng.randrange(64)
            value ^= 1 << rng.choice([rng.randrange(64), 63])
    values = sorted(values)
    prints = spark.createDataFrame([(i, [v - (1 << 64) if v >> 63 else v]) for i, v in enumerate(values)], "node long, fp array<long>")
    got = {r["node"]: r["root"] for r in components(links_within_two(prints)).collect()}
    want = components_brute(list(range(len(values))), lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(300, 300 + i) for i in range(1, 50)] + [(500, 500)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{300 + i: 300 for i in range(50)}}


def test_near_copies_are_dropped_and_others_stay(spark):
    rng = random.Random(5)
    rows, groups = [], defaultdict(set)
    for g in range(60):
        words = sentence(rng, 250).split()
        for c in range(3):
            copy = list(words)
            for _ in range(c * 2):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10 ** 6)}"
            groups[g].add(len(rows))
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    rows += [(len(rows) + i, sentence(rng, rng.randrange(20, 400)), "en", "s", 0) for i in range(60)]
    docs = documents(spark, rows)

    def share(a, b):
        x, y = set(shingles(a, 5)), set(shingles(b, 5))
        return len(x & y) / len(x | y)

    kept = {r["doc_id"] for r in drop_near(docs).select("doc_id").collect()}
    assert all(i in kept for i in range(180, 240)), "a text unlike all others stays"
    close = [i for g, ids in groups.items() for i in sorted(ids)[1:] if share(rows[min(ids)][1], rows[i][1]) >= 0.85]
    assert sum(i in kept for i in close) <= 0.02 * len(close) and len(close) > 60
    assert all(kept & ids for ids in groups.values())


def test_near_copies_within_a_family_that_shares_a_template(spark):
    rng = random.Random(8)
    template = sentence(rng, 125).split()
    rows = [(i, " ".join(template + sentence(rng, 25).split()), "en", "s", 0) for i in range(1000)]
    for i in range(60):
        copy = rows[16 * i][1].split()
        for at in rng.sample(range(5, 145), 3):
            copy[at] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((1000 + 16 * i, " ".join(copy), "en", "s", 0))
    left = {i: set(shingles(t, 5)) for i, t, *_ in rows}
    planted = {i for i in left if i >= 1000}
    assert all(len(left[i] & left[i - 1000]) >= 0.8 * len(left[i] | left[i - 1000]) for i in planted)
    assert not any(len(left[a] & left[b]) >= 0.8 * len(left[a] | left[b]) for a in range(1000) for b in range(a))
    kept = {r["doc_id"] for r in drop_near(documents(spark, rows)).select("doc_id").collect()}
    assert len(planted & kept) <= 6 and kept >= set(range(1000))


def test_recall_holds_with_the_index_of_a_corpus_of_any_size(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        words = sentence(rng, 244).split()
        rows.append((i, " ".join(words), "en", "s", 0))
        for at in range(12, 225, 45):  # 25 of 240 shingles on either side differ: 0.81
            words[at + rng.randrange(20)] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(words), "en", "s", 0))
    docs = documents(spark, rows)
    tables = simhash.tables_for(simhash.WIDTH, 1024, 184, 0.8)  # the same for a corpus of any size
    assert 0.95 <= simhash.recall(simhash.WIDTH, tables, 1024, 184, 0.8) < 0.96
    assert simhash.recall(simhash.WIDTH, tables, 1024, 184, 0.85) > 0.99
    kept = {r["doc_id"] for r in drop_near(docs).select("doc_id").collect()}
    assert kept >= set(range(150)) and len(kept) - 150 <= 13


def test_repeats_count_once_for_near_copies(spark):
    rng = random.Random(10)
    texts, line, spam = [sentence(rng, 300) for _ in range(8)], sentence(rng, 8), "buy now " * 400
    rows = [(i, t + "\n" + line, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(100 + i, t + ("\n" + line) * 50, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(200 + i, sentence(rng, 60) + " " + spam, "en", "s", 0) for i in range(6)]
    kept = {r["doc_id"] for r in drop_near(documents(spark, rows)).select("doc_id").collect()}
    assert kept == {*range(8), *range(200, 206)}


def test_simhash_odd_rows(spark):
    docs = documents(spark, extra=True)
    assert near_groups(docs).count() == docs.count()
    assert drop_near(docs).columns == docs.columns
    assert near_groups(empty(spark)).count() == 0 and drop_near(empty(spark)).count() == 0


def test_token_ids_are_the_librarys():
    ids = ids_of(default_tokenizer())
    assert as_ranks(default_tokenizer()) and ids._fast is not None
    rng = random.Random(2)
    odd = ["", " ", "a  b", "\n \t x", "<|endoftext|>", "a<|endoftext|> b", "it's 'S 'll", "é ñ 漢字 ١٢ ½", "\x00 \x85\xa0y", "🎉" * 9]
    odd += ["".join(rng.choice("aB1 .\n\t'é漢\xa0") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in odd:
        assert ids.of(text) == ids.whole(text), repr(text)


def test_token_counts_and_cache(spark, tmp_path):
    docs, cache = documents(spark, extra=True), str(tmp_path / "cache")
    ids = ids_of(default_tokenizer())
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(ids.whole(r["text"] or "")))
                   for r in docs.collect()))
    for _ in range(2):
        got = token_counts(docs, cache=cache).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    stored.agg(F.max("version")).first()
    assert token_counts(empty(spark)).count() == 0


def test_stored_counts_are_used(spark, tmp_path):
    from opsweave.llm.tokens import version_of
    cache = str(tmp_path / "cache")
    docs = documents(spark, [(1, "known text", "en", "s", 10)])
    (docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
     .write.parquet(f"{cache}/version={version_of(default_tokenizer())}"))
    assert token_counts(docs, cache=cache).first()["n_tokens"] == 77


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    docs = documents(spark, extra=extra)
    ids = ids_of(default_tokenizer())
    texts = sorted((r["text"] or "" for r in docs.collect()), key=str)
    got = pack(docs, with_ids=True).collect()
    found = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 2048
        found[r["doc_id"]].append(r)
    whole = sorted(array("I", ids.whole(t) + [0]).tobytes() for t in texts)
    seen = []
    for rows in found.values():
        rows.sort(key=lambda r: (r["piece"], r["start"]))
        copies = sum(r["piece"] == 0 for r in rows)
        if copies == 1:
            assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
            assert all(r["length"] == 2048 for r in rows[1:])
            seen.append(b"".join(bytes(r["ids"]) for r in rows))
        else:
            seen += [bytes(r["ids"]) for r in rows]
    assert sorted(seen) == whole
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= math.ceil(total / 2048) + 1
    assert pack(empty(spark)).count() == 0


def test_genetic_steps_keep_items_whole():
    rng = random.Random(4)
    lengths = [rng.choice([3, 7, 11, 20, 33, 49, 51, 67, 90]) for _ in range(300)]
    a = best_fit([], list(range(300)), lengths, 100)
    b = best_fit([], rng.sample(range(300), 300), lengths, 100)
    child = crossover(a, b, lengths, 100, rng)
    for bins in (a, b, child, evolve(lengths, 100, [], 1)[0]):
        assert sorted(i for x in bins for i in x) == list(range(300))
        assert all(sum(lengths[i] for i in x) <= 100 for x in bins)
    assert fitness(evolve(lengths, 100, [a], 1)[0], lengths) >= fitness(a, lengths)
    thirds = [34, 33, 33] * 40  # longest first pairs the 34s; the least number is 40
    longest_first = best_fit([], list(range(120)), thirds, 100)
    assert len(longest_first) == 47 and len(evolve(thirds, 100, [longest_first], 1)[0]) <= 43


def test_order_minhash(spark):
    docs = documents(spark)
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in edited_fingerprints(docs).collect()}
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        g = got[r["doc_id"]]
        assert g["edited_text"] == text[:len(text) - half] + following[:half] and g["n_chars"] == len(text)
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        after = got[rows[(i + 1) % len(rows)]["doc_id"]]["fingerprint"]
        bins = {x >> 58 for x in g["fingerprint"]} | {x >> 58 for x in after}
        assert g["near_next"] == pytest.approx(len(set(g["fingerprint"]) & set(after)) / len(bins) if bins else 1.0)
    by_text = defaultdict(set)
    for r in rows:
        by_text[" ".join((r["text"] or "").split(" "))].add(tuple(got[r["doc_id"]]["fingerprint"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_order_counts_and_edits_show(spark):
    rng = random.Random(8)
    words = sentence(rng, 400).split()
    edits = {n: list(words) for n in (0, 4, 40, 200)}
    for n, w in edits.items():
        for i in rng.sample(range(400), n):
            w[i] = f"new{i}"
    blocks = [words[i:i + 100] for i in range(0, 400, 100)]
    versions = {**{f"e{n}": w for n, w in edits.items()}, "moved": sum(reversed(blocks), []), "other": sentence(rng, 400).split()}
    from opsweave.llm.order_minhash import likeness, signature
    df = spark.createDataFrame([(k, " ".join(words), " ".join(v)) for k, v in versions.items()], "k string, a string, b string")
    got = {r["k"]: r["near"] for r in df.select("k", likeness(signature(F.col("a")), signature(F.col("b"))).alias("near")).collect()}
    assert got["e0"] == 1 > got["e4"] > got["e40"] > got["e200"] >= got["other"] == 0
    assert got["moved"] < got["e4"], "the order of text counts, not only its k-mers"


def test_order_shows_in_short_texts(spark):
    from opsweave.llm.order_minhash import likeness, signature
    rng = random.Random(11)
    rows = []
    for n in (40, 64, 100):
        for _ in range(20):
            words = sentence(rng, n).split()
            rows.append((n, " ".join(words), " ".join(words[n // 2:] + words[:n // 2])))
    df = spark.createDataFrame(rows, "n int, a string, b string").select(
        "n", F.size(signature(F.col("a"))).alias("size"), likeness(signature(F.col("a")), signature(F.col("b"))).alias("near"))
    got = {r["n"]: r for r in df.groupBy("n").agg(F.avg("near").alias("near"), F.min("size").alias("least")).collect()}
    assert all(0.3 < r["near"] < 0.6 and r["least"] == 64 for r in got.values()), got
    few = spark.createDataFrame([("a b",), ("a b c",)], "a string").select(signature(F.col("a")).alias("s")).collect()
    assert all([x >> 58 for x in r["s"]] == list(range(-32, 32)) for r in few)


def test_order_minhash_odd_rows(spark):
    docs = documents(spark, extra=True)
    assert edited_fingerprints(docs).count() == docs.count()
    assert edited_fingerprints(empty(spark)).count() == 0
    one = edited_fingerprints(documents(spark, [(7, "a b c d", "en", "s", 7)])).first()
    assert one["edited_text"] == "a ba b" + "" or one["edited_text"] == "a b " + "a b"
    assert one["near_next"] == 1.0


def test_workers_need_no_package(tmp_path):
    """A session whose workers cannot import the package counts tokens and packs."""
    script = tmp_path / "alone.py"
    script.write_text(f"""
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())

def importable(frames):
    import importlib.util
    import pandas as pd
    for pdf in frames:
        yield pd.DataFrame({{"found": [importlib.util.find_spec("opsweave") is not None]}})

sys.path.insert(0, {os.path.dirname(os.path.dirname(opsweave.__file__))!r})
assert not spark.range(1).mapInPandas(importable, "found boolean").first()["found"]
from opsweave.llm.packing import pack
from opsweave.llm.tokens import token_counts
docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
print("counted", token_counts(docs).count(), pack(docs).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "counted 2 2" in done.stdout, done.stderr[-2000:]


def test_cache_of_other_contents_is_not_rewritten(spark, tmp_path, monkeypatch):
    sizes = []

    def seen(df, name, write=tokens.written):
        out = write(df, name)
        sizes.append(out.count())
        return out

    cache = str(tmp_path / "cache")
    others = documents(spark, [(i, f"other {i}", "en", "s", 0) for i in range(50)])
    assert token_counts(others, cache=cache).count() == 50
    monkeypatch.setattr(tokens, "written", seen)
    batch = documents(spark, [(1, "other 3", "en", "s", 0), (2, "new one", "en", "s", 0), (3, "new one", "en", "s", 0)])
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(batch, cache=cache).collect()}
    ids = ids_of(default_tokenizer())
    assert got == {1: len(ids.whole("other 3")), 2: len(ids.whole("new one")), 3: len(ids.whole("new one"))}
    assert sizes == [2]


def test_wide_fingerprints_by_definition():
    grams = [b"a b c", b"d e f", b"g h", b"ijk"]
    mask = (1 << 64) - 1
    words = []
    for word in range(3):
        mixed = []
        for g in grams:
            x = (xxhash.xxh64_intdigest(g, 42) + (word + 1) * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            mixed.append(x ^ x >> 31)
        words.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in mixed) * 2 > len(grams)))
    assert [w & mask for w in simhash.wide_simhash(grams, 3)] == words
    assert simhash.wide_simhash([], 2) == [0, 0]


def test_middle_of_a_group_is_nearest_to_its_majority():
    near = np.array([0b0111, 0b1111, 0b1110, -1, 5, 5], dtype=np.int64)
    assert simhash.middles(near, np.array([0, 3, 4])).tolist() == [1, 3, 4]


def test_middle_is_met_whatever_the_signs_of_words(spark):
    entries = spark.createDataFrame([(1, -1, 7, [-1, 5]), (2, -2, 7, [-2, 5]), (3, 2 ** 63 - 1, 7, [2 ** 63 - 1, 5]), (4, 0, 7, [0, 5])],
                                    "node long, near long, key long, fp array<long>")
    assert [tuple(r) for r in simhash._meet_middle(entries, 1, 1).collect()] == [(2, 1)]
    assert sorted(tuple(r) for r in simhash._meet_middle(entries, 2, 2).collect()) == [(2, 1), (3, 2)]
    assert simhash._meet_middle(entries, 2, 1).count() == 1


def test_members_that_meet_by_chance_are_left_out(spark):
    far = [(100 + i, (i * 0x9E3779B97F4A7C15) % (1 << 63), 4) for i in range(simhash.FEW + 1)]
    found = spark.createDataFrame([(1, 0, 1), (2, -1, 1), (3, 0, 2), (4, 1, 2), (5, 0, 3), (6, 0, 3), (7, -1, 3), (8, 0, 5), *far],
                                  "node long, near long, key long")
    kept = {tuple(r) for r in simhash.shared_entries(found, ["key"], 17).select("node", "near", "key").collect()}
    assert kept == {(3, 0, 2), (4, 1, 2), (5, 0, 3), (6, 0, 3), *far}


def test_fingerprints_are_fetched_once_for_both_steps(spark, monkeypatch, tmp_path):
    rng = random.Random(12)
    base = rng.getrandbits(1024)
    values = [base]
    for n in [60] * 30 + [190] * 10:  # copies of one text, and texts near it that are no copies
        values.append(base ^ sum(1 << b for b in rng.sample(range(1024), n)))
    rows = [(i, np.frombuffer(v.to_bytes(128, "little"), dtype=np.int64).tolist()) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "node long, fp array<long>").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    simhash.segment_entries(prints, 16, 8, 20).write.parquet(f"{tmp_path}/index")
    fetched, write = [], simhash.written

    def noted(df, name):
        fetched.extend([name] if any("/prints/" in f for f in df.inputFiles()) else [])
        return write(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    links = simhash.links_by_segments(prints, spark.read.parquet(f"{tmp_path}/index"), 16, 150, lambda pairs: pairs)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    assert root == {i: 0 for i in range(31)}
    assert fetched == ["entries"]
