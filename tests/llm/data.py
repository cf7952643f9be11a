"""Small tables with the cases that operators must stand: nulls, empty and long texts, ties, repeats."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
WORDS = ("amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north oasis plain quarry ridge "
         "stone trail upland valley water").split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts(seed=0):
    rng = random.Random(seed)
    line = "This LINE stands in many documents and is long enough to count."
    out = [None, "", " ", "\n\n", "a", "Ünï çödé 漢字 🎉", "tab\tand  two spaces ", "x\x00y"]
    out += [sentence(rng, n) for n in (1, 2, 3, 5, 30, 80, 200)]
    out += [sentence(rng, 40) + "\n" + line + "\n" + sentence(rng, 12) for _ in range(8)]
    out += ["  " + line.upper() + " \nend", line + "\n" + line]
    same = sentence(rng, 60)
    out += [same, same.upper(), same, same + " more"]
    near = sentence(rng, 300)
    out += [near, near.replace(near.split()[150], "changed"), near + " tail"]
    out += [sentence(rng, 6000)]
    return out


def documents(spark, rows=None, extra=False):
    """Documents of `texts`; with `extra`, repeated rows, a null key and columns with clashing names."""
    if rows is None:
        rows = [(i * 3, t, ["en", "de", None][i % 3], ["s0", "s1", None][i % 3 if i % 4 else 0], None if t is None else len(t))
                for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        more = spark.createDataFrame([(9, rows[3][1], "en", "s0", 2), (None, "no key here", None, None, 11)], SCHEMA)
        df = df.unionByName(more)
        for name in ("id", "digest", "row", "content", "batch", "host", "size", "label", "rank", "item", "mix_copy", "fp", "node",
                     "print", "rate", "number", "found", "draws", "cdf", "word"):
            df = df.withColumn(name, df["n_chars"] if name != "found" else df["lang"])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
