import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def fold(doc_id, n):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n


def corpus(spark, n=120, seed=3, extra=()):
    """Texts with copies, near copies, shared passages, odd white space, nulls, empty and very long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, texts = make(80), []
    for i in range(n):
        w = make(rng.choice([1, 3, 4, 5, 30, 120, 200]))
        if i % 7 == 1 and texts:
            w = list(texts[rng.randrange(len(texts))])
        if i % 7 == 2 and texts:
            w = list(texts[rng.randrange(len(texts))])
            for _ in range(max(1, len(w) // rng.choice([20, 40, 60, 120]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 5 == 3:
            w = w[: len(w) // 2] + passage[: rng.randint(45, 80)] + w[len(w) // 2 :]
        texts.append(w)
    rows = [(3 * i, " ".join(w) if i % 4 else "\t".join(x.title() for x in w) + "\n", ["en", "de", "fr", None][i % 4], ["src0", "src1", None][i % 3], None) for i, w in enumerate(texts)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, " \n\t ", "en", "src0", 4), (1003, " ".join(make(6000)), "en", "src0", 9), (1004, "x" * 50_000, "en", "src9", 50_000), (1005, "é漢 ñ b 12 !!", "es", "srcX", 9)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows + list(extra), SCHEMA).repartition(3)


def clashing(docs):
    """The same rows with more columns, of names that operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("hash", "key", "cid", "sig", "block", "word", "row", "n", "at", "guest", "start", "anchor", "size", "score", "held_out", "kept", "n_words", "mix_slot", "sketch", "cluster")})
