"""Hand-made documents for the tests of the training-data operators."""

import random

#: Columns whose names the operators also return or use inside.
CLASHES = ["shard", "slot", "keep_id", "score", "n", "sig", "block", "text_sha256", "uid", "kind", "weight", "source",
           "__key", "__copy", "__keep", "__hits", "__score", "row", "id", "key", "copy", "keep", "tie", "nth", "slot_", "words", "bucket",
           "tree", "place", "size", "digest", "carried", "path", "group", "root", "leaf", "samples", "word"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES if c != "source")


def documents(spark, rows):
    """A documents table with further columns of clashing names, all null."""
    return spark.createDataFrame([(i, t, s, *[None] * (len(CLASHES) - 1)) for i, t, s in rows], SCHEMA)


def plain(seed=7):
    """(id, text) rows with unique ids: prose, copies, edits, junk, long and empty texts."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("sal", "mor", "ti", "ve", "no", "ka") for b in ("ra", "li", "den", "", "ost", "é")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(200)
    texts = [None, "", " ", "one", "One", "a b c", "A b c", base, base, base.upper(), base + " end"]
    for k in range(1, 14):  # near copies at several distances
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"w{k}{rng.randrange(99)}"
        texts.append(" ".join(words))
    passage = prose(70)
    texts += [prose(40) + " " + passage + " " + prose(30), prose(25) + "\n" + passage, passage + "! " + prose(15)]
    texts += ["ab" * 400, "ab" * 260, "x" * 1000 + " y", prose(20000), "é" * 300, "é" * 300 + "z"]
    texts += ["Released under the MIT License. mit  license, MIT-license", "GNU General Public License, version 3; cc-by 4.0",
              "Licensed under the Apache License, Version 2.0.", "mit licenses and summit license", "CC BY-NC-SA 4.0 cc by",
              "This is released into the public domain.", "permission is hereby granted free of charge to any person "
              "obtaining a copy under the mit license"]
    texts += ["mail a@b.co, x.y+z@mail.example.com_q@r.st now", "1.2.3.4 256.1.1.1 10.0.0.256.7.8.9.1 001.002.003.255",
              "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4012888888881881", "+1 (415) 555-0100 +123 +49 30 1234567890 ++1234567890",
              "é@b.c é +12 345 678 901 2", "12" * 40, "a.b@c.d.e@f.g", "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\" x"]
    return list(enumerate(texts, 10))


def hard(spark):
    """Nulls in any column, ties, repeated rows, ids that repeat with other texts."""
    rows = [(i, t, f"s{i % 3}") for i, t in plain()]
    rows += [(None, "null id text", "s1"), (None, None, None), (11, "", None), (500, "same", "s0"), (500, "same", "s0"),
             (500, "other text of one id", None), (501, plain()[7][1], "s1")]
    return documents(spark, rows)

