"""License scans with ordered signature rules.

A text is cut into words (see :data:`SEPARATORS`) joined by single blanks, and
rules (regexes on that line) mark intervals of words.  A rule runs only where
its keyword occurs.  A detection inside another of the same or a higher
priority is suppressed; at the same interval the higher priority, then the
earlier rule, wins.  DataFrame expressions only.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that separate words, after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text that is not lower-cased yet.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases: label and words (fixed values).
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"),
        ("cc-by", "cc by"), ("mit", "mit license"))

#: Families: label, keyword (every name holds it), names (regexes on words), versions, SPDX words.
FAMILIES = (
    ("gpl", "gpl", ("gpl", "gplv[23]"), ("2 0", "3 0", "2", "3"), "gpl"),
    ("gpl", "gnu", ("gnu general public license", "gnu gpl"), ("2 0", "3 0", "2", "3"), "gpl"),
    ("lgpl", "lgpl", ("lgpl", "lgplv[23]"), ("2 1", "3 0", "3"), "lgpl"),
    ("lgpl", "gnu", ("gnu lesser general public license", "gnu library general public license"), ("2 1", "3"), ""),
    ("agpl", "agpl", ("agpl", "agplv3"), ("3 0", "3"), "agpl"),
    ("agpl", "affero", ("(?:gnu )?affero general public license",), ("3 0", "3"), ""),
    ("gfdl", "gnu", ("gnu free documentation license",), ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache", "apache", ("apache(?: software)? license", "apache licence"), ("1 0", "1 1", "2 0", "2"), "apache"),
    ("mit", "mit", ("mit license", "mit licence", "mit x11 license"), (), "mit"),
    ("isc", "isc", ("isc license", "isc licence"), (), "isc"),
    ("bsd", "bsd", ("(?:[234] clause )?bsd license", "(?:new|modified|simplified|revised) bsd license",
                    "bsd licence"), ("2 clause", "3 clause", "4 clause"), ""),
    ("bsd", "berkeley", ("berkeley software distribution license",), ("2 clause", "3 clause", "4 clause"), "bsd"),
    ("mpl", "mozilla", ("mozilla public license",), ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", "eclipse", ("eclipse public license",), ("1 0", "2 0"), "epl"),
    ("edl", "eclipse", ("eclipse distribution license",), ("1 0",), ""),
    ("cddl", "common development", ("common development and distribution license",), ("1 0", "1 1"), "cddl"),
    ("cpl", "common public", ("common public license",), ("1 0",), "cpl"),
    ("eupl", "european union", ("european union public licen[cs]e",), ("1 1", "1 2"), "eupl"),
    ("artistic", "artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0"), "artistic"),
    ("zlib", "zlib", ("zlib license", "zlib libpng license"), (), "zlib"),
    ("boost", "boost", ("boost software license",), ("1 0",), "bsl"),
    ("unlicense", "unlicense", ("unlicense", "the unlicense"), (), "unlicense"),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",), "wtfpl"),
    ("python", "python", ("python software foundation license",), ("2",), ""),
    ("python", "psf", ("psf license",), ("2",), "psf"),
    ("php", "php", ("php license",), ("3 0", "3 01"), "php"),
    ("ofl", "open font", ("sil open font license",), ("1 0", "1 1"), "ofl"),
    ("odbl", "open data", ("open database license", "open data commons open database license"), ("1 0",), "odbl"),
    ("odc-by", "open data", ("open data commons attribution license",), ("1 0",), "odc by"),
    ("pddl", "open data", ("open data commons public domain dedication and licen[cs]e",), ("1 0",), "pddl"),
    ("ms-pl", "microsoft", ("microsoft public license",), (), "ms pl"),
    ("ms-rl", "microsoft", ("microsoft reciprocal license",), (), "ms rl"),
    ("postgresql", "postgresql", ("postgresql licen[cs]e",), (), "postgresql"),
    ("openssl", "openssl", ("openssl license",), (), "openssl"),
    ("ruby", "ruby", ("ruby license",), (), "ruby"),
    ("qpl", "q public", ("q public license",), ("1 0",), "qpl"),
    ("afl", "academic free", ("academic free license",), ("2 1", "3 0"), "afl"),
    ("osl", "open software", ("open software license",), ("2 1", "3 0"), "osl"),
    ("upl", "universal permissive", ("universal permissive license",), ("1 0",), "upl"),
    ("vim", "vim", ("vim license",), (), "vim"),
    ("cc-by", "cc by", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0"), ""),
    ("cc-by", "ccby", ("ccby",), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by"),
    ("cc-by-sa", "cc by sa", ("cc by sa",), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by sa"),
    ("cc-by-nc", "cc by nc", ("cc by nc",), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc"),
    ("cc-by-nd", "cc by nd", ("cc by nd",), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa", ("cc by nc sa",), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", ("cc by nc nd",), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc nd"),
    ("cc0", "cc0", ("cc0(?: 1 0)?(?: universal)?",), (), "cc0"),
    ("cc-by", "creative commons", ("creative commons attribution(?: international| unported)?(?: license)?",),
     ("2 0", "2 5", "3 0", "4 0"), ""),
    ("cc-by-sa", "creative commons", ("creative commons attribution share ?alike(?: license)?",), ("3 0", "4 0"), ""),
    ("cc-by-nc", "creative commons", ("creative commons attribution non ?commercial(?: license)?",), ("3 0", "4 0"), ""),
)

#: Sentences that identify a license or a reservation: label, keyword, regex, priority, confidence.
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 4, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 4, 1.0),
    ("gpl", "general public", "free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", 4, 1.0),
    ("lgpl", "general public", "under the terms of the gnu lesser general public license", 4, 1.0),
    ("apache", "apache", "licensed under the apache license version 2 0 the license", 4, 1.0),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 3, 0.95),
    ("public-domain", "public domain", "public domain", 1, 0.6),
    ("proprietary", "rights reserved", "all rights reserved", 1, 0.5),
    ("proprietary", "be reproduced", "no part of this (?:work|publication|document) may be reproduced", 3, 0.9),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 4, 1.0),
)

#: What a text must hold for any rule to run, words with any separators between
#: them: whatever a rule's regex matches holds one of these.
ROOTS = ("licen", "gpl", "cc0", "public domain", "rights reserved", "permission is", "permission to",
         "redistribution and", "be reproduced", "creative", "wtfpl", "ccby", "cc by")


def signature_rules() -> list[dict]:
    """All rules in their order: ``rule, label, keyword, regex, priority,
    confidence, base``.  The base phrases come first."""
    rules: list[tuple[str, str, str, int, float, bool]] = [
        (label, words, words, 2, 0.8, True) for label, words in BASE]
    for label, keyword, names, versions, spdx in FAMILIES:
        for name in names:
            for v in versions:
                versioned = f"(?:the )?{name}(?: license)?(?: version| v| ver)? {v}"
                rules.append((f"{label}-{v.replace(' ', '.')}", keyword, versioned, 3, 0.9, False))
            rules.append((label, keyword, f"(?:licensed|released|distributed|available|published|provided) under "
                          f"(?:the terms of )?(?:the |an |a )?{name}(?: license)?", 2, 0.95, False))
            rules.append((label, keyword, name, 1, 0.7, False))
        if spdx:
            ends = [v.replace(" clause", "") for v in versions] or [""]
            for v in ends:
                rules.append((f"{label}-{v.replace(' ', '.')}".rstrip("-"), "spdx",
                              f"spdx license identifier {spdx} {v}".rstrip() + "(?: only| or later)?", 4, 1.0, False))
    rules += [(*s, False) for s in SENTENCES]
    return [{"rule": i, "label": r[0], "keyword": r[1], "regex": f"(?<= ){r[2]}(?= )", "priority": r[3],
             "confidence": r[4], "base": r[5]} for i, r in enumerate(rules)]


def _keyword_groups(rules: list[dict]) -> Column:
    """The rules by keyword, as one literal."""
    groups: dict[str, list[dict]] = {}
    for r in rules:
        groups.setdefault(r["keyword"], []).append({k: v for k, v in r.items() if k != "keyword"})
    kind = ("array<struct<keyword: string, rules: array<struct<rule: int, label: string, regex: string, "
            "priority: int, confidence: double, base: boolean>>>>")
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])), kind)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def license_detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every detection, suppressed or not, and one row without a rule for each
    row of ``df``: ``(uid, id, n_words, rule, label, priority, confidence, base,
    first, last, suppressed)``; words ``first`` to ``last - 1``.  ``uid``
    numbers the rows of ``df`` (ids may repeat)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    gate = F.lit(False)
    for root in ROOTS:
        words = root.split()
        holds = reduce(and_, [F.contains(low, F.lit(w)) for w in words])
        gate = gate | (holds & low.rlike(SEPARATORS.join(words)) if len(words) > 1 else holds)
    ascii_low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    line = F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_low, SEPARATORS, " ")), F.lit(" ")))
    rows = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_words"), line.alias("line"))
    groups = _keyword_groups(signature_rules())
    wanted = F.flatten(F.transform(
        F.filter(groups, lambda g: F.contains(F.col("line"), g["keyword"])), lambda g: g["rules"]))
    rule = F.explode_outer(F.when(F.col("line").isNotNull(), F.concat(F.array(F.lit(None)), wanted)))
    rows = rows.select("uid", "id", "n_words", "line", rule.alias("r"))
    gaps = F.transform(F.split("line", F.col("r.regex"), -1), _blanks)
    hits = F.transform(F.regexp_extract_all("line", F.col("r.regex"), F.lit(0)), _blanks)
    found = F.when(F.col("r").isNotNull(), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))
    rows = rows.select("uid", "id", "n_words", "r", F.posexplode_outer(found).alias("i", "d"))
    # the last gap has no hit; a row without a rule stands for the text itself
    rows = rows.where("r is null or d.hit is not null").select(
        "uid", "id", "n_words", "r.*", "i", F.col("d.gap").alias("gap"), F.col("d.hit").alias("hit"))
    rows = rows.repartition("uid")
    before = Window.partitionBy("uid", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.col("gap") + F.col("hit")).over(before))
    first = (F.col("upto") - F.col("hit") - F.lit(1)).cast("long")
    rows = rows.withColumn("first", first).withColumn("last", F.col("first") + F.col("hit") + F.lit(1))
    outer = Window.partitionBy("uid").orderBy("first", F.desc("last"), F.desc("priority"), "rule") \
        .rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r["priority"] for r in signature_rules()})
    reach = F.lit(None).cast("long")
    for p in levels:
        over = F.max(F.when(F.col("priority") >= F.lit(p), F.col("last"))).over(outer)
        reach = F.when(F.col("priority") == F.lit(p), over).otherwise(reach)
    return rows.withColumn("suppressed", F.coalesce(reach >= F.col("last"), F.lit(False))).select(
        "uid", "id", "n_words", "rule", "label", "priority", "confidence", "base", "first", "last", "suppressed")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``(id, n_words, n_base, first_word, last_word,
    base_labels, labels, score)``.

    The base phrases count at every place, suppressed or not; ``labels`` adds
    what the other rules found and was not suppressed; ``score`` is the highest
    confidence among what remains (0: nothing found).  Null and empty texts
    have no words and no labels.  A text of any length is read whole; only its
    detections are shuffled, never the text.  Extra columns are not read.
    """
    found = license_detections(df, id_col, text_col)
    kept = ~F.col("suppressed") | F.col("base")
    join = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return found.groupBy("uid").agg(
        F.first("id").alias(id_col), F.first("n_words").alias("n_words"),
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        join(F.col("base")).alias("base_labels"), join(kept).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("score")).drop("uid")
