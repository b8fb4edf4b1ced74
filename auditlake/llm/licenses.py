"""License scans with a positional rare-token index.

The index maps each word of the license templates to the places where it stands. A template whose mandatory phrases
stand in a document is looked up by its own words, the rarest (by inverse document frequency in this corpus) first; each
posting gives an offset, and an alignment counts if enough of the template's rarity agrees and its mandatory phrases are
there. The lookups of a template end when an alignment that holds only the words not yet looked up could neither give
its label nor the best agreement, so the result is that of trying every offset.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import plain_words

# Phrases that count wherever they stand, with the label of each.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Sentences by which licenses are granted, with phrases that must all occur in the aligned words.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license", "redistribute"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "copyright all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized copying"]),
]
AGREE = 0.75
ROUNDING = 1e-9


class TemplateIndex:
    """Word -> (template, position); idf gives the weight of a word, words of no document the highest."""

    def __init__(self, idf: dict[bytes, float]):
        self.words = [t.encode().split() for _, t, _ in TEMPLATES]
        self.top = max(idf.values(), default=1.0)
        self.weight = {w: idf.get(w, self.top) for ws in self.words for w in ws}
        self.total = [sum(self.weight[w] for w in ws) for ws in self.words]
        self.postings: list[list[tuple[bytes, list[int]]]] = []  # of each template: its words and their positions, rarest first
        for ws in self.words:
            at: dict[bytes, list[int]] = defaultdict(list)
            for p, w in enumerate(ws):
                at[w].append(p)
            self.postings.append(sorted(at.items(), key=lambda x: (-self.weight[x[0]], x[0])))
        self.needed = [[p.encode() for p in phrases] for _, _, phrases in TEMPLATES]
        self.needed_words = [{w for p in phrases for w in p.split()} for phrases in self.needed]

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of templates that align with the words, and the best agreement, as if every offset were tried."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.weight:
                places[w].append(i)
        labels, best, joined = set(), 0.0, b""
        for t, own in enumerate(self.words):
            if not self.needed_words[t] <= places.keys():
                continue
            joined = joined or b" " + b" ".join(words) + b" "
            if not all(b" " + n + b" " in joined for n in self.needed[t]):
                continue
            left, tried = self.total[t], set()
            for w, positions in self.postings[t]:
                if left / self.total[t] < min(AGREE, best) - ROUNDING:
                    break
                left -= self.weight[w] * len(positions)
                offsets = {i - p for i in places.get(w, ()) for p in positions} - tried
                tried |= offsets
                for offset in offsets:
                    same = sum(self.weight[w] for p, w in enumerate(own) if 0 <= p + offset < len(words) and words[p + offset] == w)
                    agree = same / self.total[t]
                    if agree <= best and agree < AGREE:
                        continue
                    near = b" " + b" ".join(words[max(0, offset - 2) : offset + len(own) + 2]) + b" "
                    if all(b" " + n + b" " in near for n in self.needed[t]):
                        best = max(best, agree)
                        if agree >= AGREE:
                            labels.add(TEMPLATES[t][0])
        return labels, best


VOCABULARY = {w.encode() for _, t, _ in TEMPLATES for w in t.split()}


def idf_table(docs: DataFrame, text: str = "text") -> dict[bytes, float]:
    """Inverse document frequencies of the templates' words over all of docs (a table of as many rows as they have words)."""

    def count(batches):
        for rows in batches:
            seen: dict[bytes, int] = defaultdict(int)
            for t in rows["t"]:
                for w in VOCABULARY.intersection(plain_words(t)):
                    seen[w] += 1
            yield pd.DataFrame({"w": [w.decode() for w in seen] + [""], "n": [*seen.values(), len(rows)]})

    got = docs.select(F.col(text).alias("t")).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r["w"].encode(): r["n"] for r in got}
    all_docs = counts.pop(b"", 0)
    return {w: math.log((1 + all_docs) / n) for w, n in counts.items()}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other."""
    out, joined = [], None
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        if joined is None:
            joined = b" " + b" ".join(words) + b" "
        if b" " + phrase.encode() + b" " not in joined:
            continue
        n = len(parts)
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == parts:
                out.append((at, label))
    return sorted(out)


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("base", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])


def license_scan(docs: DataFrame, text: str = "text", into: str = "_found") -> DataFrame:
    """docs with a struct `into`: n_words, places (starts of base phrases), base and all labels (sorted), score (0 to 1).

    The score is the best share of a template's rarity that aligns, 1 where a base phrase stands. Null and empty texts
    have no words, no labels and score 0. Repeated rows get equal results; other columns stay, one
    named `into` is replaced. An empty corpus has no
    document frequencies; the result is empty. The index is made of fixed templates and is broadcast.
    """
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(idf_table(docs, text)))

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = plain_words(t)
            base = base_places(words)
            labels, score = index.value.scan(words) if words else (set(), 0.0)
            own = sorted({x for _, x in base})
            out.append((len(words), np.array([p for p, _ in base], np.int64), own, sorted(labels.union(own)), 1.0 if base else min(1.0, score)))
        return pd.DataFrame(out, columns=FOUND.names)

    return docs.withColumn(into, scan(F.col(text)))
