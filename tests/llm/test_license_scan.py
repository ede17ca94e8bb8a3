"""License blocks: published notices, clean texts, and the filters of the join."""

import random

import pytest
from pyspark.sql import functions as F

from barline.llm import license_scan as L

BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice."""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to do so."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
GARDEN = ("This garden is a work of many years and it is under the care of a society. Visitors need a license to take creative pictures, "
          "and the attribution of each plant is on a sign. An international club of gardeners helps. Nothing here is licensed to shops, "
          "and no commons or park lies near. The work is hard in spring. ")
FILLER = "some words that say nothing of the kind and go on for a while until they end "


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return {r.doc_id: (r.labels, round(r.score, 3)) for r in L.scan(df).collect()}


def test_published_notices_are_found_wherever_they_stand(spark):
    notices = {"bsd": BSD, "apache": APACHE, "mit": MIT, "gpl": GPL}
    texts = [t for n in notices.values() for t in (n, FILLER * 40 + n + " " + FILLER * 40, " ".join(n.split()), FILLER * 7 + n)]
    got = labels(spark, texts + [GARDEN, GARDEN * 30, FILLER * 200, MIT[:120], None, ""])
    for k, label in enumerate(notices):
        assert all(label in got[4 * k + j][0].split(",") and got[4 * k + j][1] >= 0.8 for j in range(4))
    assert all(got[len(texts) + j] == ("", 0.0) for j in range(6))


@pytest.mark.parametrize("seed", [1, 2])
def test_filters_drop_blocks_but_none_that_holds_enough(spark, seed):
    rng = random.Random(seed)
    order = sorted({w for _, words, _ in L._template_words() for w in words}, key=lambda w: rng.random())
    label, held, _ = L._template_words()[rng.randrange(3)]
    words = [w for w in order if w in held]
    needed = -(-len(words) * L.THRESHOLD // 100)
    blocks = []
    for _ in range(1500):
        mine = rng.sample(words, rng.randint(0, len(words)))
        others = rng.sample(order, rng.randint(0, 60))
        blocks.append([w for w in order if w in {*mine, *others}])
    frame = spark.createDataFrame([(b,) for b in blocks], "block array<string>")
    kept = [r[0] for r in frame.select(L.passes(F.col("block"), words, needed)).collect()]
    enough = [len(set(b) & set(words)) >= needed for b in blocks]
    assert all(k for k, e in zip(kept, enough) if e) and sum(enough) > 50
    drop = {"length": 0, "prefix": 0, "position": 0}
    for b, k in zip(blocks, kept):
        prefix = [w for w in b[: max(0, len(b) - needed + 1)] if w in words[: len(words) - needed + 1]]
        if len(b) < needed:
            drop["length"] += 1
            assert not k
        elif not prefix:
            drop["prefix"] += 1
            assert not k
        elif 1 + min(len(words) - 1 - words.index(prefix[0]), len(b) - 1 - b.index(prefix[0])) < needed:
            drop["position"] += 1
            assert not k
        else:
            assert k
    assert drop["length"] and drop["prefix"], drop


def test_position_filter_by_hand(spark):
    words = list("abcdefghij")  # eight needed: prefixes of three
    blocks = [list("cdefghij"), list("cdefghijxyz"), list("acdefghi"), ["w", "x", "y", *"cdefghij"], ["c", *"pqrstuv"], list("bdefghij")]
    frame = spark.createDataFrame([(b,) for b in blocks], "block array<string>")
    assert [r[0] for r in frame.select(L.passes(F.col("block"), words, 8)).collect()] == [True, True, True, True, True, True]
    late = spark.createDataFrame([(["w", "x", "c", *"defghi"],), (["x", "a", "b", *"cdefgh"],), (["w", "a", *"qrstuv"],)], "block array<string>")
    assert [r[0] for r in late.select(L.passes(F.col("block"), words, 8)).collect()] == [False, True, False]
