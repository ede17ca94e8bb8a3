import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

CLASHING = ("n_words", "kept", "id", "hash", "row", "component_id", "_spaced", "score", "copy", "ids", "_mix_copies", "_mix_key", "_mix_name", "_mix_rows")


def odd_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    base = [word() for _ in range(150)]
    near = list(base)
    near[60] = "changed"
    chain = list(near)
    chain[110] = "again"
    return [
        None, "", " \t\n ", "one two three", "One two THREE", " ".join(base), " ".join(base), " ".join(near), " ".join(chain),
        "a" * 500, "ab" * 300 + "é" * 120, "\n".join(["Same line of words here."] * 40), "x " * 30000, " ".join(word() for _ in range(40000)),
        "Licensed under the Apache License. MIT License mit license\n\n" + "Permission is hereby granted, free of charge, to any person obtaining "
        "a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "cc by cc by, CC-BY 4.0 gnu GENERAL public license", "日本語 のテキスト — “quoted” Ünïcode.", "mail a@b.org, 10.0.0.1 and 4111 1111 1111 1111",
        "\n\n\n", "<|endoftext|> it's", "word\r\nword\r\nword", "!" * 50, "one", "one",
    ]


def write(folder, texts, ids=None, extra=True):
    n = len(texts)
    columns = {
        "doc_id": pa.array(ids or range(n), pa.int64()), "text": pa.array(texts, pa.string()),
        "lang": pa.array([None if k % 5 == 0 else "en" for k in range(n)], pa.string()),
        "source": pa.array([None if k % 7 == 0 else f"src{k % 3}" for k in range(n)], pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    }
    if extra:
        columns |= {c: pa.array(["x"] * n, pa.string()) for c in CLASHING}
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    pq.write_table(
        pa.table({"doc_id": pa.array([*range(n), None], pa.int64()), "quality": pa.array([1] * (n + 1), pa.int64()), "toxic": pa.array([*([0, 1, None] * n)[:n], 1], pa.int64())}),
        folder / "labels.parquet",
    )
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Tables of odd texts: null, empty, blank, tied, repeated, very long; with clashing extra columns."""
    return write(tmp_path_factory.mktemp("odd"), odd_texts())


@pytest.fixture(scope="session")
def repeated(tmp_path_factory):
    """The same rows twice, and rows without doc_id."""
    texts = odd_texts()
    return write(tmp_path_factory.mktemp("repeated"), texts * 2 + texts, [*range(len(texts))] * 2 + [None] * len(texts))


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])
