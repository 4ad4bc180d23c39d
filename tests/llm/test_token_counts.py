import json
import random

import numpy as np
import pytest
from tests.llm.data import awkward, empty

from rivulet.llm import token_counts as C

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
ALPHABET = ["a", "the", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "1", "٣", "½", "<|endoftext|>", "<|endo", "!", "中文", "\U0001f600", "́", "-", "\r\n", " word", " next", "'r", "'ve"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(PATH))


@pytest.fixture(scope="module")
def machine():
    return C.Transducer(str(PATH))


def counted(machine, texts):
    raw = [t.encode() for t in texts]
    return machine.count(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).tolist()


def wanted(library, texts):
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def random_texts(n, most):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts_equal_the_library(spark, library):
    texts = random_texts(200, 300) + [r.text for r in awkward(spark).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = C.token_counts(docs, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == wanted(library, [t or "" for t in texts])
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]


def test_clashing_columns_and_empty_tables(spark):
    docs = awkward(spark).withColumnRenamed("size", "N_Bytes")
    out = C.token_counts(docs, PATH)
    assert out.columns == [c for c in docs.columns if c not in ("text", "n_tokens", "N_Bytes")] + ["n_bytes", "n_tokens"]
    assert out.count() == 13 and {r.n_tokens for r in out.filter("n_chars = 0").collect()} == {0}
    assert C.token_counts(empty(spark), PATH).count() == 0


def test_every_character(machine, library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}9'{chr(c)}" for c in range(1, 0x3000)]
    assert counted(machine, texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_by_chunk_maps(machine, library):
    rng = random.Random(2)
    texts = ["x" * 9001, "ab" * 7000, "".join(rng.choice("aeinrst") for _ in range(20_000)), " " * 5000 + "y", "=" * 3000 + "-" * 4000, "日本" * 3000]
    assert counted(machine, texts) == wanted(library, texts)


def test_maps_compose_to_the_whole(machine):
    data = np.frombuffer(("ab" * 3000).encode(), np.uint8)
    inside, cuts = np.ones(len(data), np.uint8), np.arange(0, len(data), 500)
    maps = machine.chunk_maps(data, inside, cuts, np.full(len(cuts), 500))
    assert all(end in after for now, after in zip(maps, maps[1:], strict=False) for end, _ in now.values())
    end, tokens = machine.walk(data, inside, np.array([0]), np.array([len(data)]), np.array([0]))
    assert machine.compose(maps)[0] == (end[0], tokens[0])


def test_long_texts_in_windows(machine, library, monkeypatch):
    monkeypatch.setattr(C, "WINDOW", 50)
    for text in [*random_texts(40, 200), "x" * 400, "one two " * 60]:
        data = np.frombuffer(text.encode(), np.uint8)
        parts = list(machine.windows(data))
        assert b"".join(p.tobytes() for p in parts) == text.encode()
        assert sum(int(machine.count(p, np.array([0, len(p)]))[0]) for p in parts) == wanted(library, [text])[0]


def test_states_are_forgotten_without_harm(machine, library, monkeypatch):
    monkeypatch.setattr(C, "KEPT_STATES", 50)
    for text in random_texts(30, 100):
        assert counted(machine, [text]) == wanted(library, [text])


def test_other_settings_raise():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            C.checked_merges(spec | change)
    with pytest.raises(ValueError):
        C.checked_merges(spec | {"model": spec["model"] | {"merges": [["ab", "c"], ["a", "b"]]}})
