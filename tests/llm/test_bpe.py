"""Tree encoding: against merges by definition on random vocabularies, against the library on texts, and back to bytes."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspool.llm import bpe, op11


def by_definition(ranks, data):
    parts = [bytes([b]) for b in data]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return tuple(ranks[p] for p in parts)
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@st.composite
def vocabularies(draw):
    """Merges of random known tokens over few letters, in random order of rank, so that merges cross seams often."""
    letters = [bytes([c]) for c in b"abc"]
    tokens = list(letters)
    for _ in range(draw(st.integers(0, 25))):
        t = draw(st.sampled_from(tokens)) + draw(st.sampled_from(tokens))
        if t not in tokens and len(t) < 12:
            tokens.append(t)
    order = draw(st.permutations(tokens))
    return {t: i for i, t in enumerate([*[bytes([b]) for b in range(256) if bytes([b]) not in letters], *order])}


@settings(max_examples=400, deadline=None)
@given(vocabularies(), st.lists(st.text("abc", max_size=40), min_size=1, max_size=4))
def test_joins_give_the_encoding_of_the_whole(ranks, texts):
    tree = bpe.Tree(ranks)
    parts = [t.encode() for t in texts]
    whole = b"".join(parts)
    want = by_definition(ranks, whole)
    assert tree.encode(whole) == tree.merged(whole) == tree._merged_long(whole) == want
    left = right = ()
    for p in parts:
        left = tree.join(left, tree.encode(p))
    for p in parts[::-1]:
        right = tree.join(tree.encode(p), right)
    assert left == right == want
    assert b"".join(tree.token[i] for i in want) == whole


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def odd_texts():
    rng = random.Random(11)
    out = [None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "<|endoftext|>", "　 \x1c \x1d a \x85 b", "x\x1c y", "don't we'll 's", "日本語 テキスト 😀😀", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 777 + "x", "=-" * 900]
    out += ["".join(rng.choice("aaab") for _ in range(rng.randrange(300))) for _ in range(50)]
    out += ["".join(rng.choice("ab \n\t'sé日😀0") for _ in range(rng.randrange(400))) for _ in range(100)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(100)]
    out.append(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 12))) for _ in range(60_000)))
    return out


def test_query_equals_the_library(spark, library, tmp_path):
    _, _, reference = library
    rows = [(i if i % 7 else None, t, "z", "z", 1) for i, t in enumerate(odd_texts())] * 2
    rows += [(100_000 + r.doc_id, r.text, "z", "z", 1) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, id string, decoded int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11.op11_bpe_tree(spark, str(tmp_path)).collect()

    def digest(i, text):
        ids = reference.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(digest(r[0], r[1])) for r in rows)


def test_cuts_change_nothing(library):
    path, pattern, _ = library
    texts = [t or "" for t in odd_texts()]
    found = [bpe.TreeEncoder(path, pattern, cut).encode(texts) for cut in (True, False)]
    assert all((a == b).all() for a, b in zip(*found))


def test_pieces_are_forgotten(library, monkeypatch):
    path, pattern, reference = library
    from larkspool.llm import tokens

    monkeypatch.setattr(tokens, "PIECES", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.TreeEncoder(path, pattern, True)
    for t in odd_texts()[:40]:
        assert encoder.encode([t or ""])[0].tolist() == reference.encode_ordinary(t or "")


def test_odd_ids(spark, library, none_docs):
    path, pattern, _ = library
    assert bpe.decode(bpe.encode(none_docs, path, pattern), path).count() == 0
    df = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert {r.id: bytes(r.decoded) for r in bpe.decode(df, path).collect()} == {1: b"", 2: b""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "id long, ids array<int>"), path).collect()


@pytest.fixture
def none_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_incomplete_vocabulary(tmp_path):
    (tmp_path / "v").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="lacks 255"):
        bpe.read_ranks(str(tmp_path / "v"))
