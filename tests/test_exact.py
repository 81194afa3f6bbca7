import random

import pytest
from pyspark.sql import functions as F

from helpers import values
from packloom import ScanConfig
from packloom.operators import exact, joins
from packloom.plans.packing import Run

WORDS = r"\p{L}+| ?[^\s\p{L}]+|\s+(?!\S)|\s+"


def brute(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(5))
def test_merges_equal_brute_force(seed):
    rng = random.Random(seed)
    tokens = {bytes([c]) for c in b"abcd"}
    while len(tokens) < 40:
        tokens.add(rng.choice(sorted(tokens)) + rng.choice(sorted(tokens)))
    ranks = {t: i for i, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
    for _ in range(400):
        piece = bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 30)))
        # A piece that is a token as a whole is one, however its bytes would merge.
        assert exact.count_merged(piece, ranks) == (1 if piece in ranks else brute(piece, ranks))


def test_long_pieces_stay_cheap():
    assert exact.count_merged(b"ab" * 100_000, {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3}) == 50_000


def test_rank_files(tmp_path, monkeypatch):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYWI= 7\n\n")
    assert exact.read_ranks(str(path)) == {b"a": 0, b"ab": 7}
    monkeypatch.setattr(exact, "RANK_BYTES", 5)
    with pytest.raises(ValueError):
        exact.read_ranks(str(path))


def test_counts_of_files_equal_the_library(spark, entries):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = exact.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts = {f"d/{i}": t for i, t in docs.items()} | {
        "odd": "a b  c\x1cd\x85e  \n\n 漢字 \U0001f600 it's 12345 <|endoftext|>", "empty": "", "long": "x" * 3000 + " " * 50 + "\n" * 9}
    got = {r.rel_path: r.content_tokens for r in exact.exact_tokens(entries(texts).coalesce(2), ranks, public.PATTERN).collect()}
    assert got == {p: len(library.encode_ordinary(t)) for p, t in texts.items()}


def test_pieces_that_are_too_many_to_broadcast(spark, entries, monkeypatch):
    ranks = {b"a": 0, b"b": 1, b"aa": 2}
    files = entries({f"f{i}": "aa " * 20 + f"b{'a' * i} c" for i in range(30)}).coalesce(2)
    expected = values(exact.exact_tokens(files, ranks, WORDS), "rel_path", "content_tokens")
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (2, 0))
    assert values(exact.exact_tokens(files, ranks, WORDS), "rel_path", "content_tokens") == expected
    assert len(expected) == 30


def test_null_contents_and_survivors(spark, entries):
    files = entries({"a.txt": "aa a", "b.md": "a", "d/": None})
    run = Run(files, ScanConfig(include="*.txt"))
    ranks = {b"a": 0, b"aa": 1}
    assert values(exact.exact_tokens(run.survivors, ranks, WORDS), "rel_path", "content_tokens") == {("a.txt", 3)}
    nothing = files.withColumn("content", F.lit(None).cast("string"))
    assert values(exact.exact_tokens(nothing, ranks, WORDS), "content_tokens") == {0}


def test_pieces_pass_no_shuffle(spark, entries):
    ranks = {b"a": 0, b"b": 1, b"aa": 2}
    frame = exact.exact_tokens(entries({f"f{i}": f"aa b{'a' * i}" for i in range(30)}).coalesce(2), ranks, WORDS)
    assert "Exchange" not in frame._jdf.queryExecution().toString()
    expected = {(f"f{i}", 2 + brute(b"b" + b"a" * i, ranks)) for i in range(30)}
    assert values(frame, "rel_path", "content_tokens") == expected


def test_what_a_task_remembers_changes_no_count(monkeypatch):
    import pyarrow as pa

    ranks = {b"a": 0, b"b": 1, b"aa": 2}
    lists = [[["aa", "b", "aa"], None], [[], ["baa"] * 3, ["a" * 100]], [["b", "aaa"], ["a" * 100, "aa"]]]
    expected = [[sum(brute(p.encode(), ranks) for p in pieces or []) for pieces in batch] for batch in lists]
    for bounds in ((500_000, 64), (1, 64), (500_000, 2)):
        monkeypatch.setattr(exact, "REMEMBERED", bounds[0])
        monkeypatch.setattr(exact, "REMEMBERED_PIECE", bounds[1])
        counts = exact.PieceCounts(ranks)
        assert [counts.of_lists(pa.array(batch, pa.list_(pa.string()))).tolist() for batch in lists] == expected
