import hashlib
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from clubspark.llm import exact_dedup, repeats, simhash
from clubspark.llm.common import table
from clubspark.llm.components import components
from tests.llm.conftest import plain, texts_of

ROOT = Path(__file__).resolve().parents[2]


def roots_of(pairs):
    """Plain union-find."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, top, k in [(0, 10, 3), (1, 1, 0), (500, 1 << 40, 30), (300, 1000, 2), (300, 400, 0)]:
        values = np.sort(rng.choice(np.unique(rng.integers(0, top, n * 3)), n, replace=False)) if n else np.zeros(0, int)
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, k), len(values), k) == values).all()


def exact_expected(df):
    groups = {}
    for r in texts_of(df):
        groups.setdefault(r.text, []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_duplicates(odd, spark, sf):
    columns = "doc_id keep_id group_size kept text_sha256".split()
    assert plain(exact_dedup.exact_duplicates(odd), *columns) == exact_expected(odd)
    docs = table(spark, sf, "documents")
    assert plain(exact_dedup.exact_duplicates(docs), *columns) == exact_expected(docs)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_with_few_bits_and_shuffled_suspects(odd, monkeypatch):
    """Colliding fingerprints make suspects, not duplicates; without a broadcast the rows are the same."""
    from clubspark.llm import common

    monkeypatch.setattr(exact_dedup, "fingerprint_bits", lambda n: (3, 2))
    monkeypatch.setattr(exact_dedup, "small", lambda df: common.small(df, 0))
    columns = "doc_id keep_id group_size kept text_sha256".split()
    assert plain(exact_dedup.exact_duplicates(odd), *columns) == exact_expected(odd)


def test_deduplicate_leaves_one_row_of_each_text(odd):
    left = exact_dedup.deduplicate(odd)
    assert left.columns == odd.columns
    found = Counter(r["text"] or "" for r in left.select("text").collect())
    assert set(found.values()) == {1} and set(found) == {r.text for r in texts_of(odd)}
    assert {r["doc_id"] for r in left.where("text = 'same text twice'").collect()} == {41}


def slow_print(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def simhash_expected(df):
    rows = [(r.doc_id, slow_print(r.text)) for r in texts_of(df)]
    fps = sorted({fp for _, fp in rows})
    links = [(a, b) for i, a in enumerate(fps) for b in fps[: i + 1] if (a ^ b).bit_count() <= 3]
    root = roots_of(links)
    low = {}
    for i, fp in rows:
        if i is not None:
            low[root[fp]] = min(i, low.get(root[fp], i))
    return sorted(((i, f"{fp:016x}", low.get(root[fp])) for i, fp in rows), key=repr)


def test_near_duplicates(odd, spark, sf):
    columns = "doc_id fingerprint component_id".split()
    assert plain(simhash.near_duplicates(odd), *columns) == simhash_expected(odd)
    docs = table(spark, sf, "documents")
    assert plain(simhash.near_duplicates(docs), *columns) == simhash_expected(docs)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_links_lose_none_in_large_variants(spark, block):
    """Balls around few centres, so that variants are large and go through all levels."""
    rng = random.Random(block)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        for _ in range(60):  # all in one half: many share a variant
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(32), rng.randint(0, 5))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block).collect()
    found = roots_of([(r.u, r.v) for r in edges] + [(f, f) for f in signed])
    pairs = [(a, b) for a in signed for b in signed if a <= b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert found == roots_of(pairs)


def test_one_of_each_keeps_the_smallest_id(odd):
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    expected = sorted({c for _, _, c in simhash_expected(odd)}, key=repr)
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == expected


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    rest = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    pairs = chain + star + rest
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (5, None), (None, 7), (9000, 9000)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: r for x, r in roots_of(pairs).items() if any(x in p for p in pairs if p[0] != p[1])}
    assert components(df.limit(0)).count() == 0


def repeats_expected(rows, length):
    seen, out = set(), []
    for place, (doc_id, text) in enumerate(rows):
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        starts = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(text), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ordered(df):
    rows = [(r.doc_id, r.text.encode()) for r in texts_of(df)]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


_REPEATS = "doc_id n_bytes n_removed n_spans kept_sha256".split()


@pytest.mark.parametrize("block", [1, 256])
def test_repeated_passages(odd, spark, sf, block):
    docs = table(spark, sf, "documents")
    got = repeats.remove_repeats(docs, digest=True, block=block)
    assert plain(got, *_REPEATS) == repeats_expected(ordered(docs), 100)
    short = odd.where("doc_id IS NULL OR doc_id <> 50")
    assert plain(repeats.remove_repeats(short, 40, True, block), *_REPEATS) == repeats_expected(ordered(short), 40)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length,block", [(100, 256), (100, 2), (60, 256)])
def test_repeats_of_stitched_texts(spark, length, block):
    rng = random.Random(length + block)
    base = ["".join(rng.choice(["ab", "c ", "é", "long piece of text", "\n"]) for _ in range(rng.randint(10, 150))) for _ in range(12)]
    rows = [(1000, "a" * 3000), (1001, "ab" * 300), (1002, "x" * length), (1003, "x" * length)]
    for i in range(150):
        parts = [rng.choice(base)[rng.randint(0, 40) :][: rng.randint(20, 300)] + rng.choice(["", "q", "zz"]) for _ in range(4)]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert plain(repeats.remove_repeats(df, length, True, block), *_REPEATS) == repeats_expected(ordered(df), length)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 257)
    bodies = [bytes(random.Random(1).randrange(97, 100) for _ in range(3000))] * 2
    found = repeats.runs(bodies, 100)
    start, stop = repeats._span(found["at"], 100)
    for text in (0, 1):  # every window is in exactly one run
        mine = found["text"] == text
        windows = np.concatenate([np.arange(a, b - 99) for a, b in zip(start[mine], stop[mine], strict=True)])
        assert sorted(windows.tolist()) == list(range(2901))


def test_workers_need_no_installed_package(tmp_path):
    """A plain frame, workers that start in another folder: the operator sends its code along."""
    script = tmp_path / "away.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from clubspark.session import local_session\n"
        "from clubspark.llm.exact_dedup import exact_duplicates\n"
        "spark = local_session(2, shuffle_partitions=2, memory='2g')\n"
        "docs = spark.createDataFrame([(1, 'a b'), (2, 'a b'), (3, None)], 'doc_id long, text string')\n"
        "print(sorted((r.doc_id, r.keep_id, r.kept) for r in exact_duplicates(docs).collect()))\n"
    )
    away = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=away, capture_output=True, text=True, timeout=300)
    assert "[(1, 2, False), (2, 2, True), (3, 3, True)]" in done.stdout, done.stderr[-2000:]
