import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clubspark.llm import bpe, mixing, simhash, toxicity, urls
from clubspark.llm.common import table
from clubspark.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import plain, texts_of
from tests.llm.test_dedup import simhash_expected


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_reference(name, spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert plain(df, *columns) == theirs


def poisson(u, mean):
    p = total = math.exp(-mean)
    k = 0
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def test_mix_draws_and_weights(odd, spark):
    weights = spark.createDataFrame([("src0", 3.0), ("src1", 1.0)], "source string, weight double")
    mixed = mixing.mix(odd, weights, epochs=4.0)
    assert mixed.columns == odd.columns
    rates = {r.source: r.rate for r in mixing.rates(odd, weights, 0.5, 4.0).collect()}
    assert rates[None] == 0.0
    counted = Counter(r["doc_id"] for r in mixed.collect())
    expected = Counter()
    for r in odd.collect():
        key = f"{mixing.SEED}:{'' if r['doc_id'] is None else r['doc_id']}:1"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        expected[r["doc_id"]] += poisson(u, rates[r["source"]]) if rates[r["source"]] < mixing.PART else 0
    assert counted == expected
    assert mixing.mix(odd.limit(0)).count() == 0


def test_number_of_the_copy_takes_the_place_of_a_column_of_that_name(odd):
    mixed = mixing.mix(odd, copy="copy_number")
    assert sorted(mixed.columns) == sorted(odd.columns)
    rows = mixed.select("doc_id", "copy_number").where("doc_id < 20").collect()
    most = Counter(r["doc_id"] for r in rows)
    assert {(r["doc_id"], r["copy_number"]) for r in rows} == {(i, k) for i, n in most.items() for k in range(1, n + 1)}


def test_mix_follows_large_and_small_rates(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'aaaa' AS text", "IF(id < 2, 'tiny', 'huge') AS source")
    weights = spark.createDataFrame([("tiny", 1.0), ("huge", 1.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.mix(rows, weights).groupBy("source").count().collect()}
    assert abs(got["tiny"] - 2000) < 200 and abs(got["huge"] - 2000) < 200  # a rate of 1000 is drawn in parts


def test_mix_is_native(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


PAGES = [
    (1, "https://a.example.org/en/1?utm_source=x#top", None),
    (2, "http://a.example.org/en/1/", '<link rel="canonical" href="https://evil.net/x">'),
    (3, "https://b.example.org/de/2", '<meta http-equiv="refresh" content="0; url=https://c.example.org/fr/9">'),
    (4, "https://c.example.org/fr/9", "<link href='https://other.net/' rel='canonical'>"),
    (5, "https://example.net/en/3", None),
    (6, "HTTPS://Sub.EXAMPLE.net/de/3", None),
    (7, "https://notexample.net.org/x", None),
    (8, None, "<link rel=canonical href=https://evil.net/x>"),
    (9, "no scheme", None),
    (10, "https://example.com/de/x", None),
    (11, "https://example.com?x=/de/", None),
    (11, "https://example.com?x=/de/", None),
    (12, "https://d.example.org/en/7", None),
    (13, "", ""),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "url AS host", "html AS root", "1 AS own")
    moves = spark.createDataFrame([("https://d.example.org/en/7", "https://example.com/de/y"), (None, "x"), ("y", None)], "source string, target string")
    got = {r.page_id: r for r in urls.judge(pages, moves).collect()}
    verdicts = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert verdicts[1] == verdicts[2] == (None, "block")  # aliases of a blocked address
    assert verdicts[3] == (None, "allow") and verdicts[4] == ("org/fr/", "allow")  # the class holds an explicit allow
    assert verdicts[5] == ("example.net/en/", "allow") and verdicts[6] == ("net/", "block") and got[6].host == "sub.example.net"
    assert verdicts[7] == verdicts[8] == verdicts[9] == verdicts[13] == (None, "allow")
    assert verdicts[10] == ("example.com/de/", "block") and verdicts[11] == (None, "allow") and got[11].path == ""
    assert verdicts[12] == (None, "block")  # by a redirect
    assert (got[8].host, got[8].path, got[8].root) == ("", "", None)
    assert urls.judge(pages, moves).count() == len(PAGES) and urls.judge(pages.limit(0)).count() == 0


def test_relative_declarations_make_aliases(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="{}">'
    base = "https://example.com/a/b/page.html?q=1#top"
    cases = [
        (link, "/de/x", "https://example.com/de/x", "block"),
        (refresh, "0; url=/de/x", "https://example.com/de/x", "block"),
        (refresh, "5;URL=../../de/y?z=2", "https://example.com/de/y?z=2", "block"),
        (link, "//sub.example.com/de/z", "https://sub.example.com/de/z", "block"),
        (link, "./x/../../../../de/w", "https://example.com/de/w", "block"),
        (link, "other", "https://example.com/a/b/other", "allow"),
        (link, "?q=2", "https://example.com/a/b/page.html?q=2", "allow"),
        (link, "#part", "https://example.com/a/b/page.html?q=1#part", "allow"),
        ('<meta property="og:url" content="{}">', "/de/v", "https://example.com/de/v", "block"),
        (refresh, "5", None, "allow"),
        (link, "mailto:de@example.com", None, "allow"),
    ]
    rows = [(i, base.replace("page", f"page{i}"), tag.format(value)) for i, (tag, value, _, _) in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = pages.select("page_id", F.explode(urls.declared(F.col("html"))).alias("target"), "url")
    got = {r.page_id: r.whole for r in found.select("page_id", urls.resolve(F.col("url"), F.col("target")).alias("whole")).collect()}
    for i, (_, _, whole, _) in enumerate(cases):
        assert got.get(i) == (whole and whole.replace("page.", f"page{i}.")), cases[i]
    assert {r.page_id: r.verdict for r in urls.judge(pages).collect()} == {i: c[3] for i, c in enumerate(cases)}
    bare = spark.createDataFrame([("https://example.com", "de/x")], "url string, target string")
    assert bare.select(urls.resolve(F.col("url"), F.col("target"))).first()[0] == "https://example.com/de/x"


def test_host_and_path_of_all_pages(spark, sf):
    for r in table(spark, sf, "pages").join(QUERIES["op6_url_filter"](spark, sf), "page_id").collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url)
        assert (r.host, r.path) == (m[1].lower(), m[2])


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    stages = dict(corpus_pipeline.STAGES)
    judged = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    clean = stages["toxicity"](spark, docs, sf)
    assert plain(clean, *docs.columns) == plain(docs.where(docs.doc_id.isin([i for i, p in judged.items() if not p])), *docs.columns)
    unique = stages["exact dedup"](spark, docs, sf)
    best = {}
    for r in texts_of(docs):
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    assert sorted(r.doc_id for r in unique.collect()) == sorted(best.values())
    near = stages["simhash near-dedup"](spark, docs, sf)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in simhash_expected(docs)})
    assert unique.columns == near.columns == stages["mixing"](spark, docs, sf).columns == docs.columns


def test_pipeline_runs_on_what_each_stage_kept(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in texts_of(table(spark, sf, "documents"))}
    assert out and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(stage, odd, spark, sf):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, odd, sf).count() >= 1
    assert run(spark, odd.limit(0), sf).count() == 0


def test_without_the_folder_the_rest_imports(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "clubspark", tmp_path / "clubspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
