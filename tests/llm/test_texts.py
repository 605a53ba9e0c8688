"""Line dedup, decontamination, language, URL, chat, sharding: awkward tables against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.llm import chat, decontaminate as de, language, line_dedup as li, sharding, url_filter

from .tables import SCHEMA, TEXTS, docs, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lines_by_hand(texts):
    """Rows without an id are documents of their own here, after all others."""
    ids = [i if i is not None else 10**9 + k for k, (i, _) in enumerate(texts)]
    owner = {}
    keys = [[lower(x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")] for _, t in texts]
    for i, ks in zip(ids, keys):
        for k in ks:
            if len(k) >= 10:
                owner[k] = min(owner.get(k, i), i)
    out = []
    for i, (given, t), ks in zip(ids, texts, keys):
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, ks) if owner.get(k, i) == i]
        out.append((given, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (6, 3)])
def test_line_dedup(spark, batches, fanout):
    got = li.line_dedup(docs(spark), batches=batches, fanout=fanout, buckets=3)
    assert Counter(tuple(r) for r in got.collect()) == lines_by_hand(TEXTS)


def test_line_dedup_many_lines_and_empty(spark):
    texts = [(2, "\n".join(f"line number {k % 700}" for k in range(3000))), (1, "\n".join(f"line number {k}" for k in range(0, 3000, 3)))]
    assert Counter(tuple(r) for r in li.line_dedup(docs(spark, texts), buckets=3).collect()) == lines_by_hand(texts)
    assert li.line_dedup(docs(spark, [])).count() == 0


def hits_by_hand(text, bench, n=10):
    words, hit, items = WORD.findall(lower(text)), set(), set()
    for b in bench:
        w = WORD.findall(lower(b["text"]))
        size = min(n, len(w))
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                items.add(str(b["item_id"]))
    return sorted(hit), sorted(items)


BENCH = [(1, " ".join(f"word{i} tale{i % 7}" for i in range(3, 9))), (2, "a b"), (3, None), (4, "?!"), (10, "Straße ünïcode ñandú"), (2, "x")]


@pytest.mark.parametrize("block_mb", [16, 0.0001])
def test_decontaminate(spark, block_mb):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    got = de.scan_benchmark(docs(spark), bench, block_mb=block_mb).collect()
    rows = [{"item_id": i, "text": t} for i, t in BENCH]
    want = Counter((i, len(WORD.findall(lower(t))), *map(tuple, hits_by_hand(t, rows))) for i, t in TEXTS)
    assert Counter((r[0], r.n_words, tuple(r.hits), tuple(r["items"])) for r in got) == want
    kept = de.decontaminate(docs(spark), bench, block_mb=block_mb)
    assert kept.columns == docs(spark).columns
    assert Counter((r[0], r[1]) for r in kept.collect()) == Counter((i, t) for i, t in TEXTS if not hits_by_hand(t, rows)[0])


def test_decontaminate_spans_and_empty(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    some = docs(spark, [(1, "zero, One two; three four"), (2, None), (3, "one two")])
    assert [r.text for r in de.decontaminate(some, bench, remove="span").orderBy("doc_id").collect()] == ["zero,  four", None, "one two"]
    assert de.scan_benchmark(docs(spark, []), bench).count() == 0
    assert de.scan_benchmark(some, bench.limit(0)).filter(F.size("hits") > 0).count() == 0


def test_language(spark):
    english, german = "the thing and the other thing with that ", "der und die nicht schön ganz über "
    rows = [(i, t, g) for i, (t, g) in enumerate([(english * 9, "en"), (german * 9, "de"), (english * 5, "en"), (german * 4, "de")])]
    train = spark.createDataFrame([*rows, (9, None, "en"), (10, "1 2", "fr"), (11, english, None)], "doc_id bigint, text string, lang string")
    prototypes = language.train_languages(train)
    assert sorted(prototypes) == ["de", "en"]
    judge = language.language_of(prototypes)
    got = docs(spark, [(1, english), (2, german), (3, None), (4, ""), (5, "12 !?"), (6, english * 40_000), (7, "x" * 600_000)]).select(judge("text").alias("j")).collect()
    assert [r.j.lang for r in got[:6]] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.j.score <= 1 for r in got)
    assert language.train_languages(train.limit(0)) == {}
    assert docs(spark).select(language.language_of({})("text")["lang"].alias("g")).filter("g <> 'und'").count() == 0


def test_bundle_equals_definition():
    text = "Ab, caé ab!"
    grams = [w[i:i + 3] for w in (" ab ", " caé ", " ab ") for i in range(len(w) - 2)]
    known = language.Letters(64)
    want = sum(np.roll(known.vector(ord(a)), 2).astype(int) * np.roll(known.vector(ord(b)), 1) * known.vector(ord(c)) for a, b, c in grams)
    got, lettered = language.bundle([None, text, "1"], known)
    assert (got[1] == want).all() and lettered.tolist() == [False, True, False] and not got[[0, 2]].any()


def test_language_accuracy_on_held_out(spark, data):
    judged = language.op7_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").filter("held_out")
    assert judged.filter("lang = lang_pred").count() >= 0.97 * judged.count()


def test_urls(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = [("https://a.net/x", "net/", "block"), ("https://a.net", None, "allow"), ("https://www.Example.NET/en/1?q", "example.net/en/", "allow"),
            ("http://t.example.com/de/1#/fr/", "example.com/de/", "block"), ("http://library.org/fr/", "org/fr/", "allow"),
            ("http://m.casino-win.example.org/en/3", None, "block"), ("http://town-library.example.org/en/3", None, "allow"),
            ("http://notexample.com/de/1", None, "allow"), ("x://y://z/p", None, None), (None, None, None), ("no scheme/de/", None, None), ("", None, None)]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, (u, _, _) in enumerate(urls)], "page_id bigint, url string, host string, _host string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, model).collect()}
    for i, (_, rule, verdict) in enumerate(urls):
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict), urls[i]
    assert (got[2].host, got[2].path, got[3].path, got[8].host, got[8].path) == ("www.example.net", "/en/1", "/de/1", "y:", "//z/p")
    assert all(got[i].host == got[i].path == "" for i in (9, 10, 11))
    assert url_filter.filter_urls(pages.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        url_filter.train(url_filter.labelled_urls(spark).filter("label = 1"))


def test_url_model_on_pages(spark, data):
    got = url_filter.op5_url_filters(spark, data).filter("rule IS NULL")
    wrong = got.filter(got.host.rlike("casino|pills|adult|spam|ads-track|free-bets") != (got.verdict == "block"))
    assert wrong.count() <= 0.02 * got.count()


def test_url_model_on_unseen_hosts_and_paths(spark, data):
    labelled = url_filter.labelled_urls(spark)
    table_hosts = labelled.select(url_filter.host_of(labelled.url).alias("h")).distinct()
    pages = spark.read.parquet(f"{data}/pages.parquet")
    name = lambda c: F.regexp_extract(c, r"^(?:www\.|m\.|blog\.)?([^.]*)", 1)
    shared = pages.select(name(url_filter.host_of(F.col("url"))).alias("n")).distinct().join(table_hosts.select(name("h").alias("n")).distinct(), "n")
    assert shared.count() == 0
    hosts = ["quiet-harbour.com", "www.lindenhof.org", "m.velodrome.example.net", "tulips.info", "zuqimo.example.com"]
    bad, good = ["/casino-games/7", "/en/viagra-deals.html", "/porn/gallery", "/poker/rules"], ["/harbour/7", "/en/tulip-care.html", "/gallery", "/static/top.js", "/rules"]
    rows = [(f"https://{h}{p}", v) for h in hosts for paths, v in ((bad, "block"), (good, "allow")) for p in paths]
    rows += [(f"https://{h}.{e}/en/9137", "block") for h in ("pills4you", "adult-films") for e in ("com", "example.org")]
    known = {r.p for r in labelled.select(url_filter.path_of(labelled.url).alias("p")).distinct().collect()}
    assert not known & set(bad + good)
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(table, url_filter.train(labelled), rules=()).collect()}
    assert not [rows[i] for i in got if got[i] != rows[i][1]]


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n", "<|turn|>user<|body|>", "\\<|\\\\", "<", "\\", "", None, "a<|b", "\\|", "<\\|x"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(odd)]
    rows += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (3, 1, "assistant", "b"), (3, None, "system", "a"), (None, 0, "<|end|>\n", "x"), (4, 0, None, None),
             (5, 2, "assistant", "c"), (5, 1, "user", "b"), (5, 0, "system", "a")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, state string, segments string")
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for template in (chat.Template(), chat.Template(mark="[[", turn="[[t]", body="[[b]", end="[[e]", escape="~")):
        got = chat.read_back(chat.format_chats(table, template), template).collect()
        assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
        assert {r.conv_id: r.loss_text for r in got} == {c: "".join(x[3] for x in sorted(v) if x[2] == "assistant") for c, v in by.items()}
        assert {r.conv_id for r in got if r.valid} == {5}
        assert all("".join(s.text for s in r.segments) == r.formatted for r in got)
    assert chat.format_chats(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(turn="turn")


@pytest.mark.parametrize("slice_rows", [50, 10**6])
def test_shards(spark, slice_rows):
    rows = [(k % 990, "t", None, ("big" if k % 3 == 0 else f"s{k % 10}" if k % 50 else None if k % 100 else f"only{k}"), 1) + ("clash",) * 8 for k in range(1003)]
    table = spark.createDataFrame([(*r[:5], "c", "c", 1, "c", "c", "c", "c", "c") for r in rows], SCHEMA)
    got = sharding.interleaved_shards(table, 8, carry={"src": F.col("source")}, slice_rows=slice_rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    for source, n in Counter(r.src for r in got).items():
        assert all(abs(sum(r.src == source for r in v) - n / 8) <= 2.5 for v in shards.values())
    assert sharding.interleaved_shards(table.limit(0)).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.interleaved_shards(table.limit(3)).collect()) == [(0, 0), (2, 0), (5, 0)]


