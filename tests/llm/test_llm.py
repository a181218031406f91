"""Training-data operators: SQL where it can express them, else brute force, exact round trips or accuracy."""

import collections
import math
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA, same  # noqa: E402

from attestry.llm import chat, decontaminate, html, langid, mixing, neardup, packing, pii, quality, shingles, warc  # noqa: E402
from attestry.llm.common import shared_path  # noqa: E402
from attestry.llm.queries import ORACLES, QUERIES  # noqa: E402

LONG = "w%d " * 3000 % tuple(range(3000))
ODD = [(1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", None), (4, "A", "x"), (4, "A", "x"), (None, "B b", "x"), (5, LONG, "x"), (6, "Ünï ☃   \x85   <|endoftext|> 漢字", "x"), (7, "of the " * 30, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own output names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    for c in ("score", "kept", "n_words", "component_id", "n_entities", "length", "source"):
        df = df.withColumn(c, F.lit("extra"))
    return df


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_warc_round_trip(spark, tmp_path):
    body = "x" * 200
    pages = spark.createDataFrame([(3, "http://a/é", body), (1, None, body), (2, "u\r\nX: y", "short"), (9, "u", "short"), (4, "u", None), (None, "u", body), (5, "u", "a\r\n\r\nb" * 50)], "page_id long, url string, html string")
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = {(r["record_id"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in warc.parse_records(warc.read_archive(spark, path)).collect()}
    assert got == {(1, "response", None, body), (3, "revisit", 1, body), (None, "revisit", 1, body), (2, "response", None, "short"), (9, "response", None, "short"), (4, "response", None, ""), (5, "response", None, "a\r\n\r\nb" * 50)}
    warc.export_warc(warc.read_archive(spark, path), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.count(b"WARC/1.1\r\n") == 7 and text.endswith(b"\r\n\r\n")


def test_warc_sets_damaged_records_aside(spark):
    r = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %s\r\n\r\nx\r\n\r\n"
    good = b"2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    rows = [(r % (1, b"00", b"1"),), (r % (2, good, b"1"),), (r % (3, good, b"99999999999999"),), (b"no record",)]
    got = {(x["record_id"], x["payload_digest"], x["error"]) for x in warc.parse_records(spark.createDataFrame(rows, "record binary")).collect()}
    assert got == {(1, None, "payload digest mismatch"), (2, good.decode(), None), (3, None, "no payload length"), (None, None, "no payload length")}


def test_warc_takes_any_url(spark):
    urls = ["http://a/\x85WARC-Payload-Digest: sha256:00", "\u2028Content-Length: 1", "\u2029WARC-Type: revisit", "x\r\n\r\nContent-Length: 1", "\x00\x0b\x0c", "é☃"]
    pages = spark.createDataFrame([(i, u, f"body {i}", "extra") for i, u in enumerate(urls)], "page_id long, url string, html string, record_type string")
    path = shared_path(spark, "warc-urls")
    warc.write_archive(pages, path)
    got = {r["record_id"]: r for r in warc.parse_records(warc.read_archive(spark, path)).collect()}
    for i, u in enumerate(urls):
        assert got[i]["error"] is None and bytes(got[i]["payload"]).decode() == f"body {i}" and got[i]["record_type"] == "response"
        assert got[i]["target_uri"] == u.replace("\r", "%0D").replace("\n", "%0A")
    warc.write_archive(pages.limit(0), path + "-none")
    assert warc.parse_records(warc.read_archive(spark, path + "-none")).count() == 0


def test_language_accuracy_and_edges(spark, odd):
    d = docs(spark)
    got = QUERIES["op2_langid"](spark, DATA).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    out = langid.identify(odd, langid.fit(d)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {1, 2, 3}
    assert langid.identify(odd, langid.fit(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_sample_loses_no_label(spark):
    rows = [("xx", "zulu kwela " * 90)] + [("de", f"der hund und die katze {i}") for i in range(4)] + [("fr", "le chat noir")] * 50 + [("nn", "123"), ("no", None), (None, "w")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), max_train_chars=900)
    assert model.langs == ["de", "fr", "xx"]
    texts = ["zulu kwela", "der hund", "² ½ Ⅷ 12", "", None, "漢字", "b h", "ϡϠ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("kept"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert [got[i][0] for i in range(5)] == ["xx", "de", "und", "und", "und"]
    # nothing of it is known: a tie, which goes to the first by name
    assert got[5][0] == got[7][0] == "de" and abs(got[5][1] - 1 / 3) < 1e-12
    kept = langid.keep_identified(df, model)
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 6} and kept.columns == df.columns and {r["score"] for r in kept.collect()} == {"kept"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_quality_edges_and_cascade(spark, odd):
    q = quality.add_features(odd)
    by = {r["doc_id"]: r for r in q.collect()}
    assert by[1]["n_words"] == by[3]["n_words"] == 0 and by[5]["n_words"] == 3000 and by[7]["n_repeat_words"] == 60
    orders = [[r.name for r in quality.RULES], [r.name for r in quality.RULES][::-1]]
    verdicts = [sorted((str(r["doc_id"]), r["rejected_by"] is None) for r in quality.quality_cascade(q, o).collect()) for o in orders]
    assert verdicts[0] == verdicts[1]
    assert sorted(e.name for e in quality.plan_cascade(odd)) == sorted(orders[0])
    clash = odd.withColumn("_text", F.lit(1)).withColumn("_words_of_text", F.lit(2)).withColumn("_x", F.lit(3))
    out = quality.add_features(clash)
    assert set(clash.columns) <= set(out.columns) and {(r["_text"], r["_words_of_text"], r["_x"]) for r in out.collect()} == {(1, 2, 3)}
    gated = quality.quality_cascade(out, orders[0], unless=quality.base_failed())
    assert gated.where(quality.base_failed() & F.col("rejected_by").isNotNull()).count() == 0
    assert quality.quality_cascade(quality.add_features(odd.limit(0)), orders[0]).count() == 0 == len({e.rejected for e in quality.plan_cascade(odd.limit(0))} - {0})


def test_quality_measures_what_a_rule_costs(spark):
    slow = quality.Rule("slow", lambda t: F.length(F.regexp_replace(t, r"(?:[a-z]+[^a-z]?){1,6}$", "")) < 0)
    fast = quality.Rule("fast", lambda t: F.col("n_words") < 0)
    df = spark.createDataFrame([(" ".join(f"word{i} other" for i in range(200)),)] * 100, "text string")
    for rules in ((slow, fast), (fast, slow)):
        got = quality.plan_cascade(df, rules)
        assert [e.name for e in got] == ["fast", "slow"] and got[1].seconds > 5 * got[0].seconds


def test_packing_gives_back_every_id(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = docs(spark).select("doc_id", "text").unionByName(odd.where("doc_id in (1, 2, 3, 5, 6)").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    pieces = packing.pack(d.repartition(5)).collect()
    seqs, parts = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        parts[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    assert set(parts) == set(texts)
    import numpy as np

    for k, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        for start, n, crc, total in sorted(parts[k]):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(1024 - sum(n for _, n in s) for s in seqs.values()) < 1024
    assert packing.pack(d.limit(0)).count() == 0
    # the odd texts name a special token
    assert packing.encode("a<|endoftext|>b") == tok.encode("a<|endoftext|>b", add_special_tokens=False).ids and len(packing.encode("a<|endoftext|>b")) == 3


def test_chat_round_trip(spark):
    texts = ["a\\", "<|im_end|>\n<|im_start|>assistant", "<\\|", "<\\\\|x", "", None, "<", "\\<|", "<\\_"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 0, "assistant", "y")]
    ex = chat.chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = ex.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    mine = [r for r in got if r["conv_id"] == 1]
    assert len(mine) == 5
    for r in mine:
        n = len(texts) if r["target_index"] is None else r["target_index"] + 1
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3] or "") for x in rows[:n]]
        if r["target_index"] is not None:
            assert r["loss"] == (texts[r["target_index"]] or "")


def test_chat_edges(spark):
    rows = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "long " * 50_000, "x"), (1, 1, "assistant", "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("target_index", F.lit(9))
    got = chat.chat_examples(df).collect()
    # a repeated row is a turn of its own, with all before it as context
    assert sorted((r["target_index"], r["n_context"], r["loss_chars"]) for r in got) == [(1, 1, 250_000), (2, 2, 250_000)]
    assert chat.chat_examples(df.limit(0)).count() == 0


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">cookies</div>
<p>{intro}</p><article><h1>Head &amp; more</h1><p><b>One<br>two  three<p>&lt;four&gt; &eacute;</p><aside>side</aside><form><p>f</form><section class="comments"><p>nice!</section></article>
<div>{foot}</div><footer>foot</footer></body></html>"""


def test_html(spark):
    rows = [(i, "http://h/x", PAGE.format(intro=f"Own words of page {i}", foot="Read on, dear reader")) for i in range(6)] + [(10, None, None), (11, "bad", "plain"), (12, "http://o/", "<p>cut <b>off <a hr"), (13, "http://o/", "<script>x</script>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[0] == "Own words of page 0\nHead & more\nOne two three\n<four> é"
    assert (got[10], got[11], got[12], got[13]) == ("", "plain", "cut off", "")


def test_html_judges_blocks_inside_articles(spark):
    page = "<main><article><h1>Head {0}</h1><p>Own words of text {0}.</p><p>{1}</p></article></main>"
    rows = [(i, "http://h/x", page.format(i, "The same on every page")) for i in range(8)]
    rows += [(100 + i, "http://copies/x", f"<title>{i}</title>" + page.format("of one", "A copied article")) for i in range(8)]
    rows += [(200 + i, "http://few/x", page.format(i, "The same on three pages")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i}\nOwn words of text {i}." for i in range(8))
    assert all(got[100 + i] == "Head of one\nOwn words of text of one.\nA copied article" for i in range(8))
    assert all(got[200 + i].endswith("The same on three pages") for i in range(3))


def brute_low_blocks(pages):
    """{(host, page): places} of blocks with little importance, from a style tree in dictionaries."""
    import numpy as np

    tree, rows = collections.defaultdict(lambda: collections.defaultdict(set)), []
    for url, page in pages:
        host, blocks = html.host_of(url), [(i, p, s, t) for i, (p, s, t) in enumerate(html.blocks_of(page)) if s]
        inside = "\n".join(t for _, _, s, t in blocks if s == 2)
        for i, p, s, t in blocks:
            parent, voice = p.rpartition("/")[0], (s, inside if s == 2 else page)
            look = tuple(dict.fromkeys(q.rpartition("/")[2] for _, q, _, _ in blocks if q.rpartition("/")[0] == parent))
            tree["page", host, p][None].add(voice)
            tree["text", host, p][t].add(voice)
            tree["look", host, parent][look].add(voice)
            rows.append((host, page, i, p, parent, t))
    out = collections.defaultdict(set)
    for host, page, i, p, parent, t in rows:
        m, same = len(tree["page", host, p][None]), len(tree["text", host, p][t])
        n = np.array([len(x) for x in tree["look", host, parent].values()], float)
        look = 1.0 if n.sum() <= 1 else -(n / n.sum() * np.log(n / n.sum())).sum() / np.log(n.sum())
        if m >= html.MIN_PAGES and same > 1 and (1 - html.GAMMA) * look + html.GAMMA * (1 - np.log(same) / np.log(m)) < html.THRESHOLD:
            out[host, page].add(i)
    return out


def test_html_equals_a_tree_in_dictionaries(spark):
    import random

    rng, pages = random.Random(5), []
    for i in range(150):
        box = "<div class='x'><p>Follow us</p></div>" if i % 3 else "<p>Own {i}</p><div class='x'><p>Follow us</p></div>"
        some = "".join(f"<p>{rng.choice(['Shared one', 'Shared two', f'Own {rng.random()}'])}</p>" for _ in range(rng.randrange(4)))
        page = rng.choice(["<article>{}{}</article>", "<div>{}<section>{}</section></div>", "{}{}", "<main><h1>T</h1>{}</main>{}"]).format(f"<p>Body of {i}</p>{box}", some)
        pages.append((f"http://h{rng.randrange(3)}/x", page))
    pages += pages[:20]
    want = brute_low_blocks(pages)
    low = html.low_blocks(spark.createDataFrame(pages, "url string, html string"))
    got = {r["page"]: set(r["drop"]) for r in low.collect()}
    assert got == {html.page_key(*k): v for k, v in want.items()} and sum(map(len, got.values())) > 100
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("_drop", F.lit("a")).withColumn("_key", F.lit("b"))
    out = html.extract(df).collect()
    assert len(out) == len(pages) and {(r["_drop"], r["_key"]) for r in out} == {("a", "b")}
    for r in out:
        url, page = pages[r["page_id"]]
        text = "\n".join(t for i, (_, s, t) in enumerate(html.blocks_of(page)) if s and i not in want.get((html.host_of(url), page), ()))
        assert r["text"] == text and r["n_chars"] == len(text)
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_what_only_looks_like_a_menu(spark):
    page = "<article><p class='market-share research legal-analysis'>A</p><p hidden>B</p><p aria-hidden=true>C</p><p>wo\u200brd</p><div class='x ad'>no</div><div id=comments><p>no</div><audio>D</audio></article>"
    shared = "<p>One text on all</p><p>{}</p>"
    rows = [(0, "http://a/", page)] + [(i, "http://b/", shared.format(f"text {i}")) for i in range(1, 11)] + [(98, "http://b/", shared.format("copied")), (99, "http://d/", shared.format("copied"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "A\nB\nC\nwo\u200brd\nD"
    # one page on two hosts: what is layout on one is text on the other
    assert got[98] == "copied" and got[99] == "One text on all\ncopied" and got[3] == "text 3"


def brute_components(texts, percent):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    import random

    rng = random.Random(3)
    texts = {r["doc_id"]: r["text"] for r in docs(spark).collect()}
    base = [f"v{rng.randrange(50)}" for _ in range(120)]
    for i in range(150):  # a family whose members are near each other to every degree
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        texts[10**6 + i] = " ".join(w)
    texts |= {2 * 10**6: None, 2 * 10**6 + 1: "", 2 * 10**6 + 2: "two words", 2 * 10**6 + 3: "TWO\twords "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, percent=percent).collect()}
    assert got == brute_components(texts, percent)


def test_near_duplicate_edges(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "A train leaves London at 40 km per hour and meets Paris traffic after 3 hours of slow travel; how far did it go?"), (2, "too short"), (3, None)], "item_id long, text string")
    q = "A train leaves {0} at {1} km per hour and meets {2} traffic after {3} hours of slow travel; how far did it go?"
    rows = [(1, "Intro words. " + q.format("London", 40, "Paris", 3)), (2, "So, " + q.format("Berlin", 55, "Rome", 7)), (3, q.format("Berlin", 55, "Berlin", 55)), (4, "a quite different text about trains and hours"), (5, "Too short!"), (6, "it is too short to tell")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["kind"]) for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {1: (1, "verbatim"), 2: (1, "reparameterised"), 5: (2, "verbatim")}
    left = decontaminate.remove_contaminated(odd, bench)
    assert left.count() == len(ODD) and left.columns == odd.columns
    assert decontaminate.contaminated(d, bench.limit(0)).count() == decontaminate.contaminated(d.limit(0), bench).count() == 0


def test_decontamination_tells_items_of_one_template_apart(spark):
    q = "At the market a clerk sells {} pens and also {} books to each of the waiting customers; how many things are sold?"
    bench = spark.createDataFrame([(1, q.format(3, 3)), (2, q.format(3, 5)), (3, q.format(3, 5)), (4, q.format(2, 7))], "item_id long, text string")
    d = spark.createDataFrame([(1, "Intro. " + q.format(3, 5)), (2, "Intro. " + q.format(3, 3))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {(1, 2, "verbatim"), (1, 4, "reparameterised"), (2, 1, "verbatim")}
    assert decontaminate.remove_contaminated(d, bench).count() == 0


def test_decontamination_finds_short_and_slot_heavy_items(spark):
    long_sum = " + ".join(str(i * 37) for i in range(21))
    items = ["Who painted the Night Watch?", "12 + 30 = 42", f"What is {long_sum}?", "1492 1776"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    rows = [(k, f"Some words that come before it. {t} And a few more that follow after it.") for k, t in enumerate(items, 1)]
    rows += [(5, "Who painted the old Night Watch, and when was that, if anyone still knows?"), (6, "what is " + long_sum.replace("370", "371") + " plus some more"), (7, "1492, 1776.")]
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, "verbatim"), (2, 2, "verbatim"), (3, 3, "verbatim"), (7, 4, "verbatim")}


def test_long_runs_take_no_stack(spark):
    n = 10_000
    run = "see " + "Foo " * n + "1." * n + "1, a@" + "b." * n + "com"
    # constants are folded in the driver, where an overflow is an error; in a task it ends the executor
    raw, plain = decontaminate.raw_tokens(F.lit(run)), decontaminate.plain_tokens(F.lit(run))
    assert spark.range(1).select(F.size(raw), F.size(plain), F.size(pii._found(F.lit(run)))).first()[:] == (n + 5, 2 * n + 4, 1)
    item = "which of these two rivers has the longer course through the old forest"
    d = spark.createDataFrame([(1, f"{run} {item}"), (2, run)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [1]
    for r in pii.replace_pii(d, "k").collect():
        assert r["n_entities"] == 1 and r["text"].startswith(run[: run.index("a@")]) and "@b." not in r["text"]


def test_decontamination_finds_what_a_plain_search_finds(spark):
    import re

    words = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], k) for r in docs(spark).collect() for k, t in items.items() if t in words(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark), bench).collect()}
    assert want <= got and len({d for d, _ in got}) == len({d for d, _ in want})


def test_mixing_base_and_gain(spark, odd):
    rows = {r["doc_id"]: r for r in QUERIES["op9_mixing"](spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs(spark).collect()}
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = collections.Counter()
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    for k, t in texts.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t))
        assert abs(rows[k]["base_score"] - base) < 1e-6 * abs(base) and rows[k]["n_known"] == sum(c[w] > 0 for w in tok(t)) and rows[k]["train_tokens"] == n
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    both = odd.select("doc_id", "text", F.lit(False).alias("teach")).unionByName(docs(spark).select(F.col("doc_id") + 1000, "text", F.lit(True)).toDF("doc_id", "text", "teach")).withColumn("row", F.lit("x")).withColumn("score", F.lit("y"))
    out = mixing.score(both, F.col("teach")).where("doc_id is null or doc_id < 1000").collect()
    assert len(out) == len(ODD) and all(r["score"] < 0 for r in out) and {r["bits_per_byte"] is None for r in out if r["doc_id"] in (1, 2)} == {True}
    assert len({r["score"] for r in out if r["doc_id"] == 4}) == 1
    assert all(r["n_known"] == r["train_tokens"] == 0 for r in mixing.score(odd, F.lit(None).cast("boolean")).collect())
    assert mixing.score(odd.limit(0), F.lit(True)).count() == 0


def scalar_score(texts, teach, k):
    """score of texts[k], one token and one bit at a time, from counts in dictionaries."""
    import numpy as np

    tok = {i: mixing.Tokens([t or ""], [0], [True], 40) for i, t in texts.items()}
    seen, words = collections.Counter(), collections.Counter()
    contexts = lambda t, i: [0, *(int(x[i]) for x in t.slots), ("both", int(t.keys[i]) >> 8)]
    path = lambda h: [(1 << d | (h & 255) >> (8 - d), h >> (7 - d) & 1) for d in range(8)]
    for i, t in tok.items():
        for j, h in enumerate(map(int, t.h)):
            if teach(i):
                words[h] += 1
                for c in contexts(t, j):
                    for node, bit in path(h):
                        seen[c, node, bit] += 1
    class_c, class_v = collections.Counter(), collections.Counter()
    for h, n in words.items():
        class_c[h & 255] += n
        class_v[h & 255] += 1
    prior = lambda node: (seen[0, node, 1] + 0.4) / (seen[0, node, 0] + seen[0, node, 1] + 0.8)
    fixed = lambda c, node: (seen[c, node, 1] + prior(node)) / (seen[c, node, 0] + seen[c, node, 1] + 1)
    t, total = tok[k], 0.0
    w = [[1.1 / mixing.K] * mixing.K for _ in range(8)]
    cells = [[1 / (1 + math.exp(-(i - mixing.MAP_CELLS / 2 + 0.5) * 16 / mixing.MAP_CELLS)) for i in range(mixing.MAP_CELLS)] for _ in range(8)]
    for at in range(0, len(t.h), mixing.BLOCK):
        moves, maps = np.zeros((8, mixing.K)), collections.defaultdict(list)
        for j in range(at, min(at + mixing.BLOCK, len(t.h))):
            h, cs = int(t.h[j]), contexts(t, j)
            for d, (node, bit) in enumerate(path(h)):
                near = fixed(cs[1], node)
                ps = [prior(node), near, fixed(cs[2], node), fixed(cs[3], node), (seen[cs[4], node, 1] + near) / (seen[cs[4], node, 0] + seen[cs[4], node, 1] + 1)]
                x = np.array([math.log(p / (1 - p)) for p in ps])
                s = min(7.9, max(-7.9, float(x @ w[d])))
                p, cell = 1 / (1 + math.exp(-s)), int((s + 8) * mixing.MAP_CELLS / 16)
                q = min(1 - 1 / 4096, max(1 / 4096, 0.75 * p + 0.25 * cells[d][cell]))
                total += math.log10(q if bit else 1 - q)
                moves[d] += mixing.RATE * (bit - p) * x
                maps[d, cell].append(bit)
            total += math.log10((words[h] + 0.5) / (class_c[h & 255] + 0.5 * (class_v[h & 255] + 1)))
        w = (np.array(w) + moves).tolist()
        for (d, cell), bits in maps.items():
            cells[d][cell] += min(mixing.MAP_RATE, 0.5 / len(bits)) * sum(b - cells[d][cell] for b in bits)
    return total


def test_mixing_equals_a_scalar_version(spark):
    texts = {i: " ".join((t or "").split()[:150]) for i, t in ((r["doc_id"], r["text"]) for r in docs(spark).limit(24).collect())} | {900: None, 901: "one", 902: "a b a b " * 40}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in mixing.score(df, F.col("doc_id") % 3 != 1).collect():
        want = scalar_score(texts, lambda i: i % 3 != 1, r["doc_id"])
        assert abs(r["score"] - want) < 2e-5 * abs(want)


def test_mixing_keeps_every_context_apart(spark):
    # 5,000 contexts, each followed by one word of its own: far more than any fixed number of buckets tells apart
    texts = [(i, " ".join(f"c{k} f{k * 7919 % 5003}" for k in range(i * 50, i * 50 + 50))) for i in range(100)]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    wrong = train.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat_ws(" ", F.reverse(F.split("text", " "))).alias("text"))
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in mixing.score(train.unionByName(wrong), F.col("doc_id") < 1000).collect()}
    assert all(got[i] > 100 and got[i] > got[i + 1000] + 100 for i in range(100))


def test_mixing_answers_and_pieces():
    import numpy as np

    # what leaves a key's path equals counting below each of its nodes
    rng = np.random.default_rng(4)
    keys, n, inverse = mixing.totals((rng.integers(0, 4, 300) * 256 + rng.integers(0, 256, 300)).astype(np.uint64), rng.integers(0, 9, 300))
    assert (keys[inverse] < 1024).all() and n.sum() > 0
    for key, got in zip(map(int, keys), mixing.leaves(keys, n), strict=True):
        below = [sum(m for k, m in zip(map(int, keys), n) if k >> (8 - d) == key >> (8 - d)) for d in range(9)]
        assert got.tolist() == [*(below[d] - below[d + 1] for d in range(8)), below[8]]
    # a text in pieces has the tokens of the whole, with the same contexts
    text = " ".join(f"w{i % 37} é{i}" for i in range(500))
    whole = mixing.Tokens([text], [0], [True], 40)
    parts = list(mixing.pieces(text, 300))
    assert len(parts) > 10 and sum(p[3] for p in parts) == len(text.encode())
    some = mixing.Tokens(*([p[k] for p in parts] for k in range(3)), 40)
    assert (some.h == whole.h).all() and (some.keys == whole.keys).all() and (some.slots[:2] == whole.slots[:2]).all()


def test_mixing_sums_the_pieces_of_a_long_text(spark):
    import numpy as np

    text = " ".join(f"w{i % 371} v{i % 37}" for i in range(60_000)) + " " + "x" * 3000
    out = mixing.score(spark.createDataFrame([(1, text * 10), (2, text), (3, None)], "doc_id long, text string"), F.lit(True)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 3 and got[1]["n_tokens"] == len((text * 10).split()) + 1 == got[1]["n_known"] and np.isfinite(got[1]["score"]) and got[3]["n_tokens"] == 1


def test_mixing_class_probabilities_sum_to_one():
    import numpy as np

    counts = np.zeros((mixing.SLOTS, 2))
    counts[: mixing.NODES, 1] = 3
    m = mixing.Model(counts, np.zeros((2, mixing.NODES)))
    t = mixing.Tokens([""] * mixing.NODES, [0] * mixing.NODES, [True] * mixing.NODES, 40)
    t.h = np.arange(mixing.NODES, dtype=np.uint64)
    p = mixing.class_bits(m, t, np.zeros(mixing.NODES, np.int64), np.zeros((1, 8), np.uint32), np.zeros(1, np.uint32))
    assert abs((10**p).sum() - 1) < 1e-3


KEY = "a key of the tests"


def test_pii(spark, odd):
    text = "Ann jo.5@mail1.example.com, JO.5@MAIL1.EXAMPLE.COM +1 (743) 555-3824 at 227.5.221.1; card 4111 1111 1111 1111, Mrs. Anna Schmidt met Herr Müller. Mrs. Schmidt left; г-жа. SSN 123-45-6789 v2.0"
    out = pii.replace_pii(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").withColumn("_entities", F.lit("mine")), KEY).collect()
    a = out[0]["text"]
    assert out[1]["text"] == a and out[0]["n_entities"] == 9 and out[0]["_entities"] == "mine"
    for x in ("jo.5@", "JO.5@", "555-3824", "227.5.221.1", "4111 1111 1111 1111", "Schmidt", "Müller", "123-45-6789"):
        assert x not in a
    assert "v2.0" in a and a.startswith("Ann ") and "+1 (" in a
    plain = pii.replace_pii(odd, KEY)
    assert {(r["doc_id"], r["text"]) for r in plain.collect()} == {(r[0], r[1]) for r in ODD} and plain.where("n_entities <> 0").count() == 0
    assert pii.replace_pii(odd.limit(0), KEY).count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(odd, "")
    assert pii.key_of(spark) == pii.key_of(spark) != ""


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace_pii(df, KEY, plan=pii.Plan()).collect()}


def test_pii_finds_keys_of_letters_and_national_phones(spark):
    texts = ["key AKIA" + "ABCDEFGHIJKLMNOP here", "key sk-" + "abcdefghijKLMNOPQRST here", "key ghp_" + "abcdefghijkl" * 3 + " here", "key " + "abcdef" * 6 + " here"]
    phones = ["call (555) 123-4567 now", "call 555-123-4567 now", "call 1-555-123-4567 now", "call +1 555-123-4567 now", "call +15551234567 now"]
    stays = "no task-like thing, 12-34, 10:20:30 and 1.2.3 stay, as do John, MODEL AB12 and Anna, of course"
    got = found(spark, [*texts, *phones, "+49 30 1234567 or +49301234567", stays])
    for k, t in enumerate([*texts, *phones]):
        assert got[k][1] == 1 and got[k][0] != t and len(got[k][0]) == len(t)
    # one number gets one surrogate however it is written
    digits = ["".join(c for c in got[k][0] if c.isdigit())[-10:] for k in range(4, 9)]
    assert len(set(digits)) == 1
    one, two = ("".join(c for c in x if c.isdigit()) for x in got[9][0].split(" or "))
    assert one == two and one.startswith("49") and one != "49301234567"
    assert got[10] == (stays, 0)


def test_pii_finds_accounts_and_addresses(spark):
    def valid(iban):
        x = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    got = found(spark, ["to DE89 3704 0044 0532 0130 00 now", "to DE89370400440532013000 now", "to GB82WEST12345698765432 now", "to DE88 3704 0044 0532 0130 00 now", "at 2001:0db8:85a3:0000:0000:8a2e:0370:7334, FE80::1:2", "at std::vector or a::b"])
    for k, spaced in ((0, True), (1, False), (2, False), (3, True)):
        x = got[k][0][3:-4]
        assert got[k][1] == 1 and valid(x) == (k != 3) and (" " in x) == spaced and x[:2] == ("GB" if k == 2 else "DE")
    assert got[0][0].replace(" ", "") == got[1][0].replace(" ", "") and "WEST" in got[2][0] and "0532" not in got[0][0]
    assert got[4][1] == 2 and got[4][0].count("2001:db8:") == 2 and got[5][1] == 0


def test_pii_finds_names(spark):
    texts = ["Anna Schmidt and Mrs. Schmidt", "ask Dr. Thomas McDonald", "my name is Xuan Li, hello", "Иван Петрович Сидоров пришёл", "г-жа Сидорова ушла", "Сидорова Ольга Петровна и Ольга Петровна", "доктор Сидоров", "le Jean-Luc Dupont", "In Paris, Maria sings"]
    got = found(spark, texts)
    for k, left in enumerate((("Schmidt",), ("McDonald", "Thomas"), ("Xuan", "Li,"), ("Сидоров", "Иван "), ("Сидорова",), ("Сидорова",), ("Сидоров",))):
        assert got[k][1] == texts[k].count(" and ") + texts[k].count(" и ") + 1 and not any(x in got[k][0] for x in left), got[k]
    assert got[8] == (texts[8], 0)
    # the family name agrees, gender and script stay
    a, b = got[0][0].split(" and ")
    assert a.split()[-1] == b.split()[-1] and a.split()[0] in pii.GIVEN["f", "latin"] and b.startswith("Mrs. ")
    assert got[1][0].split()[2] in pii.GIVEN["m", "latin"] and got[3][0].split()[0] in pii.GIVEN["m", "cyrillic"] and got[3][0].split()[1] in pii.FATHERS["m"]
    assert got[6][0].split()[1] == got[3][0].split()[2] and all("а" <= c.lower() <= "я" for c in got[6][0].split()[1])


def test_pii_quick_pattern_changes_nothing(spark):
    d = docs(spark).select("text").unionAll(spark.createDataFrame([("sk-" + "abcdefghij" * 3,), ("Anna Schmidt",), ("me llamo Xi",), ("д-р Ли",), ("a@b.cd",)], "text string"))
    whole = F.size(F.regexp_extract_all("text", F.lit(pii.ENTITY), F.lit(0)))
    assert d.where(F.coalesce(whole, F.lit(0)) != F.greatest(F.size(pii._found(F.col("text"))), F.lit(0))).count() == 0
    assert d.where(whole > 0).count() > 10
    # every entity of the table is gone, and what stands around it stays
    out = pii.replace_pii(docs(spark), KEY).withColumnRenamed("text", "new").join(docs(spark).select("doc_id", "text"), "doc_id")
    around = lambda c: F.split(c, pii.ENTITY, -1)
    assert out.where(F.to_json(around("text")) != F.to_json(around("new"))).count() == 0
    assert out.where((F.size(F.array_intersect(F.regexp_extract_all("text", F.lit(pii.ENTITY), F.lit(0)), F.regexp_extract_all("new", F.lit(pii.ENTITY), F.lit(0)))) > 0)).count() == 0


def test_surrogates_are_distinct(spark):
    n = 2000
    ids = spark.range(n)
    kinds = (F.format_string("+1 (%03d) 555-%04d", F.col("id") % 7, F.col("id")), F.format_string("10.0.%d.%d", (F.col("id") / 250).cast("int"), F.col("id") % 250), F.format_string("4%015d", F.col("id")), F.format_string("a%d@b.org", F.col("id")), F.sha2(F.col("id").cast("string"), 256), F.format_string("DE00%018d", F.col("id")), F.format_string("%03d-12-%04d", F.col("id") % 900, F.col("id")))
    for f in kinds:
        x = ids.select(f.alias("x")).select("x", pii.surrogate(F.col("x"), KEY).alias("s"))
        assert x.select(F.count_distinct("s"), F.count_if(F.col("s") == F.col("x")), F.count_if(pii.kind_of(F.col("s")) != pii.kind_of(F.col("x")))).first()[:] == (n, 0, 0)


def test_surrogates_avoid_real_entities(spark):
    one = spark.createDataFrame([("555-123-4567 is here",), ("a@b.org too",)], "text string")
    made = {r[0] for r in pii.replace_pii(one, KEY, plan=pii.Plan()).select("text").collect()}
    taken = one.unionAll(spark.createDataFrame([(x,) for x in made], "text string"))
    # one key gives one surrogate in every plan
    again = taken.select(F.explode(pii._found(F.col("text"))).alias("x")).select(pii.surrogate(F.col("x"), KEY))
    assert {x.split(" ")[0] for x in made} <= {r[0] for r in again.collect()}
    plan = pii.find_plan(taken, KEY)
    assert plan.round > 0 and plan.width > pii.WIDTH
    e = spark.createDataFrame([("phone", "5551234567", "555-123-4567"), ("email", "a@b.org", "a@b.org")], "kind string, value string, x string")
    assert pii.conflicts(e, KEY, pii.Plan()) == {"hashed": 0, "numbers": 0, "same": 0}


def test_shingles_and_registers():
    import numpy as np

    texts = ["a b c d e f a b c d e", None, "", " one\x0b\tTWO ", "ONE two", "Éa", "éa", "x" * 3000]
    h, shapes, at = shingles.hash_words(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert at.tolist() == [0, 11, 11, 11, 13, 15, 16, 17, 18] and len(set(h.tolist())) == len(set(words))
    assert all((words[i] == words[j]) == (h[i] == h[j]) for i in range(18) for j in range(18))
    assert shapes.tolist() == [w[-1] * 16 + min(len(w), 15) for w in words]
    s = next(shingles.shingle_sets(texts))
    assert len(s) == 6 and (np.diff(s.astype(object)) > 0).all()
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**64, int(4000 * j), dtype=np.uint64)
        rest = [rng.integers(0, 2**64, int(4000 * (1 - j) / 2), dtype=np.uint64) for _ in range(2)]
        a, b = (neardup.registers(np.unique(np.concatenate((both, r)))) for r in rest)
        assert abs(neardup.estimate((a == b).mean()) - j) < 0.15


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as cp

    d = docs(spark)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    out = {}
    for name, stage in cp.STAGES[:-1]:
        d = stage(spark, d, DATA)
        assert d.columns == docs(spark).columns
        out[name] = {r["doc_id"]: r["text"] for r in d.collect()}
    assert set(out["language"]) == {k for k, t in texts.items() if any(c.isalpha() for c in t or "")}
    comp = brute_components({k: texts[k] for k in out["language"]}, 80)
    assert set(out["near_dedup"]) == {k for k, (_, c) in comp.items() if k == c}
    bad = {r["doc_id"] for r in decontaminate.contaminated(docs(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert set(out["decontamination"]) == set(out["near_dedup"]) - bad
    assert set(out["surrogates"]) == set(out["decontamination"])
    assert {r["doc_id"] for r in cp.run(spark, DATA).select("doc_id").distinct().collect()} == set(out["surrogates"])


def test_pipeline_takes_odd_documents(spark, odd, tmp_path):
    import corpus_pipeline as cp

    bench = spark.createDataFrame([(1, "of the of the of the of the of the of the"), (None, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (odd, odd.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == odd.columns
            d = out
        ids = sorted(str(r["doc_id"]) for r in d.collect())
        # texts without letters, and what the benchmark holds, go; the null id and the repeated row stay
        assert ids in (["4", "4", "5", "6", "None"], [])
        packed = cp.STAGES[-1][1](spark, d, str(tmp_path))
        assert {str(r["doc_id"]) for r in packed.collect()} == set(ids)
