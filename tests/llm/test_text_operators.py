"""Text operators against plain loops, SQL on the given tables, and odd inputs."""

from collections import Counter
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from biotables.llm import (
    byte_bpe, chat_quotes, edit_counts, masked_lm, ngram_jaccard, quality_mil, suffix_dedup, template_decontam, topk_inner, url_filter,
)
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts, ids=None):
    return frame(spark, [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)])


@given
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_operator_agrees_with_sql(spark, name):
    status, _, note = compare(spark, connect(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert {f"op{i}" for i in range(1, 14)} <= names and "pipeline" in entry.queries()


# 1 suffix dedup ---------------------------------------------------------------------------------


def plain_dedup(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - length + 1):
                first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def repetitive_rows(count, seed):
    rnd = random.Random(seed)
    common = ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(20, 90))) for _ in range(5)]
    out = []
    for i in range(count):
        out.append("".join(rnd.choice(common) if rnd.random() < 0.6 else "".join(rnd.choice("abcd é") for _ in range(rnd.randrange(30))) for _ in range(rnd.randrange(6))))
    return out


@pytest.mark.parametrize("hot", [0, 200_000])
def test_suffix_dedup_equals_brute_force(spark, hot):
    texts = [*repetitive_rows(60, 1), None, "", "short", "x" * 400, "x" * 300]
    ids = [*range(100, 100 + len(texts) - 2), 7, 7]
    ids[5] = None
    got = suffix_dedup.remove_repeats(docs_of(spark, texts, ids), length=30, hot=hot, bucket_bytes=2000)
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=lambda r: (r[0] is not None, r))
    assert found == plain_dedup(list(zip(ids, texts)), 30)
    one = got.where("n_spans > 0").first()
    assert sum(b - a for a, b in zip(one.spans[::2], one.spans[1::2])) == one.n_removed


def test_suffix_dedup_in_place_keeps_whole_characters_and_columns(spark):
    texts = ["é" * 40 + "a", "b" + "é" * 40, None, ""]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts), length=51, in_place=True).collect()}
    assert out[0].text == texts[0] and out[1].text == "b" and out[2].text is None and out[3].text == "" and out[1].lang == "en"


def test_bucket_pointers_class_equal_strings():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    starts = np.arange(len(data) - 19)
    classes = suffix_dedup.bucket_pointers(data, starts, 20)
    strings = [data[s : s + 20].tobytes() for s in starts]
    order = sorted(range(len(starts)), key=lambda i: (strings[i], classes[i]))
    for a, b in zip(order, order[1:]):
        assert (strings[a] == strings[b]) == (classes[a] == classes[b])


def test_suffix_dedup_of_nothing_and_clashing_columns(spark):
    empty = docs_of(spark, [])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    clash = docs_of(spark, ["a" * 60, "a" * 60]).withColumn("kept", F.lit(1)).withColumn("n_spans", F.lit("x"))
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(clash).collect()) == [0, 60]


# 2 url filter -----------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        None, "", "no host", "http://a.example.net/en/x", "HTTP://A.EXAMPLE.NET/en/", "http://example.net/EN/", "http://net", "http://net/",
        "http://x.org/fr/?a://b", "http://example.com/de/#x", "http://notexample.com/de/", "http://y.net?q=/", "http://é.net/", "http://x.net/en/://z/", "http://x.net/a",
    ]
    pages = frame(spark, [(i, u) for i, u in enumerate([*urls, urls[3]])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("word0", F.lit(2))
    rules = spark.sql(f"SELECT * FROM {url_filter.RULES} UNION ALL SELECT null, '/', 'block' UNION ALL SELECT 'net', '/', 'allow'")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls) + 1 and got[15] == got[3]
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][2] == "example.net/en/"
    assert got[5][2:] == ("net/", "block") and got[6] == ("net", "", None, "allow") and got[7][2:] == ("net/", "block")
    assert got[8] == ("x.org", "/fr/", "org/fr/", "allow") and got[9][2:] == ("example.com/de/", "block") and got[10][2:] == (None, "allow")
    assert got[11] == ("y.net", "", None, "allow") and got[13] == ("x.net", "/en/://z/", "net/", "block")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), otherwise="allow").collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    rules = spark.range(3000).selectExpr("concat('h', id, '.com') host", "'/' path", "'block' verdict")
    pages = spark.range(3500).selectExpr("id page_id", "concat('http://a.h', id, '.com/x') url")
    assert url_filter.filter_urls(pages, rules).where("verdict = 'block'").count() == 3000


# 3 n-gram Jaccard -------------------------------------------------------------------------------


def plain_components(rows):
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in low.replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = rows[a][0] == rows[b][0] and rows[a][0] is not None
            near = both and 100 * both >= 75 * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0])
            if same or near:
                root[find(a)] = find(b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(doc, groups.get(find(i), doc))
    return sorted(((doc, len(s), groups.get(find(i)) if doc is not None else None) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(1, 60))]
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy).upper() if rnd.random() < 0.2 else "  ".join(copy))
    return out


@pytest.mark.parametrize("unit", [3, 4000])
def test_jaccard_equals_brute_force(spark, unit):
    texts = [*near_copies(4), None, "", " \n", "one two", "One two", "one two three", "a b c d e", "a b c d e", "é À x y z", "é à x y z"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids[3], ids[9] = None, ids[10]
    got = ngram_jaccard.jaccard_components(docs_of(spark, texts, ids).withColumn("tokens", F.lit(1)), unit=unit, bucket_bytes=500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_components(list(zip(ids, texts)))


def test_jaccard_keeps_representatives(spark):
    texts = [*near_copies(5), None, ""]
    docs = docs_of(spark, texts)
    want = sorted(d for d, _, c in plain_components(list(enumerate(texts))) if d == c)
    out = ngram_jaccard.representatives(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_count_tree_loses_no_link():
    rnd = np.random.default_rng(2)
    base = [np.unique(rnd.integers(0, 2**63, 80, dtype=np.int64).astype(np.uint64) * np.uint64(2)) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[: len(b) - k], rnd.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64)])) for b in base for k in range(0, 20, 2)]
    tree = ngram_jaccard.CountTree(sets)
    for i in range(0, len(sets), 7):
        asked = set(tree.ask(i).tolist())
        assert {j for j in range(len(sets)) if ngram_jaccard.linked(sets[i], sets[j])} <= asked
        assert len(asked) < len(sets) / 4


# 4 chat quotes ----------------------------------------------------------------------------------


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "a", "Hello  there\nsecond line"),
        (1, 1, "b", "> hello there\n> second line\n\nanswer one"),
        (1, 2, "a", "> > Hello there\n> > second line\n> answer one\nreply two"),
        (1, 3, "c", "> second line\nto the first\n>not known\nend"),
        (1, 4, "c", "> > > > reply two\n> to the first\n"),
        (2, 0, "a", "answer one"), (2, 1, "a", "answer one"), (2, 2, "b", "> answer one\nx"),
        (3, 0, "a", None), (3, 1, "b", ""), (3, 2, "b", ">\n>  \n"), (None, 1, "a", "> Hello there\nz"), (4, None, "a", "> q\nw"),
        (5, 1, "a", "> self\nself"),
    ]
    messages = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in chat_quotes.link_quotes(messages).collect()}
    assert len(got) == len(rows)
    assert (got[1, 1].text, got[1, 1].reply_to, got[1, 1].n_quoted) == ("answer one", 0, 1)
    assert (got[1, 2].text, got[1, 2].reply_to, got[1, 2].quoted, got[1, 2].max_level) == ("reply two", 1, [0, 1], 2)
    assert (got[1, 3].text, got[1, 3].reply_to, got[1, 3].n_quoted) == ("to the first\nend", 0, 2)
    assert (got[1, 4].reply_to, got[1, 4].quoted, got[1, 4].max_level) == (3, [2, 3], 4)
    assert [(got[1, t].root, got[1, t].depth) for t in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 1), (0, 2)]
    assert got[2, 2].reply_to == 0 and got[2, 1].reply_to is None
    assert (got[3, 0].text, got[3, 1].text, got[3, 2].text, got[3, 2].reply_to) == ("", "", "", None)
    assert got[None, 1].text == "z" and got[None, 1].reply_to is None and got[4, None].text == "w"
    assert got[5, 1].reply_to is None and got[5, 1].root == 1
    assert chat_quotes.link_quotes(messages.limit(0)).count() == 0


def test_trimmed_quotes_link(spark):
    said = "First line here\nsecond line here\n\nA new paragraph starts\nand it goes on\nto a third line"
    rows = [
        (1, 0, "a", said), (1, 1, "b", "Something else\nand it goes on\nin another way"),
        (1, 2, "c", "> A new paragraph starts\n> and it goes on\n> to a third line\nYes"),
        (1, 3, "d", "> First line here\n> second line here\n>\n> A new paragraph starts\n> to a third line\nNo"),
        (1, 4, "e", "> A new paragraph\n> starts and it goes on to\n> a third line\nWrapped anew"),
        (1, 5, "f", "> and it goes on\n> in another way\nThe later one"), (1, 6, "g", "> and it goes on\n> unknown words\nHalf is too little"),
        (2, 1, "h", "> A new paragraph starts\n> and it goes on\nOther conversation"),
    ]
    got = {(r.conv_id, r.turn): r.reply_to for r in chat_quotes.link_quotes(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 5): 1, (1, 6): None, (2, 1): None}


def test_long_reply_chain(spark):
    rows = [(1, k, "a", (f"> message {k - 1}\n" if k else "") + f"message {k}") for k in range(40)]
    got = chat_quotes.link_quotes(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.root, r.depth) for r in got) == [(k, 0, k) for k in range(40)]


# 5 quality --------------------------------------------------------------------------------------


def test_attention_gradients():
    rnd = np.random.default_rng(0)
    x = np.abs(rnd.standard_normal((6, quality_mil.FEATURES)).astype(np.float32)) * 0.1
    first, y = np.array([0, 2, 5, 6]), np.array([0, 1, 1], np.float32)
    model = quality_mil.Model.start(1)
    for p in model.parts():
        p[...] = p + 0.05

    def loss():
        s = np.clip(model.forward(x.astype(np.float64), first)["score"], 1e-12, 1)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for part, grad in zip(model.parts(), model.gradients(model.forward(x, first), y)):
        at = tuple(0 for _ in part.shape)
        keep = part[at]
        part[at] = keep + 1e-2
        up = loss()
        part[at] = keep - 1e-2
        down = loss()
        part[at] = keep
        assert abs((up - down) / 2e-2 - np.asarray(grad).reshape(part.shape)[at]) < 2e-3


def test_quality_of_labelled_text(spark):
    rnd = random.Random(2)
    good = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(1, 1500))) for _ in range(150)]
    bad = ["".join(rnd.choice("abcdef $%#!") for _ in range(rnd.randrange(600, 1500))) for _ in range(150)]
    docs = docs_of(spark, [*good, *bad, None, "", "x" * 300_000])
    labels = frame(spark, [(i, int(i < 150), None) for i in range(300)] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.train(docs, labels)
    got = quality_mil.score(docs.withColumn("score", F.lit("old")), model)
    scored = {r.doc_id: r.score for r in got.collect()}
    assert len(scored) == 303 and all(0 <= s <= 1 for s in scored.values())
    held = [r.doc_id for r in docs.where(quality_mil.held_out(F.col("doc_id"))).collect() if r.doc_id < 300]
    assert sum((scored[i] >= 0.5) == (i < 150) for i in held) / len(held) > 0.9
    none = quality_mil.train(docs, labels.limit(0))
    assert {r.score for r in quality_mil.score(docs, none).collect()} == {0.5}
    assert quality_mil.score(docs.limit(0), model).count() == 0


@given
def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in entry.queries()["op5_quality_mil"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) > 0.92


# 6 top k ----------------------------------------------------------------------------------------


def plain_top(rows, every, k):
    known = [(i, [int(np.floor(1024 * float(a))) for a in v]) for i, v in rows if i is not None and v is not None and all(a is not None and np.isfinite(a) for a in v)]
    out = []
    for q, x in {i: max(v for j, v in known if j == i) for i, _ in known if i % every == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in known if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2e4])
def test_top_k_equals_brute_force(spark, scale):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 1)]) * scale * (1 + i % 7) for _ in range(5)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (20, rows[20][1]), (404, []), (405, [1.0]), (40, [9.0] * 5)]
    table = frame(spark, rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = topk_inner.top_k(table, every=20, k=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 20, 4)
    assert topk_inner.top_k(table.limit(0)).count() == 0


def test_search_prunes_without_losing_any():
    rnd = np.random.default_rng(1)
    x = (rnd.standard_normal((5000, 16)) * rnd.exponential(300, (5000, 1))).astype(np.int64)
    x = x[np.argsort(-(x.astype(float) ** 2).sum(axis=1))]
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    best = topk_inner.search(x[::500], np.arange(0, 5000, 500), np.full(10, -1e30), x, np.arange(5000), turn, 10)
    for q in range(10):
        scores = x @ x[500 * q]
        scores[500 * q] = -(10**15)
        assert sorted(best.score[best.query == q].tolist(), reverse=True) == sorted(scores.tolist(), reverse=True)[:10]


# 7 decontamination ------------------------------------------------------------------------------

ITEM = "A train leaves at 3 with Maria and travels 40 km to reach the old town where it waits for Maria until 7 before it goes back"


def test_templates_are_found_with_other_values(spark):
    benchmark = frame(spark, [(1, ITEM), (2, "short item of five words"), (3, None), (None, ITEM), (4, ""), (5, "1 2 3 4 5 6 7 8 9"), (1, ITEM)], "item_id long, text string")
    changed = ITEM.replace("3", "5.25").replace("Maria", "Peter").replace("40 km", "90 miles").replace("7", "9")
    mixed = ITEM.replace("with Maria", "with Peter")
    texts = [
        f"Some words before. {ITEM} And after.", f"Intro text: {changed}.", f"Intro text: {mixed}.", "nothing here at all", None, "",
        "He said: short item of five words, really.", "short item of five other words", "9 8 7 6 5 4 3 2 1", ITEM[:45],
    ]
    docs = docs_of(spark, [*texts, ITEM], [*range(10), None]).withColumn("window", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in template_decontam.found_items(docs, benchmark).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 2)}
    assert got[0, 1].exact and not got[1, 1].exact
    assert template_decontam.found_items(docs, benchmark.limit(0)).count() == 0
    assert template_decontam.found_items(docs.limit(0), benchmark).count() == 0


def test_one_other_value_does_not_hide_a_passage(spark):
    benchmark = frame(spark, [(1, ITEM), (2, "we add 3 apples and then 4 more apples to the basket on the old wooden table")], "item_id long, text string")
    equal = "we add 5 apples and then 5 more apples to the basket on the old wooden table"
    other = ITEM.replace("Maria", "Peter").replace("3", "8")
    docs = docs_of(spark, [ITEM.replace("with Maria", "with Peter"), equal, ITEM, other, "nothing here at all"], [0, 1, 2, 2, 4])
    got = {(r.doc_id, r.item_id): r for r in template_decontam.matches(docs, benchmark).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 1)}
    assert not got[0, 1].whole and not got[1, 2].whole and got[2, 1].whole and got[2, 1].exact


def test_items_of_numbers_and_short_items(spark):
    numbers = "1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    one_window = "we go to the big red old barn 1 2 3 4 5 6 7 8 9 10 11 12"
    benchmark = frame(spark, [(1, numbers), (2, "1 2 3 4 5 6 7 8 9"), (3, one_window), (4, "of the"), (5, "the")], "item_id long, text string")
    texts = [f"Copy: {numbers}.", "14 13 12 11 10 9 8 7 6 5 4 3 2 1", "Now we go to the big red old barn 5 times", "all of the rest", "we go to the big red old barn 1 2 3 4 5"]
    got = {(r.doc_id, r.item_id): r for r in template_decontam.matches(docs_of(spark, texts), benchmark).collect()}
    assert set(got) == {(0, 1), (0, 2), (4, 3)} and all(r.exact for r in got.values())


def test_layout_and_scripts_do_not_hide_a_copy(spark):
    named = "In the spring Ana and Olaf walked with Ines to see Omar. Then Élodie met Ugo, Otto and Ürgen by the river"
    chinese = "春天的时候小明和他的朋友们一起去河边散步并且看见了很多花"
    benchmark = frame(spark, [(1, named), (2, chinese)], "item_id long, text string")
    texts = [
        named.lower(), named.upper(), named.replace(" ", "\n"), named.replace(".", " ").replace(",", " "), f"他说：{chinese[:9]}，{chinese[9:]}。完",
        "春天的时候小明", "nothing here at all", None, "",
    ]
    got = {(r.doc_id, r.item_id) for r in template_decontam.matches(docs_of(spark, texts), benchmark).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)}
    odd = np.frombuffer(b"ab \xff\xfe cd" + "é x".encode(), np.uint8)
    assert np.diff(template_decontam.plain_words(odd, np.array([0, 8, len(odd)]))[1]).tolist() == [2, 2]


@given
def test_benchmark_passages_are_found(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    run = lambda text: [text.split()[k : k + 16] for k in range(len(text.split()) - 15)]
    parts = {tuple(w) for t in items.values() for w in run(t)}
    copied = {d for d, t in docs.items() if any(tuple(w) in parts for w in run(t))}
    found = {r.doc_id for r in entry.queries()["op7_template_decontam"](spark, FOLDER).collect() if r.contaminated}
    assert copied <= found and all(any(tuple(w[:10]) in {p[k : k + 10] for p in parts for k in range(7)} for w in run(docs[d])) for d in found)


# 8 masked LM ------------------------------------------------------------------------------------


def test_log_probabilities_equal_a_plain_loop():
    net = masked_lm.Network(1)
    rnd = np.random.default_rng(4)
    word = np.sort(rnd.integers(0, masked_lm.ENTRIES, 50))
    context = rnd.integers(0, masked_lm.ENTRIES + 1, (50, 4))
    embed, w, b, wc, bc, ww, bw = net.parts
    for value, c, t in zip(net.log_prob(context, word), context, word):
        h = np.tanh(embed[c].ravel() @ w + b)
        group = np.exp(h @ wc + bc)
        inner = np.exp(h @ ww[t // 64] + bw[t // 64])
        assert abs(value - np.log(group[t // 64] / group.sum()) - np.log(inner[t % 64] / inner.sum())) < 1e-4


def test_gradients_equal_differences_in_blocks_of_any_size(monkeypatch):
    rnd = np.random.default_rng(8)
    word = np.sort(rnd.integers(0, masked_lm.ENTRIES, 300) // 97 * 97).astype("<u2")
    context = rnd.integers(0, masked_lm.ENTRIES + 1, (300, 4)).astype("<u2")
    weight = rnd.integers(1, 5, 300).astype(np.float32)
    whole = masked_lm.Network(2).gradients(context, word, weight)
    monkeypatch.setattr(masked_lm, "ROWS", 7)
    net = masked_lm.Network(2)
    for g, h, p in zip(net.gradients(context, word, weight), whole, net.parts):
        assert g.shape == p.shape and np.allclose(g, h, atol=1e-3)
        # towards the gradient, the loss falls by the gradient's square
        loss, by = [], 0.02 / np.sqrt(np.sum(h * h))
        for k in (-by, by):
            p += k * h
            loss.append(-(net.log_prob(context, word) * weight).sum(dtype=np.float64))
            p -= k * h
        assert abs((loss[1] - loss[0]) / (2 * by) / np.sum(h * h) - 1) < 0.02


def test_scoring_reads_each_text_once(spark):
    docs = docs_of(spark, ["red apple", "red house", None, "red apple", "old house red apple"] * 20)
    known, net = masked_lm.train(docs)
    counts = masked_lm.vocabulary(docs, frequent=1)  # most words meet their counts in the join
    read = spark.sparkContext.accumulator(0)

    def watch(parts):
        for rows in parts:
            read.add(rows.num_rows)
            yield rows

    watched = docs.select("doc_id", "text").mapInArrow(watch, "doc_id long, text string")
    value = {r.doc_id: r.log_prob for r in masked_lm.score(watched, counts, net).collect()}
    assert read.value == len(value) == 100
    assert all(abs(r.log_prob - value[r.doc_id]) < 1e-6 for r in masked_lm.score(docs, known, net).collect())


def test_order_of_words_counts(spark):
    rnd = random.Random(3)
    pairs = [("red", "apple"), ("old", "house"), ("wild", "river"), ("cold", "night")]
    texts = [" ".join(w for _ in range(rnd.randrange(20, 120)) for w in rnd.choice(pairs)) for _ in range(200)]
    shuffled = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in texts]
    docs = docs_of(spark, [*texts, None, "", "word"]).withColumn("n_words", F.lit("x"))
    known, net = masked_lm.train(docs)
    score = lambda d: {r.doc_id: r for r in masked_lm.score(d, known, net).collect()}
    plain, mixed = score(docs), score(docs_of(spark, shuffled))
    assert sum(plain[i].log_prob > mixed[i].log_prob for i in range(200)) > 190
    assert (plain[200].n_words, plain[200].log_prob) == (plain[201].n_words, plain[201].log_prob) == (0, 0.0) and plain[202].n_words == 1
    known, net = masked_lm.train(docs.limit(0))
    assert len(known) == 0 and masked_lm.score(docs.limit(0), known, net).count() == 0


def test_scores_do_not_depend_on_partitions_and_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "UNIT_WORDS", 4000)
    monkeypatch.setattr(masked_lm, "PIECE", 700)
    rnd, count_all = random.Random(12), masked_lm.vocabulary
    base = [" ".join(f"w{int(rnd.paretovariate(0.5)) % 9000}" for _ in range(rnd.randrange(1, 300))) for _ in range(120)]
    texts = [*base, *base[:30], *[base[3]] * 40, None, "", " ".join(f"v{k % 211}" for k in range(5000))]
    docs = docs_of(spark, texts)
    both = []
    for parts, frequent in ((1, 1 << 18), (7, 300)):
        known = count_all(docs.repartition(parts), frequent=frequent)
        assert len(known.frequent) <= frequent and (known.counts.count() > 0) == (frequent == 300)
        monkeypatch.setattr(masked_lm, "vocabulary", lambda *_, k=known: k)
        known, net = masked_lm.train(docs.repartition(parts))
        both.append({r.doc_id: r for r in masked_lm.score(docs.repartition(parts), known, net).collect()})
    for i, a in both[0].items():
        assert a.n_words == both[1][i].n_words == len((texts[i] or "").split())
        assert abs(a.log_prob - both[1][i].log_prob) <= 1e-3 * a.n_words
    # the whole sum from counts and one word at a time
    n = Counter(w for t in texts for w in (t or "").split())
    hashed = {w: masked_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for w in n}
    entry_of = {w: int(masked_lm.entries(h, known.own)[0]) for w, h in hashed.items()}
    held, single = Counter(), {w for w in n if int(masked_lm.places(hashed[w], known.own)[0]) < masked_lm.OWN}
    for w in n:
        held[entry_of[w]] += n[w]
    for i in (0, 5, 60, 149, 150, len(texts) - 1):
        words = (texts[i] or "").split()
        line = [masked_lm.OUTSIDE] * 2 + [entry_of[w] for w in words] + [masked_lm.OUTSIDE] * 2
        want = 0.0
        for k, w in enumerate(words):
            context = np.array([[line[k], line[k + 1], line[k + 3], line[k + 4]]])
            want += float(net.log_prob(context, np.array([entry_of[w]]))[0])
            want += 0.0 if w in single else np.log(n[w] / (held[entry_of[w]] + 1))
        assert abs(want - both[1][i].log_prob) < 1e-3 * max(1, len(words))


def test_words_of_an_entry_share_its_probability(spark):
    rnd = random.Random(7)
    often = {f"w{k}": 5 if k < masked_lm.OWN else 1 + k % 3 for k in range(7000)}
    words = [w for w, n in often.items() for _ in range(n)]
    rnd.shuffle(words)
    known, net = masked_lm.train(docs_of(spark, [" ".join(words[k : k + 200]) for k in range(0, len(words), 200)]))
    asked = [*often, *(f"never{k}" for k in range(3000))]
    texts = [*asked, "w2050 w6999 never1 w2050", "W2050 w6999 never1 W2050"]
    rows = masked_lm.score(docs_of(spark, texts), known, net).collect()
    assert len(rows) == len(texts)
    value = {texts[r.doc_id]: r.log_prob for r in rows}
    assert 0.5 < sum(np.exp(value[w]) for w in often) < 1
    entry_of = lambda w: int(masked_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) % masked_lm.SHARED
    by_entry = {}
    for w in asked:
        if often.get(w) != 5:
            by_entry.setdefault(entry_of(w), []).append(w)
    for some in by_entry.values():
        for w in some[1:]:
            want = np.log(often.get(w, 1) / often.get(some[0], 1))
            assert abs(value[w] - value[some[0]] - want) < 1e-4
    assert abs(value[texts[-1]] - value[texts[-2]]) < 1e-4


# 9 byte BPE -------------------------------------------------------------------------------------

ODD = [None, "", " ", "  two  spaces ", "a\n\n b\t c", "it's we'll I'D", "naïve façade 北京 \U0001f600\U0001f680", "x" * 3000, "<|endoftext|> end", "\u00a0\u2003 z\u0085", " lead", "trail \n", "1234567 89.5%", "e\u0301 \u200b.", "A  \n  B"]


def test_bpe_equals_tiktoken_and_round_trips(spark):
    rnd = random.Random(9)
    texts = ODD + ["".join(rnd.choice("ab c\n'sé1. \u3000") for _ in range(rnd.randrange(80))) for _ in range(300)]
    tool = edit_counts.encoding(byte_bpe.RANKS, byte_bpe.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.digests(docs_of(spark, texts).withColumn("ids", F.lit(1))).collect()}
    full = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        ids = np.array(tool.encode_ordinary(t or ""), "<u4")
        assert bytes(full[i].ids) == ids.tobytes() and bytes(full[i].decoded).decode() == (t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        starts = np.frombuffer(full[i].offsets, "<u4")
        assert len(starts) == len(ids) and all(a <= b for a, b in zip(starts, starts[1:])) and (not len(starts) or starts[-1] < len(t))
    assert byte_bpe.digests(docs_of(spark, [])).count() == 0


# 10 edit counts ---------------------------------------------------------------------------------


def test_edited_counts_equal_full_counts():
    tool = edit_counts.encoding(edit_counts.RANKS, edit_counts.PATTERN)
    rnd = random.Random(8)
    for _ in range(400):
        text = "".join(rnd.choice(" \n ab'sre12.,éß ") for _ in range(rnd.randrange(200)))
        tree = edit_counts.TokenTree(text, tool, rnd.choice([3, 10, 30]))
        for _ in range(5):
            at, less = rnd.randrange(len(text) + 3), rnd.randrange(10)
            new = "".join(rnd.choice(" ab'\n1é") for _ in range(rnd.randrange(6)))
            tree.edit(at, less, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + less :]
            assert tree.text() == text and tree.total() == len(tool.encode_ordinary(text))


def test_edits_of_odd_rows(spark):
    long = "some words and more " * 5000
    texts = [None, "", "abc", long, "abc"]
    edits = [[(1, 0, 0, "x y")], [(1, 5, 5, "new")], [(2, 0, 1, None), (1, -4, -1, "zz "), (3, None, None, "")], [(1, 50_000, 10, "inserted")], None]
    kind = "doc_id long, text string, edits array<struct<seq:long,start:long,length:long,text:string>>"
    docs = frame(spark, [(i, t, e) for i, (t, e) in enumerate(zip(texts, edits))], kind)
    got = {r.doc_id: r for r in edit_counts.count_edited(docs).collect()}
    assert [got[i].edited for i in (0, 1, 2, 4)] == ["x y", "new", "z abc", "abc"]
    assert got[3].edited == long[:50_000] + "inserted" + long[50_010:] and got[3].chars_encoded < 2000
    tool = edit_counts.encoding(edit_counts.RANKS, edit_counts.PATTERN)
    assert all(got[i].tokens_after == len(tool.encode_ordinary(got[i].edited)) for i in got) and got[4].tokens_before == got[4].tokens_after
    flat = frame(spark, [(2, 1, 0, 1, "Q"), (2, 2, 0, 0, "R"), (9, 1, 0, 0, "S")], "doc_id long, seq long, start long, length long, text string")
    joined = {r.doc_id: r.edited for r in edit_counts.count_edited(edit_counts.with_edits(docs, flat)).collect()}
    assert joined[2] == "RQbc" and joined[4] == "abc"
    assert edit_counts.count_edited(docs.limit(0)).count() == 0
