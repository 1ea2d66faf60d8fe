"""Leakage, mixing and text statistics."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.leakage import ItemIndex, best_passage, leaked_items, normal_words
from tidemark.llm.mixing import TOKENIZER, blocks_of, draw_plan, feasible_total, mix, quotas, reached_shares, split_tree, token_counter
from tidemark.llm.textstats import measures, statistics, text_statistics, verdict

WORDS = "the grey heron waits beside a shallow pond until some careless frog jumps from its stone and then strikes with one quick thrust of that long yellow bill before any ripple reaches the bank".split()
OTHER = "meanwhile seven tired farmers carried heavy baskets over frozen hills while distant bells were ringing loudly across every valley below them tonight".split()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "s", " ".join(WORDS), None), (2, "s", "too short", "x = " + " + ".join(OTHER)), (None, "s", " ".join(OTHER[::-1]), None), (1, "s", " ".join(WORDS), None)], "item_id bigint, suite string, prompt string, solution string").cache()


def test_normal_words():
    want = "a bold fish swam home".split()
    for text in ("A <b>bold</b> fish swam home", "// a bold\n// fish swam\n// home", '"a bold\\nfish" + \'swam\' home', "a&nbsp;bold fish&#44; swam home!", "а bоld fish swаm hömé", "1 | a bold\n2 | fish swam home", "> *a* __bold__ fi­sh SWAM home"):
        assert normal_words(text) == want, text


def passage(item, doc):
    item, doc = np.asarray(item), np.asarray(doc)
    return best_passage(item, doc, 0, len(item) - 1, -len(item), len(doc))


def test_align():
    a = np.arange(30)
    assert passage(a, np.r_[np.full(9, -1), a, np.full(9, -1)]) == (30, 0.0)
    span, rate = passage(a, np.delete(np.where(a == 9, -1, a), 20))
    assert span == 30 and abs(rate - 2 / 30) < 1e-9
    assert passage(a, np.full(5, -1))[0] == 0 and passage(a[:19], a[:19])[0] == 0


def edited(item, every, start=0, stop=None):
    """Every so many words changed."""
    out = np.array(item)
    out[start:stop][every - 1 :: every] = -7
    return out


def test_no_link_is_lost_to_what_stands_beside_it():
    a = np.arange(300)
    for n, gap in ((25, 10), (22, 8)):
        doc = a[: 2 * n + gap].copy()
        doc[n : n + gap] = -1
        assert passage(a, doc)[0] == n
    assert passage(a, np.r_[a[:30], edited(a[30:150], 5)])[0] == 30 + 4  # up to the first edit
    assert passage(a, np.r_[a[:40], edited(a[40:150], 5)])[0] == 40 + 4
    assert passage(a, edited(a[:150], 5))[0] == 0  # a fifth replaced throughout
    assert passage(a, edited(a[:150], 10))[0] >= 140
    doc = np.r_[edited(a[100:200], 4), np.full(200, -1), a[:25]]  # the poorer of two passages has the higher score
    assert passage(a, doc)[0] == 25


def test_areas_are_cut_without_loss(monkeypatch):
    """A long repeated passage is aligned in pieces of bounded size."""
    from tidemark.llm import leakage

    words = [f"w{k}" for k in range(120)]
    index = ItemIndex([(1, words * 3), (2, [f"v{k}" for k in range(25)])])
    text = ["x"] * 30 + words * 40 + ["y"] * 9 + [f"v{k}" for k in range(25)]
    want = index.found(text)
    assert want[1][0] == 360 and want[2] == (25, 0.0)
    monkeypatch.setattr(leakage, "MOST_ROWS", 200)
    monkeypatch.setattr(leakage, "MOST_BAND", 128)
    got = index.found(text)
    assert set(got) == {1, 2} and got[1][0] >= 200


def test_recall_and_precision_on_random_edits():
    """Passages of 22 to 139 words: everything at up to one edit in ten, hardly anything with a fifth replaced."""
    rng = np.random.default_rng(8)
    texts = [(k, [f"t{k}w{j}" if rng.random() < 0.5 else f"c{rng.integers(400)}" for j in range(int(rng.integers(60, 200)))]) for k in range(60)]
    index, found = ItemIndex(texts), {}
    for rate, kinds in ((0.0, "c"), (0.05, "cad"), (0.1, "cad"), (0.2, "c"), (0.3, "c")):
        for _ in range(100):
            k, words = texts[rng.integers(len(texts))]
            n = int(rng.integers(22, min(140, len(words))))
            at = int(rng.integers(0, len(words) - n + 1))
            edits, doc = set(rng.choice(n, round(rate * n), replace=False).tolist()), ["before"] * 40
            for j, w in enumerate(words[at : at + n]):
                kind = rng.choice(list(kinds)) if j in edits else " "
                doc += {"c": ["other"], "a": ["more", w], "d": [], " ": [w]}[kind]
            found.setdefault(rate, []).append(k in index.found(doc + ["after"] * 40))
    share = {rate: sum(x) / len(x) for rate, x in found.items()}
    assert share[0.0] == 1.0 and share[0.05] >= 0.99 and share[0.1] >= 0.98 and share[0.2] <= 0.12 and share[0.3] <= 0.03


def cases():
    swap = lambda every: [w if k % every else "other" for k, w in enumerate(WORDS, 1)]
    wrap = "\n".join("# " + " ".join(WORDS[i : i + 6]) for i in range(0, len(WORDS), 6))
    dropped = [w for k, w in enumerate(WORDS, 1) if k % 11]
    yield 1, " ".join(OTHER) + "\n" + wrap, {1, 2}
    yield 2, " ".join(swap(11)), {1}
    yield 3, " ".join(swap(5)), set()
    yield 4, " ".join(dropped), {1}
    yield 5, " ".join(WORDS[:12]), set()
    yield 6, " ".join(WORDS[3:25]).upper(), {1}
    yield 7, "f(" + ", ".join(OTHER) + ")" + " ".join(WORDS), {1, 2}
    yield 8, None, set()
    yield 9, "", set()
    yield 10, " ".join(WORDS[::-1]), set()
    yield 11, "filler words " * 200_000 + wrap, {1}


def test_leaks(spark, items):
    docs = spark.createDataFrame([(i, t) for i, t, _ in cases()], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    got: dict[int, set[int]] = {}
    for r in leaked_items(docs, items).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert got == {i: x for i, _, x in cases() if x}
    assert leaked_items(docs.where("false"), items).count() == 0
    assert leaked_items(docs, items.where("false")).count() == 0


def test_planted_passages(spark, sf):
    """Passages of the real items, edited at random, in real documents: all are found, and heavily edited ones aren't."""
    rng = np.random.default_rng(4)
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    carriers = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("length(text) > 50").limit(60).collect()]
    rows, want, never = [], set(), set()
    for k, r in enumerate(items.orderBy("item_id").limit(60).collect()):
        words = normal_words(r.prompt)
        n = int(rng.integers(26, 60))
        at = int(rng.integers(0, max(1, len(words) - n)))
        part = words[at : at + n]
        for edits, kept in ((set(rng.choice(len(part), len(part) // 12, replace=False)), want), (set(range(0, len(part), 4)), never)):
            text = " ".join("unrelated" if j in edits else w for j, w in enumerate(part))
            rows.append((len(rows), carriers[k % len(carriers)][:200] + "\n" + text))
            kept.add((rows[-1][0], r.item_id))
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert want <= got and not never & got


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_quotas():
    assert feasible_total({"a": 100, "b": 50}, {"a": (0.5, 1), "b": (0.5, 3)}) == 200.0
    assert quotas({"a": 100, "b": 50}, {"a": (0.5, 1), "b": (0.5, 3)}, 200) == {"a": 100.0, "b": 100.0}
    assert quotas({"a": 100}, {"a": (0.5, 2), "b": (0.5, 3)}, 1000) == {"a": 200.0}
    assert quotas({"a": 10, "b": 1000}, {"a": (0.5, 1), "b": (0.5, 1)}, 100) == {"a": 10, "b": 90.0}
    assert quotas({}, {"a": (0.5, 1)}, 10) == {} and quotas({"a": 5}, {"a": (0.0, 1), "b": (1.0, 0)}, 10) == {}
    assert quotas({"big": 10_000_000, "small": 300}, {"big": (0.5, 1), "small": (0.5, 2)}, 5_000_000) == {"small": 600, "big": 4_999_400.0}


def test_draws():
    sums = np.array([5, 5, 5, 5])
    passes, prefix, part = draw_plan("s", np.arange(4), sums, 47.0, 1)
    assert passes == 2 and len(prefix) == 1 and part[1] == 2.0 and part[0] not in prefix
    assert draw_plan("s", np.arange(4), sums, 40.0, 1)[0] == 2 and draw_plan("s", np.arange(4), sums * 0, 9.0, 1)[0] == 0
    assert blocks_of(0) == 64 and blocks_of(1 << 28) == 512 and blocks_of(1 << 60) == 4096


def test_tree_is_exact():
    draws = np.array([100, 7, 0, 393])
    dealt = split_tree(draws, 13, np.random.default_rng(1))
    assert (dealt.sum(axis=0) == draws).all() and np.ptp(dealt.sum(axis=1)) <= 1 and dealt.shape == (13, 4)


def test_mix(spark, sf):
    docs, targets = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    sample = mix(docs.withColumn("tokens", F.lit("clash")), targets, shards=8).cache()
    rows = reached_shares(sample, targets).collect()
    whole = sum(r.target_share for r in rows if r.tokens)
    size = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for r in rows:
        assert r.most_repeats <= r.max_repeats
        if r.copies < r.max_repeats * size.get(r.source, 0):  # else it has given all that it may
            assert r.actual_share > r.target_share / whole - 0.01
    got = sample.toPandas()
    assert not got.duplicated(["doc_id", "copy"]).any() and set(got["shard"]) == set(range(8))
    again = mix(docs.repartition(5), targets, shards=8).toPandas()
    key = ["doc_id", "copy", "shard", "shuffle_key"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.select("doc_id", "text").collect()}
    count = token_counter(TOKENIZER)
    assert all(sizes[i] >= n for i, n in zip(got["doc_id"], got["tokens"], strict=True)) and count("two words") == 2


def test_shards_are_whole_and_shuffled(spark, sf):
    docs, targets = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    rows = mix(docs, targets, shards=8).withColumn("at", F.spark_partition_id()).toPandas()
    assert (rows.groupby("shard")["at"].nunique() == 1).all()
    for _, shard in rows.groupby("shard", sort=False):
        assert shard["shuffle_key"].is_monotonic_increasing and not shard["doc_id"].is_monotonic_increasing


def test_a_small_source_does_not_set_the_size(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "small").otherwise("big").alias("source"), F.lit("one two three four five").alias("text"))
    targets = spark.createDataFrame([("small", 0.5, 4), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in reached_shares(mix(docs, targets, fraction=0.5), targets).collect()}
    assert rows["small"].copies == 12 and abs(rows["small"].copies + rows["big"].copies - 1500) <= 1


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a", "some words here"), (1, "a", "some words here"), (2, None, "x"), (3, "b", None), (4, "c", ""), (None, "a", "null id")], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("c", None, None), (None, 0.1, 1), ("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = mix(docs, targets, shards=2, total_tokens=1000)
    assert got.count() == 6 and got.where("source <> 'a'").count() == 0
    for d, t in ((docs.where("false"), targets), (docs, targets.where("false"))):
        empty = mix(d, t)
        assert empty.count() == 0 and reached_shares(empty, t).where("tokens > 0").count() == 0


# --- text statistics --------------------------------------------------------------------------------------------------

PROSE = "The grey heron waits beside a shallow pond, and nobody sees it.\nThen it strikes with one quick thrust.\n"
BLOB = "".join(base64.b64encode(np.random.default_rng(k).bytes(48)).decode() + "\n" for k in range(6))
KEEP = {
    "prose": PROSE,
    "terms": "1. You may copy this file for your own use as long as this notice\nstays in place with it.\n\n2. There is no promise of any kind, and nobody owes you a repair\nof anything at all.\n",
    "narrow": "A grey heron waits\nbeside the shallow pond\nuntil some frog\njumps from its stone\nand swims\n",
    "zeros": "int z[] = {\n" + "    0, 0, 0, 0, 0,\n" * 20 + "};\n",
    "array": "static const int t[] = {\n" + "    0x1897348f, 0x2be4c87c, 0xeb02d1c8,\n" * 20 + "};\n",
    "minified": 'var e={a:5,b:!1};g&&(s=x["k"]||[]).push(g);function et(t,u){return t*22+u.w}if(x>289)h(m,!0);else x--;' * 4,
    "yaml": "servers:\n  - name: one\n    port: 80\n  - name: two\n    port: 81\n",
    "yaml lists": "".join(f"{a.title()}:\n  - {b} {a} value\n" for a, b in zip(OTHER, WORDS)),
    "json": '{\n  "a": {"mode": "R", "n": 3},\n  "b": {"mode": "W", "n": 4}\n}\n',
    "html": "<ul>\n<li>One thing</li>\n<li>Another thing</li>\n</ul>\n" + "<p>Some more text that goes on.</p>\n" * 2,
    "german": "Eine alte Reihe schreibt der Stufe, obwohl die Grenze ohne Fehler bleibt.\nDie kleine Lücke prüft das Ende.\n",
    "embedded": "def key(x):\n    y = load(x, 3)\n    if y is None:\n        return None\n    k = decode(y)\n    return k\n" + '"""\n' + BLOB + '"""\n',
    "comments": "int f(const int *x) {\n/*\n" + " * the heron waits on the other side, since that one might go its\n * way at any time and then nobody can say where it is\n * unless some of them had been there before it was gone\n */\n    int y = g(x);\n    return y;\n}\n",
    "sentences": "The terms are these.\n1. You may copy this file for your own use as long as this notice stays in place with it and can be read.\n"
    "2. There is no promise of any kind that it will do what you want, and nobody owes you a repair of it.\n"
    "3. If one of these terms can not hold where you live, then all of the others are still in force there.\n",
    "commas": "He came, saw it, and went.\nIt was late, dark, cold and wet in the town.\nNobody spoke of it, or of him, or of the house, for as long as they were there.\n",
    "russian": "Старая цапля стоит у воды, и никто её не видит.\nПотом она ловит лягушку.\n",
    "chinese": "苍鹭在浅水边等待。\n然后它抓住了青蛙。\n",
    "empty": "",
    "blank": " \n\n \t\n",
}
DROP = {
    "bullets": "# Changes\n" + "".join(f"* fix the {w} page (#{k})\n" for k, w in enumerate(WORDS)),
    "long bullets": "".join("- " + " ".join(WORDS[k % 20 : k % 20 + 10]) + "\n" for k in range(40)),
    "very long bullets": "".join("- " + " ".join(WORDS[k % 9 : k % 9 + 25]) + "\n" for k in range(40)),
    "two-word cells": "id,full name,x\n" + "".join(f"{k},{a} {b},{k * 1.5}\n" for k, (a, b) in enumerate(zip(OTHER, OTHER[1:]))),
    "empty last cells": "id,name,x,\n" + "".join(f"{k},{w},{k * 1.5},\n" for k, w in enumerate(WORDS)),
    "two columns": "".join(f"{w},{k}\n" for k, w in enumerate(OTHER)),
    "quoted cells": "".join(f'{k},"{w}, {w}",{k}\n' for k, w in enumerate(WORDS)),
    "passage over and over": "The heron waits beside the pond until it sees a frog. " * 40,
    "same line": PROSE + "This page was left empty.\n" * 30,
    "same paragraph": PROSE + (PROSE + "\n") * 9,
    "period three": "abc" * 100,
    "numbers": "".join(f"{k}. Small {w}.\n" for k, w in enumerate(WORDS)),
    "words": "\n".join(WORDS) + "\n",
    "csv": "id,name,x\n" + "".join(f"{k},{w},{k * 1.5}\n" for k, w in enumerate(WORDS)),
    "pipes": "| a | b |\n|---|---|\n" + "".join(f"| {w} | {k} |\n" for k, w in enumerate(WORDS)),
    "aligned": "".join(f"{w:<14}{k:>6}{k * 1.25:>9.2f}  ok\n" for k, w in enumerate(WORDS)),
    "aligned after a word": "The rows are these, and they were not in the log as it was.\nAnd the rest of it is with them.\n" + "".join(f"{w:<14}{k:>6}{k * 1.25:>9.2f}  ok\n" for k, w in enumerate(WORDS)),
    "log": "".join(f"2024-01-02 03:04:{k:02d} INFO {w} done\n" for k, w in enumerate(WORDS)),
    "hex": "".join(f"{16 * k:08x}  f0 35 6a 1f 2f b9 5f 09 ba 29 55 25 80 ba 53 f3\n" for k in range(20)),
    "base64": "fWdD2ifmO80bBH2dJTA3mj+4EOPyJdidlbM8oR+VcOnhPY8FerUYJtJHiQy0BB3sqp7ohsagm+F8\n" * 3 + "Bn07cUTsJeIcLb91edpaPfSw2WecNuKyXkI+jzn5lQrV+dy+Fykm73myX4e6t/EboTO1aLYqZ+3=\n",
    "rules": "##################\n*****************\n-------------------\n" * 3,
    "consonants": "nnhxx xlldv lzfqsvgqdp pfdpbfjqrbhcct hczgjc vggfkfzkfqhpl\nhz xsmrnflh bzpmw mblfkbjdxh xjbszrcfpgtvdj\n",
    "random": "┈┻:┭┹äÍØ╕┛�5Ø┴╁╂┪%�┧╜7�┡<��╊7Æ┤÷╌Íï�╽�ÑÖ┈ÀÜ\n",
    "locks": "".join(f"{w} 1.{k}.0 a8a2e9a3375705093932a21d\n" for k, w in enumerate(WORDS)),
}


@pytest.mark.parametrize(("name", "text", "want"), [(k, v, False) for k, v in KEEP.items()] + [(k, v, True) for k, v in DROP.items()], ids=[*KEEP, *DROP])
def test_kinds(name, text, want):
    assert statistics(text)[-1] is want


def changed_without(*names, instead=0.0):
    """The texts of KEEP and DROP whose verdict changes when statistics are set to a constant."""
    out = set()
    for name, text in (KEEP | DROP).items():
        s = measures(text)
        before = verdict(s)
        vars(s).update(dict.fromkeys(names, instead))
        if verdict(s) != before:
            out.add(name)
    return out


def test_every_statistic_decides_something():
    assert {"period three"} <= changed_without("periodic_share") and {"passage over and over"} <= changed_without("repeated_5grams")
    assert {"same line", "same paragraph"} <= changed_without("duplicate_lines", "duplicate_paragraphs", "top_2gram", "top_3gram", "top_4gram", "repeated_5grams")
    assert "random" in changed_without("symbol_ratio", "control_ratio") and "consonants" in changed_without("vowel_ratio", instead=1.0)
    assert {"comments", "sentences"} <= changed_without("common_words")
    assert "sentences" in changed_without("punctuated_lines") and "sentences" in changed_without("item_words")
    assert "aligned after a word" in changed_without("digit_ratio")
    assert {"zeros", "embedded", "comments"} <= changed_without("source_share") and "yaml lists" in changed_without("config_share")


def test_statistics(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, None), (None, ""), (1, PROSE), (5, "a,b,c\n" * 300_000)], "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in text_statistics(docs).collect()}
    assert text_statistics(docs).count() == 5
    r = got[1]
    assert (r.n_words, r.n_lines, r.punctuated_lines, r.duplicate_lines) == (19, 2, 1.0, 0.0)
    assert abs(r.common_words - 7 / 19) < 0.2 and 3.5 < r.mean_word_length < 5
    assert got[2].n_chars == 0 and not got[2].not_prose and got[5].not_prose and got[5].duplicate_lines > 0.99
    assert text_statistics(docs.where("false")).count() == 0


def test_long_texts_take_linear_time():
    import time

    for text in ("a" * 400_000, "x(" * 200_000, "- " * 200_000, "\t" * 400_000 + "x", "a b  " * 80_000, "1 " * 200_000, "=" * 400_000, "&lt;<p " * 60_000):
        began = time.time()
        statistics(text)
        normal_words(text)
        assert time.time() - began < 20, text[:10]


def test_queries_run(spark, sf):
    for name, f in queries.queries().items():
        assert f(spark, sf).count() >= 0, name
